"""Token alignment, web archives and phrases against plain versions, as registered and on odd rows."""

import base64
import bisect
import gzip
import glob
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from typeloom.llm import alignment, archives, phrases, units
from typeloom.llm.queries import QUERIES
from typeloom.session import fresh_path

SF = "/root/testdata/sf0.001"
PAIR = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


# --- alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PAIR[0])
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PAIR[1])
    table, names = alignment.level_bytes(), {i: t for t, i in library.get_vocab().items()}
    a_bytes = lambda i: bytes(table[c] for c in names[i])
    b_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    links, found = [], []
    for _, text in rows:
        links.append([])
        found.append((0, 0, 0, ""))
        if not text:
            continue
        a, b, raw = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), (" " + text).encode()
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            continue
        ends = []
        for ids, size in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids:
                at += len(size(i))
                own.append(at)
            ends.append(own)
        i = j = 0
        while i < len(a):
            links[-1].append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [defaultdict(list), defaultdict(list)]
        for side, ids in enumerate((a, b)):
            for end, token in zip(ends[side], ids):
                groups[side][bisect.bisect_left(shared, end)].append(str(token))
        text = ";".join(",".join(groups[0][g]) + "|" + ",".join(groups[1][g]) for g in range(len(shared)))
        found[-1] = (len(a), len(b), len(shared), hashlib.sha256(text.encode()).hexdigest())
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, *f[:3], len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), f[3]) for (i, _), f, own in zip(rows, found, links)]


ODD_TEXTS = [
    (None, "hello ▁"), (1000, None), (1001, ""), (1002, "  a  b "), (1003, "x▁y z"), (1004, "foo <|endoftext|> <s> bar"), (1004, "the the"),
    (1004, "the the"), (1005, " "), (1006, "a\x00b c"), (1007, "\n\n\t q"), (1008, "日本 語 ü"), (1009, "<0x41> <unk> </s>"), (1010, "long " * 20_000),
]


@pytest.mark.parametrize("sizes", [{}, {"piece": 7, "chunk_bytes": 50_000}])
def test_alignment_against_a_plain_version(spark, sizes):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80).collect()] + ODD_TEXTS
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_A", F.lit("x")).withColumn("pair", F.lit(1)).repartition(3)
    assert ordered(alignment.aligned(docs, alignment.Pair(*PAIR, **sizes)).collect()) == ordered(plain_alignment(rows))
    bad = docs.filter("doc_id IN (1000, 1001, 1003)")
    assert ordered(alignment.aligned(bad, alignment.Pair(*PAIR)).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1000, 1001, 1003)]
    assert alignment.aligned(docs.limit(0), alignment.Pair(*PAIR)).count() == 0


def test_alignment_as_registered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert ordered(QUERIES["op11_token_alignment"](spark, SF).collect()) == ordered(plain_alignment([tuple(r) for r in docs.collect()]))


def test_pieces_of_the_merge_path_are_put_together():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(np.append(r.integers(1, 60, r.integers(1, 40)), 60)) for _ in range(2))
        whole = None
        for piece in (1, 2, 3, 7, 1000):
            of_a, of_b, last_a, last_b = alignment.overlaps(a, b, piece)
            links = sorted(zip(of_a.tolist(), of_b.tolist()))
            ends = sorted({*a.tolist(), *b.tolist()})
            assert links == sorted((bisect.bisect_left(a.tolist(), e), bisect.bisect_left(b.tolist(), e)) for e in ends)
            assert a[last_a].tolist() == b[last_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
            assert whole in (None, links)
            whole = links


def test_units_join_to_their_texts():
    import pyarrow as pa

    texts = ["a b", " a", "a  b c", "", None, "a\n b", "  x", "x y ", "<e> q r"]
    for lead in ("", " "):
        cut = units.cut(pa.array(texts), lead, ["<e>"])
        own = [[cut.texts[c] for c in cut.codes[a:b]] for a, b in zip(cut.begin, cut.begin[1:])]
        assert ["".join(x) for x in own] == [lead + (t or "") for t in texts]
        assert len(own[0]) == 2 and len(own[8]) == 1


def test_units_end_with_their_lines():
    import pyarrow as pa

    texts = ["a.\nB c\n\n\nd", "\nB a", "x\t\ny", "B", None, "", "a  b\nB", "e\n"]
    cut = units.cut(pa.array(texts), lines=True)
    own = [[cut.texts[c] for c in cut.codes[a:b]] for a, b in zip(cut.begin, cut.begin[1:])]
    assert ["".join(x) for x in own] == [t or "" for t in texts]
    assert own[0] == ["a.", "\nB", " c", "\n\n\nd"] and own[2] == ["x\t\ny"] and own[7] == ["e", "\n"]
    assert len(set(cut.texts)) == len(cut.texts)


# --- archives


def plain_archive(rows):
    first, out = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((key, len(raw), digest, *(("revisit", first[raw]) if raw in first else ("response", None))))
        first.setdefault(raw, key)
    return out


def test_archives_as_registered(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert ordered(QUERIES["op12_web_archives"](spark, SF).collect()) == ordered(plain_archive(pages))


def test_archives_of_odd_pages(spark):
    pages = [
        (1, "http://a b\n", "x"), (2, None, "x"), (3, "http://q", None), (4, "http://q", ""), (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\n\nfiledesc:// 5\n"),
        (5, "u", "ü\x00\n"), (5, "u", "ü\x00\n"), (None, "u", "x"), (None, None, "HTTP/1.1 \r\n\r\n"), (6, "v", "long " * 200_000),
    ]
    rows = spark.createDataFrame(pages, "key long, url string, payload string").withColumn("date", F.lit("2024")).withColumn("ID", F.lit(0)).repartition(3)

    def through(spec):
        out = archives.through_archives(rows, spec, F.col("key").cast("long"))
        return ordered(out.select(F.col("key").cast("long"), "payload_bytes", "payload_digest", "type", F.col("refers_to").cast("long")).collect())

    plain = plain_archive([(k, p) for k, _, p in pages])
    assert through(archives.Archives(per_file=2)) == ordered(plain)
    assert through(archives.Archives(compression="none", least_bytes=3)) == ordered((*r[:3], *(r[3:] if r[1] >= 3 else ("response", None))) for r in plain)
    assert archives.through_archives(rows.limit(0), archives.Archives()).count() == 0


def test_foreign_archives(spark, tmp_path):
    body, image = b"HTTP/1.0 200 OK\r\n\r\n\xff\xfe\x00bin\n", b"GIF89a\xff\xfe"
    fields = {n: " ".join(archives.FIELDS[n]) for n in (1, 2)}
    for n, later in ((1, ""), (2, "200 - - 0 x.arc ")):
        block = f"{n} 0 someone\n{fields[n]}\n".encode()
        records = b"".join(b"%s 1.2.3.4 %s %s %s%d\n%s\n" % (u, d, m, later.encode(), len(x), x) for u, d, m, x in ((b"http://x y/", b"199801021530", b"text/html", body), (b"ftp://z", b"19980102153000", b"image/gif", image)))
        (tmp_path / f"{n}.arc").write_bytes(b"filedesc://x.arc 0.0.0.0 19980101 text/plain %s%d\n%s\n%s" % (later.encode(), len(block), block, records))
    with gzip.open(tmp_path / "3.arc.gz", "wb") as f:
        f.write((tmp_path / "1.arc").read_bytes())
    out = fresh_path(spark, "test-warc")
    archives.convert(spark, str(tmp_path), out, archives.Archives(compression="none"))
    back = archives.read_back(spark, out).collect()
    assert Counter((r["type"], r["uri"], r["payload_bytes"]) for r in back) == {("response", "http://x%20y/", 7): 1, ("revisit", "http://x%20y/", 7): 2, ("resource", "ftp://z", 8): 1, ("revisit", "ftp://z", 8): 2}
    raw = b"".join(open(f, "rb").read() for f in glob.glob(f"{out}/*.txt"))
    assert raw.count(body[-7:]) == 1 and raw.count(b"WARC-Date: 1998-01-02T15:30:00Z\r\n") == 6 and b"WARC-IP-Address: 1.2.3.4" in raw
    (tmp_path / "4.arc").write_bytes(b"http://short 1.2.3.4 19980102153000 text/html 99\nabc\n")
    with pytest.raises(Exception, match="99 bytes are declared"):
        archives.convert(spark, str(tmp_path), fresh_path(spark, "test-warc"), archives.Archives())


# --- phrases


def plain_phrases(rows, least, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        own = f[lang or "und"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, a in held.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= 80 * own[q[i : i + k]]}
        kept = []
        for p in held.keys() - gone:
            score, k = min((2_000_000 * held[p] // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -held[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return ordered(out)


def test_phrases_as_registered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    assert ordered(QUERIES["op13_phrases"](spark, SF).collect()) == plain_phrases([tuple(r) for r in docs.collect()], 30, 2000)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 20, "bucket": 3}, {"top": 2}])
def test_phrases_of_odd_texts(spark, sizes):
    rows = [("a", "x y z q. X Y z Q")] * 4 + [(None, "a\ta a a a\x0bb a a")] * 3 + [("a", None), ("b", ""), ("b", " . "), ("c", "solo"), ("d", "so long " * 20_000)]
    rows += [(None, "p q\x00 p q\x00 é É p")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("N", F.lit(1)).withColumn("w1", F.lit(2)).repartition(3)
    spec = phrases.Phrases(least=2, **sizes)
    assert ordered(phrases.mined(docs, spec).collect()) == plain_phrases(rows, 2, spec.top)
    assert phrases.mined(docs.limit(0)).count() == 0
