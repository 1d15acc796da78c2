"""Plain versions of the corpus operators, on few texts."""

import re
import struct
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(texts: dict, size: int, percent: int = 80) -> dict:
    """Least reachable id by id, all pairs compared."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def _long(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed & (2**64 - 1))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def chunks(text: str, solo: int = 50) -> list[tuple[int, int]]:
    """First and last line (from 0) of the content-defined chunks of a text."""
    lines = text.split("\n")
    h = [_signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
    r = [_signed(_long(b, _long(a, 42))) for a, b in zip([0, *h], h)]
    long_ = [x.count(" ") >= solo - 1 for x in lines]
    low = -(2**63)
    out, start = [], 0
    for i in range(len(lines)):
        before, after = r[i - 1] if i else low, r[i + 1] if i + 1 < len(r) else low
        if (r[i] > before and r[i] >= after) or long_[i] or i + 1 == len(lines) or long_[i + 1]:
            out.append((start, i))
            start = i + 1
    return out


def without_repeats(texts: dict, solo: int = 50) -> dict:
    """Texts without chunks of several lines, or of a long one, that stand somewhere earlier."""
    seen, out = set(), {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = None
            continue
        lines, kept = texts[i].split("\n"), []
        for a, b in chunks(texts[i], solo):
            part = lines[a : b + 1]
            if (len(part) > 1 or part[0].count(" ") >= solo - 1) and any(x.strip(" ") for x in part):
                if tuple(part) in seen:
                    continue
                seen.add(tuple(part))
            kept += part
        out[i] = "\n".join(kept)
    return out


def runs(text: str, n: int = 50) -> set[tuple[int, int]]:
    """The shortest runs of lines with ``n`` words that begin, and that end, with each line (from 0)."""
    sizes = [min(n, 1 + sum(c in " \t" for c in x.strip(" "))) for x in text.split("\n")]
    out = set()
    for i in range(len(sizes)):
        ahead = next((j for j in range(i, len(sizes)) if sum(sizes[i : j + 1]) >= n), None)
        behind = next((j for j in range(i, -1, -1) if sum(sizes[j : i + 1]) >= n), None)
        out |= {(i, ahead)} if ahead is not None else set()
        out |= {(behind, i)} if behind is not None else set()
    return out


def without_passages(texts: dict, n: int = 50) -> dict:
    """Texts without the lines of chunks and of runs of ``n`` words that stand somewhere earlier."""
    first, spans = {}, {}
    for i in sorted(k for k, t in texts.items() if t is not None):
        lines = texts[i].split("\n")
        own = {(a, b) for a, b in chunks(texts[i], n) if b > a or lines[a].count(" ") >= n - 1} | runs(texts[i], n)
        spans[i] = [(a, b, tuple(lines[a : b + 1])) for a, b in sorted(own) if any(x.strip(" ") for x in lines[a : b + 1])]
        for a, b, part in spans[i]:
            first.setdefault(part, (i, a, b))
    out = {i: t for i, t in texts.items() if t is None}
    for i, own in spans.items():
        gone = set()
        for a, b, part in own:
            at, start, stop = first[part]
            if at != i or stop < a:
                gone |= set(range(a, b + 1))
        out[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone) if gone else texts[i]
    return out


PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]")


def leaks(texts: dict, items: dict, size: int = 5, least: float = 0.8) -> dict:
    """(doc, item) with the best window's (similarity, start), every window compared."""

    def words(t):
        return PUNCTUATION.sub(b" ", (t or "").encode().lower()).split()

    def bag(w):
        return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)])

    own = {k: words(t) for k, t in items.items() if words(t)}
    bags = {k: bag(w) for k, w in own.items()}
    df = Counter(s for b in bags.values() for s in b)
    weight = {s: (len(bags) // n).bit_length() for s, n in df.items()}
    full = len(bags).bit_length()
    out = {}
    for d, t in texts.items():
        w = words(t)
        for k, item in own.items():
            for start in range(max(1, len(w) - len(item) + 1)) if w else ():
                b = bag(w[start : start + len(item)])
                total = sum(v * weight[s] for s, v in bags[k].items()) + sum(v * weight.get(s, full) for s, v in b.items())
                both = sum(min(v, bags[k][s]) * weight[s] for s, v in b.items() if s in bags[k])
                sim = both / (total - both)
                if sim >= least and sim > out.get((d, k), (0,))[0]:
                    out[d, k] = (sim, start)
    return out


SECRETS = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    (re.compile("[0-9a-f]+"), 0, 24),
)


def secrets(text) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= n)


def statistics(text) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    at: dict = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
