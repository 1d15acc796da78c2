"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

The merges decide locally: a sequence of tokens is the BPE encoding of its bytes exactly if each pair of
neighbours is the encoding of its own bytes. So a non-deterministic transducer reads a piece byte by byte
with hypotheses (last finished token, bytes read after it), of which one at most finishes a token at any
byte that fits its last one. Its subsets are the states of a deterministic transducer that are made when
first met; each step yields the last token of what has been read, and the tokens follow from the end.
Hypotheses live no longer than the longest token, so that all of them agree on whatever lies further back:
in a long piece that is emitted as reading goes on. States, and the ids of words, are kept up to a bound
and then made anew.

Texts are cut into pieces by the tokenizer's pattern; no piece goes on over a single space that follows and
precedes other characters, so that units of text (``units.cut``) are encoded one by one: each distinct one of a batch
is looked up once, and goes through the transducer if it was not met of late.

Decoding reads ids one by one; an incremental UTF-8 machine holds back the bytes of a character that is not
complete. Ill-formed bytes become U+FFFD as in Python's decoder, so any list of ids can be decoded.

Defined results: null text encodes like an empty one: no ids. Ids outside the vocabulary raise an error. Repeated rows each
give their result; long texts are read whole, one row at a time.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held
from .units import Recent, cut, expand, flattened, runs

Hypothesis = tuple[int, bytes]  # the last finished token (-1: none), the bytes read after it


@dataclass(frozen=True)
class Vocabulary:
    """A file of base64 tokens with ranks, and the pattern whose matches are encoded one by one."""

    path: str
    pattern: str


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State(dict):
    """A subset of hypotheses; by byte the next state and the last token, found when first asked for."""

    __slots__ = ("live", "machine")

    def __init__(self, live: tuple[Hypothesis, ...], machine: "Transducer"):
        self.live, self.machine = live, machine

    def __missing__(self, byte: int) -> tuple["State", int]:
        self[byte] = found = self.machine.step(self.live, byte)
        return found


class Transducer:
    KEEP_STATES = 150_000
    KEEP_WORDS = 250_000
    KEEP_FITS = 250_000
    #: In a longer piece, what all hypotheses agree on is emitted every so many bytes.
    FLUSH = 4096

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        #: By bytes that are a token or that one begins with: its id (-1: none), and the same bytes, one object for all
        #: states, where a longer token begins so.
        begun = {k[:i] for k in ranks for i in range(1, len(k))}
        self.heads: dict[bytes, tuple[int, bytes | None]] = {k: (ranks.get(k, -1), k) for k in begun}
        self.heads.update((k, (v, None)) for k, v in ranks.items() if k not in begun)
        self.halves: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple[Hypothesis, ...], State] = {}
        #: Ids of units, and of the pieces of units that have several.
        self.words = Recent(self.KEEP_WORDS)

    def _state(self, live: tuple[Hypothesis, ...]) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State(live, self)
        return found

    def _bound_states(self) -> None:
        if len(self.states) > self.KEEP_STATES:
            for state in self.states.values():  # they refer to each other
                state.clear()
            self.states.clear()

    def merges(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """The plain merge loop on a few bytes: the lowest rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[int, bytes, bytes]:
        """The rank of a token's last merge and the two tokens it joined; rank -1 for a single byte."""
        found = self.halves.get(token)
        if found is None:
            parts = self.merges(token, 2)
            found = self.halves[token] = (self.ranks[token], parts[0], parts[1]) if len(parts) == 2 else (-1, b"", b"")
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes: no merge over the border comes first.

        The merges of both are taken back, the latest first, which gives all tokens that ever meet at the border. Of
        equal ranks the leftmost merges first: at the left token's border its own, at the right one's the one over
        the border.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.KEEP_FITS:
                self.fits.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            until_a = until_b = 1 << 40
            while True:
                over = self.ranks.get(a + b)
                if over is not None and over < until_a and over <= until_b:
                    known = False
                    break
                since_a, _, tail = self._split(a)
                since_b, head, _ = self._split(b)
                if since_a < 0 and since_b < 0:
                    known = True
                    break
                if since_a >= since_b:
                    a, until_a = tail, since_a
                if since_b >= since_a:
                    b, until_b = head, since_b
            self.fits[key] = known
        return known

    def step(self, live: tuple[Hypothesis, ...], byte: int) -> tuple[State, int]:
        """The next state, and the last token of the encoding of all bytes read."""
        more = bytes((byte,))
        heads = self.heads
        alive: list[Hypothesis] = []
        done = -1
        for last, read in live:
            now = read + more
            head = heads.get(now)
            if head is None:
                continue
            token, longer = head
            # One hypothesis is the encoding of what has been read.
            if done < 0 <= token and (last < 0 or self._fit(last, token)):
                done = token
            if longer is not None:
                alive.append((last, longer))
        if done < 0:
            raise ValueError("the vocabulary lacks a byte")
        alive.append((done, b""))
        return self._state(tuple(alive)), done

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the encoding of the first ``at`` bytes, the last first."""
        out, size_of = [], self.size_of
        while at > 0:
            token = ends[at]
            out.append(token)
            at -= size_of[token]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        self._bound_states()
        state = self._state(((-1, b""),))
        ends, out = [-1], []
        for begin in range(0, len(piece), self.FLUSH):
            for byte in piece[begin : begin + self.FLUSH]:
                state, token = state[byte]
                ends.append(token)
            if begin + self.FLUSH < len(piece):
                ends, state = self._flush(ends, state, out)
        tokens = self._back(ends, len(ends) - 1)
        tokens.reverse()
        return out + tokens if out else tokens

    def _flush(self, ends: list[int], state: State, out: list[int]) -> tuple[list[int], State]:
        """Emits the tokens that all live hypotheses agree on; what is left."""
        chains = [self._back(ends, len(ends) - 1 - len(read))[::-1] for _, read in state.live]
        agreed = 0
        while all(agreed < len(c) for c in chains) and len({c[agreed] for c in chains}) == 1:
            agreed += 1
        out += chains[-1][:agreed]
        gone = sum(self.size_of[t] for t in chains[-1][:agreed])
        self._bound_states()
        return [-1, *ends[gone + 1 :]], self._state(state.live)

    def _encoded(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        return array("I", self.encode_piece(piece.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.words.recall(piece)
        if ids is None:
            ids = self._encoded(piece)
            self.words.note(piece, ids)
        return ids

    def packed(self, text: str) -> bytes:
        pieces = self.find(text)
        return self._encoded(text) if len(pieces) == 1 else b"".join(map(self._piece, pieces))

    def _units(self, units: list[str]) -> list[bytes]:
        return self.words.all(units, lambda lacking: list(map(self.packed, lacking)))

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text``, as little-endian unsigned 32-bit integers."""
        return b"".join(self._units(runs(text))) if text else b""

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin: each distinct unit is looked up once."""
        units = cut(texts)
        ids, at = expand(*flattened(self._units(units.texts)), units.codes)
        return ids, at[units.begin]


def _utf8_machine() -> list[list[int]]:
    """By state and byte the next state: 0 between characters, 1 to 3 so many bytes to come, 4 to 7 with
    a narrower range for the next byte (after E0, ED, F0, F4), -1 ill-formed."""
    table = [[-1] * 256 for _ in range(8)]
    table[0][:0x80] = [0] * 0x80
    for low, high, state in ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEF, 2), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        table[0][low : high + 1] = [state] * (high + 1 - low)
    for state, low, high, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][low : high + 1] = [then] * (high + 1 - low)
    return table


UTF8 = _utf8_machine()


def advance(held: bytes, more: bytes) -> tuple[str, bytes]:
    """The characters that ``more`` completes after the bytes held back, and what is held back then."""
    data = held + more
    out: list[str] = []
    state = good = begin = at = 0  # data[good:begin] is well-formed; a character is under way since begin
    while at < len(data):
        then = UTF8[state][data[at]]
        if then < 0:
            out += data[good:begin].decode(), "\ufffd"
            at += state == 0  # a byte that breaks off a character is looked at again
            good = begin = at
            state = 0
            continue
        at += 1
        state = then
        if state == 0:
            begin = at
    return "".join(out) + data[good:begin].decode(), data[begin:]


class Decoder:
    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        top = max(bytes_of) + 1
        steps = [advance(b"", bytes_of.get(i, b"")) for i in range(top)]
        #: What an id gives between characters, and whether that is well-formed and ends between characters again.
        self.text_of = [text for text, _ in steps]
        self.whole = np.array([not held and "\ufffd" not in text for text, held in steps])
        self.data = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.begin = np.cumsum([0, *(len(bytes_of.get(i, b"")) for i in range(top))])

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as far as it is complete, id by id."""
        held = b""
        for i in ids:
            text, held = advance(held, self.bytes_of[i])
            yield text
        if held:
            yield "\ufffd"

    def decode(self, ids: np.ndarray) -> str:
        """The whole text: the machine runs from each id that leaves a character open until one closes it."""
        values = ids.tolist()
        out: list[str] = []
        at, size = 0, len(values)
        for open_ in np.flatnonzero(~self.whole[ids]).tolist():
            if open_ < at:
                continue
            out += map(self.text_of.__getitem__, values[at:open_])
            held, at = b"", open_
            while at < size and (held or at == open_):
                text, held = advance(held, self.bytes_of[values[at]])
                out.append(text)
                at += 1
            if held:
                out.append("\ufffd")
        out += map(self.text_of.__getitem__, values[at:])
        return "".join(out)


    def _closes(self, ids: np.ndarray) -> bool:
        """Whether the machine finds well-formed characters wherever an id leaves one open."""
        at, size = 0, len(ids)
        for open_ in np.flatnonzero(~self.whole[ids]).tolist():
            if open_ < at:
                continue
            held, at = b"", open_
            while at < size and (held or at == open_):
                text, held = advance(held, self.bytes_of[int(ids[at])])
                if "\ufffd" in text:
                    return False
                at += 1
            if held:
                return False
        return True

    def utf8(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """What the ids of each text decode to, in UTF-8: the ids' bytes, but where the machine finds them ill-formed."""
        data, at = expand(self.data, self.begin, ids)
        raw, cuts = data.tobytes(), at[begin].tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(begin, np.flatnonzero(~self.whole[ids]), "right") - 1).tolist():
            own = ids[begin[k] : begin[k + 1]]
            if not self._closes(own):
                out[k] = self.decode(own).encode()
        return out


def transducer(vocabulary: Vocabulary) -> tuple[Transducer, Decoder]:
    def make() -> tuple[Transducer, Decoder]:
        made = Transducer(read_ranks(vocabulary.path), vocabulary.pattern)
        return made, Decoder(made.bytes_of)

    return held(("bpe", vocabulary), make)


def _lists(ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.view("<i4")))


def encoded(vocabulary: Vocabulary, text: Column) -> Column:
    """The ids of a text column, as an array of int."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec, _ = transducer(vocabulary)
        return _lists(*codec.encode_all(texts))

    return encode.asNondeterministic()(text)


def decoded(vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of an array of ids; null stays null."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        _, decoder = transducer(vocabulary)
        return pa.array([None if x is None else decoder.decode(np.array(x, np.int64)) for x in lists.to_pylist()], pa.string())

    return decode.asNondeterministic()(ids)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with the digests of its texts' ids and of what they decode to.

    Adds n_tokens, ids_sha256 (of little-endian unsigned 32-bit integers) and decoded_sha256 (of UTF-8);
    columns of these names are replaced.
    """

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        codec, decoder = transducer(vocabulary)
        ids, begin = codec.encode_all(texts)
        packed, cuts = ids.tobytes(), (4 * begin).tolist()
        ids_sha = [sha256(packed[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        text_sha = [sha256(x).hexdigest() for x in decoder.utf8(ids, begin)]
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(begin)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
        )

    name = fresh(docs, "_digest")
    out = docs.withColumn(name, digest.asNondeterministic()(F.col("text")))
    return out.withColumns({c: F.col(name)[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(name)


def tokenised(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with the ids of its texts, their number, and whether they decode to the text again.

    Adds ids, n_tokens and exact; columns of these names are replaced. A null text counts as empty.
    """

    @F.arrow_udf("struct<ids: array<int>, exact: boolean>")
    def encode(texts: pa.Array) -> pa.Array:
        codec, decoder = transducer(vocabulary)
        ids, begin = codec.encode_all(texts)
        exact = [x == (t or "").encode() for x, t in zip(decoder.utf8(ids, begin), texts.to_pylist())]
        return pa.StructArray.from_arrays([_lists(ids, begin), pa.array(exact, pa.bool_())], ["ids", "exact"])

    name = fresh(docs, "_encoded")
    out = docs.withColumn(name, encode.asNondeterministic()(F.col("text")))
    return out.withColumns({"ids": F.col(name)["ids"], "n_tokens": F.size(F.col(name)["ids"]).cast("long"), "exact": F.col(name)["exact"]}).drop(name)
