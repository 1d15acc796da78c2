"""Texts as sequences of units, so that what is the same for a unit is worked out once in a batch.

A unit is a word with the space before it. Tokenizers of bytes or of pieces that begin with a space encode
such units one by one: none of their tokens goes on over a single space that follows and precedes other
characters. Where spaces stand next to other white space, the unit goes on to the next space that parts.
Tokenizers with GPT-2's pattern part a line from the one before it as well, and a word from the mark that ends its unit.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: White space in the sense of any library, and a space next to it or at an end of the text.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = f"^ | $|{_WHITE} | {_WHITE}"
#: A line end behind white space that is no line end: where it begins a token is another matter.
MIXED = r"[\t\f\r\x0b\x1c-\x1f\x{85}\p{Z}]\n"
#: How byte-level vocabularies write the space at the begin of a token.
SPACE = "Ġ"
#: And the line end.
LINE = "Ċ"
#: Letters of two bytes at most, in UTF-8 none with the byte C2, that have been letters for long: Latin, Greek, Cyrillic.
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f"


@dataclass
class Units:
    """Distinct units, the unit at each place, and where each text's places begin (n + 1 entries)."""

    texts: list[str]
    codes: np.ndarray
    begin: np.ndarray


def runs(text: str, lead: str = "") -> list[str]:
    """The units of a text, whatever its white space; ``lead`` stands before the text."""
    first, *rest = text.split(" ")
    out, unit = [], lead + first
    for word in rest:
        if unit and word and not unit[-1].isspace() and not word[0].isspace():
            out.append(unit)
            unit = " " + word
        else:
            unit += " " + word
    out.append(unit)
    return out


def _lines_parted(texts: pa.Array) -> pa.Array:
    """Texts with a space before the line ends that follow other characters, as long as no other white space precedes one."""
    parted = pc.replace_substring(texts, "\n", " \n")
    for _ in range(2):  # the second time what overlapped
        parted = pc.replace_substring(parted, "\n \n", "\n\n")
    return pc.if_else(pc.match_substring_regex(texts, MIXED), texts, parted)


def cut(texts: pa.Array, lead: str = "", whole: list[str] | tuple[str, ...] = (), lines: bool = False) -> Units:
    """The units of each text; a null text is an empty one and has one empty unit (``lead``).

    A text that holds one of ``whole`` is one unit. ``lines``: line ends behind other characters begin a unit, too.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, ODD + r"|^\n" if lines else ODD)
    uncut = [pc.match_substring(texts, w) for w in whole]
    for found in uncut:
        odd = pc.or_(odd, found)
    even = pc.if_else(odd, "", texts)
    lists = pc.split_pattern(_lines_parted(even) if lines else even, " ")
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = words.dictionary
    spaced = pc.binary_join_element_wise(" ", known, "")
    if lines:  # a word begins with a line end only where it was parted
        spaced = pc.if_else(pc.starts_with(known, "\n"), known, spaced)
    begin = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    first = begin[:-1]
    if lead != " " and len(first):
        heads, at = _numbered(codes[first], len(known))
        later = np.ones(len(codes), bool)
        later[first] = False
        tails, codes[later] = _numbered(codes[later], len(known))
        codes[first] = len(tails) + at
        units = _strings(spaced.take(pa.array(tails))) + [lead + w for w in _strings(known.take(pa.array(heads)))]
    else:
        units = _strings(spaced)
    if pc.any(odd).as_py():
        number: dict[str, int] = {u: k for k, u in enumerate(units)}
        parts, sizes, at = [], np.diff(begin), 0
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = texts[k].as_py()
            own = [lead + text] if any(found[k].as_py() for found in uncut) else runs(text, lead)
            own = [number.setdefault(u, len(number)) for u in own]
            parts += [codes[at : begin[k]], np.array(own, np.int64)]
            at, sizes[k] = begin[k] + 1, len(own)
        codes = np.concatenate([*parts, codes[at:]])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        units = list(number)
    return Units(units, codes, begin)


def level_characters() -> np.ndarray:
    """By byte, the character that stands for it in a byte-level vocabulary: itself where it is printable, the others, in
    order, have those from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    characters = np.zeros(256, "<u2")
    characters[shown] = shown
    rest = np.flatnonzero(characters == 0)
    characters[rest] = 256 + np.arange(len(rest))
    return characters


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


def _numbered(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of codes below ``n``, ascending, and the number of each code among them."""
    met = np.bincount(codes, minlength=n) > 0
    return np.flatnonzero(met), (np.cumsum(met) - 1)[codes]


def expand(flat: np.ndarray, begin: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``flat[begin[c]:begin[c + 1]]`` of all codes one after the other, and where each begins."""
    sizes = np.diff(begin)[codes]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(begin[codes] - ends[:-1], sizes)
    at += np.arange(len(at))
    return flat[at], ends


def flattened(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids one after the other, and where each part begins."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.concatenate(([0], np.cumsum(sizes)))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2^32, byte by byte of all numbers (high ones are mostly zero), compressed."""
    parts = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    parts += [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    out, at = [], 4 * (n + 1)
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return out


def gathered(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches together, as long as the strings of a column take no more than ``chars`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        more = batch.column(column).nbytes
        if held and size + more > chars:
            yield _joined(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Recent:
    """Ids by text, for the texts met last: as many as ``keep`` to twice that."""

    def __init__(self, keep: int, longest: int = 64):
        self.keep, self.longest = keep, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, text: str) -> bytes | None:
        ids = self.new.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is not None:
                self.note(text, ids)
        return ids

    def note(self, text: str, ids: bytes) -> None:
        if len(text) <= self.longest:
            if len(self.new) >= self.keep:
                self.old, self.new = self.new, {}
            self.new[text] = ids

    def all(self, texts: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of all texts; ``make`` gives those of texts not met of late."""
        found = list(map(self.new.get, texts))
        if None in found:
            lacking, note = [], self.note
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = ids = self.old.get(texts[k])
                    if ids is None:
                        lacking.append(k)
                    else:
                        note(texts[k], ids)
            asked = [texts[k] for k in lacking]
            for k, text, ids in zip(lacking, asked, make(asked)):
                found[k] = ids
                note(text, ids)
        return found


class Library:
    """The tokenizers library on units. ``plain``: the strings of added tokens are text like any other."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if plain:
            self.library.encode_special_tokens = True
        self.added = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Whether texts are parted by GPT-2's pattern, so that lines and final marks have tokens of their own.
        self.parts = self._gpt2()
        self.bare = None  # the library without its pattern, for units that are one match of it
        if self.parts and self._merges_apart():
            self.bare, self.characters = Tokenizer(self.library.model), level_characters()
        self.word = re.compile(f"[ \\n][{LETTERS}]+").fullmatch
        #: A space or line end, and a word that has other characters than white space at both ends.
        self.led = re.compile(r"(?s) \S(?:[^ ]*\S)?" + (r"|(\n)\S(?:[^ \n]*\S)?" if self.parts else "")).fullmatch
        self.spaced, self.lined = self._begin(SPACE), self._begin(LINE)

    def _gpt2(self) -> bool:
        if self.library.normalizer is not None or self.library.pre_tokenizer is None:
            return False
        rule = json.loads(self.library.pre_tokenizer.__getstate__())
        return rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule["add_prefix_space"]

    def _merges_apart(self) -> bool:
        """Whether no token of letters goes on over a space or line end, or from a line end to a letter.

        Merges make tokens only: words of letters that stand one after the other are then encoded as each of them alone.
        """
        model = self.library.model
        if type(model).__name__ != "BPE" or model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            return False
        of_words = "".join(map(re.escape, map(chr, level_characters()[[*b"\n ", *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xD5)]].tolist())))
        joined = re.compile(f"(?=[{of_words}]*$).*(?:[^{SPACE}{LINE}][{SPACE}{LINE}]|{LINE}[^{SPACE}{LINE}])").match
        return not any(map(joined, self.vocabulary))

    def _begin(self, character: str) -> np.ndarray:
        """By id, whether the token begins with a character."""
        begin = np.zeros(max(self.vocabulary.values()) + 1, bool)
        begin[[i for token, i in self.vocabulary.items() if token.startswith(character)]] = True
        return begin

    def barred(self, units: list[str]) -> list[bool]:
        """Which units hold an added token."""
        joined = "".join(units)
        met = [a for a in self.added if a in joined]
        return [any(a in u for a in met) for u in units] if met else [False] * len(units)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _line(self, units: list[str], begins: np.ndarray, size: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of units that are a space (or line end) and a solid word: of each the first token alone begins so."""
        for start in range(0, len(units), size):
            some = units[start : start + size]
            ids = np.frombuffer(self.whole(["".join(some)])[0], "<u4")
            cuts = np.flatnonzero(begins[ids])
            if len(cuts) != len(some):
                raise ValueError("the tokenizer joins words over a space")
            yield ids, np.diff(cuts, append=len(ids))

    def _words(self, units: list[str], many: int = 100) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of units that are a space or line end and letters, as ``_line``; shorter lines merge faster."""
        for start in range(0, len(units), many * many):
            some = units[start : start + many * many]
            data = [np.frombuffer("".join(some[k : k + many]).encode(), np.uint8) for k in range(0, len(some), many)]
            found = self.bare.encode_batch_fast([self.characters[x].tobytes().decode("utf-16-le") for x in data], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            cuts = np.flatnonzero(self.spaced[ids] | self.lined[ids])
            if len(cuts) != len(some):
                raise ValueError("the tokenizer joins words over a space")
            yield ids, np.diff(cuts, append=len(ids))

    def encoded(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """All units by place, in the order of encoding; their ids in that order, and how many each has."""
        words, spaced, lined, rest = [], [], [], []
        for k, (unit, barred) in enumerate(zip(units, self.barred(units))):
            if barred:
                rest.append(k)
            elif self.bare and self.word(unit):
                words.append(k)
            elif m := self.led(unit):
                (lined if m.lastindex else spaced).append(k)
            else:
                rest.append(k)
        ids, ends = flattened(self.whole([units[k] for k in rest]))
        parts = [*self._words([units[k] for k in words]), *self._line([units[k] for k in spaced], self.spaced), *self._line([units[k] for k in lined], self.lined), (ids, np.diff(ends))]
        return words + spaced + lined + rest, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian unsigned 32-bit integers."""
        order, ids, sizes = self.encoded(units)
        packed, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [b""] * len(units)
        for k, i, j in zip(order, [0, *ends], ends):
            out[k] = packed[i:j]
        return out


class Numbered:
    """Ids of units by number, for the units met last: ``keep`` stay whenever there are half as many more."""

    def __init__(self, keep: int, encode: Callable[[list[str]], tuple[list[int], np.ndarray, np.ndarray]], longest: int = 64):
        self.keep, self.encode, self.longest = keep, encode, longest
        self.number: dict[str, int] = {}
        #: The ids of all numbers, where each one's begin, and the batch that met it last.
        self.ids, self.begin, self.met, self.now = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def find(self, units: list[str]) -> np.ndarray:
        """The number of each unit, -1 where it has none."""
        found = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        self.met[found[found >= 0]] = self.now
        return found

    def add(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers for units that have none; long ones are not found again."""
        first = len(self.met)
        self.ids = np.concatenate((self.ids, ids))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        self.met = np.concatenate((self.met, np.full(len(units), self.now, np.int32)))
        self.number.update((u, k) for k, u in enumerate(units, first) if len(u) <= self.longest)
        return np.arange(first, first + len(units))

    def made(self, units: list[str]) -> np.ndarray:
        """Numbers for units that have none, which are encoded."""
        order, ids, sizes = self.encode(units)
        found = np.zeros(len(units), np.int64)
        found[order] = self.add([units[k] for k in order], ids, sizes)
        return found

    def all(self, units: list[str]) -> np.ndarray:
        """The numbers of distinct units; those not met of late are encoded."""
        found = self.find(units)
        lacking = np.flatnonzero(found < 0)
        found[lacking] = self.made([units[k] for k in lacking.tolist()])
        return found

    def end_batch(self) -> None:
        """Numbers given so far hold no longer."""
        self.now += 1
        many, wide = len(self.met) > self.keep + self.keep // 2, len(self.ids) > 20 * self.keep
        if not (many or wide):
            return
        old = np.fromiter(self.number.values(), np.int64, len(self.number))
        stay = np.ones(len(old), bool)
        if (gone := max(len(old) - self.keep, len(old) // 2 if wide else 0)) > 0:
            stay[np.argpartition(self.met[old], gone - 1)[:gone]] = False
        self.number = dict(zip(compress(self.number, stay.tolist()), range(len(old))))
        old = old[stay]
        self.ids, self.begin = expand(self.ids, self.begin, old)
        self.met = self.met[old]
