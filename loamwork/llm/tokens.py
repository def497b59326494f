"""Token ids of public tokenizers, with what comes again encoded once.

Both tokenizers used here split a text before they merge, and never inside a run
of letters, nor across the point where a non-space is followed by white space.
So a text's ids are those of its words, each with the one space that may lead it,
and of what other white space there is; and a word of letters with signs after it
has the ids of the letters and of the signs. Words are told apart in numpy by
their keys (all bytes of a word of up to 15, a 120-bit digest of a longer one), and
only new letters or signs reach the tokenizer, many to a call.
The table of words belongs to the worker process; beyond ``MOST_WORDS`` it keeps
the ``KEPT_WORDS`` most used. No text or word is cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .common import kept_in_worker
from .wordhash import Chunk, chunks, joined, mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and threads keep memory of their own

MOST_WORDS = 600_000
KEPT_WORDS = 300_000
GROUP = 100
CHUNK_BYTES = 1 << 20
#: In the high half of a word's key: whether a space leads it.
LED = np.uint64(1 << 62)
#: Stands between runs of letters; its id is that of no letters.
MARK = "!"

#: Letters that both tokenizers keep together, and signs that they keep apart from letters (fixed values).
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_WORD = re.compile(f"( ?[{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)").fullmatch
#: UTF-8 of white space other than ASCII's. A text that has it is encoded whole.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").finditer

_encoders: dict[str, Encoder] = kept_in_worker()


class WordTable:
    """Numbers for words by their keys, by open addressing."""

    def __init__(self) -> None:
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._place(1 << 16)

    def __len__(self) -> int:
        return len(self.low)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(joined(high, low)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _place(self, slots: int) -> None:
        self.slots = np.full(slots, -1, dtype=np.int32)
        self._insert(np.arange(len(self), dtype=np.int32))

    def _insert(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            lost = self.slots[slot] != numbers
            numbers, slot = numbers[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Words that are new and all different."""
        first = len(self)
        self.low, self.high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        if 2 * len(self) > len(self.slots):
            self._place(1 << (3 * len(self) - 1).bit_length())
        else:
            self._insert(np.arange(first, len(self), dtype=np.int32))

    def keep(self, numbers: np.ndarray) -> None:
        self.low, self.high = self.low[numbers], self.high[numbers]
        self._place(len(self.slots))

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is new."""
        slot = self._slot(low, high)
        found = self.slots[slot]
        going = np.flatnonzero(found >= 0)
        while len(going):
            at = found[going]
            going = going[(self.low[at] != low[going]) | (self.high[at] != high[going])]
            slot[going] = (slot[going] + 1) & (len(self.slots) - 1)
            found[going] = self.slots[slot[going]]
            going = going[found[going] >= 0]
        return found


class Pool:
    """Ids of numbered pieces, one after the other. Piece 0 is empty."""

    def __init__(self) -> None:
        self.ids, self.ends, self.numbers = np.zeros(0, np.uint32), np.zeros(2, np.int64), {"": 0}

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.numbers.update(zip(pieces, range(len(self.numbers), len(self.numbers) + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def keep(self, used: np.ndarray) -> np.ndarray:
        """Keep the pieces used, and give each old number its new one."""
        used = np.union1d(used, [0])
        names = list(self.numbers)
        sizes = np.diff(self.ends)[used]
        self.ids = self.ids[ranges(self.ends[used], sizes)]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        moved = np.zeros(len(names), dtype=np.int64)
        moved[used] = np.arange(len(used))
        self.numbers = {names[i]: k for k, i in enumerate(used.tolist())}
        return moved

    def sizes(self, pieces: np.ndarray) -> np.ndarray:
        return self.ends[pieces + 1] - self.ends[pieces]


class Encoder:
    """Ids of whole texts, the same as the tokenizer gives for each."""

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer(self.tokenizer.model)  # merges alone, for runs of letters
        self.spaced = self.tokenizer.normalizer is None  # else white space and case are dropped
        (self.mark,) = self.bare.encode(MARK, add_special_tokens=False).ids
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {ord(c): as_bytes(c)[0][0] for c in map(chr, [32, *range(0xC0, 0x100)])}
        self.pool, self.words = Pool(), WordTable()
        self.parts = np.zeros((0, 2), dtype=np.int64)  # of each word: letters and signs, as pieces
        self.uses = np.zeros(0, dtype=np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.array([len(x) for x in found])

    def runs_of_letters(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, which need no more than merging."""
        ready = [x if x.isalpha() and x.isascii() else x.translate(self.letters) for x in runs]
        groups = [list(chain.from_iterable(zip(part, repeat(MARK)))) for i in range(0, len(ready), GROUP) for part in [ready[i : i + GROUP]]]
        found = self.bare.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1

    def numbers_of(self, pieces: list[str], letters: bool) -> list[int]:
        known = self.pool.numbers
        new = list(dict.fromkeys(filterfalse(known.__contains__, pieces)))
        if new:
            self.pool.add(new, *(self.runs_of_letters(new) if letters else self.whole(new)))
        return list(map(known.__getitem__, pieces))

    def learn(self, words: list[str]) -> None:
        """Words not met before, in the order of their numbers."""
        found = [m and m.groups() for m in map(_WORD, words)]
        parts = np.zeros((len(words), 2), dtype=np.int64)
        plain = np.fromiter(map(bool, found), dtype=bool, count=len(words))
        if plain.any():
            letters, signs = zip(*filter(None, found))
            parts[plain, 0] = self.numbers_of(letters if self.spaced else list(map(str.lower, letters)), letters=True)
            parts[plain, 1] = self.numbers_of(signs, letters=False)
        parts[~plain, 0] = self.numbers_of([w for w, x in zip(words, found, strict=True) if not x], letters=False)
        self.parts = np.concatenate([self.parts, parts])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])

    def forget(self) -> None:
        """Keep the words most used."""
        keep = np.sort(np.argpartition(-self.uses, KEPT_WORDS)[:KEPT_WORDS])
        self.words.keep(keep)
        self.uses = self.uses[keep] // 2
        moved = self.pool.keep(self.parts[keep])
        self.parts = moved[self.parts[keep]]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each text."""
        if len(self.words) > MOST_WORDS:
            self.forget()
        low, high = chunk.keys()
        led = self._led(chunk) if self.spaced else np.zeros(len(low), dtype=bool)
        high[led] ^= LED
        found = self.words.find(low, high)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            missing = missing[np.lexsort((low[missing], high[missing]))]
            a, b = low[missing], high[missing]
            first = missing[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]
            raw = chunk.data.tobytes()
            places = zip((chunk.starts[first] - led[first]).tolist(), chunk.ends[first].tolist(), strict=True)
            self.learn([raw[a:b].decode() for a, b in places])
            self.words.add(low[first], high[first])
            found[missing] = self.words.find(low[missing], high[missing])
        self.uses += np.bincount(found, minlength=len(self.uses))
        pieces = self.parts[found]
        if self.spaced:
            pieces = np.concatenate([self._spaces(chunk, led), pieces], axis=1)
        sizes = self.pool.sizes(pieces.reshape(-1))
        ids = self.pool.ids[ranges(self.pool.ends[pieces.reshape(-1)], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[chunk.bounds * pieces.shape[1]]
        return self._mended(chunk, ids, np.diff(bounds)) if self.spaced else (ids, np.diff(bounds))

    @staticmethod
    def _gaps(chunk: Chunk) -> np.ndarray:
        """Where the white space before each word begins."""
        before = np.concatenate([[0], chunk.ends[:-1]])
        return np.maximum(before, chunk.offsets[:-1][chunk.text_of_word()])

    def _led(self, chunk: Chunk) -> np.ndarray:
        """Whether the word is led by a space, which then belongs to it."""
        begin = np.maximum(chunk.starts - 1, 0)
        return (chunk.starts > self._gaps(chunk)) & (chunk.data[begin] == 0x20)

    def _spaces(self, chunk: Chunk, led: np.ndarray) -> np.ndarray:
        """Two pieces of white space before each word, mostly empty: all but the last character, and the last unless it belongs to the word."""
        gaps = self._gaps(chunk)
        size = chunk.starts - gaps
        out = np.zeros((len(led), 2), dtype=np.int64)
        raw = chunk.data.tobytes()
        for column, some in ((0, np.flatnonzero(size > 1)), (1, np.flatnonzero((size > 0) & ~led))):
            begin, end = (gaps, chunk.starts - 1) if not column else (chunk.starts - 1, chunk.starts)
            out[some, column] = self.numbers_of([raw[a:b].decode() for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)], letters=False)
        return out

    def _mended(self, chunk: Chunk, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """White space at the end of texts put in, and texts with wide white space encoded whole."""
        last = np.where(chunk.counts > 0, chunk.ends[np.maximum(chunk.bounds[1:], 1) - 1] if len(chunk.ends) else 0, chunk.offsets[:-1])
        ragged = last < chunk.offsets[1:]
        raw = chunk.data.tobytes()
        wide = np.searchsorted(chunk.offsets, [m.start() for m in _WIDE_SPACE(raw)], side="right") - 1
        ragged[wide] = True
        if not ragged.any():
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        rows = np.flatnonzero(ragged).tolist()
        whole, lengths = self.whole([raw[chunk.offsets[i] : chunk.offsets[i + 1]].decode() for i in rows])
        for i, x in zip(rows, np.split(whole, np.cumsum(lengths)[:-1]), strict=True):
            parts[i] = x
        return np.concatenate(parts), np.array([len(x) for x in parts])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encode_documents(name: str, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids of each text with ``end`` after it, and the number of ids of each, for some texts at a time."""
    for chunk in chunks(texts, chunk_bytes=CHUNK_BYTES):
        ids, sizes = encoder(name).encode(chunk)
        out = np.full(len(ids) + len(sizes), end, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(sizes + 1) - 1] = False
        out[keep] = ids
        yield chunk.first, out, sizes + 1
