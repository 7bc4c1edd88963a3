"""Exact BPE ids at several times the library's own speed on natural text.

Byte-level BPE never merges across the words that its pre-tokenizer finds. A text may therefore be
cut where a word surely begins, every distinct piece be encoded once by the ``tokenizers`` library,
and the ids be joined. A batch is cut as one array of code points and its words become an Arrow
dictionary, so Python sees each different word of a batch once. What was encoded is kept in
dictionaries of bounded size for the life of a Python worker. Texts beyond the Latin blocks are cut
at white space only, and tokenizers of another kind get whole texts.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

#: White space as Unicode's property has it, which the library's pattern uses.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: For texts of ASCII and the Latin blocks the library's pattern can be said exactly, by the class of each code point.
_OUTSIDE = re.compile("[^\\x00-ɏ]")
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CLASS = np.array([_SPACE if re.match(f"[{_WHITE}]", x) else _LETTER if re.match("[A-Za-zªµºÀ-ÖØ-öø-ɏ]", x) else _NUMBER if re.match("[0-9²³¹¼½¾]", x) else _OTHER for x in map(chr, range(0x250))], "u1")
#: Longer pieces are encoded each time they come and not kept.
_LONGEST_KEPT = 80


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words begin in texts that stand one after another; begins: where each text that is not empty begins.

    Runs of one class are words. White space before something else gives up its last code point:
    a blank goes to the next word, any other stands alone. An apostrophe that is a run by itself,
    with no blank before it, takes one of seven endings with it.
    """
    n, kind = len(points), _CLASS[points]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    white = kind == _SPACE
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    at = np.flatnonzero((points == 39) & start[:n])
    at = at[(at + 1 < n) & ~first[np.minimum(at + 1, n)]]
    one = points[at + 1]
    short = at[np.isin(one, [ord(x) for x in "stmd"])]
    far = at[at + 2 < n]
    far = far[~first[far + 2]]
    one, two = points[far + 1], points[far + 2]
    long = far[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    for ending, size in ((short, 2), (long, 3)):
        start[ending + 1] = False
        start[ending + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodes batches of texts; the ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str, most_kept: int = 300_000):
        self._library = Tokenizer.from_str(tokenizer_json)
        self._library.no_padding()
        self._library.no_truncation()
        shape = self._library.pre_tokenizer
        self.cuts = (
            isinstance(shape, pre_tokenizers.ByteLevel) and not shape.add_prefix_space and shape.use_regex and self._library.normalizer is None
            and not any(re.search(r"\s", x.content) or x.lstrip or x.rstrip or x.single_word for x in self._library.get_added_tokens_decoder().values())
        )
        line_end = self._library.encode("\n", add_special_tokens=False).ids
        self.cuts = self.cuts and len(line_end) == 1
        if self.cuts:
            self._line_end = line_end[0]
            self._spaced = np.array([(self._library.id_to_token(k) or "")[:1] == "Ġ" for k in range(self._library.get_vocab_size())])
            self._single = Tokenizer.from_str(tokenizer_json)
            self._single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._added = [x.content for x in self._library.get_added_tokens_decoder().values()]
        self._most = most_kept
        self._kept: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], spaced: bool) -> None:
        """words: each a single word to the pre-tokenizer, without special tokens; all with or all without a space before.

        Only a word's first id can begin with a space; words without one are parted by line ends.
        """
        for at in range(0, len(words), 4000):
            some = listed = words[at : at + 4000]
            if not spaced:
                listed = ["\n"] * (2 * len(some))
                listed[::2] = some
            ids = np.asarray(self._single.encode_batch_fast([listed], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(self._spaced[ids])[1:], len(ids)).tolist() if spaced else np.flatnonzero(ids == self._line_end).tolist()
            if len(ends) != len(some):
                self._kept.update(zip(some, self._plain(some), strict=True))
                continue
            raw, begin = ids.tobytes(), 0
            for word, end in zip(some, ends, strict=True):
                self._kept[word] = raw[4 * begin : 4 * end]
                begin = end + (not spaced)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._plain(texts)
        on = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles: the collector would walk them again and again
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self._kept) > self._most:  # what comes again moves on, the rest goes with the next change
            self._old, self._kept = self._kept, {}
        if len(self._chunks) > self._most // 4:
            self._chunks.clear()
        out: list[bytes] = [b""] * len(texts)
        latin, other = [], []
        for k, x in enumerate(texts):
            if any(y in x for y in self._added):  # white space before a special token is cut otherwise
                out[k] = self._plain([x])[0]
            elif x:
                (latin if x.isascii() or not _OUTSIDE.search(x) else other).append(k)
        if latin:
            for k, ids in zip(latin, self._words([texts[k] for k in latin]), strict=True):
                out[k] = ids
        cut = [_CHUNK.findall(texts[k]) for k in other]
        chunks = list(set(chain.from_iterable(cut)).difference(self._chunks))
        self._chunks.update(zip(chunks, self._plain(chunks), strict=True))
        for k, p in zip(other, cut, strict=True):
            out[k] = b"".join(map(self._chunks.__getitem__, p))
        for x in chunks:
            if len(x) > _LONGEST_KEPT:
                del self._chunks[x]
        return out

    def _words(self, texts: list[str]) -> list[bytes]:
        """texts: none empty, all of the Latin blocks."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begins = np.cumsum([0, *map(len, texts)])
        starts = word_starts(points, begins[:-1])
        parts = np.append(np.searchsorted(starts, begins[:-1]), len(starts))
        ends = np.append(starts, len(points))
        if not joined.isascii():
            ends[1:] += np.cumsum(points >= 128, dtype="i4")[ends[1:] - 1]  # such a code point has two bytes
        del points, starts
        raw = joined.encode()
        table = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype("<i8", copy=False)), pa.py_buffer(raw)).dictionary_encode()
        distinct = table.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self._kept.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            by: tuple[list[str], list[str], list[str]] = ([], [], [])
            for k in new:
                x = distinct[k]
                if (ids := self._old.get(x)) is not None:
                    self._kept[x] = ids
                else:
                    by[2 if "\n" in x else x[0] == " " and " " not in x[1:]].append(x)
            self._learn(by[1], True)
            self._learn(by[0], False)
            if by[2]:
                self._kept.update(zip(by[2], self._plain(by[2]), strict=True))
            for k in new:
                x = distinct[k]
                found[k] = self._kept.pop(x) if len(x) > _LONGEST_KEPT else self._kept[x]
        every = pa.array(found, pa.large_binary()).take(table.indices)
        ids, offsets = every.buffers()[2].to_pybytes(), np.frombuffer(every.buffers()[1], "<i8", len(every) + 1)[parts].tolist()
        return [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


_made: dict[tuple[int, int], Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder for this tokenizer."""
    key = (len(tokenizer_json), hash(tokenizer_json))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(tokenizer_json)
    return _made[key]
