"""Packing: order-preserving dynamic programming over window cuts.

Documents follow each other by doc_id, each with an end id. A window of at most 1024 ids ends at the
end of a document, of a sentence, or, within long sentences, at every ``step``-th id. The cuts
minimise padding plus penalties (document 0, sentence ``SENTENCE``, elsewhere ``INSIDE``). With
f(i) the least cost up to boundary i, f(j) = 1024 - p(j) + penalty(j) + min(f(i) + p(i)) over the
boundaries of the last 1024 ids: a monotone queue gives each minimum in constant time. Windows
whose length is a power of two need no padding; the larger of these lengths are tried as well.

The range partitions are packed independently, each in segments of about ``SEGMENT`` ids that end
with a document: a segment pads at most one more window, 1 in 4096, and bounds a task's memory.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, token_files

LENGTH = 1024
SENTENCE, INSIDE = 4, 16
STEP = 64
SEGMENT = 4 << 20
#: Lengths of windows that need no padding, besides LENGTH.
UNPADDED = (256, 512)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=1)
def sentence_ends(tokens: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: may it end a sentence; does it begin with white space."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokens)
    names = [library.id_to_token(k) or "" for k in range(library.get_vocab_size())]
    return np.array([bool("Ċ" in x or "\n" in x or re.search(r"[.!?][\"')\]]*\Z", x)) for x in names]), np.array([x[:1] in "ĠĊ▁ \n" and x != "" for x in names])


def boundaries(docs: list[bytes], ends: np.ndarray, spaced: np.ndarray, step: int = STEP) -> tuple[list[int], list[int]]:
    """Places where a window may end, ascending from 0, and the penalty of each."""
    places, costs, base = [np.zeros(1, "i8")], [np.zeros(1, "i8")], 0
    for raw in docs:
        ids = np.frombuffer(raw, "<u4")
        n = len(ids)
        at = np.flatnonzero(ends[ids[: n - 2]] & spaced[ids[1 : n - 1]]) + 1 if n > 2 else np.zeros(0, "i8")
        own = np.append(at, n)
        cost = np.full(len(own), SENTENCE)
        cost[-1] = 0
        gaps = np.diff(own, prepend=0)
        if (long := np.flatnonzero(gaps > step)).size:
            more = np.concatenate([np.arange(own[k] - gaps[k] + step, own[k], step) for k in long])
            own, cost = np.concatenate([own, more]), np.concatenate([cost, np.full(len(more), INSIDE)])
            order = np.argsort(own, kind="stable")
            own, cost = own[order], cost[order]
        places.append(own + base)
        costs.append(cost)
        base += n
    return np.concatenate(places).tolist(), np.concatenate(costs).tolist()


def cuts(places: list[int], costs: list[int], length: int = LENGTH, unpadded: tuple[int, ...] = UNPADDED) -> list[int]:
    """Ends of the windows with least padding plus penalties; the first place is 0, neighbours are at most ``length`` apart."""
    n = len(places)
    best, back = [0] * n, [0] * n
    at = {p: k for k, p in enumerate(places)}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, boundary), costs ascending
    for j in range(1, n):
        p = places[j]
        while places[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        low = length - p + value
        for size in unpadded:
            k = at.get(p - size)
            if k is not None and best[k] < low:
                low, i = best[k], k
        low += costs[j]
        best[j], back[j] = low, i
        value = low + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], n - 1
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


def pieces(docs: list[tuple[int | None, bytes]], ends: list[int], first_sequence: int) -> Iterator[tuple]:
    """Rows of SCHEMA for a segment's documents and the ends of its windows."""
    k, begin, base = 0, 0, 0
    for doc_id, raw in docs:
        n, at = len(raw) // 4, 0
        while at < n:
            stop = min(n, ends[k] - base)
            yield doc_id, at, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), n, first_sequence + k, base + at - begin
            at = stop
            if base + at == ends[k]:
                begin, k = ends[k], k + 1
        base += n


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a sequence.

    Null and empty texts are documents of the end id alone. Equal doc_ids (and null ones, which come
    first) are ordered by a hash of their text; repeated rows are packed each. An empty table gives
    no rows. Only doc_id and text are read; other columns may have any name. Sequence ids are unique
    and ascend with the documents: the number of the range partition, times 2^32, plus a count.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(common.tokenizer_json(tokenizer_path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        enc, sequence = encoder(held.value), TaskContext.get().partitionId() << 32
        flags, end = sentence_ends(held.value), np.array([end_id], "<u4").tobytes()
        own: list[tuple[int | None, bytes]] = []
        size = 0

        def solved() -> pa.RecordBatch:
            nonlocal sequence
            at = cuts(*boundaries([x for _, x in own], *flags))
            rows = list(pieces(own, at, sequence))
            sequence += len(at)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for rows in it:
            for some in common.batches(rows, 1):
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    own.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT:
                        yield solved()
                        own, size = [], 0
        if own:
            yield solved()

    return token_files.ordered(docs).mapInArrow(run, SCHEMA)
