"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of 8 words (all its words if fewer). Containment of a window must be
complete, so of its shingles, ordered by rarity in the corpus, the rarest alone is its necessary
prefix: a document without that shingle cannot hold the window. One pass over the documents counts
the shingles of all windows, which gives the order. A second finds the prefixes; the join with the
windows by prefix applies the length and positional bounds and compares window-sized slices with
the windows themselves.

Windows are a table, cut in parallel. A count decides how they meet the documents: up to
``most_windows`` of them are sent to the tasks as an index (a broadcast join, verified where the
text is); of more, the documents' prefixes are shuffled to the windows with the words around them.
Documents are read twice either way, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_scan import words

WINDOW = 8
SHINGLE = 2
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def windows_of(own: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not own:
        return []
    return [tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))]


def shingles_of(window: tuple[bytes, ...], size: int = SHINGLE) -> list[tuple[bytes, ...]]:
    return [window[k : k + size] for k in range(max(1, len(window) - size + 1))]


class Index:
    """A block of windows, by the rarest shingle of each."""

    def __init__(self, windows: dict[tuple[bytes, ...], list], counts: dict[tuple[bytes, ...], int]):
        self.items = windows
        self.prefix: dict[tuple[bytes, ...], set[tuple[int, int]]] = {}
        for w in windows:
            parts = shingles_of(w)
            k = min(range(len(parts)), key=lambda i: (counts.get(parts[i], 0), parts[i], i))
            if counts.get(parts[k], 0):  # else no document holds it
                self.prefix.setdefault(parts[k], set()).add((k, len(w)))
        self.sizes = sorted({len(x) for x in self.prefix})

    def find(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged intervals of hit words, and the ids of the items."""
        hits: list[tuple[int, int]] = []
        items: set = set()
        for size in self.sizes:
            grams = zip(*(own[k:] for k in range(size)), strict=False)
            prefix = self.prefix
            for at in [k for k, x in enumerate(grams) if x in prefix]:
                for offset, n in prefix[tuple(own[at : at + size])]:
                    begin = at - offset
                    if begin < 0 or begin + n > len(own):  # positional and length bounds
                        continue
                    if (ids := self.items.get(tuple(own[begin : begin + n]))) is not None:
                        hits.append((begin, begin + n))
                        items.update(ids)
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: A window of an item: its words joined by spaces, their number, the item, and the hashes of its shingles.
WINDOWS = "key binary, size int, item_id long, shingles array<long>"
#: Words of a map of hashes, 64 bits each; it says which hashes may be wanted, and is of a fixed size.
MAP_WORDS = 1 << 18
#: Words that stand around a prefix: what any window with it can reach.
AROUND = WINDOW - 1


def _hashes(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the single words and of the pairs of neighbours."""
    from xxhash import xxh64_intdigest

    one = np.array(list(map(xxh64_intdigest, own)), np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two ^= two >> np.uint64(29)
    return one, two * np.uint64(0xBF58476D1CE4E5B9)


def window_table(benchmark: DataFrame) -> DataFrame:
    """WINDOWS of all items, each once per item."""

    def make():
        def f(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for item_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                found = list(dict.fromkeys(windows_of(words(text))))
                if found:
                    shingles = [_hashes(list(w))[len(w) > 1].view(np.int64) for w in found]
                    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w) for w in found], pa.binary()), pa.array([len(w) for w in found], pa.int32()), pa.array([item_id] * len(found), pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], names=["key", "size", "item_id", "shingles"])

        return f

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_or_empty(benchmark).cast("binary").alias("text"))
    return common.map_arrow(rows, make, WINDOWS, text=1)


def _block_counts(docs: DataFrame, block: dict[tuple[bytes, ...], list]) -> dict[tuple[bytes, ...], int]:
    """How often each shingle of the windows stands in all documents; at most 7 a window come back."""
    wanted = docs.sparkSession.sparkContext.broadcast({s for w in block for s in shingles_of(w)})  # bounded by the count of windows

    def make():
        want = wanted.value
        sizes = sorted({len(x) for x in want})

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for text in rows.column(1).to_pylist():
                own = words(text)
                for size in sizes:
                    seen.update(x for x in zip(*(own[k:] for k in range(size)), strict=False) if x in want)
            return pa.RecordBatch.from_arrays([pa.array([b" ".join(x) for x in seen], pa.binary()), pa.array(seen.values(), pa.int64())], names=["shingle", "n"])

        return f

    rows = common.map_arrow(docs, make, "shingle binary, n long", text=1).groupBy("shingle").agg(F.sum("n").alias("n"))
    out = {tuple(bytes(s).split(b" ")): n for s, n in rows.collect()}
    wanted.unpersist()
    return out


def mark(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, most_windows: int = 100_000) -> DataFrame:
    """Per document: words, words inside benchmark windows, items found, and the verdict.

    Null texts and texts without words have no windows: 0 hits, the checksum of no bytes, not
    contaminated. Items without words (or with null text) are found nowhere; repeated items count
    once per item_id, and a null item_id is left out of the ids. Repeated documents give a row each,
    an empty table none, an empty benchmark no hits. Only doc_id, text and item_id, text are read.
    """
    return _marked(docs, benchmark, least_items, most_windows).drop("text_hash")


def _marked(docs: DataFrame, benchmark: DataFrame, least_items: int, most_windows: int) -> DataFrame:
    text = common.text_or_empty(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    scratch = common.Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.cut(window_table(benchmark), "windows")
    if windows.count() <= most_windows:
        return _indexed(docs, windows, least_items)
    return _joined(docs, windows, least_items, scratch)


RESULT = f"{SCHEMA}, text_hash long"


def _rows(out: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    fields = [x.split() for x in names.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(columns, fields, strict=True)], names=[x for x, _ in fields])


def _result(doc_id, text_hash, n: int, spans: list[tuple[int, int]], items: set, least_items: int) -> tuple:
    return doc_id, n, sum(b - a for a, b in spans), len(items), digest(items), len(items) >= least_items, text_hash


def _indexed(docs: DataFrame, windows: DataFrame, least_items: int) -> DataFrame:
    block: dict[tuple[bytes, ...], list] = {}
    for key, item_id in windows.select("key", "item_id").collect():  # counted before
        block.setdefault(tuple(bytes(key).split(b" ")), []).append(item_id)
    index = docs.sparkSession.sparkContext.broadcast((block, _block_counts(docs, block)))

    def make():
        known = Index(*index.value)

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                own = words(text)
                spans, items = known.find(own)
                items.discard(None)
                out.append(_result(doc_id, text_hash, len(own), spans, items, least_items))
            return _rows(out, RESULT)

        return f

    return common.map_arrow(docs, make, RESULT, text=1)


def _map_of(hashes: DataFrame) -> np.ndarray:
    """MAP_WORDS words in which each hash (h) has its bit; at most as many rows come back."""
    h = F.col("h")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(h, {MAP_WORDS.bit_length() - 1}) & 63 as int))")
    found = hashes.groupBy(h.bitwiseAND(MAP_WORDS - 1).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(MAP_WORDS, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _wanted(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    shift = np.uint64(MAP_WORDS.bit_length() - 1)
    return bits[(h & np.uint64(MAP_WORDS - 1)).astype(np.int64)] >> (h >> shift & np.uint64(63)) & np.uint64(1) != 0


def _counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """h, n: how often shingles that may be wanted stand in the documents."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            found = [x[_wanted(held.value, x)] for text in rows.column(1).to_pylist() if (own := words(text)) for x in _hashes(own)]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        return f

    return common.map_arrow(docs, make, "h long, n long", text=1).groupBy("h").agg(F.sum("n").alias("n"))


#: A document (h null), or a place in one where a prefix may stand: the words around, and how many of them before it.
PLACES = "doc_id long, text_hash long, n_words long, h long, at long, before int, around binary"


def _places(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                own = words(text)
                out.append((doc_id, text_hash, len(own), None, None, None, None))
                for h in _hashes(own) if own else ():
                    for at in np.flatnonzero(_wanted(held.value, h)).tolist():
                        begin = max(0, at - AROUND)
                        out.append((doc_id, text_hash, len(own), int(h[at].view(np.int64)), at, at - begin, b" ".join(own[begin : at + WINDOW])))
            return _rows(out, PLACES)

        return f

    return common.map_arrow(docs, make, PLACES, text=1)


def _joined(docs: DataFrame, windows: DataFrame, least_items: int, scratch: common.Scratch) -> DataFrame:
    """The same rows by shuffled joins, for any number of windows."""
    once = windows.groupBy("key").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    shingles = scratch.cut(once.select("key", "size", F.posexplode("shingles").alias("offset", "h")), "shingles")
    counts = scratch.cut(_counts(docs, _map_of(shingles.select("h"))), "counts")
    rarest = shingles.join(counts, "h").groupBy("key", "size").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "h", "offset")).alias("x"))
    # A window with a shingle that no document has is in no document.
    prefix = rarest.filter(F.col("k") == F.greatest(F.col("size") - SHINGLE + 1, F.lit(1))).select("key", "size", F.col("x.h").alias("h"), F.col("x.offset").alias("offset"))
    prefix = scratch.cut(prefix, "prefixes")
    found = scratch.cut(_places(docs, _map_of(prefix.select("h"))), "places")
    begin = F.col("at") - F.col("offset")
    met = found.filter("h is not null").join(prefix, "h").filter((begin >= 0) & (begin + F.col("size") <= F.col("n_words")))  # positional and length bounds

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            c = {x: rows.column(k) for k, x in enumerate(rows.schema.names)}
            good = []
            for around, before, offset, size, key in zip(*(c[x].to_pylist() for x in ("around", "before", "offset", "size", "key")), strict=True):
                good.append(b" ".join(around.split(b" ")[before - offset : before - offset + size]) == key)
            return rows.select(["doc_id", "text_hash", "begin", "size", "key"]).filter(pa.array(good, pa.bool_()))

        return f

    met = met.select("doc_id", "text_hash", begin.alias("begin"), F.col("size").cast("long").alias("size"), "key", "around", "before", "offset")
    hits = scratch.cut(common.map_arrow(met, make, "doc_id long, text_hash long, begin long, size long, key binary").distinct(), "hits")
    own = ["doc_id", "text_hash"]
    spans = hits.groupBy(*own).agg(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))).alias("spans"))
    items = hits.select(*own, "key").distinct().join(windows.filter("item_id is not null").select("key", "item_id").distinct(), "key").groupBy(*own).agg(F.collect_set("item_id").alias("items"))
    whole = found.filter("h is null").groupBy(*own, "n_words").agg(F.count(F.lit(1)).alias("copies"))  # repeated rows give as many rows again
    for more, d, h in ((spans, "_d1", "_h1"), (items, "_d2", "_h2")):
        more = more.withColumnsRenamed({"doc_id": d, "text_hash": h})
        whole = whole.join(more, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("text_hash") == F.col(h)), "left").drop(d, h)

    def make_last():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for x in rows.to_pylist():
                spans = merged([(s["begin"], s["end"]) for s in x["spans"] or ()])
                out += [_result(x["doc_id"], x["text_hash"], x["n_words"], spans, set(x["items"] or ()), least_items)] * x["copies"]
            return _rows(out, RESULT)

        return f

    return common.map_arrow(whole, make_last, RESULT)


def digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def drop(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, most_windows: int = 100_000) -> DataFrame:
    """The documents whose own text does not hold ``least_items`` items, all columns as they were.

    A text decides, so documents without doc_id and repeated ones are judged like all others. Null
    texts stay. Texts are named by a 64-bit hash.
    """
    from .near_dedup import _small

    scratch, bad = common.Scratch(docs.sparkSession, "decontaminate"), common.fresh(docs, "_bad")
    marks = scratch.cut(_marked(docs, benchmark, least_items, most_windows).filter("contaminated").select(F.col("text_hash").alias(bad)).distinct(), "marks")
    return docs.join(_small(marks), F.xxhash64(common.text_or_empty(docs)) == F.col(bad), "left_anti").select(*docs.columns)
