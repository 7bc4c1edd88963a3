"""MinHash near-duplicates by an LSH forest.

* Every document becomes the set of its distinct shingles. Documents with equal sets form a class,
  which one representative (least doc_id) stands for from there on.
* Each class gets TREES sequences of DEPTH MinHash values. Tree by tree the classes are sorted by
  their sequence, so neighbours have the longest common prefixes. How long a prefix must be adapts to
  the region: a class is paired with all that share the shortest prefix, of MIN_DEPTH values or more,
  that no more than RUN classes share. Where RUN classes share all DEPTH values, and everywhere else
  too, it is paired with the class next to it.
* Pairs whose sizes cannot reach the threshold go, and so do those whose 256 signature bits estimate
  a similarity far below it: six standard errors, or three within dense regions. What is left is
  confirmed on the full sets, and links are contracted to components.
* Dense regions: classes that in any tree more than RUN classes share MIN_DEPTH values with. They are
  joined exactly by their rarest shingles (a prefix-filtered set join, see ``all_candidates``) between
  different components, with no bound on partners. Every filter there is lossless.

So of two classes at similarity 0.8 either one is sparse, and both meet unless they share MIN_DEPTH
values in none of 32 trees (a chance below 1e-7), or both are dense and meet in the exact join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

TREES, DEPTH, MIN_DEPTH, RUN = 32, 8, 4, 8
VALUES = TREES * DEPTH
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Standard errors below the threshold at which an estimate rules a pair out, in sparse and dense regions.
SURE, LIKELY = 6, 3
#: Shingles are ordered by how often their bucket occurs; any order is right, rare ones first is fast.
BUCKET_BITS = 18
#: Rows of one shingle that are compared in one place; more are dealt in blocks, four times as large beyond MANY.
BLOCK, MANY = 512, 16
#: Bits of the map of a set's shingles.
MAP_BITS = 2048
#: Bytes of ids that may be broadcast; a larger side is joined by shuffling.
BROADCAST_BYTES = 32 << 20
SETS = "doc_id long, n_shingles long, class_key binary, signature binary, text_hash long"
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, or of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    h = np.array(list(map(xxh64_intdigest, words)), np.uint64)
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out ^= h[k : len(h) - size + 1 + k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _A + _B).min(axis=0), out=least)
    least ^= least >> np.uint64(31)
    return (least * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(">u2")


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    n = len(a) + len(b)
    both = n - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (n - both) and both > 0


def sets(docs: DataFrame, size: int) -> DataFrame:
    """SETS of docs (doc_id, text, text_hash)."""

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            counts, keys, values = [], [], []
            for text in rows.column(1).to_pylist():
                s = shingle_hashes(text, size)
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values.append(signature(s).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary()), rows.column(2)], names=[x.split()[0] for x in SETS.split(", ")])

        return f

    return common.map_arrow(docs, make, SETS, text=1)


def _bits(column: pa.Array, size: int) -> np.ndarray:
    """A column of binary values of one size as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a column of binary values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


ORDER = ["tree", "path", "rep"]


def _forest(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: tree, path, rep, n, and the signature's 256 lowest bits."""

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            n = rows.num_rows
            values = _bits(rows.column(2), 2 * VALUES)
            sketch = np.packbits(values.reshape(n, VALUES, 2)[:, :, 1] & 1, axis=1)
            again = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), TREES))
            return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype="i4"), n)), _binary(values.reshape(n * TREES, 2 * DEPTH)), *map(again, rows.columns[:2]), _binary(np.repeat(sketch, TREES, axis=0))], names=["tree", "path", "rep", "n", "sketch"])

        return f

    return common.map_arrow(classes.select("rep", "n", "signature"), make, "tree int, path binary, rep long, n long, sketch binary", text=2)


#: kind 0: a candidate (a, b). kind 1: a row (a) at an edge of partition ``part`` of ``rows`` rows, at its
#: end if ``tail``. kind 2: a class (a) of a dense region.
FOUND = "kind int, a long, b long, tree int, path binary, n long, sketch binary, part int, rows long, tail boolean"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _found(kind: int, a: np.ndarray, **more) -> pa.RecordBatch:
    given = {"kind": np.full(len(a), kind, "i4"), "a": a, **more}
    fields = [x.split() for x in FOUND.split(", ")]
    column = lambda name, t: x if isinstance(x := given.get(name), pa.Array) else pa.nulls(len(a), t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([column(name, _KINDS[t]) for name, t in fields], names=[x for x, _ in fields])


def _bits_apart(percent: int, errors: float) -> int:
    """Of 256 bits, the most that may differ: similarity is about 2 * (share of equal bits) - 1."""
    equal = (1 + percent / 100) / 2
    return int(VALUES * (1 - equal) + errors * (VALUES * equal * (1 - equal)) ** 0.5)


def _pairs_of(rows: list[np.ndarray], begin: int, end: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidates whose first row is one of begin to end - 1, and the classes of dense regions among these.

    rows: tree, path, rep, n, sketch, sorted; with RUN + 1 rows of context on each side, if there are as many.
    """
    tree, path, rep, n, sketch = rows
    total = len(rep)
    values = np.ascontiguousarray(path).view(">u2")
    common_prefix = np.cumprod((values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
    high = np.arange(total)
    sparse = np.zeros(total, bool)
    for depth in range(DEPTH, MIN_DEPTH - 1, -1):
        cuts = np.r_[0, np.flatnonzero(common_prefix < depth) + 1, total]
        size = np.diff(cuts)
        sparse = np.repeat(size <= RUN, size)
        high = np.where(sparse, np.repeat(cuts[1:], size), high)
    own = np.arange(begin, end)
    if len(dense := own[~sparse[own]]):
        yield _found(2, np.unique(rep[dense]))
    bits = np.ascontiguousarray(sketch).view(np.uint64)
    most = np.where(sparse, _bits_apart(percent, SURE), _bits_apart(percent, LIKELY))
    for step in range(1, RUN + 1):
        a = own[own + step < total]
        a = a[(a + step < high[a]) | ((step == 1) & (common_prefix[a] >= MIN_DEPTH))]
        b = a + step
        ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= most[a]
        a, b = a[ok], b[ok]
        if len(a):
            yield _found(0, np.minimum(rep[a], rep[b]), b=np.maximum(rep[a], rep[b]))


def _columns(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [rows.column(0).to_numpy(), _bits(rows.column(1), 2 * DEPTH), rows.column(2).to_numpy(), rows.column(3).to_numpy(), _bits(rows.column(4), VALUES // 8)]


def _along(percent: int):
    """Candidates within a sorted partition, in a window that moves over it, and its edges."""
    side = RUN + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, first, total = None, 0, None, 0
        for rows in it:
            if not rows.num_rows:
                continue
            total += rows.num_rows
            now = _columns(rows)
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            if first is None or len(first[0]) < side:
                first = [x[:side].copy() for x in now]
            end = max(done, len(now[0]) - side)  # those after it may have more in common with the next batch
            yield from _pairs_of(now, done, end, percent)
            keep = max(0, end - side)
            held, done = [x[keep:].copy() for x in now], end - keep
        if held is None:
            return
        yield from _pairs_of(held, done, len(held[0]), percent)
        part = TaskContext.get().partitionId()
        for tail, edge in ((False, first), (True, [x[-side:] for x in held])):
            if tail and total < side:  # a partition so small has been told whole
                continue
            k = len(edge[0])
            yield _found(1, edge[2], tree=edge[0], path=_binary(edge[1]), n=edge[3], sketch=_binary(edge[4]), part=np.full(k, part, "i4"), rows=np.full(k, total), tail=np.full(k, tail))

    return run


def _across(percent: int):
    """Candidates among the rows around an edge; ``edge`` is the last column, rows are sorted within it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in it:
            if not rows.num_rows:
                continue
            now = [*_columns(rows), rows.column(5).to_numpy()]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            cuts = np.r_[0, np.flatnonzero(np.diff(now[5])) + 1, len(now[5])]
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield from _pairs_of([x[a:b] for x in now[:5]], 0, b - a, percent)
            held = [x[cuts[-2] :].copy() for x in now]
        if held is not None:
            yield from _pairs_of(held[:5], 0, len(held[0]), percent)

    return run


def candidates(classes: DataFrame, scratch: common.Scratch, percent: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of representatives, a < b, each once; and the classes (rep) of dense regions.

    ``classes`` has rep, n and signature. Range partitions cut runs; RUN + 1 rows of either side of
    each cut meet once more, a cut at a time.
    """
    dealt = _forest(classes).repartitionByRange(common.parts_for(classes), *ORDER).sortWithinPartitions(*ORDER)
    found = scratch.cut(dealt.mapInArrow(_along(percent), FOUND), "found")
    edges = found.filter("kind = 1")
    # A cut is named by the partition before it; partitions too small to be one side of it belong to the cut before.
    whole = edges.groupBy("part").agg(F.first("rows").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    cut = whole.select("part", F.coalesce(F.last(F.when(F.col("rows") > RUN, F.col("part")), ignorenulls=True).over(before), F.lit(-1)).alias("head_edge"))
    edges = edges.join(F.broadcast(cut), "part").select("tree", "path", F.col("a").alias("rep"), "n", "sketch", F.when(F.col("tail"), F.col("part")).otherwise(F.col("head_edge")).alias("edge"))
    met = edges.repartition(common.parts_for(edges), "edge").sortWithinPartitions("edge", *ORDER).mapInArrow(_across(percent), FOUND)
    met = scratch.cut(met.select("kind", "a", "b"), "across")
    every = found.select("kind", "a", "b").unionByName(met)
    pairs = scratch.cut(every.filter("kind = 0").select("a", "b").distinct(), "pairs")
    dense = scratch.cut(every.filter("kind = 2").select(F.col("a").alias("rep")).distinct(), "dense")
    scratch.drop("found", "across")
    return pairs, dense


def _histogram(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur, by the first BUCKET_BITS bits of their hash; of a fixed size."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for rows in it:
            for text in rows.column(0).to_pylist():
                np.add.at(total, (shingle_hashes(text, size) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def bit_map(shingles: np.ndarray) -> bytes:
    """MAP_BITS bits, those of the shingles' lowest hash bits set. Two maps differ in no more places than their sets."""
    out = np.zeros(MAP_BITS, np.uint8)
    out[(shingles & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _prefixes(texts: DataFrame, often: np.ndarray, size: int, percent: int) -> DataFrame:
    """For each text its set's size and map, and its rarest shingles: sets that reach the threshold share one of each other's."""
    held = texts.sparkSession.sparkContext.broadcast(often)

    def make():
        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            counts, maps, tokens = [], [], []
            for text in rows.column(1).to_pylist():
                s = shingle_hashes(text, size)
                p = len(s) + (-percent * len(s)) // 100 + 1
                counts.append(len(s))
                maps.append(bit_map(s))
                tokens.append(s[np.lexsort((s, held.value[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))][:p].view(np.int64))
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(maps, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], names=["rep", "n", "map", "tokens"])

        return f

    return common.map_arrow(texts.select("doc_id", "text"), make, "rep long, n long, map binary, tokens array<long>", text=1)


def _dealt():
    """A row once for each block of its shingle's rows: i and j are its own block and the other, in order."""

    def f(rows: pa.RecordBatch) -> pa.RecordBatch:
        at = {x: k for k, x in enumerate(rows.schema.names)}
        blocks, own = (rows.column(at[x]).to_numpy() for x in ("blocks", "own"))
        again = np.repeat(np.arange(rows.num_rows), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        i, j = (g(own[again], other).astype("i4") for g in (np.minimum, np.maximum))
        rest = [rows.column(at[x]).take(pa.array(again)) for x in ("own", "rep", "part", "n", "pos", "map")]
        return pa.RecordBatch.from_arrays([rows.column(at["token"]).take(pa.array(again)), pa.array(i), pa.array(j), *rest], names=["token", "i", "j", "own", "rep", "part", "n", "pos", "map"])

    return f


def _met(percent: int):
    """Compares all rows of a key (token, i, j), sorted by n; i and j are blocks, of which pairs lie across."""

    def close(token, i, j, own, rep, part, n, pos, maps) -> Iterator[pa.RecordBatch]:
        bits = np.ascontiguousarray(maps).view(np.uint64)
        at, got, k = np.arange(len(token)), [], 0
        for s in range(1, len(token)):
            at = at[at < len(token) - s]
            to = at + s
            # Sorted by n: who is too small for one row is too small for those beyond it.
            at = at[(token[at] == token[to]) & (i[at] == i[to]) & (j[at] == j[to]) & (100 * n[at] >= percent * n[to])]
            if not len(at):
                break
            x, y = at, at + s
            ok = (part[x] != part[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
            ok &= (100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y])
            x, y = x[ok], y[ok]
            ok = (100 + percent) * np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[x] + n[y])
            got.append((np.minimum(rep[x], rep[y])[ok], np.maximum(rep[x], rep[y])[ok]))
            k += len(got[-1][0])
            if k >= 1 << 18:
                yield once(got)
                got, k = [], 0
        if k:
            yield once(got)

    def once(got) -> pa.RecordBatch:
        a, b = np.unique(np.stack([np.concatenate(x) for x in zip(*got, strict=True)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in it:
            if not rows.num_rows:
                continue
            now = [rows.column(c).to_numpy() for c in range(8)] + [_bits(rows.column(8), MAP_BITS // 8)]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
            end = other[-1] + 1 if len(other) else 0  # the last key may go on in the next batch
            if end:
                yield from close(*(x[:end] for x in now))
            held = [x[end:].copy() for x in now]
        if held is not None:
            yield from close(*held)

    return run


def all_candidates(region: DataFrame, docs: DataFrame, scratch: common.Scratch, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts over ``region`` (rep, part): all that can reach the threshold.

    A prefix-filtered set join: no bound on neighbours. Only shingles that classes of different parts
    have in their prefixes count. A frequent one's rows are dealt in blocks, each pair of blocks in a
    place of its own; there sizes, places in the prefixes and bit maps rule pairs out, all without loss.
    """
    own = region.select(F.col("rep").alias("doc_id"))
    texts = scratch.cut(docs.join(_small(own), "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text"), "rest-texts")
    held = scratch.cut(_prefixes(texts, _histogram(texts, size), size, percent).join(region, "rep"), "rest-prefixes")
    rows = held.select("rep", "part", F.posexplode("tokens").alias("pos", "token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("part").alias("p"), F.max("part").alias("q"))
    shared = scratch.cut(counts.filter("p < q").select("token", "c"), "rest-shared")
    rows = held.select("rep", "part", "n", "map", F.posexplode("tokens").alias("pos", "token")).join(shared, "token").select("token", "c", "rep", "part", "n", F.col("pos").cast("long").alias("pos"), "map")
    if shared.filter(F.col("c") > MANY * BLOCK).limit(1).count():
        rows = _merged(rows, shared, scratch)
    blocks = F.least(F.ceil(F.col("c") / BLOCK), F.greatest(F.lit(MANY), F.ceil(F.col("c") / (4 * BLOCK)))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = common.map_arrow(rows, _dealt, "token long, i int, j int, own int, rep long, part long, n long, pos long, map binary")
    dealt = dealt.repartition(common.parts_for(dealt), "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "rep")
    pairs = scratch.cut(dealt.mapInArrow(_met(percent), "a long, b long").distinct(), "rest-pairs")
    scratch.drop("rest-texts", "rest-prefixes", "rest-shared", "rest-once")
    return pairs


def _merged(rows: DataFrame, shared: DataFrame, scratch: common.Scratch) -> DataFrame:
    """``rows`` (token, c, ...) with very frequent shingles that go together replaced by one, where that is less work.

    In a region without rare shingles two sets share many frequent ones, and would be compared at
    each. Shingles that meet in a prefix form a cluster; if all its sets compared once are less than
    the sum over its shingles, the cluster is a shingle. A set's place there is its least one, so no
    bound on the overlap is tightened.
    """
    hot = shared.filter(F.col("c") > MANY * BLOCK)
    met = rows.join(_small(hot.select("token")), "token", "left_semi").select("rep", "token")
    edges = met.groupBy("rep").agg(F.min("token").alias("a")).join(met, "rep").select("a", F.col("token").alias("b")).distinct()
    cluster = components(edges, scratch, "rest-clusters").select(F.col("node").alias("token"), F.col("component").alias("cluster"))
    cluster = hot.join(cluster, "token").select("token", "c", "cluster")
    sets_of = met.join(_small(cluster.select("token", "cluster")), "token").select("cluster", "rep").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    work = cluster.groupBy("cluster").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("work")).join(sets_of, "cluster")
    once = cluster.join(work.filter(F.col("m").cast("double") * F.col("m") <= F.col("work")), "cluster").select("token", F.xxhash64(F.lit("cluster"), "cluster").alias("_as"), "m")
    once = scratch.cut(once, "rest-once")
    apart = rows.join(_small(once.select("token")), "token", "left_anti")
    one = rows.join(_small(once), "token").groupBy(F.col("_as").alias("token"), F.col("m").alias("c"), "rep", "part", "n", "map").agg(F.min("pos").alias("pos"))
    return apart.unionByName(one)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows that 16 bytes a row stay below the limit."""
    return F.broadcast(df) if df.count() * 16 <= BROADCAST_BYTES else df


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: common.Scratch, name: str, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar on their full sets. Only texts of classes with pairs move."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = scratch.cut(docs.join(_small(ends), "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text"), f"{name}-texts")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    # A pair has 16 bytes, but much work: dealt by bytes, all would come to one task. A class with many pairs is shared out.
    dealt = pairs.select("a", "b").repartition(common.parts_for(pairs), F.col("b"), F.pmod(F.xxhash64("a"), F.lit(16))).sortWithinPartitions("b")
    both = dealt.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def make():
        last: list = [None, None]

        def of(text: bytes) -> np.ndarray:
            if last[0] != text:
                last[:] = [text, shingle_hashes(text, size)]
            return last[1]

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            good = [similar(shingle_hashes(x, size), of(y), percent) for x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
            return rows.select([0, 1]).filter(pa.array(good, pa.bool_()))

        return f

    links = scratch.cut(common.map_arrow(both, make, "a long, b long", text=2), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return links


def _grouped(docs: DataFrame, scratch: common.Scratch, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """SETS of the documents, and class_key, component_id of their classes."""
    text = common.text_or_empty(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    own = scratch.cut(sets(docs, size), "sets")
    classes = own.filter("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = scratch.cut(classes, "classes")
    real = classes.filter("rep is not null")
    pairs, dense = candidates(real, scratch, percent)
    label = components(confirmed(pairs, docs, scratch, "near", size, percent), scratch, "near")
    if dense.limit(1).count():
        region = scratch.cut(dense.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("part")), "region")
        links = confirmed(all_candidates(region, docs, scratch, size, percent), docs, scratch, "rest", size, percent)
        label = components(links.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch, "rest")
    # Two classes of one doc_id (repeated doc_ids with different texts) share their component.
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("class_key", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.cut(named, "named")
    scratch.drop("classes", "pairs", "dense", "region", "rest-pairs")
    return own, named


def group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept, per document.

    Documents link if ``100 * |A and B| >= percent * |A or B|`` over their shingle sets. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and empty texts and texts without words have
    an empty set and link with nothing. Repeated rows give a row each; rows that share a doc_id are
    one document, which has the links of all its texts. A null doc_id links only with equal sets and
    takes their least doc_id. An empty table gives no rows. Only doc_id and text are read; other
    columns may have any name.
    """
    own, named = _grouped(docs, common.Scratch(docs.sparkSession, "near-dedup"), shingle_words, percent)
    rows = own.select("doc_id", "n_shingles", "class_key").join(named, "class_key", "left")
    component = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """The documents of which ``group`` keeps one for each component, all columns as they were; of repeated rows one.

    A document without doc_id goes if one with a doc_id has its set; of several without doc_id and
    with equal sets one stays. Documents without words stay, repeated doc_ids apart.
    """
    scratch = common.Scratch(docs.sparkSession, "near-dedup")
    own, named = _grouped(docs, scratch, shingle_words, percent)
    rows = scratch.cut(own.filter("class_key is not null").select("doc_id", "class_key", "text_hash").join(named, "class_key"), "verdicts")
    gone = rows.filter("doc_id <> component_id").select("doc_id").distinct()
    # Where no doc_id is repeated or missing, which is the rule, the documents are not dealt again.
    known = own.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    out = docs.filter(docs["doc_id"].isNotNull()).join(_small(gone), "doc_id", "left_anti").select(*docs.columns)
    if known:
        out = out.dropDuplicates(["doc_id"])
    if not own.filter("doc_id is null").limit(1).count():
        return out
    alone = rows.filter("doc_id is null and component_id is null").groupBy("class_key").agg(F.min("text_hash").alias("h")).select("h").distinct()
    name = common.fresh(docs, "_text_hash")
    nameless = docs.filter(docs["doc_id"].isNull()).withColumn(name, F.xxhash64(common.text_or_empty(docs)))
    empty = ~F.rlike(common.text_or_empty(docs), F.lit(r"[^\x20\x09-\x0D]"))
    one = nameless.join(_small(alone), nameless[name] == alone["h"], "left_semi").dropDuplicates([name])
    return out.unionByName(nameless.filter(empty).drop(name)).unionByName(one.drop(name))
