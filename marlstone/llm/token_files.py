"""Binary token files: documents' ids, each compressed by itself with one shared dictionary.

A shard file is ``TIDS1\\n``, a little-endian u32 with the length of a JSON header, the header, the
offset index, and the documents' zstandard frames. The index holds, per document: doc_id (i64),
whether it is null (u8), number of ids (u32) and the end of its frame (u64). Ids are serialized as
u16 if the vocabulary allows, else as u32. The header names the SHA-256 of the dictionary, which
is in ``dictionary`` beside the shards. Bytes after the last frame are ignored. One document is
read from its index entry and its frame alone.

Shards hold ascending doc_ids and come in the order (part, seq). They are written and read through
Spark's own file sources, so any store that Spark reaches will do, and a task that is lost and run
again leaves no second copy.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TIDS1\n"
#: Documents of which the dictionary is fitted, and code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 8192
DIGEST = "part int, seq int, nth int, doc_id long, local long, n_tokens long, ids_crc32 long"


def pack_shard(docs: list[tuple[int | None, bytes]], width: int, dictionary: bytes, part: int, seq: int, level: int = 3) -> bytes:
    """docs: doc_id and little-endian u32 ids."""
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True)
    frames = [press.compress(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()) for _, ids in docs]
    head = {"part": part, "seq": seq, "docs": len(docs), "width": width, "dictionary": hashlib.sha256(dictionary).hexdigest() if dictionary else "", "ids": sum(len(x) // 4 for _, x in docs)}
    raw = json.dumps(head, sort_keys=True).encode()
    index = np.array([x or 0 for x, _ in docs], "<i8").tobytes() + np.array([x is None for x, _ in docs], "u1").tobytes() + np.array([len(x) // 4 for _, x in docs], "<u4").tobytes() + np.cumsum([len(x) for x in frames], dtype="<u8").tobytes()
    return b"".join([MAGIC, struct.pack("<I", len(raw)), raw, index, *frames])


class Shard:
    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4 + n
        self.head = json.loads(data[at - n : at])
        if self.head["dictionary"] != (hashlib.sha256(dictionary).hexdigest() if dictionary else ""):
            raise ValueError("the shard was written with another dictionary")
        k = self.head["docs"]
        ids = np.frombuffer(data, "<i8", k, at)
        null = np.frombuffer(data, "u1", k, at + 8 * k)
        self.counts = np.frombuffer(data, "<u4", k, at + 9 * k)
        self._ends = np.frombuffer(data, "<u8", k, at + 13 * k)
        self._frames = at + 21 * k
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self._data = memoryview(data)
        self._open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, as little-endian u32."""
        begin = int(self._ends[k - 1]) if k else 0
        raw = self._open.decompress(self._data[self._frames + begin : self._frames + int(self._ends[k])])
        return np.frombuffer(raw, f"<u{self.head['width']}").astype("<u4", copy=False)


def sample(docs: DataFrame) -> list[str]:
    """At most SAMPLE_DOCS different texts, those of least hash; of a text of over SAMPLE_CHARS a part at a place its hash names.

    A count sets a bound on the hash that about twice as many texts pass, so tasks send few, whatever
    the number of partitions or copies.
    """
    n = docs.count()
    if not n:
        return []
    h = F.xxhash64("text")
    bound = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 2 * SAMPLE_DOCS / n)))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substring("text", (F.pmod(F.col("h"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = docs.select("text", h.alias("h")).filter((F.col("h") <= F.lit(bound)) & (F.length("text") > 0)).select("h", part.alias("text"))
    few = rows.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_DOCS)
    return [x["text"] for x in few.collect()]


def train_dictionary(docs: DataFrame, tokens: str, end_id: int, width: int, size: int = 32 << 10) -> bytes:
    """Fitted on the id arrays of ``sample``. Where they are too few to train on, they are the dictionary themselves.

    Without any text there is none: the header then names none.
    """
    import zstandard

    from .bpe import encoder

    samples = [np.append(np.frombuffer(x, "<u4"), end_id).astype(f"<u{width}").tobytes() for x in encoder(tokens).encode(sample(docs))]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
        return bytes(8) + raw if raw else b""  # zeros first: never the mark of a trained one


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id order over the partitions; equal doc_ids by a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.repartitionByRange(common.parts_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 2, shard_bytes: int = 16 << 20) -> None:
    """Writes shards of about ``shard_bytes`` of ids to ``folder``/shards, the dictionary beside them."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokens = common.tokenizer_json(tokenizer_path)
    width = 2 if max(Tokenizer.from_str(tokens).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs.select("doc_id", common.text_or_empty(docs).alias("text")), tokens, end_id, width)
    spark.createDataFrame([(bytearray(dictionary),)], "content binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    held = spark.sparkContext.broadcast((tokens, dictionary))  # a tokenizer file and at most 32 KB

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        enc, part, seq = encoder(held.value[0]), TaskContext.get().partitionId(), 0
        end, own, size = np.array([end_id], "<u4").tobytes(), [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([pack_shard(own, width, held.value[1], part, seq)], pa.binary())], names=["shard"])
        for rows in it:
            for some in common.batches(rows, 1):
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    own.append((doc_id, ids + end))
                    size += len(ids) + 4
                    if size >= shard_bytes:
                        yield done()
                        own, size, seq = [], 0, seq + 1
        if own:
            yield done()

    shards = ordered(docs).mapInArrow(run, "shard binary")
    # The text source writes a value's bytes as they are; each shard gets a file of its own.
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{folder}/shards")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, nth, doc_id, local start, number of ids and their CRC-32 of every document in the files."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    held = spark.sparkContext.broadcast(bytes(row[0]))

    def make():
        def f(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for data in rows.column(0).to_pylist():
                shard = Shard(data, held.value)
                starts = np.concatenate([[0], np.cumsum(shard.counts.astype("i8"))])[:-1]
                n = shard.head["docs"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.head["part"]] * n, pa.int32()), pa.array([shard.head["seq"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts), pa.array(shard.counts.astype("i8")), pa.array([zlib.crc32(shard.ids(k)) for k in range(n)], pa.int64()),
                    ],
                    names=["part", "seq", "nth", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

        return f

    return common.map_arrow(spark.read.format("binaryFile").load(f"{folder}/shards").select("content"), make, DIGEST, text=0)


def digests(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, shard_bytes: int = 16 << 20) -> DataFrame:
    """Writes the files, reads them back, and gives each document's place and checksum.

    Null and empty texts are documents of the end id alone. Equal doc_ids (and null ones, which come
    first) are ordered by a hash of their text; repeated rows each get a place. An empty table gives
    no rows. Only doc_id and text are read; other columns may have any name. The starts of shards
    come from their sums: one row a shard meets in one task.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "token-files")
    write(docs, scratch.dir, tokenizer_path, end_id, shard_bytes)
    rows = scratch.cut(read(spark, scratch.dir), "digest")
    sums = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", "seq", F.coalesce(F.sum("n").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
