"""Token counts as rollups that deltas maintain.

A batch holds changes: rows with a sign, +1 for an inserted document, -1 for a deleted one; a
revised count is the old row with -1 and the new one with +1. Each commit adds up its changes by
source, language and tokenizer version and writes these few rows. Totals are the sum of all
committed batches, and zero groups vanish. A batch id commits once: its folder is written under a
name of its own attempt and then made current by a marker file, which is written aside and renamed
to the batch's name if that does not exist yet. So a commit that is run again, raced or broken off
changes nothing. ``compact`` folds batches into one; of folds that overlap one counts.

The store must rename a file atomically and refuse to where the name is taken, as HDFS does; an
object store needs a committer in front that offers this.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
WORD = r"[^\x20\x09-\x0D]+"
#: Tokenizer versions that SQL functions can count.
NATIVE = {
    "words.1": lambda text: F.regexp_count(text, F.lit(WORD)).cast("long"),
    "bytes.1": lambda text: F.octet_length(text).cast("long"),
}


def count_bpe(docs: DataFrame, tokenizer_path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """doc_id, source, lang and the number of ids that a ``tokenizers`` file gives each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(common.tokenizer_json(tokenizer_path))  # one file of a fixed size

    def make():
        from .bpe import encoder

        enc = encoder(held.value)

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            counts = [len(x) // 4 for x in enc.encode(rows.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", name])

        return f

    return common.map_arrow(docs.select("doc_id", "source", "lang", common.text_or_empty(docs).alias("text")), make, f"doc_id long, source string, lang string, {name} long", text=3, encodes=True)


def inserts(rows: DataFrame, tokenizer: str, n: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).alias("sign"), n.cast("long").alias("n_tokens"))


def deletes(rows: DataFrame, tokenizer: str, n: Column) -> DataFrame:
    return inserts(rows, tokenizer, n).withColumn("sign", F.lit(-1))


def revisions(rows: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Documents whose count changed: the old one goes, the new one comes."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.explode(F.array(F.struct(F.lit(-1).alias("sign"), old.cast("long").alias("n_tokens")), F.struct(F.lit(1).alias("sign"), new.cast("long").alias("n_tokens")))).alias("x")).select(
        "source", "lang", "tokenizer", "x.sign", "x.n_tokens"
    )


class Rollup:
    """The rollup kept in a folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(f"{self.folder}/x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/_commits"))

    def _markers(self) -> dict[str, dict]:
        out = {}
        for x in self._fs.listStatus(self._path(f"{self.folder}/_commits")):
            name = x.getPath().getName()
            if name.startswith(("_", ".")):  # written aside, and left by a driver that was lost
                continue
            stream = self._fs.open(x.getPath())
            try:
                out[name] = json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # no marker of this protocol: nothing was committed by it
                continue
            finally:
                stream.close()
        return out

    def _mark(self, name: str, what: dict) -> bool:
        """False if the marker was there already; of several callers one succeeds."""
        at, aside = (self._path(f"{self.folder}/_commits/{x}") for x in (name, f"_{uuid.uuid4().hex}"))
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(what).encode())
        stream.close()
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), sc._jsc.hadoopConfiguration())
        kinds = sc._jvm.org.apache.hadoop.fs.Options.Rename
        how = sc._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        broken = self._fs.exists(at) and name not in self._markers()
        if broken:
            how[0] = kinds.OVERWRITE
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(at), how)
        except Exception as e:  # noqa: BLE001
            if not self._fs.exists(at):
                raise e
            self._fs.delete(aside, False)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (source, lang, tokenizer, sign, n_tokens); False if it was committed before.

        Null counts are 0 tokens; null sources and languages are groups of their own. A hot group
        is added up on the map side before the shuffle.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch.startswith(("_", ".", "fold-")):
            raise ValueError(f"a batch id of the rollup's own: {batch!r}")
        live = self._markers()
        if batch in live:
            return False
        data = f"delta-{batch}-{uuid.uuid4().hex}"
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).cast("long").alias("n_tokens"))
        delta.write.parquet(f"{self.folder}/{data}")
        if self._mark(batch, {"data": data}):
            return True
        self._fs.delete(self._path(f"{self.folder}/{data}"), True)
        return False

    def _current(self) -> dict[str, dict]:
        """Markers whose data count: every batch once, whatever folds there are.

        A fold counts if all that it folds counts and no fold before it, by name, has taken any of it.
        """
        live = self._markers()
        counts, taken = {k for k, x in live.items() if "folds" not in x}, set()
        waiting = sorted(k for k, x in live.items() if "folds" in x)
        while ready := [k for k in waiting if counts.issuperset(live[k]["folds"])]:
            k = ready[0]
            waiting.remove(k)
            if taken.isdisjoint(live[k]["folds"]):
                counts.add(k)
                taken.update(live[k]["folds"])
        return {k: live[k] for k in counts - taken}

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._sums(self._current())

    def _sums(self, markers: dict[str, dict]) -> DataFrame:
        at = [f"{self.folder}/{x['data']}" for x in markers.values()]
        rows = self.spark.read.schema(SCHEMA).parquet(*at) if at else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> bool:
        """Folds all current batches into one; their ids stay committed. False if there was nothing to fold, or another did it.

        The marker is named by what it folds, so two that fold the same are one. Totals are of the
        batches listed here, not of those that come while this runs.
        """
        current = self._current()
        if len(current) < 2:
            return False
        name = f"fold-{hashlib.sha256(' '.join(sorted(current)).encode()).hexdigest()[:32]}"
        data = f"{name}-{uuid.uuid4().hex}"
        self._sums(current).write.parquet(f"{self.folder}/{data}")
        if self._mark(name, {"data": data, "folds": sorted(current)}):
            return True
        self._fs.delete(self._path(f"{self.folder}/{data}"), True)
        return False


def later_copies(counted: DataFrame, values: list[str]) -> DataFrame:
    """source, lang, copies and ``values`` of the documents whose text an earlier doc_id has.

    ``counted`` has doc_id, source, lang, text_key and the values, which equal texts share. Copies are
    added up by text, source and language on the map side first, so a text that a third of all
    documents have costs a row for each source, language and task.
    """
    same = counted.filter("text_key is not null").groupBy("text_key", "source", "lang", "doc_id").agg(F.count(F.lit(1)).alias("c"), *[F.min(x).alias(x) for x in values])
    by = same.groupBy("text_key", "source", "lang").agg(F.sum("c").alias("c"), F.min(F.struct("doc_id", "c")).alias("first"), *[F.min(x).alias(x) for x in values])
    least = by.groupBy("text_key").agg(F.min("first.doc_id").alias("first_id"))
    rows = by.join(least, "text_key").withColumn("copies", F.col("c") - F.when(F.col("first.doc_id") == F.col("first_id"), F.col("first.c")).otherwise(0))
    return rows.filter("copies > 0").select("source", "lang", "copies", *values)


def corpus_rollup(docs: DataFrame, markup: str = r"<[^<>\n]{1,40}>", tokenizers: dict[str, str | None] | None = None) -> DataFrame:
    """The rollup of a corpus that loads, gets cleaner texts, and loses its later exact copies.

    Batches: ``load`` inserts every document under each tokenizer version; ``clean`` revises the
    counts of texts that lose inline markup; ``copies`` deletes documents whose text an earlier
    doc_id has; and ``load`` comes a second time and must change nothing. Tokenizer versions are
    NATIVE, or those of ``tokenizers``: names and paths of their files (None: the default one). A
    null text has 0 tokens and is nobody's copy; of repeated rows (same doc_id and text) all stay,
    as none is later. A null doc_id is no copy and has none. An empty table gives no rows. Of
    ``docs`` only doc_id, text, source and lang are read.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "token-rollup")
    text = common.text_or_empty(docs)
    cleaned = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, markup, "")).otherwise(text)
    key = F.when(docs["text"].isNotNull() & docs["doc_id"].isNotNull(), F.sha2(text, 256)).alias("text_key")
    names = list(NATIVE if tokenizers is None else tokenizers)
    columns = [f"{x}_{k}" for k in range(len(names)) for x in ("old", "new")]
    if tokenizers is None:
        counted = docs.select("doc_id", "source", "lang", key, *[f(x).alias(f"{when}_{k}") for k, f in enumerate(NATIVE.values()) for when, x in (("old", text), ("new", cleaned))])
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", key, text.alias("old"), F.when(cleaned != text, cleaned).alias("new"))
        counted = _bpe_columns(texts, list(tokenizers.values()), columns)
    counted = scratch.cut(counted, "counts")  # 60 bytes a document; the texts are read once
    both = lambda f: functools.reduce(DataFrame.unionByName, [f(k, name) for k, name in enumerate(names)])
    later = scratch.cut(later_copies(counted, [x for x in columns if x.startswith("new")]), "later")
    rollup = Rollup(spark, scratch.path("state"))
    load = both(lambda k, name: inserts(counted, name, F.col(f"old_{k}")))
    rollup.commit("load", load)
    rollup.commit("clean", both(lambda k, name: revisions(counted.filter(F.col(f"old_{k}") != F.col(f"new_{k}")), name, F.col(f"old_{k}"), F.col(f"new_{k}"))))
    # So many copies of one text are one change with that sign.
    rollup.commit("copies", both(lambda k, name: later.select("source", "lang", F.lit(name).alias("tokenizer"), (-F.col("copies")).alias("sign"), F.col(f"new_{k}").alias("n_tokens"))))
    rollup.commit("load", load)
    scratch.drop("counts", "later")
    return rollup.totals()


def _bpe_columns(texts: DataFrame, paths: list[str | None], columns: list[str]) -> DataFrame:
    """doc_id, source, lang, text_key and, per tokenizer, the ids of ``old`` and of ``new`` (null: as old)."""
    held = texts.sparkSession.sparkContext.broadcast([common.tokenizer_json(x) for x in paths])  # files of fixed sizes

    def make():
        from .bpe import Encoder

        own = [Encoder(x) for x in held.value]

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            old, new = rows.column(4).to_pylist(), rows.column(5).to_pylist()
            out = []
            for e in own:
                n = [len(x) // 4 for x in e.encode(old)]
                changed = [k for k, x in enumerate(new) if x is not None]
                m = list(n)
                for k, x in zip(changed, e.encode([new[k] for k in changed]), strict=True):
                    m[k] = len(x) // 4
                out += [pa.array(n, pa.int64()), pa.array(m, pa.int64())]
            return pa.RecordBatch.from_arrays([*rows.columns[:4], *out], names=["doc_id", "source", "lang", "text_key", *columns])

        return f

    return common.map_arrow(texts, make, ", ".join(["doc_id long, source string, lang string, text_key string", *[f"{x} long" for x in columns]]), text=4)
