"""Shared by the operators: the folder for written tables, names, and batches of texts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes up at once.
BATCH_BYTES = 4 << 20


class Scratch:
    """A folder of its own below spark.checkpoint.dir for tables that cut lineage.

    All executors and the driver share that folder. Where the setting is absent (tests on one
    machine), a folder in the local temporary directory takes its place. Tables that are no longer
    needed are dropped by ``drop``; the rest goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="marlstone-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.dir = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows as a table and reads it back."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for at in [self.path(x) for x in names] or [self.dir]:
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended; leftovers do no harm
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def batches(rows: pa.RecordBatch, text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(rows.column(text)), 0).to_pylist()
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield rows.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if begin < rows.num_rows:
        yield rows.slice(begin)


def release() -> None:
    """Gives up what an encoder of an earlier stage has kept in this worker."""
    bpe = sys.modules.get(f"{__package__}.bpe")
    if bpe is not None and bpe._made:
        bpe._made.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]]], schema: str, text: int | None = None, encodes: bool = False) -> DataFrame:
    """Runs ``make()(batch)`` in each task; batches are small in bytes if ``text`` is a column's number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            release()
        f = make()
        for rows in it:
            for part in batches(rows, text) if text is not None else (rows,):
                if part.num_rows:
                    got = f(part)
                    if isinstance(got, pa.RecordBatch):
                        yield got
                    else:
                        yield from got

    return df.mapInArrow(run, schema)


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file, read on the driver; tasks get its contents, not its path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def parts_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions: the session's number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
