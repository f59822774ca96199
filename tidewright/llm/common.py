"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all run here."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


@atexit.register
def _sweep() -> None:
    for spark, where in _written:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, where)
        except Exception:  # the session ended before us; the folder's owner cleans up
            return


class Written:
    """A table written to the shared folder, which cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.where = f"{shared_dir(self.spark)}/tidewright/{uuid.uuid4().hex}"
        df.write.parquet(self.where)
        _written.append((self.spark, self.where))
        self.df = self.spark.read.schema(df.schema).parquet(self.where)

    def drop(self) -> None:
        remove(self.spark, self.where)


def written(df: DataFrame) -> DataFrame:
    return Written(df).df


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own: `names`, with underscores after those that are in `columns`."""
    have, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


Batches = Iterator[pa.RecordBatch]


#: Rows that go to a Python worker at once, at most: a thousand very long texts still fit its memory.
ROWS = 1000


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """mapInArrow after shipping the package, so that workers can import fn. Lowers the session's
    rows an Arrow batch to ROWS where they are more."""
    ship(df.sparkSession)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(most)) <= ROWS:
        df.sparkSession.conf.set(most, str(ROWS))
    return df.mapInArrow(fn, schema)


def slices(batches: Batches, rows: int = 1000, column: int = 1, most_bytes: int = 8 << 20) -> Batches:
    """Smaller batches: of `rows` rows at most, and of most_bytes of text in a column, or one row."""
    for b in batches:
        ends = None
        if column < b.num_columns and pa.types.is_string(b.schema.types[column]):
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = min(b.num_rows, at + rows)
            if ends is not None:
                before = ends[at - 1] if at else 0
                end = max(at + 1, min(end, int(np.searchsorted(ends, before + most_bytes, "right"))))
            yield b.slice(at, end - at)
            at = end


def gathered(batches: Batches, rows: int = 4000, column: int = 1, most_bytes: int = 8 << 20) -> Batches:
    """Fewer, larger batches, within the limits of slices()."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for b in slices(batches, rows, column, most_bytes):
        n = b.column(column).nbytes
        if held and (size + n > most_bytes or count + b.num_rows > rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, count = [], 0, 0
        held.append(b)
        size, count = size + n, count + b.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def thinned(rows: DataFrame, key, count, wanted: int, spare: int = 8):
    """Rows whose hash of `key` lies in a share that holds about `spare` times the rows wanted of
    `count`; all of them where there are few. What is left for a sort or rank is bounded, however many
    partitions the rows come from."""
    share = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(share * count < spare * wanted)


def bucket_of(doc_id, mod: int):
    """crc32 of the id as text, modulo mod: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
