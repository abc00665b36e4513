"""Shared helpers: tables, cluster storage, labels and text units.

Intermediate results are written as Parquet to the folder that the cluster
names in ``spark.checkpoint.dir``; every executor can read them, so a lost
executor costs a retry and never a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table

BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_BYTES`` at most: rows are counted by default up to 64 MB, and texts
    may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return read_table(spark, sf_dir, name)


def store_dir(spark: SparkSession) -> str:
    """The shared folder. Only where the session names none: a temporary one under a
    local master, the warehouse otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_quire"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_written: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


class Stored:
    """A DataFrame written to shared storage: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        bounded(self.spark)
        self.path = f"{store_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _written[self.path] = self.spark
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _written.pop(self.path, None)


def materialise(df: DataFrame, label: str) -> DataFrame:
    return Stored(df, label).df


def stored_alone(make: Callable[[], DataFrame], label: str) -> Stored:
    """What ``make`` gives, written; all that was stored on the way to it is deleted."""
    before = set(_written)
    out = Stored(make(), label)
    for path in set(_written) - before - {out.path}:
        _delete(_written.pop(path), path)
    return out


HOT = 1000


def _hot(counted: DataFrame, weight: str) -> Column | None:
    """Whether a row's weight is over a thousandth of all: true of fewer than a thousand rows."""
    total = counted.agg(F.sum(weight)).first()[0]
    return None if total is None else F.col(weight) * HOT > total


def hot_keys(counted: DataFrame, weight: str) -> list:
    """The first column of the hot rows, fewer than ``HOT``."""
    hot = _hot(counted, weight)
    return [] if hot is None else [r[0] for r in counted.where(hot).collect()]


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """left joined with right by ``keys``, which are unique in right; ``weight`` counts their
    rows in left. Hot keys meet a broadcast of fewer than ``HOT`` rows and so stay where they
    are; the others are shuffled. Both are read twice, so they are best stored."""
    hot = _hot(right, weight)
    if hot is None:
        return left.join(right, keys)
    often = right.where(hot)
    rest = left.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(F.broadcast(often), keys).unionByName(rest)


def with_clear_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; whatever else the input carries can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_fold(id_col, mod: int):
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def sampled(ids: DataFrame, key: str, at_most: int) -> DataFrame:
    """About ``at_most`` of the rows, chosen by a hash of ``key``: the same rows on every
    run. Expected size is bounded whatever the input's size."""
    n = ids.count()
    if n <= at_most:
        return ids
    share = int(at_most / n * (1 << 40))
    return ids.where(F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(1 << 40)) < share)


def doubles(values) -> Column:
    """A constant array<double>, folded by Catalyst."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")
