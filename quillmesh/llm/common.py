"""Shared folder, written intermediates and small helpers of the llm operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WHITE = " \t\n\u000b\f\r"

#: Written intermediates by who asked for them.
_scratch: dict[str, list[str]] = {}
_owner = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary folder only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
    return os.path.dirname(spark.sparkContext.getCheckpointDir())


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives a lost executor.

    ``release`` deletes what isn't marked to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _scratch.setdefault(_owner[-1], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned_by(name: str) -> Iterator[None]:
    """Intermediates written meanwhile belong to the name."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def release(spark: SparkSession, name: str = "") -> None:
    """Delete an owner's intermediates; only for callers whose earlier results have been written out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for written_to in _scratch.pop(name, []):
        path = jvm.org.apache.hadoop.fs.Path(written_to)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in the given part; a null id is in no part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Memo(dict):
    """A dict that computes missing values and holds two generations of at most ``limit`` entries each."""

    def __init__(self, compute, limit: int = 150_000, longest: int = 64):
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
