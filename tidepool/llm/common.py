"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import scratch_path

#: Word of a text: a run of characters other than ASCII white space.  ``bytes.split()``
#: cuts at exactly these characters, so Python code uses that instead of a regex.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (writer's ``options``) under the shared checkpoint folder and read it back.

    Like ``checkpoint()`` it cuts the lineage and survives lost executors, but the
    copy is compressed and later reads can prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of materialized rows that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the write that made them ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that do not clash with any column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        name = f"__{s}"
        while name.lower() in taken:
            name = f"__{s}_{uuid.uuid4().hex[:6]}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(col: str | Column) -> Column:
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
