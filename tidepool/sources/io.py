"""Reading and writing tables.

``read_table`` dispatches on the file extension: ``.parquet`` is Parquet,
``.tab`` is tab-separated text with a header, anything else is CSV with a
header.  Pass an explicit schema for text files on large inputs (inference is
a full extra scan).  NaN in floating columns becomes SQL NULL (it would sort
above every number and poison averages), and in the columns named as labels so
does the sentinel -1, which stands for a missing label.
"""

from __future__ import annotations

import csv
import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.sources.history import HistorySchemaError, append_history, read_history, read_if_present  # noqa: F401


MISSING_LABELS = (-1.0,)


def normalize_missing(df: DataFrame, cols: list[str] | None = None,
                      sentinels: tuple[float, ...] = ()) -> DataFrame:
    """Turn NaN (and optional sentinel values) into NULL in the given numeric columns."""
    numeric = (T.FloatType, T.DoubleType)
    fields = {f.name: f.dataType for f in df.schema.fields}
    targets = cols if cols is not None else [c for c, t in fields.items() if isinstance(t, numeric)]
    out = []
    for c in df.columns:
        col = F.col(c)
        if c in targets:
            bad = F.isnan(col) if isinstance(fields[c], numeric) else F.lit(False)
            for s in sentinels:
                bad = bad | (col == F.lit(s))
            col = F.when(bad, F.lit(None).cast(fields[c])).otherwise(col)
        out.append(col.alias(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               normalize: bool = True, label_cols: list[str] | None = None) -> DataFrame:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".parquet":
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.parquet(path)
    else:
        reader = spark.read.option("header", "true")
        if ext == ".tab":
            reader = reader.option("sep", "\t")
        # "NaN" cells in text files are read as NaN, then normalised below.
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
        df = reader.csv(path)
    if normalize:
        df = normalize_missing(df)
    if label_cols:
        df = normalize_missing(df, label_cols, MISSING_LABELS)
    return df


def read_features(spark: SparkSession, path: str, key_col: str) -> DataFrame:
    """Wide feature file (a key column, all others numeric) -> ``(id, x array<float>)``, columns in file order.

    A text line is cut straight into key and array: only its header says how wide it is, the
    file is scanned once, and no plan holds a column per unit.  NaN, empty and unreadable
    numbers are NULL.  The key may be quoted; a quoted line break in it is not supported.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".parquet":
        wide = normalize_missing(spark.read.parquet(path))
        units = [c for c in wide.columns if c != key_col]
        return wide.select(F.col(f"`{key_col}`").alias("id"), F.array(*[F.col(f"`{c}`").cast("float") for c in units]).alias("x"))
    sep = "\t" if ext == ".tab" else ","
    lines = spark.read.text(path)
    head = lines.first()  # one line of one file
    names = next(csv.reader([head[0]], delimiter=sep)) if head else []
    if key_col not in names:
        raise ValueError(f"{path} has no column {key_col!r}")
    at, width = names.index(key_col), len(names)
    line = F.col("value")
    # the fields before the key are numbers, so the first quote of a line opens the key
    before = F.regexp_extract(line, f"^(?:[^{sep}]*{sep}){{{at}}}", 0) if at else F.lit("")
    rest = F.substr(line, F.length(before) + 1)
    quoted = rest.startswith('"')
    raw = F.when(quoted, F.regexp_extract(rest, '^"(?:[^"]|"")*"', 0)).otherwise(F.substring_index(rest, sep, 1))
    key = F.when(quoted, F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
    after = F.substr(rest, F.length(raw) + 2)
    numbers = F.slice(F.split(before, sep), 1, at) if at else F.array().cast("array<string>")
    if at < width - 1:
        numbers = F.concat(numbers, F.split(after, sep))
    x = F.transform(numbers, lambda v: F.when(~F.isnan(v.try_cast("float")), v.try_cast("float")))
    # the header is known by its digest, so that the plan does not hold it either
    header = (F.length(line) == len(head[0])) & (F.md5(line) == hashlib.md5(head[0].encode()).hexdigest())
    return lines.where(~header).select(key.alias("id"), x.alias("x"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "tab":
        writer.option("header", "true").option("sep", "\t").csv(path)
    else:
        writer.parquet(path)
    return path
