"""Fingerprint job: string column -> sparse hashed bit set, with a reject table.

The chemistry featuriser is re-aimed at text: a string is split into tokens
(runs of non-blank characters); every token n-gram of length 1..radius+1 is
hashed (md5, first 32 bits) modulo ``size``; the fingerprint is the sorted set
of bit ids (``array<int>``), i.e. the non-zero columns of the dense 0/1
vector.  Whole strings are processed, inside one row (no shuffle).

Rows that cannot be featurised go to a reject table with a reason instead of
failing the job: NULL (``NA value``), non-string input (``Not a string``),
no letter or digit at all (``Invalid``), no token (``Featurization failed``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.md5 import first_words

DEFAULT_SIZE = 1024
DEFAULT_RADIUS = 2
TOKEN_SPLIT = "[ \\t\\n\\r]+"
VALID_CHAR = "[\\p{L}\\p{N}]"
PART_BYTES = 1 << 19     # bytes of texts whose n-grams a task hashes at once
_MARK = np.ones(256, dtype=bool)
_MARK[[ord(c) for c in " \t\n\r"]] = False

NA, NOT_STRING, INVALID, FAILED = "NA value", "Not a string", "Invalid", "Featurization failed"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_SPLIT), lambda t: t != "")


def fingerprint_column(texts: pa.Array, max_n: int, size: int) -> pa.Array:
    """Sorted distinct bit ids of the token n-grams of length 1..max_n of every text (``list<int32>``).

    The tokens of all texts are laid out one after another with one blank between them, so an n-gram
    is a stretch of that layout and none is ever built by itself.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    mark = _MARK[data]  # whether a byte is part of a token
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(mark & (edge[:-1] | ~np.concatenate([[False], mark[:-1]])))
    end = np.flatnonzero(mark & (edge[1:] | ~np.concatenate([mark[1:], [False]]))) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    long = end - start
    at = np.cumsum(long + 1) - (long + 1)
    line = np.full(int((long + 1).sum()), ord(" "), dtype=np.uint8)
    line[np.arange(int(long.sum())) + np.repeat(np.arange(len(long)), long)] = data[mark]
    found = []
    for n in range(1, max_n + 1):
        i = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
        last = i + n - 1
        bits = first_words(line, at[i], at[last] + long[last] - at[i]).astype(np.int64) % size
        found.append(row[i] << 32 | bits)
    both = np.sort(np.concatenate(found))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    ends = np.concatenate([[0], np.cumsum(np.bincount(both >> 32, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(both & 0xFFFFFFFF, pa.int32()))


def _fingerprints(rows: DataFrame, max_n: int, size: int) -> DataFrame:
    """``(key, bits)`` of rows ``(key, text)``."""
    def run(batches):
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # a part has at most PART_BYTES bytes, or one row
                before = upto[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(upto, before + PART_BYTES, "right")))
                b = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([b.column(0), fingerprint_column(b.column(1), max_n, size)], ["key", "bits"])
                at = stop

    key = rows.schema[0]
    return rows.mapInArrow(run, f"key {key.dataType.simpleString()}, bits array<int>").withColumnRenamed("key", key.name)


def reject_reason(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    if not isinstance(dtype, T.StringType):
        return F.when(F.col(col).isNull(), F.lit(NA)).otherwise(F.lit(NOT_STRING))
    c = F.col(col)
    return (F.when(c.isNull(), F.lit(NA))
            .when(~c.rlike(VALID_CHAR), F.lit(INVALID))
            .when(F.size(tokens(c)) == 0, F.lit(FAILED)))


def quarantine_rows(df: DataFrame, col: str, row_index: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid rows, rejects ``(row_index, value, error)``) by one reason column."""
    d = df.withColumn("_reason", reject_reason(df, col))
    good = d.where(F.col("_reason").isNull()).drop("_reason")
    bad = d.where(F.col("_reason").isNotNull()).select(
        F.col(row_index).alias("row_index"), F.col(col).cast("string").alias(col), F.col("_reason").alias("error"))
    return good, bad


def quarantine_summary(df: DataFrame, col: str) -> DataFrame:
    """Counts per outcome in one aggregate: ('ok' or the reject reason, n)."""
    return df.select(F.coalesce(reject_reason(df, col), F.lit("ok")).alias("status")) \
        .groupBy("status").agg(F.count(F.lit(1)).alias("n"))


class NoValidRowsError(ValueError):
    pass


def hash_fingerprint(df: DataFrame, col: str, key: str, size: int = DEFAULT_SIZE, radius: int = DEFAULT_RADIUS,
                     check: bool = True, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fingerprints ``(key, bits array<int>)``, rejects).  Raises when no row is valid.

    ``partitions``: deal the valid rows out to so many tasks first.  For inputs of few, large row
    groups, whose scan has too few tasks for this much work per row.
    """
    if check and not df.where(reject_reason(df, col).isNull()).limit(1).collect():
        raise NoValidRowsError("no valid fingerprints were generated")
    good, bad = quarantine_rows(df, col, key)
    rows = good.select(key, col)
    if partitions:
        rows = rows.repartition(partitions, key)
    return _fingerprints(rows.select(key, F.col(col).cast("string").alias(col)), radius + 1, size), bad


def explode_bits(fps: DataFrame, key: str) -> DataFrame:
    return fps.select(key, F.explode("bits").alias("bit"))


def sql_fingerprint_bits(table: str, key: str, col: str, size: int = DEFAULT_SIZE, radius: int = DEFAULT_RADIUS) -> str:
    """DuckDB twin: ``(key, bit)`` rows of the valid strings."""
    leads = ", ".join(f"lead(tok, {i}) OVER w AS t{i}" for i in range(1, radius + 1))
    grams = []
    for n in range(1, radius + 2):
        expr = " || ' ' || ".join(["tok"] + [f"t{i}" for i in range(1, n)])
        cond = f" WHERE t{n - 1} IS NOT NULL" if n > 1 else ""
        grams.append(f"SELECT k, {expr} AS g FROM fp_lead{cond}")
    return f"""
fp_toks AS (SELECT {key} AS k, list_filter(string_split_regex({col}, '[ \\t\\n\\r]+'), lambda t: t <> '') AS t
            FROM {table} WHERE {col} IS NOT NULL AND regexp_matches({col}, '[\\p{{L}}\\p{{N}}]')),
fp_pos AS (SELECT k, unnest(t) AS tok, unnest(range(len(t))) AS i FROM fp_toks),
fp_lead AS (SELECT k, tok, {leads} FROM fp_pos WINDOW w AS (PARTITION BY k ORDER BY i)),
fp_grams AS ({" UNION ALL ".join(grams)}),
fp_bits AS (SELECT DISTINCT k AS {key}, CAST(CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % {size} AS INTEGER) AS bit
            FROM fp_grams)"""
