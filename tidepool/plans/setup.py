"""The standard active-learning inputs built from the driver tables, in Spark and in SQL.

Spark side returns DataFrames; SQL side returns DuckDB CTE text with the same
names (``feats``, ``cells``, ``roles``, ``train_cells``, ``test_cells``, ``wt``,
``bias``) so oracle queries can be written on top.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.hashing import sql_hash52
from tidepool.operators.scoring import (
    DEFAULT_DROPOUT, DEFAULT_PASSES, centroid_weights, sql_centroid_weights, sql_keep_mask_ctes,
)
from tidepool.operators.split import split_random
from tidepool.session import cut_lineage
from tidepool.sources import testdata as td

SPLIT_SEED = 42
TRAIN_FRAC = 0.8
MAIN_TASK = "t0"


@dataclass
class ALInputs:
    feats: DataFrame
    cells: DataFrame
    roles: DataFrame
    train_cells: DataFrame
    test_cells: DataFrame
    weights: DataFrame


def al_inputs(spark: SparkSession, sf_dir: str) -> ALInputs:
    feats = td.emb_features(spark, sf_dir)
    cells = td.emb_cells(spark, sf_dir)
    # read by every consumer below: drawn once
    roles = cut_lineage(split_random(feats.select("id"), TRAIN_FRAC, SPLIT_SEED))
    cr = cells.join(roles, "id")
    train = cr.where(F.col("role") == "train").drop("role")
    test = cr.where(F.col("role") == "test").drop("role")
    weights = centroid_weights(train, feats, tasks=td.EMB_TASKS)
    return ALInputs(feats, cells, roles, train, test, weights)


def pool_feats(inp: ALInputs) -> DataFrame:
    return inp.feats.join(inp.roles.where(F.col("role") == "train"), "id", "left_semi")


def test_feats(inp: ALInputs) -> DataFrame:
    return inp.feats.join(inp.roles.where(F.col("role") == "test"), "id", "left_semi")


SQL_AL_DATA = f"""
feats AS ({td.SQL_EMB_FEATURES}),
cells AS ({td.SQL_EMB_CELLS}),
ids_h AS (SELECT id, {sql_hash52(SPLIT_SEED, 'id')} AS h FROM feats),
roles AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY h, id) <= floor({TRAIN_FRAC} * count(*) OVER ())
                          THEN 'train' ELSE 'test' END AS role FROM ids_h),
train_cells AS (SELECT c.id, c.task, c.y FROM cells c JOIN roles r ON c.id = r.id WHERE r.role = 'train'),
test_cells AS (SELECT c.id, c.task, c.y FROM cells c JOIN roles r ON c.id = r.id WHERE r.role = 'test')"""
SQL_AL_BASE = SQL_AL_DATA + ",\n" + sql_centroid_weights('SELECT * FROM train_cells', 'SELECT * FROM feats')


def sql_probs(name: str, ids_sql: str, passes: int = DEFAULT_PASSES, dropout: bool = True,
              tasks_sql: str | None = None, rate: float = DEFAULT_DROPOUT, key: str = "s.id") -> str:
    """CTEs ending in ``{name}(id, task, pass, p)`` for the ids selected by ``ids_sql``."""
    wsel = f"(SELECT * FROM wt WHERE task IN ({tasks_sql}))" if tasks_sql else "wt"
    xv = (f"{name}_xv AS (SELECT id, unnest(range(len(x))) AS j, CAST(unnest(x) AS DOUBLE) AS v "
          f"FROM feats WHERE id IN ({ids_sql}))")
    if dropout:
        mask = sql_keep_mask_ctes(f"{name}_xv", passes, rate, key).replace("mask_", f"{name}_mask_")
        zsum = (f"{name}_z AS (SELECT m.id, m.pass, w.task, sum(w.w * (x.v * (m.keep * {1.0 / (1.0 - rate)!r}))) AS s "
                f"FROM {name}_mask_final m JOIN {name}_xv x ON m.id = x.id AND m.j = x.j "
                f"JOIN {wsel} w ON w.j = m.j GROUP BY m.id, m.pass, w.task)")
        return ",\n".join([xv, mask, zsum,
                           f"{name} AS (SELECT z.id, z.task, z.pass, 1.0 / (1.0 + exp(-(z.s + b.b))) AS p "
                           f"FROM {name}_z z JOIN bias b ON z.task = b.task)"])
    zsum = (f"{name}_z AS (SELECT x.id, 0 AS pass, w.task, sum(w.w * x.v) AS s FROM {name}_xv x "
            f"JOIN {wsel} w ON w.j = x.j GROUP BY x.id, w.task)")
    return ",\n".join([xv, zsum,
                       f"{name} AS (SELECT z.id, z.task, z.pass, z.s + b.b AS z, 1.0 / (1.0 + exp(-(z.s + b.b))) AS p "
                       f"FROM {name}_z z JOIN bias b ON z.task = b.task)"])


SQL_POOL_IDS = "SELECT id FROM roles WHERE role = 'train'"
SQL_TEST_IDS = "SELECT id FROM roles WHERE role = 'test'"
