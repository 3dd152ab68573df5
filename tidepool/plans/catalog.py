"""Registered queries: one per operator of the inventory, each with a DuckDB twin
where the operator is expressible in SQL.

Every query reads the driver tables (or data Spark derives from them) in
full.  Double outputs are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.hashing import sql_hash52
from tidepool.operators import acquisition as acq
from tidepool.operators import selection as sel
from tidepool.operators.scoring import (
    DEFAULT_PASSES, explode_passes, labelled_predictions, pred_mean_var, score_deterministic, score_mc,
)
from tidepool.plans.registry import register, rounded, sql_rounded
from tidepool.plans.setup import (
    MAIN_TASK, SQL_AL_BASE, SQL_POOL_IDS, SQL_TEST_IDS, al_inputs, pool_feats, sql_probs, test_feats,
)

K = DEFAULT_PASSES
TOP_K = 10


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


# ---------------------------------------------------------------------------------
# 2.6 scoring
# ---------------------------------------------------------------------------------

def pool_preds(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    return inp, score_mc(pool_feats(inp), inp.weights, passes=K)


@register("score_mc", sql_rounded(_with(SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K)) +
                                  "\nSELECT id, task, pass, p FROM probs", ["p"]))
def q_score_mc(spark, sf_dir):
    _, preds = pool_preds(spark, sf_dir)
    return rounded(explode_passes(preds).select("id", "task", F.col("pass").cast("long").alias("pass"), "p"))


STRING_KEY = "'k' || CAST(s.id AS VARCHAR)"


@register("score_mc_string_key", sql_rounded(
    _with(SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K, rate=0.2, key=sql_hash52("mask", STRING_KEY))) +
    "\nSELECT 'k' || CAST(id AS VARCHAR) AS id, task, avg(p) AS mean FROM probs GROUP BY id, task", ["mean"]))
def q_score_mc_string_key(spark, sf_dir):
    """Row keys that are strings, and another dropout rate."""
    inp = al_inputs(spark, sf_dir)
    feats = pool_feats(inp).withColumn("id", F.concat(F.lit("k"), F.col("id").cast("string")))
    return rounded(pred_mean_var(score_mc(feats, inp.weights, passes=K, dropout=0.2)).select("id", "task", "mean"))


@register("score_deterministic", sql_rounded(_with(SQL_AL_BASE, sql_probs("probs", SQL_TEST_IDS, 1, dropout=False)) +
                                             "\nSELECT id, task, z, p FROM probs", ["z", "p"]))
def q_score_deterministic(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    return rounded(score_deterministic(test_feats(inp), inp.weights))


@register("pred_mean_var", sql_rounded(_with(SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K)) +
                                       "\nSELECT id, task, avg(p) AS mean, var_pop(p) AS var FROM probs GROUP BY id, task",
                                       ["mean", "var"]))
def q_pred_mean_var(spark, sf_dir):
    _, preds = pool_preds(spark, sf_dir)
    return rounded(pred_mean_var(preds))


@register("labelled_predictions", sql_rounded(_with(SQL_AL_BASE, sql_probs("probs", SQL_TEST_IDS, 1, dropout=False)) +
                                              "\nSELECT c.id, c.task, c.y, p.p FROM test_cells c "
                                              "JOIN probs p ON c.id = p.id AND c.task = p.task WHERE c.y IS NOT NULL",
                                              ["p"]))
def q_labelled_predictions(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    preds = score_deterministic(test_feats(inp), inp.weights).select("id", "task", "p")
    return rounded(labelled_predictions(inp.test_cells, preds).select("id", "task", "y", "p"))


# ---------------------------------------------------------------------------------
# 2.7 acquisition
# ---------------------------------------------------------------------------------

SQL_BALD = ("SELECT id, task, -avg(p) * ln(avg(p) + 1e-10) - avg(-p * ln(p + 1e-10)) AS score "
            "FROM probs GROUP BY id, task")
SQL_GREEDY = "SELECT id, task, avg(p) AS score FROM probs GROUP BY id, task"
SQL_UCB = "SELECT id, task, avg(p) + 2.0 * stddev_pop(p) AS score FROM probs GROUP BY id, task"


def _acq_sql(body: str) -> str:
    return sql_rounded(_with(SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K)) + "\n" + body, ["score"])


@register("acq_bald", _acq_sql(SQL_BALD))
def q_acq_bald(spark, sf_dir):
    _, preds = pool_preds(spark, sf_dir)
    return rounded(acq.bald(preds))


@register("acq_greedy", _acq_sql(SQL_GREEDY))
def q_acq_greedy(spark, sf_dir):
    _, preds = pool_preds(spark, sf_dir)
    return rounded(acq.greedy(preds))


@register("acq_ucb", _acq_sql(SQL_UCB))
def q_acq_ucb(spark, sf_dir):
    _, preds = pool_preds(spark, sf_dir)
    return rounded(acq.ucb(preds))


SQL_EPIG = f"""
pool_m AS (SELECT id, task, avg(p) AS m FROM probs GROUP BY id, task),
targ AS (SELECT id, pass, p FROM tprobs WHERE task = '{MAIN_TASK}'),
targ_m AS (SELECT id, avg(p) AS m FROM targ GROUP BY id),
joint AS (SELECT a.id, a.task, t.id AS tid, sum(a.p * t.p) / {K} AS j
          FROM probs a JOIN targ t ON a.pass = t.pass GROUP BY a.id, a.task, t.id),
terms AS (SELECT j.id, j.task,
                 CASE WHEN j.j > 0 THEN j.j * (ln(j.j) - ln(pm.m * tm.m)) ELSE 0.0 END AS s
          FROM joint j JOIN pool_m pm ON j.id = pm.id AND j.task = pm.task JOIN targ_m tm ON j.tid = tm.id)"""


@register("acq_epig", sql_rounded(_with(SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K),
                                        sql_probs("tprobs", SQL_TEST_IDS, K, tasks_sql=f"SELECT '{MAIN_TASK}'"),
                                        SQL_EPIG) +
                                  "\nSELECT id, task, avg(s) AS score FROM terms GROUP BY id, task", ["score"]))
def q_acq_epig(spark, sf_dir):
    inp, preds = pool_preds(spark, sf_dir)
    targ = score_mc(test_feats(inp), inp.weights.where(F.col("task") == MAIN_TASK), passes=K).select("id", "ps")
    return rounded(acq.epig(preds, targ))


def entry_query(spark, sf_dir):
    """Flagship: K-pass scoring -> BALD -> keep labelled pool cells -> global top-k."""
    inp, preds = pool_preds(spark, sf_dir)
    scores = sel.mask_unlabelled(acq.bald(preds), inp.train_cells)
    return rounded(sel.topk_cells(scores, TOP_K))


# ---------------------------------------------------------------------------------
# 2.1 sources and sinks
# ---------------------------------------------------------------------------------

from tidepool.functions.hashing import sql_hash52  # noqa: E402
from tidepool.operators import reshape as rs  # noqa: E402
from tidepool.session import scratch_path  # noqa: E402
from tidepool.sources import io as sio  # noqa: E402
from tidepool.sources.history import compact_history, read_history  # noqa: E402
from tidepool.sources import testdata as td  # noqa: E402

DOC_WIDE = f"doc_wide AS ({td.SQL_DOC_LABELS_WIDE})"


@register("read_table", "SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels")
def q_read_table(spark, sf_dir):
    t = sio.read_table(spark, f"{sf_dir}/labels.parquet")
    return t.select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))


@register("write_table", _with(DOC_WIDE) + "\nSELECT id, quality, toxic FROM doc_wide")
def q_write_table(spark, sf_dir):
    wide = td.doc_labels_wide(spark, sf_dir)
    path = scratch_path(spark, "doc_labels") + ".tab"
    sio.write_table(wide, path, fmt="tab")
    back = sio.read_table(spark, path, schema="id long, quality double, toxic double")
    return back.select("id", "quality", "toxic")


HIST_N = 5
HIST_ITERS = 3


def _sql_uniform(src: str, n: int, seed, iteration: int) -> str:
    return (f"SELECT id, task, y FROM ({src}) s WHERE y IS NOT NULL "
            f"ORDER BY {sql_hash52(f'{seed}|{iteration}', 'id', 'task')}, id, task LIMIT {n}")


SQL_HISTORY = " UNION ALL ".join(
    f"SELECT CAST(0 AS BIGINT) AS run_id, CAST({i} AS BIGINT) AS iteration, id, task, y FROM "
    f"({_sql_uniform('SELECT * FROM train_cells', HIST_N, 42, i)}) h{i}" for i in range(HIST_ITERS))


@register("append_history", _with(SQL_AL_BASE) + "\n" + SQL_HISTORY)
def q_append_history(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    path = scratch_path(spark, "history")
    for i in range(HIST_ITERS):
        q = acq.uniform(inp.train_cells, HIST_N, seed=42, iteration=i)
        sio.append_history(q.select(F.lit(0).cast("long").alias("run_id"), F.lit(i).cast("long").alias("iteration"),
                                    "id", "task", "y"), path)
    # re-appending an iteration replaces it (idempotent retry), it does not duplicate
    q = acq.uniform(inp.train_cells, HIST_N, seed=42, iteration=HIST_ITERS - 1)
    sio.append_history(q.select(F.lit(0).cast("long").alias("run_id"),
                                F.lit(HIST_ITERS - 1).cast("long").alias("iteration"), "id", "task", "y"), path)
    h = read_history(spark, path)
    return h.select(F.col("run_id").cast("long"), F.col("iteration").cast("long"), "id", "task", "y")


# ---------------------------------------------------------------------------------
# 2.2 assembly and reshaping
# ---------------------------------------------------------------------------------

@register("labels_with_features", _with(DOC_WIDE) +
          "\nSELECT id, quality, toxic FROM doc_wide WHERE id IN (SELECT vec_id FROM embeddings)")
def q_labels_with_features(spark, sf_dir):
    return rs.labels_with_features(td.doc_labels_wide(spark, sf_dir), td.emb_features(spark, sf_dir))


@register("compact_history", _with(SQL_AL_BASE) + "\n" + SQL_HISTORY)
def q_compact_history(spark, sf_dir):
    """A run's history after its first iterations have been merged into one file set."""
    inp = al_inputs(spark, sf_dir)
    path = scratch_path(spark, "compacted")
    for i in range(HIST_ITERS):
        q = acq.uniform(inp.train_cells, HIST_N, seed=42, iteration=i)
        sio.append_history(q.select(F.lit(0).cast("long").alias("run_id"), F.lit(i).cast("long").alias("iteration"),
                                    "id", "task", "y"), path)
    compact_history(spark, path, 0)
    return read_history(spark, path).select("run_id", "iteration", "id", "task", "y")


def _xsum(col="x"):
    return F.aggregate(col, F.lit(0.0), lambda a, v: a + v.cast("double"))


SQL_XSUM = "list_reduce(list_transform(x, lambda e: CAST(e AS DOUBLE)), lambda a, b: a + b)"


@register("read_features", sql_rounded(
    f"SELECT vec_id AS id, len(embedding) AS dim, {SQL_XSUM.replace('x,', 'embedding,')} AS xsum FROM embeddings", ["xsum"]))
def q_read_features(spark, sf_dir):
    """The features written as a wide text file and read back, key and vector per line."""
    path = scratch_path(spark, "wide") + ".csv"
    feats = td.emb_features(spark, sf_dir)
    sio.write_table(rs.unpack_features(feats, 64), path, fmt="csv")
    back = sio.read_features(spark, path, "id")
    return rounded(back.select(F.col("id").cast("long"), F.size("x").cast("long").alias("dim"), _xsum().alias("xsum")))


@register("features_for_labels", sql_rounded(
    f"SELECT vec_id AS id, len(embedding) AS dim, "
    f"{SQL_XSUM.replace('x,', 'embedding,')} AS xsum FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    ["xsum"]))
def q_features_for_labels(spark, sf_dir):
    f = rs.features_for_labels(td.emb_features(spark, sf_dir), td.table(spark, sf_dir, "labels"), label_key="doc_id")
    return rounded(f.select("id", F.size("x").cast("long").alias("dim"), _xsum().alias("xsum")))


@register("dedup_keep_first",
          "SELECT doc_id, md5(text) AS text_key FROM (SELECT doc_id, text, row_number() OVER "
          "(PARTITION BY text ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1")
def q_dedup_keep_first(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("text", "doc_id")
    return rs.dedup_keep_first(d, ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("text_key"))


@register("concat_features",
          "SELECT key_id, src, md5(text) AS text_key FROM (SELECT *, row_number() OVER (PARTITION BY text "
          "ORDER BY src, key_id) AS rn FROM (SELECT doc_id AS key_id, text, 0 AS src FROM documents UNION ALL "
          "SELECT item_id AS key_id, text, 1 AS src FROM benchmark) u) d WHERE rn = 1")
def q_concat_features(spark, sf_dir):
    docs = td.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key_id"), "text")
    bench = td.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("key_id"), "text")
    both = rs.concat_features(docs.withColumn("src", F.lit(0)), bench.withColumn("src", F.lit(1)),
                              key="text", order_col="key_id")
    return both.select("key_id", F.col("src").cast("int"), F.md5("text").alias("text_key"))


EMB_TASKS = td.EMB_TASKS
SQL_EMB_WIDE = ("emb_wide AS (SELECT id, " + ", ".join(f"max(CASE WHEN task = '{t}' THEN y END) AS {t}"
                                                      for t in EMB_TASKS) + " FROM cells GROUP BY id)")
SQL_EMB = f"feats AS ({td.SQL_EMB_FEATURES}),\ncells AS ({td.SQL_EMB_CELLS}),\n{SQL_EMB_WIDE}"


@register("align_features", sql_rounded(_with(SQL_EMB) +
                                        f"\nSELECT w.*, {SQL_XSUM} AS xsum FROM emb_wide w JOIN feats f ON w.id = f.id",
                                        ["xsum"]))
def q_align_features(spark, sf_dir):
    wide = rs.to_wide(td.emb_cells(spark, sf_dir), EMB_TASKS)
    a = rs.align_features(wide, td.emb_features(spark, sf_dir))
    return rounded(a.select("id", *EMB_TASKS, _xsum().alias("xsum")))


@register("select_tasks", _with(SQL_EMB) + "\nSELECT id, t1, t3 FROM emb_wide")
def q_select_tasks(spark, sf_dir):
    return rs.select_tasks(rs.to_wide(td.emb_cells(spark, sf_dir), EMB_TASKS), ["t1", "t3"])


PACK_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("pack_features", sql_rounded(
    "SELECT l_orderkey, l_linenumber, 4 AS n, "
    "list_reduce([CAST(l_quantity AS DOUBLE), l_extendedprice, l_discount, l_tax], lambda a, b: a + b) AS s "
    "FROM lineitem", ["s"]))
def q_pack_features(spark, sf_dir):
    li = td.table(spark, sf_dir, "lineitem")
    p = rs.pack_features(li, PACK_COLS, keep=["l_orderkey", "l_linenumber"])
    return rounded(p.select("l_orderkey", "l_linenumber", F.size("x").alias("n"),
                            F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s")))


@register("to_wide", _with(SQL_EMB) + "\nSELECT * FROM emb_wide")
def q_to_wide(spark, sf_dir):
    return rs.to_wide(td.emb_cells(spark, sf_dir), EMB_TASKS)


@register("to_dataset", _with(DOC_WIDE) +
          "\nSELECT id, CAST((quality IS NOT NULL) AS INTEGER) + CAST((toxic IS NOT NULL) AS INTEGER) AS n_obs, "
          "coalesce(quality, 0.0) + coalesce(toxic, 0.0) AS n_pos FROM doc_wide")
def q_to_dataset(spark, sf_dir):
    ds = rs.to_dataset(td.doc_labels_wide(spark, sf_dir), td.DOC_TASKS)
    return ds.select("id", F.size(F.filter("ys", lambda v: v.isNotNull())).alias("n_obs"),
                     F.aggregate("ys", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("n_pos"))


SQL_DOC_LONG = ("doc_long AS (SELECT id, 'quality' AS task, quality AS y FROM doc_wide WHERE quality IS NOT NULL "
                "UNION ALL SELECT id, 'toxic' AS task, toxic AS y FROM doc_wide WHERE toxic IS NOT NULL)")


@register("melt_labels", _with(DOC_WIDE, SQL_DOC_LONG) + "\nSELECT id, task, y FROM doc_long")
def q_melt_labels(spark, sf_dir):
    return rs.melt_labels(td.doc_labels_wide(spark, sf_dir), td.DOC_TASKS)


@register("merge_cells", _with(DOC_WIDE, SQL_DOC_LONG) +
          "\nSELECT id, sum(CASE WHEN task = 'quality' THEN y END) AS quality, "
          "sum(CASE WHEN task = 'toxic' THEN y END) AS toxic FROM doc_long GROUP BY id")
def q_merge_cells(spark, sf_dir):
    long = rs.melt_labels(td.doc_labels_wide(spark, sf_dir), td.DOC_TASKS)
    partial = long.select("id", *[F.when(F.col("task") == t, F.col("y")).alias(t) for t in td.DOC_TASKS])
    return rs.merge_cells(partial, td.DOC_TASKS)


# ---------------------------------------------------------------------------------
# 2.7 (rest) and 2.8 selection and updates
# ---------------------------------------------------------------------------------

N_QUERY = 25


@register("acq_uniform", _with(SQL_AL_BASE) + "\n" + _sql_uniform("SELECT * FROM train_cells", N_QUERY, 42, 0))
def q_acq_uniform(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    return acq.uniform(inp.train_cells, N_QUERY, seed=42, iteration=0).select("id", "task", "y")


_TASK_LIST = "[" + ", ".join(f"'{t}'" for t in EMB_TASKS) + "]"


@register("acq_random_index", _with(SQL_AL_BASE) +
          f"\nSELECT id, list_element({_TASK_LIST}, CAST({sql_hash52('42|0|task', 'id')} % {len(EMB_TASKS)} AS INTEGER) + 1)"
          f" AS task FROM (SELECT DISTINCT id FROM train_cells) d "
          f"ORDER BY {sql_hash52('42|0', 'id')}, id LIMIT {N_QUERY}")
def q_acq_random_index(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    return acq.random_index(inp.train_cells, EMB_TASKS, N_QUERY, seed=42, iteration=0)


SQL_EPIG_SCORES = [SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K),
                   sql_probs("tprobs", SQL_TEST_IDS, K, tasks_sql=f"SELECT '{MAIN_TASK}'"), SQL_EPIG,
                   "epig AS (SELECT id, task, avg(s) AS score FROM terms GROUP BY id, task)"]


@register("score_range_check", sql_rounded(
    _with(*SQL_EPIG_SCORES) +
    "\nSELECT count(*) AS n, sum(CASE WHEN isnan(score) OR score + 1e-6 < 0 THEN 1 ELSE 0 END) AS n_bad, "
    "min(score) AS min_score, max(score) AS max_score FROM epig", ["min_score", "max_score"]))
def q_score_range_check(spark, sf_dir):
    inp, preds = pool_preds(spark, sf_dir)
    targ = score_mc(test_feats(inp), inp.weights.where(F.col("task") == MAIN_TASK), passes=K).select("id", "ps")
    return rounded(acq.score_range_check(acq.epig(preds, targ)))


SQL_BALD_BASE = [SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K),
                 f"bald AS ({SQL_BALD})",
                 "masked AS (SELECT b.id, b.task, b.score FROM bald b JOIN train_cells c "
                 "ON b.id = c.id AND b.task = c.task WHERE c.y IS NOT NULL)",
                 f"topk AS (SELECT * FROM masked ORDER BY score DESC, id, task LIMIT {TOP_K})",
                 "query AS (SELECT c.id, c.task, c.y FROM train_cells c JOIN topk t ON c.id = t.id AND c.task = t.task)",
                 f"seed_train AS ({_sql_uniform('SELECT * FROM train_cells', 50, 7, 0)})"]


def _bald_state(spark, sf_dir):
    inp, preds = pool_preds(spark, sf_dir)
    masked = sel.mask_unlabelled(acq.bald(preds), inp.train_cells)
    top = sel.topk_cells(masked, TOP_K)
    query = sel.reveal_cells(inp.train_cells, top)
    return inp, masked, top, query


@register("mask_unlabelled", sql_rounded(_with(*SQL_BALD_BASE) + "\nSELECT * FROM masked", ["score"]))
def q_mask_unlabelled(spark, sf_dir):
    return rounded(_bald_state(spark, sf_dir)[1])


@register("topk_cells", sql_rounded(_with(*SQL_BALD_BASE) + "\nSELECT * FROM topk", ["score"]))
def q_topk_cells(spark, sf_dir):
    return rounded(_bald_state(spark, sf_dir)[2])


@register("topk_one_task", sql_rounded(
    _with(*SQL_BALD_BASE) + "\nSELECT * FROM (SELECT id, task, score, row_number() OVER (PARTITION BY task "
    "ORDER BY score DESC, id) AS rank FROM masked) r WHERE rank <= 5", ["score"]))
def q_topk_one_task(spark, sf_dir):
    masked = _bald_state(spark, sf_dir)[1]
    return rounded(sel.topk_one_task(masked, 5).select("id", "task", "score", F.col("rank").cast("long")))


@register("reveal_cells", _with(*SQL_BALD_BASE) + "\nSELECT * FROM query")
def q_reveal_cells(spark, sf_dir):
    return _bald_state(spark, sf_dir)[3]


@register("upsert_train", _with(*SQL_BALD_BASE) +
          "\nSELECT id, task, y FROM seed_train UNION ALL SELECT q.id, q.task, q.y FROM query q "
          "WHERE NOT EXISTS (SELECT 1 FROM seed_train s WHERE s.id = q.id AND s.task = q.task)")
def q_upsert_train(spark, sf_dir):
    inp, _, _, query = _bald_state(spark, sf_dir)
    train = acq.uniform(inp.train_cells, 50, seed=7, iteration=0)
    return sel.upsert_train(train, query)


@register("shrink_pool", _with(*SQL_BALD_BASE) +
          "\nSELECT p.id, p.task, p.y FROM train_cells p WHERE NOT EXISTS "
          "(SELECT 1 FROM query q WHERE q.id = p.id AND q.task = p.task)")
def q_shrink_pool(spark, sf_dir):
    inp, _, _, query = _bald_state(spark, sf_dir)
    return sel.shrink_pool(inp.train_cells, query)


AUX = ["t1", "t2"]
SQL_POOL_WIDE = ("pool_wide AS (SELECT id, " + ", ".join(
    f"max(CASE WHEN task = '{t}' AND NOT EXISTS (SELECT 1 FROM query q WHERE q.id = c.id AND q.task = c.task) "
    f"THEN y END) AS {t}" for t in EMB_TASKS) + " FROM train_cells c GROUP BY id)")


@register("shrink_pool_single", _with(*SQL_BALD_BASE, SQL_POOL_WIDE) +
          "\nSELECT * FROM pool_wide WHERE " + " AND ".join(f"{t} IS NOT NULL" for t in AUX))
def q_shrink_pool_single(spark, sf_dir):
    inp, _, _, query = _bald_state(spark, sf_dir)
    wide = rs.to_wide(inp.train_cells, EMB_TASKS)
    return sel.shrink_pool_single(wide, query, EMB_TASKS, AUX)


SQL_STEP_BASE = [SQL_AL_BASE, sql_probs("probs", SQL_POOL_IDS, K),
                 f"bald AS ({SQL_BALD})",
                 f"seed_train AS ({_sql_uniform('SELECT * FROM train_cells', 50, 7, 0)})",
                 "pool AS (SELECT p.id, p.task, p.y FROM train_cells p WHERE NOT EXISTS "
                 "(SELECT 1 FROM seed_train s WHERE s.id = p.id AND s.task = p.task))",
                 f"query AS (SELECT p.id, p.task, p.y FROM bald b JOIN pool p ON b.id = p.id AND b.task = p.task "
                 f"WHERE p.y IS NOT NULL ORDER BY b.score DESC, b.id, b.task LIMIT {TOP_K})",
                 "new_train AS (SELECT id, task, y FROM seed_train UNION ALL SELECT q.id, q.task, q.y "
                 "FROM query q WHERE NOT EXISTS (SELECT 1 FROM seed_train s WHERE s.id = q.id AND s.task = q.task))",
                 "new_pool AS (SELECT p.* FROM pool p WHERE NOT EXISTS "
                 "(SELECT 1 FROM query q WHERE q.id = p.id AND q.task = p.task))"]


def _step_state(spark, sf_dir):
    from tidepool.operators.sampling import remainder_pool
    inp, preds = pool_preds(spark, sf_dir)
    train = acq.uniform(inp.train_cells, 50, seed=7, iteration=0)
    pool = remainder_pool(inp.train_cells, train)
    top = sel.topk_cells(sel.mask_unlabelled(acq.bald(preds), pool), TOP_K)
    query = sel.reveal_cells(pool, top)
    return train, pool, query


@register("conservation_check", _with(*SQL_STEP_BASE) +
          "\nSELECT role, count(*) AS n FROM (SELECT 'train' AS role, y FROM seed_train UNION ALL "
          "SELECT 'pool', y FROM pool UNION ALL SELECT 'query', y FROM query UNION ALL "
          "SELECT 'new_train', y FROM new_train UNION ALL SELECT 'new_pool', y FROM new_pool) u "
          "WHERE y IS NOT NULL GROUP BY role")
def q_conservation_check(spark, sf_dir):
    train, pool, query = _step_state(spark, sf_dir)
    new_train = sel.upsert_train(train, query)
    new_pool = sel.shrink_pool(pool, query)
    return sel.conservation_check(train, pool, query, new_train, new_pool)


# ---------------------------------------------------------------------------------
# 2.9 evaluation and calibration
# ---------------------------------------------------------------------------------

from tidepool.operators import metrics as mt  # noqa: E402


def metric_scores(spark, sf_dir):
    """Two score kinds per line status: 'disc' (11 values, many ties) and 'price' (near-continuous);
    a task without positives and one with NaN scores, from the labels."""
    li = td.table(spark, sf_dir, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("double").alias("y")
    disc = li.select(F.concat(F.col("l_linestatus"), F.lit("/disc")).alias("task"), y,
                     (F.col("l_discount") * 10).alias("p"))
    price = li.select(F.concat(F.col("l_linestatus"), F.lit("/price")).alias("task"), y,
                      ((F.col("l_extendedprice") % 1000) / 1000).alias("p"))
    lab = td.table(spark, sf_dir, "labels")
    p = (F.col("doc_id") % 100) / 100
    negative = lab.select(F.lit("labels/negative").alias("task"), F.lit(0.0).alias("y"), p.alias("p"))
    nan = lab.select(F.lit("labels/nan").alias("task"), F.col("toxic").cast("double").alias("y"),
                     F.when(F.col("quality") == 0, F.lit(float("nan"))).otherwise(p).alias("p"))
    return disc.unionByName(price).unionByName(negative).unionByName(nan)


SQL_METRIC_SCORES = """metric_scores AS (
SELECT 'labels/negative' AS task, 0.0 AS y, (doc_id % 100) / 100 AS p FROM labels UNION ALL
SELECT 'labels/nan', CAST(toxic AS DOUBLE), CASE WHEN quality = 0 THEN CAST('nan' AS DOUBLE) ELSE (doc_id % 100) / 100 END
FROM labels UNION ALL
SELECT l_linestatus || '/disc' AS task, CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) AS y, l_discount * 10 AS p
FROM lineitem UNION ALL
SELECT l_linestatus || '/price' AS task, CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) AS y,
       (l_extendedprice % 1000) / 1000 AS p FROM lineitem)"""


def sql_curve(src: str) -> str:
    return f"""
base_all AS (SELECT task, p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n_neg
             FROM {src} WHERE y IN (0, 1) AND p IS NOT NULL GROUP BY task, p),
nan_tasks AS (SELECT DISTINCT task FROM base_all WHERE isnan(p)),
base AS (SELECT * FROM base_all WHERE task NOT IN (SELECT task FROM nan_tasks)),
curve AS (SELECT task, p, n_pos, n_neg,
                 sum(n_pos) OVER (PARTITION BY task ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_n_pos,
                 sum(n_neg) OVER (PARTITION BY task ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_n_neg,
                 sum(n_pos) OVER (PARTITION BY task) AS tot_pos, sum(n_neg) OVER (PARTITION BY task) AS tot_neg FROM base
          UNION ALL SELECT task, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nan_tasks),
pts AS (SELECT *,
          CAST(cum_n_pos AS DOUBLE) / NULLIF(tot_pos, 0) AS tpr, CAST(cum_n_neg AS DOUBLE) / NULLIF(tot_neg, 0) AS fpr,
          CAST(cum_n_pos - n_pos AS DOUBLE) / NULLIF(tot_pos, 0) AS tpr_prev,
          CAST(cum_n_neg - n_neg AS DOUBLE) / NULLIF(tot_neg, 0) AS fpr_prev,
          CAST(cum_n_pos AS DOUBLE) / NULLIF(cum_n_pos + cum_n_neg, 0) AS precision,
          CASE WHEN cum_n_pos - n_pos + cum_n_neg - n_neg = 0 THEN 1.0
               ELSE CAST(cum_n_pos - n_pos AS DOUBLE) / (cum_n_pos - n_pos + cum_n_neg - n_neg) END AS precision_prev,
          CAST(cum_n_pos AS DOUBLE) / NULLIF(tot_pos, 0) AS recall,
          CAST(cum_n_pos - n_pos AS DOUBLE) / NULLIF(tot_pos, 0) AS recall_prev
        FROM curve),
pr_pts AS (SELECT * FROM pts WHERE cum_n_pos - n_pos < tot_pos),
best AS (SELECT task, bacc, tpr, fpr, p FROM (
           SELECT task, (tpr + (1.0 - fpr)) / 2 AS bacc, tpr, fpr, p,
                  row_number() OVER (PARTITION BY task ORDER BY (tpr + (1.0 - fpr)) / 2 DESC, p DESC) AS rn
           FROM pts) b WHERE rn = 1),
sens_spec AS (SELECT task,
          CASE WHEN bacc IS NULL THEN NULL WHEN bacc > 0.5 THEN bacc ELSE 0.5 END AS balanced_acc,
          CASE WHEN bacc IS NULL THEN NULL WHEN bacc > 0.5 THEN tpr ELSE 0.0 END AS sensitivity,
          CASE WHEN bacc IS NULL THEN NULL WHEN bacc > 0.5 THEN 1.0 - fpr ELSE 1.0 END AS specificity,
          CASE WHEN bacc > 0.5 THEN p END AS threshold FROM best),
roc_auc AS (SELECT task, sum((fpr - fpr_prev) * (tpr + tpr_prev) / 2) AS roc_auc FROM pts GROUP BY task),
aupr AS (SELECT task, sum((recall - recall_prev) * (precision + precision_prev) / 2)
                FILTER (cum_n_pos - n_pos < tot_pos) AS AUPR FROM pts GROUP BY task),
ap AS (SELECT task, sum((recall - recall_prev) * precision) FILTER (cum_n_pos - n_pos < tot_pos) AS average_precision
       FROM pts GROUP BY task),
f1 AS (SELECT task, max(CAST(2 * cum_n_pos AS DOUBLE) / NULLIF(cum_n_pos + cum_n_neg + tot_pos, 0))
              FILTER (cum_n_pos - n_pos < tot_pos) AS f1_score FROM pts GROUP BY task),
ece_bins AS (SELECT task, {' + '.join(f"CASE WHEN p >= CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in mt.ECE_EDGES)} AS bin,
                    n_pos, n_neg, p FROM curve),
ece_b AS (SELECT task, bin, sum(n_pos + n_neg) AS nb, sum(n_pos) AS pos, sum(p * (n_pos + n_neg)) AS psum
          FROM ece_bins GROUP BY task, bin),
ece AS (SELECT b.task, sum(CAST(b.nb AS DOUBLE) / t.n * abs(CAST(b.pos AS DOUBLE) / b.nb - b.psum / b.nb)) AS ECE
        FROM ece_b b JOIN (SELECT task, sum(nb) AS n FROM ece_b GROUP BY task) t ON b.task = t.task GROUP BY b.task),
ace_q AS (SELECT t.task, q.qi, CAST(t.n - 1 AS DOUBLE) * q.q AS pos FROM
          (SELECT DISTINCT task, tot_pos + tot_neg AS n FROM curve) t,
          (SELECT unnest(range(9)) AS qi, unnest([{', '.join(f"CAST('{q!r}' AS DOUBLE)" for q in mt.ACE_QUANTILES)}]) AS q) q),
ace_r AS (SELECT task, qi, pos, floor(pos) AS lo, ceil(pos) AS hi, pos - floor(pos) AS d FROM ace_q),
ace_rows AS (SELECT task, p, tot_pos + tot_neg - cum_n_pos - cum_n_neg AS asc0, n_pos + n_neg AS c FROM curve),
ace_v AS (SELECT r.task, r.qi, r.d,
                 max(CASE WHEN r.lo >= a.asc0 AND r.lo < a.asc0 + a.c THEN a.p END) AS vlo,
                 max(CASE WHEN r.hi >= a.asc0 AND r.hi < a.asc0 + a.c THEN a.p END) AS vhi
          FROM ace_r r JOIN ace_rows a ON r.task = a.task GROUP BY r.task, r.qi, r.d),
ace_e AS (SELECT task, qi, CASE WHEN d >= 0.5 THEN vhi - (vhi - vlo) * (1.0 - d) ELSE vlo + (vhi - vlo) * d END AS e
          FROM ace_v),
ace_bins AS (SELECT c.task, c.p, c.n_pos, c.n_neg, (SELECT count(*) FROM ace_e e WHERE e.task = c.task AND c.p >= e.e) AS bin
             FROM curve c),
ace_b AS (SELECT task, bin, sum(n_pos + n_neg) AS nb, sum(n_pos) AS pos, sum(p * (n_pos + n_neg)) AS psum
          FROM ace_bins GROUP BY task, bin),
ace AS (SELECT b.task, sum(CAST(b.nb AS DOUBLE) / t.n * abs(CAST(b.pos AS DOUBLE) / b.nb - b.psum / b.nb)) AS ACE
        FROM ace_b b JOIN (SELECT task, sum(nb) AS n FROM ace_b GROUP BY task) t ON b.task = t.task GROUP BY b.task),
mtab AS (SELECT s.task, s.balanced_acc, f.f1_score, s.specificity, s.sensitivity, r.roc_auc, a.AUPR,
                ap.average_precision, e.ECE, c.ACE
         FROM sens_spec s LEFT JOIN f1 f ON s.task = f.task LEFT JOIN roc_auc r ON s.task = r.task
         LEFT JOIN aupr a ON s.task = a.task LEFT JOIN ap ON s.task = ap.task LEFT JOIN ece e ON s.task = e.task
         LEFT JOIN ace c ON s.task = c.task)"""


SQL_M = _with(SQL_METRIC_SCORES, sql_curve("metric_scores")) + "\n"


def _curve(spark, sf_dir):
    return mt.threshold_curve(metric_scores(spark, sf_dir))


@register("roc_curve", sql_rounded(SQL_M + "SELECT task, p AS threshold, fpr, tpr FROM pts UNION ALL "
                                   "SELECT DISTINCT task, NULL, CASE WHEN tot_neg > 0 THEN 0.0 END, "
                                   "CASE WHEN tot_pos > 0 THEN 0.0 END FROM curve", ["threshold", "fpr", "tpr"]))
def q_roc_curve(spark, sf_dir):
    return rounded(mt.roc_curve(_curve(spark, sf_dir)))


@register("roc_auc", sql_rounded(SQL_M + "SELECT * FROM roc_auc", ["roc_auc"]))
def q_roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(_curve(spark, sf_dir)))


@register("balanced_acc", sql_rounded(SQL_M + "SELECT task, balanced_acc FROM sens_spec", ["balanced_acc"]))
def q_balanced_acc(spark, sf_dir):
    return rounded(mt.balanced_acc(_curve(spark, sf_dir)))


@register("sens_spec", sql_rounded(SQL_M + "SELECT * FROM sens_spec",
                                   ["balanced_acc", "sensitivity", "specificity", "threshold"]))
def q_sens_spec(spark, sf_dir):
    return rounded(mt.sens_spec(_curve(spark, sf_dir)))


@register("pr_curve", sql_rounded(SQL_M + "SELECT task, p AS threshold, precision, recall FROM pr_pts UNION ALL "
                                  "SELECT DISTINCT task, NULL, 1.0, 0.0 FROM curve WHERE tot_pos > 0",
                                  ["threshold", "precision", "recall"]))
def q_pr_curve(spark, sf_dir):
    return rounded(mt.pr_curve(_curve(spark, sf_dir)))


@register("aupr", sql_rounded(SQL_M + "SELECT * FROM aupr", ["AUPR"]))
def q_aupr(spark, sf_dir):
    return rounded(mt.aupr(_curve(spark, sf_dir)))


@register("best_f1", sql_rounded(SQL_M + "SELECT * FROM f1", ["f1_score"]))
def q_best_f1(spark, sf_dir):
    return rounded(mt.best_f1(_curve(spark, sf_dir)))


@register("f1_at_threshold", sql_rounded(
    SQL_M + "SELECT t.task, CASE WHEN t.tot_pos > 0 THEN coalesce(x.f1, 0.0) END AS f1_at_threshold FROM "
    "(SELECT DISTINCT task, tot_pos FROM curve) t LEFT JOIN (SELECT c.task, CAST(2 * c.cum_n_pos AS DOUBLE) / "
    "NULLIF(c.cum_n_pos + c.cum_n_neg + c.tot_pos, 0) AS f1 FROM curve c JOIN sens_spec s ON c.task = s.task "
    "AND c.p = s.threshold) x ON t.task = x.task", ["f1_at_threshold"]))
def q_f1_at_threshold(spark, sf_dir):
    return rounded(mt.f1_at_threshold(_curve(spark, sf_dir)))


@register("average_precision", sql_rounded(SQL_M + "SELECT * FROM ap", ["average_precision"]))
def q_average_precision(spark, sf_dir):
    return rounded(mt.average_precision(_curve(spark, sf_dir)))


@register("ece", sql_rounded(SQL_M + "SELECT * FROM ece", ["ECE"]))
def q_ece(spark, sf_dir):
    return rounded(mt.ece(mt.score_rows(metric_scores(spark, sf_dir))))


@register("ace", sql_rounded(SQL_M + "SELECT * FROM ace", ["ACE"]))
def q_ace(spark, sf_dir):
    return rounded(mt.ace(_curve(spark, sf_dir)))


@register("nanmean_metrics", sql_rounded(SQL_M + "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in mt.METRIC_COLUMNS)
                                         + " FROM mtab", mt.METRIC_COLUMNS))
def q_nanmean_metrics(spark, sf_dir):
    return rounded(mt.nanmean_metrics(mt.metrics_table(_curve(spark, sf_dir))))


SQL_REPORT_SCORES = ("report_scores AS (SELECT c.task, c.y, p.p FROM test_cells c JOIN probs p "
                     "ON c.id = p.id AND c.task = p.task)")


@register("metrics_report", sql_rounded(
    _with(SQL_AL_BASE, sql_probs("probs", SQL_TEST_IDS, 1, dropout=False), SQL_REPORT_SCORES,
          sql_curve("report_scores")) +
    "\nSELECT CAST(0 AS BIGINT) AS iteration, task AS Tasks, " + ", ".join(mt.METRIC_COLUMNS) + " FROM mtab "
    "UNION ALL SELECT 0, 'mean', " + ", ".join(f"avg({c})" for c in mt.METRIC_COLUMNS) + " FROM mtab",
    mt.METRIC_COLUMNS))
def q_metrics_report(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    preds = score_deterministic(test_feats(inp), inp.weights).select("id", "task", "p")
    scored = inp.test_cells.join(preds, ["id", "task"])
    return rounded(mt.metrics_report(mt.threshold_curve(scored), iteration=0))


# ---------------------------------------------------------------------------------
# 2.10 losses and label weights
# ---------------------------------------------------------------------------------

from tidepool.operators import losses as ls  # noqa: E402

ALPHA, BETA, GAMMA, FOCAL_ALPHA = 0.5, 0.3, 2.0, 0.25


def _loss_inputs(spark, sf_dir):
    sc = td.lineitem_scores(spark, sf_dir).select("task", "y", "z")
    tw = ls.target_weights(sc)
    tasks = sc.select("task").distinct()
    return sc, tw, ls.pos_weights(tw, tasks, ALPHA), ls.class_weights(tw, tasks, BETA)


def _sp(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1 + exp(-abs({x}))))"


def _bce(z="z", y="y", pw="1.0") -> str:
    return f"({pw} * {y} * {_sp(f'(-{z})')} + (1.0 - {y}) * {_sp(z)})"


SQL_LOSS_BASE = _with(
    f"ls AS (SELECT task, y, z FROM ({td.SQL_LINEITEM_SCORES}) s WHERE y IN (0, 1))",
    "tw_r AS (SELECT task, sum(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) / "
    "NULLIF(sum(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 0) AS r FROM ls GROUP BY task)",
    "tw AS (SELECT task, r / avg(r) OVER () AS w FROM tw_r)",
    f"pw AS (SELECT task, {ALPHA} * w + {1.0 - ALPHA} AS w FROM tw)",
    f"cw AS (SELECT task, {BETA} * w + {1.0 - BETA} AS w FROM tw)",
    "lw AS (SELECT ls.*, pw.w AS pw, cw.w AS cw, 1.0 / (1.0 + exp(-z)) AS p FROM ls "
    "JOIN pw ON ls.task = pw.task JOIN cw ON ls.task = cw.task)") + "\n"


def _sql_rollup(expr: str, name: str, den: str = "1.0") -> str:
    return (f"SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE task END AS task, "
            f"sum({expr}) / NULLIF(sum({den}), 0) AS {name} FROM lw GROUP BY ROLLUP (task)")


@register("target_weights", sql_rounded(SQL_LOSS_BASE + "SELECT * FROM tw", ["w"]))
def q_target_weights(spark, sf_dir):
    return rounded(_loss_inputs(spark, sf_dir)[1])


@register("pos_weights", sql_rounded(SQL_LOSS_BASE + "SELECT * FROM pw", ["w"]))
def q_pos_weights(spark, sf_dir):
    return rounded(_loss_inputs(spark, sf_dir)[2])


@register("class_weights", sql_rounded(SQL_LOSS_BASE + "SELECT * FROM cw", ["w"]))
def q_class_weights(spark, sf_dir):
    return rounded(_loss_inputs(spark, sf_dir)[3])


@register("masked_bce", sql_rounded(SQL_LOSS_BASE + _sql_rollup(_bce(), "bce"), ["bce"]))
def q_masked_bce(spark, sf_dir):
    return rounded(ls.masked_bce(_loss_inputs(spark, sf_dir)[0]))


@register("weighted_bce", sql_rounded(SQL_LOSS_BASE + _sql_rollup("cw * " + _bce(pw="pw"), "weighted_bce"),
                                      ["weighted_bce"]))
def q_weighted_bce(spark, sf_dir):
    sc, _, pw, cw = _loss_inputs(spark, sf_dir)
    return rounded(ls.weighted_bce(sc, pw, cw))


@register("focal_loss", sql_rounded(SQL_LOSS_BASE + _sql_rollup(
    f"(-pw * pow(1.0 - p, {GAMMA}) * y * ln(greatest(p, 1e-8)) - pow(p, {GAMMA}) * (1.0 - y) * "
    f"ln(greatest(1.0 - p, 1e-8)))", "focal_loss"), ["focal_loss"]))
def q_focal_loss(spark, sf_dir):
    sc, _, pw, _ = _loss_inputs(spark, sf_dir)
    return rounded(ls.focal_loss(sc, pw, GAMMA))


@register("focal_loss_v2", sql_rounded(SQL_LOSS_BASE + _sql_rollup(
    f"(({FOCAL_ALPHA} * y + {1.0 - FOCAL_ALPHA} * (1.0 - y)) * {_bce()} * "
    f"pow(1.0 - (p * y + (1.0 - p) * (1.0 - y)), {GAMMA}))", "focal_loss_v2"), ["focal_loss_v2"]))
def q_focal_loss_v2(spark, sf_dir):
    return rounded(ls.focal_loss_v2(_loss_inputs(spark, sf_dir)[0], GAMMA, FOCAL_ALPHA))


@register("pos_neg_loss", sql_rounded(
    SQL_LOSS_BASE + "SELECT task, pos_loss, neg_loss, sqrt(pos_loss * neg_loss) AS gm_loss FROM ("
    f"SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE task END AS task, "
    f"sum(CASE WHEN y = 1 THEN {_bce()} END) / NULLIF(sum(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 0) AS pos_loss, "
    f"sum(CASE WHEN y = 0 THEN {_bce()} END) / NULLIF(sum(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END), 0) AS neg_loss "
    "FROM lw GROUP BY ROLLUP (task)) r", ["pos_loss", "neg_loss", "gm_loss"]))
def q_pos_neg_loss(spark, sf_dir):
    return rounded(ls.pos_neg_loss(_loss_inputs(spark, sf_dir)[0]))


# ---------------------------------------------------------------------------------
# 2.4 splits and folds, 2.5 seed sets
# ---------------------------------------------------------------------------------

from tidepool.operators import sampling as smp  # noqa: E402
from tidepool.operators import split as sp  # noqa: E402


@register("split_random", _with(SQL_AL_BASE) + "\nSELECT id, role FROM roles")
def q_split_random(spark, sf_dir):
    return sp.split_random(td.emb_features(spark, sf_dir).select("id"), 0.8, 42)


def sql_systematic(source: str, order: str, frac: float, first: str = "train", second: str = "test") -> str:
    """Role per row of ``source`` in the given order: taken where ``floor(frac * place)`` rises."""
    return (f"SELECT id, CASE WHEN floor({frac} * g) > floor({frac} * (g - 1)) THEN '{first}' ELSE '{second}' END AS role "
            f"FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS g FROM ({source}) q) p")


@register("split_stratified", sql_systematic(
    f"SELECT vec_id AS id, label, {sql_hash52(42, 'vec_id')} AS h FROM embeddings", "label, h, id", 0.8))
def q_split_stratified(spark, sf_dir):
    e = td.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return sp.split_stratified(e, ["label"], 0.8, 42).select("id", "role")


def sql_label_strata(wide: str, tasks: list[str], seed) -> str:
    """CTEs ``cells``, ``ranks`` (rarest task first) and ``strata(id, sig, own, h)`` of a wide label table."""
    cells = " UNION ALL ".join(f"SELECT id, '{t}' AS task, {t} AS y FROM {wide}" for t in tasks)
    return f"""cells AS MATERIALIZED ({cells}),
ranks AS MATERIALIZED (SELECT task, row_number() OVER (ORDER BY n, task) - 1 AS r FROM (
  SELECT task, count(*) FILTER (WHERE y = 1) AS n FROM cells GROUP BY task) c),
strata AS MATERIALIZED (SELECT id, {sql_hash52(seed, 'id')} AS h,
  string_agg(CASE WHEN y = 1 THEN '0' ELSE '1' END, '' ORDER BY r) || '|' ||
  string_agg(CASE WHEN y IS NULL THEN '1' ELSE '0' END, '' ORDER BY r) AS sig,
  coalesce(min(CASE WHEN y = 1 THEN r END), {len(tasks)}) AS own
  FROM cells JOIN ranks USING (task) GROUP BY id)"""


DOC_MARKS_CTE = f"doc_marks AS MATERIALIZED ({td.SQL_DOC_MARKS_WIDE})"


@register("split_multilabel", _with(DOC_MARKS_CTE, sql_label_strata("doc_marks", td.MARK_TASKS, 42)) + "\n" +
          sql_systematic("SELECT id, sig, h FROM strata", "sig, h, id", 0.85, "pool", "val"))
def q_split_multilabel(spark, sf_dir):
    """Pool / validation split over twelve sparse tasks."""
    wide = td.doc_marks_wide(spark, sf_dir)
    return sp.split_multilabel(wide, td.MARK_TASKS, 0.85, 42, roles=("pool", "val")).select("id", "role")


def sql_group_split(source_ctes: str, group: str) -> str:
    """Biggest-first group split of ``src(doc_id, <group>)``, which ``source_ctes`` end with."""
    return f"""WITH RECURSIVE
{source_ctes},
g AS (SELECT {group} AS grp, count(*) AS sz FROM src GROUP BY {group}),
hist AS (SELECT sz, count(*) AS m, row_number() OVER (ORDER BY sz DESC) AS i FROM g GROUP BY sz),
tot AS (SELECT 0.8 * count(*) AS cutoff FROM src),
fill(i, filled, take) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT h.i,
         f.filled + h.sz * CASE WHEN t.cutoff - f.filled >= h.sz
                                THEN least(h.m, CAST(floor((t.cutoff - f.filled) / h.sz) AS BIGINT)) ELSE 0 END,
         CASE WHEN t.cutoff - f.filled >= h.sz
              THEN least(h.m, CAST(floor((t.cutoff - f.filled) / h.sz) AS BIGINT)) ELSE 0 END
  FROM fill f JOIN hist h ON h.i = f.i + 1 CROSS JOIN tot t),
gr AS (SELECT grp, sz, row_number() OVER (PARTITION BY sz ORDER BY {sql_hash52(42, 'grp')}, grp) AS rn FROM g),
dec AS (SELECT gr.grp, CASE WHEN gr.rn <= f.take THEN 'train' ELSE 'test' END AS role
        FROM gr JOIN hist h ON gr.sz = h.sz JOIN fill f ON f.i = h.i)
SELECT d.doc_id, d.{group}, dec.role FROM src d JOIN dec ON d.{group} IS NOT DISTINCT FROM dec.grp"""


@register("split_by_group", sql_group_split(
    "src AS (SELECT doc_id, NULLIF(source, 'src0') AS source FROM documents)", "source"))
def q_split_by_group(spark, sf_dir):
    """Groups are the sources; src0 is made NULL, which is a group like any other."""
    d = td.table(spark, sf_dir, "documents").select("doc_id", F.expr("nullif(source, 'src0')").alias("source"))
    return sp.split_by_group(d, "source", 0.8, 42).select("doc_id", "source", "role")


@register("split_existing", _with(DOC_WIDE) +
          "\nSELECT id, quality, toxic, 'train' AS role FROM doc_wide WHERE id IN (SELECT vec_id FROM embeddings) "
          "AND id NOT IN (SELECT doc_id FROM labels) "
          "UNION ALL SELECT doc_id, CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE), 'test' FROM labels "
          "WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def q_split_existing(spark, sf_dir):
    """Two inputs: documents without an entry in ``labels``, and the rows of ``labels``."""
    feats = td.emb_features(spark, sf_dir)
    lab = td.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double"),
                                                   F.col("toxic").cast("double"))
    rest = td.doc_labels_wide(spark, sf_dir).join(lab.select("id"), "id", "left_anti")
    train = rs.dedup_keep_first(rs.labels_with_features(rest, feats), ["id"], ["id"])
    test = rs.dedup_keep_first(rs.labels_with_features(lab, feats), ["id"], ["id"])
    return sp.split_existing(train, test)


SQL_EMB_T0 = (f"emb_t0 AS (SELECT id, y AS t0, {sql_hash52(42, 'id')} AS h FROM ({td.SQL_EMB_CELLS}) c "
              f"WHERE task = 't0')")


@register("kfold_stratified", _with(SQL_EMB_T0) +
          "\nSELECT id, (row_number() OVER (PARTITION BY coalesce(t0, 0) ORDER BY h, id) - 1) % 5 AS fold FROM emb_t0")
def q_kfold_stratified(spark, sf_dir):
    wide = rs.to_wide(td.emb_cells(spark, sf_dir), ["t0"])
    return sp.kfold_stratified(wide, "t0", 5, 42).select("id", "fold")


def sql_iterative_folds(wide: str, tasks: list[str], k: int, seed) -> str:
    """CTEs up to ``dealt(id, fold)``: round by round, the rows of one task go to the lowest free slots.

    A slot is (positives the fold would then have, the fold's place in the round's order).
    """
    out = [sql_label_strata(wide, tasks, seed),
           f"own AS MATERIALIZED (SELECT id, own, row_number() OVER (PARTITION BY own ORDER BY sig, h, id) AS i FROM strata),\n"
           f"folds AS (SELECT range AS fold FROM range({k}))"]
    done = "SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS fold WHERE false"
    for r in range(len(tasks) + 1):
        out.append(f"done{r} AS MATERIALIZED ({done})")
        size = f"(SELECT count(*) FROM done{r} d WHERE d.fold = f.fold)"
        have = size if r == len(tasks) else (
            f"(SELECT count(*) FROM done{r} d JOIN cells c ON c.id = d.id AND c.y = 1 "
            f"JOIN ranks q ON q.task = c.task AND q.r = {r} WHERE d.fold = f.fold)")
        out.append(f"have{r} AS MATERIALIZED (SELECT fold, have, row_number() OVER (ORDER BY have, size, fold) AS turn "
                   f"FROM (SELECT f.fold, {have} AS have, {size} AS size FROM folds f) x)")
        out.append(f"slot{r} AS MATERIALIZED (SELECT fold, row_number() OVER (ORDER BY have + j, turn) AS i FROM have{r}, "
                   f"(SELECT unnest(range(1, 1 + (SELECT count(*) FROM own WHERE own = {r}))) AS j) n)")
        done = f"SELECT * FROM done{r} UNION ALL SELECT o.id, s.fold FROM own o JOIN slot{r} s ON s.i = o.i WHERE o.own = {r}"
    out.append(f"dealt AS ({done})")
    return ",\n".join(out)


@register("kfold_multilabel", _with(DOC_WIDE, sql_iterative_folds("doc_wide", td.DOC_TASKS, 5, 42)) +
          "\nSELECT id, fold FROM dealt")
def q_kfold_multilabel(spark, sf_dir):
    return sp.kfold_multilabel(td.doc_labels_wide(spark, sf_dir), td.DOC_TASKS, 5, 42).select("id", "fold")


@register("kfold_multilabel_sparse", _with(DOC_MARKS_CTE, sql_iterative_folds("doc_marks", td.MARK_TASKS, 5, 42)) +
          "\nSELECT id, fold FROM dealt")
def q_kfold_multilabel_sparse(spark, sf_dir):
    """Iterative stratification over twelve sparse tasks."""
    return sp.kfold_multilabel(td.doc_marks_wide(spark, sf_dir), td.MARK_TASKS, 5, 42).select("id", "fold")


@register("fold_guard", _with(SQL_EMB_T0, f"cells AS ({td.SQL_EMB_CELLS})") +
          "\nSELECT f.fold, c.task, coalesce(sum(c.y), 0.0) AS n_pos FROM (SELECT id, (row_number() OVER "
          "(PARTITION BY coalesce(t0, 0) ORDER BY h, id) - 1) % 5 AS fold FROM emb_t0) f "
          "JOIN cells c ON f.id = c.id GROUP BY f.fold, c.task")
def q_fold_guard(spark, sf_dir):
    cells = td.emb_cells(spark, sf_dir)
    folds = sp.kfold_stratified(rs.to_wide(cells, ["t0"]), "t0", 5, 42).select("id", "fold")
    return sp.fold_guard(folds.join(cells, "id"), 5)


SEED = 3
N_SEED = 20
N_ACTIVE = 10  # all-negative documents are rare: 6 at the smallest scale


def _sql_draw(src: str, part: str, per: int, seed: int | None = None) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT s.*, row_number() OVER (PARTITION BY {part} ORDER BY "
            f"{sql_hash52(SEED if seed is None else seed, 'id')}, id) AS rn FROM ({src}) s) d WHERE rn <= {per}")


@register("seed_set_balanced", _with(SQL_AL_BASE) + "\n" + _sql_draw(
    f"SELECT id, task, y FROM train_cells WHERE task = '{MAIN_TASK}' AND y IS NOT NULL", "y", N_SEED // 2))
def q_seed_set_balanced(spark, sf_dir):
    return smp.seed_set_balanced(al_inputs(spark, sf_dir).train_cells, MAIN_TASK, N_SEED, SEED)


AUX_TASKS = EMB_TASKS[1:]


@register("seed_set_aux", _with(SQL_AL_BASE) + "\n" + _sql_draw(
    "SELECT id, task, y FROM train_cells WHERE task IN (" + ", ".join(f"'{t}'" for t in AUX_TASKS) +
    ") AND y IS NOT NULL", "task, y", 10 // 2))
def q_seed_set_aux(spark, sf_dir):
    return smp.seed_set_aux(al_inputs(spark, sf_dir).train_cells, AUX_TASKS, 10, SEED)


SQL_ACTIVITY = (f"act AS (SELECT id, CASE WHEN max(y) = 1 THEN 'active' WHEN max(y) = 0 AND count(y) = "
                f"{len(td.DOC_TASKS)} THEN 'inactive' END AS cls FROM doc_long GROUP BY id)")


def _doc_long(spark, sf_dir):
    return rs.melt_labels(td.doc_labels_wide(spark, sf_dir), td.DOC_TASKS)


@register("seed_set_any_active", _with(DOC_WIDE, SQL_DOC_LONG, SQL_ACTIVITY) + "\n" + _sql_draw(
    "SELECT id, cls FROM act WHERE cls IS NOT NULL", "cls", N_ACTIVE // 2))
def q_seed_set_any_active(spark, sf_dir):
    return smp.seed_set_any_active(_doc_long(spark, sf_dir), len(td.DOC_TASKS), N_ACTIVE, SEED)


@register("remainder_pool", _with(DOC_WIDE, SQL_DOC_LONG, SQL_ACTIVITY,
                                  "seed AS (" + _sql_draw("SELECT id, cls FROM act WHERE cls IS NOT NULL", "cls",
                                                          N_ACTIVE // 2) + ")") +
          "\nSELECT id, task, y FROM doc_long WHERE id NOT IN (SELECT id FROM seed)")
def q_remainder_pool(spark, sf_dir):
    cells = _doc_long(spark, sf_dir)
    seed = smp.seed_set_any_active(cells, len(td.DOC_TASKS), N_ACTIVE, SEED)
    return smp.remainder_pool(cells, seed, by="rows")


# ---------------------------------------------------------------------------------
# 2.3 fingerprint job
# ---------------------------------------------------------------------------------

from tidepool.operators import fingerprint as fp  # noqa: E402


def _mixed_texts(spark, sf_dir):
    """The documents with some texts missing and some without a letter or digit."""
    text = F.when(F.col("source") == "src0", F.lit(None)).when(
        F.col("source") == "src1", F.regexp_replace("text", fp.VALID_CHAR, "")).otherwise(F.col("text"))
    return td.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@register("quarantine_rows",
          "WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN NULL WHEN source = 'src1' THEN "
          "regexp_replace(text, '[\\p{L}\\p{N}]', '', 'g') ELSE text END AS text FROM documents), "
          "r AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN 'NA value' "
          "WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'Invalid' "
          "WHEN len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) = 0 "
          "THEN 'Featurization failed' END AS error FROM d) "
          "SELECT CASE WHEN error IS NULL THEN 'kept' ELSE 'rejected' END AS sink, doc_id, length(text) AS n_chars, error FROM r")
def q_quarantine_rows(spark, sf_dir):
    """Rows of both sinks: the kept table and the reject table."""
    good, bad = fp.quarantine_rows(_mixed_texts(spark, sf_dir), "text", "doc_id")
    kept = good.select(F.lit("kept").alias("sink"), "doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.lit(None).cast("string").alias("error"))
    return kept.unionByName(bad.select(F.lit("rejected").alias("sink"), F.col("row_index").alias("doc_id"),
                                       F.length("text").cast("long").alias("n_chars"), "error"))


FP_TASKS = 64  # the documents table is a file of one row group: texts are dealt out to so many tasks


@register("hash_fingerprint", _with(fp.sql_fingerprint_bits("documents", "doc_id", "text")) +
          "\nSELECT doc_id, count(*) AS n_bits, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits "
          "FROM fp_bits GROUP BY doc_id")
def q_hash_fingerprint(spark, sf_dir):
    """One row per valid string: bit count and the sorted bit ids as text (the sparse fingerprint)."""
    fps, _ = fp.hash_fingerprint(td.table(spark, sf_dir, "documents"), "text", "doc_id", partitions=FP_TASKS)
    return fps.select("doc_id", F.size("bits").cast("long").alias("n_bits"),
                      F.array_join(F.transform("bits", lambda b: b.cast("string")), ",").alias("bits"))


# ---------------------------------------------------------------------------------
# 2.6 training, 2.11 iteration, resume, grid
# ---------------------------------------------------------------------------------

from tidepool.operators.scoring import (  # noqa: E402
    centroid_weights, sql_centroid_weights, sql_logistic_weights, train_surrogate,
)
from tidepool.plans import loop as lp  # noqa: E402
from tidepool.plans.setup import SQL_AL_DATA  # noqa: E402
from tidepool.session import cut_lineage  # noqa: E402


@register("train_surrogate", sql_rounded(
    "WITH RECURSIVE " + ",\n".join([SQL_AL_DATA.strip(), sql_logistic_weights("SELECT * FROM train_cells", "SELECT * FROM feats", 64).strip()]) +
    "\nSELECT task, w[65] AS bias, sqrt(list_dot_product(w[1:64], w[1:64])) AS w_norm FROM logit", ["bias", "w_norm"]))
def q_train_surrogate(spark, sf_dir):
    """Logistic regression of ten tasks, run until the values stand (any converged solver gives them)."""
    inp = al_inputs(spark, sf_dir)
    w = train_surrogate(inp.train_cells, inp.feats, reg=0.01, tol=1e-11)
    return rounded(w.select("task", "bias", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)).alias("w_norm")))


STEP_SEED = 3
N_STEP_SEED = 10


def _step_inputs(spark, sf_dir):
    inp = al_inputs(spark, sf_dir)
    seed = cut_lineage(smp.seed_set_aux(inp.train_cells, EMB_TASKS, N_STEP_SEED, STEP_SEED).select("id", "task", "y"))
    pool = cut_lineage(smp.remainder_pool(inp.train_cells, seed, by="cells"))
    return inp, seed, pool


SQL_STEP_DATA = [
    SQL_AL_DATA,
    "seed AS (" + _sql_draw("SELECT id, task, y FROM train_cells WHERE y IS NOT NULL", "task, y", N_STEP_SEED // 2) + ")",
    "pool AS (SELECT c.id, c.task, c.y FROM train_cells c WHERE NOT EXISTS "
    "(SELECT 1 FROM seed s WHERE s.id = c.id AND s.task = c.task))",
]


@register("al_step", _with(*SQL_STEP_DATA, sql_centroid_weights("SELECT * FROM seed", "SELECT * FROM feats"),
                           sql_probs("probs", "SELECT DISTINCT id FROM pool WHERE y IS NOT NULL", K),
                           f"bald AS ({SQL_BALD})",
                           f"top AS (SELECT b.id, b.task FROM bald b JOIN pool p ON b.id = p.id AND b.task = p.task "
                           f"WHERE p.y IS NOT NULL ORDER BY b.score DESC, b.id, b.task LIMIT {TOP_K})") +
          "\nSELECT p.id, p.task, p.y FROM pool p JOIN top t ON p.id = t.id AND p.task = t.task")
def q_al_step(spark, sf_dir):
    inp, seed, pool = _step_inputs(spark, sf_dir)
    weights = centroid_weights(seed, inp.feats)
    res = lp.al_step(seed, pool, inp.feats, weights, lp.StepConfig("BALD", n_query=TOP_K, passes=K))
    return res.query


RUN_ITERS = 2
RUN_N = 5
RUN_DROPOUT = 0.2


def _sql_run_history(score: str = SQL_BALD, evaluate: bool = True) -> list[str]:
    """The loop: every iteration fits, evaluates and queries (BALD, or another score per cell) in a nested query."""
    ctes = ["train_0 AS (SELECT * FROM seed)", "pool_0 AS (SELECT * FROM pool)"]
    for i in range(RUN_ITERS):
        fit = sql_centroid_weights(f"SELECT * FROM train_{i}", "SELECT * FROM feats")
        probs = sql_probs("probs", f"SELECT DISTINCT id FROM pool_{i} WHERE y IS NOT NULL", K, rate=RUN_DROPOUT)
        ctes.append(f"q_{i} AS ({_with(fit, probs, f'bald AS ({score})')} SELECT p.id, p.task, p.y FROM bald b "
                    f"JOIN pool_{i} p ON b.id = p.id AND b.task = p.task WHERE p.y IS NOT NULL "
                    f"ORDER BY b.score DESC, b.id, b.task LIMIT {RUN_N})")
        if evaluate:
            ctes.append(f"m_{i} AS ({_with(fit, sql_probs('probs', SQL_TEST_IDS, 1, dropout=False), SQL_REPORT_SCORES, sql_curve('report_scores'))}"
                        f" SELECT * FROM mtab)")
        ctes.append(f"train_{i + 1} AS (SELECT * FROM train_{i} UNION ALL SELECT * FROM q_{i})")
        ctes.append(f"pool_{i + 1} AS (SELECT p.* FROM pool_{i} p WHERE NOT EXISTS "
                    f"(SELECT 1 FROM q_{i} q WHERE q.id = p.id AND q.task = p.task))")
    ctes.append("hist AS (" + " UNION ALL ".join(
        f"SELECT CAST(0 AS BIGINT) AS run_id, CAST({i} AS BIGINT) AS iteration, id, task, y FROM q_{i}"
        for i in range(RUN_ITERS)) + ")")
    return ctes


def _run(spark, sf_dir, evaluate=True):
    from tidepool.session import scratch_path
    inp, seed, pool = _step_inputs(spark, sf_dir)
    cfg = lp.RunConfig(run_id=0, iterations=RUN_ITERS, history_path=scratch_path(spark, "al_run_history"),
                       metrics_path=scratch_path(spark, "al_run_metrics") if evaluate else None,
                       step=lp.StepConfig("BALD", n_query=RUN_N, passes=K, dropout=RUN_DROPOUT))
    lp.al_run(seed, pool, inp.feats, cfg, test_cells=inp.test_cells)
    return cfg, seed, pool


MANY_SEEDS = [3, 5]
MANY_STRATEGIES = {"BALD": SQL_BALD, "greedy": SQL_GREEDY}


def _sql_one_of_many(run_id: int, seed: int, score: str) -> str:
    draw = _sql_draw("SELECT id, task, y FROM train_cells WHERE y IS NOT NULL", "task, y", N_STEP_SEED // 2, seed)
    ctes = [f"seed AS ({draw})",
            "pool AS (SELECT c.id, c.task, c.y FROM train_cells c WHERE NOT EXISTS "
            "(SELECT 1 FROM seed s WHERE s.id = c.id AND s.task = c.task))", *_sql_run_history(score, evaluate=False)]
    return f"run_{run_id} AS ({_with(*ctes)} SELECT CAST({run_id} AS BIGINT) AS run_id, iteration, id, task, y FROM hist)"


_MANY = [(i * len(MANY_STRATEGIES) + j, seed, name) for i, seed in enumerate(MANY_SEEDS) for j, name in enumerate(MANY_STRATEGIES)]


@register("al_runs", _with(SQL_AL_DATA, *[_sql_one_of_many(r, seed, MANY_STRATEGIES[name]) for r, seed, name in _MANY]) + "\n" +
          " UNION ALL ".join(f"SELECT * FROM run_{r}" for r, _, _ in _MANY))
def q_al_runs(spark, sf_dir):
    """History of four runs (two seeds, two strategies) that share one loop."""
    from tidepool.plans import runs as mr
    inp = al_inputs(spark, sf_dir)
    cells = cut_lineage(inp.train_cells)
    train = pool = None
    for r, seed_no, _ in _MANY:
        seed = cut_lineage(smp.seed_set_aux(cells, EMB_TASKS, N_STEP_SEED, seed_no).select("id", "task", "y"))
        own = [d.withColumn("run_id", F.lit(r).cast("long")) for d in (seed, smp.remainder_pool(cells, seed, by="cells"))]
        train, pool = own if train is None else (train.unionByName(own[0]), pool.unionByName(own[1]))
    cfg = lp.RunConfig(iterations=RUN_ITERS, history_path=scratch_path(spark, "al_runs_history"),
                       step=lp.StepConfig(passes=K, dropout=RUN_DROPOUT))
    mr.al_runs(train, pool, inp.feats, [mr.RunSpec(r, name, seed, RUN_N) for r, seed, name in _MANY], cfg)
    return read_history(spark, cfg.history_path).select(
        F.col("run_id").cast("long"), F.col("iteration").cast("long"), F.col("id").cast("long"), "task", "y")


RUN_METRICS = ["balanced_acc", "roc_auc", "average_precision", "ECE"]


@register("al_run", sql_rounded(_with(*SQL_STEP_DATA, *_sql_run_history()) +
          "\nSELECT 'query' AS kind, iteration, id, task, 'y' AS name, y AS value FROM hist UNION ALL " + " UNION ALL ".join(
    f"SELECT 'metric', {i}, NULL, {task}, '{c}', {value} FROM m_{i}{group}"
    for i in range(RUN_ITERS) for c in RUN_METRICS
    for task, value, group in (("task", c, ""), ("'mean'", f"avg({c})", ""))), ["value"]))
def q_al_run(spark, sf_dir):
    """History and metrics of a BALD run: fit, evaluate, query and update in every iteration."""
    cfg, _, _ = _run(spark, sf_dir)
    it = F.col("iteration").cast("long").alias("iteration")
    hist = spark.read.parquet(cfg.history_path).select(
        F.lit("query").alias("kind"), it, F.col("id").cast("long"), "task", F.lit("y").alias("name"),
        F.col("y").cast("double").alias("value"))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in RUN_METRICS])).alias("m")
    metrics = spark.read.parquet(cfg.metrics_path).select(it, F.col("Tasks").alias("task"), long).select(
        F.lit("metric").alias("kind"), "iteration", F.lit(None).cast("long").alias("id"), "task", "m.name", "m.value")
    return rounded(hist.unionByName(metrics))


@register("iteration_done", _with(*SQL_STEP_DATA, *_sql_run_history()) +
          "\nSELECT CAST(r.range AS BIGINT) AS iteration, CASE WHEN r.range IN (SELECT iteration FROM hist) "
          "THEN 1 ELSE 0 END AS done FROM range(5) r")
def q_iteration_done(spark, sf_dir):
    cfg, _, _ = _run(spark, sf_dir, evaluate=False)
    return lp.iterations_done(spark, cfg.history_path, 0, list(range(5))).select("iteration", F.col("done").cast("int"))


@register("replay_history", _with(*SQL_STEP_DATA, *_sql_run_history()) +
          "\nSELECT 'train' AS role, id, task, y FROM seed UNION ALL SELECT 'train', id, task, y FROM hist "
          "UNION ALL SELECT 'pool', p.id, p.task, p.y FROM pool p WHERE NOT EXISTS "
          "(SELECT 1 FROM hist h WHERE h.id = p.id AND h.task = p.task)")
def q_replay_history(spark, sf_dir):
    cfg, seed, pool = _run(spark, sf_dir, evaluate=False)
    train, pool_t = lp.replay_history(spark, cfg.history_path, seed, pool, 0)
    return train.select(F.lit("train").alias("role"), "id", "task", "y").unionByName(
        pool_t.select(F.lit("pool").alias("role"), "id", "task", "y"))


GRID_SEEDS = [0, 1, 2]
GRID_STRATEGIES = list(lp.STRATEGIES)
GRID_FEATURES = ["BERT", "FP"]


N_GRID_SEED = 6


@register("experiment_grid", _with(f"cells AS ({td.SQL_EMB_CELLS})",
                                   "t AS (SELECT task, dense_rank() OVER (ORDER BY task) - 1 AS ti FROM "
                                   "(SELECT DISTINCT task FROM cells) d)",
                                   "grid AS (SELECT CAST(((t.ti * 3 + s.si) * 5 + g.gi) * 2 + f.fi AS BIGINT) AS run_id, t.task, "
                                   "CAST(s.seed AS BIGINT) AS seed, g.strategy, f.feature_type FROM t, "
                                   f"(SELECT unnest({GRID_SEEDS}) AS seed, unnest(range(3)) AS si) s, "
                                   "(SELECT unnest([" + ", ".join(f"'{x}'" for x in GRID_STRATEGIES) + "]) AS strategy, unnest(range(5)) AS gi) g, "
                                   "(SELECT unnest([" + ", ".join(f"'{x}'" for x in GRID_FEATURES) + "]) AS feature_type, unnest(range(2)) AS fi) f)",
                                   "drawn AS (SELECT g.*, c.id, c.y, row_number() OVER (PARTITION BY g.run_id, c.y ORDER BY "
                                   "CAST(('0x' || substr(md5(concat_ws('|', CAST(g.seed AS VARCHAR), CAST(c.id AS VARCHAR))), 1, 13)) AS BIGINT), "
                                   "c.id) AS rn FROM grid g JOIN cells c ON c.task = g.task WHERE c.y IS NOT NULL)") +
          f"\nSELECT run_id, task, seed, strategy, feature_type, id, y FROM drawn WHERE rn <= {N_GRID_SEED // 2}")
def q_experiment_grid(spark, sf_dir):
    """The grid of the data's tasks, and the seed set of every run, drawn in one job."""
    cells = td.emb_cells(spark, sf_dir)
    grid = cut_lineage(lp.experiment_grid(cells.select("task"), GRID_SEEDS, GRID_STRATEGIES, GRID_FEATURES))
    seeds = smp.seed_sets_for_runs(cells, grid, N_GRID_SEED)
    return grid.join(seeds.drop("task"), "run_id").select("run_id", "task", "seed", "strategy", "feature_type", "id", "y")


# ---------------------------------------------------------------------------------
# 2.4 cluster split
# ---------------------------------------------------------------------------------

from tidepool.operators import cluster as clu  # noqa: E402

CLUSTER_BITS = 1 << 20

#: Exact pairs by a bit join; Butina in fixed order as a walk over the ranked nodes.
SQL_CLUSTERS = fp.sql_fingerprint_bits("documents", "doc_id", "text", size=CLUSTER_BITS).strip() + f""",
sets AS (SELECT doc_id, list(bit ORDER BY bit) AS bits FROM fp_bits GROUP BY doc_id),
reps AS (SELECT min(doc_id) AS key, count(*) AS mult, bits, len(bits) AS n FROM sets GROUP BY bits),
rep_bits AS (SELECT key, unnest(bits) AS bit FROM reps),
shared AS (SELECT x.key AS a, y.key AS b, count(*) AS n FROM rep_bits x JOIN rep_bits y ON x.bit = y.bit AND x.key < y.key
           GROUP BY x.key, y.key),
pairs AS (SELECT s.a, s.b FROM shared s JOIN reps x ON x.key = s.a JOIN reps y ON y.key = s.b
          WHERE CAST(s.n AS DOUBLE) / (x.n + y.n - s.n) >= {clu.DEFAULT_THRESHOLD}),
und AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
ranked AS (SELECT r.key, row_number() OVER (ORDER BY r.mult - 1 + coalesce(w.s, 0) DESC, r.key) AS pos
           FROM reps r LEFT JOIN (SELECT u.a, sum(r.mult) AS s FROM und u JOIN reps r ON r.key = u.b GROUP BY u.a) w ON w.a = r.key),
near AS (SELECT x.pos, y.pos AS other FROM und u JOIN ranked x ON x.key = u.a JOIN ranked y ON y.key = u.b),
lists AS (SELECT r.pos, coalesce(list(n.other) FILTER (n.other IS NOT NULL), []) AS others
          FROM ranked r LEFT JOIN near n ON n.pos = r.pos GROUP BY r.pos),
walk(pos, centres) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT l.pos, CASE WHEN list_has_any(w.centres, l.others) THEN w.centres ELSE list_append(w.centres, l.pos) END
  FROM walk w JOIN lists l ON l.pos = w.pos + 1),
centres AS (SELECT unnest(centres) AS pos FROM (SELECT centres FROM walk ORDER BY pos DESC LIMIT 1) z),
claims AS (SELECT pos, pos AS centre FROM centres UNION ALL
           SELECT n.pos, min(n.other) FROM near n JOIN centres c ON c.pos = n.other
           WHERE n.pos NOT IN (SELECT pos FROM centres) GROUP BY n.pos),
clusters AS (SELECT s.doc_id, c.key AS cluster, CAST(m.pos = m.centre AND s.doc_id = x.key AS INTEGER) AS is_centre
             FROM sets s JOIN reps x ON x.bits = s.bits JOIN ranked r ON r.key = x.key JOIN claims m ON m.pos = r.pos
             JOIN ranked c ON c.pos = m.centre)"""


def _doc_fps(spark, sf_dir):
    fps, _ = fp.hash_fingerprint(td.table(spark, sf_dir, "documents"), "text", "doc_id", size=CLUSTER_BITS, partitions=FP_TASKS)
    return fps


@register("similarity_clusters", "WITH RECURSIVE " + SQL_CLUSTERS + "\nSELECT * FROM clusters")
def q_similarity_clusters(spark, sf_dir):
    return clu.similarity_clusters(_doc_fps(spark, sf_dir), "doc_id", clu.DEFAULT_THRESHOLD) \
        .select("doc_id", "cluster", F.col("is_centre").cast("int").alias("is_centre"))


@register("split_by_cluster", sql_group_split(
    SQL_CLUSTERS + ",\nsrc AS (SELECT d.doc_id, coalesce(c.cluster, d.doc_id) AS cluster FROM documents d "
    "LEFT JOIN clusters c ON c.doc_id = d.doc_id)", "cluster"))
def q_split_by_cluster(spark, sf_dir):
    docs = td.table(spark, sf_dir, "documents").select("doc_id", "source")
    return clu.split_by_cluster(docs, _doc_fps(spark, sf_dir), "doc_id", 0.8, 42).select("doc_id", "cluster", "role")


@register("experiment_grid_data_sets",
          _with(DOC_WIDE, SQL_DOC_LONG, f"cells AS ({td.SQL_EMB_CELLS})",
                "both_sets AS (SELECT 'documents' AS dataset, task, id, y FROM doc_long UNION ALL "
                "SELECT 'embeddings', task, id, y FROM cells WHERE y IS NOT NULL)",
                "t AS (SELECT dataset, task, dense_rank() OVER (ORDER BY dataset, task) - 1 AS ti FROM "
                "(SELECT DISTINCT dataset, task FROM both_sets) d)",
                "grid AS (SELECT CAST(t.ti * 3 + s.si AS BIGINT) AS run_id, t.dataset, t.task, CAST(s.seed AS BIGINT) AS seed FROM t, "
                f"(SELECT unnest({GRID_SEEDS}) AS seed, unnest(range(3)) AS si) s)",
                "drawn AS (SELECT g.*, c.id, c.y, row_number() OVER (PARTITION BY g.run_id, c.y ORDER BY "
                "CAST(('0x' || substr(md5(concat_ws('|', CAST(g.seed AS VARCHAR), CAST(c.id AS VARCHAR))), 1, 13)) AS BIGINT), "
                "c.id) AS rn FROM grid g JOIN both_sets c ON c.dataset = g.dataset AND c.task = g.task)") +
          f"\nSELECT run_id, dataset, task, seed, id, y FROM drawn WHERE rn <= {N_GRID_SEED // 2}")
def q_experiment_grid_data_sets(spark, sf_dir):
    """A grid over two data sets with their own tasks, and every run's seed set."""
    docs = _doc_long(spark, sf_dir).select(F.lit("documents").alias("dataset"), "task", "id", "y")
    emb = td.emb_cells(spark, sf_dir).select(F.lit("embeddings").alias("dataset"), "task", "id", "y")
    cells = docs.unionByName(emb)
    grid = cut_lineage(lp.experiment_grid(cells.where("y is not null").select("dataset", "task"), GRID_SEEDS, ["BALD"]))
    seeds = smp.seed_sets_for_runs(cells, grid, N_GRID_SEED, by=["dataset", "task"])
    return seeds.join(grid.select("run_id", "seed"), "run_id").select("run_id", "dataset", "task", "seed", "id", "y")
