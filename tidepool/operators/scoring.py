"""Training and scoring as table jobs.

The surrogate is a per-task linear model ``p = sigmoid(b_t + w_t . x)``.  The
weight table ``(task, bias, w array<double>)`` is small (tasks x feature
width), so it is the one thing shipped to executors; the feature table is
scored where it lies, batch by batch, with no shuffle.

Stochastic passes use deterministic dropout on the inputs: unit j of row key i
is kept in pass k when a mixed integer hash of (i, k, j) clears a threshold, and
kept units are scaled by 1/(1-p).  The mask therefore never depends on task
order, partitioning or retries, and a SQL engine can reproduce it exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.hashing import hash52
from tidepool.session import broadcast, cut_lineage, release

# Fixed values of the dropout hash (own design: integer mixing that stays inside 64 bits).
MASK_MOD = 1000003
MASK_MUL_ID = 7919
MASK_MUL_PASS = 104729
MASK_MUL_UNIT = 1299709
MASK_ADD = 12345
MASK_ROUNDS = 3

DEFAULT_PASSES = 20
DEFAULT_DROPOUT = 0.5

CENTROID_SCALE = 16.0
MAX_WEIGHT_CELLS = 50_000_000  # tasks x width shipped to executors at once (400 MB)
SCORE_TILE = 2048              # rows per in-task tile


def keep_below(dropout: float) -> int:
    """Mask hashes under this are kept: a share of ``1 - dropout`` of all."""
    return round((1.0 - dropout) * MASK_MOD)


def mask_key(key: str, kind: T.DataType):
    """Integer mask key of a row key: integers stand for themselves, others are hashed."""
    return F.col(key).cast("long") if isinstance(kind, T.IntegralType) else hash52("mask", key)


def keep_mask(keys: np.ndarray, pass_no: int, width: int, dropout: float = DEFAULT_DROPOUT) -> np.ndarray:
    """Boolean (n, width) keep-mask for integer row keys in pass ``pass_no``."""
    j = np.arange(width, dtype=np.int64)
    h = (np.mod(keys.astype(np.int64), MASK_MOD)[:, None] * MASK_MUL_ID
         + pass_no * MASK_MUL_PASS + j[None, :] * MASK_MUL_UNIT) % MASK_MOD
    for _ in range(MASK_ROUNDS):
        h = (h * h + 7 * h + MASK_ADD) % MASK_MOD
    return h < keep_below(dropout)


def sql_keep_mask_ctes(src: str, passes: int, dropout: float = DEFAULT_DROPOUT, key: str = "s.id") -> str:
    """DuckDB CTE text: ``mask_final(id, pass, j, keep)`` from ``src(id, j)`` rows."""
    steps = [f"mask_0 AS (SELECT s.id, r.range AS pass, s.j, "
             f"((({key} % {MASK_MOD}) * {MASK_MUL_ID} + r.range * {MASK_MUL_PASS} + s.j * {MASK_MUL_UNIT}) "
             f"% {MASK_MOD}) AS h FROM {src} s, range({passes}) r)"]
    for i in range(1, MASK_ROUNDS + 1):
        steps.append(f"mask_{i} AS (SELECT id, pass, j, (h * h + 7 * h + {MASK_ADD}) % {MASK_MOD} AS h "
                     f"FROM mask_{i - 1})")
    steps.append(f"mask_final AS (SELECT id, pass, j, CASE WHEN h < {keep_below(dropout)} THEN 1 ELSE 0 END AS keep "
                 f"FROM mask_{MASK_ROUNDS})")
    return ",\n".join(steps)


# ---- surrogate models -----------------------------------------------------------

def _class_sums(cells: DataFrame, feats: DataFrame, tasks: list[str]) -> DataFrame:
    """(task, y, j, s, n): per task and class, the sum of feature unit j and the row count.

    One row per key carries its label vector (pivot) next to its features; each
    Arrow batch contributes ``M_c^T X`` (tasks x width) per class with one matrix
    product, so the N x tasks x width work runs in BLAS and only
    batches x tasks x 2 partial rows are shuffled.
    """
    wide = cells.where(F.col("y").isNotNull()).groupBy("id").pivot("task", tasks).agg(F.max("y"))
    d = wide.join(feats, "id").select("x", *[F.col(t).cast("double").alias(t) for t in tasks])
    n_t = len(tasks)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            X = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            Y = np.column_stack([batch.column(t).to_numpy(zero_copy_only=False).astype(np.float64)
                                 for t in tasks])
            out_t, out_y, out_n, sums = [], [], [], []
            for c in (0.0, 1.0):
                M = (Y == c).astype(np.float64)
                S = M.T @ X
                for ti in range(n_t):
                    out_t.append(tasks[ti])
                    out_y.append(c)
                    out_n.append(int(M[:, ti].sum()))
                    sums.append(S[ti])
            width = X.shape[1]
            offsets = pa.array(np.arange(0, len(sums) * width + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_t, pa.string()), pa.array(out_y), pa.array(out_n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sums)))],
                schema=pa.schema([("task", pa.string()), ("y", pa.float64()), ("n", pa.int64()),
                                  ("s", pa.list_(pa.float64()))]))

    part = d.mapInArrow(run, "task string, y double, n long, s array<double>")
    # the count travels with every unit's sum; the table (tasks x classes x width rows) is read twice
    return cut_lineage(part.select("task", "y", "n", F.posexplode("s").alias("j", "v")).groupBy("task", "y", "j")
                       .agg(F.sum("v").alias("s"), F.sum("n").alias("n")))


def centroid_weights(cells: DataFrame, feats: DataFrame, scale: float = CENTROID_SCALE,
                     tasks: list[str] | None = None) -> DataFrame:
    """Closed-form per-task linear surrogate (class-centroid direction, log prior odds).

    ``w = scale * (mu1 - mu0)``, ``b = ln(n1/n0) - w . (mu1 + mu0) / 2``.
    Deterministic and one aggregation deep, so every downstream score can be
    checked against SQL.  A task with one class only gets w = 0, b = 0.
    ``tasks`` defaults to the distinct tasks of ``cells`` (a handful of names).
    """
    if tasks is None:
        tasks = sorted(r["task"] for r in cells.select("task").distinct().collect())
    cs = _class_sums(cells, feats, tasks).where(F.col("n") > 0)
    mu = cs.groupBy("task", "j").agg(
        F.max(F.when(F.col("y") == 1, F.col("s") / F.col("n"))).alias("mu1"),
        F.max(F.when(F.col("y") == 0, F.col("s") / F.col("n"))).alias("mu0"))
    wt = mu.select("task", "j",
                   F.coalesce(F.lit(scale) * (F.col("mu1") - F.col("mu0")), F.lit(0.0)).alias("w"),
                   F.coalesce(F.lit(scale) * (F.col("mu1") - F.col("mu0")) * (F.col("mu1") + F.col("mu0")) / 2,
                              F.lit(0.0)).alias("c"))
    prior = cs.groupBy("task").agg(F.max(F.when(F.col("y") == 1, F.col("n"))).alias("n1"),
                                   F.max(F.when(F.col("y") == 0, F.col("n"))).alias("n0"))
    packed = wt.groupBy("task").agg(
        F.sum("c").alias("csum"),
        F.array_sort(F.collect_list(F.struct("j", "w"))).alias("jw"))
    out = packed.join(prior, "task")
    both = F.coalesce(F.col("n1"), F.lit(0)) > 0
    both = both & (F.coalesce(F.col("n0"), F.lit(0)) > 0)
    return out.select(
        "task",
        F.when(both, F.log(F.col("n1") / F.col("n0")) - F.col("csum")).otherwise(F.lit(0.0)).alias("bias"),
        F.transform("jw", lambda s: s["w"]).alias("w"))


def sql_centroid_weights(cells: str, feats: str, scale: float = CENTROID_SCALE) -> str:
    """DuckDB CTE text producing ``wt(task, j, w)`` and ``bias(task, b)``."""
    return f"""
lab AS (SELECT c.task, c.y, f.x FROM ({cells}) c JOIN ({feats}) f ON c.id = f.id WHERE c.y IS NOT NULL),
lab_units AS (SELECT task, y, unnest(range(len(x))) AS j, CAST(unnest(x) AS DOUBLE) AS v FROM lab),
mu AS (SELECT task, j, avg(CASE WHEN y = 1 THEN v END) AS mu1, avg(CASE WHEN y = 0 THEN v END) AS mu0
       FROM lab_units GROUP BY task, j),
wt AS (SELECT task, j, coalesce({scale} * (mu1 - mu0), 0.0) AS w,
              coalesce({scale} * (mu1 - mu0) * (mu1 + mu0) / 2, 0.0) AS c FROM mu),
prior AS (SELECT task, sum(y) AS n1, count(*) - sum(y) AS n0 FROM lab GROUP BY task),
bias AS (SELECT p.task, CASE WHEN p.n1 > 0 AND p.n0 > 0 THEN ln(p.n1 / p.n0) - s.csum ELSE 0.0 END AS b
         FROM prior p JOIN (SELECT task, sum(c) AS csum FROM wt GROUP BY task) s ON p.task = s.task)"""


def labelled_rows(cells: DataFrame, feats: DataFrame, tasks: list[str]) -> DataFrame:
    """``(x, ys)``: one row per labelled key, with its labels as one array in task order."""
    wide = cells.where(F.col("y").isNotNull()).groupBy("id").pivot("task", tasks).agg(F.max("y"))
    ys = wide.select("id", F.array(*[F.col(f"`{t}`").cast("double") for t in tasks]).alias("ys"))
    return ys.join(feats, "id").select("x", "ys")


def _loss_pass(data: DataFrame, W: np.ndarray, b: np.ndarray, wt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic loss and its gradient for several weight sets in one pass over the data.

    ``W`` (sets, tasks, width), ``b`` (sets, tasks), ``wt`` (2, tasks): weight of a negative and of a positive.
    Each map task adds up one array of sets x tasks x (width + 2) numbers; these are summed by position.
    """
    spark = data.sparkSession
    n_s, n_t, width = W.shape
    bc = spark.sparkContext.broadcast((W, b, wt))

    def run(batches):
        Ws, bs, c = bc.value
        acc = np.zeros((n_s, n_t, width + 2))
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            X = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)
            Y = batch.column("ys").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, n_t)
            C = np.where(Y == 1, c[1], np.where(Y == 0, c[0], 0.0))  # missing labels (NaN) weigh nothing
            Y = np.where(Y == 1, 1.0, 0.0)
            for i in range(n_s):
                Z = X @ Ws[i].T + bs[i]
                R = C * (1.0 / (1.0 + np.exp(-np.clip(Z, -700, 700))) - Y)
                acc[i, :, :width] += R.T @ X
                acc[i, :, width] += R.sum(axis=0)
                acc[i, :, width + 1] += (C * (np.logaddexp(0.0, Z) - Y * Z)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"v": pa.array([acc.ravel()], pa.list_(pa.float64()))})

    try:
        total = data.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")) \
            .groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    finally:
        bc.destroy()
    out = np.zeros(n_s * n_t * (width + 2))
    out[total["i"].to_numpy()] = total["v"].to_numpy()
    out = out.reshape(n_s, n_t, width + 2)
    return out[:, :, width + 1], out[:, :, :width + 1]


def _direction(g: np.ndarray, steps: list, bends: list) -> np.ndarray:
    """Two-loop L-BFGS direction of every task (rows), from its own steps and gradient changes."""
    q = -g
    used = []
    for s_, y_ in reversed(list(zip(steps, bends))):
        sy = (s_ * y_).sum(axis=1)
        rho = np.where(sy > 1e-300, 1.0 / np.where(sy > 1e-300, sy, 1.0), 0.0)
        alpha = rho * (s_ * q).sum(axis=1)
        q = q - alpha[:, None] * y_
        used.append((s_, y_, rho, alpha))
    if used:
        s_, y_, rho, _ = used[0]
        yy = (y_ * y_).sum(axis=1)
        q = q * np.where(rho > 0, (s_ * y_).sum(axis=1) / np.where(yy > 0, yy, 1.0), 1.0)[:, None]
    for s_, y_, rho, alpha in reversed(used):
        q = q + (alpha - rho * (y_ * q).sum(axis=1))[:, None] * s_
    return q


STEPS = (1.0, 0.25, 0.03)      # tried in one pass
MEMORY = 10                    # steps that the curvature is estimated from


def sql_logistic_weights(cells: str, feats: str, width: int, reg: float = 0.01, rounds: int = 250) -> str:
    """DuckDB CTE text (of a recursive WITH) producing ``logit(task, w)``, the bias last in ``w``.

    Accelerated gradient descent on the same objective: the step is one over the largest curvature,
    the momentum that of a strong convexity of ``0.9 reg``.
    """
    n = width + 1
    zeros = f"list_transform(range({n}), lambda i: CAST(0 AS DOUBLE))"
    return f"""
lab AS MATERIALIZED (SELECT c.task, c.y, list_append(list_transform(f.x, lambda e: CAST(e AS DOUBLE)), CAST(1 AS DOUBLE)) AS x
  FROM ({cells}) c JOIN ({feats}) f ON c.id = f.id WHERE c.y IS NOT NULL),
cls AS (SELECT task, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM lab GROUP BY task),
obs AS MATERIALIZED (SELECT l.task, y, x, 0.5 / CASE WHEN y = 1 THEN n1 ELSE n0 END AS c
  FROM lab l JOIN cls USING (task) WHERE n1 > 0 AND n0 > 0),
step AS MATERIALIZED (SELECT l, (sqrt(l / {0.9 * reg}) - 1) / (sqrt(l / {0.9 * reg}) + 1) AS m FROM (
  SELECT 0.25 * max(s) + {reg} AS l FROM (SELECT task, sum(c * list_dot_product(x, x)) AS s FROM obs GROUP BY task) t) q),
fit AS (
  SELECT DISTINCT task, 0 AS k, {zeros} AS w, {zeros} AS u FROM obs
  UNION ALL
  SELECT n.task, n.k, n.w, list_transform(range(1, {n + 1}), lambda i: n.w[i] + n.m * (n.w[i] - n.old[i])) FROM (
    SELECT f.task, f.k + 1 AS k, f.w AS old, p.m, list_transform(range(1, {n + 1}),
      lambda i: f.u[i] - (g.g[i] + CASE WHEN i < {n} THEN {reg} * f.u[i] ELSE 0 END) / p.l) AS w
    FROM fit f JOIN (SELECT task, list(s ORDER BY j) AS g FROM (SELECT task, j, sum(r * xj) AS s FROM (
        SELECT f.task, o.c * (1 / (1 + exp(-list_dot_product(f.u, o.x))) - o.y) AS r, unnest(o.x) AS xj, unnest(range({n})) AS j
        FROM fit f JOIN obs o ON o.task = f.task) a GROUP BY task, j) b GROUP BY task) g ON g.task = f.task, step p
    WHERE f.k < {rounds}) n),
logit AS (SELECT task, w FROM fit WHERE k = {rounds}
  UNION ALL SELECT task, {zeros} FROM cls WHERE n1 = 0 OR n0 = 0)"""


def train_surrogate(cells: DataFrame, feats: DataFrame, reg: float = 0.01, max_iter: int = 200,
                    balance: bool = True, tol: float = 1e-7) -> DataFrame:
    """L2 logistic regression of every task on the labelled cells, all tasks in one fit.

    Per task the mean weighted log loss plus ``reg / 2 |w|^2`` (the bias is free); class weights
    ``n / (2 n_class)`` when ``balance``.  L-BFGS runs for all tasks in lockstep: one pass over the labelled rows
    yields loss and gradient of all tasks for a few step lengths, summed map-side as tasks x width
    numbers; the driver holds a few arrays of that size.  It ends when every task's gradient norm
    is below ``tol`` (raises after ``max_iter`` passes).  A task with one class only gets w = 0, b = 0.
    Returns the same ``(task, bias, w)`` table as :func:`centroid_weights`.
    """
    spark = cells.sparkSession
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("bias", T.DoubleType()),
                           T.StructField("w", T.ArrayType(T.DoubleType()))])
    tasks = sorted(r["task"] for r in cells.where(F.col("y").isNotNull()).select("task").distinct().collect())
    width = (feats.select(F.size("x").alias("d")).first() or {"d": 0})["d"]
    if not tasks:
        return spark.createDataFrame([], schema)
    data = cut_lineage(labelled_rows(cells, feats, tasks))
    counts = data.select(F.posexplode("ys").alias("t", "y")).groupBy("t").agg(
        F.sum((F.col("y") == 0).cast("long")).alias("n0"), F.sum((F.col("y") == 1).cast("long")).alias("n1")).collect()
    n = np.zeros((2, len(tasks)))
    for r in counts:
        n[:, r["t"]] = r["n0"] or 0, r["n1"] or 0
    open_ = (n > 0).all(axis=0)
    total = n.sum(axis=0)
    weight = total / np.maximum(2 * n, 1) if balance else np.ones_like(n)
    weight = np.where(open_, weight / np.maximum((weight * n).sum(axis=0), 1e-300), 0.0)  # a mean over the weights

    def losses(V: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, g = _loss_pass(data, V[:, :, :width], V[:, :, width], weight)
        f = f + reg / 2 * (V[:, :, :width] ** 2).sum(axis=2)
        g[:, :, :width] += reg * V[:, :, :width]
        return f, g * open_[None, :, None]

    v = np.zeros((len(tasks), width + 1))
    (f,), (g,) = losses(v[None])
    steps, bends = [], []
    for _ in range(max_iter):
        norm = np.sqrt((g * g).sum(axis=1))
        if norm.max() < tol:
            break
        p = _direction(g, steps, bends)
        slope = (p * g).sum(axis=1)
        p = np.where((slope < 0)[:, None], p, -g)  # a task whose curvature is lost starts anew
        slope = (p * g).sum(axis=1)
        if not steps:
            p, slope = p / np.maximum(norm, 1.0)[:, None], slope / np.maximum(norm, 1.0)
        scale = np.ones(len(tasks))
        while True:
            tried = [v + (a * scale)[:, None] * p for a in STEPS]
            fs, gs = losses(np.stack(tried))
            best, at = np.full(len(tasks), -1), np.arange(len(tasks))
            for i, a in reversed(list(enumerate(STEPS))):  # the longest step that lowers the loss enough
                # near the end a loss no longer shows differences; then the slope along the step decides
                flat = np.abs(fs[i] - f) <= 1e-14 * np.abs(f) + 1e-300
                fine = (fs[i] <= f + 1e-4 * a * scale * slope) | (flat & (np.abs((gs[i] * p).sum(axis=1)) <= 0.9 * np.abs(slope)))
                best = np.where(fine, i, best)
            best = np.where(norm < tol, 0, best)
            if (best >= 0).all() or scale.min() < 1e-12:
                break
            scale = np.where(best >= 0, scale, scale * STEPS[-1] / 4)
        moved = (best >= 0) & (norm >= tol)
        best = np.maximum(best, 0)
        new_v = np.where(moved[:, None], np.stack(tried)[best, at], v)
        new_g = np.where(moved[:, None], gs[best, at], g)
        f = np.where(moved, fs[best, at], f)
        steps, bends = [*steps, new_v - v][-MEMORY:], [*bends, new_g - g][-MEMORY:]
        v, g = new_v, new_g
        if not moved.any():
            break
    norm = np.sqrt((g * g).sum(axis=1))
    release(data)
    if norm.max() > max(100 * tol, 1e-6):
        raise RuntimeError(f"fit of {tasks[int(norm.argmax())]} has not converged: gradient norm {norm.max():.2e}")
    return spark.createDataFrame([(t, float(r[width]), r[:width].tolist()) for t, r in zip(tasks, v)], schema)


# ---- scoring ------------------------------------------------------------------------

def collect_weights(weights: DataFrame):
    """Bring a weight table (at most ``MAX_WEIGHT_CELLS`` numbers, see :func:`weight_chunks`) to the driver."""
    rows = weights.orderBy("task").collect()
    if not rows:
        raise ValueError("empty weight table")
    tasks = [r["task"] for r in rows]
    W = np.array([r["w"] for r in rows], dtype=np.float64)
    b = np.array([r["bias"] for r in rows], dtype=np.float64)
    return tasks, W, b


def weight_chunks(weights: DataFrame, max_cells: int = MAX_WEIGHT_CELLS) -> list[DataFrame]:
    """The weight table in runs of whole tasks of at most ``max_cells`` numbers (one task at least), counted first."""
    width = weights.agg(F.max(F.size("w"))).first()[0]
    if width is None:
        raise ValueError("empty weight table")
    names = sorted(r["task"] for r in weights.select("task").collect())
    per = max(1, max_cells // max(1, width))
    return [weights.where(F.col("task").isin(names[i:i + per])) for i in range(0, len(names), per)]


def _score_arrow(feats: DataFrame, weights: DataFrame, passes: int, dropout: float | None,
                 key_col: str, with_logit: bool, max_cells: int = MAX_WEIGHT_CELLS) -> DataFrame:
    weights = cut_lineage(weights)  # sized, then collected by chunk
    out = None
    for chunk in weight_chunks(weights, max_cells):
        part = _score_chunk(feats, chunk, passes, dropout, key_col, with_logit)
        out = part if out is None else out.unionByName(part)
    return out


def _score_chunk(feats: DataFrame, weights: DataFrame, passes: int, dropout: float | None,
                 key_col: str, with_logit: bool) -> DataFrame:
    tasks, W, b = collect_weights(weights)
    bc = broadcast(feats.sparkSession, (tasks, W, b))
    id_type = feats.schema["id"].dataType
    scale = 1.0 / (1.0 - dropout) if dropout else 1.0
    fields = [T.StructField("id", id_type), T.StructField("task", T.StringType())]
    if with_logit:
        fields += [T.StructField("z", T.DoubleType()), T.StructField("p", T.DoubleType())]
    else:
        fields += [T.StructField("ps", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(fields)
    # without dropout no mask is drawn, and no key is needed
    key = mask_key(key_col, feats.schema[key_col].dataType) if dropout else F.lit(0).cast("long")
    src = feats.select("id", key.alias("_key"), "x")

    def run(batches):
        tnames, Wm, bv = bc.value
        n_t = len(tnames)
        tarr = np.array(tnames, dtype=object)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            xcol = batch.column("x")
            width = Wm.shape[1]
            X = xcol.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if X.size != n * width:
                raise ValueError("feature arrays must all have the weight width")
            X = X.reshape(n, width)
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            take = pa.array(np.repeat(np.arange(n), n_t))
            ids = batch.column("id").take(take)
            task_col = pa.array(np.tile(tarr, n), type=pa.string())
            if with_logit:
                Z = X @ Wm.T + bv
                P = 1.0 / (1.0 + np.exp(-Z))
                yield pa.RecordBatch.from_arrays([ids, task_col, pa.array(Z.reshape(-1)), pa.array(P.reshape(-1))],
                                                 schema=pa.schema([pa.field("id", ids.type), pa.field("task", pa.string()),
                                                                   pa.field("z", pa.float64()), pa.field("p", pa.float64())]))
                continue
            out = np.empty((n, n_t, passes), dtype=np.float64)
            # row tiles bound the per-pass mask and product to SCORE_TILE x width
            for r in range(0, n, SCORE_TILE):
                rs = slice(r, r + SCORE_TILE)
                for k in range(passes):
                    Xk = X[rs] * keep_mask(keys[rs], k, width, dropout) * scale if dropout else X[rs]
                    out[rs, :, k] = 1.0 / (1.0 + np.exp(-(Xk @ Wm.T + bv)))
            offsets = pa.array(np.arange(0, n * n_t * passes + 1, passes, dtype=np.int32))
            ps = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, task_col, ps],
                                             schema=pa.schema([pa.field("id", ids.type), pa.field("task", pa.string()),
                                                               pa.field("ps", pa.list_(pa.float64()))]))

    return src.mapInArrow(run, schema)


def score_mc(feats: DataFrame, weights: DataFrame, passes: int = DEFAULT_PASSES,
             dropout: float = DEFAULT_DROPOUT, key_col: str = "id") -> DataFrame:
    """K stochastic passes per (id, task): ``(id, task, ps array<double>)``, ps ordered by pass."""
    return _score_arrow(feats, weights, passes, dropout, key_col, with_logit=False)


def _mask_expr(key, pass_no, j, dropout):
    """The dropout hash as a Spark expression (same integers as :func:`keep_mask`)."""
    P = F.lit(MASK_MOD).cast("long")
    h0 = F.pmod(F.pmod(key, P) * MASK_MUL_ID + pass_no.cast("long") * MASK_MUL_PASS
                + j.cast("long") * MASK_MUL_UNIT, P)
    return F.aggregate(F.array_repeat(F.lit(0), MASK_ROUNDS), h0,
                       lambda h, _: F.pmod(h * h + 7 * h + MASK_ADD, P)) < keep_below(dropout)


def score_mc_expr(feats: DataFrame, weights: DataFrame, passes: int = DEFAULT_PASSES,
                  dropout: float = DEFAULT_DROPOUT, key_col: str = "id") -> DataFrame:
    """:func:`score_mc` written with built-in array functions only (no Python workers).

    Same output and the same dropout hash.  The weight table travels as one
    array literal (size-checked like the Arrow path).  Higher-order array
    functions are evaluated row by row in the JVM, so this form is much slower
    than the per-batch matrix product; it exists for deployments without
    Python workers and as an independent check of the Arrow path.
    """
    tasks, W, b = collect_weights(weights)
    scale = 1.0 / (1.0 - dropout)
    Wl, bl = F.lit(W.tolist()), F.lit(b.tolist())
    key = mask_key(key_col, feats.schema[key_col].dataType)

    def probs_for_pass(k):
        xm = F.transform("x", lambda v, j: F.when(_mask_expr(key, k, j, dropout), v.cast("double") * scale)
                         .otherwise(F.lit(0.0)))
        return F.transform(F.sequence(F.lit(1), F.lit(len(tasks))), lambda t: F.lit(1.0) / (F.lit(1.0) + F.exp(-(
            F.aggregate(F.zip_with(xm, F.element_at(Wl, t), lambda a, w: a * w), F.lit(0.0), lambda acc, v: acc + v)
            + F.element_at(bl, t)))))

    m = feats.select("id", F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), probs_for_pass).alias("_m"))
    out = m.select("id", F.posexplode(F.lit(tasks)).alias("_t", "task"), "_m")
    return out.select("id", "task", F.transform("_m", lambda row: F.element_at(row, F.col("_t") + 1)).alias("ps"))


def score_deterministic(feats: DataFrame, weights: DataFrame) -> DataFrame:
    """One pass, dropout off: ``(id, task, z, p)`` with z the logit."""
    return _score_arrow(feats, weights, 1, None, "id", with_logit=True)


def explode_passes(preds: DataFrame) -> DataFrame:
    """Packed ``ps`` -> long ``(id, task, pass, p)``."""
    return preds.select("id", "task", F.posexplode("ps").alias("pass", "p"))


def _mean(ps: str = "ps"):
    return F.aggregate(ps, F.lit(0.0), lambda a, p: a + p) / F.size(ps)


def pred_mean_var(preds: DataFrame) -> DataFrame:
    """Mean and population variance over passes (np.mean / np.var), no shuffle."""
    m = _mean()
    d = preds.withColumn("mean", m)
    var = F.aggregate("ps", F.lit(0.0), lambda a, p: a + (p - F.col("mean")) * (p - F.col("mean"))) / F.size("ps")
    return d.select("id", "task", "mean", var.alias("var"))


def labelled_predictions(cells: DataFrame, preds: DataFrame) -> DataFrame:
    """True labels next to predictions, joined by key (never by position)."""
    return cells.where(F.col("y").isNotNull()).join(preds, ["id", "task"], "inner")
