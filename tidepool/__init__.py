"""tidepool: pool-based active learning on large, sparsely labelled tables, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a small dict of
DataFrames) built from Spark SQL / DataFrame primitives.  Long tables are the
working form:

* ``cells(id, task, y)``            one row per observed or hidden label cell
* ``features(id, x array<float>)``   one row per key
* ``preds(id, task, ps array<double>)`` K stochastic passes packed per cell
* ``scores(id, task, score)``        acquisition matrix in long form

``run_id`` may lead every key so that many runs share one job.
"""

__version__ = "0.1.0"
