"""What the matching of records asks of the driver: no broadcasts of its own, and no job for each step of the calibration."""

import numpy as np
from kinmatch.llm import linkage, logistic
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def test_search_broadcasts_nothing(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    rows = spark.createDataFrame([(1, [1, 2], [9]), (2, [2, 3], [9]), (3, [4], [8])], "id long, terms array<long>, common array<long>")
    index = linkage.Index(rows, rows, 2)
    try:
        spark.conf.set(threshold, "-1")
        steps = [index.looked_up(index.queries.withColumn("floor", F.lit(0.0)), F.lit(0), F.size("t"), 2, 1), index.score(rows.select(F.col("id").alias("q"), F.col("id").alias("d")))]
        assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in steps)
    finally:
        spark.conf.set(threshold, before)
    assert {(r["q"], r["d"]) for r in index.nearest(1).collect()} == {(1, 1), (2, 2), (3, 3)}
    index.release()
    none = linkage.Index(rows, rows.limit(0))
    assert none.nearest(1).count() == 0
    none.release()


def test_regression_is_that_of_spark_in_few_jobs(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    x[:, 2] = 1.0  # the same in all rows: no weight
    y = (rng.random(600) < 1 / (1 + np.exp(1 - 3 * x[:, 0] + 2 * x[:, 1]))).astype(float)
    cols = ["a", "b", "c"]
    rows = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], [*cols, "y"]).cache()
    sc = spark.sparkContext
    sc.setJobGroup("fit", "fit")
    model = logistic.fit(rows, cols, "y")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("fit")) <= 4
    ready = VectorAssembler(inputCols=cols, outputCol="x").transform(rows)
    theirs = LogisticRegression(featuresCol="x", labelCol="y", regParam=logistic.L2, maxIter=50).fit(ready)
    assert np.allclose([model.base, *model.weights], [theirs.intercept, *theirs.coefficients], atol=1e-3)
    p = np.array([r[0] for r in rows.select(model.column(cols)).collect()])
    assert np.allclose(p, 1 / (1 + np.exp(-(model.base + x @ np.array(model.weights)))))
    assert logistic.fit(rows.where("y = 1"), cols, "y") is None
    assert logistic.fit(rows.limit(0), cols, "y") is None
