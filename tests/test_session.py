"""What is broadcast: named tables only."""

from pyspark.sql import functions as F

from kinmatch.core.session import cut
from kinmatch.llm.same_names import member_pairs


def writes(spark):
    """Plans of all writes so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
    return [p for p in plans if "InsertIntoHadoopFsRelation" in p]


def test_cut_broadcasts_only_what_is_named(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in names]
    a, b = (spark.range(40).withColumnRenamed("id", "k") for _ in range(2))
    assert cut(a.join(b, "k")).count() == 40
    plan = writes(spark)[-1]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert cut(a.join(F.broadcast(b), "k")).count() == 40
    plan = writes(spark)[-1]
    assert "BroadcastHashJoin" in plan
    assert [spark.conf.get(k, None) for k in names] == before


def test_pairs_of_a_group_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, g int")
    pairs = member_pairs(rows, "id", "g")
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
