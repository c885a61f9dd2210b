"""The distributed ranks against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postlabel.functions.text import shuffle_key
from postlabel.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of all rows in one group, the others in many.
    i = F.col("id")
    return spark.range(3000).select(
        i, F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), i % 20)).alias("g"), (i * 7919 % 101).alias("v")
    )


def _expected(df, order):
    window = Window.partitionBy("g").orderBy(*order)
    return {r["id"]: r["rank"] for r in df.withColumn("rank", F.row_number().over(window)).collect()}


def test_exact_rank(skewed):
    order = [F.col("v").desc(), F.col("id")]
    got = {r["id"]: r["rank"] for r in ranking.exact_rank(skewed, ["g"], order).collect()}
    assert got == _expected(skewed, order)


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_hash_rank(skewed, digits):
    rows = ranking.hash_rank(skewed, ["g"], "id", digits=digits).collect()
    assert {r["id"]: r["rank"] for r in rows} == _expected(skewed, [shuffle_key(F.col("id")), "id"])
    assert {r["group_rows"] for r in rows if r["g"] == "hot"} == {1000}


def test_null_groups_are_ranked_too(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id BIGINT, g STRING")
    assert ranking.hash_rank(df, ["g"], "id").count() == 3
    assert ranking.exact_rank(df, ["g"], [F.col("id")]).count() == 3


@pytest.mark.parametrize("spread_by", [(), ("id",)])
@pytest.mark.parametrize("k", [1, 10, 1500])
def test_top_per_group(skewed, k, spread_by, monkeypatch):
    order = [F.col("v").desc(), F.col("id")]
    want = {i: r for i, r in _expected(skewed, order).items() if r <= k}
    got = ranking.top_per_group(skewed, ["g"], order, k, spread_by=spread_by)
    assert {r["id"]: r["rank"] for r in got.collect()} == want
    assert got.columns == ["id", "g", "v", "rank"]


def test_small_k_is_pruned_before_the_shuffle(skewed, capsys):
    ranking.top_per_group(skewed, ["g"], [F.col("id")], 5).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("k", [7, 1500])
def test_first_rows(skewed, k):
    order = [F.col("v").desc(), F.col("id")]
    want = [r["id"] for r in skewed.orderBy(*order).limit(k).collect()]
    assert [r["id"] for r in ranking.first_rows(skewed, order, k, ["id"]).collect()] == want


def test_each_task_sends_k_rows_of_a_group_at_most(spark):
    """The shuffled rows of a salted top-k: tasks x k x groups."""
    df = spark.range(0, 40_000, 1, 4).select("id", (F.col("id") % 3).alias("g"))
    top = ranking.top_per_group(df, ["g"], [F.col("id").desc()], 80, spread_by=["id"])
    top.collect()
    plan = top._jdf.queryExecution().executedPlan()
    written = []

    def walk(node):
        if node.nodeName().startswith("Exchange"):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        for child in (node.children().apply(i) for i in range(node.children().size())):
            walk(child)
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())

    walk(plan)
    assert written and max(written) <= 4 * 80 * 3
    assert top.count() == 240
