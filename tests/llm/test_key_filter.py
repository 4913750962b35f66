"""The bitmap that keeps rows out of a shuffle loses none that the join needs."""

from pyspark.sql import functions as F

from riskframe.llm.common import among, may_hold, shared_table
from riskframe.llm.quality_rules import drop_lines


def test_filter_passes_every_key_and_few_others(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("a"),
                                      (F.col("id") % 3).cast("string").alias("b"))
    keys = shared_table(rows.filter("a % 20 = 0 or (a is null and b = '1')").distinct(), "test-keys")
    passed = rows.filter(may_hold(keys, "a", "b")("a", "b"))
    assert passed.join(keys, rows.a.eqNullSafe(keys.a) & (rows.b == keys.b), "left_semi").count() \
        == rows.filter("a % 20 = 0 or (a is null and b = '1')").count()
    assert passed.count() < 2_400 + 40_000 / 16


def test_filter_of_no_keys_and_of_more_than_it_has_room_for(spark, monkeypatch):
    rows = spark.range(300_000).withColumnRenamed("id", "a")
    none = shared_table(rows.filter("a < 0"), "test-keys")
    assert among(rows, none, ["a"]).count() == 0
    monkeypatch.setattr("riskframe.llm.common.FILTER_PAGES", 2)
    many = shared_table(rows.filter("a % 2 = 0"), "test-keys")
    got = among(rows, many, ["a"])
    assert got.count() == 150_000 and got.filter("a % 2 = 1").isEmpty()


def test_texts_without_lines_to_drop_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i if i else None, f"keep {i}\nline two of {i}\nlast") for i in range(200)], "doc_id long, text string")
    listed = docs.filter("doc_id is null or doc_id = 5")
    drops = shared_table(listed.select(F.col("doc_id").alias("doc"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("th"),
                                       F.array(F.lit(1)).alias("at")), "test-drops")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = drop_lines(docs, drops, "doc_id", "text")
        got = {r.doc_id: r.text for r in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {i if i else None: f"keep {i}\nlast" if i in (0, 5) else f"keep {i}\nline two of {i}\nlast" for i in range(200)}
    # one side of the union never meets the drops
    assert plan.nodeName() == "Union"
    assert sorted("Join" in plan.children().apply(k).toString() for k in range(2)) == [False, True]
