"""op2: what Spark sizes too low does not pass through the driver."""
from pyspark.sql import functions as F

from tidepanel.llm import lines


def test_variants_are_not_broadcast(spark, monkeypatch):
    """Few lines of many characters: their variants look as small as the lines."""
    text = "\n".join("x" * 30 + f"{i:04d}" + "y" * 30 for i in range(40)) + "\n" + "z" * 400 + "\n" + "z" * 399
    plans, keep = [], lines.keep

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)
    monkeypatch.setattr(lines, "keep", watched)
    got = lines.decide(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("line_no").collect()
    assert [r.dropped for r in got][-2:] == [False, True] and got[-1].near
    [made] = [p for p in plans if "MapInArrow" in p]
    assert "Broadcast" not in made, made


def test_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c"), (None, "d"), (3, "e")], "key bigint, v string")
    assert sorted(r.v for r in lines.repeated(d, "key").collect()) == ["a", "c"]
    assert lines.repeated(d.withColumn("key", F.lit(7)), "key").columns == ["key", "v"]
