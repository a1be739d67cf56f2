from pyspark.sql import functions as F

from partwright import session


def test_hot_values_join_the_same(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 1700)).alias("value"))
    mapping = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.upper("value")).filter("value != 'v7'")
    total = mapping.agg(F.sum("n").alias("t")).first()["t"]
    plain = {tuple(r) for r in rows.join(mapping.drop("n"), "value").select("id", "target").collect()}
    for bound in (0, 10_000_000):
        got = [tuple(r) for r in session.join_values(rows, mapping, ["value"], "n", total, bound).select("id", "target").collect()]
        assert len(got) == len(plain) and set(got) == plain


def test_cut_uses_the_shared_folder(spark):
    df = session.cut(spark.range(10))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir() and session.shared_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_salt_is_repeatable(spark):
    df = spark.range(100).select("id", session.salted("id", 8).alias("s"))
    assert df.collect() == df.collect() and {r.s for r in df.collect()} <= set(range(8))
