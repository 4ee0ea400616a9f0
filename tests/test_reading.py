"""How the given tables are read, and what joins on fingerprints cost."""

from conftest import SF
from pyspark.sql import functions as F

from faultmatch.functions import text as tx
from faultmatch.operators import candidates as ca
from faultmatch.session import configure
from faultmatch.sources.fixtures import Fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_are_spread_over_all_cores(spark):
    part = Fixtures(spark, SF).table("part")
    assert part.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(part.collect()) == sorted(spark.read.parquet(f"{SF}/part.parquet").collect())


def test_broadcasts_are_not_planned_by_the_size_of_files(spark, tmp_path):
    """Files of 1 MB stand for rows of 200 MB; both sides are of that kind."""
    path = str(tmp_path / "t.parquet")
    configure(spark)
    spark.range(300_000).write.parquet(path)
    wide = spark.read.parquet(path).select("id", F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"))
    assert "BroadcastHashJoin" not in plan(wide.join(wide.withColumnRenamed("text", "other"), "id"))


def test_fingerprints_are_not_worked_out_twice_for_a_join(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select(tx.fingerprint(tx.normalize("p_name")).alias("error_hash"))
    assert "isnotnull(sha2" not in plan(rows.join(rows.groupBy("error_hash").count(), "error_hash"))
    assert spark.createDataFrame([(None,)], "t string").select(tx.fingerprint("t")).first()[0] == (
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    )


def test_rows_of_equal_texts_are_all_counted(spark):
    kb = spark.createDataFrame(
        [("1", "disk full", None), ("2", "disk full", None), ("3", "disk full", ""), ("4", None, "full-disk"), ("5", "", "")],
        "kb_id string, error_signature string, error_text string",
    )
    needles = spark.createDataFrame([("disk",), ("full",), ("none",)], "token string")
    got = ca.token_frequency(needles, kb, ["error_signature", "error_text"])
    assert sorted(map(tuple, got.collect())) == [("disk", 4), ("full", 4)]
