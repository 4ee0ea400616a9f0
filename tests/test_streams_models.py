"""Streaming twins over out-of-order files, trained models by invariants, registered queries."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from faultmatch.functions import scoring as sc
from faultmatch.operators import clusters as cl, feedback as fb, models as ml
from faultmatch.sources.fixtures import VIEWS
from faultmatch.streaming import jobs


@pytest.fixture(scope="module")
def event_files(spark, fixtures):
    """The events as several files; the streams read them a file at a time, not in time order."""
    folder = tempfile.mkdtemp(prefix="events-")
    parts = 4
    for i in range(parts):
        rows = fixtures.events.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == i).coalesce(1)
        rows.write.parquet(os.path.join(folder, f"part{i}"))
    return folder


def stream(spark, folder, schema, late_first=False):
    return jobs.read_files(spark, os.path.join(folder, "part*"), schema, per_batch=1)


def test_security_hours_equal_batch(spark, fixtures, event_files):
    log = spark.sql(VIEWS["security_raw"], events=stream(spark, event_files, fixtures.events.schema))
    # files interleave in time, so the allowed lateness spans the month
    got = jobs.security_per_hour(log, late="40 days")
    want = fixtures.security_log.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "event_type").agg(F.count("*").alias("events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_after_the_watermark(spark):
    folder = tempfile.mkdtemp(prefix="late-")
    schema = "event_type string, created_at timestamp"
    for i, ts in enumerate(["2024-01-02 12:00:00", "2024-01-03 00:00:00", "2024-01-01 00:00:00"]):
        spark.sql(f"SELECT 'QUERY' AS event_type, TIMESTAMP'{ts}' AS created_at").coalesce(1).write.parquet(f"{folder}/p{i}")
        for name in os.listdir(f"{folder}/p{i}"):
            os.utime(f"{folder}/p{i}/{name}", (1_700_000_000 + i * 100,) * 2)
    s = jobs.read_files(spark, f"{folder}/p*", spark.createDataFrame([], schema).schema, per_batch=1)
    hours = {str(r["hour"]) for r in jobs.security_per_hour(s, late="1 hour").collect()}
    assert hours == {"2024-01-02 12:00:00", "2024-01-03 00:00:00"}


def test_solution_stats_equal_batch(spark, fixtures, event_files):
    hashes = fixtures.kb_texts.select("kb_id", F.col("error_hash").alias("solution_hash"), "error_signature")
    ratings = spark.sql(VIEWS["feedback_raw"], events=stream(spark, event_files, fixtures.events.schema), part=fixtures.part).join(hashes, "kb_id")
    got = {r["solution_hash"]: (round(r["success_rate"], 9), r["feedback_count"]) for r in jobs.solution_stats(ratings).collect()}
    want = {r["solution_hash"]: (round(r["success_rate"], 9), r["feedback_count"]) for r in fb.solution_stats(fixtures.feedback).collect()}
    assert got == want


def test_streams_start_again_where_they_stopped(spark, fixtures, tmp_path):
    """New files alone are read; the result equals the batch over all files and keeps two versions at most."""
    schema, batches = fixtures.events.schema, [fixtures.events.filter(f"event_id % 5 = {k}") for k in range(5)]
    hashes = fixtures.kb_texts.select("kb_id", F.col("error_hash").alias("solution_hash"), "error_signature")

    def ratings(events):
        return spark.sql(VIEWS["feedback_raw"], events=events, part=fixtures.part).join(hashes, "kb_id")

    for k, part in enumerate(batches):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
        got = jobs.solution_stats(
            ratings(jobs.read_files(spark, str(tmp_path / "in" / "part*"), schema, per_batch=1)), path=str(tmp_path / "job")
        )
        seen = fixtures.events.filter(f"event_id % 5 <= {k}")
        key = lambda r: (r["solution_hash"], round(r["success_rate"], 9), r["feedback_count"], round(r["conflict_rate"], 9))
        assert sorted(map(key, got.collect())) == sorted(map(key, fb.solution_stats(ratings(seen)).collect()))
    offsets = [f for f in os.listdir(tmp_path / "job" / "progress" / "offsets") if f.isdigit()]
    assert len(offsets) == 5
    assert len([f for f in os.listdir(tmp_path / "job" / "out") if f.startswith("version=")]) <= 2


def test_incremental_index_is_idempotent(spark, fixtures):
    folder, path = tempfile.mkdtemp(prefix="vec-"), tempfile.mkdtemp(prefix="idx-")
    rows = fixtures.embeddings.select(F.col("vec_id").cast("string").alias("kb_id"), "embedding")
    rows.filter("kb_id < '3'").coalesce(1).write.parquet(f"{folder}/a")
    read = lambda: jobs.read_files(spark, f"{folder}/*", rows.schema, per_batch=1)
    first = jobs.index_vectors(read(), path).count()
    rows.coalesce(1).write.parquet(f"{folder}/b")
    second = jobs.index_vectors(read(), path)
    assert first < second.count() == second.select("kb_id").distinct().count() == rows.count()
    assert jobs.index_vectors(read(), path).count() == rows.count()


@pytest.fixture(scope="module")
def points(fixtures):
    return ml.training_points(fixtures.kb_texts, fixtures.feedback).persist()


def test_clusters(points):
    centres = ml.cluster_centres(points)
    assert 1 <= len(centres.ids) <= 10
    members = cl.assign(points, centres)
    assert cl.summary(members).agg(F.sum("size")).first()[0] == points.count()
    shares = cl.variance_shares(members).groupBy("cluster").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 or r["s"] == 0 for r in shares)


def test_tree_and_net(points):
    tree, net = ml.success_tree(points), ml.success_net(points, scale=True)
    majority = points.agg(F.greatest(F.avg("label"), 1 - F.avg("label"))).first()[0]
    hits = ml.tree_prediction(tree, points).agg(F.avg((F.col("tree_works") == F.col("worked")).cast("double"))).first()[0]
    assert hits >= majority
    shares = ml.split_importance(tree)
    assert abs(sum(s for _, _, s in shares) - 1) < 1e-9 and {n for n, _, _ in shares} <= set(sc.FEATURE_NAMES)
    bad = ml.net_prediction(net, points).filter("neural_confidence < 0 or neural_confidence > 1").count()
    assert bad == 0


def test_category_classifier_beats_the_majority(points):
    out = ml.category_classifier(points).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    largest = points.groupBy("category").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert out > largest


def test_augment_fills_small_groups(points):
    few = points.filter("category = 'nullref'").orderBy("feedback_id").limit(7)
    out = cl.augment(few, ["category"]).persist()
    assert out.count() == 50 and out.filter("synthetic").count() == 43
    base = {r["kb_id"]: r["length"] for r in few.collect()}
    assert all(abs(r["length"] - base[r["kb_id"]]) <= 0.05 for r in out.collect())
    again = cl.augment(few, ["category"])
    assert out.exceptAll(again).count() == 0


def test_cascade_gives_one_row_per_query(spark, fixtures):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() == rows.select("query_id").distinct().count() == fixtures.incoming.count()
    layers = {r["layer"] for r in rows.select("layer").distinct().collect()}
    assert {1, 2} <= layers


def test_stream_reads_a_table_that_is_a_folder_or_a_file(spark, tmp_path):
    rows = spark.range(20).select("id", F.lit(None).cast("string").alias("note"))
    rows.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("many", "one"):
        stream = jobs.read_files(spark, str(tmp_path), rows.schema, f"{name}.parquet")
        out = str(tmp_path / f"out_{name}")
        stream.writeStream.option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start(out, "parquet").awaitTermination()
        assert spark.read.parquet(out).count() == 20
