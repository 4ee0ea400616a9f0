"""Training points summed up before they meet, against the pairs one by one."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultmatch.functions import scoring as sc
from faultmatch.operators import clusters as cl, models as ml

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """One error with 40 equal knowledge rows, 2 others, and 300 ratings within two hours."""
    texts = ["Disk page corrupt error code 7"] * 40 + ["Disk page  corrupt error code 8", "login failed. now"]
    kb = spark.createDataFrame(
        [(str(i), "h1" if i < 41 else "h2", "disk page corrupt" if i < 41 else "login failed", t) for i, t in enumerate(texts)],
        "kb_id string, error_hash string, error_signature string, error_text string",
    )
    feedback = spark.createDataFrame(
        [(str(i), "h1" if i % 10 else "h2", None if i % 7 == 0 else i % 3 == 0, DAY + dt.timedelta(hours=i % 2, seconds=i)) for i in range(300)],
        "feedback_id string, solution_hash string, was_helpful boolean, created_at timestamp",
    )
    return kb, feedback


def test_groups_stand_for_all_pairs(tables):
    pairs, groups = ml.training_points(*tables), ml.point_groups(*tables)
    keys = ["error_hash", "error_signature", "category", "worked", "label", *sc.FEATURE_NAMES]
    one_by_one = pairs.groupBy(*keys).agg(F.max("created_at").alias("newest"), F.count("*").alias("weight"))
    assert groups.select(one_by_one.columns).exceptAll(one_by_one).count() == 0
    assert groups.count() == one_by_one.count() == 10 < pairs.count() == 232 * 41 + 25


def test_summaries_of_groups_are_those_of_pairs(tables):
    pairs, groups = ml.training_points(*tables), ml.point_groups(*tables)
    centres = cl.category_centres(pairs)
    a, b = cl.assign(pairs, centres), cl.assign(groups, centres)
    for f in (cl.member_rows, cl.keywords, cl.summary):
        first, second = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(m).collect()) for m in (a, b))
        assert first == second
    spread = {r["cluster"]: r for r in a.groupBy("cluster").agg(*[F.var_pop(n).alias(n) for n in sc.FEATURE_NAMES]).collect()}
    for r in cl.weighted_spread(b, sc.FEATURE_NAMES, "cluster").collect():
        assert [r[n] for n in sc.FEATURE_NAMES] == pytest.approx([spread[r["cluster"]][n] for n in sc.FEATURE_NAMES], abs=1e-9)


def test_tree_of_groups_is_that_of_pairs(tables):
    pairs, groups = ml.training_points(*tables), ml.point_groups(*tables)
    rows = groups.dropDuplicates(sc.FEATURE_NAMES).select("error_hash", *sc.FEATURE_NAMES)
    a, b = (ml.tree_prediction(ml.success_tree(p), rows).orderBy("error_hash", *sc.FEATURE_NAMES).collect() for p in (pairs, groups))
    assert a == b


def test_net_takes_weights_and_its_gradient_is_right(tables):
    from faultmatch.operators import net as nt

    rng = np.random.default_rng(1)
    outputs, sums = nt.layer_functions([3, 4, 2])
    w, x, label, weight = rng.normal(size=26), rng.normal(size=(7, 3)), np.array([0, 1, 1, 0, 1, 0, 1.0]), np.array([1, 2, 3, 1, 1, 5, 1.0])
    many = np.repeat(np.arange(7), weight.astype(int))
    assert np.allclose(sums(w, x, label, weight), sums(w, x[many], label[many], np.ones(len(many))))
    by_steps = [(sums(w + e, x, label, weight)[0] - sums(w - e, x, label, weight)[0]) / 2e-6 for e in np.eye(26) * 1e-6]
    assert np.allclose(sums(w, x, label, weight)[1:], by_steps, atol=1e-5)
    groups = ml.point_groups(*tables)
    net = ml.success_net(groups)
    out = ml.net_prediction(net, groups).withColumn("p", net.success([F.col(n) for n in sc.FEATURE_NAMES]))
    loss = out.agg(F.sum(-F.log(F.when(F.col("worked"), F.col("p")).otherwise(1 - F.col("p"))) * F.col("weight")) / F.sum("weight")).first()[0]
    keys = groups.groupBy(*sc.FEATURE_NAMES).agg(F.sum("weight").alias("n"), (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("r"))
    least = sum(-r["n"] * (q * np.log(q) if q else 0) for r in keys.collect() for q in (r["r"], 1 - r["r"])) / groups.agg(F.sum("weight")).first()[0]
    assert least <= loss + 1e-9 and loss < least + 0.01


def test_only_small_groups_are_filled_up_row_by_row(tables, monkeypatch):
    from faultmatch.queries import learning

    keys, whole = ["error_hash", "worked"], cl.augment
    given = SimpleNamespace(kb_texts=tables[0], feedback=tables[1].filter("solution_hash = 'h1' or feedback_id < 120"))
    points = learning.points(given)
    wanted = whole(points, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("synthetic").cast("long")).alias("synthetic"))
    sizes = []
    monkeypatch.setattr(cl, "augment", lambda rows, k: sizes.append(rows.groupBy(*k).count().agg(F.max("count")).first()[0]) or whole(rows, k))
    assert sorted(map(tuple, learning._augment(given).collect())) == sorted(map(tuple, wanted.collect()))
    assert sizes[0] < 50 <= points.groupBy(*keys).count().agg(F.max("count")).first()[0]
