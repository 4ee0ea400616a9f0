"""Troubleshooting trees as node tables: (tree_id, node_id, parent_id, branch, depth, question, solution, is_leaf, rate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import text as tx


def _node(
    node: Column, parent: Column | None, branch: str | None, depth: Column, question: Column,
    solution: Column | None, rate: Column,
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        node.alias("node_id"),
        (none if parent is None else parent).alias("parent_id"),
        (none if branch is None else F.lit(branch)).alias("branch"),
        depth.cast("int").alias("depth"),
        question.alias("question"),
        (none if solution is None else solution).alias("solution"),
        F.lit(solution is not None).alias("is_leaf"),
        rate.cast("double").alias("rate"),
    )


def _leaf(node: Column, parent: Column, branch: str, depth: Column, solution: Column) -> Column:
    return _node(node, parent, branch, depth, F.lit(fv.TREE_LEAF), solution, F.lit(fv.TREE_DEFAULT_RATE))


def _filled(template: str, **values: Column) -> Column:
    """Text template with columns put into its braces."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{%s}" % name), value.cast("string"))
    return out


def step_trees(solutions: DataFrame) -> DataFrame:
    """Tree of each solution: a single leaf, or a chain of yes/no steps with closing leaves.

    ``solutions``: tree_id, steps_text, rate.  All nodes of a row come from that
    row, so there is no shuffle.
    """
    rows = solutions.withColumn("steps", tx.split_steps("steps_text"))
    n, rate = F.size("steps"), F.col("rate")
    zero = F.lit(0)

    def step_nodes(text: Column, i0: Column) -> Column:
        i = i0 + 1
        me = F.concat(F.lit("step"), i.cast("string"))
        parent = F.when(i == 1, "root").otherwise(F.concat(F.lit("step"), (i - 1).cast("string")))
        step = _node(me, parent, "yes", i, _filled(fv.TREE_STEP, i=i, text=text), None, rate)
        failed = F.concat(F.lit("failed"), i.cast("string"))
        last = F.array(
            step,
            _leaf(F.concat(me, F.lit("-yes")), me, "yes", i + 1, F.lit(fv.TREE_DONE)),
            _leaf(F.concat(me, F.lit("-no")), me, "no", i + 1, F.lit(fv.TREE_LAST_NO)),
        )
        middle = F.array(
            step,
            _node(failed, me, "no", i + 1, F.lit(fv.TREE_FAILED), None, F.lit(fv.TREE_DEFAULT_RATE)),
            _leaf(F.concat(failed, F.lit("-yes")), failed, "yes", i + 2, F.lit(fv.TREE_RETURN)),
            _leaf(F.concat(failed, F.lit("-no")), failed, "no", i + 2, _filled(fv.TREE_CONTINUE, i=i + 1)),
        )
        return F.when(i == n, last).otherwise(middle)

    root = F.lit("root")
    single = F.array(_node(root, None, None, zero, F.lit(fv.TREE_SINGLE), F.element_at("steps", 1), rate))
    start = F.array(_node(root, None, None, zero, _filled(fv.TREE_ROOT, n=n), None, rate))
    chain = F.concat(start, F.flatten(F.transform("steps", step_nodes)))
    nodes = F.when(n == 1, single).otherwise(chain)
    return rows.select("tree_id", F.inline(nodes))


def _literal_nodes(rows: list[tuple], depth_of: dict[str, int]) -> list[Column]:
    none = F.lit(None).cast("string")
    out = []
    for node, parent, branch, question, solution in rows:
        is_leaf = solution is not None
        rate = fv.TREE_DEFAULT_RATE
        out.append(
            F.struct(
                F.lit(node).alias("node_id"),
                (none if parent is None else F.lit(parent)).alias("parent_id"),
                (none if branch is None else F.lit(branch)).alias("branch"),
                F.lit(depth_of[node]).alias("depth"),
                F.lit(question).alias("question"),
                (none if solution is None else F.lit(solution)).alias("solution"),
                F.lit(is_leaf).alias("is_leaf"),
                F.lit(rate).cast("double").alias("rate"),
            )
        )
    return out


def _depths(rows: list[tuple]) -> dict[str, int]:
    depth: dict[str, int] = {}
    for node, parent, *_ in rows:
        depth[node] = 0 if parent is None else depth[parent] + 1
    return depth


def unknown_trees(hashes: DataFrame, kb: DataFrame) -> DataFrame:
    """Three-node tree for every fingerprint without a knowledge row."""
    rows = fv.TREE_UNKNOWN
    nodes = F.array(*_literal_nodes(rows, _depths(rows)))
    missing = hashes.select("error_hash").distinct().join(kb.select("error_hash").distinct(), "error_hash", "left_anti")
    return missing.select(F.col("error_hash").alias("tree_id"), F.inline(nodes))


def category_trees(errors: DataFrame) -> DataFrame:
    """Category template per error with the recommended solution put into its place.

    ``errors``: tree_id, category, template, confidence.
    """
    by_category = None
    for category, rows in fv.CATEGORY_TREES.items():
        nodes = F.array(*_literal_nodes(rows, _depths(rows)))
        hit = F.col("category") == category
        by_category = F.when(hit, nodes) if by_category is None else by_category.when(hit, nodes)
    out = errors.select("tree_id", "category", "template", "confidence", F.inline(by_category))
    marker = "{template} | "
    fallback = F.replace("solution", F.lit(marker), F.lit(""))
    solution = F.when(F.col("solution").startswith(marker), F.coalesce("template", fallback)).otherwise(F.col("solution"))
    rate = F.when(F.col("parent_id").isNull(), F.col("confidence")).otherwise(F.col("rate"))
    return out.withColumn("solution", solution).withColumn("rate", rate).drop("template", "confidence")


def recommended_path(nodes: DataFrame) -> DataFrame:
    """Node order when always following the better rated child, yes on a tie.

    A tree's nodes, as many as its solution has steps, are gathered into one map
    per tree; a node lacking one of its children ends the path on the side of
    the missing child, as comparing with nothing chooses no.
    """
    child = lambda side, c: F.max(F.when(F.col("branch") == side, F.col(c)))
    choice = (
        nodes.filter(F.col("parent_id").isNotNull())
        .groupBy("tree_id", F.col("parent_id").alias("node_id"))
        .agg(child("yes", "node_id").alias("y"), child("no", "node_id").alias("n"),
             child("yes", "rate").alias("yr"), child("no", "rate").alias("nr"))
        .select("tree_id", "node_id", F.when(F.col("yr") >= F.col("nr"), F.col("y")).otherwise(F.col("n")).alias("next"))
        .filter(F.col("next").isNotNull())
        .groupBy("tree_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("node_id", "next"))).alias("choices"))
    )
    roots = nodes.filter(F.col("parent_id").isNull()).select("tree_id", F.col("node_id").alias("root"))
    empty = F.create_map().cast("map<string,string>")
    rows = roots.join(choice, "tree_id", "left").withColumn("choices", F.coalesce("choices", empty))

    def extend(path: Column, _: Column) -> Column:
        following = F.try_element_at("choices", F.element_at(path, -1))
        return F.when(following.isNotNull(), F.concat(path, F.array(following))).otherwise(path)

    steps = F.sequence(F.lit(1), F.size("choices") + 1)
    path = F.aggregate(steps, F.array("root"), extend)
    return rows.select("tree_id", F.posexplode(path).alias("pos", "node_id"))


def step_counts(nodes: DataFrame) -> DataFrame:
    """Steps along the yes chain of each tree."""
    is_step = ~F.col("is_leaf") & F.contains("question", F.lit("Step ")) & F.contains("question", F.lit(":"))
    return nodes.groupBy("tree_id").agg(F.sum(F.when(is_step, 1).otherwise(0)).alias("steps"))


def level_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id", "depth").agg(F.count("*").alias("nodes"))


def path_outcomes(steps: DataFrame) -> DataFrame:
    """Per node: uses, successful uses, rate, walks and, where steps are timed, the mean time spent there."""
    timed = [F.avg("seconds").alias("mean_seconds")] if "seconds" in steps.columns else []
    return steps.groupBy("node_id").agg(
        F.count("*").alias("times_used"),
        F.sum(F.when(F.col("was_successful"), 1).otherwise(0)).alias("successes"),
        F.avg(F.when(F.col("was_successful"), 1.0).otherwise(0.0)).alias("success_rate"),
        F.count_distinct("path_id").alias("walks"),
        *timed,
    )
