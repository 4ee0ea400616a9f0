"""Teaching: upsert into the knowledge base and version history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.operators.ranking import running_sums


def batch_steps(teach: DataFrame) -> DataFrame:
    """Steps taught per fingerprint: distinct, in order of first appearance.

    Equal steps are reduced before they are gathered, so many teachings of one
    error cost no more than its distinct steps.
    """
    seen = (
        teach.select("error_hash", "ts", "teach_id", F.posexplode("steps").alias("pos", "step"))
        .groupBy("error_hash", "step")
        .agg(F.min(F.struct("ts", "teach_id", "pos")).alias("first"))
    )
    steps = F.transform(F.sort_array(F.collect_list(F.struct("first", "step"))), lambda s: s["step"])
    origin = ["ts", "teach_id", "raw_text", "error_signature", *(["embedding"] if "embedding" in teach.columns else [])]
    first = teach.groupBy("error_hash").agg(F.min_by(F.struct(*origin), F.struct("ts", "teach_id")).alias("origin"))
    return seen.groupBy("error_hash").agg(steps.alias("new_steps")).join(first, "error_hash")


def teach(kb: DataFrame, taught: DataFrame) -> DataFrame:
    """The knowledge base after a batch: matching rows gain the new steps, other errors become rows.

    Every column of ``kb`` stays; only the steps and notes of matching rows
    change.  A taught ``embedding`` goes into the new row.
    """
    new = batch_steps(taught)
    if "notes" not in kb.columns:
        kb = kb.withColumn("notes", F.lit(None).cast("string"))
    old = F.coalesce("resolution_steps", F.array().cast("array<string>"))
    hit = F.col("new_steps").isNotNull()
    kept = kb.join(new.select("error_hash", "new_steps"), "error_hash", "left").withColumns({
        "resolution_steps": F.when(hit, F.array_distinct(F.concat(old, "new_steps"))).otherwise(F.col("resolution_steps")),
        "notes": F.when(hit, F.lit(fv.TEACH_NOTES_MERGED)).otherwise(F.col("notes")),
    })
    values = {
        "kb_id": F.concat(F.lit("t"), "origin.teach_id"), "error_hash": F.col("error_hash"),
        "error_signature": F.col("origin.error_signature"), "error_text": F.col("origin.raw_text"),
        "resolution_steps": F.col("new_steps"), "created_at": F.col("origin.ts"),
        "source": F.lit(fv.TEACH_SOURCE), "notes": F.lit(fv.TEACH_NOTES_NEW),
    }
    if "embedding" in taught.columns:
        values["embedding"] = F.col("origin.embedding")
    added = new.join(kb.select("error_hash").distinct(), "error_hash", "left_anti")
    rows = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kb.schema.fields]
    return kept.select(*kb.columns).unionByName(added.select(*rows))


def version_rows(checked: DataFrame, kb: DataFrame) -> DataFrame:
    """One history row per teaching, of the first knowledge row of its error or the one that the batch makes.

    ``checked`` carries the conflict flag and, where known, the ``author``.
    """
    first = kb.groupBy("error_hash").agg(F.min(F.struct("created_at", "kb_id")).alias("old"))
    made = checked.groupBy("error_hash").agg(F.min(F.struct("ts", "teach_id")).alias("new"))
    entry = F.coalesce("old.kb_id", F.concat(F.lit("t"), "new.teach_id"))
    rows = checked.join(made, "error_hash").join(first, "error_hash", "left")
    return rows.select(
        F.concat(F.lit("v"), "teach_id").alias("version_id"),
        entry.alias("kb_entry_id"),
        "error_hash",
        F.col("steps").alias("resolution_steps"),
        F.col("ts").alias("created_at"),
        (F.col("author") if "author" in checked.columns else F.lit(None)).cast("string").alias("created_by"),
        F.when(F.col("has_conflicts"), "alternative").otherwise("create").alias("change_type"),
        F.lit(None).cast("string").alias("parent_version"),
        F.lit(fv.VERSION_CONFIDENCE).alias("confidence_score"),
        F.lit(0).alias("feedback_count"),
        F.lit(True).alias("is_active"),
    )


def version_timeline(versions: DataFrame) -> DataFrame:
    """Ordinal, predecessor and latest flag of the active versions of each error."""
    numbered = running_sums(
        versions.filter("is_active"), ["error_hash"], [F.col("created_at"), F.col("version_id")],
        F.date_trunc("day", "created_at"), {"ordinal": F.lit(1)},
    ).select("error_hash", "version_id", "created_at", "ordinal")
    previous = numbered.select(
        "error_hash", (F.col("ordinal") + 1).alias("ordinal"), F.col("version_id").alias("previous_version")
    )
    last = numbered.groupBy("error_hash").agg(F.max("ordinal").alias("last"))
    return (
        numbered.join(previous, ["error_hash", "ordinal"], "left")
        .join(last, "error_hash")
        .withColumn("is_latest", F.col("ordinal") == F.col("last"))
        .drop("last")
    )


def training_rows(kb: DataFrame, feedback: DataFrame, n: int | None = fv.TRAINING_ROWS) -> DataFrame:
    """Rated (was_helpful known) feedback with its knowledge text, newest first; ``None`` takes all."""
    rows = kb.select("kb_id", "error_hash", "error_text", "error_signature").join(
        feedback.filter(F.col("was_helpful").isNotNull()).select(
            "feedback_id", F.col("solution_hash").alias("error_hash"), "was_helpful", "created_at"
        ),
        "error_hash",
    )
    if n is None:
        return rows
    return rows.orderBy(F.col("created_at").desc(), "feedback_id", "kb_id").limit(n)
