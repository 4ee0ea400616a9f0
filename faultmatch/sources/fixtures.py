"""Knowledge, feedback, audit and input tables derived from the given parquet tables.

Each view is one SQL text over the given tables, with the tables named in braces.
Every row of a table takes part.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultmatch.functions import text as tx
from faultmatch.session import stored

AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "kb_raw": """
SELECT CAST(p_partkey AS STRING) AS kb_id,
  concat(CASE CAST(p_partkey % 10 AS INT)
    WHEN 0 THEN 'Connection timeout expired while opening database network session'
    WHEN 1 THEN 'Login failed for user ''app.svc'' on server'
    WHEN 2 THEN 'Permission denied on object orders schema dbo'
    WHEN 3 THEN 'Object reference was null in batch loader'
    WHEN 4 THEN 'Transaction deadlock detected during update of ledger'
    WHEN 5 THEN 'Query timeout while scanning partition'
    WHEN 6 THEN 'Invalid syntax near keyword in statement'
    WHEN 7 THEN 'Disk page corrupt in storage file'
    WHEN 8 THEN 'Authentication token rejected for ops@corp.example.com'
    ELSE 'Unexpected condition in worker process' END,
    ' error code ', CAST(p_partkey % 40 AS STRING),
    CASE WHEN p_partkey <= 10 THEN '' ELSE concat(' item ', p_name, ' ref',
      substring(md5(CAST(p_partkey % 500 AS STRING)), 1, 6)) END) AS error_text,
  CASE WHEN p_partkey % 11 = 0 THEN ''
    WHEN p_partkey % 3 = 0 THEN concat('1. Check ', p_brand, chr(10), '2. Restart ', p_type, chr(10), '3. Retry')
    ELSE concat('Restart ', p_type) END AS steps_text,
  CASE p_partkey % 4 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'pattern_match' WHEN 2 THEN 'openai_enhanced' END AS solution_source,
  CAST(p_size AS DOUBLE) / 50 AS confidence_score,
  TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE AS created_at
FROM {part}""",
    "feedback_raw": """
SELECT CAST(event_id AS STRING) AS feedback_id, concat('s', CAST(user_id AS STRING)) AS session_id,
  CAST(1 + (event_id * 37) % (SELECT CAST(floor(count(*) * 0.75) AS BIGINT) FROM {part}) AS STRING) AS kb_id,
  CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'exact_match' WHEN 1 THEN 'enhanced_fuzzy_keyword' WHEN 2 THEN 'enhanced_fuzzy_search'
    WHEN 3 THEN 'advanced_scalable_vector' WHEN 4 THEN 'pattern_match' ELSE 'comprehensive_ml' END AS solution_source,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type <> 'error' AND value < 60 END AS was_helpful,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS DOUBLE) END AS confidence_rating,
  ts AS created_at
FROM {events}""",
    "security_raw": """
SELECT CAST(event_id AS STRING) AS event_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'SQL_INJECTION_ATTEMPT' WHEN 'signup' THEN 'RATE_LIMIT_EXCEEDED'
    WHEN 'purchase' THEN 'ERROR_ANALYSIS' WHEN 'view' THEN 'SEARCH' ELSE 'QUERY' END AS event_type,
  CAST(user_id AS STRING) AS user_id
FROM {events}""",
    "incoming": """
SELECT CAST(c_custkey AS STRING) AS query_id,
  CASE WHEN c_custkey % 50 = 2 THEN concat(c_name, ' union select 1')
    WHEN c_custkey % 50 = 3 THEN concat('zzzz ', c_name)
    WHEN c_custkey % 50 = 4 THEN concat('<script> failed ', c_name)
    WHEN c_custkey % 50 = 5 THEN ''
    WHEN c_custkey % 50 = 6 THEN concat('run xp_cmdshell; "', c_name, '"')
    WHEN c_custkey % 50 = 7 THEN concat('slow ', c_mktsegment, ' batch; it''s <b>', c_name)
    WHEN c_custkey % 4 = 0 THEN concat(replace(k.error_text, 'nn', 'n'), ' retry')
    WHEN c_custkey % 4 = 1 THEN upper(k.error_text)
    ELSE k.error_text END AS raw_text,
  CAST(c_custkey % 20 AS STRING) AS user_id,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('s', CAST(c_custkey % 30 AS STRING)) END AS session_id,
  TIMESTAMP '2024-01-30 00:00:00' + (c_custkey % 1440) * INTERVAL '1' MINUTE AS ts
FROM {customer} JOIN {kb_raw} k ON k.kb_id = CAST(c_custkey AS STRING)""",
    "patterns": """
SELECT pattern_id, pattern_regex, priority, CAST(effectiveness AS DOUBLE) AS effectiveness_score, usage_count,
  concat('Apply rule ', pattern_id, chr(10), 'Confirm') AS steps_text
FROM (VALUES ('p1', 'timeout (expired|while)', 10, 0.8, 12), ('p2', 'login failed', 20, 0.6, 40),
  ('p3', 'deadlock', 5, 0.9, 3), ('p4', 'syntax|corrupt', 5, 0.4, 0), ('p5', '^zzzz', 1, 0.5, 7))
  AS t(pattern_id, pattern_regex, priority, effectiveness, usage_count)""",
    "teachings": """
SELECT CAST(c_custkey AS STRING) AS teach_id,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Novel fault near ', c_name) ELSE k.error_text END AS raw_text,
  CASE WHEN c_custkey % 31 = 0 THEN chr(10)
    ELSE concat('Check ', c_mktsegment, chr(13), chr(10), chr(10), 'Restart') END AS steps_text,
  TIMESTAMP '2024-01-30 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS ts, concat('u', CAST(c_custkey % 20 AS STRING)) AS author
FROM {customer} JOIN {kb_raw} k ON k.kb_id = CAST(c_custkey - c_custkey % 3 AS STRING)""",
    "answers": """
SELECT conv_id, turn, concat('Intro', chr(10), '1. ', replace(text, chr(10), ' '), chr(10),
  '  - ', role, chr(10), '4. not extracted') AS answer
FROM {conversations}""",
    "tree_steps": """
SELECT conv_id AS path_id, turn AS step_no,
  concat('n', CAST(turn AS STRING), '-', CAST(conv_id % 5 AS STRING)) AS node_id,
  length(text) % 3 <> 0 AS decision, conv_id % 4 <> 0 AS was_successful, length(text) % 60 AS seconds,
  concat('s', CAST(conv_id % 7 AS STRING)) AS session_id, md5(CAST(conv_id % 11 AS STRING)) AS error_hash,
  concat('u', CAST(conv_id % 3 AS STRING)) AS created_by
FROM {conversations}""",
    "cache": """
SELECT concat('q', CAST(user_id AS STRING)) AS cache_key, max(ts) AS created_at, CAST(count(*) AS INT) AS hit_count,
  max(ts) AS last_accessed, concat('r', CAST(max(event_id) AS STRING)) AS query_hash
FROM {events} WHERE event_type = 'view' GROUP BY user_id""",
    "lookups": """
SELECT CAST(event_id AS STRING) AS lookup_id, concat('q', CAST(user_id + event_id % 3 AS STRING)) AS cache_key, ts
FROM {events} WHERE event_type = 'click'""",
    "new_results": """
SELECT concat('q', CAST(user_id * 2 AS STRING)) AS cache_key, concat('n', CAST(max(event_id) AS STRING)) AS query_hash
FROM {events} WHERE event_type = 'purchase' GROUP BY user_id""",
}

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def results_of(name: Column) -> Column:
    """A result list that tells the hash it belongs to."""
    first = F.struct(F.concat(F.lit("a"), name).alias("error_hash"), F.lit(0.9).alias("similarity"))
    return F.array(first, F.struct(F.concat(F.lit("b"), name).alias("error_hash"), F.lit(0.8).alias("similarity")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions for all cores.

    Files of a few row groups are read by as many tasks, but the texts made of
    their rows cost far more than reading them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


class Fixtures:
    """The given tables and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._steps: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step that several parts of a query read, worked out when it is first asked for."""
        if name not in self._steps:
            self._steps[name] = build()
        return self._steps[name]

    def hold(self, name: str) -> None:
        """From now on the view ``name`` and those made of it read rows that are worked out once."""
        self.__dict__[name] = self.once(name, lambda: stored(getattr(self, name), name))

    def _load(self, name: str) -> DataFrame:
        if name in GIVEN:
            df = self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))
            for field in df.schema.fields:
                if field.dataType.typeName() == "timestamp_ntz":
                    df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
            return spread(df)
        return self._view(name)

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = [n for n in GIVEN + list(VIEWS) if "{%s}" % n in sql]
        return self.spark.sql(sql, **{n: self.table(n) for n in used})

    @cached_property
    def kb(self) -> DataFrame:
        """Knowledge base: texts, signature, hash, steps, embedding."""
        vectors = self.table("embeddings").select(F.col("vec_id").cast("string").alias("kb_id"), "embedding")
        return (
            self.table("kb_raw")
            .withColumn("error_signature", tx.normalize("error_text"))
            .withColumn("error_hash", tx.fingerprint("error_signature"))
            .withColumn("resolution_steps", tx.teach_steps("steps_text"))
            .join(vectors, "kb_id", "left")
        )

    @cached_property
    def kb_texts(self) -> DataFrame:
        """The knowledge base without its embeddings."""
        return (
            self.table("kb_raw")
            .withColumn("error_signature", tx.normalize("error_text"))
            .withColumn("error_hash", tx.fingerprint("error_signature"))
            .withColumn("resolution_steps", tx.teach_steps("steps_text"))
        )

    @cached_property
    def kb_table(self) -> DataFrame:
        """The knowledge base in the columns of its table, every second row with notes of its own."""
        from faultmatch.sources import tables

        own = self.kb.drop("steps_text").withColumn("source", F.lit("seed"))
        return tables.fit(own.withColumn("notes", F.when(F.col("kb_id").cast("long") % 2 == 0, F.concat(F.lit("note "), "kb_id"))), "kb")

    @cached_property
    def result_cache(self) -> DataFrame:
        """The cache with its results."""
        return self.table("cache").withColumn("results", results_of(F.col("query_hash")))

    @cached_property
    def found_results(self) -> DataFrame:
        """New results for some keys."""
        return self.table("new_results").withColumn("results", results_of(F.col("query_hash")))

    @cached_property
    def feedback(self) -> DataFrame:
        hashes = self.kb_texts.select("kb_id", F.col("error_hash").alias("solution_hash"), "error_signature")
        return self.table("feedback_raw").join(hashes, "kb_id").drop("kb_id")

    @cached_property
    def incoming(self) -> DataFrame:
        return self.table("incoming")

    @cached_property
    def queries(self) -> DataFrame:
        """Incoming rows with signature, hash and, where there is one, an embedding."""
        vectors = self.table("embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
        return (
            self.incoming.withColumn("signature", tx.normalize("raw_text"))
            .withColumn("error_hash", tx.fingerprint("signature"))
            .join(vectors, "query_id", "left")
        )

    @cached_property
    def security_log(self) -> DataFrame:
        from faultmatch.functions import security as sec

        return self.table("security_raw").withColumn("severity", sec.severity("event_type"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in GIVEN:
            return self.table(name)
        raise AttributeError(name)
