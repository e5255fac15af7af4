"""Registered dataset-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.operators import datasets as od
from tensorloom.plans.catalog import register, table
from tensorloom.plans.scans import shuffled_rank
from tensorloom.sources.datasets import labelled


@register(
    "labelled_scan",
    "SELECT doc_id AS label, strlen(text)::INTEGER AS payload_bytes, md5(text) AS payload_md5 FROM documents",
)
def labelled_scan(spark, sf_dir):
    nested = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct(F.encode("text", "UTF-8").alias("bytes"), F.col("source").alias("path")).alias("image")
    )
    return labelled(nested).select(
        "label", F.length("payload").alias("payload_bytes"), F.md5("payload").alias("payload_md5")
    )


@register(
    "class_predicate",
    "SELECT vec_id, label IN (0, 1) AS positive FROM embeddings",
)
def class_predicate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", od.is_positive(F.col("label"), (0, 1)).alias("positive")
    )


BALANCED = """r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id)) AS rk,
  count(*) FILTER (quality = 0) OVER () AS p FROM labels),
  b AS (SELECT doc_id, quality FROM r WHERE quality = 0 OR rk <= p)"""


@register("balanced_sample", f"WITH {BALANCED} SELECT doc_id, quality FROM b")
def balanced_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return od.balanced_sample(rows, "doc_id", F.col("quality") == 0, 7).select("doc_id", "quality")


@register(
    "late_payload_load",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label = 0 ORDER BY md5('7:' || vec_id)) AS rk,
    count(*) FILTER (label = 0) OVER () AS p FROM embeddings)
    SELECT e.vec_id, e.label, round(list_sum(e.embedding::DOUBLE[]), 6) AS total FROM embeddings e JOIN r USING (vec_id)
    WHERE e.label = 0 OR rk <= p""",
)
def late_payload_load(spark, sf_dir):
    """Choose on (id, label) alone; the payload is read once behind the cut-off."""
    rows = table(spark, sf_dir, "embeddings")
    chosen = od.balanced_sample(rows, "vec_id", F.col("label") == 0, 7)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return chosen.select("vec_id", "label", F.round(total, 6).alias("total"))


@register(
    "seeded_shuffle",
    """SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id)) - 1 AS position FROM documents""",
)
def seeded_shuffle(spark, sf_dir):
    return shuffled_rank(table(spark, sf_dir, "documents").select("doc_id"), 9, "doc_id", "position")


@register(
    "holdout_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('3:' || doc_id)) <= count(*) OVER () * 15 // 100
    THEN 'validation' ELSE 'training' END AS part FROM documents""",
)
def holdout_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    out = od.held_out(rows, "doc_id", 3)
    return rows.select("doc_id", F.when(out, "validation").otherwise("training").alias("part"))


CURSOR = """c AS (SELECT doc_id, quality, epoch, epoch * count(*) OVER (PARTITION BY epoch) +
  row_number() OVER (PARTITION BY epoch ORDER BY md5('9:' || epoch || ':' || doc_id)) - 1 AS position
  FROM labels, range(3) t(epoch))"""


def cursor_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return od.cursor(rows, "doc_id", 9, 3)


@register(
    "fixed_batches",
    f"""WITH {CURSOR} SELECT position // 4 AS batch, string_agg(doc_id, ',' ORDER BY position) AS members,
    count(*) AS slots FROM c GROUP BY ALL""",
)
def fixed_batches(spark, sf_dir):
    rows = od.batches(cursor_rows(spark, sf_dir), "position")
    members = F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "doc_id"))), lambda m: m["doc_id"].cast("string")
    )
    return rows.groupBy("batch").agg(F.array_join(members, ",").alias("members"), F.count(F.lit(1)).alias("slots"))


@register("cyclic_cursor", f"WITH {CURSOR} SELECT doc_id, epoch::INTEGER AS epoch, position FROM c")
def cyclic_cursor(spark, sf_dir):
    return cursor_rows(spark, sf_dir).select("doc_id", "epoch", "position")


@register(
    "micro_batches",
    f"""WITH {CURSOR}, b AS (SELECT DISTINCT position // 4 AS batch, (position // 4) // 16 AS step FROM c),
    z AS (SELECT step, count(*) AS n FROM b GROUP BY step)
    SELECT batch, step, CASE WHEN n % 2 = 0 THEN (batch % 16) // greatest(n // 2, 1) END AS replica,
      CASE WHEN n % 2 = 0 THEN (batch % 16) % greatest(n // 2, 1) END AS micro,
      CASE WHEN n % 2 <> 0 THEN 'micro-batches cannot be split across replicas' END AS error FROM b JOIN z USING (step)""",
)
def micro_batches(spark, sf_dir):
    rows = od.batches(cursor_rows(spark, sf_dir), "position").select("batch").distinct()
    return od.micro_batches(rows, "batch", 8, 2)


@register(
    "two_passes",
    "SELECT doc_id, unnest(['up', 'down']) AS side, quality FROM labels",
)
def two_passes(spark, sf_dir):
    return od.two_passes(table(spark, sf_dir, "labels").select("doc_id", "quality"))
