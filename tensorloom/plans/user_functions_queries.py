"""Registered queries for the user-function surface."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te
from tensorloom.operators import tensors as ot
from tensorloom.operators import user_functions as uf
from tensorloom.plans.catalog import register, table
from tensorloom.plans.graphs_queries import DELIVERED, deliveries
from tensorloom.plans.tensors_queries import LOGITS, logits


def halve(frames):
    for frame in frames:
        if len(frame):
            block = np.stack(frame["v"].to_numpy()) * 0.5
            frame = frame.assign(v=list(block))
        yield frame


@register(
    "user_operation_forward",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings WHERE vec_id % 9 <> 0)
    SELECT vec_id, NULL::VARCHAR AS error, p::INTEGER AS idx, round(v * 0.5, 6) AS value FROM e
    UNION ALL SELECT vec_id, 'input: dtype mismatch', NULL, NULL FROM embeddings WHERE vec_id % 9 = 0""",
)
def user_operation_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", te.doubles("embedding").alias("v"), F.when(F.col("vec_id") % 9 == 0, "f64").otherwise("f32").alias("dtype")
    )
    operation = uf.Operation(uf.Port("f32", 64), uf.Port("f32", 64), halve)
    done = operation.run(rows, ["vec_id"])
    return done.select("vec_id", "error", F.posexplode_outer("v").alias("idx", "value")).withColumn(
        "value", F.round("value", 6)
    )


@register(
    "monoid_ordered_fold",
    """SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS trace FROM events GROUP BY user_id""",
)
def monoid_ordered_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.substring("event_type", 1, 1).alias("trace")
    )
    return uf.Monoid("", lambda a, b: a + b).fold(rows, "user_id", "event_id", "trace")


@register(
    "policy_losses",
    f"""WITH {LOGITS}, s AS (SELECT vec_id, any_value(label) AS label, max(l) AS m FROM logits GROUP BY vec_id),
    n AS (SELECT vec_id, any_value(label) AS label, any_value(m) + ln(sum(exp(l - m))) AS lse FROM logits JOIN (SELECT vec_id, m FROM s) USING (vec_id) GROUP BY vec_id)
    SELECT n.label, round(avg(lse - l), 6) AS mean_loss FROM n JOIN logits ON logits.vec_id = n.vec_id AND c = n.label GROUP BY n.label""",
)
def policy_losses(spark, sf_dir):
    def policy(outputs):
        rows = outputs.withColumn("loss", te.cross_entropy("logits", "label"))
        return ot.mean_loss(rows, "label", "loss").select("label", F.round("mean_loss", 6).alias("mean_loss"))

    return uf.apply_policy(logits(spark, sf_dir), policy, ["mean_loss"])


@register(
    "fusion_transform",
    f"""WITH {DELIVERED} SELECT graph_id, vertex, step, CASE WHEN a.address = b.address THEN (a.payload + b.payload) / 2 END AS fused
    FROM (SELECT * FROM d WHERE ordinal = 0) a JOIN (SELECT * FROM d WHERE ordinal = 1) b USING (graph_id, vertex, step)""",
)
def fusion_transform(spark, sf_dir):
    fused = uf.fuse(deliveries(spark, sf_dir), "payload", "address", lambda a, b: (a + b) / 2)
    return fused.select("graph_id", "vertex", "step", "fused")


@register(
    "augmentation_steps",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)
    SELECT vec_id, (CASE WHEN substr(md5('8:flip:' || vec_id), 1, 1) < '8' THEN (p // 8) * 8 + 7 - p % 8 ELSE p END)::INTEGER AS idx,
    round(greatest(v, 0) * 2, 6) AS value FROM e""",
)
def augmentation_steps(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings").select("vec_id", te.doubles("embedding").alias("v"))
    out = uf.source_steps(
        source,
        lambda df: df.withColumn("v", te.random_flip("v", 8, 8, "vec_id")),
        lambda df: df.withColumn("v", te.relu("v")),
        lambda df: df.withColumn("v", te.scale("v", 2.0)),
    )
    return ot.explode_values(out, ["vec_id"], "v").withColumn("value", F.round("value", 6))
