"""Registered tensor queries (embeddings as tensors, lineitem keys as u32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te
from tensorloom.operators import contracts as oc
from tensorloom.operators import tensors as ot
from tensorloom.plans.catalog import register, table

E = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
  generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"""
# Ten logits per vector: lane sums of the values, so every value counts.
LOGITS = f"""{E}, logits AS (SELECT vec_id, label, (p % 10)::INTEGER AS c,
  round(sum(v), 6) AS l FROM e GROUP BY ALL)"""
LSE = LOGITS + """, lse AS (SELECT vec_id, any_value(label) AS label, max(l) AS m,
  max(l) + ln(sum(exp(l - m0))) AS lse FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS m0
  FROM logits) GROUP BY vec_id)"""
WEIGHTS = """w(k, j, w) AS (VALUES (0,0,1.0::DOUBLE),(0,1,0.0),(0,2,0.5),(0,3,0.0),(1,0,0.0),(1,1,1.0),
  (1,2,0.0),(1,3,0.5),(2,0,1.0),(2,1,1.0),(2,2,1.0),(2,3,1.0))"""
MATMUL = f"""{E}, {WEIGHTS}, mm AS (SELECT vec_id, ((p // 3) * 4 + j)::INTEGER AS idx, sum(v * w) AS value
  FROM e JOIN w ON p % 3 = k GROUP BY ALL)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", te.doubles("embedding").alias("v")
    )


def triples(spark, sf_dir):
    """Vectors zero-padded to a whole number of 3-wide rows."""
    short = F.pmod(-F.size("v"), F.lit(3))
    return vectors(spark, sf_dir).withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), short)))


def logits(spark, sf_dir):
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda c: F.round(te.total(F.filter("v", lambda x, i: i % 10 == c)), 6),
    )
    return vectors(spark, sf_dir).select("vec_id", "label", lanes.alias("logits"))


def long(df, value="value"):
    return ot.explode_values(df, ["vec_id"], value).withColumn("value", F.round("value", 6))


@register(
    "typed_tensor_chain",
    f"WITH {MATMUL} SELECT vec_id, idx, round(greatest(value * 0.5, 0), 6) AS value FROM mm",
)
def typed_tensor_chain(spark, sf_dir):
    """Bundles that pass their contract, then matmul, scale and ReLU."""
    rows = triples(spark, sf_dir)
    rows = oc.keep_conforming(rows, "vec_id", "v", dtype="f32", expected="f32", rank=1, size=66)
    return long(ot.tensor_chain(rows, "v", "value"))


@register("matmul", f"WITH {MATMUL} SELECT vec_id, idx, round(value, 6) AS value FROM mm")
def matmul(spark, sf_dir):
    return long(triples(spark, sf_dir).select("vec_id", te.matmul("v", te.PIPELINE_WEIGHTS).alias("value")))


@register(
    "matmul_long_form",
    f"""WITH {E}, wt AS (SELECT label AS j, p AS k, avg(v) AS w FROM e GROUP BY ALL)
    SELECT vec_id, j, round(sum(v * w), 6) AS value FROM e JOIN wt ON p = k GROUP BY ALL""",
)
def matmul_long_form(spark, sf_dir):
    """Scores against class centroids that are themselves a long-form table."""
    x = ot.explode_values(vectors(spark, sf_dir), ["vec_id", "label"], "v")
    centroids = x.groupBy(F.col("label").alias("j"), F.col("idx").alias("k")).agg(F.avg("value").alias("value"))
    left = x.select(F.col("vec_id").alias("i"), F.col("idx").alias("k"), "value")
    return ot.matmul_long(left, centroids).select(
        F.col("i").alias("vec_id"), "j", F.round("value", 6).alias("value")
    )


@register("scale", f"WITH {E} SELECT vec_id, p::INTEGER AS idx, round(v * 0.5, 6) AS value FROM e")
def scale(spark, sf_dir):
    return long(vectors(spark, sf_dir).select("vec_id", te.scale("v", 0.5).alias("value")))


@register("relu", f"WITH {E} SELECT vec_id, p::INTEGER AS idx, round(greatest(v, 0), 6) AS value FROM e")
def relu(spark, sf_dir):
    return long(vectors(spark, sf_dir).select("vec_id", te.relu("v").alias("value")))


@register(
    "slice_first_half",
    f"WITH {E} SELECT vec_id, p::INTEGER AS idx, round(v, 6) AS value FROM e WHERE p < 32",
)
def slice_first_half(spark, sf_dir):
    return long(vectors(spark, sf_dir).select("vec_id", te.first_half("v").alias("value")))


@register(
    "add_one_u32",
    """SELECT l_orderkey, l_linenumber, (l_partkey + 1) % 4294967296 AS part,
    (4294967295 - l_suppkey % 3 + 1) % 4294967296 AS near_top FROM lineitem""",
)
def add_one_u32(spark, sf_dir):
    keys = F.array(F.col("l_partkey"), F.lit(te.U32 - 1) - F.col("l_suppkey") % 3)
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", te.add_one_u32(keys).alias("_u"))
        .select("l_orderkey", "l_linenumber", F.col("_u")[0].alias("part"), F.col("_u")[1].alias("near_top"))
    )


@register(
    "log_softmax",
    f"WITH {LSE} SELECT vec_id, c AS idx, round(l - lse, 6) AS value FROM logits JOIN lse USING (vec_id)",
)
def log_softmax(spark, sf_dir):
    return long(logits(spark, sf_dir).select("vec_id", te.log_softmax("logits").alias("value")))


@register(
    "cross_entropy",
    f"""WITH {LSE} SELECT vec_id, round(lse - l, 6) AS loss FROM lse JOIN logits USING (vec_id)
    WHERE logits.c = lse.label""",
)
def cross_entropy(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", F.round(te.cross_entropy("logits", "label"), 6).alias("loss"))


@register(
    "mean_batch_loss",
    f"""WITH {LSE} SELECT vec_id // 4 AS batch, round(avg(lse - l), 6) AS mean_loss, count(*) AS rows
    FROM lse JOIN logits USING (vec_id) WHERE logits.c = lse.label GROUP BY ALL""",
)
def mean_batch_loss(spark, sf_dir):
    rows = logits(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 4).alias("batch"), te.cross_entropy("logits", "label").alias("loss")
    )
    return ot.mean_loss(rows, "batch", "loss").withColumn("mean_loss", F.round("mean_loss", 6))


PREDICTED = LOGITS + """, pr AS (SELECT vec_id, any_value(label) AS label,
  arg_min(c, (-l, c)) AS predicted FROM logits GROUP BY vec_id)"""


@register("predicted_class", f"WITH {PREDICTED} SELECT vec_id, predicted FROM pr")
def predicted_class(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", te.predicted_class("logits").alias("predicted"))


@register(
    "accuracy",
    f"""WITH {PREDICTED} SELECT label, round(avg((predicted = label)::INTEGER), 6) AS accuracy,
    count(*) AS rows FROM pr GROUP BY label""",
)
def accuracy(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("predicted", te.predicted_class("logits"))
    return ot.accuracy(rows, "predicted", "label", ["label"]).withColumn("accuracy", F.round("accuracy", 6))


@register(
    "step_metrics",
    f"""WITH {PREDICTED},
    ls AS (SELECT vec_id, ln(sum(exp(l - m0))) + max(m0) AS lse FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS m0
      FROM logits) GROUP BY vec_id),
    r AS (SELECT vec_id, vec_id // 32 AS step, vec_id // 4 AS output, lse - l AS loss,
      predicted = pr.label AS hit FROM pr JOIN ls USING (vec_id) JOIN logits USING (vec_id)
      WHERE logits.c = pr.label)
    SELECT step, count(DISTINCT output) AS outputs,
      round(sum(loss) / greatest(count(DISTINCT output) * 4, 1), 6) AS mean_loss,
      round(count(*) FILTER (hit) / greatest(count(DISTINCT output) * 4, 1), 6) AS accuracy
    FROM r GROUP BY step""",
)
def step_metrics(spark, sf_dir):
    rows = logits(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 32).alias("step"),
        F.floor(F.col("vec_id") / 4).alias("output"),
        te.cross_entropy("logits", "label").alias("loss"),
        te.predicted_class("logits").alias("predicted"),
        F.col("label").alias("target"),
    )
    return ot.step_metrics(rows, "step", "output", 4).select(
        "step", "outputs", F.round("mean_loss", 6).alias("mean_loss"), F.round("accuracy", 6).alias("accuracy")
    )


@register(
    "spatial_mean_pool",
    f"WITH {E} SELECT vec_id, (p // 16)::INTEGER AS idx, round(avg(v), 6) AS value FROM e GROUP BY ALL",
)
def spatial_mean_pool(spark, sf_dir):
    return long(vectors(spark, sf_dir).select("vec_id", te.spatial_mean("v", 4, 4, 4).alias("value")))


@register(
    "spatial_mean_pool_long",
    f"WITH {E} SELECT vec_id, (p // 16)::INTEGER AS channel, round(avg(v), 6) AS value FROM e GROUP BY ALL",
)
def spatial_mean_pool_long(spark, sf_dir):
    rows = ot.explode_values(vectors(spark, sf_dir), ["vec_id"], "v")
    return ot.spatial_mean_long(rows, ["vec_id"], 4, 4).withColumn("value", F.round("value", 6))


POOL = f"""WITH {E}, o AS (SELECT unnest(range(16)) AS idx)
    SELECT vec_id, idx::INTEGER AS idx, round(max(v), 6) AS value FROM e JOIN o
    ON p // 8 BETWEEN (idx // 4) * 2 - 1 AND (idx // 4) * 2 + 1
    AND p % 8 BETWEEN (idx % 4) * 2 - 1 AND (idx % 4) * 2 + 1 GROUP BY ALL"""


@register("max_pool_3x3", POOL)
def max_pool_3x3(spark, sf_dir):
    return long(vectors(spark, sf_dir).select("vec_id", te.max_pool_3x3("v", 8, 8).alias("value")))


@register("max_pool_3x3_long", POOL)
def max_pool_3x3_long(spark, sf_dir):
    rows = ot.explode_values(vectors(spark, sf_dir), ["vec_id"], "v")
    return ot.max_pool_long(rows, ["vec_id"], 8, 8).withColumn("value", F.round("value", 6))


@register(
    "collapse_class_head",
    f"""WITH {E}, h AS (SELECT label, p, avg(v) AS w FROM e GROUP BY ALL)
    SELECT CASE WHEN label IN (0, 1) THEN 0 ELSE 1 END AS row, p::INTEGER AS dim, round(avg(w), 6) AS value
    FROM h GROUP BY ALL""",
)
def collapse_class_head(spark, sf_dir):
    head = (
        ot.explode_values(vectors(spark, sf_dir), ["label"], "v")
        .groupBy("label", "idx")
        .agg(F.avg("value").alias("value"))
    )
    return ot.collapse_head(head, "label", "idx", "value", (0, 1)).withColumn("value", F.round("value", 6))


def pixels(spark, sf_dir):
    """8x8x3 images: the three channels follow from each value."""
    def level(x):
        return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    image = F.flatten(
        F.transform("v", lambda x: F.array(level(x + 0.5), level(x * x), level(F.lit(0.5) - x)))
    )
    return vectors(spark, sf_dir).select("vec_id", image.alias("pixels"))


PIXELS = f"""{E}, px AS (SELECT vec_id, p, unnest([0, 1, 2]) AS c,
  unnest([floor(least(greatest(v + 0.5, 0), 1) * 255)::INTEGER, floor(least(greatest(v * v, 0), 1) * 255)::INTEGER,
  floor(least(greatest(0.5 - v, 0), 1) * 255)::INTEGER]) AS px FROM e)"""


@register(
    "normalise_image",
    f"""WITH {PIXELS} SELECT vec_id, (c * 64 + p)::INTEGER AS idx, round((px / 255.0::DOUBLE - [0.485, 0.456, 0.406][c + 1]::DOUBLE)
    / [0.229, 0.224, 0.225][c + 1]::DOUBLE, 6) AS value FROM px""",
)
def normalise_image(spark, sf_dir):
    return long(pixels(spark, sf_dir).select("vec_id", te.normalise_hwc("pixels", 8, 8).alias("value")))


@register("denormalise_image", f"WITH {PIXELS} SELECT vec_id, (c * 64 + p)::INTEGER AS idx, px AS value FROM px")
def denormalise_image(spark, sf_dir):
    restored = te.denormalise_chw(te.normalise_hwc("pixels", 8, 8), 64)
    return ot.explode_values(pixels(spark, sf_dir).select("vec_id", restored.alias("v")), ["vec_id"], "v")


@register(
    "random_horizontal_flip",
    f"""WITH {E} SELECT vec_id, (CASE WHEN substr(md5('11:flip:' || vec_id), 1, 1) < '8'
    THEN (p // 8) * 8 + 7 - p % 8 ELSE p END)::INTEGER AS idx, round(v, 6) AS value FROM e""",
)
def random_horizontal_flip(spark, sf_dir):
    return long(vectors(spark, sf_dir).select("vec_id", te.random_flip("v", 8, 11, "vec_id").alias("value")))


@register(
    "random_crop_box",
    """WITH d AS (SELECT vec_id, i, ('0x' || substr(md5('5:area:' || vec_id || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS a,
      ('0x' || substr(md5('5:ratio:' || vec_id || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS r,
      ('0x' || substr(md5('5:x:' || vec_id || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS ux,
      ('0x' || substr(md5('5:y:' || vec_id || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS uy
      FROM embeddings, range(1, 11) t(i)),
    b AS (SELECT *, round(sqrt(50176 * (0.08::DOUBLE + a * 0.92::DOUBLE) * (0.75 + r * (4.0::DOUBLE / 3 - 0.75))))::INTEGER AS w,
      round(sqrt(50176 * (0.08::DOUBLE + a * 0.92::DOUBLE) / (0.75 + r * (4.0::DOUBLE / 3 - 0.75))))::INTEGER AS h FROM d),
    f AS (SELECT vec_id, arg_min(struct_pack(x := floor(ux * (224 - w + 1))::INTEGER, y := floor(uy * (224 - h + 1))::INTEGER,
      w := w, h := h, a := i::INTEGER), i) AS s FROM b WHERE w BETWEEN 1 AND 224 AND h BETWEEN 1 AND 224 GROUP BY vec_id)
    SELECT vec_id, coalesce(s.x, 0) AS x, coalesce(s.y, 0) AS y, coalesce(s.w, 224) AS width,
      coalesce(s.h, 224) AS height, coalesce(s.a, 0) AS attempt FROM embeddings LEFT JOIN f USING (vec_id)""",
)
def random_crop_box(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", te.crop_box(5, "vec_id", 224, 224).alias("b"))
    return rows.select("vec_id", "b.*")


@register(
    "reshape_by_index",
    f"""WITH {E} SELECT vec_id, (p // 16)::INTEGER AS d0, ((p // 4) % 4)::INTEGER AS d1, (p % 4)::INTEGER AS d2,
    round(v, 6) AS value FROM e""",
)
def reshape_by_index(spark, sf_dir):
    rows = ot.explode_values(vectors(spark, sf_dir), ["vec_id"], "v")
    d0, d1, d2 = te.reshape_index("idx", (4, 4, 4))
    return rows.select("vec_id", d0.alias("d0"), d1.alias("d1"), d2.alias("d2"), F.round("value", 6).alias("value"))


@register(
    "batch_tensor_concat",
    f"""WITH {E}, n AS (SELECT vec_id // 4 AS batch, count(*) AS c FROM embeddings GROUP BY ALL)
    SELECT batch, 'ok' AS status, ((vec_id % 4) * 64 + p)::INTEGER AS idx, round(v, 6) AS value
    FROM e JOIN n ON batch = vec_id // 4 WHERE c = 4
    UNION ALL SELECT batch, 'wrong batch size', NULL, NULL FROM n WHERE c <> 4""",
)
def batch_tensor_concat(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 4).alias("batch"), (F.col("vec_id") % 4).alias("slot"), "v"
    )
    return (
        ot.batch_concat(rows, "batch", "slot", "v", 4)
        .select("batch", "status", F.posexplode_outer("v").alias("idx", "value"))
        .withColumn("value", F.round("value", 6))
    )
