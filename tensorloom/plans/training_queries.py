"""Registered training queries: parameters, gradients, schedules and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te
from tensorloom.operators import tensors as ot
from tensorloom.operators import training as tr
from tensorloom.operators import user_functions as uf
from tensorloom.plans.catalog import register, table
from tensorloom.session import ensure_checkpoint_dir
from tensorloom.sources.checkpoints import read_checkpoint, write_checkpoints

WIDTH = 64

E = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
  generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"""


def signed(seed, key):
    return f"CASE WHEN substr(md5('{seed}:' || {key}), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END"


# Every embedding element is a parameter of the instance vec_id.
PARAMS = f"""{E}, pr AS (SELECT vec_id AS instance, vec_id * 64 + p AS param_id, v AS value,
  {signed(1, '(vec_id * 64 + p)')} AS direction, vec_id % 3 = 0 AS open,
  label / 10.0::DOUBLE + 1 AS loss_up, 1 + label * label / 90.0::DOUBLE AS loss_down FROM e)"""


def params(spark, sf_dir):
    long = ot.explode_values(
        table(spark, sf_dir, "embeddings").select("vec_id", te.doubles("embedding").alias("v")), ["vec_id"], "v"
    )
    keyed = long.select(
        F.col("vec_id").alias("instance"), (F.col("vec_id") * WIDTH + F.col("idx")).alias("param_id"), "value"
    )
    return tr.directions(keyed, 1)


def sessions(spark, sf_dir):
    label = F.col("label").cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("instance"),
        (F.col("vec_id") % 3 == 0).alias("open"),
        (label / 10 + 1).alias("loss_up"),
        (label * label / 90 + 1).alias("loss_down"),
    )


def settled(df):
    return df.select("param_id", F.round("value", 9).alias("value"), "error")


@register("sign_directions", f"WITH {PARAMS} SELECT param_id, direction FROM pr")
def sign_directions(spark, sf_dir):
    return params(spark, sf_dir).select("param_id", "direction")


@register(
    "perturb_up",
    f"""WITH {PARAMS} SELECT param_id, round(CASE WHEN open THEN value ELSE value + direction * 0.001 END, 9) AS value,
    CASE WHEN open THEN 'previous step not completed' END AS error FROM pr""",
)
def perturb_up(spark, sf_dir):
    return settled(tr.perturb_up(params(spark, sf_dir), sessions(spark, sf_dir)))


@register(
    "perturb_down",
    f"""WITH {PARAMS} SELECT param_id, round(CASE WHEN open THEN value - direction * 0.002 ELSE value END, 9) AS value,
    CASE WHEN NOT open THEN 'perturb down without perturb up' END AS error FROM pr""",
)
def perturb_down(spark, sf_dir):
    return settled(tr.perturb_down(params(spark, sf_dir), sessions(spark, sf_dir)))


@register(
    "zeroth_order_optimise",
    f"""WITH {PARAMS} SELECT param_id, round(CASE WHEN open THEN value + direction * 0.001 - direction * 0.0001 *
      greatest(least((loss_up - loss_down) / 0.002, 10), -10) ELSE value END, 9) AS value,
    CASE WHEN NOT open THEN 'optimise without perturbation state' END AS error FROM pr""",
)
def zeroth_order_optimise(spark, sf_dir):
    return settled(tr.optimise(params(spark, sf_dir), sessions(spark, sf_dir)))


@register(
    "user_operation_verbs",
    f"""WITH {PARAMS} SELECT param_id, round(value - CASE WHEN open THEN direction * 0.001 ELSE 0 END
      - direction * 0.0001 * greatest(least((loss_up - loss_down) / 0.002, 10), -10), 9) AS value,
    CASE WHEN open THEN 'previous step not completed' END AS error FROM pr""",
)
def user_operation_verbs(spark, sf_dir):
    """A whole step through an operation's verbs; where a step was open the first perturbation is refused."""
    verbs = {"perturb": tr.perturb_up, "perturb back": tr.perturb_down, "optimise": tr.optimise}
    operation = uf.Operation(uf.Port("f32"), uf.Port("f32"), lambda frames: frames, verbs)
    state = sessions(spark, sf_dir)
    begun = state.withColumn("open", F.lit(True))
    up = operation.call("perturb", params(spark, sf_dir), state).withColumnRenamed("error", "_refused")
    down = operation.call("perturb back", up, begun).drop("error")
    done = operation.call("optimise", down, begun).drop("error")
    return settled(done.withColumnRenamed("_refused", "error"))


# Two-class head from the data: class 0 is the mean of label 0, class 1 of the rest.
HEAD = f"""{E}, h AS (SELECT CASE WHEN label = 0 THEN 0 ELSE 1 END AS c, p, round(avg(v), 9) AS w FROM e GROUP BY ALL),
  th AS (SELECT c * 64 + p AS param_id, w AS value FROM h UNION ALL
    SELECT 128 + c, round(avg(w), 9) FROM h GROUP BY c)"""


def head(spark, sf_dir):
    rows = ot.explode_values(
        table(spark, sf_dir, "embeddings").select("label", te.doubles("embedding").alias("v")), ["label"], "v"
    )
    weights = ot.collapse_head(rows, "label", "idx", "value", (0,)).withColumn("value", F.round("value", 9))
    bias = weights.groupBy("row").agg(F.round(F.avg("value"), 9).alias("value"))
    flat = weights.select((F.col("row") * WIDTH + F.col("dim")).cast("bigint").alias("param_id"), "value")
    return flat.unionByName(bias.select((F.col("row") + 2 * WIDTH).cast("bigint").alias("param_id"), "value"))


def examples(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        (F.col("vec_id") % 2).cast("int").alias("replica"),
        te.doubles("embedding").alias("v"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias("target"),
    )


def loss_sql(name, shift):
    return f"""{name}w AS (SELECT param_id, value + ({shift}) * {signed(5, 'param_id')} AS w FROM th),
    {name}l AS (SELECT vec_id, any_value(label) AS label, w.param_id // 64 AS c, sum(v * w) + any_value(b) AS l FROM e
      JOIN {name}w w ON w.param_id < 128 AND w.param_id % 64 = p JOIN (SELECT param_id - 128 AS bc, w AS b FROM {name}w
      WHERE param_id >= 128) ON bc = w.param_id // 64 GROUP BY vec_id, w.param_id // 64),
    {name}a AS (SELECT avg(ln(1 + exp(o.l - t.l))) AS loss FROM {name}l t JOIN {name}l o
      ON t.vec_id = o.vec_id AND o.c <> t.c WHERE t.c = CASE WHEN t.label = 0 THEN 0 ELSE 1 END)"""


TWO_SIDED = f"""WITH {HEAD}, {loss_sql('u', '0.001')}, {loss_sql('d', '-0.001')}
  SELECT round(ua.loss, 9) AS loss_up, round(da.loss, 9) AS loss_down FROM ua, da"""


def two_sided(spark, sf_dir, **kwargs):
    theta = tr.directions(head(spark, sf_dir), 5)
    out = tr.two_sided_losses(examples(spark, sf_dir), theta, WIDTH, 2, **kwargs)
    return out.select(F.round("loss_up", 9).alias("loss_up"), F.round("loss_down", 9).alias("loss_down"))


@register("two_sided_losses", TWO_SIDED)
def two_sided_losses(spark, sf_dir):
    return two_sided(spark, sf_dir)


@register("two_sided_losses_long_form", TWO_SIDED)
def two_sided_losses_long_form(spark, sf_dir):
    """The same with one class in a tile."""
    return two_sided(spark, sf_dir, tile=WIDTH)


@register(
    "zeroth_order_quadratic",
    f"""WITH {E} SELECT vec_id * 64 + p AS param_id, round((4 + v) * pow(0.6, 12), 9) AS value,
    pow((4 + v) * pow(0.6, 12), 2) < 0.01 * pow(4 + v, 2) AS converged FROM e""",
)
def zeroth_order_quadratic(spark, sf_dir):
    start = params(spark, sf_dir).select(
        "param_id", (F.col("value") + 4).alias("start"), (F.col("value") + 4).alias("value")
    )
    done = tr.minimise_quadratic(start, 2)
    return done.select(
        "param_id",
        F.round("value", 9).alias("value"),
        (F.col("loss") < 0.01 * F.pow("start", 2)).alias("converged"),
    )


@register(
    "accumulate_gradient_pairs",
    f"""WITH {E}, l AS (SELECT vec_id // 16 AS step, CASE WHEN vec_id % 2 = 0 THEN 'up' ELSE 'down' END AS side,
      vec_id % 16 // 2 AS micro, sum(v) AS loss FROM e GROUP BY vec_id),
    p AS (SELECT step, micro, max(loss) FILTER (side = 'up') AS u, max(loss) FILTER (side = 'down') AS d FROM l GROUP BY ALL)
    SELECT step, count(*) FILTER (u IS NOT NULL AND d IS NOT NULL) AS pairs,
      round(avg(u) FILTER (d IS NOT NULL), 6) AS loss_up, round(avg(d) FILTER (u IS NOT NULL), 6) AS loss_down,
      CASE WHEN count(*) FILTER (u IS NULL) > 0 THEN 'missing up pass'
        WHEN count(*) FILTER (u IS NOT NULL AND d IS NOT NULL) <> 8 THEN 'wrong number of pairs' END AS error
    FROM p GROUP BY step""",
)
def accumulate_gradient_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    losses = rows.select(
        F.floor(F.col("vec_id") / 16).alias("step"),
        F.when(F.col("vec_id") % 2 == 0, "up").otherwise("down").alias("side"),
        F.floor(F.col("vec_id") % 16 / 2).alias("micro"),
        te.total(te.doubles("embedding")).alias("loss"),
    )
    return tr.accumulate_pairs(losses, ["step"], 8).select(
        "step", "pairs", F.round("loss_up", 6).alias("loss_up"), F.round("loss_down", 6).alias("loss_down"), "error"
    )


GRAD = f"""{HEAD}, lg AS (SELECT vec_id, any_value(label) AS label, t.param_id // 64 AS c, sum(v * value) + any_value(b) AS l FROM e
      JOIN th t ON t.param_id < 128 AND t.param_id % 64 = p JOIN (SELECT param_id - 128 AS bc, value AS b FROM th
      WHERE param_id >= 128) ON bc = t.param_id // 64 GROUP BY vec_id, t.param_id // 64),
  dl AS (SELECT a.vec_id, a.c, a.vec_id % 2 AS replica, 1 / (1 + exp(b.l - a.l)) -
      CASE WHEN a.c = CASE WHEN a.label = 0 THEN 0 ELSE 1 END THEN 1 ELSE 0 END AS d FROM lg a JOIN lg b
      ON a.vec_id = b.vec_id AND a.c <> b.c),
  gr AS (SELECT replica, c * 64 + p AS param_id, d * v AS g FROM dl JOIN e USING (vec_id)
    UNION ALL SELECT replica, 128 + c, d FROM dl),
  rg AS (SELECT replica, param_id, avg(g) AS g FROM gr GROUP BY ALL),
  ag AS (SELECT param_id, sum(g) * 0.5 AS g FROM rg GROUP BY ALL),
  st AS (SELECT param_id, value - 0.1 * coalesce(g, 0) AS value FROM th LEFT JOIN ag USING (param_id))"""


@register(
    "softmax_head_gradient",
    f"WITH {GRAD} SELECT param_id, round(avg(g), 8) AS grad, count(*) AS rows FROM gr GROUP BY param_id",
)
def softmax_head_gradient(spark, sf_dir):
    grads = tr.head_gradient(examples(spark, sf_dir), head(spark, sf_dir), WIDTH, 2)
    return grads.withColumn("grad", F.round("grad", 8))


def layer(spark, sf_dir):
    """Dense 64x4 ReLU layer whose gradient depends on the label."""
    weights = [[1.0 if (k * 7 + j * 3) % 5 < 2 else -0.5 for j in range(4)] for k in range(WIDTH)]
    grad = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda j: F.when(j == F.col("label") % 4, 1.0).otherwise(-0.25),
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", te.doubles("embedding").alias("v"), grad.alias("g"))
    return rows, weights


LAYER = f"""{E}, wt AS (SELECT k, j, CASE WHEN (k * 7 + j * 3) % 5 < 2 THEN 1.0::DOUBLE ELSE -0.5 END AS w
  FROM range(64) a(k), range(4) b(j)),
  z AS (SELECT vec_id, any_value(label) AS label, j, sum(v * w) AS z FROM e JOIN wt ON k = p GROUP BY vec_id, j),
  mg AS (SELECT vec_id, j, CASE WHEN z > 0 THEN CASE WHEN j = label % 4 THEN 1.0::DOUBLE ELSE -0.25 END ELSE 0 END AS m FROM z)"""


@register(
    "dense_weight_gradient",
    f"""WITH {LAYER} SELECT p::INTEGER AS i, j::INTEGER AS j, round(sum(v * m), 6) AS grad FROM e JOIN mg USING (vec_id)
    GROUP BY ALL""",
)
def dense_weight_gradient(spark, sf_dir):
    rows, weights = layer(spark, sf_dir)
    return tr.dense_weight_gradient(rows, "v", "g", weights).withColumn("grad", F.round("grad", 6))


@register(
    "dense_input_gradient",
    f"WITH {LAYER} SELECT vec_id, k::INTEGER AS idx, round(sum(m * w), 6) AS value FROM mg JOIN wt USING (j) GROUP BY ALL",
)
def dense_input_gradient(spark, sf_dir):
    rows, weights = layer(spark, sf_dir)
    out = tr.dense_input_gradient(rows, "v", "g", weights)
    return ot.explode_values(out, ["vec_id"], "input_gradient").withColumn("value", F.round("value", 6))


def averaged(spark, sf_dir):
    grads = tr.head_gradient(examples(spark, sf_dir), head(spark, sf_dir), WIDTH, 2, ["replica"])
    return tr.average_replicas(grads, 2)


@register("average_replica_gradients", f"WITH {GRAD} SELECT param_id, round(g, 8) AS grad FROM ag")
def average_replica_gradients(spark, sf_dir):
    return averaged(spark, sf_dir).withColumn("grad", F.round("grad", 8))


def stepped(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return tr.sgd_step(head(spark, sf_dir), averaged(spark, sf_dir), rows.filter(F.col("v").isNull()), 0.1)


@register("sgd_step", f"WITH {GRAD} SELECT param_id, round(value, 8) AS value, NULL::VARCHAR AS error FROM st")
def sgd_step(spark, sf_dir):
    return stepped(spark, sf_dir).withColumn("value", F.round("value", 8))


@register(
    "sgd_step_refused",
    f"""WITH {HEAD} SELECT param_id, value, 'forward passes still pending' AS error FROM th""",
)
def sgd_step_refused(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return tr.sgd_step(head(spark, sf_dir), averaged(spark, sf_dir), rows.select("example_id"), 0.1)


@register(
    "checkpoint_then_evaluate",
    f"""WITH {GRAD}, lt AS (SELECT vec_id, any_value(label) AS label, t.param_id // 64 AS c, sum(v * value) + any_value(b) AS l FROM e
      JOIN st t ON t.param_id < 128 AND t.param_id % 64 = p JOIN (SELECT param_id - 128 AS bc, value AS b FROM st
      WHERE param_id >= 128) ON bc = t.param_id // 64 GROUP BY vec_id, t.param_id // 64)
    SELECT count(*) AS rows, round(avg(ln(1 + exp(o.l - t.l))), 8) AS mean_loss,
      round(avg((CASE WHEN t.c = 0 THEN t.l >= o.l ELSE t.l > o.l END)::INTEGER), 8) AS accuracy
    FROM lt t JOIN lt o ON t.vec_id = o.vec_id AND o.c <> t.c WHERE t.c = CASE WHEN t.label = 0 THEN 0 ELSE 1 END""",
)
def checkpoint_then_evaluate(spark, sf_dir):
    """The stepped head is saved as step 1, and the latest step on file is evaluated."""
    folder = f"{ensure_checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}"
    write_checkpoints(stepped(spark, sf_dir).select("param_id", "value", F.lit(1).alias("step")), "step", 1, folder)
    saved = read_checkpoint(spark, folder).select("param_id", "value")
    rows = examples(spark, sf_dir)
    found = tr.head_statistics(rows, saved, WIDTH, 2, {"head": "value"}).join(rows.select("example_id", "target"), "example_id")
    hit = F.when(F.col("predicted_head") == F.col("target"), 1.0).otherwise(0.0)
    return found.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg("loss_head"), 8).alias("mean_loss"),
        F.round(F.avg(hit), 8).alias("accuracy"),
    )


def passes(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view", "signup"), "forward").otherwise("backward")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), kind.alias("kind")
    )


@register(
    "match_forward_backward",
    """WITH RECURSIVE o AS (SELECT user_id AS instance, event_id AS seq, event_type IN ('click', 'view', 'signup') AS fwd,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    q AS (SELECT instance, 0::BIGINT AS rn, 0::BIGINT AS depth, 0::BIGINT AS popped, NULL::BIGINT AS seq, NULL::BOOLEAN AS fwd, false AS orphan
      FROM (SELECT DISTINCT instance FROM o)
      UNION ALL SELECT o.instance, o.rn, CASE WHEN o.fwd THEN depth + 1 WHEN depth > 0 THEN depth - 1 ELSE 0 END,
        CASE WHEN NOT o.fwd AND depth > 0 THEN popped + 1 ELSE popped END, o.seq, o.fwd, NOT o.fwd AND depth = 0
      FROM q JOIN o ON o.instance = q.instance AND o.rn = q.rn + 1),
    f AS (SELECT instance, seq, row_number() OVER (PARTITION BY instance ORDER BY seq) AS ordinal FROM q WHERE fwd),
    b AS (SELECT instance, seq, popped AS ordinal FROM q WHERE NOT fwd AND NOT orphan)
    SELECT instance, ordinal, f.seq AS forward_seq, b.seq AS backward_seq,
      CASE WHEN b.seq IS NULL THEN 'pending' ELSE 'matched' END AS status FROM f LEFT JOIN b USING (instance, ordinal)
    UNION ALL SELECT instance, NULL, NULL, seq, 'no cached forward' FROM q WHERE orphan""",
)
def match_forward_backward(spark, sf_dir):
    return tr.match_passes(passes(spark, sf_dir))


@register(
    "merge_checkpoints",
    f"""WITH {E}, a AS (SELECT vec_id * 64 + p AS param_id, v FROM e),
    b AS (SELECT param_id + 64 AS param_id, v FROM a)
    SELECT param_id, round(a.v * 0.75 + b.v * 0.25, 9) AS value, CASE WHEN a.v IS NULL THEN 'unknown parameter'
      WHEN b.v IS NULL THEN 'missing in checkpoint' END AS error FROM a FULL JOIN b USING (param_id)""",
)
def merge_checkpoints(spark, sf_dir):
    """Each vector with its predecessor as the checkpoint."""
    now = params(spark, sf_dir).select("param_id", "value")
    return settled(tr.merge_checkpoint(now, now.withColumn("param_id", F.col("param_id") + WIDTH), 0.25))


SHARDS = "SELECT l_orderkey AS step, l_linenumber AS shard, l_partkey AS name FROM lineitem"


def shards(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("shard"), F.col("l_partkey").alias("name")
    )


UNIFY = f"""s AS ({SHARDS}), t AS (SELECT step, name, count(*) AS n FROM s GROUP BY ALL),
  u AS (SELECT step, count(DISTINCT shard) AS shards, count(DISTINCT name) AS tensors, count(*) <> count(DISTINCT name) AS dup
    FROM s GROUP BY step),
  r AS (SELECT step, shards, tensors, CASE WHEN shards < 6 THEN 'waiting' WHEN dup THEN 'duplicate tensor' ELSE 'unified' END AS status FROM u)"""


@register("unify_shards", f"WITH {UNIFY} SELECT * FROM r")
def unify_shards(spark, sf_dir):
    return tr.unify_shards(shards(spark, sf_dir), "step", "shard", "name")


@register(
    "unified_tensors", f"WITH {UNIFY} SELECT s.* FROM s JOIN r USING (step) WHERE status = 'unified'"
)
def unified_tensors(spark, sf_dir):
    return tr.unified_tensors(shards(spark, sf_dir), "step", "shard", "name")


@register(
    "checkpoint_completeness",
    """WITH f AS (SELECT l_suppkey AS run, count(DISTINCT (l_linenumber, l_partkey % 6)) AS found FROM lineitem
    WHERE l_linenumber % 2 = 0 GROUP BY 1) SELECT run, found, found >= 18 AS complete FROM f""",
)
def checkpoint_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("step"), (F.col("l_partkey") % 6).alias("shard")
    )
    return tr.checkpoint_completeness(rows, "run", "step", "shard", steps=7, every=2, shards=6)


INSTANCES = """i AS (SELECT c_custkey AS instance, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 5 END AS period,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 4 END AS train, c_custkey % 6 AS phase, c_custkey % 3 AS warmup,
  c_acctbal < 0 AS initial_frozen FROM customer),
  j AS (SELECT *, CASE WHEN period = 0 THEN 'period must be positive' WHEN period IS NOT NULL AND train IS NULL
    THEN 'train steps missing' WHEN train > period THEN 'train steps exceed period' END AS error FROM i)"""
ASKED = """CASE WHEN period > 0 AND {s} > warmup THEN NOT (({s} - warmup - 1 + phase % period) % period < train) END"""


def instances(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("instance"),
        F.when(k % 11 != 0, k % 5).alias("period"),
        F.when(k % 7 != 0, k % 4).alias("train"),
        (k % 6).alias("phase"),
        (k % 3).alias("warmup"),
        (F.col("c_acctbal") < 0).alias("initial_frozen"),
    )


@register(
    "freeze_schedule",
    f"""WITH {INSTANCES} SELECT instance, step::INTEGER AS step, {ASKED.format(s='step')} AS scheduled, error
    FROM j, range(1, 13) t(step)""",
)
def freeze_schedule(spark, sf_dir):
    return tr.freeze_schedule(instances(spark, sf_dir), 12).select("instance", "step", "scheduled", "error")


FROZEN = f"""{INSTANCES}, fz AS (SELECT instance, step, coalesce({ASKED.format(s='greatest(step, 1)')}, initial_frozen) AS frozen,
  CASE WHEN period IS NULL THEN 0 ELSE step END AS optimize_steps FROM j, range(0, 13) t(step) WHERE error IS NULL)"""


@register(
    "effective_frozen_state",
    f"WITH {FROZEN} SELECT instance, step::INTEGER AS step, frozen, optimize_steps::INTEGER AS optimize_steps FROM fz",
)
def effective_frozen_state(spark, sf_dir):
    return tr.effective_frozen(instances(spark, sf_dir), 12).select("instance", "step", "frozen", "optimize_steps")


CONFIG = """cf AS (SELECT c_custkey AS instance, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS top_k,
  CASE WHEN c_custkey % 3 = 0 THEN 0.25::DOUBLE END AS temperature, CASE WHEN c_custkey % 5 = 0 THEN 0.9::DOUBLE END AS top_p,
  CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS inference_limit FROM customer),
  ov AS (SELECT instance, coalesce(top_k, 256) AS top_k, coalesce(temperature, 0.7::DOUBLE) AS temperature, top_p,
    coalesce(inference_limit, 256) AS inference_limit, NOT (top_k IS NULL AND temperature IS NULL AND top_p IS NULL
    AND inference_limit IS NULL) AS has_override FROM cf)"""
# Engine defaults where neither server nor instance sets one.
DEFAULTS = {"top_k": 256, "temperature": 0.7, "top_p": None, "inference_limit": 256}


def configured(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("instance"),
        F.when(k % 2 == 0, F.col("c_nationkey")).alias("top_k"),
        F.when(k % 3 == 0, F.lit(0.25)).alias("temperature"),
        F.when(k % 5 == 0, F.lit(0.9)).alias("top_p"),
        F.when(k % 7 == 0, k).alias("inference_limit"),
    )
    return tr.overlay(rows, DEFAULTS, list(DEFAULTS))


@register("config_overlay", f"WITH {CONFIG} SELECT * FROM ov")
def config_overlay(spark, sf_dir):
    return configured(spark, sf_dir)


@register(
    "parameter_report",
    f"""WITH {FROZEN}, {CONFIG} SELECT ov.*, frozen, optimize_steps::INTEGER AS optimize_steps FROM ov JOIN fz USING (instance)
    WHERE step = 12""",
)
def parameter_report(spark, sf_dir):
    frozen = tr.effective_frozen(instances(spark, sf_dir), 12).filter("step = 12")
    return tr.parameter_report(configured(spark, sf_dir), frozen)


WORKERS = """w AS (SELECT s_suppkey AS worker, s_nationkey AS pool, CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 4 * 300 END AS cap,
  CASE s_suppkey % 3 WHEN 0 THEN ['small'] WHEN 1 THEN ['small', 'large'] ELSE ['large', 'wide'] END AS kinds FROM supplier),
  r AS (SELECT l_suppkey AS worker, CASE l_returnflag WHEN 'A' THEN 'small' WHEN 'R' THEN 'large' END AS required FROM lineitem)"""


def workers(spark, sf_dir):
    k = F.col("s_suppkey")
    small, large, wide = F.lit("small"), F.lit("large"), F.lit("wide")
    kinds = F.when(k % 3 == 0, F.array(small)).when(k % 3 == 1, F.array(small, large)).otherwise(F.array(large, wide))
    return table(spark, sf_dir, "supplier").select(
        k.alias("worker"),
        F.col("s_nationkey").alias("pool"),
        F.when(k % 10 != 0, k % 4 * 300).alias("max_instances"),
        kinds.alias("kinds"),
    )


def routes(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("worker"), F.when(flag == "A", "small").when(flag == "R", "large").alias("required")
    )


@register(
    "capacity_rollup",
    f"""WITH {WORKERS}, u AS (SELECT worker, count(*) AS n FROM r GROUP BY worker),
    t AS (SELECT pool, CASE WHEN count(*) = count(cap) THEN sum(cap)::BIGINT END AS total,
      coalesce(sum(n), 0)::BIGINT AS occupied FROM w LEFT JOIN u USING (worker) GROUP BY pool)
    SELECT pool, total, occupied, CASE WHEN total IS NOT NULL THEN greatest(total - occupied, 0) END AS available FROM t""",
)
def capacity_rollup(spark, sf_dir):
    return tr.capacity(workers(spark, sf_dir), routes(spark, sf_dir), "pool")


@register(
    "capacity_by_kind",
    f"""WITH {WORKERS}, k AS (SELECT worker, cap, unnest(kinds) AS kind FROM w),
    t AS (SELECT kind, CASE WHEN count(*) = count(cap) THEN sum(cap)::BIGINT END AS total FROM k GROUP BY kind),
    o AS (SELECT kind, count(*) AS occupied FROM k JOIN r USING (worker) WHERE required IS NULL OR required = kind GROUP BY kind)
    SELECT kind, total, coalesce(occupied, 0) AS occupied, CASE WHEN total IS NOT NULL THEN
      greatest(total - coalesce(occupied, 0), 0) END AS available FROM t LEFT JOIN o USING (kind)""",
)
def capacity_by_kind(spark, sf_dir):
    return tr.capacity_by_kind(workers(spark, sf_dir), routes(spark, sf_dir))


SESSION = """CASE event_type WHEN 'click' THEN 'up' WHEN 'purchase' THEN 'down' WHEN 'signup' THEN 'optimise' ELSE 'infer' END"""


@register(
    "session_order_audit",
    f"""WITH RECURSIVE o AS (SELECT user_id AS instance, event_id AS seq, {SESSION} AS command,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    q AS (SELECT instance, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS command, 'idle' AS state, 'idle' AS nxt
      FROM (SELECT DISTINCT instance FROM o)
      UNION ALL SELECT o.instance, o.rn, o.seq, o.command, q.nxt, CASE
        WHEN o.command = 'infer' THEN CASE WHEN q.nxt IN ('after up', 'awaits down') THEN 'awaits down' ELSE 'awaits update' END
        WHEN o.command = 'up' AND q.nxt = 'idle' THEN 'after up'
        WHEN o.command = 'down' AND q.nxt = 'awaits down' THEN 'after down'
        WHEN o.command = 'optimise' AND q.nxt = 'awaits update' THEN 'idle' ELSE q.nxt END
      FROM q JOIN o ON o.instance = q.instance AND o.rn = q.rn + 1)
    SELECT instance, seq, command, state, command = 'infer' OR state = CASE command WHEN 'up' THEN 'idle'
      WHEN 'down' THEN 'awaits down' ELSE 'awaits update' END AS legal FROM q WHERE seq IS NOT NULL""",
)
def session_order_audit(spark, sf_dir):
    kind = F.col("event_type")
    command = (
        F.when(kind == "click", "up").when(kind == "purchase", "down").when(kind == "signup", "optimise").otherwise("infer")
    )
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), command.alias("command")
    )
    return tr.session_audit(log)


@register(
    "lane_agreement",
    """WITH l AS (SELECT l_orderkey AS stage, l_linenumber AS ordinal, l_suppkey % 2 AS lane,
      max((l_returnflag, l_quantity::INTEGER % 3)) AS m FROM lineitem GROUP BY ALL)
    SELECT stage, ordinal, coalesce(a.m = b.m, false) AS agrees FROM (SELECT * FROM l WHERE lane = 0) a
    FULL JOIN (SELECT * FROM l WHERE lane = 1) b USING (stage, ordinal)""",
)
def lane_agreement(spark, sf_dir):
    number = F.col("l_quantity").cast("int") % 3
    log = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("stage"),
            F.col("l_linenumber").alias("ordinal"),
            (F.col("l_suppkey") % 2).alias("lane"),
        )
        .agg(F.max(F.struct(F.col("l_returnflag").alias("command"), number.alias("number"))).alias("m"))
    )
    return tr.lane_agreement(log.select("stage", "ordinal", "lane", "m.*"))
