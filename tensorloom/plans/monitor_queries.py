"""Registered monitoring queries: events as status messages of ten nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions.cols import epoch_ms
from tensorloom.operators import monitor as om
from tensorloom.plans.catalog import register, table
from tensorloom.plans.scans import last_known

ST = """st AS (SELECT user_id % 10 AS node, epoch_us(ts) // 1000 AS at_ms, event_id, event_type, value,
  CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS phase FROM events),
  ph AS (SELECT node, at_ms, event_id, phase, coalesce(lag(phase) OVER (PARTITION BY node ORDER BY at_ms, event_id), 0) AS b FROM st WHERE phase IS NOT NULL),
  di AS (SELECT *, CASE WHEN b = phase THEN 0 WHEN b = 0 THEN phase ELSE (phase - b + 3) % 3 END AS distance FROM ph),
  sq AS (SELECT node, at_ms, event_id, phase, distance, sum(distance) OVER (PARTITION BY node ORDER BY at_ms, event_id)::BIGINT AS sequence FROM di)"""
ORDER = ["at_ms", "event_id"]


def status(spark, sf_dir):
    kind = F.col("event_type")
    phase = F.when(kind == "click", 1).when(kind == "signup", 2).when(kind == "purchase", 3)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("node"), epoch_ms("ts").alias("at_ms"), "event_id", kind.alias("kind"), "value", phase.alias("phase")
    )


def messages(spark, sf_dir):
    return status(spark, sf_dir).filter("phase IS NOT NULL").select("node", "at_ms", "event_id", "phase")


@register("phase_sequence", f"WITH {ST} SELECT * FROM sq")
def phase_sequence(spark, sf_dir):
    return om.phase_sequence(messages(spark, sf_dir), ORDER)


OBS = f"""{ST}, po AS (SELECT st.node, st.at_ms, st.event_id, coalesce(sq.phase, 0) AS phase, coalesce(sq.sequence, 0) AS sequence
  FROM (SELECT * FROM st WHERE event_type IN ('view', 'error')) st ASOF LEFT JOIN sq ON st.node = sq.node AND st.at_ms >= sq.at_ms)"""


def polls(spark, sf_dir):
    """State seen by polls (views and errors), which may skip several changes."""
    numbered = om.phase_sequence(messages(spark, sf_dir), ORDER)
    seen = numbered.select("node", *ORDER, F.struct("phase", "sequence").alias("_s"))
    asked = status(spark, sf_dir).filter("kind IN ('view', 'error')").select("node", *ORDER).withColumn("_poll", F.lit(True))
    both = asked.unionByName(seen, allowMissingColumns=True)
    known = last_known(both, ["node"], ORDER, {"_k": "_s"}).filter("_poll")
    return known.select(
        "node", *ORDER,
        F.coalesce("_k.phase", F.lit(0)).alias("phase"),
        F.coalesce("_k.sequence", F.lit(0)).cast("bigint").alias("sequence"),
    )


@register(
    "pending_phase_transitions",
    f"""WITH {OBS}, p2 AS (SELECT *, coalesce(lag(phase) OVER (PARTITION BY node ORDER BY at_ms, event_id), 0) AS bp,
      coalesce(lag(sequence) OVER (PARTITION BY node ORDER BY at_ms, event_id), 0) AS bs FROM po),
    w AS (SELECT *, sequence - bs AS n, least(sequence - bs, 4) AS keep FROM p2),
    x AS (SELECT node, at_ms, event_id, unnest(range(keep)) AS step, n, keep, bp FROM w WHERE n > 0),
    y AS (SELECT node, at_ms, event_id, step, n - keep + step + 1 AS i, bp FROM x),
    z AS (SELECT node, at_ms, event_id, step::INTEGER AS step, CASE WHEN bp = 0 THEN (i - 1) % 3 + 1 ELSE (bp - 1 + i) % 3 + 1 END AS shown FROM y),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY at_ms DESC, event_id DESC, step DESC) AS rank FROM z)
    SELECT node, at_ms, event_id, step, shown::INTEGER AS shown, rank FROM r WHERE rank <= 4""",
)
def pending_phase_transitions(spark, sf_dir):
    return om.pending_phases(polls(spark, sf_dir), ORDER)


@register(
    "forward_snapshots_only",
    """WITH s AS (SELECT user_id % 10 AS node, epoch_us(ts) // 1000 AS at_ms, event_id, floor(value)::BIGINT AS sequence FROM events),
    m AS (SELECT *, max(sequence) OVER (PARTITION BY node ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s)
    SELECT node, at_ms, event_id, sequence FROM m WHERE seen IS NULL OR sequence >= seen""",
)
def forward_snapshots_only(spark, sf_dir):
    rows = status(spark, sf_dir).select("node", *ORDER, F.floor("value").cast("bigint").alias("sequence"))
    return om.forward_only(rows, ORDER)


@register(
    "attach_nested_state",
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS instance, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS nested FROM lineitem),
    a AS (SELECT p_partkey AS nested, p_size % 4 <> 0 AS published, p_size % 5 <> 0 AS decodable FROM part WHERE p_partkey % 7 <> 0)
    SELECT l_orderkey, l_linenumber, l_partkey, instance, n.nested, s_acctbal < 0 AS frozen, CASE WHEN n.nested IS NOT NULL THEN CASE WHEN a.nested IS NULL THEN 'fetch failed'
      WHEN NOT published THEN 'not published yet' WHEN NOT decodable THEN 'not decodable' END END AS reason
    FROM n LEFT JOIN supplier ON s_suppkey = instance LEFT JOIN a ON a.nested = n.nested""",
)
def attach_nested_state(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("instance"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("nested"),
    )
    appearances = table(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").select(
        F.col("p_partkey").alias("nested"), (F.col("p_size") % 4 != 0).alias("published"), (F.col("p_size") % 5 != 0).alias("decodable")
    )
    states = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instance"), (F.col("s_acctbal") < 0).alias("frozen"))
    return om.attach_nested(nodes, appearances, states)


@register(
    "snapshot_diff",
    """WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
    b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT user_id, CASE WHEN a.state IS NULL THEN 'added' WHEN b.state IS NULL THEN 'removed' WHEN a.state <> b.state OR a.n <> b.n THEN 'changed' END AS change
    FROM a FULL JOIN b USING (user_id) WHERE a.state IS NULL OR b.state IS NULL OR a.state <> b.state OR a.n <> b.n""",
)
def snapshot_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "events")

    def seen(when):
        return rows.filter(when).groupBy("user_id").agg(
            F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n")
        )

    first = seen(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    second = seen(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return om.snapshot_diff(first, second, "user_id", ["state", "n"])


@register(
    "progress_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_linenumber - 1, 1), greatest(l_suppkey % 6, 1)) / greatest(l_suppkey % 6, 1)::DOUBLE, 6) AS ratio FROM lineitem""",
)
def progress_ratio(spark, sf_dir):
    ratio = om.progress_ratio(F.col("l_linenumber") - 1, F.col("l_suppkey") % 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(ratio, 6).alias("ratio"))


@register(
    "frozen_at_transition",
    f"""WITH {ST}, f AS (SELECT node, at_ms, event_id, phase, event_id % 3 = 0 AS frozen, lag(phase) OVER (PARTITION BY node ORDER BY at_ms, event_id) AS b FROM st WHERE phase IS NOT NULL),
    m AS (SELECT *, CASE WHEN b = 1 AND phase = 2 THEN frozen END AS mo FROM f),
    l AS (SELECT *, last_value(mo IGNORE NULLS) OVER (PARTITION BY node ORDER BY at_ms, event_id) AS held FROM m)
    SELECT node, at_ms, event_id, phase, frozen, CASE WHEN phase = 3 THEN coalesce(held, frozen) ELSE frozen END AS shown FROM l""",
)
def frozen_at_transition(spark, sf_dir):
    log = messages(spark, sf_dir).withColumn("frozen", F.col("event_id") % 3 == 0)
    return om.shown_frozen(log, ORDER)


@register(
    "latest_node_state",
    """SELECT user_id % 10 AS node, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'queued' ELSE 'running' END, (epoch_us(ts) // 1000, event_id)) AS state,
    count(*) AS observations FROM events GROUP BY 1""",
)
def latest_node_state(spark, sf_dir):
    kind = F.col("kind")
    state = F.when(kind == "error", "failed").when(kind == "purchase", "succeeded").when(kind == "view", "queued").otherwise("running")
    return om.latest_state(status(spark, sf_dir).withColumn("state", state), ORDER)
