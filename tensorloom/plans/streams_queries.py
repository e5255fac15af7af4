"""Registered stream queries: each runs a stream over staged tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions.cols import epoch_ms
from tensorloom.operators import mailboxes as om
from tensorloom.plans.artifacts_queries import CHUNK, N
from tensorloom.plans.catalog import register, table
from tensorloom.plans.contracts_queries import DIMS, TENSORS, audit_sql, bundles, ports
from tensorloom.plans.graphs_queries import DELIVERED, deliveries
from tensorloom.streaming import streams as st
from tensorloom.streaming import timers as tm
from tensorloom.streaming import transfers as tr


def instant(ms):
    return F.timestamp_millis(ms)


WINDOWS = 3


def in_windows(df, keys, last=None):
    """Stream over a table in three windows or more, rows dealt to them by key.

    Files are as many as the table's own partitions ask for. ``last`` is a row
    written afterwards, whose event time moves the watermark on.
    """
    spark, folder = df.sparkSession, st.new_folder(df.sparkSession)
    df.withColumn("_w", F.pmod(F.xxhash64(*keys), F.lit(WINDOWS))).write.partitionBy("_w").parquet(folder)
    if last is not None:
        row = last.select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])
        row.coalesce(1).write.parquet(f"{folder}/_w={WINDOWS}")
    files = len(spark.read.schema(df.schema).parquet(f"{folder}/*").inputFiles())
    return st.read_windowed(spark, df.schema, f"{folder}/*", in_flight=files // WINDOWS)


# Faults by doc_id % 7: 1 last chunk lost, 2 begun twice under one number, 3 wrong hash of the
# first chunk, 4 two chunks swapped, 5 short declaration, 6 never committed. Where
# doc_id % 11 = 5 the declared and the sent total hash are both wrong.
def frames(spark, sf_dir):
    # Cut and counted in one pass: a substring or a length reads the text anew for every chunk.
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.ceil(F.length("text") / F.lit(CHUNK)).cast("bigint").alias("n"),
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("pieces"),
    )
    n, k = F.col("n"), F.col("doc_id") % 7
    kinds = {"seq": "bigint", "kind": "string", "idx": "bigint", "piece": "string", "hash": "string"}
    none = F.array().cast("array<struct<seq:bigint,kind:string,idx:bigint,piece:string,hash:string>>")

    def frame(seq, kind, idx=None, piece=None, digest=None):
        values = {"seq": seq, "kind": F.lit(kind), "idx": idx, "piece": piece, "hash": digest}
        return F.struct(
            *[(F.lit(None) if values[c] is None else values[c]).cast(t).alias(c) for c, t in kinds.items()]
        )

    def chunk(i):
        swapped = F.when((k == 4) & (n > 1) & (i < 2), 1 - i).otherwise(i)
        piece = F.col("pieces")[swapped.cast("int")]
        return frame(i + 1, "chunk", swapped, piece, F.when((k == 3) & (i == 0), "bad").otherwise(F.sha2(piece, 256)))

    sent = n - F.when((k == 1) & (n > 0), 1).otherwise(0)
    chunks = F.when(sent > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), sent - 1), chunk)).otherwise(none)
    commit = F.when(k == 6, none).otherwise(F.array(frame(sent + 1, "commit")))
    begin = frame(F.lit(0), "begin")
    every = F.concat(F.when(k == 2, F.array(begin, begin)).otherwise(F.array(begin)), chunks, commit)
    digest = F.when(F.col("doc_id") % 11 == 5, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2("text", 256))
    rows = docs.select(
        "doc_id",
        n.alias("expected_chunks"),
        (F.octet_length("text") - F.when(k == 5, 1).otherwise(0)).alias("expected_len"),
        digest.alias("expected_hash"),
        F.explode(every).alias("f"),
    )
    return tr.frames_from(
        rows.select(
            F.col("doc_id").alias("transfer"),
            instant(F.lit(1000) + F.col("f.seq")).alias("at"),
            "f.seq", "f.kind", "f.idx", F.col("f.piece").alias("data"), "f.hash",
            "expected_chunks", "expected_len", "expected_hash",
            F.col("expected_hash").alias("aggregate_hash"),
            F.lit(600_000).alias("deadline_ms"),
        )
    )


def sentinel_frame(spark):
    values = {"transfer": F.lit("late"), "at": instant(F.lit(10_000_000)), "seq": F.lit(0), "kind": F.lit("abort")}
    return spark.range(1).select(*[values.get(c, F.lit(None)).alias(c) for c in ("transfer", "at", *tr.FRAME)])


FRAMES = f"""d AS (SELECT doc_id, {N} AS n, doc_id % 7 AS k, doc_id % 11 = 5 AS wrong FROM documents),
  c AS (SELECT *, n - (k = 1 AND n > 0)::INTEGER AS sent FROM d),
  bad AS (SELECT doc_id, n, k, sent, CASE WHEN k = 3 AND sent > 0 THEN 1 WHEN k = 4 AND n > 1 THEN 1 WHEN k <> 6 AND (sent < n OR k = 5 OR wrong) THEN sent + 1 END AS bad_seq,
    CASE WHEN k = 3 AND sent > 0 THEN 'failed: hash mismatch' WHEN k = 4 AND n > 1 THEN 'failed: out of order' ELSE 'failed: commit check' END AS why FROM c),
  fr AS (SELECT *, unnest(range(sent + CASE WHEN k = 6 THEN 1 ELSE 2 END)) AS seq FROM bad),
  oc AS (SELECT doc_id::VARCHAR AS transfer, seq, CASE WHEN seq = 0 THEN 'begin' WHEN seq <= sent THEN 'chunk' ELSE 'commit' END AS kind,
    CASE WHEN seq BETWEEN 1 AND sent THEN CASE WHEN k = 4 AND n > 1 AND seq <= 2 THEN 2 - seq ELSE seq - 1 END END AS idx,
    CASE WHEN seq > bad_seq THEN 'ignored: stream is over' WHEN seq = bad_seq THEN why WHEN seq = 0 THEN 'begun' WHEN seq <= sent THEN 'accepted' ELSE 'closed' END AS outcome FROM fr
    UNION ALL SELECT doc_id::VARCHAR, 0, 'begin', NULL, 'ignored: number already used' FROM bad WHERE k = 2
    UNION ALL SELECT doc_id::VARCHAR, sent + 1, 'lease', NULL, 'failed: expired' FROM bad WHERE k = 6)"""


def outcomes(spark, sf_dir, **how):
    stream = in_windows(frames(spark, sf_dir), ["transfer", "seq"], sentinel_frame(spark)).withWatermark("at", "300 seconds")
    return st.drain(tr.transfer_outcomes(stream, **how), typed_state=True).drop("window").filter("transfer <> 'late'")


@register("ordered_chunk_stream", f"WITH {FRAMES} SELECT * FROM oc")
def ordered_chunk_stream(spark, sf_dir):
    return outcomes(spark, sf_dir)


@register(
    "chunk_stream_whole_artifact",
    f"""WITH {FRAMES}, cl AS (SELECT transfer FROM oc WHERE outcome = 'closed') SELECT transfer, seq, kind, idx,
    CASE WHEN outcome = 'accepted' AND transfer NOT IN (SELECT transfer FROM cl) THEN 'dropped: stream failed' ELSE outcome END AS outcome FROM oc""",
)
def chunk_stream_whole_artifact(spark, sf_dir):
    return outcomes(spark, sf_dir, finalise="whole artifact")


@register(
    "unordered_chunk_stream",
    f"""WITH {FRAMES.replace("WHEN k = 4 AND n > 1 THEN 1 ", "").replace("WHEN k = 4 AND n > 1 THEN 'failed: out of order' ", "")} SELECT * FROM oc""",
)
def unordered_chunk_stream(spark, sf_dir):
    return outcomes(spark, sf_dir, order="unordered")


@register(
    "header_check_stream",
    f"WITH {TENSORS}, {DIMS}, {audit_sql('vectors', 'a')} SELECT artifact, error FROM a",
)
def header_check_stream(spark, sf_dir):
    artifacts, tensors = bundles(spark, sf_dir)
    headers = tensors.groupBy("artifact", "contract", "side").agg(
        F.collect_list(F.struct("pos", "name", "dtype", "shape")).alias("tensors")
    )
    stream = in_windows(headers, ["artifact"])
    return st.drain(stream, st.header_audit(ports(spark))).select("artifact", "error")


@register(
    "lease_expiry_stream",
    """WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS at_ms, event_type FROM events),
    b AS (SELECT event_id AS transfer, at_ms, at_ms + 900000 - event_id % 5 * 180000 AS deadline_ms, event_type FROM t),
    c AS (SELECT event_id AS transfer, at_ms + event_id % 3 * 300000 AS closed_ms FROM t WHERE event_type IN ('purchase', 'click'))
    SELECT transfer, CASE WHEN closed_ms < deadline_ms THEN 'committed' ELSE 'transfer lease expired' END AS outcome FROM b LEFT JOIN c USING (transfer)""",
)
def lease_expiry_stream(spark, sf_dir):
    """Every event opens a transfer for 3 to 15 minutes; purchases and clicks commit theirs, some too late."""
    at = epoch_ms("ts")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("transfer"), at.alias("_ms"), "event_type")
    begins = rows.select(
        "transfer", instant(F.col("_ms")).alias("at"), (F.col("_ms") + 900_000 - F.col("transfer") % 5 * 180_000).alias("deadline_ms")
    )
    closes = rows.filter("event_type IN ('purchase', 'click')").select(
        "transfer", instant(F.col("_ms") + F.col("transfer") % 3 * 300_000).alias("closed_at"), F.lit("committed").alias("how")
    )
    far = instant(F.lit(10**14))
    late = spark.range(1).select(
        F.lit(-1).alias("transfer"), far.alias("at"), far.alias("closed_at"), F.lit(10**14).alias("deadline_ms"), F.lit("").alias("how")
    )
    # Windows are dealt by key, so rows come up to the length of the log late.
    opened, closed = in_windows(begins, ["transfer"], late), in_windows(closes, ["transfer"], late)
    found = st.drain(tm.lease_outcomes(opened, closed, "10000 days"), typed_state=True)
    return found.filter("transfer >= 0").select("transfer", "outcome")


WAITS = """q AS (SELECT event_id AS request, user_id AS id, epoch_us(ts) // 1000000 - 1704067200 AS at_ms, CASE WHEN event_id % 50 = 3 THEN 30001 WHEN event_id % 50 = 4 THEN 0 ELSE 1 + event_id % 30000 END AS timeout_ms FROM events WHERE event_type = 'view'),
  o AS (SELECT user_id AS id, min(epoch_us(ts) // 1000000 - 1704067200) AS stored FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


def waits(spark, sf_dir):
    """Time runs a thousand times faster: seconds of the log count as milliseconds."""
    ms = F.floor(epoch_ms("ts") / 1000) - 1704067200
    rows, odd = table(spark, sf_dir, "events").withColumn("_ms", ms), F.col("event_id") % 50
    requests = rows.filter("event_type = 'view'").select(
        F.col("event_id").alias("request"), F.col("user_id").alias("id"), instant(F.col("_ms")).alias("at"),
        F.when(odd == 3, 30001).when(odd == 4, 0).otherwise(F.col("event_id") % 30000 + 1).alias("timeout_ms"),
    )
    stored = rows.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(
        instant(F.min("_ms")).alias("stored_at")
    )
    return requests, stored


FOUND = f"WITH {WAITS} SELECT request, q.id, CASE WHEN timeout_ms NOT BETWEEN 1 AND 30000 THEN 'timeout out of range' WHEN stored <= at_ms + timeout_ms THEN 'found' ELSE 'timed out' END AS outcome FROM q LEFT JOIN o USING (id)"


@register("wait_for_objects", FOUND)
def wait_for_objects(spark, sf_dir):
    return st.wait_for_objects_batch(*waits(spark, sf_dir))


@register("wait_for_objects_stream", FOUND)
def wait_for_objects_stream(spark, sf_dir):
    requests, stored = waits(spark, sf_dir)
    far = instant(F.lit(10**14))
    late = spark.range(1).select(F.lit(-1).alias("request"), F.lit(-1).alias("id"), far.alias("at"), F.lit(1).alias("timeout_ms"), far.alias("stored_at"))
    asked, came = in_windows(requests, ["request"], late), in_windows(stored, ["id"], late)
    # Windows are dealt by key, so rows come up to the length of the log late.
    found = st.drain(tm.wait_for_objects(asked, came, stored, "10000 days"), typed_state=True)
    return found.filter("request >= 0").select("request", "id", "outcome")


@register("bounded_in_flight_windows", "SELECT 8::BIGINT AS windows, count(*) AS rows FROM events")
def bounded_in_flight_windows(spark, sf_dir):
    events, folder = table(spark, sf_dir, "events"), st.new_folder(spark)
    events.repartition(8).write.parquet(folder)
    stream = st.read_windowed(spark, events.schema, folder, in_flight=0)
    done = st.drain(stream)
    return done.agg(F.countDistinct("window").alias("windows"), F.count(F.lit(1)).alias("rows"))


@register(
    "policy_per_output_stream",
    "SELECT event_id, round(value * value / 7.0::DOUBLE, 6) AS loss, event_type = 'error' AS failed FROM events",
)
def policy_per_output_stream(spark, sf_dir):
    def policy(batch):
        loss = F.round(F.col("value") * F.col("value") / F.lit(7.0), 6)
        return batch.select("event_id", loss.alias("loss"), (F.col("event_type") == "error").alias("failed"))

    stream = in_windows(table(spark, sf_dir, "events"), ["event_id"])
    return st.drain(stream, policy, order=["ts", "event_id"]).select("event_id", "loss", "failed")


@register(
    "two_port_fan_in_stream",
    f"""WITH {DELIVERED} SELECT graph_id, vertex, step, a.payload AS p1, b.payload AS p2, CASE WHEN a.address <> b.address THEN 'ports name different receivers' END AS error
    FROM (SELECT * FROM d WHERE ordinal = 0) a JOIN (SELECT * FROM d WHERE ordinal = 1) b USING (graph_id, vertex, step)""",
)
def two_port_fan_in_stream(spark, sf_dir):
    sent = deliveries(spark, sf_dir).withColumn("at", instant(F.col("step") * 1000))
    sides = [
        in_windows(sent.filter(F.col("ordinal") == i), ["graph_id", "vertex", "step"]).withWatermark("at", "1 day")
        for i in (0, 1)
    ]
    return st.drain(st.fan_in_stream(*sides, ["graph_id", "vertex", "step"], "1 hour")).drop("window")


@register(
    "live_or_durable_fallback",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN sha256(d.text) WHEN quality = 1 AND d.doc_id % 2 = 0 THEN sha256(lower(d.text)) END AS digest,
    CASE WHEN d.doc_id % 3 = 0 THEN 'live' WHEN quality = 1 AND d.doc_id % 2 = 0 THEN 'durable' END AS source
    FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def live_or_durable_fallback(spark, sf_dir):
    """A third of the texts came live; those of good quality are stored as well, in lower case, half of them for replay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    stored = docs.join(kept, "doc_id").select("doc_id", F.lower("text").alias("stored"))
    live = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    durability = F.when(F.col("doc_id") % 2 == 0, "replay required").otherwise("ephemeral")
    found = docs.join(stored, "doc_id", "left").withColumn("_data", st.live_or_durable(live, F.col("stored"), durability))
    source = F.when(F.col("_data").isNotNull(), F.when(live.isNotNull(), "live").otherwise("durable"))
    return found.select("doc_id", F.sha2("_data", 256).alias("digest"), source.alias("source"))


@register(
    "mailbox_chain",
    """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS to_end FROM events""",
)
def mailbox_chain(spark, sf_dir):
    """Inboxes named from the event order, then the order found again from the names."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    named = om.name_next_inbox(rows, ["user_id"], ["event_id"], F.md5(F.col("event_id").cast("string")))
    return om.follow_inboxes(named).select("user_id", "event_id", "to_end")


@register(
    "node_progress_stream",
    "SELECT user_id % 10 AS node, count(*) AS completed, count(*) >= 2000 AS reached FROM events GROUP BY 1",
)
def node_progress_stream(spark, sf_dir):
    target = st.completion_target(nodes=1, inputs=1000, passes=2)
    stream = in_windows(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"])
    counted = st.progress(stream.withColumn("node", F.col("user_id") % 10), "node")
    done = st.drain(counted, mode="update", keys=["node"]).select("node", "completed")
    return done.withColumn("reached", F.col("completed") >= target)
