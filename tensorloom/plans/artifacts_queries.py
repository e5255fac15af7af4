"""Registered artifact-store queries: documents as objects in 256-character chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tensorloom.functions.cols import epoch_ms
from tensorloom.plans.catalog import register, table
from tensorloom.session import durable, ensure_checkpoint_dir
from tensorloom.sources import artifacts as sa
from tensorloom.sources.checkpoints import read_checkpoint, write_checkpoints
from tensorloom.sources.pieces import hashes, read_ranges, reassemble

CHUNK = 256
NOW = 1000
N = "ceil(length(text) / 256.0)::BIGINT"


def objects(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("data"), "source", "lang"
    )


@register(
    "put_objects",
    "SELECT doc_id, sha256(doc_id || '/' || text) AS id, strlen(text) AS size, NULL::VARCHAR AS error FROM documents",
)
def put_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    identity = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), "text"), 256)
    return sa.put(rows, "text", identity).drop("text")


@register(
    "put_last_write_wins",
    """SELECT user_id AS id, CASE WHEN user_id % 10 <> 0 THEN arg_max(props, event_id) END AS data, max(event_id) AS seq, count(*) AS writes,
    CASE WHEN user_id % 10 = 0 THEN 'object is managed by the transfer protocol' END AS error FROM events GROUP BY user_id""",
)
def put_last_write_wins(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("props").alias("data")
    )
    return sa.put_with_ids(writes, writes.filter("id % 10 = 0"), "data")


@register(
    "get_objects",
    """WITH i AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS id FROM labels)
    SELECT i.id, strlen(text) AS size, CASE WHEN text IS NULL THEN 'object not found' END AS error FROM i LEFT JOIN documents ON doc_id = i.id""",
)
def get_objects(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1000000000).otherwise(0)).alias("id")
    )
    found = sa.get(ids, objects(spark, sf_dir))
    return found.select("id", F.octet_length("data").cast("bigint").alias("size"), "error")


@register(
    "delete_objects",
    "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_objects(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return sa.delete(objects(spark, sf_dir), gone).select("id", "source")


@register(
    "read_byte_ranges",
    """WITH r AS (SELECT doc_id, doc_id AS id, (doc_id * 37) % 900 AS off, doc_id % 5 * 100 AS len FROM documents)
    SELECT id, off AS "offset", len AS length, CASE WHEN len = 0 THEN '' ELSE substring(text, off + 1, len) END AS piece,
      NULL::VARCHAR AS error FROM r JOIN documents USING (doc_id)""",
)
def read_byte_ranges(spark, sf_dir):
    stored = objects(spark, sf_dir)
    ranges = stored.select(
        "id", (F.col("id") * 37 % 900).alias("offset"), (F.col("id") % 5 * 100).alias("length")
    )
    return sa.read_ranges(ranges, stored, "data")


def piece_table(spark, sf_dir):
    """Object table and pieces of 256 characters; empty objects have a row and no piece."""
    stored = objects(spark, sf_dir).select("id", "data")
    pieces = sa.chunk_data(stored, "data", CHUNK).select("id", (F.col("idx") * CHUNK).cast("bigint").alias("start"), F.col("piece").alias("data"))
    return stored.select("id", F.length("data").cast("bigint").alias("extent")), pieces


@register(
    "read_ranges_across_pieces",
    """WITH r AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS id, text, doc_id % 10 = 0 AS lost, length(text) AS n,
      (doc_id * 37) % 900 AS off, doc_id % 7 * 150 AS len FROM documents),
    e AS (SELECT *, least(off + len, n) AS stop FROM r),
    t AS (SELECT *, unnest(range(off // 256, (stop - 1) // 256 + 1)) AS p FROM e WHERE stop > off AND NOT lost)
    SELECT id, off AS "offset", len AS length, greatest(p * 256 - off, 0) AS at,
      substring(text, greatest(off, p * 256) + 1, least(stop, (p + 1) * 256) - greatest(off, p * 256)) AS data, NULL::VARCHAR AS error FROM t
    UNION ALL SELECT id, off, len, 0, CASE WHEN len = 0 OR NOT lost THEN '' END, CASE WHEN len > 0 AND lost THEN 'object not found' END
    FROM e WHERE lost OR stop <= off""",
)
def read_ranges_across_pieces(spark, sf_dir):
    stored, pieces = piece_table(spark, sf_dir)
    lost = F.when(F.col("id") % 10 == 0, 1000000000).otherwise(0)
    ranges = stored.select(
        (F.col("id") + lost).alias("id"), (F.col("id") * 37 % 900).alias("offset"), (F.col("id") % 7 * 150).alias("length")
    )
    return read_ranges(ranges, stored, pieces, "data", width=1024)


def upload_parts(spark, sf_dir):
    """Documents in parts; part 1 is sent twice where id % 5 = 2, the last is lost where id % 5 = 1."""
    n = F.ceil(F.length("data") / F.lit(CHUNK))
    cut = sa.chunk_data(objects(spark, sf_dir).select("id", "data", n.alias("part_count")), "data", CHUNK)
    uploads = objects(spark, sf_dir).select("id", n.cast("bigint").alias("part_count"))
    parts = cut.filter("NOT (id % 5 = 1 AND idx = part_count - 1)").select(
        "id", (F.col("idx") + 1).alias("part"), F.col("idx").cast("bigint").alias("seq"), F.col("piece").alias("data")
    )
    again = parts.filter("id % 5 = 2 AND part = 1").withColumn("seq", F.lit(10**6)).withColumn("data", F.translate("data", "e", "E"))
    return uploads, parts.unionByName(again)


@register(
    "assemble_multipart",
    f"""WITH n AS (SELECT doc_id AS id, text, {N} AS part_count FROM documents),
    k AS (SELECT *, CASE WHEN id % 5 = 1 THEN CASE WHEN part_count = 1 THEN 'upload never begun' ELSE 'parts incomplete' END END AS error,
      CASE WHEN id % 5 = 2 THEN translate(substring(text, 1, 256), 'e', 'E') || substring(text, 257) ELSE text END AS whole FROM n)
    SELECT id, part_count, error, CASE WHEN error IS NULL THEN strlen(whole) END AS size,
      CASE WHEN error IS NULL THEN sha256(whole) END AS digest FROM k""",
)
def assemble_multipart(spark, sf_dir):
    judged, pieces, _ = sa.assemble_parts(*upload_parts(spark, sf_dir), "data")
    return judged.join(hashes(pieces, ["id"], "part", "data"), "id", "left").drop("refused")


@register(
    "multipart_refused_parts",
    f"""WITH n AS (SELECT doc_id AS id, {N} AS part_count FROM documents),
    p AS (SELECT id, part_count, unnest(range(1, part_count + 1)) AS part FROM n),
    s AS (SELECT id, CASE WHEN id % 4 = 1 AND part = part_count THEN 0 WHEN id % 4 = 2 AND part = 1 THEN 20000 ELSE part END AS part, part AS seq FROM p)
    SELECT id, part, seq, 'part number out of range' AS error FROM s WHERE part NOT BETWEEN 1 AND 10000""",
)
def multipart_refused_parts(spark, sf_dir):
    """The last part is sent as number 0 where id % 4 = 1, the first as number 20000 where id % 4 = 2."""
    uploads = objects(spark, sf_dir).select("id", "data", F.ceil(F.length("data") / F.lit(CHUNK)).alias("part_count"))
    k, number = F.col("id") % 4, (F.col("idx") + 1).cast("bigint")
    sent = F.when((k == 1) & (number == F.col("part_count")), 0).when((k == 2) & (number == 1), 20000).otherwise(number)
    parts = sa.chunk_data(uploads, "data", CHUNK).select("id", sent.alias("part"), number.alias("seq"), F.col("piece").alias("data"))
    return sa.assemble_parts(uploads.select("id", "part_count"), parts, "data")[2]


@register(
    "multipart_gap_audit",
    """SELECT l_orderkey AS id, max(l_linenumber)::BIGINT AS part_count, CASE WHEN count(DISTINCT l_linenumber) <> max(l_linenumber)
    THEN 'parts incomplete' END AS error FROM lineitem GROUP BY 1""",
)
def multipart_gap_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("part"),
        F.col("l_partkey").alias("seq"),
        F.col("l_returnflag").alias("data"),
    )
    uploads = lines.groupBy("id").agg(F.max("part").cast("bigint").alias("part_count"))
    return sa.assemble_parts(uploads, lines, "data")[0].select("id", "part_count", "error")


BEGIN = f"""b AS (SELECT doc_id AS transfer, text, CASE WHEN doc_id % 11 = 1 THEN 2 ELSE 1 END AS protocol_version,
  {N} + CASE WHEN doc_id % 11 = 2 THEN 10000 ELSE 0 END AS expected_chunks,
  CASE WHEN doc_id % 11 = 3 THEN 0 ELSE length(text) END AS expected_len,
  CASE WHEN doc_id % 11 = 4 THEN 1000 ELSE 1500 END AS deadline_ms FROM documents)"""


@register(
    "begin_transfers",
    f"""WITH {BEGIN} SELECT transfer, CASE WHEN protocol_version <> 1 THEN 'unsupported protocol version' WHEN expected_chunks > 10000 THEN 'chunk count over the limit'
      WHEN (expected_chunks = 0) <> (expected_len = 0) THEN 'zero length needs zero chunks' WHEN deadline_ms <= 1000 THEN 'deadline already expired'
      WHEN transfer IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'transfer id in use' END AS error FROM b""",
)
def begin_transfers(spark, sf_dir):
    k = F.col("id") % 11
    n = F.ceil(F.length("data") / F.lit(CHUNK))
    requests = objects(spark, sf_dir).select(
        F.col("id").alias("transfer"),
        F.when(k == 1, 2).otherwise(1).alias("protocol_version"),
        (n + F.when(k == 2, 10000).otherwise(0)).alias("expected_chunks"),
        F.when(k == 3, 0).otherwise(F.length("data")).alias("expected_len"),
        F.when(k == 4, 1000).otherwise(1500).alias("deadline_ms"),
    )
    taken = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return sa.begin_transfers(requests, taken, F.lit(NOW)).select("transfer", "error")


# Faults by id % 7: 1 last chunk lost, 2 first chunk sent twice, 3 first chunk
# with a wrong hash, 4 past the deadline, 5 declared one character short, 6 an
# index past the end.
def transfers(spark, sf_dir):
    k = F.col("id") % 7
    return objects(spark, sf_dir).select(
        F.col("id").alias("transfer"),
        F.lit("in progress").alias("status"),
        F.ceil(F.length("data") / F.lit(CHUNK)).alias("expected_chunks"),
        (F.length("data") - F.when(k == 5, 1).otherwise(0)).cast("bigint").alias("expected_len"),
        F.sha2("data", 256).alias("expected_hash"),
        F.when(k == 4, 900).otherwise(2000).cast("bigint").alias("deadline_ms"),
    )


def arrivals(spark, sf_dir):
    """Chunks in index order, plus the extra ones of the faults."""
    k = F.col("id") % 7
    stored = objects(spark, sf_dir).select("id", "data", F.ceil(F.length("data") / F.lit(CHUNK)).alias("_n"))
    cut = sa.chunk_data(stored, "data", CHUNK)
    extra = F.when((k == 2) & (F.col("idx") == 0), F.array(F.lit(0), F.lit(1))).when(
        (k == 6) & (F.col("idx") == 0), F.array(F.lit(0), F.lit(2))
    ).otherwise(F.array(F.lit(0)))
    sent = cut.filter(~((k == 1) & (F.col("idx") == F.col("_n") - 1))).withColumn("_x", F.explode(extra))
    return sent.select(
        F.col("id").alias("transfer"),
        (F.col("idx") * 4 + F.col("_x")).cast("bigint").alias("seq"),
        F.lit(NOW).cast("bigint").alias("at_ms"),
        F.when(F.col("_x") == 2, F.col("_n")).otherwise(F.col("idx")).cast("bigint").alias("idx"),
        F.col("piece").alias("data"),
        F.when((k == 3) & (F.col("idx") == 0), "bad").otherwise(F.sha2("piece", 256)).alias("hash"),
    )


ARRIVED = f"""n AS (SELECT doc_id AS transfer, text, {N} AS n FROM documents),
  cut AS (SELECT transfer, n, unnest(range(n)) AS idx, text FROM n),
  a AS (SELECT transfer, idx * 4 + x AS seq, CASE WHEN x = 2 THEN n ELSE idx END AS idx, n, substring(text, (idx * 256 + 1)::INTEGER, 256) AS data
    FROM (SELECT *, unnest(CASE WHEN transfer % 7 = 2 AND idx = 0 THEN [0, 1] WHEN transfer % 7 = 6 AND idx = 0 THEN [0, 2] ELSE [0] END) AS x FROM cut
    WHERE NOT (transfer % 7 = 1 AND idx = n - 1))),
  o AS (SELECT *, length(data) AS len, CASE WHEN transfer % 7 = 4 THEN 'not in progress' WHEN idx >= n THEN 'index out of range'
    WHEN transfer % 7 = 2 AND seq = 1 THEN 'duplicate index' WHEN transfer % 7 = 3 AND idx = 0 THEN 'hash mismatch'
    WHEN transfer % 7 = 5 AND idx = n - 1 THEN 'over the declared length' END AS error FROM a)"""


@register("ingest_chunks", f"WITH {ARRIVED} SELECT transfer, seq, idx, len, error FROM o")
def ingest_chunks(spark, sf_dir):
    return sa.judge_chunks(transfers(spark, sf_dir), arrivals(spark, sf_dir)).select(
        "transfer", "seq", "idx", "len", "error"
    )


def stored_chunks(spark, sf_dir):
    """The chunk table that ingest leaves behind."""
    return durable(sa.ingest_chunks(transfers(spark, sf_dir), arrivals(spark, sf_dir)).filter("error IS NULL"))


@register(
    "stage_chunks",
    f"""WITH {ARRIVED} SELECT transfer, idx, len, CASE WHEN transfer % 2 = 0 THEN 'committed' ELSE 'in progress' END AS status,
    transfer % 2 = 0 AS authoritative FROM o WHERE error IS NULL""",
)
def stage_chunks(spark, sf_dir):
    half = transfers(spark, sf_dir).withColumn(
        "status", F.when(F.col("transfer") % 2 == 0, "committed").otherwise(F.col("status"))
    )
    return sa.stage_chunks(half, stored_chunks(spark, sf_dir)).select("transfer", "idx", "len", "status", "authoritative")


@register(
    "commit_transfers",
    f"""WITH {ARRIVED}, s AS (SELECT transfer, count(*) AS chunks FROM o WHERE error IS NULL GROUP BY transfer),
    j AS (SELECT n.transfer, coalesce(chunks, 0) AS chunks, n.n, CASE WHEN transfer % 7 = 4 THEN 'not in progress'
      WHEN transfer % 13 = 0 THEN 'hash differs from declaration' WHEN coalesce(chunks, 0) <> n THEN 'chunks incomplete' END AS error FROM n LEFT JOIN s USING (transfer))
    SELECT transfer, chunks, CASE WHEN error IS NULL THEN 'committed' ELSE 'in progress' END AS status, error FROM j""",
)
def commit_transfers(spark, sf_dir):
    declared = transfers(spark, sf_dir)
    commits = declared.select(
        "transfer",
        F.lit(NOW).cast("bigint").alias("at_ms"),
        F.when(F.col("transfer") % 13 == 0, "other").otherwise(F.col("expected_hash")).alias("aggregate_hash"),
    )
    return sa.commit_transfers(declared, stored_chunks(spark, sf_dir), commits)


@register(
    "abort_transfers",
    """SELECT doc_id AS transfer, CASE WHEN doc_id % 4 = 0 THEN 'committed' WHEN quality = 0 THEN 'aborted' ELSE 'in progress' END AS status,
    CASE WHEN doc_id % 4 <> 0 AND quality = 0 THEN 'low quality' END AS reason, CASE WHEN doc_id % 4 = 0 AND quality = 0 THEN 'not in progress' END AS error
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def abort_transfers(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("transfer"),
        F.when(F.col("doc_id") % 4 == 0, "committed").otherwise("in progress").alias("status"),
    )
    aborts = table(spark, sf_dir, "labels").filter("quality = 0").select(
        F.col("doc_id").alias("transfer"), F.lit("low quality").alias("reason")
    )
    return sa.abort_transfers(known, aborts)


@register(
    "expire_transfers",
    """SELECT event_id AS transfer, CASE WHEN epoch_us(ts) // 1000 + 300000 <= epoch_ms(TIMESTAMP '2024-01-15') THEN 'aborted' ELSE 'in progress' END AS status,
    CASE WHEN epoch_us(ts) // 1000 + 300000 <= epoch_ms(TIMESTAMP '2024-01-15') THEN 'transfer lease expired' END AS reason FROM events""",
)
def expire_transfers(spark, sf_dir):
    opened = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transfer"),
        F.lit("in progress").alias("status"),
        (epoch_ms("ts") + 300000).alias("deadline_ms"),
    )
    as_of = epoch_ms(F.lit("2024-01-15").cast("timestamp_ntz"))
    return sa.expire_transfers(opened, as_of).drop("deadline_ms")


@register(
    "chunks_after_abort",
    f"WITH {ARRIVED} SELECT transfer, idx FROM o WHERE error IS NULL AND transfer % 3 <> 0",
)
def chunks_after_abort(spark, sf_dir):
    gone = transfers(spark, sf_dir).withColumn(
        "status", F.when(F.col("transfer") % 3 == 0, "aborted").otherwise(F.col("status"))
    )
    return sa.live_chunks(stored_chunks(spark, sf_dir), gone).select("transfer", "idx")


@register(
    "object_catalogue",
    """SELECT source AS namespace, count(*) AS objects, sum(strlen(text))::BIGINT AS bytes, min(doc_id) AS first_written, max(doc_id) AS last_written
    FROM documents GROUP BY source""",
)
def object_catalogue(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("namespace"), F.octet_length("text").alias("size"), "doc_id"
    )
    return sa.catalogue(rows, "namespace", "size", "doc_id")


@register(
    "resolve_references",
    """WITH r AS (SELECT doc_id AS ref, doc_id, text, ['committed', 'transfer', 'stream'][doc_id % 3 + 1] AS kind, doc_id % 7 AS k FROM documents),
    e AS (SELECT *, CASE WHEN kind = 'committed' AND k = 0 THEN 'object not found' WHEN kind = 'transfer' AND k IN (1, 2) THEN 'transfer not committed'
      WHEN kind = 'stream' AND k = 3 THEN 'ticket not found' WHEN kind = 'stream' AND k = 4 THEN 'ticket does not match fallback'
      WHEN kind = 'stream' AND doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 'live data missing'
      WHEN kind = 'stream' AND doc_id % 2 = 0 AND k IN (1, 2) THEN 'live and stored data missing' END AS error FROM r)
    SELECT ref, kind, error, CASE WHEN error IS NULL THEN CASE kind WHEN 'committed' THEN 'object' WHEN 'transfer' THEN 'transfer' ELSE
      CASE WHEN doc_id % 2 = 1 THEN 'live' ELSE 'fallback' END END END AS source, CASE WHEN error IS NULL THEN md5(text) END AS digest FROM e""",
)
def resolve_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    k = d % 7
    kind = F.element_at(F.array(F.lit("committed"), F.lit("transfer"), F.lit("stream")), (d % 3 + 1).cast("int"))
    references = docs.select(
        d.alias("ref"),
        kind.alias("kind"),
        d.alias("id"),
        F.when(kind == "stream", d).alias("fallback_id"),
    )
    stored = docs.filter(k != 0).select(d.alias("id"), F.col("text").alias("data"))
    verified = docs.filter(~k.isin(1, 2)).select(d.alias("transfer"), F.col("text").alias("data"))
    tickets = docs.filter(k != 3).select(
        d.alias("ticket"),
        (d + F.when(k == 4, 1).otherwise(0)).alias("transfer"),
        F.when(d % 4 == 0, "replay required").otherwise("live only").alias("durability"),
    )
    live = docs.filter(d % 2 == 1).select(d.alias("ticket"), F.col("text").alias("data"))
    out = sa.resolve(references, stored, verified, tickets, live)
    return out.select("ref", "kind", "error", "source", F.md5("data").alias("digest"))


@register(
    "chunk_payloads",
    f"""WITH n AS (SELECT doc_id, text, unnest(range({N})) AS idx FROM documents)
    SELECT doc_id, idx::INTEGER AS idx, substring(text, (idx * 256 + 1)::INTEGER, 256) AS piece FROM n""",
)
def chunk_payloads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sa.chunk_data(docs, "text", CHUNK)


@register(
    "check_tickets",
    """WITH t AS (SELECT doc_id, doc_id % 9 AS k, text FROM documents)
    SELECT doc_id AS transfer, CASE WHEN k IN (1, 2, 3) THEN 'descriptor does not match envelope' WHEN k = 4 THEN 'durable object does not match transfer'
      WHEN k = 5 THEN 'declared lengths differ' WHEN k IN (6, 7) THEN 'received data does not match ticket'
      WHEN k = 8 THEN 'received payload is invalid' END AS error FROM t""",
)
def check_tickets(spark, sf_dir):
    k = F.col("doc_id") % 9

    def off(n, value, other):
        return F.when(k == n, other).otherwise(value)

    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("transfer"),
        F.lit("c").alias("contract"), off(1, F.lit("c"), F.lit("d")).alias("envelope_contract"),
        F.lit(1).alias("version"), off(2, F.lit(1), F.lit(2)).alias("envelope_version"),
        F.lit("h").alias("hash"), off(3, F.lit("h"), F.lit("g")).alias("envelope_hash"),
        off(4, F.col("doc_id"), F.lit(-1)).alias("eventual_id"),
        F.length("text").alias("expected_len"),
        off(5, F.length("text"), F.lit(-1)).alias("header_len"),
        off(6, F.sha2("text", 256), F.lit("other")).alias("expected_hash"),
        off(7, F.substring("text", 1, 8), F.lit("\u0000")).alias("header"),
        F.col("text").alias("data"),
        F.when(k == 8, "dtype embedding").alias("bundle_error"),
    )
    return sa.check_tickets(rows).select("transfer", "error")


@register(
    "emit_and_receive",
    """WITH e AS (SELECT doc_id, lang AS meta, sha256(doc_id || '/' || source || '/' || text) AS tensor_id, text FROM documents)
    SELECT sha256(tensor_id || '/' || meta) AS emission_id, tensor_id, meta AS lang, strlen(text)::INTEGER AS bytes FROM e""",
)
def emit_and_receive(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    stored, emissions = sa.emit(docs, ["doc_id", "source"], "text", "lang")
    back = sa.receive(emissions.select("emission_id"), emissions, stored)
    return back.select("emission_id", "tensor_id", "lang", F.octet_length("text").alias("bytes"))


@register(
    "checkpoint_every_n_steps",
    """SELECT l_linenumber AS step, count(*) AS params, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1""",
)
def checkpoint_every_n_steps(spark, sf_dir):
    """Line numbers as steps: saved, the sixth saved again with other values first, and read back."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("step"), "l_quantity")
    folder = f"{ensure_checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}"
    write_checkpoints(rows.filter("step = 6").withColumn("l_quantity", -F.col("l_quantity")), "step", 3, folder)
    saved = None
    for step in write_checkpoints(rows, "step", 3, folder):
        part = read_checkpoint(spark, folder, step)
        saved = part if saved is None else saved.unionByName(part)
    return saved.groupBy("step").agg(F.count(F.lit(1)).alias("params"), F.round(F.sum("l_quantity"), 2).alias("total"))


@register(
    "constant_generator",
    "SELECT c_custkey, (i - 1)::INTEGER AS idx, i::DOUBLE AS value FROM customer, range(1, 7) t(i)",
)
def constant_generator(spark, sf_dir):
    made = sa.constant_matrices(table(spark, sf_dir, "customer").select("c_custkey"))
    return made.select("c_custkey", F.posexplode("v").alias("idx", "value"))


# Ranged reads of 600 characters over pieces of 256.
READ = 600
CUTS = "CASE WHEN n = 0 THEN 0 ELSE (n - 1) // 256 + (n - 1) // 600 - (n - 1) // 19200 + 1 END"


@register(
    "reassemble_ranges",
    f"""WITH d AS (SELECT doc_id AS id, text, length(text) AS n, doc_id % 6 = 1 AND length(text) >= 600 AS moved FROM documents)
    SELECT id, CASE WHEN NOT moved THEN {CUTS} END AS pieces, CASE WHEN NOT moved THEN strlen(text) END AS size,
    CASE WHEN moved THEN 'ranges do not cover the object' END AS error, CASE WHEN NOT moved AND n > 0 THEN sha256(text) END AS digest FROM d""",
)
def reassemble_ranges(spark, sf_dir):
    """Every object is read until a read is short or empty; where id % 6 = 1 the second read is one too far."""
    stored, pieces = piece_table(spark, sf_dir)
    reads = stored.select("id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("extent") / READ))).alias("k", "_r"))
    moved = F.when((F.col("id") % 6 == 1) & (F.col("k") == 1), 1).otherwise(0)
    ranges = reads.select("id", (F.col("_r") * READ + moved).alias("offset"), F.lit(READ).cast("bigint").alias("length"))
    read = read_ranges(ranges, stored, pieces, "data", width=1024)
    whole, parts = reassemble(read.select("id", (F.col("offset") + F.col("at")).alias("offset"), "data"), "data")
    sound = F.col("error").isNull()
    return whole.join(hashes(parts, ["id"], "start", "data"), "id", "left").select(
        "id", F.when(sound, F.col("pieces")).alias("pieces"), F.when(sound, F.col("size")).alias("size"), "error", "digest"
    )
