"""Artifact store as tables: objects, multipart uploads and chunked transfers.

``data`` columns are binary or text. What is assembled from parts, chunks or
ranged reads stays in ordered pieces (``sources.pieces``) at every size, and is
hashed piece by piece.

Transfers: transfer, status ('in progress'/'committed'/'aborted'),
expected_chunks, expected_len, expected_hash, deadline_ms. Arrivals: transfer,
seq (arrival order), at_ms, idx, data, hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cols import first_failure
from tensorloom.session import written
from tensorloom.sources.pieces import hashes, with_starts

# Upload limit, part limit, transfer protocol, chunk size.
MAX_OBJECT_BYTES = 1024 * 1024 * 1024
MAX_PARTS = 10_000
PROTOCOL_VERSION = 1
CHUNK_BYTES = 16 * 1024 * 1024
NIL_ID = "00000000-0000-0000-0000-000000000000"


# -- objects -----------------------------------------------------------------


def put(df: DataFrame, data: str, identity: Column | None = None) -> DataFrame:
    """Assign ids: random, or a given deterministic one; oversized data is refused."""
    identity = F.expr("uuid()") if identity is None else identity
    size = F.octet_length(data).cast("bigint")
    return (
        df.withColumn("id", identity)
        .withColumn("size", size)
        .withColumn("error", F.when(F.col("size") > MAX_OBJECT_BYTES, "upload exceeds maximum size"))
    )


def put_with_ids(writes: DataFrame, managed: DataFrame, data: str) -> DataFrame:
    """Last write per id wins; ids owned by transfers are refused."""
    latest = writes.groupBy("id").agg(
        F.max_by(data, "seq").alias(data), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("writes")
    )
    owned = managed.select("id").distinct().withColumn("_owned", F.lit(True))
    joined = latest.join(owned, "id", "left")
    return joined.select(
        "id",
        F.when(F.col("_owned").isNull(), F.col(data)).alias(data),
        "seq",
        "writes",
        F.when(F.col("_owned"), "object is managed by the transfer protocol").alias("error"),
    )


def get(ids: DataFrame, objects: DataFrame) -> DataFrame:
    found = objects.withColumn("_found", F.lit(True))
    return (
        ids.join(found, "id", "left")
        .withColumn("error", F.when(F.col("_found").isNull(), "object not found"))
        .drop("_found")
    )


def delete(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects that remain; deleting an unknown id changes nothing."""
    return objects.join(ids.select("id"), "id", "left_anti")


def byte_range(data: Column | str, offset: Column, length: Column) -> Column:
    """Slice that is short or empty past the end."""
    data = F.col(data) if isinstance(data, str) else data
    most = F.lit((1 << 31) - 2).cast("bigint")
    start, n = F.least(offset.cast("bigint"), most), F.least(length.cast("bigint"), most)
    return F.substring(data, (start + 1).cast("int"), n.cast("int"))


def read_ranges(ranges: DataFrame, objects: DataFrame, data: str) -> DataFrame:
    """Ranges (id, offset, length); a zero length is empty even without the object."""
    joined = ranges.join(objects.select("id", F.col(data).alias("_data")), "id", "left")
    empty = F.lit("").cast(dict(objects.dtypes)[data])
    piece = F.when(F.col("length") == 0, empty).otherwise(
        byte_range("_data", F.col("offset"), F.col("length"))
    )
    missing = (F.col("length") > 0) & F.col("_data").isNull()
    return joined.withColumn("piece", piece).withColumn("error", F.when(missing, "object not found")).drop("_data")


def chunk_data(df: DataFrame, data: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Cut ``data`` into pieces of ``size``: adds idx and piece; empty data has none."""
    n = F.ceil(F.length(data) / F.lit(size)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    others = [c for c in df.columns if c != data]
    spread = df.select(*others, data, F.explode(starts).alias("idx"))
    return spread.select(
        *others, "idx", F.substring(F.col(data), F.col("idx") * size + 1, F.lit(size)).alias("piece")
    )


def catalogue(objects: DataFrame, namespace: str, size: str, stamp: str) -> DataFrame:
    return objects.groupBy(namespace).agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum(size).alias("bytes"),
        F.min(stamp).alias("first_written"),
        F.max(stamp).alias("last_written"),
    )


# -- multipart uploads -------------------------------------------------------


def assemble_parts(uploads: DataFrame, parts: DataFrame, data: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finish uploads (id, part_count): parts must be exactly 1..part_count.

    ``parts`` has id, part, seq and data. A part sent again replaces the earlier
    one; of two with one ``seq`` the one of larger digest counts. Returns

    * the uploads: id, part_count, error, size (of the kept parts), refused (parts
      whose number is out of range, which never enter);
    * the piece table of the sound ones: id, part, start, data;
    * the refused parts: id, part, seq, error.
    """
    number = F.col("part").between(1, MAX_PARTS)
    refused = parts.filter(~F.coalesce(number, F.lit(False))).select("id", "part", "seq", F.lit("part number out of range").alias("error"))
    entered = parts.filter(number).withColumn("_rank", F.struct("seq", F.xxhash64(data)))
    # Parts are counted and placed without payload; payload moves once, by (id, part).
    extent = F.struct(F.length(data).alias("length"), F.octet_length(data).alias("bytes"))
    slim = entered.groupBy("id", "part").agg(F.max_by(extent, "_rank").alias("_e")).select("id", "part", "_e.*")
    shape = slim.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("part").alias("_hi"), F.sum("bytes").cast("bigint").alias("_size")
    )
    lost = refused.groupBy("id").agg(F.count(F.lit(1)).alias("_refused"))
    error = first_failure(
        (~F.col("part_count").between(1, MAX_PARTS), "part count out of range"),
        (F.col("_n").isNull(), "upload never begun"),
        ((F.col("_n") != F.col("part_count")) | (F.col("_hi") != F.col("part_count")), "parts incomplete"),
    )
    judged = uploads.join(shape, "id", "left").join(lost, "id", "left").withColumn("error", error).select(
        "id", "part_count", "error", F.when(F.col("error").isNull(), F.col("_size")).alias("size"),
        F.coalesce("_refused", F.lit(0).cast("bigint")).alias("refused"),
    )
    sound = judged.filter("error IS NULL").select("id")
    placed = with_starts(slim.join(sound, "id", "left_semi"), "part", "length").select("id", "part", "start")
    kept = entered.groupBy("id", "part").agg(F.max_by(data, "_rank").alias(data))
    return judged, kept.join(placed, ["id", "part"]).select("id", "part", "start", data), refused


# -- transfers ---------------------------------------------------------------


def begin_transfers(requests: DataFrame, objects: DataFrame, now_ms: Column) -> DataFrame:
    """First broken rule of each request, else in progress."""
    used = objects.select(F.col("id").alias("transfer")).distinct().withColumn("_used", F.lit(True))
    joined = requests.join(used, "transfer", "left")
    rule = first_failure(
        (F.col("protocol_version") != PROTOCOL_VERSION, "unsupported protocol version"),
        (F.col("transfer").cast("string") == NIL_ID, "nil transfer id"),
        (F.col("expected_chunks") > MAX_PARTS, "chunk count over the limit"),
        ((F.col("expected_chunks") == 0) != (F.col("expected_len") == 0), "zero length needs zero chunks"),
        (F.col("deadline_ms") <= now_ms, "deadline already expired"),
        (F.col("_used").isNotNull(), "transfer id in use"),
    )
    return joined.withColumn("error", rule).withColumn(
        "status", F.when(F.col("error").isNull(), "in progress")
    ).drop("_used")


def judge_chunks(transfers: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Outcome of every arrival without its payload, as if they were handled in ``seq`` order.

    Rules: transfer in progress, index in range, index not stored yet, hash
    matches, stored length stays within the declaration. A chunk rejected for
    its hash or length does not occupy its index.

    Payload is hashed at the scan. Of the sound arrivals one per (index, length)
    can be stored, since room only shrinks: those run in order through a fold
    whose state is the room left and one bit per index.
    """
    declared = transfers.select("transfer", "status", "expected_chunks", "expected_len", "deadline_ms")
    slim = arrivals.withColumns({"_len": F.length("data").cast("bigint"), "_sound": F.sha2("data", 256) == F.col("hash")}).drop("data")
    live = F.coalesce((F.col("status") == "in progress") & (F.col("at_ms") < F.col("deadline_ms")), F.lit(False))
    # Rows without payload are kept, so that it is read and hashed once.
    judged = written(
        slim.join(declared, "transfer", "left").withColumns({"_live": live, "_range": F.col("idx").between(0, F.col("expected_chunks") - 1)})
        .drop("status", "expected_chunks", "deadline_ms")
    )
    candidates = (
        judged.filter("_live AND _range AND _sound AND _len <= expected_len")
        .groupBy("transfer", "idx", "_len", "expected_len")
        .agg(F.min("seq").alias("seq"))
    )
    stored = _stored(candidates)
    outcome = first_failure(
        (~F.col("_live"), "not in progress"),
        (~F.col("_range"), "index out of range"),
        (F.col("_stored") < F.col("seq"), "duplicate index"),
        (~F.col("_sound"), "hash mismatch"),
        (F.col("_stored").isNull() | (F.col("_stored") > F.col("seq")), "over the declared length"),
    )
    others = [c for c in arrivals.columns if c != "data"]
    return judged.join(stored, ["transfer", "idx"], "left").withColumn("error", outcome).select(*others, F.col("_len").alias("len"), "error")


def ingest_chunks(transfers: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``judge_chunks`` with the payload beside it; ``seq`` is unique within a transfer."""
    outcomes = judge_chunks(transfers, arrivals).select("transfer", "seq", "len", "error")
    return arrivals.join(outcomes, ["transfer", "seq"]).select(*arrivals.columns, "len", "error")


def _stored(candidates: DataFrame) -> DataFrame:
    """First stored arrival of every (transfer, idx), by a fold over rows in order."""
    kind = candidates.schema["transfer"].dataType.simpleString()

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room, taken = None, 0, 0
        for batch in batches:
            keys, idx, length, room_, seq = (c.to_pylist() for c in batch.columns)
            kept = []
            for i, key in enumerate(keys):
                if key != held:
                    held, room, taken = key, room_[i], 0
                if length[i] <= room and not taken >> idx[i] & 1:
                    room -= length[i]
                    taken |= 1 << idx[i]
                    kept.append(i)
            at = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([idx[i] for i in kept], pa.int64()), pa.array([seq[i] for i in kept], pa.int64())],
                ["transfer", "idx", "_stored"],
            )

    ordered = candidates.repartition("transfer").sortWithinPartitions("transfer", "seq")
    return ordered.select("transfer", "idx", "_len", "expected_len", "seq").mapInArrow(fold, f"transfer {kind}, idx bigint, _stored bigint")


def stage_chunks(transfers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Readable chunks with the state of their transfer; authoritative once committed."""
    return chunks.join(transfers.select("transfer", "status"), "transfer").withColumn(
        "authoritative", F.col("status") == "committed"
    )


def commit_transfers(transfers: DataFrame, chunks: DataFrame, commits: DataFrame) -> DataFrame:
    """Outcome of commit requests (transfer, at_ms, aggregate_hash).

    ``chunks`` are the stored ones: transfer, idx, len, data, hash. The payload is
    hashed only for transfers that pass every cheaper rule.
    """
    sound = (F.sha2("data", 256) == F.col("hash")) & (F.length("data") == F.col("len"))
    shape = chunks.groupBy("transfer").agg(
        F.countDistinct("idx").alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
        F.min("idx").alias("_lo"),
        F.max("idx").alias("_hi"),
        F.sum("len").alias("_len"),
        F.bool_and(sound).alias("_sound"),
    )
    joined = commits.join(transfers, "transfer", "left").join(shape, "transfer", "left")
    n = F.coalesce("_n", F.lit(0))
    exact = (
        (F.coalesce("_rows", F.lit(0)) == F.col("expected_chunks"))
        & (n == F.col("expected_chunks"))
        & ((n == 0) | ((F.col("_lo") == 0) & (F.col("_hi") == n - 1)))
    )
    live = (F.col("status") == "in progress") & (F.col("at_ms") < F.col("deadline_ms"))
    cheap = joined.withColumn(
        "_fault",
        first_failure(
            (~F.coalesce(live, F.lit(False)), "not in progress"),
            (F.col("aggregate_hash") != F.col("expected_hash"), "hash differs from declaration"),
            (~exact, "chunks incomplete"),
            (F.coalesce("_len", F.lit(0)) != F.col("expected_len"), "length mismatch"),
            (~F.coalesce("_sound", F.lit(True)), "chunk failed validation"),
        ),
    )
    passing = cheap.filter("_fault IS NULL").select("transfer")
    hashed = hashes(chunks.join(passing, "transfer", "left_semi"), ["transfer"], "idx", "data")
    empty = F.sha2(F.lit(""), 256)
    error = F.when(
        F.col("_fault").isNull() & (F.coalesce("digest", empty) != F.col("aggregate_hash")),
        "total hash differs",
    ).otherwise(F.col("_fault"))
    return cheap.join(hashed, "transfer", "left").select(
        "transfer",
        F.coalesce("_n", F.lit(0)).alias("chunks"),
        F.when(error.isNull(), "committed").otherwise(F.col("status")).alias("status"),
        error.alias("error"),
    )


def abort_transfers(transfers: DataFrame, aborts: DataFrame) -> DataFrame:
    """Explicit aborts (transfer, reason); only a transfer in progress can be aborted."""
    joined = transfers.join(aborts.select("transfer", "reason"), "transfer", "left")
    asked, live = F.col("reason").isNotNull(), F.col("status") == "in progress"
    return joined.select(
        *[c for c in transfers.columns if c != "status"],
        F.when(asked & live, "aborted").otherwise(F.col("status")).alias("status"),
        F.when(asked & live, F.col("reason")).alias("reason"),
        F.when(asked & ~live, "not in progress").alias("error"),
    )


def expire_transfers(transfers: DataFrame, as_of_ms: Column) -> DataFrame:
    late = (F.col("status") == "in progress") & (as_of_ms >= F.col("deadline_ms"))
    return transfers.withColumn("reason", F.when(late, "transfer lease expired")).withColumn(
        "status", F.when(late, "aborted").otherwise(F.col("status"))
    )


def live_chunks(chunks: DataFrame, transfers: DataFrame) -> DataFrame:
    """Chunks without those of aborted transfers."""
    gone = transfers.filter("status = 'aborted'").select("transfer")
    return chunks.join(gone, "transfer", "left_anti")


# -- references, tickets, emissions, checkpoints ------------------------------


def durable_id(kind: Column, identity: Column, fallback: Column) -> Column:
    return F.when(kind == "stream", fallback).otherwise(identity)


def resolve(
    references: DataFrame, objects: DataFrame, verified: DataFrame, tickets: DataFrame, live: DataFrame
) -> DataFrame:
    """Payload behind every reference (ref, kind, id, fallback_id).

    'committed' reads the object; 'transfer' the verified transfer; 'stream' its
    live data and, when the ticket's durability is 'replay required', the
    committed transfer. ``objects`` id, data; ``verified`` transfer, data;
    ``tickets`` ticket, transfer, durability; ``live`` ticket, data.
    """
    joined = (
        references.join(objects.select("id", F.col("data").alias("_object")), "id", "left")
        .join(
            tickets.select(F.col("ticket").alias("id"), F.col("transfer").alias("_for"), "durability"),
            "id", "left",
        )
        .join(live.select(F.col("ticket").alias("id"), F.col("data").alias("_live")), "id", "left")
        .withColumn("durable_id", durable_id(F.col("kind"), F.col("id"), F.col("fallback_id")))
        .join(
            verified.select(F.col("transfer").alias("durable_id"), F.col("data").alias("_durable")),
            "durable_id", "left",
        )
    )
    kind, replay = F.col("kind"), F.col("durability") == "replay required"
    error = first_failure(
        ((kind == "committed") & F.col("_object").isNull(), "object not found"),
        ((kind == "transfer") & F.col("_durable").isNull(), "transfer not committed"),
        ((kind == "stream") & F.col("_for").isNull(), "ticket not found"),
        ((kind == "stream") & (F.col("_for") != F.col("fallback_id")), "ticket does not match fallback"),
        ((kind == "stream") & F.col("_live").isNull() & ~F.coalesce(replay, F.lit(False)), "live data missing"),
        (
            (kind == "stream") & F.col("_live").isNull() & F.col("_durable").isNull(),
            "live and stored data missing",
        ),
    )
    source = (
        F.when(kind == "committed", "object")
        .when(kind == "transfer", "transfer")
        .when(F.col("_live").isNotNull(), "live")
        .otherwise("fallback")
    )
    data = (
        F.when(kind == "committed", F.col("_object"))
        .when(kind == "transfer", F.col("_durable"))
        .otherwise(F.coalesce("_live", "_durable"))
    )
    return joined.withColumn("error", error).select(
        *references.columns,
        "durable_id",
        "error",
        F.when(F.col("error").isNull(), source).alias("source"),
        F.when(F.col("error").isNull(), data).alias("data"),
    )


def check_tickets(tickets: DataFrame) -> DataFrame:
    """First broken rule of a ticket and of the data received under it.

    Ticket columns: contract, version, hash and their envelope_ twins,
    transfer, eventual_id, header, header_len, expected_len, expected_hash;
    ``data`` is NULL until received; ``bundle_error`` is the audit result.
    """
    data = F.col("data")
    received = (
        (F.length("data") == F.col("expected_len"))
        & (F.sha2("data", 256) == F.col("expected_hash"))
        & F.startswith(data, F.col("header"))
    )
    twins = [F.col(c) != F.col(f"envelope_{c}") for c in ("contract", "version", "hash")]
    return tickets.withColumn(
        "error",
        first_failure(
            (twins[0] | twins[1] | twins[2], "descriptor does not match envelope"),
            (F.col("eventual_id") != F.col("transfer"), "durable object does not match transfer"),
            (F.col("header_len") != F.col("expected_len"), "declared lengths differ"),
            (data.isNotNull() & ~received, "received data does not match ticket"),
            (data.isNotNull() & F.col("bundle_error").isNotNull(), "received payload is invalid"),
        ),
    )


def emit(outputs: DataFrame, keys: Sequence[str], data: str, metadata: str) -> tuple[DataFrame, DataFrame]:
    """Objects and emissions of a stage-output table keyed by ``keys``.

    Ids are digests of key and content, so a replayed task writes the same rows.
    """
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    tagged = outputs.withColumn("tensor_id", F.sha2(F.concat_ws("/", key, data), 256)).withColumn(
        "emission_id", F.sha2(F.concat_ws("/", "tensor_id", metadata), 256)
    )
    return (
        tagged.select(F.col("tensor_id").alias("id"), data),
        tagged.select(*keys, "emission_id", "tensor_id", metadata),
    )


def receive(deliveries: DataFrame, emissions: DataFrame, objects: DataFrame) -> DataFrame:
    """Tensor and metadata behind every delivered emission id."""
    return deliveries.join(emissions, "emission_id", "left").join(
        objects.withColumnRenamed("id", "tensor_id"), "tensor_id", "left"
    )


def constant_matrices(keys: DataFrame) -> DataFrame:
    """The same 2x3 matrix for every row of ``keys``."""
    return keys.withColumn("shape", F.array(F.lit(2), F.lit(3)).cast("array<bigint>")).withColumn(
        "v", F.array(*[F.lit(float(i)) for i in range(1, 7)])
    )
