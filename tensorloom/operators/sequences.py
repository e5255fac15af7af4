"""Token-sequence operators: one row per (batch, sequence).

Batch-wide facts (longest sequence, sequence count) come from a grouped
aggregate that is joined back, never from a window over the batch, so a batch
that holds a large share of the table does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import sequence_expr as se
from tensorloom.functions.cols import whole_div
from tensorloom.functions.draws import coin
from tensorloom.plans.scans import running_total, shuffled_rank
from tensorloom.session import written

# Fixed value: generation cap of a request that sets none.
DEFAULT_LIMIT = 256
# Vocabulary entries that are broadcast.
FREQUENT = 4096


def n_tokens(df: DataFrame, batch: Sequence[str], tokens: str) -> DataFrame:
    return df.groupBy(*batch).agg(F.sum(F.size(tokens)).cast("bigint").alias("n_tokens"))


def pad_start(
    df: DataFrame, batch: Sequence[str], tokens: str, pad: Column | None = None
) -> DataFrame:
    """Left-pad every sequence to the longest of its batch."""
    longest = df.groupBy(*batch).agg(F.max(F.size(tokens)).alias("_longest"))
    return (
        df.join(longest, list(batch))
        .withColumn(tokens, se.pad_start_to(tokens, F.col("_longest"), pad))
        .drop("_longest")
    )


def trim(df: DataFrame, tokens: str, id_of=se.plain) -> DataFrame:
    return df.withColumn(tokens, se.trim_padding(tokens, id_of))


def frame(
    df: DataFrame,
    batch: Sequence[str],
    tokens: str,
    before: Column,
    after: Column,
    id_of=se.plain,
    pad: Column | None = None,
) -> DataFrame:
    """Trim, wrap in ``before`` and ``after``, left-pad to the batch length."""
    wrapped = trim(df, tokens, id_of).withColumn(tokens, F.concat(before, F.col(tokens), after))
    return pad_start(wrapped, batch, tokens, pad)


def frame_with(
    df: DataFrame,
    frames: DataFrame,
    batch: Sequence[str],
    seq: str,
    tokens: str,
    id_of=se.plain,
    pad: Column | None = None,
) -> DataFrame:
    """As ``frame`` with a (before, after) row per sequence.

    Sequences without a frame row are trimmed and padded only.
    """
    wrapped = trim(df, tokens, id_of).join(
        frames.select(*batch, seq, "before", "after"), [*batch, seq], "left"
    )
    framed = F.when(
        F.col("before").isNotNull(), F.concat("before", tokens, "after")
    ).otherwise(F.col(tokens))
    return pad_start(
        wrapped.withColumn(tokens, framed).drop("before", "after"), batch, tokens, pad
    )


def merge_batches(parts: Sequence[DataFrame], batch: Sequence[str], seq: str) -> DataFrame:
    """Concatenate batches in the given order; no parts or empty parts change nothing.

    Sequence numbers are dense per part, so a part only needs an offset.
    """
    tagged = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        tagged = tagged.unionByName(part.withColumn("_part", F.lit(i)))
    sizes = tagged.groupBy(*batch).agg(
        *[F.count(F.when(F.col("_part") == i, 1)).alias(f"_n{i}") for i in range(len(parts))]
    )
    offset = sum(
        (F.when(F.col("_part") > i, F.col(f"_n{i}")).otherwise(0) for i in range(len(parts) - 1)),
        F.lit(0),
    )
    return (
        tagged.join(sizes, list(batch))
        .withColumn(seq, F.col(seq) + offset)
        .drop("_part", *[f"_n{i}" for i in range(len(parts))])
    )


def merge_pairs(
    df: DataFrame, keys: Sequence[str], pair: str, side: str, seq: str, metadata: str
) -> DataFrame:
    """Concatenate all up passes and all down passes of a step, pairs in order.

    ``metadata`` merges by addition. Offsets run over one row per pair.
    """
    sizes = df.groupBy(*keys, side, pair).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(metadata).alias("_m")
    )
    offsets = running_total(sizes, [*keys, side], [pair], {"_through": F.col("_n")})
    merged = sizes.groupBy(*keys, side).agg(F.sum("_m").alias(f"merged_{metadata}"))
    return (
        df.join(offsets.select(*keys, side, pair, "_n", "_through"), [*keys, side, pair])
        .withColumn(seq, F.col(seq) + F.col("_through") - F.col("_n"))
        .drop("_n", "_through")
        .join(merged, [*keys, side])
    )


def stack(
    base: DataFrame, other: DataFrame, batch: Sequence[str], seq: str, tokens: str, metadata: str
) -> DataFrame:
    """Append the other side's sequence to the base's; base metadata is kept.

    A batch whose two sides differ in sequence count is one error row.
    """
    on = [*batch, seq]
    both = base.select(*on, F.col(tokens).alias("_a"), metadata).join(
        other.select(*on, F.col(tokens).alias("_b")), on, "full_outer"
    )
    counts = both.groupBy(*batch).agg(
        F.count("_a").alias("base_sequences"), F.count("_b").alias("other_sequences")
    )
    equal = F.col("base_sequences") == F.col("other_sequences")
    good = (
        both.join(counts.filter(equal).select(*batch), list(batch), "left_semi")
        .filter(F.col("_a").isNotNull())
        .select(*on, metadata, F.concat("_a", "_b").alias(tokens), F.lit(None).cast("string").alias("error"))
    )
    kinds = dict(good.dtypes)
    bad = counts.filter(~equal).select(
        *batch,
        *[F.lit(None).cast(kinds[c]).alias(c) for c in (seq, metadata, tokens)],
        F.lit("sequence counts differ").alias("error"),
    )
    return good.unionByName(bad)


def random_stack(
    left: DataFrame, right: DataFrame, batch: Sequence[str], seq: str, tokens: str, metadata: str, seed: int
) -> DataFrame:
    """Left or right stack, drawn once per batch."""
    def sided(base: DataFrame, other: DataFrame, keep: Column) -> DataFrame:
        return stack(base.filter(keep), other.filter(keep), batch, seq, tokens, metadata)

    heads = coin(f"{seed}:stack", *batch)
    return sided(left, right, heads).unionByName(sided(right, left, ~heads))


def dense_shapes(df: DataFrame, batch: Sequence[str], tokens: str) -> DataFrame:
    """Shape of the dense bundle per batch, or the reason it has none."""
    widths = F.transform(F.col(tokens), lambda t: F.size(t["dark"]))
    shapes = df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n_batch"),
        F.min(F.size(tokens)).cast("bigint").alias("n_sequence"),
        F.max(F.size(tokens)).alias("_longest"),
        F.coalesce(F.min(F.array_min(widths)), F.lit(0)).cast("bigint").alias("n_top_k"),
        F.coalesce(F.max(F.array_max(widths)), F.lit(0)).alias("_widest"),
    )
    ragged = (F.col("n_sequence") != F.col("_longest")) | (F.col("n_top_k") != F.col("_widest"))
    return shapes.withColumn("error", F.when(ragged, "ragged")).drop("_longest", "_widest")


def to_dense(df: DataFrame, batch: Sequence[str], seq: str, tokens: str) -> DataFrame:
    """Long-form dense tensors ``(batch, idx, predicted, token_id, log_prob)``.

    ``idx`` is the flat position in the [batch, sequence, k] tensors. Batches
    that are ragged give no rows; see ``dense_shapes`` for the reason.
    """
    shapes = dense_shapes(df, batch, tokens).filter("error IS NULL")
    spread = df.join(shapes.select(*batch, "n_sequence", "n_top_k"), list(batch)).select(
        *batch, seq, "n_sequence", "n_top_k", F.posexplode(tokens).alias("_pos", "_t")
    )
    return spread.select(
        *batch, seq, "n_sequence", "n_top_k", "_pos", F.col("_t.predicted").alias("predicted"),
        F.posexplode("_t.dark").alias("_k", "_e"),
    ).select(
        *batch,
        ((F.col(seq) * F.col("n_sequence") + F.col("_pos")) * F.col("n_top_k") + F.col("_k")).alias("idx"),
        "predicted",
        F.col("_e.token_id").alias("token_id"),
        F.col("_e.log_prob").alias("log_prob"),
    )


def to_ragged(dense: DataFrame, shapes: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Coordinates of every dense entry: (sequence, position, rank)."""
    joined = dense.join(shapes.select(*batch, "n_sequence", "n_top_k"), list(batch))
    position = whole_div("idx", F.col("n_top_k"))
    return joined.select(
        *batch,
        whole_div(position, F.col("n_sequence")).alias("seq"),
        (position % F.col("n_sequence")).alias("pos"),
        (F.col("idx") % F.col("n_top_k")).alias("rank"),
        "predicted",
        "token_id",
        "log_prob",
    )


def vocabulary(df: DataFrame, text: str, seed: int = 0) -> DataFrame:
    """Distinct words with dense ids 1..n in a seeded order, and how often each stands (``count``).

    Kept as a table: it is small beside the texts, which are split once for it.
    """
    counted = df.select(F.explode(se.words(text)).alias("word")).groupBy("word").count()
    return written(shuffled_rank(counted, seed, "word", "_rank").select("word", (F.col("_rank") + 1).alias("token_id"), "count"))


def _looked_up(tokens: DataFrame, vocab: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``value`` of every ``key``; keys that are not in the vocabulary are left out.

    The ``FREQUENT`` entries of highest count are broadcast, which is a bound on
    their number. Tokens found there stay where they are; the others alone are
    shuffled, and each of their keys has less than a 1 / FREQUENT share of the
    tokens, so the shuffle has no hot key. ``tokens`` are read for both.
    """
    top = vocab.orderBy(F.desc("count"), key).limit(FREQUENT).select(key, value)
    found = tokens.join(F.broadcast(top), key)
    further = tokens.join(F.broadcast(top.select(key)), key, "left_anti").join(vocab.select(key, value), key)
    return found.unionByName(further)


def encode(df: DataFrame, keys: Sequence[str], text: str, vocab: DataFrame) -> DataFrame:
    """Long-form token ids ``(keys, pos, token_id)``; ``vocab`` as ``vocabulary`` gives it."""
    tokens = df.select(*keys, F.posexplode(se.words(text)).alias("pos", "word"))
    return _looked_up(tokens, vocab, "word", "token_id").select(*keys, "pos", "token_id")


def decode(tokens: DataFrame, keys: Sequence[str], vocab: DataFrame) -> DataFrame:
    """Words joined by single blanks; a group is one sequence, bounded by its text.

    Where positions are ints, a word travels behind eight digits of its position,
    which sort alike and take half the room of a struct.
    """
    words = _looked_up(tokens, vocab, "token_id", "word")
    if dict(tokens.dtypes)["pos"] == "int":
        digits = F.lpad(F.hex(F.col("pos").cast("bigint") + F.lit(1 << 31)), 8, "0")
        item, word = F.concat(F.coalesce(digits, F.lit(" " * 8)), "word"), lambda p: F.substring(p, 9, 2**31 - 1)
    else:
        item, word = F.struct("pos", "word"), lambda p: p["word"]
    ordered = F.sort_array(F.collect_list(item))
    return words.groupBy(*keys).agg(F.array_join(F.transform(ordered, word), " ").alias("text"))


def normalise_requests(requests: DataFrame, stored: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One input per request row, by kind, with the default generation limit.

    Kinds: ``text``, ``tokens``, ``dark`` inline, or ``stored`` (an object id).
    """
    joined = requests.join(
        stored.select(F.col("id").alias("stored_id"), F.col("tokens").alias("_stored")), "stored_id", "left"
    )
    kind = F.col("kind")
    tokens = F.when(kind == "stored", F.col("_stored")).when(kind != "text", F.col("tokens"))
    return joined.select(
        "request_id",
        F.when(kind == "stored", "dark").otherwise(kind).alias("input"),
        F.when(kind == "text", F.col("text")).alias("text"),
        tokens.alias("tokens"),
        F.coalesce("limit", F.lit(default_limit)).alias("limit"),
        F.when((kind == "stored") & F.col("_stored").isNull(), "object not found").alias("error"),
    )


def replicate(df: DataFrame, times: int = 8) -> DataFrame:
    """Every prompt ``times`` times, as sequences 0..times-1 of its batch."""
    return df.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def check_batch_size(df: DataFrame, batch: Sequence[str], size: int) -> DataFrame:
    counts = df.groupBy(*batch).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("error", F.when(F.col("rows") != size, "wrong batch size"))
