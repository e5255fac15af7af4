"""Registered sequence queries: batch = conversation, sequence = turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions import sequence_expr as se
from tensorloom.functions import tensor_expr as te
from tensorloom.operators import sequences as os_
from tensorloom.plans.catalog import register, table

SEQ = """w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '') AS ws
    FROM conversations),
  s AS (SELECT conv_id, turn, role, list_concat(list_transform(ws, lambda x: CASE WHEN substr(md5(x), 1, 1) = 'f' THEN 248044
    ELSE ('0x' || substr(md5(x), 1, 4))::BIGINT + 1 END), list_transform(range(turn % 3), lambda i: 248044::BIGINT),
    list_transform(range(turn % 2), lambda i: 248046::BIGINT)) AS ids FROM w)"""
TRIM = SEQ + """, t AS (SELECT conv_id, turn, role, list_slice(ids, 1, coalesce(list_max(list_transform(range(1, len(ids) + 1),
    lambda i: CASE WHEN ids[i] IN (248044, 248046) THEN 0 ELSE i END)), 0)) AS ids FROM s)"""
OUT = "SELECT conv_id, turn, (generate_subscripts(ids, 1) - 1)::INTEGER AS pos, unnest(ids) AS token FROM "


def token_id(word):
    digest = F.md5(word)
    return F.when(F.substring(digest, 1, 1) == "f", F.lit(se.PAD).cast("bigint")).otherwise(
        F.conv(F.substring(digest, 1, 4), 16, 10).cast("bigint") + 1
    )


def sequences(spark, sf_dir):
    """Word ids with trailing PAD and IM_END that vary by turn; some words are PAD."""
    pad, end = F.lit(se.PAD).cast("bigint"), F.lit(se.IM_END).cast("bigint")
    ids = F.concat(
        F.transform(se.words("text"), token_id),
        F.array_repeat(pad, (F.col("turn") % 3).cast("int")),
        F.array_repeat(end, (F.col("turn") % 2).cast("int")),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", ids.alias("ids"))


def out(df):
    return df.select("conv_id", "turn", F.posexplode("ids").alias("pos", "token"))


def literal_ids(*ids):
    return F.array(*[F.lit(i).cast("bigint") for i in ids])


@register(
    "one_hot_tokens",
    f"""WITH {SEQ} SELECT conv_id, turn, (generate_subscripts(ids, 1) - 1)::INTEGER AS pos, unnest(ids) AS predicted,
    unnest(ids) AS token_id, 0.0::DOUBLE AS log_prob FROM s""",
)
def one_hot_tokens(spark, sf_dir):
    hot = sequences(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(F.transform("ids", se.one_hot)).alias("pos", "t")
    )
    return hot.select(
        "conv_id", "turn", "pos", "t.predicted", F.col("t.dark")[0]["token_id"].alias("token_id"),
        F.col("t.dark")[0]["log_prob"].alias("log_prob"),
    )


@register("trim_padding", f"WITH {TRIM} {OUT} t")
def trim_padding(spark, sf_dir):
    return out(os_.trim(sequences(spark, sf_dir), "ids"))


@register(
    "trim_padding_batches",
    f"""WITH {TRIM} SELECT conv_id, count(*) AS sequences, sum(len(ids))::BIGINT AS kept,
    count(*) FILTER (len(ids) = 0) AS emptied FROM t GROUP BY conv_id""",
)
def trim_padding_batches(spark, sf_dir):
    hot = sequences(spark, sf_dir).withColumn("ids", F.transform("ids", se.one_hot))
    return (
        os_.trim(hot, "ids", se.predicted)
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("sequences"),
            F.sum(F.size("ids")).cast("bigint").alias("kept"),
            F.count(F.when(F.size("ids") == 0, 1)).alias("emptied"),
        )
    )


PADDED = """list_concat(list_transform(range(greatest({n} - len(ids), 0)), lambda i: 248044::BIGINT), ids)"""


@register(
    "pad_start_to_length",
    f"WITH {SEQ}, p AS (SELECT conv_id, turn, {PADDED.format(n=40)} AS ids FROM s) {OUT} p",
)
def pad_start_to_length(spark, sf_dir):
    return out(sequences(spark, sf_dir).withColumn("ids", se.pad_start_to("ids", F.lit(40))))


@register("n_tokens", f"WITH {SEQ} SELECT conv_id, sum(len(ids))::BIGINT AS n_tokens FROM s GROUP BY conv_id")
def n_tokens(spark, sf_dir):
    return os_.n_tokens(sequences(spark, sf_dir), ["conv_id"], "ids")


def padded_sql(source):
    return f"""mx AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM {source}),
    p AS (SELECT conv_id, turn, {PADDED.format(n='m')} AS ids FROM mx) {OUT} p"""


@register("pad_start_batch", f"WITH {SEQ}, {padded_sql('s')}")
def pad_start_batch(spark, sf_dir):
    return out(os_.pad_start(sequences(spark, sf_dir), ["conv_id"], "ids"))


@register(
    "frame_sequences",
    f"""WITH {TRIM}, f AS (SELECT conv_id, turn, list_concat([248045::BIGINT, 11], ids, [248046::BIGINT]) AS ids FROM t),
    {padded_sql('f')}""",
)
def frame_sequences(spark, sf_dir):
    return out(
        os_.frame(
            sequences(spark, sf_dir), ["conv_id"], "ids",
            literal_ids(se.FRAME_START, 11), literal_ids(se.IM_END),
        )
    )


@register(
    "frame_with_table",
    f"""WITH {TRIM}, f AS (SELECT conv_id, turn, CASE WHEN turn < 2 THEN list_concat([248045::BIGINT, length(role)], ids, [248046::BIGINT])
    ELSE ids END AS ids FROM t), {padded_sql('f')}""",
)
def frame_with_table(spark, sf_dir):
    frames = table(spark, sf_dir, "conversations").filter("turn < 2").select(
        "conv_id", "turn",
        F.array(F.lit(se.FRAME_START).cast("bigint"), F.length("role").cast("bigint")).alias("before"),
        literal_ids(se.IM_END).alias("after"),
    )
    return out(os_.frame_with(sequences(spark, sf_dir), frames, ["conv_id"], "turn", "ids"))


@register(
    "merge_batches",
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id AS batch, turn AS seq, length(text) AS chars FROM conversations
    UNION ALL SELECT c.conv_id - 1, c.turn + coalesce(n.n, 0), length(c.text) FROM conversations c
    LEFT JOIN n ON n.conv_id = c.conv_id - 1""",
)
def merge_batches(spark, sf_dir):
    """Each conversation followed by the next one."""
    rows = table(spark, sf_dir, "conversations")
    one = rows.select(F.col("conv_id").alias("batch"), F.col("turn").alias("seq"), F.length("text").cast("bigint").alias("chars"))
    return os_.merge_batches([one, one.withColumn("batch", F.col("batch") - 1)], ["batch"], "seq")


@register(
    "merge_pass_pairs",
    """WITH c AS (SELECT conv_id // 32 AS step, conv_id // 2 AS pair,
      CASE WHEN conv_id % 2 = 0 THEN 'up' ELSE 'down' END AS side, turn, length(text) AS chars FROM conversations)
    SELECT step, pair, side, row_number() OVER (PARTITION BY step, side ORDER BY pair, turn) - 1 AS seq,
      sum(chars) OVER (PARTITION BY step, side)::BIGINT AS merged_chars FROM c""",
)
def merge_pass_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 32).alias("step"),
        F.floor(F.col("conv_id") / 2).alias("pair"),
        F.when(F.col("conv_id") % 2 == 0, "up").otherwise("down").alias("side"),
        F.col("turn").alias("seq"),
        F.length("text").cast("bigint").alias("chars"),
    )
    return os_.merge_pairs(rows, ["step"], "pair", "side", "seq", "chars").drop("chars")


STACK = SEQ + """, n AS (SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS a, count(*) FILTER (turn % 2 = 1) AS b FROM s GROUP BY conv_id),
  l AS (SELECT conv_id, turn // 2 AS seq, role, ids FROM s WHERE turn % 2 = 0),
  r AS (SELECT conv_id, turn // 2 AS seq, role, ids FROM s WHERE turn % 2 = 1)"""


def stacked_sql(base, other, where="true"):
    return f"""SELECT x.conv_id, x.seq, x.role, len(list_concat(x.ids, y.ids))::INTEGER AS n,
    list_concat(x.ids, y.ids)[1] AS first_id, NULL::VARCHAR AS error
    FROM {base} x JOIN {other} y USING (conv_id, seq) JOIN n USING (conv_id) WHERE a = b AND {where}
    UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, 'sequence counts differ' FROM n WHERE a <> b AND {where}"""


def sides(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("seq", F.floor(F.col("turn") / 2))
    return rows.filter("turn % 2 = 0"), rows.filter("turn % 2 = 1")


def stacked(df):
    size = F.when(F.col("ids").isNotNull(), F.size("ids"))
    return df.select("conv_id", "seq", "role", size.alias("n"), F.col("ids")[0].alias("first_id"), "error")


@register("left_stack", f"WITH {STACK} {stacked_sql('l', 'r')}")
def left_stack(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return stacked(os_.stack(left, right, ["conv_id"], "seq", "ids", "role"))


@register("right_stack", f"WITH {STACK} {stacked_sql('r', 'l')}")
def right_stack(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return stacked(os_.stack(right, left, ["conv_id"], "seq", "ids", "role"))


HEADS = "substr(md5('3:stack:' || conv_id), 1, 1) < '8'"


@register(
    "random_stack",
    f"WITH {STACK} {stacked_sql('l', 'r', HEADS)} UNION ALL {stacked_sql('r', 'l', f'NOT ({HEADS})')}",
)
def random_stack(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return stacked(os_.random_stack(left, right, ["conv_id"], "seq", "ids", "role", 3))


def bundles(spark, sf_dir):
    """Two-entry tokens; conversations with an even id are padded to a common length."""
    rows = sequences(spark, sf_dir)
    even = os_.pad_start(rows.filter("conv_id % 2 = 0"), ["conv_id"], "ids")
    every = even.unionByName(rows.filter("conv_id % 2 = 1"))
    pair = F.transform(
        "ids",
        lambda t: F.struct(
            t.alias("predicted"),
            F.array(
                F.struct(t.alias("token_id"), F.lit(-0.5).alias("log_prob")),
                F.struct((t + 1).alias("token_id"), F.lit(-1.5).alias("log_prob")),
            ).alias("dark"),
        ),
    )
    return every.select("conv_id", "turn", pair.alias("tokens"))


DENSE = SEQ + f""", mx AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM s),
  e AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN {PADDED.format(n='m')} ELSE ids END AS ids FROM mx),
  sh AS (SELECT conv_id, count(*) AS n_batch, min(len(ids)) AS n_sequence, max(len(ids)) AS longest FROM e GROUP BY conv_id),
  d AS (SELECT conv_id, turn, n_sequence, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS predicted
    FROM e JOIN sh USING (conv_id) WHERE n_sequence = longest),
  k AS (SELECT *, unnest([0, 1]) AS r FROM d)"""


@register(
    "ragged_to_dense",
    f"""WITH {DENSE} SELECT conv_id, ((turn * n_sequence + pos) * 2 + r)::BIGINT AS idx, predicted, predicted + r AS token_id,
    -0.5 - r::DOUBLE AS log_prob FROM k""",
)
def ragged_to_dense(spark, sf_dir):
    return os_.to_dense(bundles(spark, sf_dir), ["conv_id"], "turn", "tokens")


@register(
    "dense_shapes",
    f"""WITH {DENSE} SELECT conv_id, n_batch, n_sequence::BIGINT AS n_sequence,
    (CASE WHEN longest = 0 THEN 0 ELSE 2 END)::BIGINT AS n_top_k,
    CASE WHEN n_sequence <> longest THEN 'ragged' END AS error FROM sh""",
)
def dense_shapes(spark, sf_dir):
    return os_.dense_shapes(bundles(spark, sf_dir), ["conv_id"], "tokens")


@register(
    "dense_to_ragged",
    f"""WITH {DENSE} SELECT conv_id, turn AS seq, pos::BIGINT AS pos, r::BIGINT AS rank, predicted, predicted + r AS token_id,
    -0.5 - r::DOUBLE AS log_prob FROM k""",
)
def dense_to_ragged(spark, sf_dir):
    rows = bundles(spark, sf_dir)
    dense = os_.to_dense(rows, ["conv_id"], "turn", "tokens")
    return os_.to_ragged(dense, os_.dense_shapes(rows, ["conv_id"], "tokens"), ["conv_id"])


VOCAB = """w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (SELECT doc_id,
    list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '') AS ws FROM documents)),
  v AS (SELECT word, row_number() OVER (ORDER BY md5('0:' || word), word) AS token_id
    FROM (SELECT DISTINCT word FROM w))"""


@register(
    "vocabulary_encode",
    f"WITH {VOCAB} SELECT doc_id, pos::INTEGER AS pos, token_id FROM w JOIN v USING (word)",
)
def vocabulary_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return os_.encode(docs, ["doc_id"], "text", os_.vocabulary(docs, "text"))


@register(
    "vocabulary_decode",
    f"WITH {VOCAB} SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM w GROUP BY doc_id",
)
def vocabulary_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vocab = os_.vocabulary(docs, "text")
    return os_.decode(os_.encode(docs, ["doc_id"], "text", vocab), ["doc_id"], vocab)


@register(
    "top_k_log_probs",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
    s AS (SELECT vec_id, p, v - max(v) OVER (PARTITION BY vec_id) - ln(sum(exp(v)) OVER (PARTITION BY vec_id)) +
      max(v) OVER (PARTITION BY vec_id) AS lp FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, p) AS rk FROM s)
    SELECT vec_id, (rk - 1)::INTEGER AS rank, p::BIGINT AS token_id, round(lp, 6) AS log_prob FROM r WHERE rk <= 5""",
)
def top_k_log_probs(spark, sf_dir):
    entries = F.transform(
        te.log_softmax(te.doubles("embedding")),
        lambda x, i: F.struct(i.cast("bigint").alias("token_id"), x.alias("log_prob")),
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", se.top_k(entries, 5).alias("top"))
    return rows.select("vec_id", F.posexplode("top").alias("rank", "e")).select(
        "vec_id", "rank", "e.token_id", F.round("e.log_prob", 6).alias("log_prob")
    )


@register(
    "normalise_requests",
    f"""WITH {SEQ}, r AS (SELECT s.conv_id, s.turn, s.conv_id * 100 + s.turn AS request_id, ids, text,
      CASE s.turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'tokens' WHEN 2 THEN 'dark' ELSE 'stored' END AS kind
      FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn),
    j AS (SELECT r.*, t.ids AS sids FROM r LEFT JOIN s t ON t.conv_id = r.conv_id + 1 AND t.turn = r.turn AND r.kind = 'stored')
    SELECT request_id, CASE WHEN kind = 'stored' THEN 'dark' ELSE kind END AS input, CASE WHEN kind = 'text' THEN text END AS text,
      CASE kind WHEN 'stored' THEN len(sids) WHEN 'text' THEN NULL ELSE len(ids) END::INTEGER AS n_tokens,
      CASE WHEN conv_id % 3 = 0 THEN turn + 1 ELSE 256 END AS "limit",
      CASE WHEN kind = 'stored' AND sids IS NULL THEN 'object not found' END AS error FROM j""",
)
def normalise_requests(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = sequences(spark, sf_dir).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("text", "tokens", "dark", "stored")]),
        (F.col("turn") % 4 + 1).cast("int"),
    )
    requests = rows.join(texts, ["conv_id", "turn"]).select(
        F.col("id").alias("request_id"),
        kind.alias("kind"),
        "text",
        F.col("ids").alias("tokens"),
        (F.col("id") + 100).alias("stored_id"),
        F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 1).alias("limit"),
    )
    stored = rows.select("id", F.col("ids").alias("tokens"))
    n = F.when(F.col("tokens").isNotNull(), F.size("tokens"))
    return os_.normalise_requests(requests, stored).withColumn("n_tokens", n).drop("tokens")


@register(
    "replicate_prompts",
    """WITH r AS (SELECT item_id, unnest(range(8)) AS seq, text FROM benchmark)
    SELECT item_id, seq::INTEGER AS seq, length(text)::INTEGER AS chars FROM r""",
)
def replicate_prompts(spark, sf_dir):
    return os_.replicate(table(spark, sf_dir, "benchmark")).select(
        "item_id", "seq", F.length("text").alias("chars")
    )


@register(
    "check_prompt_batch_size",
    """SELECT conv_id, count(*) AS rows, CASE WHEN count(*) <> 8 THEN 'wrong batch size' END AS error
    FROM conversations GROUP BY conv_id""",
)
def check_prompt_batch_size(spark, sf_dir):
    return os_.check_batch_size(table(spark, sf_dir, "conversations"), ["conv_id"], 8)
