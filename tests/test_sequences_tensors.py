import random
from pyspark.sql import functions as F

from tensorloom.functions import sequence_expr as se
from tensorloom.functions import tensor_expr as te
from tensorloom.operators import sequences as os_
from tensorloom.operators import tensors as ot

P, S, E = se.PAD, se.FRAME_START, se.IM_END


def ids(*values):
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def batch(spark, *seqs):
    rows = [(0, i, list(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "b long, s long, ids array<long>")


def read(df):
    return [r.ids for r in df.orderBy("b", "s").collect()]


def test_trim_keeps_interior_padding(spark):
    df = batch(spark, [5, P, 7, P, E], [P, E, P], [], [1, E, 2], [E, 3])
    assert read(os_.trim(df, "ids")) == [[5, P, 7], [], [], [1, E, 2], [E, 3]]


def test_trim_works_on_tokens_with_distributions(spark):
    df = batch(spark, [4, P]).withColumn("ids", F.transform("ids", se.one_hot))
    got = read(os_.trim(df, "ids", se.predicted))[0]
    assert [t.predicted for t in got] == [4]
    assert [(e.token_id, e.log_prob) for e in got[0].dark] == [(4, 0.0)]


def test_pad_never_truncates_and_frame(spark):
    df = batch(spark, [1, 2, P], [3])
    assert read(df.withColumn("ids", se.pad_start_to("ids", F.lit(2)))) == [[1, 2, P], [P, 3]]
    assert read(os_.frame(df, ["b"], "ids", ids(S), ids(E))) == [[S, 1, 2, E], [P, S, 3, E]]


def test_frame_with_leaves_extra_sequences_unframed(spark):
    df = batch(spark, [1, P], [2, P], [3, 4, P])
    frames = spark.createDataFrame(
        [(0, 0, [S], [E]), (0, 1, [S, S], [])], "b long, s long, before array<long>, after array<long>"
    )
    assert read(os_.frame_with(df, frames, ["b"], "s", "ids")) == [[S, 1, E], [S, S, 2], [P, 3, 4]]


def test_token_count(spark):
    assert os_.n_tokens(batch(spark, [1, 2, 3], [], [4, 5, 6]), ["b"], "ids").first().n_tokens == 6


def test_merge_with_empty_part_changes_nothing(spark):
    df = batch(spark, [1], [2])
    merged = os_.merge_batches([df, df.limit(0), df], ["b"], "s")
    assert sorted((r.s, r.ids) for r in merged.collect()) == [(0, [1]), (1, [2]), (2, [1]), (3, [2])]


def test_merge_pairs_over_any_ranges(spark, ranges):
    rows = [(0, p, side, s, p + 1) for p in range(40) for side in ("up", "down") for s in range(p % 3 + 1)]
    df = spark.createDataFrame(rows, "step long, pair long, side string, seq long, meta long")
    merged = os_.merge_pairs(df, ["step"], "pair", "side", "seq", "meta")
    for side in ("up", "down"):
        got = [(r.pair, r.seq) for r in merged.filter(F.col("side") == side).orderBy("pair", "seq").collect()]
        assert got == [(p, n) for n, p in enumerate(p for _, p, s, _, _ in rows if s == side)]


def test_unequal_stack_is_an_error_row(spark):
    left = batch(spark, [1], [2]).withColumn("m", F.lit("L"))
    right = batch(spark, [9]).withColumn("m", F.lit("R"))
    row = os_.stack(left, right, ["b"], "s", "ids", "m").collect()
    assert [(r.b, r.ids, r.error) for r in row] == [(0, None, "sequence counts differ")]


def test_dense_round_trip_and_ragged(spark):
    def tokens(n, k):
        return [(i, [(i * 10 + j, -float(j)) for j in range(k)]) for i in range(n)]

    schema = f"b long, s long, t array<struct<predicted:bigint,dark:{se.DARK}>>"
    df = spark.createDataFrame(
        [(0, 0, tokens(3, 2)), (0, 1, tokens(3, 2)), (1, 0, tokens(2, 2)), (1, 1, tokens(1, 2)), (2, 0, [])], schema
    )
    shapes = {r.b: (r.n_batch, r.n_sequence, r.n_top_k, r.error) for r in os_.dense_shapes(df, ["b"], "t").collect()}
    assert shapes == {0: (2, 3, 2, None), 1: (2, 1, 2, "ragged"), 2: (1, 0, 0, None)}
    dense = os_.to_dense(df, ["b"], "s", "t")
    assert sorted(r.idx for r in dense.collect()) == list(range(12))
    back = os_.to_ragged(dense, os_.dense_shapes(df, ["b"], "t"), ["b"])
    assert {(r.seq, r.pos, r["rank"], r.token_id) for r in back.collect()} == {
        (s, p, k, p * 10 + k) for s in range(2) for p in range(3) for k in range(2)
    }


def vector(spark, *values):
    return spark.createDataFrame([(list(map(float, values)),)], "v array<double>")


def test_matrix_example_and_slice_chain(spark):
    out = ot.tensor_chain(vector(spark, 1, 2, 3, 4, 5, 6), "v", "o").first().o
    assert out == [2.0, 2.5, 1.75, 2.0, 5.0, 5.5, 4.0, 4.25]
    chain = spark.createDataFrame([([1, 2, 3, 4],)], "v array<bigint>")
    step = chain.select(te.first_half("v").alias("v")).select(te.add_one_u32(te.add_one_u32("v")).alias("v"))
    assert step.first().v == [3, 4]
    top = spark.createDataFrame([([te.U32 - 1],)], "v array<bigint>")
    assert top.select(te.add_one_u32("v").alias("v")).first().v == [0]
    assert vector(spark).select(te.matmul("v", te.PIPELINE_WEIGHTS).alias("v")).first().v == []


def test_first_class_wins_a_tie(spark):
    assert vector(spark, 1, 1).select(te.predicted_class("v").alias("c")).first().c == 0
    assert vector(spark, 1, 2).select(te.predicted_class("v").alias("c")).first().c == 1


def test_large_logits_stay_finite(spark):
    row = vector(spark, 1000, 999).select(te.log_sum_exp("v").alias("x")).first()
    assert abs(row.x - 1000.3132616875182) < 1e-9


def test_image_round_trip(spark):
    pixels = spark.createDataFrame([(list(range(0, 255, 5))[:48],)], "p array<int>")
    back = pixels.select(te.denormalise_chw(te.normalise_hwc("p", 4, 4), 16).alias("q"), "p").first()
    assert back.q == [back.p[i * 3 + c] for c in range(3) for i in range(16)]


def test_crop_boxes_fit(spark):
    rows = spark.range(300).select(te.crop_box(3, "id", 20, 30).alias("b")).select("b.*").collect()
    for r in rows:
        assert 0 <= r.x and r.x + r.width <= 30 and 0 <= r.y and r.y + r.height <= 20
        assert r.attempt <= 10


def test_short_batches_are_errors(spark):
    rows = [(0, i, [float(i)]) for i in range(4)] + [(1, 0, [9.0])]
    df = spark.createDataFrame(rows, "b long, slot int, v array<double>")
    got = {r.b: (r.status, r.v) for r in ot.batch_concat(df, "b", "slot", "v", 4).collect()}
    assert got == {0: ("ok", [0.0, 1.0, 2.0, 3.0]), 1: ("wrong batch size", None)}


def test_vocabulary_with_one_word_in_a_third_of_the_tokens(spark, monkeypatch):
    """Few entries are broadcast; the frequent word is spread, the rest is joined, unknown words drop out."""
    monkeypatch.setattr(os_, "FREQUENT", 2)
    rng = random.Random(4)
    texts = {i: [rng.choice(["the", f"w{rng.randrange(40)}", f"r{i}"]) for _ in range(30)] for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc long, text string").repartition(5)
    vocab = os_.vocabulary(df, "text", 3)
    ids = {r.word: r.token_id for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))
    tokens = os_.encode(df, ["doc"], "text", vocab)
    assert {(r.doc, r.pos): r.token_id for r in tokens.collect()} == {(i, p): ids[w] for i, ws in texts.items() for p, w in enumerate(ws)}
    assert {r.doc: r.text for r in os_.decode(tokens, ["doc"], vocab).collect()} == {i: " ".join(w) for i, w in texts.items()}
    known = vocab.filter("word <> 'the'")
    assert os_.encode(df, ["doc"], "text", known).count() == sum(w != "the" for ws in texts.values() for w in ws)


def test_tokens_of_frequent_words_are_not_shuffled(spark):
    """They stay in the task that split their text; positions of any type give the same texts."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        texts = {i: " ".join(f"w{(i * 7 + j * 3) % 50}" for j in range(40)) for i in range(20)}
        df = spark.createDataFrame(list(texts.items()), "doc long, text string").repartition(5)
        vocab = os_.vocabulary(df, "text", 3)
        tokens = os_.encode(df, ["doc"], "text", vocab)
        assert tokens.select("doc", F.spark_partition_id()).distinct().count() == 20
        assert {r.doc: r.text for r in os_.decode(tokens, ["doc"], vocab).collect()} == texts
        other = tokens.withColumn("pos", F.col("pos").cast("bigint") - 20)
        assert {r.doc: r.text for r in os_.decode(other, ["doc"], vocab).collect()} == texts
        other = tokens.withColumn("pos", F.col("pos") - 20)
        assert {r.doc: r.text for r in os_.decode(other, ["doc"], vocab).collect()} == texts
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
