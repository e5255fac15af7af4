"""Registered contract-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te
from tensorloom.operators import contracts as oc
from tensorloom.plans.catalog import literal_rows, register, table

PORT_SCHEMA = (
    "contract string, side string, ordinal int, name string, dtype_kind string, dtypes array<string>, "
    "dims array<struct<kind:string,size:bigint,label:string>>"
)


def dim(kind, size=None, label=None):
    return {"kind": kind, "size": size, "label": label}


# Two contracts over the same three tensors; the second narrows the mask to u8
# and fixes the last axis of the scores.
PORTS = [
    ("vectors", "input", 0, "embedding", "exact", ["f32"], [dim("static", 64)]),
    ("vectors", "input", 1, "mask", "one_of", ["u8", "bool"], [dim("symbolic", None, "n")]),
    ("vectors", "input", 2, "scores", "any", [], [dim("symbolic", None, "n"), dim("dynamic")]),
    ("ranked", "input", 0, "embedding", "exact", ["f32"], [dim("dynamic")]),
    ("ranked", "input", 1, "mask", "exact", ["u8"], [dim("symbolic", None, "m")]),
    ("ranked", "input", 2, "scores", "exact", ["f32"], [dim("symbolic", None, "m"), dim("static", 3)]),
]


def ports(spark):
    return literal_rows(spark, PORTS, PORT_SCHEMA)


def bundles(spark, sf_dir, contract="vectors"):
    """Three tensors per vector with a fault chosen by vec_id % 10."""
    fault, n = F.col("vec_id") % 10, F.col("label").cast("bigint") + 1

    def tensor(pos, name, dtype, shape):
        return F.struct(
            F.lit(pos).alias("pos"), F.lit(name).alias("name"), dtype.alias("dtype"), shape.alias("shape")
        )

    one = F.lit(1).cast("bigint")
    embedding = tensor(
        1, "embedding", F.when(fault == 1, "f64").otherwise("f32"),
        F.when(fault == 2, F.array(one * 8, one * 8)).when(fault == 3, F.array(one * 63)).otherwise(F.array(one * F.size("embedding"))),
    )
    mask = tensor(2, "mask", F.when(fault == 8, "f32").when(fault == 9, "bool").otherwise("u8"), F.array(n))
    scores = tensor(0, "scores", F.lit("f32"), F.array(F.when(fault == 7, n + 1).otherwise(n), one * 3))
    noise = tensor(3, "noise", F.lit("f32"), F.array(one))
    again = tensor(4, "scores", F.lit("f32"), F.array(n, one * 3))
    group = (
        F.when(fault == 4, F.array(scores, embedding))
        .when(fault == 5, F.array(scores, embedding, mask, noise))
        .when(fault == 6, F.array(scores, embedding, mask, noise, again))
        .otherwise(F.array(scores, embedding, mask))
    )
    keyed = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("artifact"),
        F.lit(contract).alias("contract"),
        F.lit("input").alias("side"),
        group.alias("_g"),
    )
    return (
        keyed.select("artifact", "contract", "side"),
        keyed.select("artifact", "contract", "side", F.explode("_g").alias("_t")).select(
            "artifact", "contract", "side", "_t.*"
        ),
    )


TENSORS = """f AS (SELECT vec_id AS artifact, vec_id % 10 AS fault, label::BIGINT + 1 AS n, len(embedding) AS w FROM embeddings),
  t AS (SELECT artifact, 0 AS pos, 'scores' AS name, 'f32' AS dtype, [CASE WHEN fault = 7 THEN n + 1 ELSE n END, 3::BIGINT] AS shape FROM f
    UNION ALL SELECT artifact, 1, 'embedding', CASE WHEN fault = 1 THEN 'f64' ELSE 'f32' END,
      CASE fault WHEN 2 THEN [8::BIGINT, 8] WHEN 3 THEN [63::BIGINT] ELSE [w::BIGINT] END FROM f
    UNION ALL SELECT artifact, 2, 'mask', CASE fault WHEN 8 THEN 'f32' WHEN 9 THEN 'bool' ELSE 'u8' END, [n] FROM f WHERE fault <> 4
    UNION ALL SELECT artifact, 3, 'noise', 'f32', [1::BIGINT] FROM f WHERE fault IN (5, 6)
    UNION ALL SELECT artifact, 4, 'scores', 'f32', [n, 3::BIGINT] FROM f WHERE fault = 6)"""
DIMS = """p(contract, ordinal, name, kind, dtypes, rank) AS (VALUES ('vectors', 0, 'embedding', 'exact', ['f32'], 1),
    ('vectors', 1, 'mask', 'one_of', ['u8', 'bool'], 1), ('vectors', 2, 'scores', 'any', []::VARCHAR[], 2),
    ('ranked', 0, 'embedding', 'exact', ['f32'], 1), ('ranked', 1, 'mask', 'exact', ['u8'], 1),
    ('ranked', 2, 'scores', 'exact', ['f32'], 2)),
  d(contract, name, ordinal, axis, size, label) AS (VALUES ('vectors', 'embedding', 0, 0, 64, NULL), ('vectors', 'mask', 1, 0, NULL, 'n'),
    ('vectors', 'scores', 2, 0, NULL, 'n'), ('ranked', 'mask', 1, 0, NULL, 'm'), ('ranked', 'scores', 2, 0, NULL, 'm'),
    ('ranked', 'scores', 2, 1, 3, NULL))"""


def audit_sql(contract, out):
    return f"""{out}_t AS (SELECT t.*, row_number() OVER (PARTITION BY artifact, name ORDER BY pos) AS nth,
      count(*) OVER (PARTITION BY artifact, name) AS copies FROM t),
    {out}_s AS (SELECT artifact, d.name, d.ordinal, axis, label, size, shape[axis + 1] AS got,
      first_value(shape[axis + 1]) OVER (PARTITION BY artifact, label ORDER BY d.ordinal, axis) AS bound
      FROM {out}_t x JOIN d ON d.name = x.name AND d.contract = '{contract}' WHERE copies = 1 AND axis < len(shape)),
    {out}_e AS (SELECT artifact, [0, pos] AS rk, 'duplicate ' || name AS error FROM {out}_t WHERE nth > 1
      UNION ALL SELECT artifact, [1, pos], 'unexpected ' || name FROM t WHERE name NOT IN (SELECT name FROM p WHERE contract = '{contract}')
      UNION ALL SELECT artifact, [2, ordinal, -1], 'missing ' || p.name FROM f, p WHERE contract = '{contract}' AND NOT EXISTS
        (SELECT 1 FROM {out}_t x WHERE x.artifact = f.artifact AND x.name = p.name AND copies = 1)
      UNION ALL SELECT artifact, [2, ordinal, -1], CASE WHEN kind <> 'any' AND NOT list_contains(dtypes, dtype) THEN 'dtype ' ELSE 'rank ' END || p.name
        FROM {out}_t x JOIN p ON p.name = x.name AND contract = '{contract}' WHERE copies = 1 AND
        ((kind <> 'any' AND NOT list_contains(dtypes, dtype)) OR len(shape) <> rank)
      UNION ALL SELECT artifact, [2, ordinal, axis], CASE WHEN label IS NULL THEN 'size ' ELSE 'symbolic ' END || name FROM {out}_s
        WHERE (label IS NULL AND got <> size) OR (label IS NOT NULL AND got <> bound)),
    {out} AS (SELECT f.artifact, arg_min(error, rk) AS error FROM f LEFT JOIN {out}_e USING (artifact) GROUP BY f.artifact)"""


@register("audit_bundles", f"WITH {TENSORS}, {DIMS}, {audit_sql('vectors', 'a')} SELECT artifact, error FROM a")
def audit_bundles(spark, sf_dir):
    return oc.audit_bundles(*bundles(spark, sf_dir), ports(spark)).select("artifact", "error")


@register(
    "retag_bundles",
    f"""WITH {TENSORS}, {DIMS}, {audit_sql('vectors', 'a')}, {audit_sql('ranked', 'b')}
    SELECT artifact, CASE WHEN a.error IS NULL AND b.error IS NULL THEN 'ranked' ELSE 'vectors' END AS contract,
      coalesce('source: ' || a.error, 'target: ' || b.error) AS error FROM a JOIN b USING (artifact)""",
)
def retag_bundles(spark, sf_dir):
    return oc.retag(*bundles(spark, sf_dir), ports(spark), "ranked", "input")


@register(
    "declared_tensor_order",
    f"WITH {TENSORS}, {DIMS} SELECT artifact, t.name, ordinal FROM t JOIN p USING (name) WHERE contract = 'vectors'",
)
def declared_tensor_order(spark, sf_dir):
    return oc.declared_order(bundles(spark, sf_dir)[1], ports(spark)).select("artifact", "name", "ordinal")


@register(
    "symbolic_dimension_binding",
    f"""WITH {TENSORS}, {DIMS}, s AS (SELECT artifact, label, t.name, d.ordinal, axis, shape[axis + 1] AS size
      FROM t JOIN d USING (name) WHERE contract = 'vectors' AND label IS NOT NULL AND axis < len(shape))
    SELECT artifact, label, min(size) AS min_size, max(size) AS max_size, min(size) <> max(size) AS conflict
    FROM s GROUP BY ALL""",
)
def symbolic_dimension_binding(spark, sf_dir):
    bound = oc.symbolic_bindings(bundles(spark, sf_dir)[1], ports(spark))
    return bound.groupBy("artifact", "label").agg(
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        (F.min("size") != F.max("size")).alias("conflict"),
    )


def part_ports(spark, sf_dir):
    """A contract per part: one sized input, one output of two axes."""
    size = F.col("p_size").cast("bigint")
    none = F.lit(None).cast("bigint")

    def axis(kind, size, label):
        return F.struct(F.lit(kind).alias("kind"), size.alias("size"), label.alias("label"))

    blank = F.lit(None).cast("string")
    port = F.array(
        F.struct(
            F.lit("input").alias("side"), F.lit(0).alias("ordinal"), F.lower("p_type").alias("name"),
            F.lit("exact").alias("dtype_kind"), F.array(F.lit("f32")).alias("dtypes"),
            F.array(axis("static", size, blank)).alias("dims"),
        ),
        F.struct(
            F.lit("output").alias("side"), F.lit(0).alias("ordinal"), F.col("p_brand").alias("name"),
            F.lit("one_of").alias("dtype_kind"), F.array(F.lit("f32"), F.lit("u32")).alias("dtypes"),
            F.array(axis("symbolic", none, F.lit("n")), axis("dynamic", none, blank)).alias("dims"),
        ),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contract"), F.explode(port).alias("p"))
    return rows.select("contract", "p.*")


CONTRACTS = """c AS (SELECT p_partkey AS contract, sha256('input:0:' || lower(p_type) || ':exact:f32:static=' || p_size ||
  ';output:0:' || p_brand || ':one_of:f32|u32:symbolic=n,dynamic=') AS descriptor_hash FROM part)"""


@register("descriptor_fingerprint", f"WITH {CONTRACTS} SELECT * FROM c")
def descriptor_fingerprint(spark, sf_dir):
    return oc.fingerprint(part_ports(spark, sf_dir))


@register(
    "duplicate_ports",
    """SELECT l_orderkey AS contract, l_linestatus AS side, 'p' || l_suppkey % 5 AS name, count(*) AS owners FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_ports(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("contract"),
        F.col("l_linestatus").alias("side"),
        F.concat(F.lit("p"), F.col("l_suppkey") % 5).alias("name"),
    )
    return oc.duplicate_ports(rows)


@register(
    "audit_envelopes",
    f"""WITH {CONTRACTS}, e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT % 9 AS f FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE f WHEN 1 THEN 'unsupported envelope version' WHEN 2 THEN 'unsupported tensor encoding'
      WHEN 3 THEN 'unsupported metadata encoding' WHEN 4 THEN 'contract id mismatch' WHEN 5 THEN 'contract version mismatch'
      WHEN 6 THEN 'contract hash mismatch' WHEN 7 THEN 'contract side mismatch' END AS error FROM e JOIN c ON contract = l_partkey""",
)
def audit_envelopes(spark, sf_dir):
    f = F.col("l_quantity").cast("bigint") % 9
    contracts = oc.fingerprint(part_ports(spark, sf_dir)).withColumn("version", F.lit(1))
    rows = table(spark, sf_dir, "lineitem").join(
        contracts.select(F.col("contract").alias("l_partkey"), F.col("descriptor_hash").alias("hash")), "l_partkey"
    )
    envelopes = rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_partkey").alias("expected_contract"),
        F.lit("input").alias("expected_side"),
        F.when(f == 1, 2).otherwise(1).alias("envelope_version"),
        F.when(f == 2, 9).otherwise(1).alias("tensor_encoding"),
        F.when(f == 3, 9).otherwise(oc.METADATA_ENCODING).alias("metadata_encoding"),
        F.when(f == 4, -1).otherwise(F.col("l_partkey")).alias("contract"),
        F.when(f == 5, 2).otherwise(1).alias("version"),
        F.when(f == 6, "").otherwise(F.col("hash")).alias("hash"),
        F.when(f == 7, "output").otherwise("input").alias("side"),
    )
    return oc.audit_envelopes(envelopes, contracts).select("l_orderkey", "l_linenumber", "l_partkey", "error")


@register(
    "frame_lengths",
    """WITH d AS (SELECT doc_id, 40 AS env, strlen(lang) AS meta, strlen(text) AS len FROM documents),
    f AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 12 + env + meta + len WHEN 1 THEN doc_id % 16 WHEN 2 THEN 30 ELSE 12 + env + meta + len + 1 END AS frame FROM d)
    SELECT doc_id, frame::BIGINT AS frame, CASE WHEN frame < 12 OR 12 + env > frame THEN 'truncated' WHEN 12 + env + meta + len <> frame THEN 'length mismatch' END AS error FROM f""",
)
def frame_lengths(spark, sf_dir):
    k = F.col("doc_id") % 4
    whole = F.lit(oc.FRAME_PREFIX_BYTES + 40) + F.octet_length("lang") + F.octet_length("text")
    frame = F.when(k == 0, whole).when(k == 1, F.col("doc_id") % 16).when(k == 2, 30).otherwise(whole + 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        frame.cast("bigint").alias("frame"),
        oc.frame_fault(frame, F.lit(40), F.octet_length("lang"), F.octet_length("text")).alias("error"),
    )


@register(
    "dtype_constraint",
    f"""WITH {TENSORS}, {DIMS} SELECT artifact, pos, kind = 'any' OR list_contains(dtypes, dtype) AS accepted FROM t JOIN p USING (name)
    WHERE contract = 'vectors'""",
)
def dtype_constraint(spark, sf_dir):
    joined = bundles(spark, sf_dir)[1].join(ports(spark), ["contract", "side", "name"])
    accepted = oc.dtype_accepts(F.col("dtype_kind"), F.col("dtypes"), F.col("dtype"))
    return joined.select("artifact", "pos", accepted.alias("accepted"))


VERB = """list_filter(['forward', 'reset', 'perturb', 'optimize', 'checkpoint', 'backward', 'step', 'fuse', 'query'],
  lambda v: (length(v) * 7 + {k}) % 5 < {n})"""


def capabilities(df, key, contract, n):
    """Capabilities that follow from a key; ``n`` of five residues keep a verb."""
    key = F.col(key)
    verbs = F.array(*[F.lit(v) for v in ("forward", "reset", "perturb", "optimize", "checkpoint", "backward", "step", "fuse", "query")])
    kept = F.filter(verbs, lambda v: (F.length(v) * 7 + key) % 5 < n)
    contract = F.col(contract)
    encodings = F.when(key % 11 == 0, F.array().cast("array<int>")).when(key % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select(
        key.alias("id"),
        contract.alias("contract"),
        (key % 2).alias("version"),
        F.concat(F.lit("h"), contract).alias("descriptor_hash"),
        encodings.alias("tensor_encodings"),
        F.array(F.lit(1)).alias("metadata_encodings"),
        kept.alias("verbs"),
        F.when(key % 3 != 0, F.concat(F.lit("b"), contract)).alias("backward_hash"),
    )


def cap_sql(name, source, key, contract, n):
    return f"""{name} AS (SELECT {key} AS id, {contract} AS contract, {key} % 2 AS version, CASE WHEN {key} % 11 = 0 THEN []::INTEGER[]
      WHEN {key} % 2 = 0 THEN [1, 2] ELSE [1] END AS enc, {VERB.format(k=key, n=n)} AS verbs,
      CASE WHEN {key} % 3 <> 0 THEN 'b' || {contract} END AS bh FROM {source})"""


@register(
    "capability_match",
    f"""WITH {cap_sql('r', 'lineitem', 'l_orderkey', 'l_suppkey % 25', 1)}, {cap_sql('a', 'supplier', 's_suppkey', 's_nationkey', 4)},
    q AS (SELECT DISTINCT id, contract, version, enc, verbs, bh FROM r),
    o AS (SELECT DISTINCT l_orderkey AS request, l_suppkey AS offer, l_suppkey % 25 AS want FROM lineitem)
    SELECT request, offer, want, a.contract = q.contract AND a.version = q.version AND len(list_filter(q.enc, lambda x: NOT list_contains(a.enc, x))) = 0
      AND len(list_filter(q.verbs, lambda x: NOT list_contains(a.verbs, x))) = 0
      AND (NOT list_contains(q.verbs, 'backward') OR a.bh IS NOT DISTINCT FROM q.bh) AS satisfied
    FROM o JOIN q ON q.id = request AND q.contract = want JOIN a ON a.id = offer""",
)
def capability_match(spark, sf_dir):
    """Requests of an order, offered to the suppliers of its lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("offer"), (F.col("l_suppkey") % 25).alias("want")
    ).distinct()
    key = F.col("l_orderkey") * 25 + F.col("want")
    requests = capabilities(lines.select("l_orderkey", "want").distinct(), "l_orderkey", "want", 1)
    requests = requests.withColumn("id", F.col("id") * 25 + F.col("contract"))
    offers = capabilities(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", 4)
    pairs = lines.select(F.col("l_orderkey").alias("order"), "want", key.alias("request"), "offer")
    return oc.capability_match(pairs, requests, offers).select(
        F.col("order").alias("request"), "offer", "want", "satisfied"
    )


@register(
    "capability_self_check",
    f"""WITH {cap_sql('a', 'customer', 'c_custkey', 'c_nationkey', 3)}, k AS (SELECT *, id % 13 AS m,
      CASE WHEN id % 7 = 0 THEN NULL ELSE contract + (id % 17 = 0)::INTEGER END AS bc FROM a)
    SELECT id, CASE WHEN m = 0 THEN 'contract hash mismatch' WHEN len(enc) = 0 THEN 'codec set empty'
      WHEN list_contains(verbs, 'backward') AND bc IS NULL THEN 'backward contract missing'
      WHEN list_contains(verbs, 'backward') AND m = 1 THEN 'contract hash mismatch'
      WHEN list_contains(verbs, 'backward') AND bc > 24 THEN 'contract hash mismatch'
      WHEN list_contains(verbs, 'backward') AND (bc <> contract OR id % 19 = 0) THEN 'backward contract mismatch' END AS error FROM k""",
)
def capability_self_check(spark, sf_dir):
    rows = capabilities(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", 3)
    k = F.col("id")
    back = F.when(k % 7 != 0, F.col("contract") + F.when(k % 17 == 0, 1).otherwise(0))
    rows = rows.select(
        "*",
        back.alias("backward_contract"),
        F.when(k % 19 == 0, -1).otherwise(F.col("version")).alias("backward_version"),
    )
    rows = rows.withColumn(
        "descriptor_hash", F.when(k % 13 == 0, "stale").otherwise(F.col("descriptor_hash"))
    ).withColumn(
        "backward_hash",
        F.when(k % 13 == 1, "stale").otherwise(F.concat(F.lit("h"), F.col("backward_contract"))),
    )
    contracts = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("contract"), F.concat(F.lit("h"), "n_nationkey").alias("descriptor_hash")
    )
    return oc.audit_capabilities(rows, contracts)


@register(
    "value_count_matches_shape",
    """SELECT vec_id, CASE WHEN (CASE WHEN vec_id % 5 = 0 THEN 60 ELSE 64 END) <> len(embedding) THEN 'value count does not match shape' END AS error FROM embeddings""",
)
def value_count_matches_shape(spark, sf_dir):
    rows = F.when(F.col("vec_id") % 5 == 0, 15).otherwise(16).cast("bigint")
    shaped = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(rows, F.lit(4).cast("bigint")).alias("shape"), te.doubles("embedding").alias("v")
    )
    return shaped.select("vec_id", oc.value_count_fault("shape", "v").alias("error"))


@register(
    "bundle_from_values",
    """SELECT vec_id, 'vectors' AS contract, 'embedding' AS name, 'f32' AS dtype, len(embedding)::INTEGER AS width,
    round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def bundle_from_values(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", te.doubles("embedding").alias("v"))
    shape = F.array(F.size("v").cast("bigint"))
    built = oc.bundle_from_values(rows, ports(spark), "vectors", "input", shape)
    return built.select(
        "vec_id", "contract", "name", "dtype", F.col("shape")[0].cast("int").alias("width"),
        F.round(te.total(F.col("v")), 6).alias("total"),
    )
