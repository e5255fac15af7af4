"""Contract audit of tensor bundles and envelopes.

``ports`` has one row per (contract, side, ordinal): name, dtype_kind
('any'/'exact'/'one_of'), dtypes array<string>, and dims
array<struct<kind:string,size:bigint,label:string>> with kind
'static'/'symbolic'/'dynamic'. ``tensors`` has artifact, contract, side, pos
(place in the bundle), name, dtype and shape array<bigint>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te
from tensorloom.functions.cols import first_failure

# Envelope version, encoding ids and the length of the frame prefix.
ENVELOPE_VERSION = 1
TENSOR_ENCODING = 1
METADATA_ENCODING = 2
FRAME_PREFIX_BYTES = 12


def dtype_accepts(kind: Column, allowed: Column, dtype: Column) -> Column:
    return (kind == "any") | F.array_contains(allowed, dtype)


def keep_conforming(
    df: DataFrame, key: str, values: str, dtype: str, expected: str, rank: int, size: int
) -> DataFrame:
    """Rows whose single one-dimensional tensor meets a one-port contract.

    Row-local form of the bundle audit for tables with one tensor per row.
    """
    fault = first_failure(
        (F.col(values).isNull(), "missing tensor"),
        (F.lit(dtype) != F.lit(expected), "dtype mismatch"),
        (F.lit(1) != F.lit(rank), "rank mismatch"),
        (F.size(values) != size, "dimension mismatch"),
    )
    return df.filter(fault.isNull())


def fingerprint(ports: DataFrame) -> DataFrame:
    """SHA-256 of a canonical text of the contract's ports, inputs first."""
    dims = F.array_join(
        F.transform(
            "dims",
            lambda d: F.concat(
                d["kind"], F.lit("="), F.coalesce(d["label"], d["size"].cast("string"), F.lit(""))
            ),
        ),
        ",",
    )
    line = F.concat_ws(
        ":", "side", F.col("ordinal").cast("string"), "name", "dtype_kind", F.array_join("dtypes", "|"), dims
    )
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("side", "ordinal", line.alias("line")))), lambda p: p["line"]
        ),
        ";",
    )
    return ports.groupBy("contract").agg(F.sha2(text, 256).alias("descriptor_hash"))


def duplicate_ports(ports: DataFrame) -> DataFrame:
    return (
        ports.groupBy("contract", "side", "name")
        .agg(F.count(F.lit(1)).alias("owners"))
        .filter("owners > 1")
    )


def symbolic_bindings(tensors: DataFrame, ports: DataFrame) -> DataFrame:
    """Sizes bound to every label: (artifact, label, ordinal, axis, size, first_size)."""
    sized = (
        tensors.join(
            ports.select("contract", "side", "ordinal", "name", F.posexplode("dims").alias("axis", "_d")),
            ["contract", "side", "name"],
        )
        .filter((F.col("_d.kind") == "symbolic") & (F.col("axis") < F.size("shape")))
        .select(
            "artifact",
            F.col("_d.label").alias("label"),
            "name",
            "ordinal",
            "axis",
            F.element_at("shape", F.col("axis") + 1).alias("size"),
        )
    )
    firsts = sized.groupBy("artifact", "label").agg(
        F.min_by("size", F.struct("ordinal", "axis")).alias("first_size")
    )
    return sized.join(firsts, ["artifact", "label"])


def audit_bundles(artifacts: DataFrame, tensors: DataFrame, ports: DataFrame) -> DataFrame:
    """First fault of every bundle, NULL when it meets its contract.

    Order of the rules: duplicate names, unexpected names, then per port in
    declared order: missing, dtype, rank, and each axis' static or symbolic
    size. ``artifacts`` has artifact, contract and side.
    """
    def fault(rank: Sequence[Column | int], text: Column | str) -> list[Column]:
        places = [F.lit(r).cast("bigint") if isinstance(r, int) else r.cast("bigint") for r in rank]
        text = F.lit(text) if isinstance(text, str) else text
        return ["artifact", F.array(*places).alias("_rank"), F.concat_ws(" ", text, F.col("name")).alias("error")]

    named = tensors.groupBy("artifact", "contract", "side", "name").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("pos").alias("_first"),
        F.min_by("dtype", "pos").alias("dtype"),
        F.min_by("shape", "pos").alias("shape"),
    )
    repeated = (
        tensors.join(named.filter("_n > 1").select("artifact", "name", "_first"), ["artifact", "name"])
        .filter("pos > _first")
        .select(*fault((0, F.col("pos")), "duplicate"))
    )
    # Only the first copy of a repeated name is looked at below: the repetition
    # itself outranks everything that follows.
    asked = artifacts.join(ports, ["contract", "side"]).join(
        named, ["artifact", "contract", "side", "name"], "full_outer"
    )
    unexpected = F.col("ordinal").isNull()
    axis = F.array_min(
        F.filter(
            F.transform(
                F.arrays_zip("dims", "shape"),
                lambda z, i: F.when((z["dims"]["kind"] == "static") & (z["dims"]["size"] != z["shape"]), i),
            ),
            lambda i: i.isNotNull(),
        )
    )
    checked = asked.withColumn(
        "_what",
        first_failure(
            (unexpected, "unexpected"),
            (F.col("dtype").isNull(), "missing"),
            (~dtype_accepts(F.col("dtype_kind"), F.col("dtypes"), F.col("dtype")), "dtype"),
            (F.size("dims") != F.size("shape"), "rank"),
            (axis.isNotNull(), "size"),
        ),
    ).filter(F.col("_what").isNotNull())
    place = F.when(F.col("_what") == "size", axis).otherwise(-1)
    rank = F.when(unexpected, F.array(F.lit(1).cast("bigint"), F.col("_first").cast("bigint"))).otherwise(
        F.array(*[c.cast("bigint") for c in (F.lit(2), F.col("ordinal"), place)])
    )
    by_port = checked.select("artifact", rank.alias("_rank"), F.concat_ws(" ", "_what", "name").alias("error"))
    symbols = (
        symbolic_bindings(named.select("artifact", "contract", "side", "name", "shape"), ports)
        .filter(F.col("size") != F.col("first_size"))
        .select(*fault((2, F.col("ordinal"), F.col("axis")), "symbolic"))
    )
    faults = repeated.unionByName(by_port).unionByName(symbols)
    first = faults.groupBy("artifact").agg(F.min_by("error", "_rank").alias("error"))
    return artifacts.join(first, "artifact", "left")


def declared_order(tensors: DataFrame, ports: DataFrame) -> DataFrame:
    """Tensors with the ordinal of their port, which is their canonical place."""
    return tensors.join(ports.select("contract", "side", "name", "ordinal"), ["contract", "side", "name"])


def audit_envelopes(envelopes: DataFrame, contracts: DataFrame) -> DataFrame:
    """First broken rule of every envelope against the contract it should carry.

    ``envelopes``: artifact, expected_contract, expected_side, envelope_version,
    tensor_encoding, metadata_encoding, contract, version, hash, side.
    ``contracts``: contract, version, descriptor_hash.
    """
    known = contracts.select(
        F.col("contract").alias("expected_contract"),
        F.col("version").alias("_version"),
        F.col("descriptor_hash").alias("_hash"),
    )
    rule = first_failure(
        (F.col("envelope_version") != ENVELOPE_VERSION, "unsupported envelope version"),
        (F.col("tensor_encoding") != TENSOR_ENCODING, "unsupported tensor encoding"),
        (F.col("metadata_encoding") != METADATA_ENCODING, "unsupported metadata encoding"),
        (F.col("contract") != F.col("expected_contract"), "contract id mismatch"),
        (F.col("version") != F.col("_version"), "contract version mismatch"),
        (F.col("hash") != F.col("_hash"), "contract hash mismatch"),
        (F.col("side") != F.col("expected_side"), "contract side mismatch"),
    )
    return (
        envelopes.join(known, "expected_contract", "left")
        .withColumn("error", F.when(F.col("_version").isNull(), "unknown contract").otherwise(rule))
        .drop("_version", "_hash")
    )


def frame_fault(frame: Column, envelope: Column, metadata: Column, tensor: Column) -> Column:
    """Length rule of a frame: prefix + envelope + metadata + tensor is all of it.

    Sums run in DECIMAL, so declared lengths cannot overflow.
    """
    wide = [c.cast("decimal(20,0)") for c in (frame, envelope, metadata, tensor)]
    start = F.lit(FRAME_PREFIX_BYTES).cast("decimal(20,0)")
    return first_failure(
        (wide[0] < start, "truncated"),
        (start + wide[1] > wide[0], "truncated"),
        (start + wide[1] + wide[2] + wide[3] != wide[0], "length mismatch"),
    )


def retag(artifacts: DataFrame, tensors: DataFrame, ports: DataFrame, target: str, side: str) -> DataFrame:
    """Move bundles to the next contract if they meet both; else the fault and the old one."""
    moved = artifacts.withColumn("contract", F.lit(target)).withColumn("side", F.lit(side))
    renamed = tensors.withColumn("contract", F.lit(target)).withColumn("side", F.lit(side))
    old = audit_bundles(artifacts, tensors, ports).withColumnRenamed("error", "_old")
    new = audit_bundles(moved, renamed, ports).select("artifact", F.col("error").alias("_new"))
    error = F.coalesce(F.concat(F.lit("source: "), "_old"), F.concat(F.lit("target: "), "_new"))
    return old.join(new, "artifact").select(
        "artifact", F.when(error.isNull(), F.lit(target)).otherwise(F.col("contract")).alias("contract"), error.alias("error")
    )


def capability_match(pairs: DataFrame, requested: DataFrame, advertised: DataFrame) -> DataFrame:
    """Whether each advertised capability satisfies the request of its pair.

    Capabilities: id, contract, version, descriptor_hash, tensor_encodings,
    metadata_encodings, verbs (arrays), backward_hash.
    """
    def side(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.struct(*[c for c in df.columns if c != "id"]).alias(f"_{key}"))

    joined = pairs.join(side(requested, "request"), "request").join(side(advertised, "offer"), "offer")
    r, a = F.col("_request"), F.col("_offer")

    def covers(field: str) -> Column:
        return F.size(F.array_except(r[field], a[field])) == 0

    same = [a[f] == r[f] for f in ("contract", "version", "descriptor_hash")]
    backward = ~F.array_contains(r["verbs"], "backward") | a["backward_hash"].eqNullSafe(r["backward_hash"])
    match = same[0] & same[1] & same[2] & backward
    for field in ("tensor_encodings", "metadata_encodings", "verbs"):
        match = match & covers(field)
    return joined.select(*pairs.columns, match.alias("satisfied"))


def audit_capabilities(capabilities: DataFrame, contracts: DataFrame) -> DataFrame:
    """First broken rule of an advertised capability.

    Adds to the capability columns backward_contract and backward_version;
    ``contracts`` holds the recomputed descriptor_hash per contract.
    """
    known = contracts.select("contract", F.col("descriptor_hash").alias("_hash"))
    back = contracts.select(
        F.col("contract").alias("backward_contract"), F.col("descriptor_hash").alias("_back_hash")
    )
    joined = capabilities.join(known, "contract", "left").join(back, "backward_contract", "left")
    backward = F.array_contains("verbs", "backward")
    rule = first_failure(
        (~F.col("descriptor_hash").eqNullSafe(F.col("_hash")), "contract hash mismatch"),
        ((F.size("tensor_encodings") == 0) | (F.size("metadata_encodings") == 0), "codec set empty"),
        (backward & F.col("backward_contract").isNull(), "backward contract missing"),
        (backward & ~F.col("backward_hash").eqNullSafe(F.col("_back_hash")), "contract hash mismatch"),
        (
            backward
            & ((F.col("backward_contract") != F.col("contract")) | (F.col("backward_version") != F.col("version"))),
            "backward contract mismatch",
        ),
    )
    return joined.select("id", rule.alias("error"))


def value_count_fault(shape: str, values: str) -> Column:
    return F.when(~te.count_fits(shape, values), "value count does not match shape")


def bundle_from_values(df: DataFrame, ports: DataFrame, contract: str, side: str, shape: Column) -> DataFrame:
    """Bundle rows named after the contract's first port."""
    first = ports.filter(
        (F.col("contract") == contract) & (F.col("side") == side) & (F.col("ordinal") == 0)
    ).select("contract", "side", "name", F.element_at("dtypes", 1).alias("dtype"))
    return df.withColumn("contract", F.lit(contract)).join(F.broadcast(first), "contract").withColumn(
        "shape", shape
    )
