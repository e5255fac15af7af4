"""Pipeline graphs held as tables; every table carries ``graph_id``.

``vertices``: vertex, contract. ``ports``: port, vertex, ordinal. ``edges``:
source (vertex), port (target port), source_contract, destination_contract.
``contracts``: contract, inputs_hash, outputs_hash. Links are resolved edges:
source, target, port.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cols import first_failure
from tensorloom.plans.scans import neighbours, row_numbers, running_total
from tensorloom.session import durable, written

G = "graph_id"
MAX_DEPTH = 16


def resolve_edges(edges: DataFrame, ports: DataFrame) -> DataFrame:
    """Target vertex behind every output port; NULL when the port is missing.

    A port with several owners resolves to the lowest one (and is reported by
    ``duplicate_port_owners``).
    """
    owners = ports.groupBy(G, "port").agg(F.min("vertex").alias("target"))
    return edges.join(owners, [G, "port"], "left")


def duplicate_port_owners(ports: DataFrame) -> DataFrame:
    return ports.groupBy(G, "port").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")


def check_edges(
    edges: DataFrame, ports: DataFrame, vertices: DataFrame, contracts: DataFrame
) -> DataFrame:
    """First contract fault of every edge."""
    own = vertices.select(G, F.col("vertex"), F.col("contract"))
    known = contracts.select("contract", "inputs_hash", "outputs_hash")
    joined = (
        resolve_edges(edges, ports)
        .join(own.select(G, F.col("vertex").alias("source"), F.col("contract").alias("_sc")), [G, "source"], "left")
        .join(own.select(G, F.col("vertex").alias("target"), F.col("contract").alias("_dc")), [G, "target"], "left")
        .join(known.select(F.col("contract").alias("_sc"), F.col("outputs_hash").alias("_out")), "_sc", "left")
        .join(known.select(F.col("contract").alias("_dc"), F.col("inputs_hash").alias("_in")), "_dc", "left")
    )
    rule = first_failure(
        (F.col("_sc").isNull(), "source has no contract"),
        (F.col("target").isNull(), "missing port"),
        (F.col("source_contract").isNull() | F.col("destination_contract").isNull(), "edge has no contract"),
        (F.col("_dc").isNull(), "destination has no contract"),
        (F.col("source_contract") != F.col("_sc"), "source contract mismatch"),
        (F.col("destination_contract") != F.col("_dc"), "destination contract mismatch"),
        (~F.col("_out").eqNullSafe(F.col("_in")), "artifact bundle mismatch"),
    )
    return joined.select(G, "source", "port", "target", rule.alias("error"))


def producer_counts(edges: DataFrame, ports: DataFrame) -> DataFrame:
    fed = edges.groupBy(G, "port").agg(F.count(F.lit(1)).alias("_n"))
    return ports.join(fed, [G, "port"], "left").select(
        G, "vertex", "port", F.coalesce("_n", F.lit(0)).alias("producers")
    )


def vertex_feeding(edges: DataFrame, ports: DataFrame) -> DataFrame:
    """Whether all ports of a vertex have one producer, or none has any."""
    n = F.col("producers")
    return (
        producer_counts(edges, ports)
        .groupBy(G, "vertex")
        .agg(F.min(n).alias("fewest"), F.max(n).alias("most"))
        .withColumn("sound", (F.col("most") == 0) | ((F.col("fewest") == 1) & (F.col("most") == 1)))
    )


def roots(vertices: DataFrame, links: DataFrame) -> DataFrame:
    fed = links.select(G, F.col("target").alias("vertex"))
    return vertices.select(G, "vertex").join(fed, [G, "vertex"], "left_anti")


def sinks(vertices: DataFrame, links: DataFrame) -> DataFrame:
    feeding = links.select(G, F.col("source").alias("vertex"))
    return vertices.select(G, "vertex").join(feeding, [G, "vertex"], "left_anti")


def levels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Topological level of every vertex; NULL on and behind a cycle.

    The level of a vertex is ``max(base, level(source) + weight)`` over its open
    inputs, where ``base`` is what its settled inputs give. A round settles the
    vertices without open inputs, and takes out all with one: those are chains of
    such functions, which compose, so pointer jumping replaces each by a function
    of the next vertex with several inputs in a logarithm of the chain's length.
    Inputs that thereby come from one vertex are one input, so chains, trees and
    diamonds shrink together; rounds are as many as there are layers of real
    merges. All graphs run at once, and degrees are counted over open inputs alone.
    """
    nodes = vertices.select(G, "vertex").distinct()
    inputs = written(links.select(G, F.col("source").alias("parent"), F.col("target").alias("vertex")).distinct().withColumn("weight", F.lit(1)))
    nodes = nodes.withColumn("base", F.lit(None).cast("int"))
    settled, taken_out, every = [], [], None
    while True:
        degree = inputs.groupBy(G, "vertex").agg(
            F.count(F.lit(1)).alias("_open"), F.max("parent").alias("parent"), F.max("weight").alias("weight")
        )
        state = written(nodes.join(degree, [G, "vertex"], "left"))
        every = state.select(G, "vertex") if every is None else every
        counts = state.agg(
            F.count(F.when(F.col("_open").isNull(), 1)).alias("free"), F.count(F.when(F.col("_open") == 1, 1)).alias("single"),
            F.count(F.when(F.col("_open") > 1, 1)).alias("merge"),
        ).first()
        free = state.filter("_open IS NULL").select(G, "vertex", F.coalesce("base", F.lit(0)).alias("level"))
        single = state.filter("_open = 1").select(G, "vertex", "parent", "base", "weight")
        if counts["single"]:
            single = _jumped(single, counts["single"])
            taken_out.append(single)
        settled.append(free)
        if not counts["merge"] or not (counts["free"] or counts["single"]):
            break
        # What settled and taken-out sources stand for: a constant, or a function of another vertex.
        known = free.select(G, F.col("vertex").alias("parent"), F.lit(None).cast(dict(single.dtypes)["parent"]).alias("_far"), F.col("level").alias("_base"), F.lit(None).cast("int").alias("_weight"))
        stand = known
        if counts["single"]:
            ended = single.join(free.select(G, F.col("vertex").alias("parent"), "level"), [G, "parent"], "left")
            constant = F.greatest(F.col("base"), F.col("level") + F.col("weight"))
            stand = known.unionByName(ended.select(
                G, F.col("vertex").alias("_v"), F.when(F.col("level").isNull(), F.col("parent")).alias("_far"),
                F.when(F.col("level").isNull(), F.col("base")).otherwise(constant).alias("_base"),
                F.when(F.col("level").isNull(), F.col("weight")).alias("_weight"),
            ).withColumnRenamed("_v", "parent"))
        merges = state.filter("_open > 1").select(G, "vertex", "base")
        stand = stand.withColumn("_stands", F.lit(True))
        into = inputs.join(merges.select(G, "vertex"), [G, "vertex"]).join(stand, [G, "parent"], "left")
        moved = written(into.select(
            G, "vertex",
            F.when(F.col("_stands").isNull(), F.col("parent")).otherwise(F.col("_far")).alias("parent"),
            F.when(F.col("_stands").isNull(), F.col("weight")).otherwise(F.col("_weight") + F.col("weight")).alias("weight"),
            (F.col("_base") + F.col("weight")).alias("_base"),
        ))
        gained = moved.groupBy(G, "vertex").agg(F.max("_base").alias("_gain"))
        nodes = merges.join(gained, [G, "vertex"], "left").select(G, "vertex", F.greatest("base", "_gain").alias("base"))
        inputs = moved.filter("parent IS NOT NULL").groupBy(G, "vertex", "parent").agg(F.max("weight").alias("weight"))
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    # Vertices taken out last depend on nothing taken out before.
    for part in reversed(taken_out):
        source = found.select(G, F.col("vertex").alias("parent"), "level")
        value = part.join(source, [G, "parent"]).select(G, "vertex", F.greatest(F.col("base"), F.col("level") + F.col("weight")).alias("level"))
        found = written(found.unionByName(value))
    return every.join(found, [G, "vertex"], "left")


def _jumped(single: DataFrame, still: int) -> DataFrame:
    """Functions (parent, base, weight) of vertices with one input, composed until the parent is none of them.

    Rows whose parent is one of them look it up, two steps of doubling a round,
    in which every chain that ends comes nearer to its end. What lies on a ring
    never gets there and is left out: it has no level, nor has what hangs on it.
    """
    there = single.select(G, F.col("vertex").alias("parent"), F.lit(True).alias("_there"))
    left = single.join(there, [G, "parent"], "left").select(
        G, "vertex", "parent", "base", "weight", F.coalesce("_there", F.lit(False)).alias("_open")
    )

    def step(rows: DataFrame) -> DataFrame:
        ahead = rows.select(
            G, F.col("vertex").alias("parent"), F.col("parent").alias("_parent"), F.col("base").alias("_base"),
            F.col("weight").alias("_weight"), F.col("_open").alias("_further"),
        )
        moved = rows.filter("_open").join(ahead, [G, "parent"]).select(
            G, "vertex", F.col("_parent").alias("parent"), F.greatest(F.col("base"), F.col("_base") + F.col("weight")).alias("base"),
            (F.col("weight") + F.col("_weight")).alias("weight"), F.col("_further").alias("_open"),
        )
        return rows.filter("NOT _open").unionByName(moved)

    while True:
        left = written(step(step(left)))
        before, still = still, left.filter("_open").count()
        if not still or still == before:
            return left.filter("NOT _open").drop("_open")


def audit_graphs(
    graphs: DataFrame, vertices: DataFrame, ports: DataFrame, edges: DataFrame, contracts: DataFrame
) -> DataFrame:
    """First broken rule of every graph and its sink when it has none.

    Order: port ownership, empty graph, edge faults by (source, port), port with
    several producers, half-fed vertex, cycle, number of sinks.
    """
    def per_graph(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(G).agg(F.count(F.lit(1)).alias(name))

    checked = check_edges(edges, ports, vertices, contracts)
    faults = checked.filter("error IS NOT NULL").groupBy(G).agg(
        F.min_by("error", F.struct("source", "port")).alias("_edge")
    )
    links = checked.filter("target IS NOT NULL")
    feeding = vertex_feeding(edges, ports)
    crowded = feeding.filter("most > 1")
    half = feeding.filter("NOT sound")
    stuck = levels(vertices, links).filter("level IS NULL")
    ends = sinks(vertices, links).groupBy(G).agg(
        F.count(F.lit(1)).alias("_sinks"), F.min("vertex").alias("_sink")
    )
    joined = graphs.select(G)
    for part in (
        per_graph(duplicate_port_owners(ports), "_dup"),
        per_graph(vertices, "_n"),
        faults,
        per_graph(crowded, "_crowd"),
        per_graph(half, "_half"),
        per_graph(stuck, "_stuck"),
        ends,
    ):
        joined = joined.join(part, G, "left")
    rule = first_failure(
        (F.col("_dup") > 0, "duplicate port ownership"),
        (F.col("_n").isNull(), "empty graph"),
        (F.col("_edge").isNotNull(), F.col("_edge")),
        (F.col("_crowd") > 0, "port with several producers"),
        (F.col("_half") > 0, "half-fed vertex"),
        (F.col("_stuck") > 0, "cycle"),
        (F.coalesce("_sinks", F.lit(0)) != 1, "not exactly one sink"),
    )
    return joined.select(G, rule.alias("error")).join(
        ends.select(G, "_sink"), G, "left"
    ).select(G, "error", F.when(F.col("error").isNull(), F.col("_sink")).alias("sink"))


def pending_counts(vertices: DataFrame, links: DataFrame, completed: DataFrame) -> DataFrame:
    """Unresolved inputs per vertex after the completed ones; zero means ready."""
    open_links = links.join(
        completed.select(G, F.col("vertex").alias("source")), [G, "source"], "left_anti"
    )
    waiting = open_links.groupBy(G, F.col("target").alias("vertex")).agg(F.count(F.lit(1)).alias("_n"))
    left = vertices.select(G, "vertex").join(completed.select(G, "vertex"), [G, "vertex"], "left_anti")
    return left.join(waiting, [G, "vertex"], "left").select(
        G, "vertex", F.coalesce("_n", F.lit(0)).alias("pending"), F.col("_n").isNull().alias("ready")
    )


def fan_out(outputs: DataFrame, links: DataFrame) -> DataFrame:
    """A copy of each vertex output for every downstream port."""
    return outputs.withColumnRenamed("vertex", "source").join(links, [G, "source"])


def root_inputs(inputs: DataFrame, vertices: DataFrame, ports: DataFrame, links: DataFrame) -> DataFrame:
    """Every graph input for every port of every root."""
    return roots(vertices, links).join(ports, [G, "vertex"]).select(G, "vertex", "port").join(inputs, G)


def fan_in(deliveries: DataFrame, payload: str, address: str) -> DataFrame:
    """Pair the two ports of a vertex per step, first port first.

    ``deliveries``: graph_id, vertex, step, ordinal (0/1), the payload and the
    send address. Differing addresses are an error.
    """
    on = [G, "vertex", "step"]

    def side(ordinal: int) -> DataFrame:
        return deliveries.filter(F.col("ordinal") == ordinal).select(
            *on, F.col(payload).alias(f"p{ordinal + 1}"), F.col(address).alias(f"_a{ordinal}")
        )

    both = side(0).join(side(1), on)
    return both.select(
        *on, "p1", "p2", F.when(F.col("_a0") != F.col("_a1"), "ports name different receivers").alias("error")
    )


def same_bits(a: Column, b: Column) -> Column:
    """Equality of the bits of two doubles: NaN equals NaN, -0.0 differs from 0.0."""
    return a.eqNullSafe(b) & (a.cast("string") == b.cast("string"))


def fan_in_control(messages: DataFrame) -> DataFrame:
    """Whether both ports carry the same (loss_up, loss_down, seed), bit for bit."""
    on = [G, "vertex", "step"]
    fields = ["loss_up", "loss_down", "seed"]

    def side(ordinal: int) -> DataFrame:
        return messages.filter(F.col("ordinal") == ordinal).select(
            *on, F.struct(*fields).alias(f"_m{ordinal}")
        )

    a, b = F.col("_m0"), F.col("_m1")
    agree = (
        same_bits(a["loss_up"], b["loss_up"])
        & same_bits(a["loss_down"], b["loss_down"])
        & (a["seed"] == b["seed"])
    )
    return side(0).join(side(1), on).select(
        *on, F.when(~agree, "control payloads disagree").alias("error")
    )


def snapshot(vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and deduplicated edges in canonical order."""
    nodes = vertices.dropDuplicates([G, "vertex"]).orderBy(G, "vertex")
    edges = links.select(G, "source", "target", "port").distinct()
    return nodes, edges.orderBy(G, "source", "target", "port")


def merged_graph_faults(vertices: DataFrame, ports: DataFrame, links: DataFrame) -> DataFrame:
    """All faults of drawn graphs: duplicate ids, shared ports, bad edges."""
    ids = vertices.groupBy(G, "vertex").agg(F.count(F.lit(1)).alias("_n"))
    repeated = ids.filter("_n > 1").select(
        G, F.col("vertex").alias("at"), F.lit("duplicate id").alias("error")
    )
    shared = (
        ports.groupBy(G, "port").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select(G, F.col("port").alias("at"), F.lit("port with several owners").alias("error"))
    )
    known = ids.select(G, "vertex", F.lit(True).alias("_k"))
    owners = ports.groupBy(G, "port").agg(F.max("vertex").alias("_owner"))
    judged = (
        links.select(G, "source", "target", "port").distinct()
        .join(known.select(G, F.col("vertex").alias("source"), F.col("_k").alias("_s")), [G, "source"], "left")
        .join(known.select(G, F.col("vertex").alias("target"), F.col("_k").alias("_t")), [G, "target"], "left")
        .join(owners, [G, "port"], "left")
        .select(
            G,
            F.col("source").alias("at"),
            first_failure(
                (F.col("_s").isNull(), "unknown source"),
                (F.col("_t").isNull(), "unknown target"),
                (F.col("source") == F.col("target"), "self edge"),
                (~F.col("_owner").eqNullSafe(F.col("target")), "unowned port"),
            ).alias("error"),
        )
        .filter("error IS NOT NULL")
    )
    return repeated.unionByName(shared).unionByName(judged)


def merge_nested(
    graphs: DataFrame,
    vertices: DataFrame,
    ports: DataFrame,
    links: DataFrame,
    top: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Expand nested graphs into their parents.

    ``graphs``: graph_id, finalized. ``vertices`` may name a ``nested`` graph.
    ``top``: graph_id of the outer graphs. Unfinished, faulty or many-sink nested
    graphs, and what hangs below them, are left out; depth is at most 16.

    Returns nodes (top, vertex, path, graph_id, local) and edges (top, source,
    target, port). Outer ids stay; nested ids and ports are numbered after the
    outer ones, level by level of the path, and a connector port joins each
    boundary vertex to the nested sink.
    """
    broken = merged_graph_faults(vertices, ports, links).select(G).distinct()
    ends = sinks(vertices, links).groupBy(G).agg(
        F.count(F.lit(1)).alias("_n"), F.min("vertex").alias("sink")
    )
    usable = (
        graphs.filter("finalized").join(broken, G, "left_anti")
        .join(ends.filter("_n = 1").select(G, "sink"), G)
    )
    boundaries = durable(
        vertices.filter("nested IS NOT NULL")
        .select(G, "vertex", "nested")
        .join(usable.select(F.col(G).alias("nested"), "sink"), "nested")
    )
    level = top.select(
        F.col(G).alias("top"), G, F.array().cast("array<bigint>").alias("path"), F.lit(None).cast("bigint").alias("sink")
    )
    instances = level = durable(level)
    for _ in range(MAX_DEPTH):
        level = durable(
            level.select("top", G, "path").join(boundaries, G).select(
                "top", F.col("nested").alias(G), F.concat("path", F.array(F.col("vertex").cast("bigint"))).alias("path"), "sink"
            )
        )
        if level.isEmpty():
            break
        instances = instances.unionByName(level)

    def numbered(members: DataFrame, item: str) -> DataFrame:
        """Number (top, place, item) rows: outer items keep theirs, others follow."""
        members = durable(members)
        outer = members.filter("_outer").groupBy("top").agg(F.max(item).alias("_base"))
        inner = members.filter("NOT _outer")
        # Sizes per instance run first, so the ordered pass sees instances, not items.
        sizes = inner.groupBy("top", "place").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_first", F.element_at("place", 1)
        )
        offsets = running_total(sizes, ["top"], ["_first", "place"], {"_through": F.col("_n")})
        within = row_numbers(inner, ["top", "place"], [item], "_r")
        fresh = (
            within.join(offsets.select("top", "place", (F.col("_through") - F.col("_n")).alias("_off")), ["top", "place"])
            .join(outer, "top", "left")
            .withColumn("id", F.coalesce("_base", F.lit(0)) + F.col("_off") + F.col("_r"))
            .drop("_r", "_off", "_base")
        )
        return members.filter("_outer").withColumn("id", F.col(item).cast("bigint")).unionByName(fresh)

    outer = F.size("path") == 0
    cells = instances.join(vertices.select(G, "vertex"), G).select(
        "top", G, "path", F.col("path").alias("place"), outer.alias("_outer"), F.col("vertex").alias("local")
    )
    nodes = durable(numbered(cells, "local"))
    # Own ports come before anything nested, the connector after it.
    start, end = F.lit(-1).cast("bigint"), F.lit(2**62).cast("bigint")
    own = instances.join(ports.select(G, "port"), G).select(
        "top", G, "path", F.concat("path", F.array(start)).alias("place"), outer.alias("_outer"), "port"
    )
    connectors = instances.filter(~outer).select(
        "top", G, "path", F.concat("path", F.array(end)).alias("place"), F.lit(False).alias("_outer"),
        F.lit(-1).cast(dict(ports.dtypes)["port"]).alias("port"),
    )
    port_ids = durable(
        numbered(own.unionByName(connectors), "port").select("top", "path", "port", F.col("id").alias("port_id"))
    )
    by_local = nodes.select("top", "path", "local", F.col("id").alias("_id"))

    def end_of(name: str) -> DataFrame:
        return by_local.select("top", "path", F.col("local").alias(name), F.col("_id").alias(f"_{name}"))

    inside = (
        instances.join(links.select(G, "source", "target", "port").distinct(), G)
        .join(end_of("source"), ["top", "path", "source"])
        .join(end_of("target"), ["top", "path", "target"])
        .join(port_ids, ["top", "path", "port"])
        .select("top", F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("port_id").alias("port"))
    )
    joints = instances.filter(~outer).select(
        "top",
        F.slice("path", 1, F.size("path") - 1).alias("_up"),
        F.element_at("path", -1).alias("_parent"),
        "path",
        "sink",
    )
    bridges = (
        joints.join(
            by_local.select("top", F.col("path").alias("_up"), F.col("local").cast("bigint").alias("_parent"), F.col("_id").alias("source")),
            ["top", "_up", "_parent"],
        )
        .join(by_local.select("top", "path", F.col("local").alias("sink"), F.col("_id").alias("target")), ["top", "path", "sink"])
        .join(port_ids.filter("port = -1").select("top", "path", F.col("port_id").alias("port")), ["top", "path"])
        .select("top", "source", "target", "port")
    )
    return (
        nodes.select("top", F.col("id").alias("vertex"), "path", G, "local"),
        inside.unionByName(bridges),
    )


def expand_lanes(vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split two-port nodes in two; edges follow the lane of their target port.

    ``vertices``: vertex and an ordered ``ports`` array. The second lane takes
    the second port's number as its id. A port that several vertices own is an
    ``error`` on its nodes and on the edges into it.
    """
    two = F.size("ports") == 2
    lanes = F.when(
        two,
        F.array(
            F.struct(F.col("vertex").cast("bigint").alias("vertex"), F.slice("ports", 1, 1).alias("ports")),
            F.struct(F.element_at("ports", 2).cast("bigint").alias("vertex"), F.slice("ports", 2, 1).alias("ports")),
        ),
    ).otherwise(F.array(F.struct(F.col("vertex").cast("bigint").alias("vertex"), F.col("ports"))))
    owned = vertices.select(G, "vertex", F.explode("ports").alias("port"))
    clash = owned.groupBy(G, "port").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    clash = clash.withColumn("_error", F.lit("port has several owners"))
    doubtful = owned.join(clash, [G, "port"]).groupBy(G, "vertex").agg(F.collect_set("port").alias("_shared"))
    spread = vertices.join(doubtful, [G, "vertex"], "left").select(G, "_shared", F.explode(lanes).alias("_l"))
    shared = F.arrays_overlap("_l.ports", F.coalesce("_shared", F.array().cast(dict(vertices.dtypes)["ports"])))
    nodes = spread.select(G, "_l.*", F.when(shared, "port has several owners").alias("error"))
    info = vertices.select(G, "vertex", "ports")
    joined = links.join(
        info.select(G, F.col("vertex").alias("target"), F.col("ports").alias("_tp")), [G, "target"], "left"
    ).join(info.select(G, F.col("vertex").alias("source"), F.col("ports").alias("_sp")), [G, "source"], "left")
    place = F.coalesce(F.array_position("_tp", F.col("port")), F.lit(0))

    def lane_id(vertex: str, own: str) -> Column:
        return F.when((F.size(own) == 2) & (place >= 2), F.element_at(own, 2)).otherwise(F.col(vertex)).cast("bigint")

    return nodes, joined.join(clash, [G, "port"], "left").select(
        G, lane_id("source", "_sp").alias("source"), lane_id("target", "_tp").alias("target"), "port", F.col("_error").alias("error")
    )


def linear_chains(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Whether every graph is one chain through its vertices in id order."""
    following = neighbours(
        vertices.select(G, "vertex").distinct(), [G], ["vertex"], {"_next": "vertex"}, 1
    )
    outgoing = links.groupBy(G, F.col("source").alias("vertex")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("target").alias("_to")
    )
    sound = F.col("_next").isNull() | (
        (F.coalesce("_n", F.lit(0)) == 1) & (F.col("_to") == F.col("_next"))
    )
    return (
        following.join(outgoing, [G, "vertex"], "left")
        .groupBy(G)
        .agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("linear"))
    )


def broadcast_losses(losses: DataFrame, ports: DataFrame) -> DataFrame:
    """One loss record per (graph, step) for every input port of the graph."""
    return ports.select(G, "vertex", "port").join(losses, G)


def route_to_nested(losses: DataFrame, vertices: DataFrame, nested_state: DataFrame) -> DataFrame:
    """Loss record of a boundary vertex for its nested graph, with the flag read back.

    ``losses``: graph_id, vertex, loss columns. ``nested_state``: graph_id, frozen.
    """
    boundary = vertices.filter("nested IS NOT NULL").select(G, "vertex", "nested")
    state = nested_state.select(F.col(G).alias("nested"), "frozen")
    return losses.join(boundary, [G, "vertex"]).join(state, "nested", "left")
