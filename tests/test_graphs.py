import random

from pyspark.sql import functions as F

from tensorloom.functions.labels import boundary_label, short_label
from tensorloom.operators import graphs as og


def test_levels_of_a_diamond_and_a_cycle(spark):
    vertices = spark.createDataFrame([(0, v) for v in range(4)] + [(1, v) for v in range(4)], "graph_id long, vertex long")
    links = spark.createDataFrame(
        [(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 3, 3), (0, 2, 3, 4), (1, 0, 1, 1), (1, 1, 2, 2), (1, 2, 1, 5), (1, 2, 3, 3)],
        "graph_id long, source long, target long, port long",
    )
    got = {(r.graph_id, r.vertex): r.level for r in og.levels(vertices, links).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (0, 3): 2, (1, 0): 0, (1, 1): None, (1, 2): None, (1, 3): None}


def test_two_lane_nodes_split(spark):
    vertices = spark.createDataFrame([(0, 0, [0, 1]), (0, 2, [2, 3])], "graph_id long, vertex long, ports array<bigint>")
    links = spark.createDataFrame([(0, 0, 2, 2), (0, 0, 2, 3)], "graph_id long, source long, target long, port long")
    nodes, edges = og.expand_lanes(vertices, links)
    assert sorted((r.source, r.target) for r in edges.collect()) == [(0, 2), (1, 3)]
    assert sorted((r.vertex, r.ports) for r in nodes.collect()) == [(0, [0]), (1, [1]), (2, [2]), (3, [3])]


def test_labels(spark):
    cases = {
        "a::b::C<d::E, f::G<h::I>>": ("C<E, G<I>>", None),
        "Warp<x::A<u8, B>, m::C<D, E>>": ("Warp<A<u8, B>, C<D, E>>", "C<D, E>"),
        "Warp<A>": ("Warp<A>", None),
        " plain ": ("plain", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r.l: (r.s, r.b) for r in df.select("l", short_label("l").alias("s"), boundary_label("l").alias("b")).collect()}
    assert got == cases


def test_hot_graph_chain(spark):
    vertices = spark.range(50).select(F.lit(0).cast("bigint").alias("graph_id"), F.col("id").alias("vertex"))
    links = spark.range(49).select(
        F.lit(0).cast("bigint").alias("graph_id"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"), (F.col("id") + 1).alias("port")
    )
    assert og.linear_chains(vertices, links).first().linear
    assert not og.linear_chains(vertices, links.filter("source <> 20")).first().linear


def random_graphs(seed):
    """graph -> (finalized, {vertex: nested}, {port: vertex}, [(source, target, port)])"""
    rng = random.Random(seed)
    out = {}
    for g in range(14):
        vs = sorted(rng.sample(range(1, 9), rng.randrange(1, 4)))
        nested = {v: (rng.randrange(g + 1, 16) if rng.random() < 0.5 else None) for v in vs}
        ports = {v * 10 + rng.randrange(3): v for v in vs}
        by_vertex = {v: p for p, v in ports.items()}
        edges = [(a, b, by_vertex[b]) for a, b in zip(vs, vs[1:]) if rng.random() < 0.9]
        if rng.random() < 0.1:
            edges.append((vs[0], vs[0], by_vertex[vs[0]]))
        out[g] = (rng.random() < 0.8, nested, ports, edges)
    return out


def valid(graph):
    return all(a != b for a, b, _ in graph[3])


def expand(graphs, g):
    """Nodes and edges of one graph with its nested graphs, one level at a time."""
    _, nested, ports, edges = graphs[g]
    nodes = [((), g, v, v) for v in sorted(nested)]
    drawn = list(edges)
    next_id, next_port = max(nested) + 1, max(ports) + 1
    all_ports = sorted(ports)
    for v in sorted(nested):
        child = nested[v]
        if child not in graphs or not graphs[child][0] or not valid(graphs[child]):
            continue
        ends = set(graphs[child][1]) - {a for a, _, _ in graphs[child][3]}
        if len(ends) != 1:
            continue
        sub_nodes, sub_edges, sub_ports = expand(graphs, child)
        ids = {n[3]: next_id + i for i, n in enumerate(sub_nodes)}
        next_id += len(sub_nodes)
        renamed = {p: next_port + i for i, p in enumerate(sub_ports)}
        next_port += len(sub_ports)
        nodes += [((v, *path), at, local, ids[i]) for path, at, local, i in sub_nodes]
        drawn += [(ids[a], ids[b], renamed[p]) for a, b, p in sub_edges]
        drawn.append((v, ids[ends.pop()], next_port))
        all_ports += [*renamed.values(), next_port]
        next_port += 1
    return nodes, drawn, all_ports


def test_nested_merge_against_recursion(spark):
    for seed in (1, 2):
        graphs = random_graphs(seed)
        table = spark.createDataFrame([(g, d[0]) for g, d in graphs.items()], "graph_id long, finalized boolean")
        vertices = spark.createDataFrame([(g, v, n) for g, d in graphs.items() for v, n in d[1].items()], "graph_id long, vertex long, nested long")
        ports = spark.createDataFrame([(g, p, v) for g, d in graphs.items() for p, v in d[2].items()], "graph_id long, port long, vertex long")
        links = spark.createDataFrame([(g, *e) for g, d in graphs.items() for e in d[3]], "graph_id long, source long, target long, port long")
        nodes, edges = og.merge_nested(table, vertices, ports, links, table.select("graph_id"))
        got_nodes = sorted((r.top, tuple(r.path), r.graph_id, r.local, r.vertex) for r in nodes.collect())
        got_edges = sorted((r.top, r.source, r.target, r.port) for r in edges.collect())
        want_nodes, want_edges = [], []
        for g in graphs:
            n, e, _ = expand(graphs, g)
            want_nodes += [(g, *x) for x in n]
            want_edges += [(g, *x) for x in e]
        assert got_nodes == sorted(want_nodes)
        assert got_edges == sorted(want_edges)


def test_nested_merge_of_one_graph_over_any_ranges(spark, ranges):
    """The instances of one outer graph, so many that they fill several ranges."""
    n = 300
    table = spark.createDataFrame([(g, True) for g in range(n + 1)], "graph_id long, finalized boolean")
    vertices = spark.createDataFrame([(0, v, v) for v in range(1, n + 1)] + [(g, 1, None) for g in range(1, n + 1)], "graph_id long, vertex long, nested long")
    ports = vertices.select("graph_id", F.col("vertex").alias("port"), "vertex")
    links = spark.createDataFrame([(0, v, v + 1, v + 1) for v in range(1, n)], "graph_id long, source long, target long, port long")
    top = spark.createDataFrame([(0,)], "graph_id long")
    nodes, edges = og.merge_nested(table, vertices, ports, links, top)
    got = sorted((r.vertex, r.graph_id, r.local) for r in nodes.collect())
    assert got == [(v, 0, v) for v in range(1, n + 1)] + [(n + v, v, 1) for v in range(1, n + 1)]
    # Per nested graph its own port and then the connector, which joins it to its boundary.
    got = sorted((r.source, r.target, r.port) for r in edges.collect())
    assert got == sorted([(v, v + 1, v + 1) for v in range(1, n)] + [(v, n + v, n + 2 * v) for v in range(1, n + 1)])


def peeled(vertices, edges):
    """Levels one by one."""
    inputs = {v: {s for s, t in edges if t == v} for v in vertices}
    found, level = {}, 0
    while True:
        ready = [v for v in vertices if v not in found and not inputs[v] - found.keys()]
        if not ready:
            return {v: found.get(v) for v in vertices}
        found |= dict.fromkeys(ready, level)
        level += 1


def test_levels_of_chains_trees_diamonds_rings_and_strangers(spark):
    rng = random.Random(7)
    rows, links, want = [], [], {}
    for g in range(60):
        n = rng.randrange(1, 22)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))]
        if g % 4 == 0:
            edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
        elif g % 4 == 1:
            edges = [(i, i + 1) for i in range(n - 1)] + [(999, n - 1)] * (g % 8 == 1)
        elif g % 4 == 2:
            edges = [(rng.randrange(i), i) for i in range(1, n)] + [(i - 2, i) for i in range(2, n, 3)]
        rows += [(g, v) for v in range(n)]
        links += [(g, s, t) for s, t in edges]
        want |= {(g, v): level for v, level in peeled(range(n), edges).items()}
    vertices = spark.createDataFrame(rows, "graph_id long, vertex long")
    got = og.levels(vertices, spark.createDataFrame(links, "graph_id long, source long, target long"))
    assert {(r.graph_id, r.vertex): r.level for r in got.collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    kept = og.written
    monkeypatch.setattr(og, "written", lambda df: tables.append(1) or kept(df))
    n = 10_000
    vertices = spark.range(n).selectExpr("0L AS graph_id", "id AS vertex")
    links = spark.range(n - 1).selectExpr("0L AS graph_id", "id AS source", "id + 1 AS target")
    got = og.levels(vertices, links).filter("level <> vertex OR level IS NULL").count()
    assert got == 0 and len(tables) <= 12
