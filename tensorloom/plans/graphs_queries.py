"""Registered graph queries: one pipeline graph per order, vertices from its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.functions.labels import boundary_label, short_label
from tensorloom.operators import graphs as og
from tensorloom.plans.catalog import register, table


def lines(spark, sf_dir):
    """Distinct line numbers of an order in an array (at most seven)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(
        F.sort_array(F.collect_set(F.col("l_linenumber").cast("bigint"))).alias("vs")
    )


def graph_tables(spark, sf_dir):
    """A chain through the lines with a fault chosen by graph_id % 8.

    1 back edge, 2 missing port, 3 shared port, 4 two producers, 5 unfed second
    port, 6 last edge lost, 7 wrong source contract, 0 second port fed as well.
    """
    base = lines(spark, sf_dir).withColumn("k", F.col("graph_id") % 8).withColumn("n", F.size("vs"))
    first, last, n, k = F.element_at("vs", 1), F.element_at("vs", -1), F.col("n"), F.col("k")
    vertices = base.select("graph_id", F.explode("vs").alias("vertex")).withColumn(
        "contract", F.concat(F.lit("stage"), F.col("vertex"))
    )

    def port(number, vertex, ordinal):
        return F.struct(number.alias("port"), vertex.alias("vertex"), F.lit(ordinal).cast("bigint").alias("ordinal"))

    fifty = F.lit(50).cast("bigint")
    none = F.array().cast("array<struct<port:bigint,vertex:bigint,ordinal:bigint>>")
    extra = (
        F.when((k == 3) & (n >= 2), F.array(port(first, last, 1)))
        .when(k.isin(0, 5) & (n >= 2), F.array(port(fifty, last, 1)))
        .otherwise(none)
    )
    own = F.transform("vs", lambda v: port(v, v, 0))
    ports = base.select("graph_id", F.explode(F.concat(own, extra)).alias("p")).select("graph_id", "p.*")

    def edge(source, target):
        return F.struct(source.alias("source"), target.alias("port"))

    no_edge = F.array().cast("array<struct<source:bigint,port:bigint>>")
    length = F.greatest(n - F.when(k == 6, 2).otherwise(1), F.lit(0))
    chain = F.when(
        length > 0,
        F.transform(F.sequence(F.lit(1), length), lambda i: edge(F.element_at("vs", i), F.element_at("vs", i + 1))),
    ).otherwise(no_edge)
    more = (
        F.when(k == 1, F.array(edge(last, first)))
        .when(k == 2, F.array(edge(first, F.lit(99).cast("bigint"))))
        .when((k == 4) & (n >= 3), F.array(edge(first, last)))
        .when((k == 0) & (n >= 2), F.array(edge(first, fifty)))
        .otherwise(no_edge)
    )
    edges = base.select("graph_id", "k", first.alias("_first"), F.explode(F.concat(chain, more)).alias("e")).select(
        "graph_id",
        F.col("e.source").alias("source"),
        F.col("e.port").alias("port"),
        F.when((F.col("k") == 7) & (F.col("e.source") == F.col("_first")), "other")
        .otherwise(F.concat(F.lit("stage"), F.col("e.source")))
        .alias("source_contract"),
        F.lit(None).cast("string").alias("destination_contract"),
    )
    named = og.resolve_edges(edges, ports).withColumn(
        "destination_contract", F.concat(F.lit("stage"), F.coalesce("target", "port"))
    )
    contracts = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("v")).distinct().select(
        F.concat(F.lit("stage"), F.col("v")).alias("contract"),
        F.when(F.col("v") == 7, "u").otherwise("t").alias("inputs_hash"),
        F.lit("t").alias("outputs_hash"),
    )
    return base.select("graph_id"), vertices, ports, named.drop("target"), contracts


TABLES = """v AS (SELECT DISTINCT l_orderkey AS graph_id, l_linenumber::BIGINT AS vertex, l_orderkey % 8 AS k FROM lineitem),
  b AS (SELECT graph_id, any_value(k) AS k, min(vertex) AS f, max(vertex) AS l, count(*) AS n FROM v GROUP BY graph_id),
  pt AS (SELECT graph_id, vertex AS port, vertex, 0 AS ordinal FROM v UNION ALL SELECT graph_id, f, l, 1 FROM b WHERE k = 3 AND n >= 2
    UNION ALL SELECT graph_id, 50, l, 1 FROM b WHERE k IN (0, 5) AND n >= 2),
  ch AS (SELECT graph_id, vertex AS source, lead(vertex) OVER (PARTITION BY graph_id ORDER BY vertex) AS port FROM v),
  ed AS (SELECT ch.graph_id, source, port FROM ch JOIN b USING (graph_id) WHERE port IS NOT NULL AND NOT (k = 6 AND port = l)
    UNION ALL SELECT graph_id, l, f FROM b WHERE k = 1 UNION ALL SELECT graph_id, f, 99 FROM b WHERE k = 2
    UNION ALL SELECT graph_id, f, l FROM b WHERE k = 4 AND n >= 3 UNION ALL SELECT graph_id, f, 50 FROM b WHERE k = 0 AND n >= 2),
  ow AS (SELECT graph_id, port, min(vertex) AS target, count(*) AS owners FROM pt GROUP BY ALL),
  li AS (SELECT ed.*, target FROM ed LEFT JOIN ow USING (graph_id, port)),
  ce AS (SELECT li.graph_id, source, port, target, CASE WHEN target IS NULL THEN 'missing port' WHEN k = 7 AND source = f THEN 'source contract mismatch'
    WHEN target = 7 THEN 'artifact bundle mismatch' END AS error FROM li JOIN b USING (graph_id)),
  pc AS (SELECT pt.graph_id, vertex, pt.port, count(ed.source) AS producers FROM pt LEFT JOIN ed ON ed.graph_id = pt.graph_id AND ed.port = pt.port
    GROUP BY pt.graph_id, vertex, pt.port, pt.ordinal),
  ln AS (SELECT DISTINCT graph_id, source, target FROM li WHERE target IS NOT NULL)"""
LEVELS = TABLES.replace("v AS (", "RECURSIVE v AS (", 1) + """,
  walk AS (SELECT graph_id, vertex, 0 AS d FROM v WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.graph_id = v.graph_id AND target = vertex)
    UNION SELECT ln.graph_id, target, d + 1 FROM walk JOIN ln ON ln.graph_id = walk.graph_id AND source = vertex WHERE d < 20),
  reach AS (SELECT graph_id, source, target FROM ln UNION SELECT r.graph_id, r.source, ln.target FROM reach r JOIN ln
    ON ln.graph_id = r.graph_id AND ln.source = r.target),
  cyc AS (SELECT DISTINCT graph_id, source AS vertex FROM reach WHERE source = target),
  bad AS (SELECT graph_id, vertex FROM cyc UNION SELECT r.graph_id, r.target FROM reach r JOIN cyc ON cyc.graph_id = r.graph_id AND cyc.vertex = r.source),
  lv AS (SELECT v.graph_id, v.vertex, CASE WHEN bad.vertex IS NULL THEN max(d) END AS level FROM v LEFT JOIN walk USING (graph_id, vertex)
    LEFT JOIN bad USING (graph_id, vertex) GROUP BY v.graph_id, v.vertex, bad.vertex)"""


def links(spark, sf_dir):
    _, vertices, ports, edges, _ = graph_tables(spark, sf_dir)
    resolved = og.resolve_edges(edges, ports).filter("target IS NOT NULL")
    return vertices, ports, resolved.select("graph_id", "source", "target", "port")


@register("resolve_output_ports", f"WITH {TABLES} SELECT graph_id, source, port, target, CASE WHEN target IS NULL THEN 'missing port' END AS error FROM li")
def resolve_output_ports(spark, sf_dir):
    _, _, ports, edges, _ = graph_tables(spark, sf_dir)
    return og.resolve_edges(edges, ports).select(
        "graph_id", "source", "port", "target", F.when(F.col("target").isNull(), "missing port").alias("error")
    )


@register("edge_contract_checks", f"WITH {TABLES} SELECT * FROM ce")
def edge_contract_checks(spark, sf_dir):
    _, vertices, ports, edges, contracts = graph_tables(spark, sf_dir)
    return og.check_edges(edges, ports, vertices, contracts)


@register("producer_counts", f"WITH {TABLES} SELECT * FROM pc")
def producer_counts(spark, sf_dir):
    _, _, ports, edges, _ = graph_tables(spark, sf_dir)
    return og.producer_counts(edges, ports)


@register(
    "vertex_feeding",
    f"""WITH {TABLES} SELECT graph_id, vertex, min(producers) AS fewest, max(producers) AS most,
    max(producers) = 0 OR (min(producers) = 1 AND max(producers) = 1) AS sound FROM pc GROUP BY ALL""",
)
def vertex_feeding(spark, sf_dir):
    _, _, ports, edges, _ = graph_tables(spark, sf_dir)
    return og.vertex_feeding(edges, ports)


@register("duplicate_port_owners", f"WITH {TABLES} SELECT graph_id, port, owners FROM ow WHERE owners > 1")
def duplicate_port_owners(spark, sf_dir):
    return og.duplicate_port_owners(graph_tables(spark, sf_dir)[2])


@register("topological_levels", f"WITH {LEVELS} SELECT graph_id, vertex, level FROM lv")
def topological_levels(spark, sf_dir):
    vertices, _, resolved = links(spark, sf_dir)
    return og.levels(vertices, resolved)


@register(
    "graph_sinks",
    f"""WITH {TABLES}, s AS (SELECT graph_id, vertex FROM v WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.graph_id = v.graph_id AND source = vertex))
    SELECT b.graph_id, count(vertex) AS sinks, count(vertex) = 1 AS sound FROM b LEFT JOIN s USING (graph_id) GROUP BY ALL""",
)
def graph_sinks(spark, sf_dir):
    graphs, _, _, _, _ = graph_tables(spark, sf_dir)
    vertices, _, resolved = links(spark, sf_dir)
    found = graphs.join(og.sinks(vertices, resolved), "graph_id", "left")
    return found.groupBy("graph_id").agg(
        F.count("vertex").alias("sinks"), (F.count("vertex") == 1).alias("sound")
    )


@register(
    "graph_roots",
    f"WITH {TABLES} SELECT graph_id, vertex FROM v WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.graph_id = v.graph_id AND target = vertex)",
)
def graph_roots(spark, sf_dir):
    vertices, _, resolved = links(spark, sf_dir)
    return og.roots(vertices, resolved)


@register(
    "audit_graphs",
    f"""WITH {LEVELS}, fe AS (SELECT graph_id, arg_min(error, (source, port)) AS error FROM ce WHERE error IS NOT NULL GROUP BY graph_id),
    fd AS (SELECT graph_id, vertex, min(producers) AS lo, max(producers) AS hi FROM pc GROUP BY ALL),
    sk AS (SELECT graph_id, vertex FROM v WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.graph_id = v.graph_id AND source = vertex)),
    r AS (SELECT graph_id, CASE WHEN EXISTS (SELECT 1 FROM ow WHERE ow.graph_id = b.graph_id AND owners > 1) THEN 'duplicate port ownership'
      WHEN fe.error IS NOT NULL THEN fe.error
      WHEN EXISTS (SELECT 1 FROM fd WHERE fd.graph_id = b.graph_id AND hi > 1) THEN 'port with several producers'
      WHEN EXISTS (SELECT 1 FROM fd WHERE fd.graph_id = b.graph_id AND NOT (hi = 0 OR (lo = 1 AND hi = 1))) THEN 'half-fed vertex'
      WHEN EXISTS (SELECT 1 FROM lv WHERE lv.graph_id = b.graph_id AND level IS NULL) THEN 'cycle'
      WHEN (SELECT count(*) FROM sk WHERE sk.graph_id = b.graph_id) <> 1 THEN 'not exactly one sink' END AS error
      FROM b LEFT JOIN fe USING (graph_id))
    SELECT graph_id, error, CASE WHEN error IS NULL THEN (SELECT min(vertex) FROM sk WHERE sk.graph_id = r.graph_id) END AS sink FROM r""",
)
def audit_graphs(spark, sf_dir):
    return og.audit_graphs(*graph_tables(spark, sf_dir))


@register(
    "pending_dependencies",
    f"""WITH {TABLES}, l3 AS (SELECT graph_id, source, port, target FROM li WHERE target IS NOT NULL),
    d AS (SELECT graph_id, f AS vertex FROM b)
    SELECT graph_id, vertex, (SELECT count(*) FROM l3 WHERE l3.graph_id = v.graph_id AND target = vertex AND source <> (SELECT f FROM b WHERE b.graph_id = l3.graph_id)) AS pending,
      NOT EXISTS (SELECT 1 FROM l3 WHERE l3.graph_id = v.graph_id AND target = vertex AND source <> (SELECT f FROM b WHERE b.graph_id = l3.graph_id)) AS ready
    FROM v WHERE (graph_id, vertex) NOT IN (SELECT graph_id, vertex FROM d)""",
)
def pending_dependencies(spark, sf_dir):
    """After the first vertex of every graph has completed."""
    vertices, _, resolved = links(spark, sf_dir)
    completed = vertices.groupBy("graph_id").agg(F.min("vertex").alias("vertex"))
    return og.pending_counts(vertices, resolved, completed)


@register(
    "fan_out_outputs",
    f"""WITH {TABLES} SELECT li.graph_id, source, target, port, l_quantity AS payload FROM li JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity
    FROM lineitem GROUP BY ALL) ON l_orderkey = graph_id AND l_linenumber = source WHERE target IS NOT NULL""",
)
def fan_out_outputs(spark, sf_dir):
    _, _, resolved = links(spark, sf_dir)
    outputs = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("bigint").alias("vertex")
    ).agg(F.max("l_quantity").alias("payload"))
    return og.fan_out(outputs, resolved)


@register(
    "root_port_inputs",
    f"""WITH {TABLES} SELECT v.graph_id, v.vertex, pt.port, o_totalprice AS payload FROM v JOIN pt ON pt.graph_id = v.graph_id AND pt.vertex = v.vertex
    JOIN orders ON o_orderkey = v.graph_id WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.graph_id = v.graph_id AND target = v.vertex)""",
)
def root_port_inputs(spark, sf_dir):
    vertices, ports, resolved = links(spark, sf_dir)
    inputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_totalprice").alias("payload"))
    return og.root_inputs(inputs, vertices, ports, resolved)


DELIVERED = """d AS (SELECT l_suppkey AS graph_id, l_linenumber AS vertex, l_orderkey AS step, l_partkey % 2 AS ordinal, max(l_quantity) AS payload,
  max(l_returnflag) AS address FROM lineitem GROUP BY ALL)"""


def deliveries(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("graph_id"),
        F.col("l_linenumber").alias("vertex"),
        F.col("l_orderkey").alias("step"),
        (F.col("l_partkey") % 2).alias("ordinal"),
    ).agg(F.max("l_quantity").alias("payload"), F.max("l_returnflag").alias("address"))


@register(
    "two_port_fan_in",
    f"""WITH {DELIVERED} SELECT graph_id, vertex, step, a.payload AS p1, b.payload AS p2, CASE WHEN a.address <> b.address THEN 'ports name different receivers' END AS error
    FROM (SELECT * FROM d WHERE ordinal = 0) a JOIN (SELECT * FROM d WHERE ordinal = 1) b USING (graph_id, vertex, step)""",
)
def two_port_fan_in(spark, sf_dir):
    return og.fan_in(deliveries(spark, sf_dir), "payload", "address")


@register(
    "fan_in_control_match",
    f"""WITH {DELIVERED}, c AS (SELECT *, CASE WHEN vertex = 1 THEN 'NaN'::DOUBLE WHEN vertex = 2 THEN CASE WHEN ordinal = 0 THEN 0.0 ELSE -0.0 END ELSE payload END AS loss FROM d)
    SELECT graph_id, vertex, step, CASE WHEN vertex = 2 OR a.address <> b.address OR (vertex > 2 AND a.loss <> b.loss) THEN 'control payloads disagree' END AS error
    FROM (SELECT * FROM c WHERE ordinal = 0) a JOIN (SELECT * FROM c WHERE ordinal = 1) b USING (graph_id, vertex, step)""",
)
def fan_in_control_match(spark, sf_dir):
    """NaN agrees with NaN, zeros of different sign do not agree."""
    zero = F.col("payload") * F.lit(0.0)
    loss = (
        F.when(F.col("vertex") == 1, F.lit(float("nan")))
        .when(F.col("vertex") == 2, F.when(F.col("ordinal") == 0, zero).otherwise(-zero))
        .otherwise(F.col("payload"))
    )
    messages = deliveries(spark, sf_dir).select(
        "graph_id", "vertex", "step", "ordinal", loss.alias("loss_up"), F.lit(1.0).alias("loss_down"), F.col("address").alias("seed")
    )
    return og.fan_in_control(messages)


@register("graph_snapshot_edges", f"WITH {TABLES} SELECT DISTINCT graph_id, source, target, port FROM li WHERE target IS NOT NULL")
def graph_snapshot_edges(spark, sf_dir):
    vertices, _, resolved = links(spark, sf_dir)
    return og.snapshot(vertices, resolved.unionByName(resolved))[1]


@register("graph_snapshot_nodes", f"WITH {TABLES} SELECT graph_id, vertex FROM v")
def graph_snapshot_nodes(spark, sf_dir):
    vertices, _, resolved = links(spark, sf_dir)
    return og.snapshot(vertices.unionByName(vertices), resolved)[0].select("graph_id", "vertex")


# Raw lines as drawn graphs: ids repeat, edges dangle, loop or miss their port.
RAW = """rv AS (SELECT l_orderkey AS graph_id, l_linenumber::BIGINT AS vertex FROM lineitem),
  rp AS (SELECT DISTINCT graph_id, vertex AS port, vertex FROM rv),
  re AS (SELECT DISTINCT l_orderkey AS graph_id, l_linenumber::BIGINT AS source, 1 + l_partkey % 7 AS target, 1 + l_suppkey % 7 AS port FROM lineitem)"""


def raw_graphs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    g = F.col("l_orderkey").alias("graph_id")
    vertices = rows.select(g, F.col("l_linenumber").cast("bigint").alias("vertex"))
    ports = vertices.distinct().select("graph_id", F.col("vertex").alias("port"), "vertex")
    drawn = rows.select(
        g, F.col("l_linenumber").cast("bigint").alias("source"), (F.col("l_partkey") % 7 + 1).alias("target"), (F.col("l_suppkey") % 7 + 1).alias("port")
    )
    return vertices, ports, drawn


@register(
    "merged_graph_checks",
    f"""WITH {RAW}, k AS (SELECT DISTINCT graph_id, vertex FROM rv),
    j AS (SELECT re.*, s.vertex AS sv, t.vertex AS tv, rp.vertex AS owner FROM re LEFT JOIN k s ON s.graph_id = re.graph_id AND s.vertex = source
      LEFT JOIN k t ON t.graph_id = re.graph_id AND t.vertex = target LEFT JOIN rp ON rp.graph_id = re.graph_id AND rp.port = re.port),
    e AS (SELECT graph_id, source AS at, CASE WHEN sv IS NULL THEN 'unknown source' WHEN tv IS NULL THEN 'unknown target' WHEN source = target THEN 'self edge'
      WHEN owner IS DISTINCT FROM target THEN 'unowned port' END AS error FROM j)
    SELECT graph_id, vertex AS at, 'duplicate id' AS error FROM rv GROUP BY graph_id, vertex HAVING count(*) > 1
    UNION ALL SELECT * FROM e WHERE error IS NOT NULL""",
)
def merged_graph_checks(spark, sf_dir):
    return og.merged_graph_faults(*raw_graphs(spark, sf_dir))


def nested_tables(spark, sf_dir):
    """Chains of line numbers; a line whose part ends in 3 opens the order a few keys on."""
    base = lines(spark, sf_dir)
    vertices = base.select("graph_id", F.explode("vs").alias("vertex"))
    opened = table(spark, sf_dir, "lineitem").filter("l_partkey % 10 = 3").groupBy(
        F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("bigint").alias("vertex")
    ).agg((F.min(F.col("l_orderkey") + 1 + F.col("l_suppkey") % 3)).alias("nested"))
    vertices = vertices.join(opened, ["graph_id", "vertex"], "left")
    ports = base.select("graph_id", F.explode("vs").alias("vertex")).withColumn("port", F.col("vertex"))
    pairs = F.when(
        F.size("vs") > 1,
        F.transform(
            F.sequence(F.lit(1), F.size("vs") - 1),
            lambda i: F.struct(F.element_at("vs", i).alias("source"), F.element_at("vs", i + 1).alias("target")),
        ),
    )
    drawn = base.select("graph_id", F.explode(pairs).alias("e")).select(
        "graph_id", "e.source", "e.target", F.col("e.target").alias("port")
    )
    graphs = base.select("graph_id", (F.col("graph_id") % 9 != 0).alias("finalized"))
    return graphs, vertices, ports, drawn


@register("merge_nested_graphs")
def merge_nested_graphs(spark, sf_dir):
    graphs, vertices, ports, drawn = nested_tables(spark, sf_dir)
    return og.merge_nested(graphs, vertices, ports, drawn, graphs.select("graph_id"))[1]


@register(
    "merge_nested_nodes",
    """WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey AS g, l_linenumber::BIGINT AS vertex FROM lineitem),
    o AS (SELECT l_orderkey AS g, l_linenumber::BIGINT AS vertex, min(l_orderkey + 1 + l_suppkey % 3) AS nested FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY ALL),
    u AS (SELECT DISTINCT g AS nested FROM v WHERE g % 9 <> 0),
    i AS (SELECT DISTINCT g AS top, g, []::BIGINT[] AS path FROM v
      UNION ALL SELECT top, o.nested, list_append(path, vertex) FROM i JOIN o USING (g) JOIN u ON u.nested = o.nested WHERE len(path) < 16),
    c AS (SELECT top, i.g, path, vertex FROM i JOIN v USING (g)),
    m AS (SELECT top, max(vertex) FILTER (len(path) = 0) AS base FROM c GROUP BY top),
    r AS (SELECT *, row_number() OVER (PARTITION BY top, len(path) = 0 ORDER BY path, vertex) AS rn FROM c)
    SELECT top, CASE WHEN len(path) = 0 THEN r.vertex ELSE base + rn END AS vertex, array_to_string(path, '/') AS path, g AS graph_id, r.vertex AS local
    FROM r JOIN m USING (top)""",
)
def merge_nested_nodes(spark, sf_dir):
    graphs, vertices, ports, drawn = nested_tables(spark, sf_dir)
    nodes = og.merge_nested(graphs, vertices, ports, drawn, graphs.select("graph_id"))[0]
    return nodes.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@register(
    "short_type_label",
    "SELECT p_partkey, 'Warp<' || p_type || '<f32>, ' || p_brand || '>' AS label FROM part",
)
def short_type_label(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    label = F.concat(F.lit(" core::ops::Warp<a::b::"), "p_type", F.lit("<std::f32>, x::"), "p_brand", F.lit("> "))
    return rows.select("p_partkey", short_label(label).alias("label"))


@register(
    "boundary_label",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_brand || '<u8, f32>' END AS label FROM part",
)
def boundary_label_query(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    label = (
        F.when(kind == 0, F.concat(F.lit("Cell<"), "p_brand", F.lit(", x>")))
        .when(kind == 1, F.concat(F.lit("Warp<a::B<u8, C<u16, D>>, m::"), "p_brand", F.lit("<u8, f32>>")))
        .otherwise(F.concat(F.lit("Warp<"), "p_type", F.lit(",z::"), "p_brand", F.lit("<u8, f32>>")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", boundary_label(label).alias("label"))


@register(
    "expand_lanes_edges",
    f"""WITH {TABLES}, two AS (SELECT graph_id, vertex, max(port) FILTER (ordinal = 1) AS second FROM pt GROUP BY ALL),
    sh AS (SELECT graph_id, port AS p FROM pt GROUP BY ALL HAVING count(*) > 1)
    SELECT li.graph_id, CASE WHEN li.port = t.second AND s.second IS NOT NULL THEN s.second ELSE source END AS source,
      CASE WHEN li.port = t.second THEN t.second ELSE target END AS target, li.port,
      CASE WHEN (li.graph_id, li.port) IN (SELECT (graph_id, p) FROM sh) THEN 'port has several owners' END AS error FROM li
      JOIN two t ON t.graph_id = li.graph_id AND t.vertex = target JOIN two s ON s.graph_id = li.graph_id AND s.vertex = source""",
)
def expand_lanes_edges(spark, sf_dir):
    vertices, ports, resolved = links(spark, sf_dir)
    listed = ports.groupBy("graph_id", "vertex").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "port"))), lambda p: p["port"]).alias("ports")
    )
    return og.expand_lanes(listed, resolved)[1]


@register(
    "expand_lanes_nodes",
    f"""WITH {TABLES} SELECT graph_id, CASE WHEN ordinal = 1 THEN port ELSE vertex END AS vertex, port,
    CASE WHEN count(*) OVER (PARTITION BY graph_id, port) > 1 THEN 'port has several owners' END AS error FROM pt""",
)
def expand_lanes_nodes(spark, sf_dir):
    _, ports, resolved = links(spark, sf_dir)
    listed = ports.groupBy("graph_id", "vertex").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "port"))), lambda p: p["port"]).alias("ports")
    )
    nodes = og.expand_lanes(listed, resolved)[0]
    return nodes.select("graph_id", "vertex", F.explode("ports").alias("port"), "error")


@register(
    "linear_chain_test",
    f"""WITH {TABLES}, x AS (SELECT graph_id, vertex, lead(vertex) OVER (PARTITION BY graph_id ORDER BY vertex) AS nxt FROM v),
    l3 AS (SELECT graph_id, source, count(*) AS n, min(target) AS t FROM li WHERE target IS NOT NULL GROUP BY ALL)
    SELECT x.graph_id, bool_and(nxt IS NULL OR coalesce(n = 1 AND t = nxt, false)) AS linear FROM x LEFT JOIN l3 ON l3.graph_id = x.graph_id AND source = vertex GROUP BY x.graph_id""",
)
def linear_chain_test(spark, sf_dir):
    vertices, _, resolved = links(spark, sf_dir)
    return og.linear_chains(vertices, resolved)


@register(
    "broadcast_losses",
    f"WITH {TABLES} SELECT pt.graph_id, vertex, port, o_totalprice AS loss_up FROM pt JOIN orders ON o_orderkey = pt.graph_id",
)
def broadcast_losses(spark, sf_dir):
    losses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_totalprice").alias("loss_up"))
    return og.broadcast_losses(losses, graph_tables(spark, sf_dir)[2])


@register(
    "route_loss_to_nested",
    """WITH o AS (SELECT l_orderkey AS graph_id, l_linenumber::BIGINT AS vertex, min(l_orderkey + 1 + l_suppkey % 3) AS nested FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY ALL),
    q AS (SELECT l_orderkey AS graph_id, l_linenumber::BIGINT AS vertex, max(l_extendedprice) AS loss FROM lineitem GROUP BY ALL)
    SELECT nested, graph_id, vertex, loss, o_orderstatus = 'F' AS frozen FROM q JOIN o USING (graph_id, vertex) LEFT JOIN orders ON o_orderkey = nested""",
)
def route_loss_to_nested(spark, sf_dir):
    _, vertices, _, _ = nested_tables(spark, sf_dir)
    losses = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("bigint").alias("vertex")
    ).agg(F.max("l_extendedprice").alias("loss"))
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), (F.col("o_orderstatus") == "F").alias("frozen"))
    return og.route_to_nested(losses, vertices, state)
