"""Near-duplicate join on runs of words by a MinHash LSH forest.

Every text is reduced to the set of hashes of its five-word runs; texts with
equal sets are one class from the start. A set has ``TREES`` signatures of
``DEPTH`` minima each, read as paths of prefix tries. Sets that share a trie
node are candidates. The join starts with whole signatures and shortens the
prefix: after each step the recall is estimated from what was found (a pair of
likeness s shares a node of depth m with probability 1 - (1 - s^m)^trees), and
at the depth where that probability reaches the target for the threshold itself
it ends in any case.

Candidates whose signatures agree enough form groups, and inside a group all
pairs are compared on their exact sets. Groups are cut into blocks and a task
compares two blocks; it returns link counts and the edges of a spanning forest,
so no table of pairs exists, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.components import components
from tensorloom.llm.shingles import RUN, mixed, run_sets
from tensorloom.llm.texts import BLOCK_BYTES, as_bytes, shared_folder, slices
from tensorloom.session import durable

TREES, DEPTH = 32, 7
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
#: Over five standard deviations of the agreement of 224 minima below the threshold.
AGREEMENT = 0.65
NODE_BLOCK = 2048
SET_BLOCK = 256

_U = np.uint64


def _salts(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, set_key, signature per row; the latter two NULL for texts without words."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("data"))
    return slim.mapInArrow(_sign(run), "doc_id bigint, set_key binary, signature binary")


def _sign(run: int):
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])
    salts = _salts(TREES * DEPTH)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", BLOCK_BYTES):
            sets = list(run_sets(batch.column("data"), run))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            full = [s for s in sets if len(s)]
            marks = np.empty((len(full), len(salts)), np.uint16)
            if full:
                values, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                for k, salt in enumerate(salts):
                    marks[:, k] = np.minimum.reduceat(values * salt, starts) >> _U(8) & _U(0xFFFF)
            rows = iter(marks)
            found = [next(rows).tobytes() if key else None for key in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], schema=schema)

    return sign


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _paths(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per tree: the trie node that a signature reaches at this depth."""
        for batch in batches:
            marks = _matrix(batch.column("signature")).reshape(-1, TREES, DEPTH).astype(np.uint64)
            node = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), marks.shape[:2])
            for k in range(depth):
                node = mixed(node * _U(0x9E3779B97F4A7C15) + marks[:, :, k])
            reps = np.repeat(batch.column("rep").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), pa.array(reps)], names=["node", "rep"])

    return run


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables in which every key of a sorted stream is complete, with the places where keys begin."""
    held: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        change = np.ones(table.num_rows, bool)
        change[1:] = False
        for key in keys:
            values = table[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = begins(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
            held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, begins(table)


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between signatures of a node that agree; in a node, only those that connect."""
    for table, starts in whole_runs(batches, ["node", "pair"]):
        reps, marks = table["rep"].to_numpy(), _matrix(table["signature"].combine_chunks())
        first = np.repeat(starts, np.diff([*starts, len(reps)]))
        likeness = (marks == marks[first]).mean(axis=1)
        near = likeness >= AGREEMENT
        near[starts] = False
        out = [(reps[first[near]], reps[near], likeness[near])]
        strays = np.ones(len(reps), bool)
        strays[near] = False
        strays[starts] = False
        for a in np.unique(np.searchsorted(starts, np.flatnonzero(strays), "right") - 1):
            low, high = starts[a], starts[a + 1] if a + 1 < len(starts) else len(reps)
            group, home = np.arange(low, high), np.zeros(high - low, np.int64)
            away = np.flatnonzero(strays[low:high])
            home[away] = away
            for i in away:
                others = np.flatnonzero(home != home[i])
                like = (marks[group[others]] == marks[group[i]]).mean(axis=1)
                hit = like >= AGREEMENT
                if hit.any():
                    out.append((np.full(hit.sum(), reps[group[i]]), reps[group[others[hit]]], like[hit]))
                    home[np.isin(home, home[others[hit]])] = home[i]
        a, b, s = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], names=["a", "b", "likeness"])


def block_pairs(rows: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Deal the members of each key so that every two of them meet in some (key, pair).

    Keys of up to ``size`` members are one pair. Larger ones are cut into blocks
    of about ``size`` by digest; a member goes to the pairs of its own block
    with every other. ``side`` is 0 for a block that is alone, else 1 or 2 for
    the lower and higher block. Keys of one member are left out.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / size).cast("int")
    dealt = rows.join(counts, key).withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return (
        dealt.withColumn("_other", other)
        .withColumn("pair", low.cast("bigint") * F.col("_blocks") + high)
        .withColumn("side", F.when(low == high, 0).when(F.col("_own") == low, 1).otherwise(2))
        .drop("_n", "_blocks", "_own", "_other")
    )


def floor_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix that reaches the target for pairs at the threshold itself."""
    return max((m for m in range(1, DEPTH + 1) if found_with(threshold, m) >= target), default=1)


def found_with(likeness, depth: int):
    return 1 - (1 - likeness**depth) ** TREES


def candidate_edges(reps: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[DataFrame, int]:
    """Edges (a, b, likeness) that connect candidates, and the depth that was needed."""
    spark, depth, least = reps.sparkSession, DEPTH, floor_depth(threshold, target)
    while True:
        nodes = reps.mapInArrow(_paths(depth), "node bigint, rep bigint")
        shared = block_pairs(nodes, "node", "rep", NODE_BLOCK).join(reps, "rep")
        met = shared.repartition("node", "pair").sortWithinPartitions("node", "pair", "side", "rep")
        folder = shared_folder(spark, "forest")
        met.mapInArrow(_agreeing, "a bigint, b bigint, likeness double").write.parquet(folder)
        edges = spark.read.schema("a bigint, b bigint, likeness double").parquet(folder)
        if depth <= least:
            return edges, depth
        chance = F.lit(1.0) - F.pow(F.lit(1.0) - F.pow(F.least("likeness", F.lit(1.0)), F.lit(float(depth))), F.lit(float(TREES)))
        seen = edges.filter(F.col("likeness") >= threshold).dropDuplicates(["a", "b"])
        found, expected = seen.agg(F.count(F.lit(1)), F.sum(1 / chance)).first()
        if found and found / expected >= target:
            return edges, depth
        depth -= 1


def _sets(run: int):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", BLOCK_BYTES):
            sets = [s.tobytes() for s in run_sets(batch.column("data"), run)]
            columns = [batch.column(n) for n in ("rep", "copies", "component")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=["rep", "copies", "component", "members"])

    return build


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other."""
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    sides = []
    for sets, own in ((left, codes[:cut]), (right, codes[cut:])):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sides.append((rows, own))
    both = np.zeros(len(values), np.int64)
    for _, own in sides:
        both[np.unique(own)] += 1
    dense = np.cumsum(both == 2) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    n = int((both == 2).sum())
    for start in range(0, n, 8192):
        parts = []
        for (rows, own), sets in zip(sides, (left, right)):
            place = dense[own]
            inside = (both[own] == 2) & (place >= start) & (place < start + 8192)
            part = np.zeros((len(sets), min(8192, n - start)), np.float32)
            part[rows[inside], place[inside] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _links(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per two blocks: how many links each member has there, and one linked neighbour that connects it."""
        for table, starts in whole_runs(batches, ["component", "pair"]):
            reps, copies, side = (table[n].to_numpy() for n in ("rep", "copies", "side"))
            members = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
            rows: list[tuple] = []
            for low, high in zip(starts, [*starts[1:], len(reps)]):
                one = np.arange(low, high)
                left, right = (one, one) if side[low] == 0 else (one[side[one] == 1], one[side[one] == 2])
                if not len(left) or not len(right):
                    continue
                sizes = np.array([len(members[i]) for i in one], np.float64)
                both = _overlaps([members[i] for i in left], [members[i] for i in right]).astype(np.float64)
                union = sizes[left - low][:, None] + sizes[right - low][None, :] - both
                linked = both >= threshold * union - 1e-9
                if side[low] == 0:
                    np.fill_diagonal(linked, False)
                for own, others, hits in ((left, right, linked), (right, left, linked.T)):
                    weight = hits @ copies[others]
                    for i in np.flatnonzero(weight):
                        rows.append((reps[own[i]], int(weight[i]), None, None))
                    if side[low] == 0:
                        break
                rows += [(None, None, reps[left[i]], reps[right[j]]) for i, j in _forest(linked, left is right)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in columns], names=["rep", "links", "a", "b"])

    return run


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a bipartite or symmetric link matrix."""
    n = linked.shape[0]
    free = [np.ones(n, bool), np.ones(linked.shape[1], bool)]
    if same:
        free[1] = free[0]
    edges = []
    for root in range(n):
        if not free[0][root]:
            continue
        free[0][root] = False
        todo = [(0, root)]
        while todo:
            half, i = todo.pop()
            row = linked[i] if half == 0 else linked[:, i]
            target = 1 - half if not same else 0
            new = np.flatnonzero(row & free[target])
            free[target][new] = False
            edges += [(i, j) if half == 0 else (j, i) for j in new.tolist()]
            todo += [(target, j) for j in new.tolist()]
    return edges


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
    threshold: float = THRESHOLD, target: float = TARGET_RECALL,
) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the class), n_links.

    Two texts are linked if the Jaccard likeness of their sets of ``run``-word
    hashes is at least ``threshold``; a text of fewer words is one run. Classes
    are the connected components of all links. ``n_links`` counts the other
    rows that a row is linked to, copies included. Words are runs without ASCII
    white space, compared as they are. Texts without words, also NULL, have no
    links and are classes of their own; so are rows with a NULL id (class
    NULL). Rows that repeat an id count as copies or links like others.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "signatures")
    signatures(docs, id_col=id_col, text_col=text_col, run=run).write.parquet(folder)
    marks = spark.read.schema("doc_id bigint, set_key binary, signature binary").parquet(folder)
    known = marks.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    reps = durable(
        known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("signature").alias("signature"))
        .groupBy("rep").agg(F.min_by("signature", "set_key").alias("signature"), F.min_by("copies", "set_key").alias("copies"), F.min("set_key").alias("set_key"))
    )
    edges, _ = candidate_edges(reps.select("rep", "signature"), threshold, target)
    groups = components(edges).withColumnRenamed("node", "rep")
    wanted = groups.join(reps.select("rep", "copies", "set_key"), "rep")
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), as_bytes(F.col(f"`{text_col}`")).alias("data"))
    sets = wanted.join(texts, "rep").select("rep", "copies", "component", "data").mapInArrow(
        _sets(run), "rep bigint, copies bigint, component bigint, members binary"
    ).dropDuplicates(["rep"])
    dealt = block_pairs(sets, "component", "rep", SET_BLOCK).repartition("component", "pair").sortWithinPartitions("component", "pair", "side", "rep")
    found = durable(dealt.mapInArrow(_links(threshold), "rep bigint, links bigint, a bigint, b bigint"))
    links = found.filter(F.col("rep").isNotNull()).groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.filter(F.col("a").isNotNull()).select("a", "b")).select(F.col("node").alias("rep"), "component")
    about = reps.select("set_key", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    key = F.when(F.col("doc_id").isNotNull(), F.col("set_key"))
    return marks.select("doc_id", key.alias("set_key")).join(about, "set_key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
