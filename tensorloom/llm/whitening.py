"""Whitening of embeddings by refined principal components.

Entries become whole numbers, so the covariance is exact: every partition shifts
its vectors by one whole vector near the mean and adds up products in integers.
Eigenvectors come from a 32-bit decomposition and are corrected by Ogita-Aishima
iterations, matrix products in higher precision that converge quadratically.
Where eigenvalues lie so close together that an iteration cannot tell their
vectors apart, the small problem within that cluster is solved by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.texts import shared_folder

SCALE = 256
MOST_COMPONENTS = 4
EXACT = 1 << 53
TILE = 256
BATCH_NUMBERS = 1 << 20
ROUNDS = 12
CLOSE = 1e-3


# -- refinement -----------------------------------------------------------------


def _clusters(values: np.ndarray, tolerance: float) -> list[slice]:
    """Runs of neighbouring eigenvalues (rising) whose gaps are within the tolerance."""
    cuts = np.flatnonzero(np.diff(values) > tolerance) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Newton-Schulz steps towards the nearest orthonormal columns."""
    for _ in range(3):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def refine(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of a symmetric matrix in its own precision.

    A 32-bit decomposition starts it, doubles follow until they settle, and the
    last steps run in the precision of the matrix where that is higher. One
    iteration takes ``R = I - X'X`` and ``S = X'AX``, reads eigenvalues off their
    diagonals and moves every vector by ``(S_ij + e_j R_ij) / (e_j - e_i)`` along
    the others; within a cluster the move is ``R_ij / 2``, and the cluster's own
    matrix is decomposed instead, after its common part is taken off, which
    widens the gaps.
    """
    size = len(matrix)
    norm = matrix.dtype.type(np.abs(matrix).max()) if size else 0
    if norm == 0:
        return np.zeros(size, matrix.dtype), np.eye(size, dtype=matrix.dtype)
    work = matrix / norm
    x = np.linalg.eigh(work.astype(np.float32))[1]
    for kind in dict.fromkeys([np.dtype(np.float64), matrix.dtype]):
        x = _iterate(work.astype(kind), x.astype(kind), rounds)
    values = np.diag(x.T @ (work @ x))
    order = np.argsort(values, kind="stable")
    return values[order] * norm, x[:, order]


def _iterate(work: np.ndarray, x: np.ndarray, rounds: int) -> np.ndarray:
    """Ogita-Aishima steps until vectors no longer move beyond rounding."""
    size, last = len(work), np.inf
    unit = float(np.finfo(work.dtype).eps) * size
    x = _orthonormal(x)
    for _ in range(rounds):
        r = np.eye(size, dtype=work.dtype) - x.T @ x
        s = x.T @ (work @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        wrong = s + values[None, :] * r
        np.fill_diagonal(wrong, 0)
        # Vectors mix by error over gap: gaps have to exceed the error by far.
        close = [c for c in _clusters(values, max(float(np.abs(wrong).max()) / CLOSE, unit)) if c.stop - c.start > 1]
        shared = np.eye(size, dtype=bool)
        for c in close:
            shared[c, c] = True
        gaps = np.where(shared, 1, values[None, :] - values[:, None])
        move = np.where(shared, r / 2, wrong / gaps)
        x = _orthonormal(x + x @ move)
        change = float(np.abs(move).max())
        for c in close:
            turn = _within(work, x[:, c], unit)
            x[:, c] = x[:, c] @ turn
            change = max(change, float(np.abs(turn - np.round(turn)).max()))
        if change <= unit or last <= change < CLOSE:
            break
        last = change
    return x


def _within(work: np.ndarray, x: np.ndarray, unit: float) -> np.ndarray:
    """Rotation inside a cluster, from its own matrix without the common part."""
    small = x.T @ (work @ x)
    middle = np.trace(small) / len(small)
    small = small - middle * np.eye(len(small), dtype=small.dtype)
    small = (small + small.T) / 2
    if float(np.abs(small).max()) <= unit:
        return np.eye(len(small), dtype=small.dtype)
    return refine(small)[1] if len(small) < len(work) else _jacobi(small, unit)


def _jacobi(small: np.ndarray, unit: float) -> np.ndarray:
    """Vectors of a cluster that fills the whole matrix, by plane rotations."""
    a, v = small.copy(), np.eye(len(small), dtype=small.dtype)
    for _ in range(30):
        if np.abs(a - np.diag(np.diag(a))).max() <= unit * np.abs(a).max():
            break
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j] == 0:
                    continue
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(1 + t * t))
                c = 1 / np.sqrt(1 + t * t)
                turn = np.array([[c, t * c], [-t * c, c]], dtype=a.dtype)
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                v[:, [i, j]] = v[:, [i, j]] @ turn
    return v


# -- sums over the corpus -------------------------------------------------------


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(-1, size)


def _parts(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Rows as matrices of bounded size."""
    step = max(1, BATCH_NUMBERS // max(1, size))
    for batch in batches:
        column = batch.column(0)
        for start in range(0, len(column), step):
            yield _matrix(column.slice(start, step), size)


def _products(z: np.ndarray) -> np.ndarray:
    """Exact ``z'z`` as whole numbers: float products while they are exact, else objects."""
    largest = int(np.abs(z).max(initial=0))
    if largest * largest < EXACT:
        step = max(1, (EXACT - 1) // max(1, largest * largest))
        total = np.zeros((z.shape[1],) * 2, object)
        for start in range(0, len(z), step):
            part = z[start : start + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
        return total
    wide = z.astype(object)
    return wide.T @ wide


def _spread(total: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Whole numbers of any size by tiles of rows, as decimal text."""
    rows = total.reshape(len(total), -1)
    for start in range(0, len(rows), TILE):
        text = "\n".join(" ".join(map(str, row)) for row in rows[start : start + TILE])
        yield pa.RecordBatch.from_pydict({"kind": [kind], "tile": [start], "numbers": [text]})


def _read(text: str) -> np.ndarray:
    return np.array([[int(x) for x in line.split()] for line in text.split("\n")], object)


_PARTIAL = "kind string, tile bigint, numbers string"


def _added(partials: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the partial matrices, tile by tile; the driver gets one matrix in the end.

    Each tile's partials stream through a task that holds one sum.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, numbers = (row["kind"], row["tile"]), _read(row["numbers"])
                sums[key] = sums[key] + numbers if key in sums else numbers
        for (kind, tile), numbers in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"kind": [kind], "tile": [tile], "numbers": ["\n".join(" ".join(map(str, row)) for row in numbers)]}
            )

    # Some partials are added before the others, so no task meets one from every task of the scan.
    few = partials.withColumn("_near", F.spark_partition_id() % 16)
    found = few.repartition("tile", "_near").drop("_near").mapInArrow(add, _PARTIAL).repartition("tile").mapInArrow(add, _PARTIAL)
    out: dict[str, list] = {}
    for row in found.orderBy("kind", "tile").collect():
        out.setdefault(row["kind"], []).append(_read(row["numbers"]))
    return {kind: np.concatenate(parts) for kind, parts in out.items()}


def _sums(fit: DataFrame, size: int) -> list[int]:
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for z in _parts(batches, size):
            part = (z if np.abs(z).max(initial=0) < 1 << 40 else z.astype(object)).sum(0).astype(object)
            total = part if total is None else total + part
        if total is not None:
            yield from _spread(total, "sum")

    return [int(x) for x in _added(fit.mapInArrow(partial, _PARTIAL))["sum"][:, 0]]


def _covariance(fit: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """``n * n * V`` as whole numbers.

    Vectors are centred by the whole vector nearest to the mean before they are
    multiplied; what the mean lies beside it is taken off exactly afterwards.
    """
    middle = [round(Fraction(s, n)) for s in sums]
    narrow = np.array(middle, np.int64)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _parts(batches, size):
            far = np.abs(x).max(initial=0) >= 1 << 62
            part = _products(x.astype(object) - middle if far else x - narrow)
            total = part if total is None else total + part
        if total is not None:
            yield from _spread(total, "product")

    products = _added(fit.mapInArrow(partial, _PARTIAL))["product"]
    rest = np.array([s - n * m for s, m in zip(sums, middle)], object)
    return products * n - np.outer(rest, rest)


def _extended(whole: np.ndarray, divisor: int) -> np.ndarray:
    """Quotients of whole numbers in extended precision, from a high and a low part."""
    flat = []
    for v in whole.ravel().tolist():
        high = float(Fraction(v, divisor))
        flat.append(np.longdouble(high) + np.longdouble(float(Fraction(v, divisor) - Fraction(high))))
    return np.array(flat, np.longdouble).reshape(whole.shape)


# -- operator -------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a fit list gives: its size, sums, mean, leading components and scales."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Ids (``vec_id``) with vectors as whole numbers (``x``), without faulty ones.

    Rows whose vector is NULL or holds a NULL, NaN or infinite entry are left out.
    Entries beyond 64 bits after scaling are faulty as well.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    slim = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("_v")).filter(F.col("_v").isNotNull())
    sound = F.forall("_v", lambda c: F.coalesce(F.abs(c) < F.lit(float(1 << 63) / SCALE), F.lit(False)))
    scaled = F.transform("_v", lambda c: F.floor(c * F.lit(float(SCALE))))
    return slim.filter(sound).select("vec_id", scaled.alias("x"))


def fit_whitening(vectors: DataFrame, most: int = MOST_COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors; None where there is no vector with an entry.

    The length that most distinct vectors have counts (of equally many, the larger).
    Components whose eigenvalue is not above rounding are left out.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark, "whitening")
    # A vector that many rows share is collapsed before the shuffle.
    vectors.select("x").filter(F.size("x") > 0).distinct().write.parquet(folder)
    distinct = spark.read.parquet(folder)
    counts = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    if not counts:
        return None
    size, n = counts[0]["size"], counts[0]["count"]
    fit = distinct.filter(F.size("x") == size)
    sums = _sums(fit, size)
    whole = _covariance(fit, size, n, sums)
    matrix = _extended(whole, n * n)
    trace = Fraction(int(np.trace(whole)), n * n)
    values, vectors_ = refine(matrix)
    values, vectors_ = values[::-1][:most], vectors_[:, ::-1][:, :most]
    keep = values > float(trace) * size * np.finfo(np.float64).eps
    values, vectors_ = values[keep], vectors_[:, keep]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    found = Whitening(n, sums, mean, vectors_.astype(np.float64), values.astype(np.float64), float(trace), 0.0)
    error = _identity_error(fit, size, found) if len(values) else 0.0
    return Whitening(**(found.__dict__ | {"identity_error": error}))


def _projected(x: np.ndarray, found: Whitening) -> np.ndarray:
    return ((x - found.mean) @ found.components) / np.sqrt(found.values)


def _identity_error(fit: DataFrame, size: int, found: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    k = len(found.values)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for x in _parts(batches, size):
            w = _projected(x, found)
            total, first = total + w.T @ w, first + w.sum(0)
        yield pa.RecordBatch.from_pydict({"i": [*range(k * k + k)], "v": [*total.ravel(), *first]})

    # At most 20 sums from a task for four components.
    sums = fit.mapInArrow(partial, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([row["v"] for row in sums]) / found.n
    covariance = flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :])
    return float(np.abs(covariance - np.eye(k)).max())


OUTPUT = "vec_id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(
    embeddings: DataFrame, most: int = MOST_COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Every sound row along the leading components of the distinct vectors.

    Per row and component: ``vec_id``, ``component`` (from 1, by falling
    eigenvalue), ``n`` distinct vectors, ``deviation`` (sum of ``(n x - S)^2``,
    exact; NULL where it does not fit 64 bits), ``whitened``, ``explained``,
    ``identity_error``.

    Rows with a NULL vector or a NULL, NaN or infinite entry, empty vectors, and
    vectors of another length than most distinct ones have, are left out. Rows
    with a NULL id stay; repeated rows stay and count once in the fit. Fewer
    distinct vectors than components give fewer components, none where all are
    equal. An empty table gives no rows. Other columns are ignored, whatever
    their names. Where eigenvalues are equal, any orthonormal vectors of their
    space are given, the same for all rows.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = OUTPUT.format(id=kind)
    vectors = whole_vectors(embeddings, id_col, vector_col)
    found = fit_whitening(vectors, most)
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    size, k, n = len(found.mean), len(found.values), found.n
    sums = np.array(found.sums, object)
    explained = [float(v) / found.trace for v in found.values]
    # (n x - S)^2 summed over the dimensions fits 64 bits while each term is below this.
    fits = int((float(1 << 62) / size) ** 0.5)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_NUMBERS // size)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = _matrix(part.column("x"), size)
                m = len(x)
                if n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max()) < fits:
                    d = n * x - sums.astype(np.int64)
                    deviation = (d * d).sum(1).tolist()
                else:
                    d = n * x.astype(object) - sums
                    deviation = [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(at)),
                        pa.array(_projected(x, found).ravel()), pa.array(explained * m, pa.float64()),
                        pa.array(np.full(m * k, found.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.filter(F.size("x") == size).mapInArrow(rows, schema)
