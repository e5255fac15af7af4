"""Parameter-table training operators: zeroth-order and first-order steps.

Parameters live in a long table ``(param_id, value)``, with an ``instance``
column where many models share it. A softmax head of ``width`` inputs and
``classes`` outputs keeps weight (c, k) at ``c * width + k`` and bias c at
``classes * width + c``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import tensor_expr as te
from tensorloom.functions.cols import first_failure, let
from tensorloom.functions.draws import sign
from tensorloom.plans.scans import AT, MARKS, last_known, lay_out, neighbours, running_min, running_total

# Perturbation size, learning rate and derivative bound of a step.
EPSILON = 1e-3
LEARNING_RATE = 1e-4
CLIP = 10.0

# Numbers of a head in one tile (8 MB).
TILE = 1 << 20


# -- zeroth-order steps ------------------------------------------------------


def directions(params: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Add the +-1 ``direction`` of every parameter."""
    return params.withColumn("direction", sign(seed, *(keys or ("param_id",))))


def perturb_up(params: DataFrame, sessions: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Move by +epsilon; an instance with an open step is refused unchanged.

    ``params`` has instance, direction and value; ``sessions`` instance and open.
    """
    joined = params.join(sessions.select("instance", "open"), "instance")
    moved = F.col("value") + F.col("direction") * F.lit(epsilon)
    return joined.withColumn("value", F.when(F.col("open"), F.col("value")).otherwise(moved)).withColumn(
        "error", F.when(F.col("open"), "previous step not completed")
    ).drop("open")


def perturb_down(params: DataFrame, sessions: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Move by -2 epsilon; needs an open step."""
    joined = params.join(sessions.select("instance", "open"), "instance")
    moved = F.col("value") - F.col("direction") * F.lit(2 * epsilon)
    return joined.withColumn("value", F.when(F.col("open"), moved).otherwise(F.col("value"))).withColumn(
        "error", F.when(~F.col("open"), "perturb down without perturb up")
    ).drop("open")


def derivative(loss_up: Column, loss_down: Column, epsilon: float = EPSILON, clip: float = CLIP) -> Column:
    """Central difference, bounded to +-clip."""
    raw = (loss_up - loss_down) / F.lit(2 * epsilon)
    return F.least(F.greatest(raw, F.lit(-clip)), F.lit(clip))


def optimise(
    params: DataFrame,
    losses: DataFrame,
    epsilon: float = EPSILON,
    lr: float = LEARNING_RATE,
    clip: float = CLIP,
) -> DataFrame:
    """Restore the point from -epsilon and apply the clipped update.

    ``losses`` has instance, open, loss_up, loss_down.
    """
    joined = params.join(losses.select("instance", "open", "loss_up", "loss_down"), "instance")
    g = derivative(F.col("loss_up"), F.col("loss_down"), epsilon, clip)
    stepped = (
        F.col("value") + F.col("direction") * F.lit(epsilon) - F.col("direction") * (F.lit(lr) * g)
    )
    return joined.withColumn("value", F.when(F.col("open"), stepped).otherwise(F.col("value"))).withColumn(
        "error", F.when(~F.col("open"), "optimise without perturbation state")
    ).drop("open", "loss_up", "loss_down")


def _tile_classes(width: int, tile: int) -> int:
    """Classes in a tile of a head."""
    return max(1, tile // (width + 1))


def head_tiles(params: DataFrame, width: int, classes: int, heads: dict[str, Column | str], tile: int = TILE) -> DataFrame:
    """A head cut along its classes: ``tile`` number and per name the rows (weights, bias) of its classes as one array.

    An array has at most ``tile`` numbers, or one class. A tile without each of
    its parameters once is an error.
    """
    step, size = _tile_classes(width, tile), classes * (width + 1)
    p = F.col("param_id")
    c = F.when(p < classes * width, F.floor(p / width)).otherwise(p - classes * width).cast("bigint")
    k = F.when(p < classes * width, p % width).otherwise(width).cast("int")
    named = [(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for n, v in heads.items()]
    rows = params.filter(p.between(0, size - 1)).select(F.floor(c / step).cast("int").alias("tile"), (c % step).alias("_c"), k.alias("_k"), *named)
    gathered = rows.groupBy("tile").agg(
        F.array_sort(F.collect_list(F.struct("_c", "_k", *heads))).alias("_w"), F.countDistinct("_c", "_k").alias("_n")
    )
    wanted = F.least(F.lit(step), F.lit(classes) - F.col("tile") * step) * (width + 1)
    whole = (F.col("_n") == wanted) & (F.size("_w") == wanted)
    gap = F.raise_error(F.lit(f"a head needs each parameter id from 0 to {size - 1} once")).cast("array<double>")

    def numbers(name: str) -> Column:
        return F.when(whole, F.transform("_w", lambda x: x[name])).otherwise(gap).alias(name)

    return gathered.select("tile", *[numbers(n) for n in heads])


def _against_tiles(
    examples: DataFrame, tiles: DataFrame, heads: Sequence[str], width: int, classes: int, tile: int, work: Callable, schema: str
) -> DataFrame:
    """Run ``work(first class, matrices, batch)`` on batches of examples under each tile of a head.

    Every task has one tile and a share of the examples; the tile's row comes
    first. ``work`` returns batches, and is called with no batch at the end of a tile.
    """
    step = _tile_classes(width, tile)
    count = -(-classes // step)
    shares = max(1, -(-int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions")) // count))
    spread = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = examples.filter("v IS NOT NULL").withColumn("_share", F.pmod(F.xxhash64("example_id"), F.lit(shares)).cast("int")).withColumn("tile", spread)
    copies = tiles.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    both = copies.unionByName(rows, allowMissingColumns=True).withColumn("_task", (F.col("tile") * shares + F.col("_share")).cast("int"))
    dealt = both.repartitionById(count * shares, F.col("_task")).sortWithinPartitions(F.col("v").isNotNull()).drop("_share", "_task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, matrices = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not batch.column("v")[0].is_valid:
                first = batch.column("tile")[0].as_py() * step
                matrices = [np.asarray(batch.column(h)[0].values).reshape(-1, width + 1) for h in heads]
                batch = batch.slice(1)
            if batch.num_rows and matrices is None:
                raise ValueError(f"a head needs each parameter id from 0 to {classes * (width + 1) - 1} once")
            if batch.num_rows:
                yield from work(first, matrices, batch)
        if matrices is not None:
            yield from work(first, matrices, None)

    return dealt.mapInArrow(run, schema)


def _values(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, width)


def head_statistics(
    examples: DataFrame, params: DataFrame, width: int, classes: int, heads: dict[str, Column | str], tile: int = TILE
) -> DataFrame:
    """Per example and head ``lse_`` (log-sum-exp of the logits), ``loss_`` and ``predicted_`` (first best class).

    ``examples``: example_id (unique), v of ``width`` numbers, target. A head of
    any size takes the same way: a tile gives four numbers per example, and no
    row ever holds all its logits. Examples without values are left out.
    """
    kind = examples.schema["example_id"].dataType.simpleString()
    names = list(heads)
    parts = [f"{n}_{h} {t}" for h in names for n, t in (("m", "double"), ("s", "double"), ("z", "double"), ("a", "bigint"))]

    def work(first: int, matrices: list[np.ndarray], batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if batch is None:
            return
        x, target = _values(batch, width), np.asarray(batch.column("target"), np.int64)
        columns: list = [batch.column("example_id")]
        for w in matrices:
            z = x @ w[:, :-1].T + w[:, -1]
            most = z.max(1)
            inside = (target >= first) & (target < first + z.shape[1])
            hit = z[np.arange(len(z)), np.where(inside, target - first, 0)]
            columns += [pa.array(most), pa.array(np.exp(z - most[:, None]).sum(1)), pa.array(hit, mask=~inside), pa.array(z.argmax(1) + first)]
        yield pa.RecordBatch.from_arrays(columns, ["example_id", *[p.split()[0] for p in parts]])

    slim = examples.select("example_id", F.col("target").cast("bigint").alias("target"), "v")
    tiles = head_tiles(params, width, classes, heads, tile)
    found = _against_tiles(slim, tiles, names, width, classes, tile, work, ", ".join([f"example_id {kind}", *parts]))
    # As many entries per example as the head has tiles.
    gathered = found.groupBy("example_id").agg(
        *[F.collect_list(F.struct(F.col(f"m_{h}").alias("m"), F.col(f"s_{h}").alias("s"))).alias(f"_{h}") for h in names],
        *[F.max(f"z_{h}").alias(f"z_{h}") for h in names],
        *[F.max(F.struct(f"m_{h}", -F.col(f"a_{h}"))).alias(f"_best_{h}") for h in names],
    )

    def joined(h: str) -> Column:
        most = F.array_max(F.transform(f"_{h}", lambda p: p["m"]))
        return let(most, lambda top: top + F.log(F.aggregate(f"_{h}", F.lit(0.0), lambda acc, p: acc + p["s"] * F.exp(p["m"] - top))))

    summed = gathered.select("example_id", *[joined(h).alias(f"lse_{h}") for h in names], *[f"z_{h}" for h in names], *[(-F.col(f"_best_{h}").getField("col2")).alias(f"predicted_{h}") for h in names])
    return summed.withColumns({f"loss_{h}": F.col(f"lse_{h}") - F.col(f"z_{h}") for h in names}).drop(*[f"z_{h}" for h in names])


def two_sided_losses(
    examples: DataFrame, params: DataFrame, width: int, classes: int, epsilon: float = EPSILON, tile: int = TILE
) -> DataFrame:
    """Mean loss under both perturbed heads, in one pass over the examples.

    ``examples`` has example_id, v and target; ``params`` param_id, direction, value.
    """
    sides = {"up": F.col("value") + F.col("direction") * F.lit(epsilon), "down": F.col("value") - F.col("direction") * F.lit(epsilon)}
    losses = head_statistics(examples, params, width, classes, sides, tile)
    return losses.agg(*[F.avg(f"loss_{n}").alias(f"loss_{n}") for n in sides])


def minimise_quadratic(
    params: DataFrame, seed: int, steps: int = 12, epsilon: float = 0.1, lr: float = 0.2
) -> DataFrame:
    """Zeroth-order descent on value squared, one instance per row.

    A step is a projection, so all steps fuse into one stage.
    """
    current = params
    for step in range(1, steps + 1):
        d = sign(f"{seed}:{step}", "param_id")
        g = (F.pow(F.col("value") + d * epsilon, 2) - F.pow(F.col("value") - d * epsilon, 2)) / (2 * epsilon)
        current = current.select(
            *[c for c in current.columns if c != "value"],
            (F.col("value") - F.lit(lr) * g * d).alias("value"),
        )
    return current.withColumn("loss", F.pow("value", 2))


def accumulate_pairs(losses: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Mean up and down loss of the step's pairs, matched by micro-batch.

    ``losses`` has side ('up'/'down'), micro and loss. A down pass without its up
    pass, or a pair count other than ``expected``, is an error.
    """
    pairs = losses.groupBy(*keys, "micro").agg(
        F.max(F.when(F.col("side") == "up", F.col("loss"))).alias("up"),
        F.max(F.when(F.col("side") == "down", F.col("loss"))).alias("down"),
    )
    whole = F.col("up").isNotNull() & F.col("down").isNotNull()
    totals = pairs.groupBy(*keys).agg(
        F.count(F.when(whole, 1)).alias("pairs"),
        F.count(F.when(F.col("up").isNull(), 1)).alias("_unmatched"),
        F.avg(F.when(whole, F.col("up"))).alias("loss_up"),
        F.avg(F.when(whole, F.col("down"))).alias("loss_down"),
    )
    return totals.withColumn(
        "error",
        first_failure(
            (F.col("_unmatched") > 0, "missing up pass"),
            (F.col("pairs") != expected, "wrong number of pairs"),
        ),
    ).drop("_unmatched")


# -- first-order steps -------------------------------------------------------


def outer_sums(rows: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Sum over rows of left x right: ``(keys, i, j, total, rows)``.

    Every task reduces its batches with numpy and emits one partial matrix per
    key; Spark adds the partials. ``keys`` has few distinct values.
    """
    keys = list(keys)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "i int", "j int", "total double", "rows bigint"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for frame in frames:
            groups = frame.groupby(keys, sort=False) if keys else [((), frame)]
            for key, part in groups:
                a = np.stack(part[left].to_numpy())
                b = np.stack(part[right].to_numpy())
                held = sums.setdefault(key, [np.zeros((a.shape[1], b.shape[1])), 0])
                held[0] += a.T @ b
                held[1] += len(part)
        for key, (matrix, n) in sums.items():
            i, j = np.indices(matrix.shape)
            out = pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "total": matrix.ravel(), "rows": n})
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "i", "j", "total", "rows"]]

    return (
        rows.select(*keys, left, right)
        .mapInPandas(partial, schema)
        .groupBy(*keys, "i", "j")
        .agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    )


def head_gradient(
    examples: DataFrame, params: DataFrame, width: int, classes: int, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Gradient of the mean loss per parameter (and key).

    Each task adds up the outer products of its examples with one tile's
    residuals and emits one partial matrix per key. ``keys`` has few distinct values.
    """
    keys = list(keys)
    kinds = dict(examples.dtypes)
    whole = head_statistics(examples, params, width, classes, {"value": "value"}, tile).select("example_id", F.col("lse_value").alias("_lse"))
    rows = examples.select("example_id", *keys, "v", F.col("target").cast("bigint").alias("target")).join(whole, "example_id")
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "param_id bigint", "total double", "rows bigint"])

    def partial(batches_work: dict) -> Callable:
        def work(first: int, matrices: list[np.ndarray], batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            w = matrices[0]
            if batch is None:
                for key, (total, n) in batches_work.items():
                    c = np.arange(first, first + len(w))[:, None]
                    ids = np.where(np.arange(width + 1) < width, c * width + np.arange(width + 1), classes * width + c)
                    columns = [pa.array([v] * ids.size, batch_types[i]) for i, v in enumerate(key)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(ids.ravel()), pa.array(total.ravel()), pa.array(np.full(ids.size, n))], [*keys, "param_id", "total", "rows"]
                    )
                batches_work.clear()
                return
            batch_types[:] = [batch.column(k).type for k in keys]
            x, target = _values(batch, width), np.asarray(batch.column("target"), np.int64)
            delta = np.exp(x @ w[:, :-1].T + w[:, -1] - np.asarray(batch.column("_lse"))[:, None])
            at = np.flatnonzero((target >= first) & (target < first + len(w)))
            delta[at, target[at] - first] -= 1.0
            ones = np.concatenate([x, np.ones((len(x), 1))], 1)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * len(x)):
                groups.setdefault(key, []).append(i)
            for key, members in groups.items():
                held = batches_work.setdefault(key, [np.zeros((len(w), width + 1)), 0])
                held[0] += delta[members].T @ ones[members]
                held[1] += len(members)

        batch_types: list = []
        return work

    tiles = head_tiles(params, width, classes, {"value": "value"}, tile)
    sums = _against_tiles(rows, tiles, ["value"], width, classes, tile, partial({}), schema)
    return (
        sums.groupBy(*keys, "param_id").agg(F.sum("total").alias("_total"), F.sum("rows").alias("rows"))
        .select(*keys, "param_id", (F.col("_total") / F.col("rows")).alias("grad"), "rows")
    )


def dense_mask(rows: DataFrame, values: str, gradient: str, weights) -> DataFrame:
    """Gradient that passes the ReLU of ``values @ weights`` ([k, n] literal)."""
    pre = te.matmul(values, weights)
    return rows.withColumn(
        "masked",
        F.zip_with(pre, F.col(gradient), lambda z, g: F.when(z > 0, g).otherwise(F.lit(0.0))),
    )


def dense_weight_gradient(rows: DataFrame, values: str, gradient: str, weights) -> DataFrame:
    """Weight gradient of sum(output * gradient) for a dense ReLU layer."""
    sums = outer_sums(dense_mask(rows, values, gradient, weights), (), values, "masked")
    return sums.select("i", "j", F.col("total").alias("grad"))


def dense_input_gradient(rows: DataFrame, values: str, gradient: str, weights) -> DataFrame:
    """Input gradient of the same objective, one array per row."""

    def back(masked: Column) -> Column:
        return F.transform(
            F.array(*[te.constants(line) for line in weights]),
            lambda line: te.total(F.zip_with(line, masked, lambda w, g: w * g)),
        )

    masked = dense_mask(rows, values, gradient, weights)
    return masked.withColumn("input_gradient", let("masked", back)).drop("masked")


def average_replicas(gradients: DataFrame, replicas: int) -> DataFrame:
    return gradients.groupBy("param_id").agg(
        (F.sum("grad") * F.lit(1.0 / max(replicas, 1))).alias("grad")
    )


def sgd_step(params: DataFrame, gradients: DataFrame, pending: DataFrame, lr: float) -> DataFrame:
    """Subtract lr * gradient; refused while any forward pass is pending.

    ``pending`` has one row per cached forward pass.
    """
    waiting = pending.agg(F.count(F.lit(1)) > 0).scalar()
    joined = params.join(gradients.select("param_id", "grad"), "param_id", "left")
    stepped = F.col("value") - F.lit(lr) * F.coalesce("grad", F.lit(0.0))
    return joined.select(
        "param_id",
        F.when(waiting, F.col("value")).otherwise(stepped).alias("value"),
        F.when(waiting, "forward passes still pending").alias("error"),
    )


def match_passes(log: DataFrame) -> DataFrame:
    """First-in first-out match of backward to forward passes per instance.

    ``log`` has instance, seq and kind ('forward'/'backward'). A backward pass
    that finds no waiting forward pass is an error and consumes nothing: it is
    the one that brings the running balance to a new low below zero.
    """
    signed = log.withColumn("_s", F.when(F.col("kind") == "forward", 1).otherwise(-1))
    laid = lay_out(signed, ["instance"], ["seq"])
    balance = laid.settle(running_total(laid.df, ["instance"], ["seq"], {"_bal": F.col("_s")}, laid))
    low = running_min(balance, ["instance"], ["seq"], "_bal", "_low", laid)
    orphan = (F.col("kind") == "backward") & (
        F.col("_bal") < F.least(F.coalesce("_low", F.lit(0)), F.lit(0))
    )
    marked = laid.settle(low.withColumn("_orphan", orphan))
    ranked = running_total(
        marked,
        ["instance"],
        ["seq"],
        {
            "_fwd": F.when(F.col("kind") == "forward", 1).otherwise(0),
            "_bwd": F.when((F.col("kind") == "backward") & ~F.col("_orphan"), 1).otherwise(0),
        },
        laid,
    )
    forward = ranked.filter("kind = 'forward'").select(
        "instance", F.col("_fwd").alias("ordinal"), F.col("seq").alias("forward_seq")
    )
    backward = ranked.filter("kind = 'backward' AND NOT _orphan").select(
        "instance", F.col("_bwd").alias("ordinal"), F.col("seq").alias("backward_seq")
    )
    matched = forward.join(backward, ["instance", "ordinal"], "left").withColumn(
        "status", F.when(F.col("backward_seq").isNull(), "pending").otherwise("matched")
    )
    orphans = ranked.filter("_orphan").select(
        "instance",
        F.lit(None).cast("bigint").alias("ordinal"),
        F.lit(None).cast("bigint").alias("forward_seq"),
        F.col("seq").alias("backward_seq"),
        F.lit("no cached forward").alias("status"),
    )
    return matched.select("instance", "ordinal", "forward_seq", "backward_seq", "status").unionByName(orphans)


# -- checkpoints -------------------------------------------------------------


def merge_checkpoint(current: DataFrame, checkpoint: DataFrame, contribution: float) -> DataFrame:
    """current * (1 - c) + checkpoint * c on shared ids; a lone id is an error row."""
    both = current.select("param_id", F.col("value").alias("_a")).join(
        checkpoint.select("param_id", F.col("value").alias("_b")), "param_id", "full_outer"
    )
    return both.select(
        "param_id",
        (F.col("_a") * F.lit(1.0 - contribution) + F.col("_b") * F.lit(contribution)).alias("value"),
        first_failure(
            (F.col("_a").isNull(), "unknown parameter"), (F.col("_b").isNull(), "missing in checkpoint")
        ).alias("error"),
    )


def unify_shards(shards: DataFrame, step: str, shard: str, name: str, needed: int = 6) -> DataFrame:
    """Per step: 'waiting' below ``needed`` shards, 'duplicate tensor', or 'unified'."""
    tensors = shards.groupBy(step, name).agg(F.count(F.lit(1)).alias("_n"))
    sizes = tensors.groupBy(step).agg(
        F.count(F.lit(1)).alias("tensors"), F.max("_n").alias("_dup")
    )
    seen = shards.groupBy(step).agg(F.countDistinct(shard).alias("shards"))
    return seen.join(sizes, step).select(
        step,
        "shards",
        "tensors",
        F.coalesce(
            first_failure(
                (F.col("shards") < needed, "waiting"), (F.col("_dup") > 1, "duplicate tensor")
            ),
            F.lit("unified"),
        ).alias("status"),
    )


def unified_tensors(shards: DataFrame, step: str, shard: str, name: str, needed: int = 6) -> DataFrame:
    """All tensors of the steps that unify."""
    good = unify_shards(shards, step, shard, name, needed).filter("status = 'unified'")
    return shards.join(good.select(step), step, "left_semi")


def checkpoint_completeness(
    checkpoints: DataFrame, run: str, step: str, shard: str, steps: int, every: int, shards: int
) -> DataFrame:
    """Whether a run holds at least ``steps // every * shards`` checkpoints."""
    expected = steps // every * shards
    return (
        checkpoints.filter(F.col(step) % every == 0)
        .groupBy(run)
        .agg(F.countDistinct(step, shard).alias("found"))
        .select(run, "found", (F.col("found") >= expected).alias("complete"))
    )


# -- schedules, configuration and capacity -----------------------------------


def schedule_fault() -> Column:
    """First broken rule of period, train, phase and warmup columns."""
    period, train = F.col("period"), F.col("train")
    return first_failure(
        (period == 0, "period must be positive"),
        (period.isNotNull() & train.isNull(), "train steps missing"),
        (train > period, "train steps exceed period"),
    )


def frozen_at(step: Column) -> Column:
    """Frozen flag the schedule asks for at a step; NULL when it has no opinion."""
    period, warmup = F.col("period"), F.coalesce("warmup", F.lit(0))
    active = period.isNotNull() & (period > 0) & (step > warmup)
    place = F.pmod(
        step - warmup - 1 + F.pmod(F.coalesce("phase", F.lit(0)), F.when(period > 0, period)),
        F.when(period > 0, period),
    )
    return F.when(active, ~(place < F.col("train")))


def freeze_schedule(instances: DataFrame, steps: int) -> DataFrame:
    """One row per instance and optimise step with the scheduled flag."""
    spread = instances.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return spread.withColumn("scheduled", frozen_at(F.col("step"))).withColumn("error", schedule_fault())


def effective_frozen(instances: DataFrame, steps: int) -> DataFrame:
    """Frozen flag in force after each step; step 0 is the state at start.

    During warm-up the schedule has no opinion and the initial flag stays. The
    counter moves only for instances with a schedule. Broken schedules are left out.
    """
    good = instances.filter(schedule_fault().isNull())
    spread = good.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    asked = frozen_at(F.greatest(F.col("step"), F.lit(1)))
    return spread.withColumn("frozen", F.coalesce(asked, F.col("initial_frozen"))).withColumn(
        "optimize_steps", F.when(F.col("period").isNotNull(), F.col("step")).otherwise(0)
    )


def overlay(instances: DataFrame, defaults: dict[str, object], overrides: Sequence[str]) -> DataFrame:
    """Instance setting where given, else the default; flags rows that set nothing."""
    given = F.coalesce(*[F.col(c).cast("string") for c in overrides]).isNotNull()
    return instances.withColumn("has_override", given).withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None}
    )


def capacity(workers: DataFrame, routes: DataFrame, group: str) -> DataFrame:
    """Total, occupied and available instances per group; NULL capacity is unbounded.

    ``workers`` has worker, the group column and max_instances; ``routes`` has
    worker. Routes are counted before they meet the workers.
    """
    used = routes.groupBy("worker").agg(F.count(F.lit(1)).alias("_used"))
    rolled = workers.join(used, "worker", "left").groupBy(group).agg(
        F.when(F.count(F.when(F.col("max_instances").isNull(), 1)) == 0, F.sum("max_instances")).alias("total"),
        F.coalesce(F.sum("_used"), F.lit(0)).alias("occupied"),
    )
    return rolled.withColumn("available", F.greatest(F.col("total") - F.col("occupied"), F.lit(0))).withColumn(
        "available", F.when(F.col("total").isNotNull(), F.col("available"))
    )


def capacity_by_kind(workers: DataFrame, routes: DataFrame) -> DataFrame:
    """Capacity per kind a worker serves.

    A route counts against every kind of its worker, or against one kind only
    when it ``required`` that kind. Workers carry an array ``kinds``.
    """
    used = routes.groupBy("worker", "required").agg(F.count(F.lit(1)).alias("_used"))
    served = workers.select("worker", "max_instances", F.explode("kinds").alias("kind"))
    totals = served.groupBy("kind").agg(
        F.when(F.count(F.when(F.col("max_instances").isNull(), 1)) == 0, F.sum("max_instances")).alias("total")
    )
    counted = (
        served.join(used, "worker")
        .filter(F.col("required").isNull() | (F.col("required") == F.col("kind")))
        .groupBy("kind")
        .agg(F.sum("_used").alias("occupied"))
    )
    joined = totals.join(counted, "kind", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0)))
    free = F.greatest(F.col("total") - F.col("occupied"), F.lit(0))
    return joined.withColumn("available", F.when(F.col("total").isNotNull(), free))


def parameter_report(configured: DataFrame, frozen: DataFrame) -> DataFrame:
    """Effective configuration with the frozen flag and step count, per instance."""
    return configured.join(frozen.select("instance", "frozen", "optimize_steps"), "instance")


def lane_agreement(log: DataFrame) -> DataFrame:
    """Whether both lanes issue the same command and number at each ordinal.

    ``log`` has stage, ordinal, lane (0/1), command and number, one row each.
    """
    lanes = [
        log.filter(F.col("lane") == lane).select(
            "stage", "ordinal", F.struct("command", "number").alias(f"_l{lane}")
        )
        for lane in (0, 1)
    ]
    both = lanes[0].join(lanes[1], ["stage", "ordinal"], "full_outer")
    return both.select(
        "stage", "ordinal", F.coalesce(F.col("_l0") == F.col("_l1"), F.lit(False)).alias("agrees")
    )


# -- session order -----------------------------------------------------------


def session_audit(log: DataFrame) -> DataFrame:
    """State before every command of a two-sided session and whether it is legal.

    ``log`` has instance, seq and command ('up', 'infer', 'down', 'optimise').
    A step runs up, infer.., down, infer.., optimise; a command out of place is
    an error and changes nothing; inference is always legal.

    Inference leaves an instance either waiting for the down pass or for the
    update, whatever came before. So the log is cut at its inferences, each
    piece maps that two-valued entry state to the next one (keep, swap or a
    constant), and the entry state of a piece follows from the last constant and
    the number of swaps since.
    """
    key = ["instance"]
    laid = lay_out(log, key, ["seq"])
    infer = F.when(F.col("command") == "infer", 1).otherwise(0)
    counted = laid.settle(
        running_total(laid.df, key, ["seq"], {"_through": infer}, laid)
        .withColumn("_piece", F.col("_through") - infer)
        .drop("_through")
    )
    piece = [*key, "_piece"]
    # A piece has the marks of its first row, so pieces stay in order over the ranges.
    place = [F.min(AT).alias(AT), *[F.min_by(m, AT).alias(m) for m in MARKS if m != AT]]

    def first(command: str) -> Column:
        return F.min(F.when(F.col("command") == command, F.col("seq")))

    firsts = counted.groupBy(*piece).agg(
        first("up").alias("_up"), first("down").alias("_down"), first("optimise").alias("_opt"), *place
    )
    restarts = (
        counted.filter("command = 'up'")
        .join(firsts.select(*piece, "_opt"), piece)
        .filter("seq > _opt")
        .groupBy(*piece)
        .agg(F.min("seq").alias("_reup"))
    )
    pieces = laid.settle(firsts.join(restarts, piece, "left"))
    leaves_down, leaves_update = F.col("_reup").isNotNull(), F.col("_down").isNotNull()
    # Exit state as 0 (waits for down) or 1 (waits for update).
    constant = (
        F.when(F.col("_piece") == 0, F.when(F.col("_up").isNotNull(), 0).otherwise(1))
        .when(leaves_update & ~leaves_down, 1)
        .when(leaves_down & ~leaves_update, 0)
    )
    swap = F.when((F.col("_piece") > 0) & leaves_down & leaves_update, 1).otherwise(0)
    walked = laid.settle(
        running_total(
            pieces.withColumn("_const", constant), key, ["_piece"], {"_swaps": swap}, laid
        ).withColumn("_anchor", F.when(F.col("_const").isNotNull(), F.struct("_const", "_swaps")))
    )
    known = last_known(walked, key, ["_piece"], {"_last": "_anchor"}, laid)
    exits = laid.settle(
        known.withColumn(
            "_exit", F.pmod(F.col("_last._const") + F.col("_swaps") - F.col("_last._swaps"), F.lit(2))
        )
    )
    entries = neighbours(exits, key, ["_piece"], {"_entry": "_exit"}, -1, laid)
    state = (
        F.when(F.col("_piece") == 0, F.when(F.col("_up") < F.col("seq"), "after up").otherwise("idle"))
        .when(F.col("_entry") == 0, F.when(F.col("_down") < F.col("seq"), "after down").otherwise("awaits down"))
        .when(F.col("_reup") < F.col("seq"), "after up")
        .when(F.col("_opt") < F.col("seq"), "idle")
        .otherwise("awaits update")
    )
    needed = (
        F.when(F.col("command") == "up", "idle")
        .when(F.col("command") == "down", "awaits down")
        .when(F.col("command") == "optimise", "awaits update")
    )
    return (
        counted.join(entries.select(*piece, "_up", "_down", "_opt", "_reup", "_entry"), piece)
        .withColumn("state", state)
        .select(*log.columns, "state", F.coalesce(F.col("state") == needed, F.lit(True)).alias("legal"))
    )
