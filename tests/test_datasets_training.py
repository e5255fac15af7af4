import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import datasets as od
from tensorloom.operators import training as tr
from tensorloom.sources.datasets import labelled_columns


def test_balanced_sample_keeps_positives(spark):
    df = spark.range(200).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    rows = od.balanced_sample(df, "id", F.col("y") == 1, 5).collect()
    assert sum(r.y for r in rows) == 20 and len(rows) == 40
    again = od.balanced_sample(df.repartition(5), "id", F.col("y") == 1, 5).collect()
    assert {r.id for r in rows} == {r.id for r in again}


@pytest.mark.parametrize("positive, text", [("id < 0", "no positive"), ("id >= 4", "too few")])
def test_balanced_sample_errors(spark, positive, text):
    with pytest.raises(Exception, match=text):
        od.balanced_sample(spark.range(10), "id", F.expr(positive), 1).collect()


def test_holdout_floors(spark):
    df = spark.range(20)
    assert od.training_split(df, "id", 1).count() == 17
    assert od.validation_split(df, "id", 1).count() == 3
    assert od.validation_split(spark.range(6), "id", 1).count() == 0


def test_cursor_covers_every_epoch(spark):
    rows = od.batches(od.cursor(spark.range(10), "id", 2, 3), "position").collect()
    assert sorted(r.position for r in rows) == list(range(30))
    for e in range(3):
        assert {r.id for r in rows if r.epoch == e} == set(range(10))
    orders = [[r.id for r in sorted(rows, key=lambda r: r.position) if r.epoch == e] for e in range(3)]
    assert orders[0] != orders[1]


def test_micro_batches_split(spark):
    rows = od.micro_batches(spark.range(35).withColumnRenamed("id", "b"), "b", 8, 2).collect()
    first = {r.b: (r.replica, r.micro) for r in rows if r.step == 0}
    assert first == {b: (b // 8, b % 8) for b in range(16)}
    assert {r.error for r in rows if r.step == 2} == {"micro-batches cannot be split across replicas"}


def test_labelled_columns_need_both(spark):
    with pytest.raises(ValueError, match="no payload"):
        labelled_columns(spark.range(1).schema)
    nested = spark.range(1).select(F.struct(F.lit(b"x").alias("bytes")).alias("image"))
    with pytest.raises(ValueError, match="no label"):
        labelled_columns(nested.schema)


SCHEDULE = "instance long, period int, train int, phase int, warmup int, initial_frozen boolean"


def schedule(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEDULE)


def test_training_steps_of_a_schedule(spark):
    df = tr.freeze_schedule(schedule(spark, (5, 2, 3, 2, False)), 12)
    assert [r.step for r in df.orderBy("step").collect() if r.scheduled is False] == [5, 6, 10, 11]


def test_half_period_instances_alternate(spark):
    df = tr.effective_frozen(schedule(spark, (2, 1, 0, 0, False), (2, 1, 1, 0, False)), 4)
    got = {}
    for r in df.orderBy("step").collect():
        got.setdefault(r.instance, []).append(r.frozen)
    assert got == {0: [False, False, True, False, True], 1: [True, True, False, True, False]}


def test_schedule_faults_and_warmup(spark):
    df = schedule(spark, (0, 1, 0, 0, False), (4, None, 0, 0, False), (3, 4, 0, 0, False), (3, 3, 0, 5, True), (None, None, None, None, True))
    faults = [r.e for r in df.select("instance", tr.schedule_fault().alias("e")).orderBy("instance").collect()]
    assert faults == ["period must be positive", "train steps missing", "train steps exceed period", None, None]
    frozen = {(r.instance, r.step): (r.frozen, r.optimize_steps) for r in tr.effective_frozen(df, 6).collect()}
    assert [frozen[3, s][0] for s in range(7)] == [True] * 6 + [False]
    assert frozen[4, 6] == (True, 0)


def test_quadratic_descends_below_one_percent(spark):
    start = spark.createDataFrame([(1, 4.0), (2, -3.0)], "param_id long, value double")
    rows = tr.minimise_quadratic(start, 3).collect()
    for r, first in zip(sorted(rows, key=lambda r: r.param_id), (16.0, 9.0)):
        assert r.loss < 0.01 * first


def test_zeroth_order_step_is_clipped(spark):
    params = spark.createDataFrame([(0, 0, 1.0, 1.0)], "instance long, param_id long, value double, direction double")
    losses = spark.createDataFrame([(0, True, 5.0, 1.0)], "instance long, open boolean, loss_up double, loss_down double")
    row = tr.optimise(params, losses).first()
    assert math.isclose(row.value, 1.0 + 1e-3 - 1e-4 * 10)


def head_data(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], rng.randrange(3)) for i in range(60)]
    params = [(i, rng.gauss(0, 0.5)) for i in range(18)]
    examples = spark.createDataFrame(rows, "example_id long, v array<double>, target int").repartition(5)
    return examples, spark.createDataFrame(params, "param_id long, value double"), rows, dict(params)


def mean_loss(rows, theta):
    total = 0.0
    for _, v, t in rows:
        z = [sum(v[k] * theta[c * 5 + k] for k in range(5)) + theta[15 + c] for c in range(3)]
        total += math.log(sum(math.exp(x) for x in z)) - z[t]
    return total / len(rows)


def test_losses_and_gradient_over_tiles(spark):
    examples, params, rows, theta = head_data(spark)
    moved = tr.directions(params, 4)
    short = tr.two_sided_losses(examples, moved, 5, 3, epsilon=0.1).first()
    wide = tr.two_sided_losses(examples, moved, 5, 3, epsilon=0.1, tile=6).first()
    signs = {r.param_id: r.direction for r in moved.collect()}
    up = mean_loss(rows, {p: v + 0.1 * signs[p] for p, v in theta.items()})
    down = mean_loss(rows, {p: v - 0.1 * signs[p] for p, v in theta.items()})
    for got in (short, wide):
        assert math.isclose(got.loss_up, up, rel_tol=1e-9) and math.isclose(got.loss_down, down, rel_tol=1e-9)
    grads = {r.param_id: r.grad for r in tr.head_gradient(examples, params, 5, 3).collect()}
    long = {r.param_id: r.grad for r in tr.head_gradient(examples, params, 5, 3, tile=12).collect()}
    assert long == pytest.approx(grads)
    for p in (0, 7, 14, 16):
        a, b = ({**theta, p: theta[p] + d} for d in (1e-5, -1e-5))
        assert math.isclose(grads[p], (mean_loss(rows, a) - mean_loss(rows, b)) / 2e-5, abs_tol=1e-6)


def test_a_wide_head_stays_in_tiles(spark):
    """5 inputs by 700 classes in tiles of 100: losses, predictions, and a gap refused."""
    rng = np.random.default_rng(2)
    w, b = rng.normal(size=(700, 5)), rng.normal(size=700)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 700, 40)
    z = x @ w.T + b
    examples = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(40)], "example_id long, v array<double>, target int").repartition(3)
    rows = [(int(c * 5 + k), float(w[c, k])) for c in range(700) for k in range(5)] + [(3500 + c, float(b[c])) for c in range(700)]
    params = spark.createDataFrame(rows, "param_id long, value double")
    tiles = tr.head_tiles(params, 5, 700, {"value": "value"}, 600)
    assert sorted((r.tile, len(r.value)) for r in tiles.collect()) == [(i, 600) for i in range(7)]
    got = {r.example_id: r for r in tr.head_statistics(examples, params, 5, 700, {"h": "value"}, 600).collect()}
    for i in range(40):
        lse = np.log(np.exp(z[i]).sum())
        assert math.isclose(got[i].lse_h, lse, rel_tol=1e-12) and math.isclose(got[i].loss_h, lse - z[i, y[i]], rel_tol=1e-9)
        assert got[i].predicted_h == z[i].argmax()
    grads = {r.param_id: r.grad for r in tr.head_gradient(examples, params, 5, 700, tile=600).collect()}
    soft = np.exp(z - np.log(np.exp(z).sum(1))[:, None])
    soft[np.arange(40), y] -= 1
    want = soft.T @ x / 40
    assert len(grads) == 4200 and np.allclose([grads[c * 5 + k] for c in range(700) for k in range(5)], want.ravel(), atol=1e-12)
    with pytest.raises(Exception, match="each parameter id"):
        tr.head_statistics(examples, params.filter("param_id <> 77"), 5, 700, {"h": "value"}, 600).collect()


def test_pair_accumulation_guards(spark):
    rows = [(0, "up", 0, 1.0), (0, "down", 0, 2.0), (1, "down", 0, 2.0), (2, "up", 0, 1.0)]
    df = spark.createDataFrame(rows, "step long, side string, micro long, loss double")
    got = {r.step: r.error for r in tr.accumulate_pairs(df, ["step"], 1).collect()}
    assert got == {0: None, 1: "missing up pass", 2: "wrong number of pairs"}


def test_capacity_null_absorbs(spark):
    workers = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, "b", 1)], "worker long, pool string, max_instances int")
    routes = spark.createDataFrame([(1,), (3,), (3,)], "worker long")
    got = {r.pool: (r.total, r.occupied, r.available) for r in tr.capacity(workers, routes, "pool").collect()}
    assert got == {"a": (None, 1, None), "b": (1, 2, 0)}


def test_checkpoint_merge(spark):
    a = spark.createDataFrame([(1, 4.0), (2, 1.0)], "param_id long, value double")
    b = spark.createDataFrame([(1, 8.0), (3, 1.0)], "param_id long, value double")
    got = {r.param_id: (r.value, r.error) for r in tr.merge_checkpoint(a, b, 0.25).collect()}
    assert got == {1: (5.0, None), 2: (None, "missing in checkpoint"), 3: (None, "unknown parameter")}
