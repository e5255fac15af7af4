"""Whitening, conversation repair and mixing against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tensorloom.llm import mixing, queries, repair, whitening


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- whitening ------------------------------------------------------------------


def spectrum(kind: str, size: int, rng) -> np.ndarray:
    e = np.sort(rng.random(size) * 10)
    if kind == "close":
        e[5:9] = e[5] + np.arange(4) * 1e-9
        e[-3:] = e[-3] + np.arange(3) * 1e-6
    elif kind == "equal":
        e[-4:] = e[-1]
    elif kind == "all equal":
        e[:] = 2
    elif kind == "all close":
        e = 1 + np.arange(size) * 1e-8
    elif kind == "steep":
        e[: size // 2] *= 1e-12
    return e


@pytest.mark.parametrize("kind", ["apart", "close", "equal", "all equal", "all close", "steep"])
def test_refinement_reaches_the_precision_of_the_matrix(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    e = spectrum(kind, 40, rng)
    a = ((q * e) @ q.T).astype(np.longdouble)
    a = (a + a.T) / 2
    values, x = whitening.refine(a)
    assert float(np.abs(x.T @ x - np.eye(40)).max()) < 1e-17
    assert float(np.abs(a @ x - x * values).max()) < 1e-16
    assert np.abs(values.astype(float) - np.linalg.eigvalsh(a.astype(float))).max() < 1e-13
    double = whitening.refine(a.astype(np.float64))[1]
    assert np.abs(double.T @ double - np.eye(40)).max() < 1e-13


def test_refinement_mends_clusters_that_32_bits_cannot_see():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    e = np.sort(rng.random(24)) + 1
    e[-4:] = 3 + np.arange(4) * 1e-9
    a = ((q * e) @ q.T).astype(np.longdouble)
    values, x = whitening.refine((a + a.T) / 2)
    rough = np.linalg.eigh(np.asarray(a, np.float32))[1].astype(np.float64)
    off = lambda y: np.abs(np.abs(q[:, -4:].T @ np.asarray(y[:, -4:], np.float64)) - np.eye(4)).max()
    assert off(rough) > 0.01 and off(x) < 1e-5


VECTORS = "vec_id bigint, embedding array<float>, label int, x int, n int, component int"


def vector_rows(size=5, n=60):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n, size)) * np.array([3.0, 2.0, 1.0, 0.5, 0.1])[:size]
    rows = [(i, [float(np.float32(v)) for v in base[i]], 0) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]  # one hot vector
    rows += [(5, rows[5][1], 1), (None, rows[6][1], 1), (2001, None, 1), (2002, [1.0, None, 0.0, 0.0, 0.0][:size], 1)]
    rows += [(2003, [math.nan] * size, 1), (2004, [math.inf] + [0.0] * (size - 1), 1), (2005, [], 1), (2006, [1.0] * (size + 1), 1)]
    return [(*r, 7, 7, 7) for r in rows]


def expected_vectors(rows, size):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(v[d] for v in fit) for d in range(size)]
    centred = np.array([[float(Fraction(n * v[d] - sums[d], n)) for d in range(size)] for v in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return kept, x, n, sums, e[::-1], u[:, ::-1], cov


def test_whitening_matches_brute_force(spark):
    rows = vector_rows()
    got = dicts(whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)))
    kept, x, n, sums, e, u, cov = expected_vectors(rows, 5)
    assert len(got) == 4 * len(kept)
    want = defaultdict(list)
    for (i, _), v in zip(kept, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        w = (np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) @ u[:, :4]) / np.sqrt(e[:4])
        for k in range(4):
            want[i, k + 1].append((deviation, w[k]))
    found = defaultdict(list)
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-10
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(cov), rel=1e-10)
        found[r["vec_id"], r["component"]].append((r["deviation"], r["whitened"]))
    assert found.keys() == want.keys()
    sign = {k: np.sign(found[0, k][0][1] * want[0, k][0][1]) for k in range(1, 5)}
    for key, values in want.items():
        for (d, w), (d2, w2) in zip(sorted(values), sorted(found[key])):
            assert d == d2 and w == pytest.approx(sign[key[1]] * w2, rel=1e-9, abs=1e-10)


def test_whitening_of_degenerate_tables(spark):
    assert dicts(whitening.whiten(spark.createDataFrame([], VECTORS))) == []
    same = [(i, [0.5, -0.25], 0, 1, 1, 1) for i in range(4)]
    assert dicts(whitening.whiten(spark.createDataFrame(same, VECTORS))) == []
    line = [(i, [float(i), 0.0], 0, 1, 1, 1) for i in range(5)]
    got = dicts(whitening.whiten(spark.createDataFrame(line, VECTORS)))
    assert [r["component"] for r in got] == [1] * 5 and {round(r["explained"], 12) for r in got} == {1.0}
    far = [(i, [1e12 * i, float(i % 2)], 0, 1, 1, 1) for i in range(5)]
    got = dicts(whitening.whiten(spark.createDataFrame(far, "vec_id bigint, embedding array<double>, label int, x int, n int, component int")))
    assert {r["deviation"] for r in got if r["vec_id"] != 2} == {None} and all(math.isfinite(r["whitened"]) for r in got)


def test_products_are_exact_beyond_double(spark):
    rng = np.random.default_rng(2)
    for most in (100, 1 << 25, 1 << 40):
        z = rng.integers(-most, most, size=(50, 3))
        assert whitening._products(z).tolist() == (z.astype(object).T @ z.astype(object)).tolist()


# -- conversation repair --------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]")


def fixed(rows):
    """Cheapest edits of one conversation by trying all of them from the end, whole audits kept."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}
    best = {}
    for i in range(len(rows), -1, -1):
        for _ in range(4):
            for state in range(4):
                options = [(0, "", [])] if i == len(rows) and state in (0, 3) else []
                letter = nexts[state]
                if (i, after[letter]) in best:
                    c, a, t = best[i, after[letter]]
                    options.append((c + 3, "I" + a, [f"{names[letter]}:", *t]))
                if i < len(rows):
                    role, text = rows[i][2], rows[i][3]
                    c, a, t = best[i + 1, state]
                    options.append((c + 4, "D" + a, t))
                    if faults[i] not in ("blank", "duplicate"):
                        more = 3 * (faults[i] == "truncated")
                        c, a, t = best[i + 1, after[letter]]
                        options.append((c + 3 + more, "R" + a, [f"{names[letter]}:{text}", *t]))
                        if role[:1] == letter:
                            options.append((c + more, "K" + a, [f"{role}:{text}", *t]))
                        if role[:1] == "s" and state == 0:
                            c, a, t = best[i + 1, 1]
                            options.append((c + more, "K" + a, [f"{role}:{text}", *t]))
                if options:
                    found = min(options, key=lambda o: o[:2])
                    if (i, state) not in best or found[:2] < best[i, state][:2]:
                        best[i, state] = found
    cost, audit, texts = best[0, 0]
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(texts).encode()).hexdigest(),
    }


CONVERSATION = "conv_id bigint, turn bigint, role string, text string, letters int, block int, copies int, plan int, _role int"


def conversation_rows(seed=5, n=150):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 12])):
            turn += rnd.choice([0, 1, 1, 1, 1, 2, 5])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rnd.choice(["Hi.", "So what?", "cut off", " \n\t", "", None, "é ok! \n", "a　.", "No ", f"T{rnd.random()}."])
            rows.append((conv, None if rnd.random() < 0.1 else turn, role, text))
    rows += [(None, 3, "user", "Hi."), (None, None, "assistant", "Well."), (None, 9, "user", "x" * 200_000 + ".")]
    rows += [(7777, 4, "user", "Same.")] * 40  # repeated rows
    rows += [(8888, k, ["user", "assistant"][k % 2], ["Yes.", "No.", "Cut"][k % 3]) for k in range(9000)]  # over several blocks
    return rows


def test_repair_matches_brute_force(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], CONVERSATION).repartition(5)
    got = {r.pop("conv_id"): r for r in dicts(repair.repair(df))}
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    assert got.keys() == {r[0] for r in rows}
    small = {k: v for k, v in groups.items() if k != 8888}
    for conv in {r[0] for r in rows} - {8888}:
        assert got[conv] == fixed(small.get(conv, [])), conv
    empty = {r[0] for r in rows} - groups.keys()
    assert empty and all(got[c]["audit"] == "" and got[c]["cost"] == 0 for c in empty)
    # The long one against the same rules with the texts rebuilt from its audit.
    long = got[8888]
    rows8 = sorted(groups[8888], key=lambda r: r[1])
    assert len(long["audit"].replace("I", "")) == len(rows8) and long["blank"] + long["duplicate"] > 8000
    assert long["gaps"] == rows8[-1][1] - rows8[0][1] + 1 - len({r[1] for r in rows8})
    texts, state = [], 0
    at = iter(rows8)
    for edit in long["audit"]:
        if edit == "D":
            next(at)
            continue
        role = {0: "user", 2: "assistant", 3: "user"}[state]
        texts.append(f"{role}:" if edit == "I" else f"{role}:{next(at)[3]}")
        state = 2 if role == "user" else 3
    assert hashlib.sha256("\n".join(texts).encode()).hexdigest() == long["repaired_sha256"]


def test_endings_are_shared_and_agree_with_fresh_ones():
    rnd = random.Random(8)
    endings = sorted({"".join(rnd.choices("suaoSUAx", k=rnd.randint(0, 9))) for _ in range(800)})
    shared = repair.Endings()
    for ending in endings:
        shared.enter(ending)
        alone = repair.Endings()
        alone.enter(ending)
        assert shared.best() == alone.best()
    assert shared.made == len({e[:k] for e in endings for k in range(1, len(e) + 1)})
    assert shared.made < sum(map(len, endings)) and len(shared.costs) < 60


def test_repair_of_an_empty_table(spark):
    assert dicts(repair.repair(spark.createDataFrame([], CONVERSATION))) == []


# -- mixing ---------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, copies int, at int, part int"


def mix_rows():
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        source = rnd.choice(["a", "b", "B", "é", None, "z", "a", "a", "a"])
        rows.append((i, " \n".join(["w"] * int(rnd.lognormvariate(3, 1.2))), source))
    rows += [(5000 + i, "one two three", "b") for i in range(300)]  # one hot size
    rows += [(9, "same row", "z")] * 50 + [(None, "no id here", "z")] * 5 + [(9001, None, "a"), (9002, "", "b"), (9003, " \n\t", "zz")]
    rows += [(9100, "x " * 4_000, "a")]
    return rows


def targets(words: dict) -> dict:
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = Fraction(3 * sum(words.values()), 2), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in open_))
        above = [s for s in open_ if level * weight[s] > 2 * words[s]]
        if not above:
            return {s: fixed.get(s, level * weight[s]) for s in names}
        fixed |= {s: Fraction(2 * words[s]) for s in above}


def test_mix_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(i, t, "en", s, 1, 1, 2, 3, 4) for i, t, s in rows], DOCS).repartition(6)
    mixed = mixing.mix(df)
    got = dicts(mixed)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += size(t)
    assert sorted((str(r["doc_id"]), r["source"] or "", r["size"]) for r in got) == sorted((str(i), s or "", size(t)) for i, t, s in rows)
    want = targets(words)
    taken, smallest = defaultdict(int), {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(float(want[s]), rel=1e-12)
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        if r["size"]:
            smallest[s] = min(smallest.get(s, 1 << 60), r["size"])
    for s in words:
        assert abs(taken[s] - want[s]) <= smallest.get(s, 0) / 2 + 1, s
    # Rates tilt exponentially with size: log rate is proportional to size below the limit, and meets the target.
    for s in words:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(float(want[s]), abs=0.3)
        slopes = {round(math.log(r["rate"]) / r["size"], 9) for r in mine if r["size"] and r["rate"] < 2 - 1e-9}
        assert len(slopes) <= 1
    again = dicts(mixing.mix(df.repartition(3)))
    totals = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert totals(again) == totals(got)


def test_mix_of_degenerate_tables(spark):
    assert dicts(mixing.mix(spark.createDataFrame([], DOCS))) == []
    rows = [(1, None, "en", "a", 1, 1, 2, 3, 4), (2, "", "en", None, 1, 1, 2, 3, 4)]
    assert {(r["target"], r["taken"]) for r in dicts(mixing.mix(spark.createDataFrame(rows, DOCS)))} == {(0.0, 0)}
    # Whole copies only: a source of one long document ends where its copies allow.
    one = [(1, "a b c d", "en", "s", 1, 1, 2, 3, 4)]
    assert [(r["target"], r["taken"]) for r in dicts(mixing.mix(spark.createDataFrame(one, DOCS)))] == [(6.0, 8)]
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(one, DOCS), share=Fraction(5, 2))


def test_word_counts():
    texts = [b"", b"a", b" a", b"a b", b"\x0b\x0c x\x1cy \xc2\xa0 z", b" ", b"end\n"]
    column = pa.array([b"skip me", *texts], pa.binary()).slice(1)
    assert mixing.word_counts(column).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_queries_are_registered():
    assert {"op11_refined_whitening", "op12_shared_ending_repair", "op13_entropy_mix"} <= queries.QUERIES.keys()
