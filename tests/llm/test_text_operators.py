"""Text operators against brute force, with NULLs, long and repeated texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import textwrap
import tracemalloc
import unicodedata
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tensorloom.llm import attention, bpe_tree, forest, licences, packing, quality, queries, sketches, substrings, token_files, wordpiece
from tensorloom.llm.components import components
from tensorloom.llm.texts import PieceEncoder, pieces, shared_folder, windows
from tools.compare import canonical

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, data string, row int, part int, ledger int, rep int"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    parts = ["the", "tion", "er", "ing", "and", "of", "hé", "ßen", "in", "re"]
    words = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (rnd.choice([".", ",", ".\n"]) if rnd.random() < 0.1 else "") for w in words)


def rows() -> list[tuple]:
    shared = prose(90, 25)
    texts = {
        7: prose(1, 120), 3: prose(2, 90) + "\n" + shared, 12: None, 5: "", 9: " \n\t ", 20: "one two", 21: "one two",
        11: prose(1, 120), 13: prose(1, 118) + " x y", 30: shared + "\n" + prose(3, 80), 2: "aaaa " * 40,
        31: "Licensed under the Apache License, Version 2.0.\n" + prose(4, 60), 33: prose(5, 9000),
        34: "x" * 3000 + " " + "é" * 200, 35: "a b  c　d 'll don't\r\n\r\n 12345 …!!", 40: prose(6, 70),
    }
    out = [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts.items()]
    out += [(40, prose(6, 70), None, None, None), (None, prose(1, 120), "en", "s", 3), (None, None, None, None, None)]
    return [(*r, "own", 1, 2, 3, 4) for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], SCHEMA)


def text_of(value) -> bytes:
    return (value or "").encode()


def order_key(row):
    return (row[0] is not None, row[0] or 0)


def test_windows_and_pieces_keep_the_text():
    for seed in range(50):
        data = (prose(seed, 60) + "  \n  x" * (seed % 3)).encode()
        assert b"".join(windows(data, 40)) == data
        assert b"".join(pieces(data)) == data


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_piece_encoder_equals_the_library(path):
    own, plain = PieceEncoder(path, 4, limit=20), Tokenizer.from_file(path)
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("ab é.,!'s \n\t  中12", k=rnd.randint(0, 40))) for _ in range(800)]
    texts += ["".join(rnd.choices(["Ab", "é", "ÀÖ", "×", "xyz", "'s", "<|endoftext|>", "<|EndOfText|>", "|", ">", "&", ".", " ", "\n", "\u0301", "1"], k=rnd.randint(1, 12))) for _ in range(2000)]
    texts += [r[1] or "" for r in rows()] + ["long " * 500_000, "a <|endoftext|> b", "<|startoftext|>" * 3, "İstanbul ΣΑΣ&&& ĳ."]
    assert own.by_words
    for text, found in zip(texts, own.encode_many([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    as_text = PieceEncoder(path, 4, as_text=True)
    plain.encode_special_tokens = True
    for text, found in zip(texts, as_text.encode_many([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# 1
def test_bounds_select():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 500):
        values = np.sort(rnd.integers(0, rnd.integers(1, 10_000), n))
        values[0] = 0
        b = token_files.Bounds.build(values)
        assert b.values().tolist() == values.tolist()
        assert [b.select(i) for i in range(n)] == values.tolist()
        with pytest.raises(IndexError):
            b.select(n)
    ends = np.arange(10_000) * 1000
    b = token_files.Bounds.build(ends)
    assert len(b.low) + len(b.high) < 10_000 * 13 / 8 + 16


@pytest.mark.parametrize("block", [1, 200, 1 << 18])
def test_token_files(spark, docs, block):
    folder = shared_folder(spark, "test")
    token_files.write(docs, folder, WORD_BPE, 1, block_ids=block, shards=4)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    plain, at = Tokenizer.from_file(WORD_BPE), 0
    want = sorted(rows(), key=lambda r: (*order_key(r), r[1] or ""))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        ids = [*plain.encode(w[1] or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (w[0], at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    wanted = spark.createDataFrame([(33,), (2,), (999,)], "doc_id bigint")
    places = {g.doc_id: (g.start, g.n_tokens) for g in got}
    assert {r.doc_id: (r.start, r.n_tokens) for r in token_files.lookup(spark, folder, wanted).collect()} == {k: places[k] for k in (33, 2)}


def test_token_files_empty(spark, empty):
    folder = shared_folder(spark, "test")
    token_files.write(empty, folder, WORD_BPE, 1)
    assert token_files.read(spark, folder).collect() == []


# 2
def test_licences(spark, docs, empty):
    found = licences.scan(docs).collect()
    assert [(r.doc_id, r.licence, r.n_different, r.start) for r in found] == [(31, "Apache-2.0", 0, 0)]
    scanner = licences.Scanner.of(licences.TEMPLATES)
    for name, text in licences.TEMPLATES.items():
        assert scanner.match(text.encode())[0] == name and scanner.match(text.encode())[2] == 0
    assert scanner.match(b"Released under the MIT Licence.")[:1] == ("MIT",)
    assert scanner.match(prose(1, 30).encode() + b" licensed") is None
    assert list(licences.candidate_blocks(b"a\nlicensed x\nCopyright y\nb\nno warranty")) == [(2, 24), (27, 38)]
    assert licences.scan(empty).collect() == []


def test_licences_wrapped_long_and_several(spark):
    wrapped = lambda name: textwrap.fill(licences.TEMPLATES[name], 72, initial_indent=" * ", subsequent_indent=" * ")
    texts = {
        1: "/*\n * MIT License\n *\n" + wrapped("MIT-full") + "\n */\ncode", 2: wrapped("MIT-permission"), 3: wrapped("BSD-3-Clause"),
        4: prose(7, 200) + " " + licences.TEMPLATES["Apache-2.0"] + " " + prose(8, 300),
        5: wrapped("BSD-3-Clause-full") + "\n" + prose(9, 3) + " " + licences.TEMPLATES["CC-BY-4.0"],
        6: "No licence here, and no warranty.\n" + prose(10, 40),
    }
    found: dict = {}
    for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).orderBy("doc_id", "start").collect():
        found.setdefault(r.doc_id, []).append((r.licence, r.n_different))
        part = texts[r.doc_id].encode()[r.start : r.end].replace(b" * ", b" ")
        assert licences.words(part) == licences.words(licences.TEMPLATES[r.licence].encode())
    assert found == {
        1: [("MIT-full", 0)], 2: [("MIT-permission", 0)], 3: [("BSD-3-Clause", 0)], 4: [("Apache-2.0", 0)],
        5: [("BSD-3-Clause-full", 0), ("CC-BY-4.0", 0)],
    }


# 3
def test_ledger_against_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    unique = [(i, r[1]) for i, r in enumerate(rows())]
    con.executemany("INSERT INTO documents VALUES (?, ?)", unique)
    spark = docs.sparkSession
    judged = quality.ledger(spark.createDataFrame(unique, "doc_id bigint, text string")).select("doc_id", "ledger.*")
    failed = F.col("failed")
    got = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejects(failed, quality.BASE).alias("base_failed"), (~quality.rejects(failed)).alias("kept"), "failed",
    )
    cursor = con.execute(queries.ORACLE_SQL["op3_rule_ledger"])
    names = [d[0] for d in cursor.description]
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(cursor.fetchall(), names)


def test_ledger_keeps_rows_and_ablation(docs, empty):
    judged = quality.ledger(docs)
    assert judged.columns == docs.columns and judged.count() == docs.count()
    masks = [r[0] for r in judged.select("ledger.failed").collect()]
    for version, names in quality.POLICIES.items():
        active = quality.mask(names)
        for r in quality.ablation(judged.select("ledger.failed"), version=version).collect():
            bit = quality.mask((r.rule,))
            assert r.rejected == sum(bool(m & bit) for m in masks)
            assert r.only_this == sum(m & active == bit for m in masks)
            assert r.kept_without == sum(not m & active & ~bit for m in masks)
    lines = quality.ablation(quality.ledger(empty).select("ledger.failed")).collect()
    assert [r.rule for r in lines] == list(quality.POLICIES[quality.CURRENT]) and not any(r.rejected for r in lines)
    assert quality.repeat_words([b"a"] * 3 + [b"b"] + [b"a"] * 3) == 6 and quality.repeat_words([b"a"] * 4) == 4


def test_letters_of_all_scripts():
    clean = {
        "cyrillic": "Съешь ещё этих мягких французских булок, да выпей чаю. Москва строит новый мост через реку.",
        "greek": "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί. Ο ήλιος ανατέλλει κάθε πρωί.",
        "arabic": "الكتاب على الطاولة في الغرفة الكبيرة، والطفل يقرأ قصة جميلة عن البحر والسماء.",
        "hebrew": "הספר מונח על השולחן בחדר הגדול, והילד קורא סיפור יפה על הים ועל השמיים.",
        "devanagari": "यह एक साफ़ दस्तावेज़ है जिसमें हिन्दी के कई शब्द और पूरे वाक्य लिखे गए हैं।",
        "burmese": "မြန်မာ နိုင်ငံ သည် အရှေ့တောင် အာရှ တွင် တည်ရှိ သည်။",
        "polish": "Zażółć gęślą jaźń, ŁÓDŹ leży nad rzeką.",
    }
    rules = {name: rule.replace("AND", "and") for name, rule in quality.RULES}
    for name, text in clean.items():
        known = dict(zip(quality.MEASURES, quality.measure(text.encode())))
        kinds = Counter(unicodedata.category(c) for c in text)
        assert (known["n_letters"], known["n_upper"]) == (sum(n for k, n in kinds.items() if k[0] in "LM"), kinds["Lu"]), name
        assert not eval(rules["few_letters"], {}, known) and not eval(rules["capitals"], {}, known), name
    assert eval(rules["capitals"], {}, dict(zip(quality.MEASURES, quality.measure("МОСКВА СТРОИТ НОВЫЙ мост".encode()))))
    for text in ("§ 12 – 34 … 56 78", "12 € 34 ☃☃"):
        assert eval(rules["few_letters"], {}, dict(zip(quality.MEASURES, quality.measure(text.encode()))))
    for text in ("Élan naïf × 3 ÷ 4, Größe", "plain words"):
        assert quality.measure(text.encode())[6:8] == quality.letters_of(text.encode())


# 4
def links_of(table: list[tuple]) -> dict:
    sets = []
    for _, text in table:
        w = text_of(text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, parent = len(table), list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i] | sets[j])) and None not in (table[i][0], table[j][0]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    classes = {}
    for i in range(n):
        if table[i][0] is not None:
            classes[find(i)] = min(classes.get(find(i), table[i][0]), table[i][0])
    return Counter((table[i][0], classes.get(find(i)), links[i]) for i in range(n))


def variants(n: int) -> list[tuple]:
    out = []
    for i in range(n):
        words = prose(100 + i // 12, 60).split()
        rnd = random.Random(i)
        for _ in range(i % 4):
            words[rnd.randrange(len(words))] = f"w{i}"
        out.append((1000 - i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [4, 2048])
def test_near_duplicates(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(forest, "SET_BLOCK", block)
    monkeypatch.setattr(forest, "NODE_BLOCK", block)
    table = [(r[0], r[1]) for r in rows()] + variants(60)
    got = forest.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert Counter(map(tuple, got)) == links_of(table)
    if block == 4:
        assert Counter(map(tuple, forest.near_duplicates(docs).collect())) == links_of([(r[0], r[1]) for r in rows()])
        assert forest.near_duplicates(empty).collect() == []


def test_forest_depth():
    assert forest.found_with(0.8, forest.floor_depth()) >= forest.TARGET_RECALL
    assert forest.found_with(0.8, forest.floor_depth() + 1) < forest.TARGET_RECALL


def test_components(spark, docs):
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (8, 7), (5, 5), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {tuple(r) for r in got} == {(k, 1) for k in (1, 2, 3, 9)} | {(7, 7), (8, 7)} | {(k, 20) for k in range(20, 25)}
    assert len(got) == 11


# 5
def test_fingerprints(spark, docs, empty):
    table = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))

    def units(text):
        out, start = Counter(), 0
        for i, c in enumerate(text):
            if c == "\n" or (c in ".!?" and text[i + 1 : i + 2] == " "):
                out[text[start : i + 1]] += 1
                start = i + 1
        return out + Counter([text[start:]] if text[start:] else [])

    def like(a, b):
        a, b = units(a), units(b)
        return (a & b).total() / (a | b).total() if a | b else 1.0

    for parts in (1, 4, 50):
        got = {}
        for r in sketches.fingerprints(docs, parts=parts).collect():
            got.setdefault((r.doc_id, r.n_chars, bytes(r.edited)), []).append(r)
        prints = {}
        for i, (doc, text) in enumerate(table):
            after = table[(i + 1) % len(table)][1]
            half = len(text) // 2
            new = text[: len(text) - half] + after[:half]
            r = got[doc, len(text), new.encode()].pop()
            assert (r.near_edited, r.near_next) == pytest.approx((like(text, new), like(text, after)))
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
            assert prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
        assert not any(got.values())
    assert sketches.fingerprints(empty).collect() == []


def test_differences_recover_digests():
    rnd = np.random.default_rng(1)
    left, right = (np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (700, 300))
    common = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    a, b = np.concatenate([left, common]), np.concatenate([common, right])
    pair, digests, signs = sketches.differences((a, np.array([0, len(a), len(a)])), (b, np.array([0, len(b), len(b)])))
    assert set(digests[signs > 0]) == set(left) and set(digests[signs < 0]) == set(right) and not pair.any()


# 6
def removed(table: list[tuple], least: int = 50) -> Counter:
    out = []
    for doc, text in table:
        data = text_of(text)
        earlier = {text_of(t)[p : p + least] for d, t in table if d is not None and doc is not None and d < doc for p in range(len(text_of(t)) - least + 1)}
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            if data[p : p + least] in earlier:
                gone[p : p + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((doc, len(data), spans, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize("many", [0, 4096])
def test_remove_repeats(spark, docs, empty, many, monkeypatch):
    table = [(r[0], r[1]) for r in rows() if r[0] != 33] + [(k, t) for k, t in variants(20)]
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    got = substrings.remove_repeats(df, many=many, buckets=5).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got) == removed(table)
    if many:
        assert substrings.remove_repeats(empty).collect() == []
        assert substrings.remove_repeats(docs).count() == docs.count()


def test_hot_passages_stay_out_of_single_tasks(spark, docs, monkeypatch, tmp_path):
    """A passage of 60 bytes in other surroundings each time, and whole copies of a text."""
    passage = "the passage that many of the documents share word for word now"
    table = [(k, f"{prose(1000 + k, 12)} {passage} {prose(3000 + k, 12)}") for k in range(80)] + [(200 + k, prose(77, 30)) for k in range(40)]
    made, judge = substrings.whole_runs, substrings._judge

    def note(n: int, kind: str):
        (tmp_path / f"{kind}-{uuid.uuid4().hex}").write_text(str(n))

    def noted(batches, keys):
        for part, begins in made(batches, keys):
            note(int(np.unique(part["key"].to_numpy(), return_counts=True)[1].max()), "rows")
            yield part, begins

    def judged(part, many):
        by_anchor = part.filter(pc.less(part["bucket"], 8))
        note(sum(len(substrings._docs(x)) for x in by_anchor["copied_docs"].to_pylist()), "copies")
        return judge(part, many)

    monkeypatch.setattr(substrings, "whole_runs", noted)
    monkeypatch.setattr(substrings, "_judge", judged)
    source = spark.createDataFrame(table, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), r.kept) for r in substrings.remove_repeats(source, buckets=8, many=8).collect())
    assert got == removed(table)
    sizes = {kind: [int(x.read_text()) for x in tmp_path.glob(f"{kind}-*")] for kind in ("rows", "copies")}
    assert max(sizes["rows"], default=0) <= 8
    assert sizes["copies"] and not any(sizes["copies"])


def test_remove_repeats_carries_columns(spark):
    passage = "the same sixty or so bytes of words stand in both of these texts "
    table = [(1, passage + "a", "x", 1, 7), (2, passage + "b", None, 2, 8), (None, passage, "z", 3, None), (4, None, "n", None, 9)]
    df = spark.createDataFrame(table, "doc_id bigint, text string, data string, spans int, carried int")
    got = substrings.remove_repeats(df, carry=["data", "spans", "carried"], buckets=3).collect()
    assert {(r.doc_id, *r.carried) for r in got} == {(r[0], *r[2:]) for r in table} and len(got) == 4
    assert {r.doc_id: bytes(r.kept).decode() for r in got} == {1: passage + "a", 2: "b", None: passage, 4: ""}


def test_suffix_order_and_previous_factors():
    rnd = random.Random(0)
    for _ in range(200):
        values = np.array([rnd.choice([97, 97, 98, 255, 0]) for _ in range(rnd.randint(1, 50))], np.uint8)
        depth, starts = rnd.choice([3, 8, 9, 20]), np.arange(len(values))
        data = values.tobytes() + bytes(depth)
        keys = [data[i : i + depth] for i in starts]
        order, common = substrings.suffix_order(values, starts, depth)
        share = lambda a, b: next((k for k in range(depth) if a[k] != b[k]), depth)
        assert [keys[i] for i in order] == sorted(keys)
        assert common.tolist() == [share(keys[a], keys[b]) for a, b in zip(order, order[1:])]
        own = np.array([rnd.randint(0, 4) for _ in starts])
        want = [max((share(keys[i], keys[j]) for j in starts if own[j] < own[i]), default=0) for i in starts]
        assert substrings.longest_previous(order, common, own).tolist() == want
        assert substrings.recurring(order, common, own, depth).tolist() == [w >= depth for w in want]


# 7
def test_scores(spark, docs, empty):
    got = attention.score_texts(docs, WORD_BPE, 49406, 49407, rounds=1).collect()
    table = [(r[0], text_of(r[1]).lower().split()) for r in rows()]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, words in table if not held(d) for w in [*words, None])
    n, v = counts.total(), len(counts)
    want = Counter()
    for d, words in table:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words, None])
        want[d, held(d), len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert attention.score_texts(empty, WORD_BPE, 49406, 49407).collect() == []


def test_all_training_ids_are_predicted_and_counted(spark):
    settings, _ = attention.read_settings(WORD_BPE, 49406, 49407)
    texts = [(k, prose(40 + k, n) + " pneumonoultramicroscopicsilicovolcanoconiosis " * 30) for k, n in enumerate((0, 3, 700, 2000))] + [(50, ""), (51, "a")]
    rows_ = spark.createDataFrame(texts, "doc_id bigint, data string").select("doc_id", F.col("data").cast("binary").alias("data"))
    gathered = rows_.mapInArrow(attention._gather(settings), "word binary, n bigint, windows binary").filter("windows IS NOT NULL").select("windows").cache()
    got = [x for r in gathered.collect() for x in attention._window_rows(r.windows)]
    plain = Tokenizer.from_file(WORD_BPE)
    chains = [[49406, *plain.encode(t, add_special_tokens=False).ids, 49407] for d, t in texts if attention.fold(d) != attention.HELD_OUT]
    pairs = Counter(p for c in chains for p in zip(c, c[1:]))
    assert Counter((int(a), int(b)) for x in got for a, b in zip(x, x[1:]) if b != settings.size) == pairs
    of = np.arange(attention.IDS) % 7
    before = attention.followers(gathered, of, 7, settings)
    want = np.zeros((7, 7))
    for (a, b), n in pairs.items():
        want[b % 7, a % 7] += n
    assert before.tolist() == want.tolist()
    ids = np.unique([x for c in chains for x in c[1:-1]])
    frequent, grouped = ids[:5], ids[5:40]
    near = attention.contexts(gathered, frequent, grouped, settings)
    assert near.tolist() == [[sum((x[1:] == g).sum() * (x == f).sum() for x in got) for f in frequent] for g in grouped]


def test_attention_gradient_causality_and_windows():
    rng = np.random.default_rng(0)
    of = np.zeros(attention.IDS, np.int64)
    of[:20] = rng.integers(0, 9, 20)
    classes = attention.Classes(of, np.zeros(attention.IDS, np.float32), 9)
    weights = {k: w.astype(np.float64) for k, w in attention.first_weights(9).items()}
    ids = rng.integers(0, 20, (5, 12)).astype(np.uint16)
    ids[2, 7:] = 60000
    gradients, _, n = attention.train_batch(weights, ids, classes, 60000)
    for name, w in weights.items():
        at, step = tuple(rng.integers(0, s) for s in w.shape), 1e-5
        w[at] += step
        high = attention.train_batch(weights, ids, classes, 60000)[1]
        w[at] -= 2 * step
        low = attention.train_batch(weights, ids, classes, 60000)[1]
        w[at] += step
        assert gradients[name][at] == pytest.approx((high - low) / 2 / step / n, rel=1e-3, abs=1e-7)
    # Windows give what one attention over the whole chain gives, and each token is scored once.
    settings = attention.Settings("", 18, 19, 20)
    text = rng.integers(0, 18, 61)
    chain = np.concatenate([[18], text, [19]])
    inputs = of[chain[:-1]][None]
    h, _ = attention.attend(weights, inputs)
    pick = lambda x, at: x[at] - np.log(np.exp(x).sum())
    whole = 0.0
    for row, token in zip(h[0], chain[1:]):
        shelf, place = divmod(of[token], 3)  # nine classes on three shelves
        whole += pick(row @ weights["top"] + weights["top_bias"], shelf)
        whole += pick((row @ weights["out"] + weights["bias"])[3 * shelf : 3 * shelf + 3], place)
    tables = attention.scoring_tables(weights, classes.n)
    short = attention.log_likelihood(tables, classes, [text, np.zeros(0, np.int64)], settings)
    assert short[0] == pytest.approx(whole, rel=1e-6) and short[1] < 0


def test_attention_by_class_equals_attention_by_position():
    rng = np.random.default_rng(4)
    of = np.zeros(attention.IDS, np.int64)
    of[:30] = rng.permutation(30) % 11
    classes = attention.Classes(of, np.zeros(attention.IDS, np.float32), 11)
    weights = {k: w.astype(np.float64) + rng.normal(0, 0.2, w.shape) for k, w in attention.first_weights(11).items()}
    ids = rng.integers(0, 30, (2 * attention.BLOCK + 3, 31)).astype(np.uint16)
    ids[5, 9:] = ids[40, 1:] = 60000
    kinds = attention.by_class(weights)
    hidden = attention._attend(weights, kinds, of[ids[:, :-1]])[0]
    want, n = 0.0, 0
    for window, (row, at) in enumerate((x, h) for x, h in zip(ids, hidden)):
        x = weights["embed"][of[row[:-1]]]
        for t in range(30):
            seen = range(max(0, t - attention.SPAN + 1), t + 1)
            scores = [x[t] @ weights["query"] @ (x[s] @ weights["key"]) * np.float32(attention.WIDTH**-0.5) + weights["near"][t - s] for s in seen]
            share = np.exp(np.clip(scores, -attention.LIMIT, attention.LIMIT))
            h = x[t] + (share / share.sum()) @ (x[seen.start : seen.stop] @ weights["value"]) @ weights["mix"]
            if row[t] != 60000:
                assert at[t] == pytest.approx(h, rel=1e-5)
            if row[t + 1] != 60000:
                shelf, place = divmod(of[row[t + 1]], 4)  # eleven classes on three shelves, the last one shorter
                for logits, k in ((h @ weights["top"] + weights["top_bias"], shelf), ((h @ weights["out"] + weights["bias"])[4 * shelf : 4 * shelf + 4], place)):
                    want += np.log(np.exp(logits).sum()) - logits[k]
                n += 1
    # Windows of several blocks, one of them not full, count as one batch; so does each alone.
    g, loss, targets = attention.train_batch(weights, ids, classes, 60000)
    assert (targets, loss) == (n, pytest.approx(want, rel=1e-9))
    alone = [attention.train_batch(weights, x[None], classes, 60000) for x in ids]
    for name, value in g.items():
        assert value == pytest.approx(sum(a[name] * m for a, _, m in alone if m) / n, rel=1e-6, abs=1e-9)


def test_words_are_numbered_as_they_come_up(monkeypatch):
    encoder, plain = attention.PieceEncoder(WORD_BPE, 2, as_text=True), Tokenizer.from_file(WORD_BPE)
    table = attention.Words({b"an": 2.5}, encoder)
    monkeypatch.setattr(attention, "KNOWN_WORDS", 3)
    for texts in ([[[b"an", b"owl"], [b"an"]], []], [[[b"owl", b"hoots"]], [[b"hoots", b"<|endoftext|>"]]], [[[b"an"]]]):
        for numbers, parts in zip(table.number(iter(texts)), texts):
            words = [w for part in parts for w in part]
            assert [table.words[k] for k in numbers] == words
            assert [table.ids[k] for k in numbers] == encoder.encode_many(words)
            assert [table.logs[k] == 2.5 if w == b"an" else np.isnan(table.logs[k]) for k, w in zip(numbers, words)] == [True] * len(words)
    assert table.words == [b"an"] and np.frombuffer(table.ids[0], np.uint16).tolist() == plain.encode("an", add_special_tokens=False).ids


# 8
def greedy(word: bytes, first: set, later: set) -> int:
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_longest_match():
    rnd = random.Random(5)
    for _ in range(300):
        make = lambda: {bytes(rnd.choices(b"abc", k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 9))}
        first, later = make(), make()
        automaton = wordpiece.LongestMatch(first, later)
        for _ in range(30):
            word = bytes(rnd.choices(b"abc", k=rnd.randint(0, 9)))
            assert automaton.count(word) == greedy(word, first, later)


def test_token_counts(docs, empty):
    got = Counter(tuple(r) for r in wordpiece.token_counts(docs, RANKS).collect())
    ranks = bpe_tree.Vocabulary.read(RANKS).ranks
    single = {bytes([b]) for b in range(256)}
    first = single | {t[1:] for t in ranks if t[:1] == b" " and len(t) > 1 and len(t.split()) == 1 and not t[1:2].isspace()}
    later = single | {t for t in ranks if t.split() == [t]}
    want = Counter()
    for r in rows():
        found = [greedy(w, first, later) for w in text_of(r[1]).split()] if len(r[1] or "") < 4000 else None
        if found is not None:
            want[r[0], len(found), sum(found), 0, max(found, default=0)] += 1
    assert not want - got and got.total() == len(rows())
    assert wordpiece.token_counts(empty, RANKS).collect() == []


# 9
def test_bpe_tree():
    words = bpe_tree.Vocabulary.read(RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    codecs = [bpe_tree.TreeCodec(RANKS, public_tokenizers.PATTERN, a, b) for a, b in ((1 << 14, 48), (7, 3))]
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("aaab '\t\n sèñ中  'llre12!?　 \x85e", k=rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 4000, "ab" * 2000, " " * 3000, "\n \n" * 500 + "x", *[r[1] or "" for r in rows()]]
    for text in texts:
        want = plain.encode_ordinary(text)
        for codec in codecs:
            ids = codec.encode(text.encode())
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert codec.decode(ids) == text.encode()


def test_bpe_tree_tables(docs, empty):
    encoded = bpe_tree.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, bytes(r.data)) for r in bpe_tree.decode(encoded, RANKS, public_tokenizers.PATTERN).collect())
    assert got == Counter((r[0], text_of(r[1])) for r in rows())
    assert bpe_tree.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


# 10
def test_sum_of_squares_rule():
    rnd = np.random.default_rng(2)
    for capacity in (1, 7, 30):
        lengths = rnd.integers(1, capacity + 1, 200)
        sequence, offset, gaps = packing.sum_of_squares(lengths, capacity)
        state: dict[int, int] = {}
        for n, s, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
            def total(gap, n=n):
                after = [g for k, g in state.items() if k != gap[1]] + [gap[0] - n]
                return sum(c * c for g, c in Counter(after).items() if g)
            choices = {g: k for k, g in state.items() if g >= n} | {capacity: -1}
            best = min(total((g, k)) for g, k in choices.items())
            gap = state.get(s, capacity)
            assert at == capacity - gap and total((gap, s if s in state else -1)) == best
            state[s] = gap - n
        assert gaps.tolist() == [state[k] for k in range(len(state))]


@pytest.mark.parametrize("group", [5, 1 << 17])
def test_packing(docs, empty, group):
    cut = packing.cut_documents(docs, BYTE_BPE, 0, 64)
    got = packing.pack(cut, "length", 64, group_items=group, fan_in=2).collect()
    plain = Tokenizer.from_file(BYTE_BPE)
    ids: dict = {}
    for r in sorted(got, key=lambda r: r.piece):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
        assert r.length == len(r.ids) // 4 <= 64 and (r.piece == 0 or r.length == 64)
    for doc, text, *_ in rows():
        if doc not in (40, None):
            assert ids[doc] == [*plain.encode(text or "", add_special_tokens=False).ids, 0]
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by) <= math.ceil(total / 64) * 1.1 + 2
    assert packing.pack(packing.cut_documents(empty, BYTE_BPE, 0, 64), "length", 64).collect() == []


@pytest.mark.parametrize("lengths", [[40], [33, 41, 52, 63], [40, 24]])
def test_packing_groups_stay_bounded(spark, monkeypatch, tmp_path, lengths):
    made = packing._pack_group

    def noted(*args):
        run = made(*args)

        def noting(table):
            (tmp_path / uuid.uuid4().hex).write_text(str(table.num_rows))
            return run(table)

        return noting

    monkeypatch.setattr(packing, "_pack_group", noted)
    items = spark.range(3000).select("id", F.element_at(F.array(*map(F.lit, lengths)), (F.col("id") % len(lengths) + 1).cast("int")).alias("length"))
    got = packing.pack(items, "length", 64, group_items=100, fan_in=16).collect()
    sizes = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert max(sizes) <= 200
    assert sorted(r.id for r in got) == list(range(3000))
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    least = 1500 if lengths == [40, 24] else 3000
    assert least <= len(by) <= least * 1.02


def test_packing_keeps_columns_of_any_name(spark, docs):
    names = ["_row", "_len", "_seq", "_at", "_group", "_round", "_own", "a.b", "sequence_id"]
    items = spark.createDataFrame([(k, *[k + j for j in range(len(names))], 1 + k % 100) for k in range(400)], ["k", *names, "n"])
    packed = packing.pack(items, "n", 100, group_items=64)
    assert packed.columns == ["k", *names[:-1], "n", "sequence_id", "offset"]
    got = packed.collect()
    assert sorted(tuple(r)[:-2] for r in got) == sorted((k, *[k + j for j in range(len(names) - 1)], 1 + k % 100) for k in range(400))
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.n))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100


def test_packing_refuses_bad_lengths(spark, docs):
    for bad in (0, 65, None):
        with pytest.raises(Exception, match="not between"):
            packing.pack(spark.createDataFrame([(1, bad)], "k int, length int"), "length", 64).collect()


# pipeline
def rejected(data: bytes) -> bool:
    known = dict(zip(quality.MEASURES, quality.measure(data)))
    return any(eval(rule.replace("AND", "and"), {}, known) for name, rule in quality.RULES if name in quality.POLICIES[quality.CURRENT])


def test_pipeline(spark, docs, tmp_path):
    table = [(r[0], r[1], r[2], r[3], r[4]) for r in rows() if r[0] != 33] + [(k, t, "en", "s", len(t)) for k, t in variants(40)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(table, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(r[0], r[1]) for r in table if not rejected(text_of(r[1]))]
    classes = {k[0]: k[1] for k in links_of(kept)}
    once = sorted({(d, t) for d, t in kept if d is not None and classes[d] == d}) + [(d, t) for d, t in kept if d is None]
    seen: dict = {}
    for d, t in once:
        seen.setdefault(d if d is not None else object(), (d, t))
    left = {}
    for (doc, _, _, data), n in removed(list(seen.values())).items():
        left[doc] = left.get(doc, 0) + n * bool(data)
    assert {r.doc_id for r in got} == {d for d, n in left.items() if n}
    assert sum(r.piece == 0 for r in got) == sum(left.values())


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_hash_of_result(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op6_earlier_substrings"](spark, str(tmp_path)).collect()
    for r in got:
        assert len(r.kept_sha256) == 64 and r.n_removed <= r.n_bytes
    assert any(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in got)


def test_memory_of_signatures_and_cut_documents():
    """Megabytes of short texts in one batch take a fraction of their arrays and lists at a time."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=4000)).encode() for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "data"])
    assert sum(map(len, texts)) > 2 << 20

    def peak(run) -> float:
        for part in run([batch.slice(0, 1)]):  # loads the vocabulary
            assert part.num_rows
        tracemalloc.start()
        try:
            assert sum(len(set(x.column("doc_id").to_pylist())) for x in run([batch])) == len(texts)
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(forest._sign(5)) < 35
    assert peak(packing._cut(BYTE_BPE, 0, 2048, False)) < 12
    assert PieceEncoder._loaded[BYTE_BPE, 4, False, packing.CACHED_PIECES].limit == packing.CACHED_PIECES <= 300_000
