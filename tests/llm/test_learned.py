"""Prefix trie, language identification and importance resampling against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.llm import importance, language, prefix_trie
from pixelloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"

# prefix trie

TURNS = "conv_id bigint, turn bigint, role string, text string, note string, key string, part int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations_of(rows):
    """conv_id to its (role, text) in order."""
    out = {}
    first = lambda v: (v is not None, v or 0)
    for c, turn, role, text, *_ in sorted(rows, key=lambda r: (first(r[1]), r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = convs.get(c - int(math.fmod(c, 100)), []) if c is not None else []
        out[c] = [*base[:h], *own[h:]]
    return out


def plain_trie(convs):
    """Every node by its sequence, brute force."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    low = lambda seq: min((c for c in members[seq] if c is not None), default=None)
    kids = Counter(seq[:-1] for seq in members if seq)
    out = []
    for seq, of in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        ends = sorted(c for c in of if c is not None and len(convs[c]) == len(seq))
        saved = sum((len(members[s]) - 1) * (len(s[-1][1]) if s else 0) for s in below)
        out.append((low(seq), len(seq), low(seq[:-1]) if seq else None, len(of), kids[seq], sum(not kids[s] for s in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found_trie(turns, convs):
    out = prefix_trie.trie(turns, convs)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=repr)


def random_conversations(seed, n, letters, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        words = rng.integers(0, letters, rng.integers(1, longest + 1))
        words[: rng.integers(0, longest + 1)] = 0
        rows += [(c * 7, t, ("user", "assistant")[t % 2], "é" * int(w), "x", "k", 1) for t, w in enumerate(words)]
    return rows


@pytest.mark.parametrize(("seed", "n", "letters", "longest"), [(0, 30, 2, 4), (1, 25, 3, 20), (2, 40, 1, 19), (3, 1, 2, 3), (4, 12, 2, 30)])
def test_trie(spark, monkeypatch, seed, n, letters, longest):
    """Several rounds, copies, conversations that begin others, and one alone; ids in many small pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = random_conversations(seed, n, letters, longest)
    turns = prefix_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(3))
    assert found_trie(turns, prefix_trie.lengths(turns)) == plain_trie(conversations_of(rows))


HARD_TURNS = [
    (100, None, "user", "first", None, None, None),
    (100, 0, None, None, None, None, None),
    (100, 0, "a", "tie", "x", "x", 3),
    (100, 0, "a", "tie", "x", "x", 3),
    (100, 5, "user", "a\x00b\n", "x", "x", 3),
    (101, 0, "user", "own", "x", "x", 3),
    (101, None, "user", "own", "x", "x", 3),
    (104, 1, "user", "short", "x", "x", 3),
    (250, 1, "user", "no base", "x", "x", 3),
    (251, 1, "user", "no base", "x", "x", 3),
    (-7, 0, "user", "below", "x", "x", 3),
    (-100, 0, "user", "below", "x", "x", 3),
    (0, 0, "user", "long " * 50_000, "x", "x", 3),
    (1, 0, "user", "long " * 50_000, "x", "x", 3),
    (None, 0, "user", "nobody", "x", "x", 3),
    (None, 1, "user", "nobody", "x", "x", 3),
]


def test_rebuilt_conversations(spark):
    turns, convs = prefix_trie.with_shared_heads(prefix_trie.numbered(spark.createDataFrame(HARD_TURNS, TURNS)))
    want = rebuilt(conversations_of(HARD_TURNS))
    assert {r.conv: r.len for r in convs.collect()} == {c: len(t) for c, t in want.items()}
    rows = turns.orderBy("conv", "pos").collect()
    assert [(r.conv, r.pos, r.chars) for r in rows if r.conv is not None] == [(c, i, len(t[1])) for c in sorted(c for c in want if c is not None) for i, t in enumerate(want[c])]
    for c in want:
        own = [r for r in rows if r.conv == c]
        assert [r.before for r in own] == [sum(len(t[1]) for t in want[c][:i]) for i in range(len(own))]
    assert found_trie(turns, convs) == plain_trie(want)
    none = prefix_trie.numbered(spark.createDataFrame([], TURNS))
    assert found_trie(*prefix_trie.with_shared_heads(none)) == [] == found_trie(none, prefix_trie.lengths(none))


def test_only_empty_conversations(spark):
    """A turnless conversation is the root alone."""
    rows = [(c, 0, "user", "x", None, None, None) for c in (3, 2)]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, TURNS))
    convs = prefix_trie.lengths(turns).select("conv", F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("total"))
    assert found_trie(turns.limit(0), convs) == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,3").hexdigest())]


def test_long_conversations_are_numbered_in_ranges(spark):
    """One conversation of most rows lies in several ranges and still counts its turns through."""
    rows = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    turns = prefix_trie.numbered(rows)
    long = turns.filter("conv = 5").orderBy("pos").collect()
    assert [r.pos for r in long] == list(range(3600)) and len({r.part for r in long}) > 1
    assert long[-1].before + long[-1].chars == sum(len(f"t{i}") for i in range(4000) if i % 10)
    assert prefix_trie.trie(turns, prefix_trie.lengths(turns)).count() == 1 + 3600 + 400


# language identification

DOCS = "doc_id bigint, text string, lang string, source string, held_out string, u string, label string, name string"


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = "Ünïcode wörds, 123 und_mehr  — 中文 ẞ\x00 end " * 40
    whole = np.sort(np.concatenate([g for g, _ in language.grams(text.encode(), 1 << 16)]))
    for piece in (7, 50, 333):
        monkeypatch.setattr(language, "PIECE", piece)
        parts = [g for g, _ in language.grams(text.encode(), 1 << 16)]
        assert len(parts) > 1 and (np.sort(np.concatenate(parts)) == whole).all()
    assert list(language.grams(b"123 ,.\n", 99)) == [] == list(language.grams(b"", 99))
    assert sum(len(g) for g, _ in language.grams(("中" * 5000).encode(), 99)) > 5000


def test_grams_are_plain_ngrams():
    """The n-grams of each word with a space on either side, the space alone left out."""
    text = "Ab c-de"
    words = [f" {w} " for w in ("ab", "c", "de")]
    want = sum(sum(w[i : i + n] != " " for i in range(len(w) - n + 1)) for w in words for n in (1, 2, 3))
    (found, letter), = language.grams(text.encode(), 1 << 20)
    assert letter and len(found) == want
    one, two = (dict(Counter(np.concatenate([g for g, _ in language.grams(t.encode(), 1 << 20)]).tolist())) for t in ("de c ab", text))
    assert one == two


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in Q.op12_language(spark, SMALL).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == held(k) and 0 <= r.score <= 1 for k, r in got.items())
    tested = [k for k in got if held(k)]
    right = [got[k].lang_pred == truth[k].lang for k in tested]
    assert len(tested) > 100 and np.mean(right) >= 0.98
    assert abs(np.mean([got[k].score for k in tested]) - np.mean(right)) < 0.05


def test_only_learned_rows_are_read(spark):
    """Labels of held-out rows change nothing, nor do other columns, and a second run gives the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    found = []
    for df in (docs, spoilt.repartition(5)):
        model = language.train(df.filter(~language.held_out(df["doc_id"])))
        found.append({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.predict(df, model).collect()})
    assert found[0] == found[1] and "xx" not in {v[0] for v in found[0].values()}


def test_languages_of_hard_rows(spark):
    train = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", *["x"] * 5) for i in range(60)]
    model = language.train(spark.createDataFrame(train, DOCS))
    assert model.names == ("de", "en") and (model.weights == 0).mean() > 0.9
    rows = [(1, None, None), (2, "", "en"), (3, " 123 ,.;\n²½", "en"), (None, "THE CAT", None), (4, "der hund " * 100_000, None), (5, "the dog\x00", "en"), (5, "the dog\x00", "en"), (6, "中文", None)]
    df = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], DOCS)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert language.predict(df, model).count() == len(rows)
    assert all(got[k][1:] == ("und", 0.0) for k in (1, 2, 3))
    assert got[None][1] == "en" and got[None][0] and got[4][1] == "de" and got[5][1] == "en" and got[6][1] in ("de", "en")
    assert all(0 < got[k][2] <= 1 for k in (None, 4, 5, 6))
    for nothing in (df.limit(0), df.filter("lang IS NULL"), df.filter("doc_id IN (1, 2, 3)")):
        out = language.predict(df, language.train(nothing)).collect()
        assert len(out) == len(rows) and all(r.lang_pred in ("und", "en") for r in out)
    assert not language.predict(df.limit(0), model).count()


def test_many_languages(spark, monkeypatch):
    """More labels take fewer buckets, and labels beyond the bound are not learned."""
    monkeypatch.setattr(language, "MAX_CELLS", 300)
    monkeypatch.setattr(language, "MAX_LANGS", 3)
    rows = [(i, "abc " * (1 + i % 7), f"l{i % 5}", *["x"] * 5) for i in range(43)]
    model = language.train(spark.createDataFrame(rows, DOCS))
    assert model.names == ("l0", "l1", "l2") and len(model.idf) == 100


def test_steps_are_the_published_rule():
    """Weights from the state, and one step, by the formulas for a single coordinate."""
    rng = np.random.default_rng(0)
    z, n = rng.normal(size=(5, 3)), rng.random((5, 3))
    w = language.leader(z, n)
    for i, k in np.ndindex(z.shape):
        want = 0.0 if abs(z[i, k]) <= language.L1 else -(z[i, k] - np.sign(z[i, k]) * language.L1) / ((language.BETA + n[i, k] ** 0.5) / language.ALPHA + language.L2)
        assert w[i, k] == pytest.approx(want)
    at, x = np.array([1, 4]), np.array([0.5, 1.0])
    p = np.exp(x @ w[at]) / np.exp(x @ w[at]).sum()
    before_z, before_n = z.copy(), n.copy()
    language.learn(z, n, at, x, 2)
    for j, i in enumerate(at):
        for k in range(3):
            g = (p[k] - (k == 2)) * x[j]
            sigma = ((before_n[i, k] + g * g) ** 0.5 - before_n[i, k] ** 0.5) / language.ALPHA
            assert z[i, k] == pytest.approx(before_z[i, k] + g - sigma * w[i, k]) and n[i, k] == pytest.approx(before_n[i, k] + g * g)
    assert (z[[0, 2, 3]] == before_z[[0, 2, 3]]).all()


# importance resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


def runs(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]).encode() for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_ranks(docs, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    features = [[zlib.crc32(f) % buckets for f in runs(t, most)] for _, t in docs]
    s, t = Counter(b for f in features for b in f), Counter(zlib.crc32(f) % buckets for x in target for f in runs(x, most))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for (key, text), f in zip(docs, features, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        name = key if key is not None else hashlib.md5((text or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(out, docs, strict=True) if len(words(text)) >= least]
    for k, r in enumerate(sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


def resampled(df, target, **how):
    return sorted((tuple(r) for r in importance.resample(df, target, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


KINDS = "doc_id bigint, text string, score string, weight string, rank string, place string, n_words string"


@pytest.mark.parametrize("how", [{}, {"max_run": 3, "buckets": 97, "percent": 37, "min_words": 2}, {"percent": 100, "min_words": 0}, {"percent": 0}, {"max_run": 2, "buckets": 1, "percent": 50, "min_words": 5}])
def test_resampling(spark, how):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, None), (None, "w " * 30), (None, "w " * 30), (3, ""), (-5, "A\x00b É中 " * 40), (7, "same words " * 20), (7, "same words " * 20), (8, "x1 y2 " * 60_000)]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame([(*d, *["x"] * 5) for d in docs], KINDS).repartition(7)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    want = plain_ranks(docs, target, *(how.get(k, v) for k, v in (("max_run", 1), ("buckets", 10_000), ("percent", 10), ("min_words", 20))))
    assert resampled(df, goal, **how) == want


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 20, *["x"] * 5)], KINDS)
    goal = spark.createDataFrame([("a",)], "text string")
    assert resampled(df.limit(0), goal) == []
    assert resampled(df, goal.limit(0), percent=100) == plain_ranks([(1, "a b " * 20)], [], percent=100)
    assert [r[4] for r in resampled(df, goal)] == [None]


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = ("some Words, and-more 中文 x_y " * 30).encode()
    known = importance.Buckets(997)
    whole = [(n, sorted(f)) for n, f in importance.feature_buckets(text, known, 3)]
    for piece in (1, 10, 100):
        monkeypatch.setattr(importance, "PIECE", piece)
        parts = list(importance.feature_buckets(text, known, 3))
        assert len(parts) > 1 and sum(n for n, _ in parts) == whole[0][0] and sorted(b for _, f in parts for b in f) == whole[0][1]


def test_the_draw_in_ranges_and_chunks(spark):
    """Small ranges and chunks over many partitions, many equal scores: exact ranks, and the last range stops inside a tie."""
    rng = np.random.default_rng(1)
    rows = [(int(i), 30 if rng.random() < 0.8 else 3, int(rng.integers(1, 9)), int(rng.integers(-5, 5)), int(rng.integers(0, 12))) for i in range(600)]
    rows += [(None, 30, 1, 1, 5), (None, 30, 1, 1, 5), (4, 30, 2, 2, 11), (4, 30, 1, 2, 11)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(9)
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for percent, range_rows, chunk in ((10, 7, 3), (35, 50, 1), (90, 1000, 64), (100, 13, 5)):
        n = percent * len(able) // 100
        got = importance.draw_ranks(df, percent, 20, range_rows=range_rows, chunk=chunk).collect()
        assert len(got) == len(rows)
        drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, n + 1))
        assert [(r.doc_id, r.n_features, r.weight, r.score) for r in drawn] == [(r[0], *r[2:]) for r in able[:n]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=12), max_size=40), st.integers(0, 200))
def test_merged_runs(runs, n):
    """Chunks in the order of their heads: the n smallest in order, then all the others."""
    chunks = sorted((sorted((v, k) for k, v in enumerate(r)) for r in runs), key=lambda c: c[0])
    merge = importance.Merge(iter(chunks))
    want = list(heapq.merge(*chunks))
    first = list(merge.take(n))
    assert first == want[:n] and sorted(merge.rest()) == sorted(want[n:])


# long inputs of earlier operators


def test_deep_pages_take_linear_time():
    from pixelloom.llm import html_text

    n = 30_000
    began = time.perf_counter()
    text = html_text.main_text("".join(f"<div>some words here {i}" for i in range(n)))
    assert len(text.split()) == 4 * n and time.perf_counter() - began < 10
    assert html_text.main_text("<form>" * n + "<p>A text of some words that is long enough to stay." + "<article>" * n) != ""


def test_long_texts_are_counted_in_pieces(monkeypatch):
    """The same fingerprints, sets and bands whatever the pieces; and bounded memory for a long text."""
    import tracemalloc

    from pixelloom.llm import simhash

    texts = [None, b"", b" \t\n", b"one", b"one two", b"A b\x0bC d\te " * 50, b"x" * 500, " é中 w".encode() * 90]
    whole = [simhash.shingles(t, 3) for t in texts], simhash.fingerprints_of(texts).tolist(), [simhash.shingle_set(t).tolist() for t in texts]
    sets = [s for s in map(simhash.shingle_set, texts) if len(s)]
    prints = simhash.prints_of(sets)
    for piece, counted in ((1, 1), (7, 3), (100, 64)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "COUNTED", counted)
        assert whole == ([simhash.shingles(t, 3) for t in texts], simhash.fingerprints_of(texts).tolist(), [simhash.shingle_set(t).tolist() for t in texts])
        assert (simhash.prints_of(sets) == prints).all()
    monkeypatch.undo()
    long = b"".join(b"word%d " % (i % 5000) for i in range(2_000_000))
    tracemalloc.start()
    simhash.fingerprints_of([long])
    assert tracemalloc.get_traced_memory()[1] < 4 * len(long) + (200 << 20)
    tracemalloc.stop()


def test_a_message_of_megabytes_folds(spark):
    from pixelloom.llm import chat

    text = "".join(f"Zeile {i} é\n" for i in range(300_000))
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    folded = chat.fold(chat.streamed(chat.events_of(rows)))
    got = {(r.conv_id, r.turn): r.text for r in folded.collect()}
    assert got == {(1, 1): "hi", (1, 2): text, (2, 1): ""} and time.perf_counter() - began < 60
