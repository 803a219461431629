"""Each operator against a plain version, its SQL, or an exact round trip; and its edge cases."""

from __future__ import annotations

import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelloom.llm import bpe, chat, decontamination, html_text, license_rules, licenses, line_dedup, mixing, oracles, quality, simhash, token_files
from pixelloom.llm import queries as Q
from pixelloom.llm.pieces import pieces
from pixelloom.session import shared_dir
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, h string, fp string, size string, __k0 string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
HARD = [
    (1, None, "en", "a", None, "x", "x", "x", "x", "x"),
    (2, "", "en", None, 0, "x", "x", "x", "x", "x"),
    (3, " \t\n\x0b\f\r ", None, "a", 7, None, None, None, None, None),
    (4, "Word", "en", "b", 4, "x", "x", "x", "x", "x"),
    (5, PASSAGE.upper() + " É é K licence All-Rights_Reserved.", "en", "b", 1, "x", "x", "x", "x", "x"),
    (5, PASSAGE.upper() + " É é K licence All-Rights_Reserved.", "en", "b", 1, "x", "x", "x", "x", "x"),
    (None, "no id here at all " * 9, "en", "c", 1, "x", "x", "x", "x", "x"),
    (None, None, None, None, None, None, None, None, None, None),
    (7, LONG, "en", "c", len(LONG), "x", "x", "x", "x", "x"),
    (8, "a b c d e f g h " * 40 + "\nx\nx\nx\nx", "en", "c", 1, "x", "x", "x", "x", "x"),
    (9, "GPL-3.0 and CC BY 4.0; General Public License. cc by, CC-BY", "en", "c", 1, "x", "x", "x", "x", "x"),
    (10, "<|endoftext|> 中文 \U0001f600  two  spaces nbsp <|im_start|>", "en", "d", 1, "x", "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_low(text):
    return (text or "").encode().lower().decode()


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_low(text))


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_sql(spark, name):
    assert assert_same(Q.QUERIES[name](spark, SF), oracles.SQL[name], SF)


# license scan


def test_rules_are_sound():
    rules = license_rules.parsed()
    assert len(rules) >= 200 and len(set(rules)) == len(rules)
    for priority, _, keyword, regex in rules:
        assert priority in license_rules.CONFIDENCE
        needed = re.sub(r"\([^()]*\)\?", "", regex)
        for option in re.split(r"\|(?![^()]*\))", needed[len(r"\b(?:") : -len(r")\b")]):
            assert any(a in option for a in license_rules.ANCHORS) or re.search(license_rules.CC_ANCHOR, option), regex
            assert keyword in option, (keyword, regex)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("All rights reserved.", "reserved"),
        ("tall rights reserved; écc by", ""),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ],
)
def test_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().labels == labels


def test_license_bases_by_hand(spark, hard):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    rows = licenses.scan(hard).collect()
    want = []
    for d in HARD:
        w = alnum(d[1])
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want.append((d[0], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter(want)
    for r in rows:
        kept = r.detections
        assert all(not (b.first <= a.first and b.last >= a.last and b.priority <= a.priority) for a in kept for b in kept if a is not b)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def plain_unsuppressed(found):
    return [a for a in found if not any(b["first"] <= a["first"] and b["last"] >= a["last"] and b["priority"] <= a["priority"] and b is not a and ((b["first"], b["last"]) != (a["first"], a["last"]) or (b["priority"], b["rule"]) < (a["priority"], a["rule"])) for b in found)]


def test_many_matches_in_a_long_text(spark):
    """A megabyte with 50,000 matches of the bases, in seconds; and every place of a shorter one."""
    piece = "cc by gpl words all rights reserved general public license mit license "
    began = time.monotonic()
    r = licenses.scan(spark.createDataFrame([(1, piece * 17_000)], "doc_id bigint, text string")).first()
    assert time.monotonic() - began < 60
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (12 * 17_000, 3 * 17_000, 0, 12 * 17_000 - 5)
    assert r.base_labels == "cc-by,gpl,reserved" and {"mit", "gpl", "cc-by"} <= set(r.labels.split(","))
    assert len(r.detections) == 5 * 17_000
    text = piece * 7 + "licensed under the gnu general public license version 3 or later"
    rules = [{"first": len(text[: m.start()].split()), "last": len(text[: m.end()].split()) - 1, "priority": p, "rule": i} for i, (p, _, keyword, regex) in enumerate(license_rules.parsed()) if keyword in text for m in re.finditer(regex, text)]
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().detections
    assert [(d.first, d.last, d.rule) for d in got] == sorted((d["first"], d["last"], d["rule"]) for d in plain_unsuppressed(rules))


# mixing


def fill(sizes, weights, cap):
    target, open_, total = {}, dict(sizes), sum(sizes.values())
    while open_:
        share = sum(weights[s] for s in open_)
        over = [s for s in open_ if total * weights[s] > cap * sizes[s] * share]
        if not over:
            return target | {s: total * weights[s] / share for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            total -= target[s]
            del open_[s]
    return target


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
def test_targets(spark, amounts):
    rows = [(f"s{i}", n) for i, n in enumerate(amounts)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = fill(dict(rows), {s: 1 + i % 3 for i, (s, _) in enumerate(rows)}, 3)
    assert got == pytest.approx(want)


def test_mix_counts(spark, hard):
    taken = mixing.allot(hard).collect()
    assert len(taken) == len(HARD)
    assert all(0 <= r["__copies"] <= 3 for r in taken)
    assert mixing.mix(hard).count() == sum(r["__copies"] for r in taken)
    assert mixing.mix(hard).columns == hard.columns


def test_salted_join_equals_broadcast(spark, hard, monkeypatch):
    one = sorted(mixing.allot(hard).collect(), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(mixing.allot(hard).collect(), key=str) == one


def test_targets_beyond_64_bits(spark):
    """Words by weights pass 2^63 here."""
    weights, rows = (1_000_000, 2_000_000, 3_000_000), [(f"s{i}", n * 10**11) for i, n in enumerate((1000, 30, 500, 7, 1000))]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint"), weights, 6_000_000).collect()}
    want = fill(dict(rows), {s: weights[i % 3] for i, (s, _) in enumerate(rows)}, 3)
    assert got == pytest.approx(want) and any(want[s] == 3 * n for s, n in rows) and any(want[s] < 3 * n for s, n in rows)


# token counts and token files

ODD = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "B", "é", "<|endoftext|>", "'s", "'", "1", "½", "\x1c", "\x85", "\xa0", "　", "中", "😀", ".", "!!", "the", "́", "\r\n", "_", "​", "٣", "ünder", ",", " ", "᠎"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_token_counts(text):
    assert bpe.counter(VOCABULARY).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert "".join(pieces(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_encoder(text):
    encode = token_files.encoder(VOCABULARY)
    assert np.frombuffer(encode.encode([text])[0], encode.kind).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_new_words_go_to_the_library_together():
    """Words not met before cost one call for all of a batch, and have the ids that the library gives them in their text."""
    encoder = token_files.Encoder(VOCABULARY)
    library, seen = encoder.library, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **more)

    encoder.library = Counted()
    odd = ["\x1c", "\t", "\u00a0", "\u3000", "\x85", "é", "<|endoftext|>", "a<|endoftext|>b", "\u0120", "12", "don't", "x.", "?!"]
    texts = [" ".join(f"w{i}x{i * i}" for i in range(2000)), *(f"a{i} {o} {o}b b{o} {o}{o}{i}" for i in range(20) for o in odd)]
    kind = encoder.kind
    assert [np.frombuffer(x, kind).tolist() for x in encoder.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) < 1000
    # a vocabulary whose ids do not tell where words begin
    encoder = token_files.Encoder(VOCABULARY)
    encoder.spaced[:] = False
    assert [np.frombuffer(x, kind).tolist() for x in encoder.encode(texts[1:])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[1:]]


def test_long_word():
    text = "ab" * 50_000
    assert bpe.counter(VOCABULARY).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_tables(spark, hard):
    for df in (hard, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = Counter((k, len(t.encode()), n := len(LIBRARY.encode(t, add_special_tokens=False).ids), n > 512) for k, t in texts)
        assert Counter(map(tuple, bpe.count_tokens(df, VOCABULARY).collect())) == want


@pytest.mark.parametrize("length", [16, 2048])
def test_files_hold_the_ids(spark, hard, length):
    for df in (hard, spark.read.parquet(f"{SF}/documents.parquet")):
        manifest = token_files.write_files(df, VOCABULARY, length=length)
        got = sorted(token_files.read_documents(spark, manifest).collect(), key=lambda r: r.start)
        texts = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        start, want, stream = 0, [], []
        for r in sorted(texts, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
            ids = [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
            stream += ids
        assert list(map(tuple, got)) == want
        held = []
        for f in manifest:
            reader = token_files.Reader(f["path"])
            for i in range(-(-f["tokens"] // length)):
                ids, mask = reader.sequence(i)
                assert len(ids) == length == 8 * len(mask)
                assert not ids.flags.owndata and not mask.flags.owndata
                held += ids[token_files.unpacked(mask)].tolist()
        assert held == stream


def test_files_end_at_their_bound(spark, hard):
    """Many files in a part, the same rows read back."""
    want = sorted(map(tuple, token_files.read_documents(spark, token_files.write_files(hard, VOCABULARY)).collect()), key=str)
    manifest = token_files.write_files(hard, VOCABULARY, length=16, file_ids=1)
    assert len(manifest) == len(HARD)
    assert sorted(map(tuple, token_files.read_documents(spark, manifest).collect()), key=str) == want
    with pytest.raises(ValueError):
        token_files.Writer("/tmp/none.arrow", pa.int64(), np.dtype("u2"), 12)


# simhash


def plain_print(text):
    w = ascii_low(text).encode().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    all_ = sorted(root)
    for i, a in enumerate(all_):
        for b in all_[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return find


def check_classes(rows, got):
    find = plain_components([p for _, p in rows])
    low = defaultdict(list)
    for k, p in rows:
        if k is not None:
            low[find(p)].append(k)
    want = Counter((k, p, min(low[find(p)], default=None)) for k, p in rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_classes(spark, hard):
    for df in (hard, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, plain_print(r.text)) for r in df.collect()]
        check_classes(rows, simhash.near_duplicates(df).collect())


@pytest.mark.parametrize("tile", [8, 2048])
def test_planted_links(spark, monkeypatch, tile):
    """Chains, stars and far strangers among fingerprints; with tiny tiles the buckets are dealt out."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "FLUSH", 64)
    rng = np.random.default_rng(3)
    prints = []
    for _ in range(12):
        p = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            prints.append(p)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                p ^= 1 << int(b)
    hub = int(rng.integers(0, 1 << 63))
    prints += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5) if a != b]
    rows = [(i, p) for i, p in enumerate(prints)]
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in rows], "doc_id bigint, fp bigint")
    classes = simhash.classes_of(df, 3, "doc_id")
    check_classes(rows, df.join(classes, "fp").collect())


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)]
    fp = np.unique(np.concatenate([base, *near]))
    end = np.minimum(np.arange(len(fp)) // 70 * 70 + 70, len(fp))
    got = {(a, b) for p, q in simhash.sliced_links(fp, np.arange(len(fp)) + 1, end, radius, 50) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(fp)) for j in range(i + 1, int(end[i])) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}


@pytest.mark.parametrize("seed", range(8))
def test_leaders_lose_no_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 10)
    rng = np.random.default_rng(seed)
    words, radius = int(rng.integers(1, 5)), int(rng.integers(0, 12))
    centres = rng.integers(0, 2**63, (4, words)).astype(np.uint64)
    fp = centres[rng.integers(0, 4, 300)].copy()
    for row in fp:
        for b in rng.integers(0, 64 * words, rng.integers(0, radius + 2)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fp = rng.permutation(np.unique(fp, axis=0))
    group = np.sort(rng.integers(0, 3, len(fp)))
    u, v = simhash.spanning_links(np.arange(len(fp)), fp, group, radius)
    near = np.argwhere((np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= radius) & (group[:, None] == group[None]))
    label = np.arange(len(fp))
    assert (simhash.unite(label.copy(), near[:, 0], near[:, 1]) == simhash.unite(label.copy(), u, v)).all()


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**13])
def test_cuts_find_all(n):
    cut = simhash.masks(3, simhash.blocks_for(n, 3))
    rng = np.random.default_rng(1)
    for _ in range(500):
        d = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(d & m == 0 for m in cut)


def test_rounds_of_components_are_few_tasks(spark):
    """A round's shuffles are fed by as many tasks as its links need, not by a task for each shuffle partition."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    chain = [(i, i + 1) for i in range(64)] + [(100, 101), (100, 102), (101, 102), (7, 7)]
    try:
        for k, v in zip(held, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("rounds", "rounds")
        roots = {r.node: r.root for r in simhash.connected(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds}
        tasks = [x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert roots == {i: 0 for i in range(1, 65)} | {101: 100, 102: 100}
    assert max(tasks) <= 80  # a table's 64 and the 8 or 16 of one before it


def test_keep_one(spark, hard):
    groups = exact_groups([d[1] for d in HARD])
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    at = {(d[0], d[1]): g for d, g in zip(HARD, groups, strict=True)}
    assert sorted(at[r.doc_id, r.text] for r in kept.collect()) == sorted(set(groups))
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 7, 8, 9, 10}


@pytest.mark.parametrize("tile", [16, 2048])
def test_similar_texts_go_and_others_stay(spark, monkeypatch, tile):
    """Of texts with planted edits those similar to at least 0.8 are caught but for a few; strangers all stay."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows, near, part = [], [], []
    for g in range(40):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        rows.append((100 * g, " ".join(base)))
        edited = list(base)
        for i in rng.choice(len(base), max(1, len(base) // 60), replace=False):
            edited[i] = word()
        near.append(100 * g + 1)
        rows.append((100 * g + 1, " ".join(edited)))
        part.append(100 * g + 2)
        rows.append((100 * g + 2, " ".join(base[: len(base) // 3] + [word() for _ in base])))
    hub = [word() for _ in range(300)]
    for k in range(60):
        copy = list(hub)
        copy[k * 3] = word()
        rows.append((10_000 + k, " ".join(copy)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {100 * g for g in range(40)} | set(part) <= kept
    assert len(kept & set(near)) <= 2
    assert {k for k in kept if k >= 10_000} == {10_000}


def exact_groups(texts, similarity=0.8):
    """The root of each text's component: links are pairs of sets of five-word shingles with that Jaccard similarity."""
    sets = [frozenset(simhash.shingles((t or "").encode(), 5)) for t in texts]
    root, on = list(range(len(sets))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        common = Counter(j for s in a for j in on[s])
        for j in [j for j, n in common.items() if n / (len(a) + len(sets[j]) - n) >= similarity] + ([] if a else [j for j in range(i) if not sets[j]]):
            root[max(find(i), find(j))] = min(find(i), find(j))
        for s in a:
            on[s].append(i)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("sf", "tile"), [("sf0.001", 2), ("sf0.01", 2048)])
def test_keep_one_is_exact_on_tables(spark, monkeypatch, sf, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, df.collect()))
    first = {}
    for (k, _), g in zip(rows, exact_groups([t for _, t in rows]), strict=True):
        first.setdefault(g, k)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(first.values())


def test_threshold_is_exact(spark):
    """Two sets of 9 n shingles that share 8 n are linked, those that share one less are not; at few and at many words."""
    rows = []
    for n in (1, 2, 5, 40):
        for g in range(10):
            words = [f"g{g}n{n}w{i}" for i in range(9 * n + 4)]
            for k, shared in enumerate((9 * n, 8 * n)):
                rows.append((1000 * n + 10 * g + k, " ".join(words[: shared + 4] + [f"x{k}{w}" for w in words[shared + 4 :]])))
            rows.append((1000 * n + 10 * g + 5, " ".join([f"y{w}" for w in words])))
            rows.append((1000 * n + 10 * g + 6, " ".join([f"y{w}" for w in words[: 8 * n + 3]] + [f"z{w}" for w in words[8 * n + 3 :]])))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {k for k, _ in rows if k % 10 != 1}


def test_recall_and_precision_around_the_threshold(spark):
    """Pairs of texts with scattered edits: of those similar to 0.80 to 0.82 at least nine in ten are found, of those below 0.8 none."""
    rng = np.random.default_rng(11)
    rows, pairs = [], {}
    for g in range(400):
        base = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(100, 600)))]
        edited = list(base)
        for i in rng.choice(len(base), max(1, int(len(base) * rng.uniform(0.012, 0.05))), replace=False):
            edited[i] = f"e{rng.integers(0, 50_000)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, edited))
        pairs[g] = len(a & b) / len(a | b)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [g for g, j in pairs.items() if 0.8 <= j < 0.82]
    assert len(near) >= 15
    assert sum(2 * g + 1 not in kept for g in near) >= 0.9 * len(near)
    assert all(2 * g + 1 in kept for g, j in pairs.items() if j < 0.8)


def test_wide_prints():
    """Bits are majorities over the set; equal sets have equal prints and the expectation bounds the distance of similar ones."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 3000):
        whole = np.unique(rng.integers(0, 1 << 63, 9 * n, dtype=np.uint64))
        part = whole[rng.permutation(len(whole))[: 8 * n]]
        a, b, c = simhash.prints_of([whole, np.sort(part), whole.copy()])
        assert (a == c).all()
        if n >= 40:
            assert np.bitwise_count(a ^ b).sum() <= simhash.wide_radius(8 / 9)


@pytest.mark.parametrize("clusters", [1, 5])
def test_large_families_are_dealt_out(spark, monkeypatch, clusters):
    """A family far above a tile: near copies of one text, or of several that overlap."""
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "LEADERS", 3)
    rng = np.random.default_rng(clusters)
    rows, base = [], [f"w{i}" for i in range(200)]
    for c in range(clusters):
        own = base[: 200 - 30 * c] + [f"c{c}w{i}" for i in range(30 * c)]
        for k in range(40):
            copy = list(own)
            for i in rng.choice(200, k % 6, replace=False):
                copy[i] = f"x{c}{k}{i}"
            rows.append((100 * c + k, " ".join(copy)))
    first = {}
    for (k, _), g in zip(rows, exact_groups([t for _, t in rows]), strict=True):
        first.setdefault(g, k)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


# decontamination

ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "zero " + PASSAGE + " thirteen"), (3, "word"), (4, None), (5, ""), (None, PASSAGE), (6, "h a b c d e f g h a b c"), (7, "no such window in any of the given documents")]


def plain_hits(docs, items):
    out = []
    for k, text in docs:
        w, hit, ids = alnum(text), set(), set()
        for item, t in items:
            x = alnum(t)
            n = min(10, len(x))
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    if item is not None:
                        ids.add(str(item))
        out.append((k, len(w), len(hit), tuple(sorted(ids))))
    return Counter(out)


@pytest.mark.parametrize("bounds", [(10**6, 0), (0, 10**6), (0, 0)])
def test_hits(spark, hard, monkeypatch, bounds):
    monkeypatch.setattr(decontamination, "HOT", 3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.hits(hard, items, broadcast_bytes=bounds[0], prefix_bytes=bounds[1]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == plain_hits([d[:2] for d in HARD], ITEMS)
    kept = decontamination.keep_clean(hard, items)
    assert kept.columns == hard.columns
    assert kept.count() == sum(n for (_, _, hit, _), n in plain_hits([d[:2] for d in HARD], ITEMS).items() if not hit)


# quality


def plain_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    rep = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality(spark, hard):
    got = Counter(tuple(r)[:7] for r in quality.score(hard).collect())
    assert got == Counter((d[0], *plain_quality(d[1])) for d in HARD)


def test_order_changes_no_verdict(spark, hard):
    texts = [d[1].encode() if d[1] is not None else None for d in HARD]
    order = quality.plan(quality.measured(texts))
    assert set(quality.planned(hard)) == set(quality.RULES)
    assert set(order) == set(quality.RULES)
    verdict = [quality.passes(t, order) for t in texts]
    assert verdict == [quality.passes(t, order[::-1]) for t in texts]
    kept = quality.keep_good(hard)
    assert kept.columns == hard.columns and kept.count() == sum(verdict)


def test_cheap_and_selective_first():
    rules = (quality.Rule("slow", lambda t: bool(sum(range(20_000))) and False), quality.Rule("sharp", lambda t: True))
    assert [r.name for r in quality.plan(quality.measured([b"x"] * 20, rules), rules)] == ["sharp", "slow"]


def test_labelled_documents(spark):
    """Documents labelled good stay; junk goes more often than not."""
    con = duck("/root/testdata/sf0.1")
    rows = con.sql("SELECT text, quality FROM documents JOIN labels USING (doc_id)").fetchall()
    kept = defaultdict(list)
    for text, good in rows:
        kept[good].append(quality.passes((text or "").encode(), quality.RULES))
    print({k: sum(v) / len(v) for k, v in kept.items()})
    assert sum(kept[1]) / len(kept[1]) > sum(kept[0]) / len(kept[0])


# line dedup

LINK = "<p>A long sentence to read <a href='x'>here</a> &amp; <B>then</B> go\non&nbsp;with &lt;it&gt;</p>"
SITES = [(1, "http://A.com/x", "<p>menu</p><p>one</p>"), (2, "http://u@a.com:80/y", "menu<br>two  \t words"), (3, "https://a.com?q", "<div>menu</div><script>var menu</script>three"), (3, "https://a.com?q", "<div>menu</div><script>var menu</script>three")]
SITES += [(4, "http://b.com", "menu"), (5, "http://b.com", "menu"), (6, None, None), (None, "nonsense", "menu"), (7, "http://c.com", ""), (8, "http://c.com", "<!-- x -->  "), (9, "http://d.com", "<p>" + LONG), (10, "http://e.com", LINK), (11, "http://e.com", LINK + "<td>other")]
SITES += [(100 + i, "http://f.com", f"<p>page {i}" + "<p>ten of seventy" * (i < 10) + "<p>nine of seventy" * (i < 9)) for i in range(70)]


class PlainLines(HTMLParser):
    """Lines by the events of the standard library's parser."""

    INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.silent = [""], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.lines.append("")
        self.silent = tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.lines.append("")
        self.silent = False

    def handle_comment(self, data):
        self.lines.append("")

    def handle_decl(self, decl):
        self.lines.append("")

    def handle_data(self, data):
        if not self.silent:
            self.lines[-1] += data


def plain_lines(rows):
    pages = []
    for key, url, page in rows:
        host = re.match(line_dedup.HOST, (url or "").lower())
        pages.append((key, host[1] if host else "", [x for x in (" ".join(y.replace("\xa0", " ").split()) for y in PlainLines(page or "").lines) if x]))
    total = Counter(h for _, h, _ in pages)
    on = Counter((h, x) for _, h, lines in pages for x in set(lines))
    out = []
    for key, host, lines in pages:
        kept = [x for x in lines if not (on[host, x] >= 2 and on[host, x] > 0.5 * total[host] or on[host, x] >= 10 and on[host, x] > 0.1 * total[host])]
        out.append((key, host, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_inline_tags_end_no_line(spark):
    """A link that all pages of a host have stays in their different sentences; the block that is the same goes."""
    rows = [(i, "http://e.com", f"<div>home</div><p>Sentence {i} has a <a href=x>here</a> in it.</p>") for i in range(4)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.n_dropped for r in got} == {1}
    assert {r.text for r in got} == {f"Sentence {i} has a here in it." for i in range(4)}


def test_lines_of_tables(spark):
    """All pages against the parser's lines; references that the operator leaves as written are decoded for it."""
    df = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in df.collect()]
    got = Counter((*r[:4], html.unescape(r.text).replace("\xa0", " ")) for r in line_dedup.drop_boilerplate(df).collect())
    assert got == plain_lines(rows)


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_lines(spark, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([(*r, "x", "x") for r in SITES], "page_id bigint, url string, html string, host string, lines string")
    got = Counter(map(tuple, line_dedup.drop_boilerplate(df).collect()))
    assert got == plain_lines(SITES)
    assert sum(r[3] * n for r, n in got.items()) == 18
    assert line_dedup.drop_boilerplate(df.limit(0)).collect() == []


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>if (a < b) x = "</p>";</script></head><body class="nav-open">
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">one</a><li><a href="/b">two</a></ul></nav><div class="cookie-notice">We use cookies and more cookies on this site for you.</div>
<div id="content"><article><h1>A &amp; B</h1><p>First   line of&nbsp;text with <b>bo</b>ld &lt;tag&gt;.<p>Tiny.<div class="ad">Buy this now</div><blockquote>Quoted
words</blockquote><ul><li>x<li>y</ul><form><input value=q><button>Send</button></form><p>Last &#233;&hellip;</p></article>
<aside>Other stories that you might like to read today</aside><div class="comments"><p>I think that this long comment is really long, longer than all.</p></div></div><!-- c --><footer>(c) me</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "A & B First line of text with bold <tag>. Tiny. Quoted words x y Last é…"
    assert html_text.main_text(PAGE.replace("article>", "div>")).startswith("A & B First line")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body class='has-sidebar'><div class='content-with-sidebar'><p>Kept text, and more of it here.</p></div><div id=sidebar>Not this one</div>", "Kept text, and more of it here."),
        ("<form id=f><div class=menu>a b c</div><main><h1>Head</h1><p>Kept text, and more of it here.</p></main></form>", "Head Kept text, and more of it here."),
        ("<article><p>Kept text.</p><p hidden>no</p><p style='display: none'>no</p><section class=comments><article class=comment><p>A reader says so, at length and with force.</p></article></section></article>", "Kept text."),
        ("<div><p>a&nbsp;b&#x41;&lt;c<p>d<br>e<i>f</i>g</div>", "a bA<c d efg"),
        ("<article><table><tr><td>x<td>y</table><pre>  z\n w </pre><ul><li>l<ul><li>m</ul></ul></article>", "x y z w l m"),
    ],
)
def test_regions(html, text):
    assert html_text.main_text(html) == text


ITEM = "<li>A long item of the list with a good many words in it.</li>"
PARA = "<p>Some paragraph of the text with a good many words in it.</p>"


@pytest.mark.parametrize(
    "html",
    [
        f"<div id=content><p>An intro to the list, in some words.</p><ul>{ITEM * 20}</ul><p>An outro to the list, in some words.</p></div>",
        f"<div>{PARA * 4}<section>{PARA * 7}</section></div>",
        f"<body><article>{PARA * 13}</article><article>{PARA * 7}</article></body>",
    ],
)
def test_region_is_whole(html):
    assert html_text.main_text(html) == " ".join(re.sub(r"<[^>]*>", " ", html).split())


@pytest.mark.parametrize("tag", ["article class='post category-legal'", "article class='hentry comments-open'", "html class='js sidebar-open'", "main id=main-search"])
def test_names_on_whole_elements(tag):
    assert html_text.main_text(f"<{tag}><p>Kept text, and more of it here.</p></{tag.split()[0]}>") == "Kept text, and more of it here."
    assert html_text.main_text(f"<{tag} hidden><p>Not this one.</p></{tag.split()[0]}>") == ""


KEPT = "The article has a sentence or two of a fair length, and they all stay. "
MORE = "Then another paragraph of the article follows, with as many words again."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # end tags that HTML lets out
        (f"<html><head><title>T</title><body><article><p>{KEPT}</article>", KEPT),
        (f"<html><head><title>T</title><div><p>{KEPT}</div>", KEPT),
        (f"<head><meta charset=utf-8>{KEPT}", KEPT),
        (f"<p class='cookie-notice'>We use cookies<div id=main><p>{KEPT}<p>{MORE}</div>", KEPT + MORE),
        (f"<div><ul><li>{KEPT}<li>{MORE}</ul></div>", KEPT + MORE),
        (f"<div><dl><dt>Term<dd>{KEPT}<dt>Other<dd>{MORE}</dl></div>", f"Term {KEPT}Other {MORE}"),
        (f"<div><table><tr><td>{KEPT}<td>b<tr><td>{MORE}</table></div>", f"{KEPT}b {MORE}"),
        (f"<div><p class=ad>Buy<h2>Head</h2><p>{KEPT}</div>", f"Head {KEPT}"),
        (f"<div><ul class=menu><li><a href=x>one</a><li><a href=y>two</a></ul><p>{KEPT}</div>", KEPT),
        (f"<body><p>{KEPT}</body></html><p>{MORE}", KEPT + MORE),
        (f"<table><tr><td></div><p>{KEPT}</td><td class=sidebar>x</table>", KEPT),
        # names
        (f"<div class='legal-news'><article><p>{KEPT}</article></div>", KEPT),
        (f"<div class='legal-news'><p>{KEPT}<p>{MORE}</div><div class=footer>Other words here</div>", KEPT + MORE),
        (f"<div><p>{KEPT}</p><div class='share no-print'>Share this now</div></div>", KEPT),
        (f"<div class='post comments-open'><p>{KEPT}</div>", KEPT),
        (f"<div class=widget><p>{KEPT}</div>", KEPT),
        (f"<div><p>{KEPT}</div><div class=comments><p>{KEPT * 9}</div>", KEPT),
        (f"<div class=comments><p>{KEPT}</div>", ""),
        (f"<div><p>{KEPT}<span class=ad>buy <span>now</span> cheap stuff</span> {MORE}</div>", KEPT + MORE),
        (f"<div id=siteHeader>Site name</div><p>{KEPT}", KEPT),
        (f"<div><p>{KEPT}</p><aside><p>{MORE}</aside></div>", KEPT),
        # a form that holds most of the text is the page
        (f"<form><div><p>{KEPT}</div></form>", KEPT),
        (f"<div><p>{KEPT * 3}</div><form><p>{MORE}</form>", KEPT * 3),
        (f"<body><form id=aspnetForm><div class=nav>Home News</div><div id=content><p>{KEPT}<p>{MORE}</div></form></body>", KEPT + MORE),
        (f"<form><div>Some page</div><article><p>{KEPT}</article></form>", KEPT),
        (f"<body><div class='content ad-free'>{KEPT * 2}</div><p>Three short words</p></body>", f"{KEPT * 2}Three short words"),
        (f"<div class=elementor-widget>{KEPT * 3}</div><div class=elementor-widget>{KEPT * 2}</div><div class=elementor-widget>{MORE}</div>", KEPT * 5 + MORE),
        (f"<p>Three short words</p><div class=elementor-widget>{KEPT * 3}</div><div class=elementor-widget>{KEPT * 2}</div>", "Three short words " + KEPT * 5),
        (f"<div><p>{KEPT * 3}</div><div class=widget><p>{MORE}</div><div class=widget><p>{MORE}</div>", KEPT * 3),
        (f"<article><p class='lead header'>{MORE}</p><p>{KEPT}</article>", f"{MORE} {KEPT}"),
        # regions
        (f"<main><article><p>{KEPT * 3}</article><article><p>{MORE}</article></main>", KEPT * 3 + MORE),
        (f"<body><div><p>{KEPT * 3}</div><div><p>{MORE}</div></body>", KEPT * 3 + MORE),
        (f"<body><div><article><p>{KEPT * 3}</article></div><div><article><p>{MORE}</article></div></body>", KEPT * 3 + MORE),
        (f"<div><h1>Head</h1><section><p>{KEPT}</section><section><p>{MORE}</section></div>", f"Head {KEPT}{MORE}"),
        (f"<div><blockquote><p>{KEPT}</blockquote><p>Short.</div>", f"{KEPT}Short."),
    ],
)
def test_page_shapes(html, text):
    assert html_text.main_text(html) == " ".join(text.split())


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</div></p>", "<a><b></a>", "<![CDATA[", "&#xFFFFFFFF;"])
def test_odd_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_pages_against_their_markup(spark):
    """The generated pages have one article each; all its text comes out, and nothing else."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert html_text.main_text(r.html) == want


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", PAGE, None), (1, None, None, "x"), (2, "u", "<p>" + LONG, "x")], "page_id bigint, url string, html string, text string")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert [r.n_chars for r in got] == [0, 0, len(LONG), len(html_text.main_text(PAGE))]
    assert html_text.extract(pages.limit(0)).collect() == []


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "|", "[", "INST]", "/INST]", "</s>", "<s>", "<<SYS>>", chat.TURN, chat.TEXT, chat.END, "\n", "a", "é"]), max_size=10).map("".join))
def test_escape_round_trip(text):
    escaped = re.sub(chat.CONTROL, r"\\", text.replace("\\", "\\\\"))
    assert chat.unescaped(escaped) == text
    assert not any(c in escaped for c in (chat.TURN, chat.TEXT, chat.END.strip(), "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "a\\<|end|>\n<|turn|>user<|text|>x", "\\", "é😀", "<<SYS>>\\\\<|"]
    rows = [(c, i, r, t) for c in (1, None, 3) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "<|x") for t in texts)]
    rows += [(9, 0, "user", "tie"), (9, 0, "user", "tie"), (9, 0, "assistant", "b")]
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.events_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))))).collect()}
    for c in (1, None, 3, 9):
        said = sorted(((i, r or "", t or "") for k, i, r, t in rows if k == c))
        loss = "".join(t for _, r, t in said if r == "assistant")
        r = got[c]
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.render(chat.fold(chat.events_of(empty)))).collect() == []


def plain_fold(events):
    out = {}
    for _, turn, op, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2] or "", e[4] or "")):
        if op == "regenerate":
            for t in [t for t in out if t >= turn]:
                del out[t]
        old = out.get(turn, ("", ""))[1]
        out[turn] = (role or "", text or "" if op in ("edit", "regenerate") else old + (text or ""))
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["delta", "delta", "edit", "regenerate", None, "x"]), st.sampled_from(["user", "assistant", None]), st.sampled_from(["a", "b", "", None])), max_size=12))
def test_fold(spark, events):
    rows = [(5, seq, *e) for seq, e in enumerate(events)]
    df = spark.createDataFrame(rows, "conv_id bigint, seq bigint, turn bigint, op string, role string, text string")
    assert {r.turn: (r.role, r.text) for r in chat.fold(df).collect()} == plain_fold([r[1:] for r in rows])


def test_streamed_log_folds_to_its_messages(spark):
    """Long texts come in many deltas after a draft or an error; with clashing extra columns and ties."""
    texts = [LONG[:5000], "", None, "x" * 400, "y" * 401, "é😀" * 300]
    rows = [(c, i, r, t, 1, "x") for c in (1, None) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", None) for t in texts)]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id bigint, turn bigint, role string, text string, seq bigint, op string")
    log = chat.events_of(df)
    events = chat.streamed(log)
    assert {r.op for r in events.select("op").distinct().collect()} == {"delta", "edit", "regenerate"}
    assert events.count() > 3 * log.count()
    assert Counter(map(tuple, chat.fold(events).collect())) == Counter(map(tuple, chat.fold(log).collect()))


# empty tables, and the pipeline


def test_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert licenses.scan(empty).collect() == []
    assert mixing.allot(empty).collect() == []
    assert bpe.count_tokens(empty, VOCABULARY).collect() == []
    assert token_files.write_files(empty, VOCABULARY) == []
    assert token_files.read_documents(spark, []).collect() == []
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []
    assert quality.score(empty).collect() == []
    assert quality.keep_good(empty).collect() == []
    assert decontamination.hits(empty, items).collect() == []
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.hits(spark.createDataFrame(HARD, SCHEMA), no_items).count() == len(HARD)


def test_pipeline(spark):
    """run() against its stages in plain Python."""
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {k: r for k, r in docs.items() if not any(rule.rejects(quality.Text((r.text or "").encode())) for rule in quality.RULES)}
    groups = dict(zip(kept, exact_groups([r.text for r in kept.values()]), strict=True))
    first = {}
    for k in sorted(kept):
        first.setdefault(groups[k], k)
    kept = {k: kept[k] for k in first.values()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {k for (k, _, hit, _) in plain_hits([(k, r.text) for k, r in kept.items()], items) if not hit}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", kept[k].text or "")) for k in clean}
    sizes = Counter()
    for k in clean:
        sizes[kept[k].source] += size[k]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: 1 + i % 3 for i, s in enumerate(names)}, 3)
    want, start = [], 0
    for k in sorted(clean):
        rate = target[kept[k].source] / sizes[kept[k].source]
        u = int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:8], 16) / 2**32
        ids = [*LIBRARY.encode(kept[k].text or "", add_special_tokens=False).ids, 2]
        for _ in range(int(rate) + (u < rate - int(rate))):
            want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    folders = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*"))
    before = folders()
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert folders() == before
    assert got == want
