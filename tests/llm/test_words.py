"""Jaccard components, repeats and text statistics, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from photonlake.llm import graph, jaccard, kernels, quality, repeats
from tests.llm.conftest import SCHEMA, words


def shingle_set(text, k):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components(docs, clashing, empty, awkward, k, percent):
    want = brute_components([(r[0], r[1]) for r in awkward], k, percent)
    for rows in (docs, clashing):
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(rows, k, percent).collect()), key=str) == want
    assert jaccard.join_components(empty, k, percent).count() == 0


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):
        own = list(base[: rng.randint(120, 150)])
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"n{rng.random()}"
        rows.append((d, " ".join(own), "en", "s", 0))
    got = jaccard.join_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components([(r[0], r[1]) for r in rows], 3, 90)


def test_first_of_each_keeps_one(docs, awkward):
    kept = jaccard.first_of_each(docs)
    want = {i for i, _, c in brute_components([(r[0], r[1]) for r in awkward], 3, 90) if i == c or i is None}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns


def test_components_of_a_chain_in_any_order(spark):
    rng = random.Random(4)
    for n, rows in ((2000, 1), (600, 3)):
        ids = list(range(n))
        rng.shuffle(ids)
        links = [(ids[i], ids[i + 1]) for i in range(n - 1) if rows == 1 or i % 200 != 199]
        want = {x: min(ids[lo : lo + n // rows]) for lo in range(0, n, n // rows) for x in ids[lo : lo + n // rows]}
        got = graph.components(spark.createDataFrame(links * 2 + [(7, 7), (None, 3)], "u long, v long")).collect()
        assert len(got) == n and {r["id"]: r["label"] for r in got} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_long_chain_of_documents_is_one_component(spark):
    rng = random.Random(6)
    own, texts = [f"w{i}" for i in range(100)], []
    for d in range(400):
        own[d * 37 % 100] = f"n{d}"
        texts.append(" ".join(own))
    ids = list(range(400))
    rng.shuffle(ids)
    got = jaccard.join_components(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(list(zip(ids, texts, strict=True)), 3, 90)
    assert {r["component_id"] for r in got} == {0}


def test_keys_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    sizes = jaccard.Sizes()
    for n in (5, 9, 10, 11, 30, 99, 100, 101, 400, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 9 + 2))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone // 2 :]], rng.integers(0, 1 << 63, gone - gone // 2, dtype=np.uint64)]))
            if jaccard.linked(a, b, 90) and set(a) != set(b):
                keys = []
                for s in (a, b):
                    level = int(sizes.of(len(s)))
                    keys.append(set(np.concatenate([jaccard.keys_of(s, x, sizes) for x in (level, level - 1) if x >= 0]).tolist()))
                assert keys[0] & keys[1]


def test_tree_finds_all_near_points():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 6, (200, 64)).astype(np.int32)
    points[100:] = np.maximum(points[:100] - (rng.random((100, 64)) < 0.05), 0)
    tree = jaccard.CountTree(points)
    for p in points[:50]:
        both = np.minimum(points, p).sum(1)
        want = np.flatnonzero(190 * both >= 90 * (p.sum() + points.sum(1)))
        assert set(want) == set(tree.near(p, 90))


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for at in range(len(w) - 12):
            if i is not None:
                key = tuple(w[at : at + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for at in range(len(w) - 12) if i is not None and first[tuple(w[at : at + 13])] < i for p in range(at, at + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(docs, clashing, empty, awkward):
    want = brute_repeats([(r[0], r[1]) for r in awkward])
    for rows in (docs, clashing):
        got = repeats.without_repeats(rows)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == want
    assert sum(x[2] for x in want) > 100
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_of_runs_and_cycles(spark):
    rng = random.Random(8)
    rows = []
    for d in range(60):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
        rows.append((d, " ".join(unit * rng.randint(1, 30)), "en", "s", 0))
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute_repeats([(r[0], r[1]) for r in rows])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 5, 4000).astype(np.uint64)
    names = kernels.mix(text)
    found = kernels.Words(None, None, np.array([0, 1000]), np.array([1000, 4000]))
    whole = kernels.windows(names, 13)
    at, _, anchor = repeats.anchors(names, found, whole)
    seen = defaultdict(set)
    for a, x in zip(at, anchor, strict=True):
        seen[tuple(text[a : a + 13])].add(int(x))
    assert all(len(v) == 1 for v in seen.values())


def test_words_and_hashes_do_not_depend_on_the_batch(awkward):
    texts = [r[1] for r in awkward]
    alone, together = [], []
    hasher = kernels.Hasher()
    for batch, out in (([[t] for t in texts], alone), ([texts], together)):
        for b in batch:
            for chunk in kernels.chunks(pa.array(b, pa.string())):
                found = kernels.words(chunk)
                h = hasher.ranges(hasher.prefix(chunk.data), found.starts, found.ends)
                out += [h[a:z].tolist() for a, z in zip(found.lo, found.hi, strict=True)]
                got = [[chunk.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:z], found.ends[a:z], strict=True)] for a, z in zip(found.lo, found.hi, strict=True)]
                assert got == [words(t) for t in b[chunk.first : chunk.first + len(got)]]
    assert alone == together


def brute_counts(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(spark, docs, clashing, awkward):
    rows = awkward + [(500, "a#b <x> |\n a#b <x> |\na#b <x> |", "en", "s", 0), (501, "\n\n\n", "en", "s", 0)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA), []).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got) == sorted(str((r[0], *brute_counts(r[1]))) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality.judge(clashing, []).count() == len(awkward)


def test_decision_list_learns_and_is_an_ordered_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.RATIOS)))
    bad = (x[:, 2] > 0.7) | ((x[:, 5] > 0.8) & (x[:, 0] < 0.5))
    rules = quality.cover(x, bad)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality._holds(rule, x)
    assert (hit == bad).mean() > 0.97
    assert quality.cover(x, rng.random(3000) < 0.3) == [] and quality.cover(x[:3], bad[:3]) == []
    rules = [[quality.Term("words", True, 5.0), quality.Term("upper_per_char", True, 0.5)], [quality.Term("words", True, 100.0)]]
    rows = spark.createDataFrame([(1, 10, 10, 9), (2, 200, 10, 0), (3, 7, 0, 0), (4, 300, 10, 10)], "doc_id long, n_words long, word_chars long, n_upper long")
    assert [r[0] for r in rows.orderBy("doc_id").select(quality.fired(rules)).collect()] == [1, 2, None, 1]
