"""Sharding, mixing and decontamination on awkward rows, against plain Python."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from photonlake.llm import decontaminate, mixing, sharding
from tests.llm.conftest import words


def test_shards(docs, clashing, empty, awkward):
    got = sharding.shard(docs).collect()
    assert len(got) == len(awkward) and sharding.shard(empty).count() == 0
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode()))
        assert r["grown_shard"] in (r["shard"], 16)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    other = sharding.shard(clashing)
    assert sorted(map(str, other.select("doc_id", "shard", "slot").collect())) == sorted(str(r) for r in sharding.shard(docs).select("doc_id", "shard", "slot").collect())
    assert other.select("label").first()[0] == "mine"


def test_weights_and_balance(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r["shard"] for r in sharding.shard(rows, 4, [1, 1, 2, 4]).select("shard").collect())
    assert abs(n[3] / n[0] - 4) < 1 and abs(n[2] / n[0] - 2) < 0.5
    with pytest.raises(ValueError):
        sharding.owner(rows["doc_id"], 2, [1.0])


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, total, got = dict(sizes), sum(sizes.values()), {}
    while True:
        share = {s: (total - sum(got.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 3 * sizes[s]]
        if not full:
            return got | share
        for s in full:
            got[s] = 3.0 * sizes[s]
            del left[s]


def test_mix(docs, clashing, empty, awkward):
    got = mixing.mix(docs).collect()
    assert mixing.mix(empty).count() == 0
    sizes = Counter()
    for _, text, _, source, _ in awkward:
        sizes[source] += len(words(text))
    want = targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["repeats"] <= 3 and (r["size"] or not r["repeats"])
        taken[r["source"]] += r["size"] * r["repeats"] * r["copies"]
    assert sum(taken.values()) <= sum(sizes.values())
    biggest = defaultdict(int)
    for r in got:
        biggest[r["source"]] = max(biggest[r["source"]], r["size"] * r["copies"])
    assert all(taken[s] <= want[s] + biggest[s] for s in sizes) and all(taken[s] >= want[s] - 2 * biggest[s] - 1 for s in sizes)
    assert sum(r["copies"] for r in got) == len(awkward)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got)) == sorted(map(str, mixing.mix(clashing).collect()))
    rows = Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in mixing.mixed(docs).collect())
    assert rows == Counter({(r["doc_id"], r["source"], r["size"]): r["repeats"] * r["copies"] for r in got if r["repeats"]})


def test_one_source_and_weightless_rows(spark):
    rows = spark.createDataFrame([(i, "a b c", "only") for i in range(9)] + [(99, None, "nothing")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(rows).collect()}
    assert got[99]["target"] == 0 and got[99]["repeats"] == 0
    assert sum(r["repeats"] for r in got.values()) == 9


def test_masks_hit_every_pattern_of_substitutions():
    n, allowed = decontaminate.WINDOW, decontaminate.ALLOWED
    for k in range(allowed + 1):
        for gone in itertools.combinations(range(n), k):
            assert any(not {at + p for p in mask} & set(gone) for mask in decontaminate.MASKS for at in range(n - decontaminate.SPAN + 1)), gone


def test_masks_of_short_items_hit_every_pattern_of_substitutions():
    for n in range(1, decontaminate.WINDOW):
        masks = decontaminate.short_masks(n)
        for gone in itertools.combinations(range(n), decontaminate.allowed(n)):
            assert any(not set(mask) & set(gone) for mask in masks), (n, gone)
    assert [decontaminate.allowed(n) for n in range(1, 14)] == [0] * 3 + [1] * 4 + [2] * 6


def test_items_of_every_length_are_found(spark):
    tests, rows, want = [], [], {}
    for n in range(1, decontaminate.WINDOW + 1):
        item = [f"t{n}x{i}" for i in range(n)]
        tests.append((n, " ".join(item)))
        most = decontaminate.allowed(n)
        for k in range(min(n, most + 1) + 1):
            for gone in itertools.combinations(range(n), k):
                rows.append((len(rows), " ".join(["before", "it", *("qqq" if i in gone else w for i, w in enumerate(item)), "after"])))
                if k <= most:
                    want[rows[-1][0], n] = (n - k, n, 2)
    rows += [(-1, " ".join(tests[9][1].split()[:7])), (-2, None), (-3, "t9x0 t9x1")]
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests * 2, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["compared"], r["start"]) for r in got} == want and len(got) == len(want)


def test_overlaps(spark, docs, clashing, empty):
    rng = random.Random(2)
    item = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(30)]
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "too short to tell"), (3, None), (4, ""), (5, " ".join(item[:9]))], "item_id long, text string")
    swap = lambda at: " ".join("qqq" if i in at else w for i, w in enumerate(item))
    own = spark.createDataFrame(
        [(1001, "x y z " + " ".join(item).upper() + "!"), (1002, swap({5, 11, 17, 23})), (1003, swap(set(range(0, 30, 2)))), (1004, " ".join(item[10:23]) + " more"), (1005, ", ".join(item[10:22])), (None, "; ".join(item)), (1001, "another text")],
        "doc_id long, text string",
    )
    rows = docs.select("doc_id", "text").union(own)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(rows, tests).collect()}
    assert {d for d, i in got if i == 1} == {1001, 1002, 1004, None}
    assert got[1001, 1]["matched"] == 30 and got[1001, 1]["start"] == 3 and got[1002, 1]["matched"] == 26 and got[1004, 1]["best"] == 13
    assert (1001, 5) in got and (1001, 2) not in got
    kept = decontaminate.clean(rows, tests).collect()
    assert len(kept) == rows.count() - sum(r["doc_id"] in {1001, 1002, 1004, None} for r in rows.collect())
    assert decontaminate.overlaps(empty, tests).count() == 0 and decontaminate.overlaps(docs, tests.limit(0)).count() == 0
    assert decontaminate.overlaps(clashing, tests).count() == 0
