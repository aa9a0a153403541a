"""The pipeline's stages against plain Python, on awkward rows and on the given tables."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from photonlake.llm import decontaminate, jaccard, langid, merkle, mixing, pii, quality, sharding, toxicity
from tests.llm.conftest import SCHEMA, held, words
from tests.llm.test_native import targets
from tests.llm.test_words import brute_components, shingle_set

DATA = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_overlaps(docs, items):
    """Pairs with an alignment that decontamination promises to find, from all alignments."""
    found = set()
    for d, text in docs:
        w = tokens(text)
        for i, item in items:
            t = tokens(item)
            width = min(decontaminate.WINDOW, len(t))
            most = min(decontaminate.ALLOWED, width // decontaminate.TOKENS_EACH)
            for start in range(1 - len(t), len(w)) if t else ():
                same = [t[j] == w[j + start] for j in range(max(0, -start), min(len(t), len(w) - start))]
                if any(sum(same[s : s + width]) >= width - most for s in range(len(same) - width + 1)):
                    found.add((d, i))
    return found


def test_overlaps_of_all_alignments(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(n))) for n in (1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 14, 20, 35)] + [(90, ""), (91, None)]
    docs = []
    for d in range(240):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        part = items[rng.randrange(14)][1].split()
        lo = rng.randrange(len(part)) if d % 2 else 0
        part = part[lo : lo + rng.randint(1, len(part))] if d % 2 else part
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = f"x{rng.random()}".replace(".", "")
        at = rng.randint(0, len(own))
        docs.append((d, " ".join(own[:at] + part + own[at:])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_overlaps(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 150
    assert {i for _, i in want} >= {4, 8, 13, 20}


def brute_links(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    return sorted((i, sum(1 for m, (j, b) in enumerate(sets) if m != n and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b)) if i is not None else 0) for n, (i, a) in enumerate(sets))


def test_numbers_of_links(spark, awkward):
    rows = [(r[0] if r[0] is not None else 1000 + n, r[1]) for n, r in enumerate(awkward)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = jaccard.join_components(docs, k, percent, count=True).collect()
        assert sorted((r["doc_id"], r["n_links"]) for r in got) == brute_links(rows, k, percent)


def test_documents_that_share_a_passage_are_no_region(spark, monkeypatch):
    """A passage that most documents have doesn't join them: they share fewer keys than linked sets must."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(20))
    own = lambda d: " ".join(f"d{d}x{rng.randrange(10**6)}" for _ in range(180))
    rows = [(d, f"{own(d)} {passage}", "en", "s", 0) for d in range(150)]
    rows += [(500 + d, rows[d][1] + " tail", "en", "s", 0) for d in range(0, 150, 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    edges = jaccard.candidate_edges(docs, 5, 80)
    sizes = Counter(r["label"] for r in jaccard.components(edges).collect())
    assert max(sizes.values()) <= 6 and len(sizes) >= 15
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs, 5, 80).collect()), key=str) == brute_components([(r[0], r[1]) for r in rows], 5, 80)


def test_edges_of_regions_grow_with_sets_not_with_partitions(spark):
    """Near copies meet at many keys: their edges are few rows, also where the keys fall into many partitions."""
    rng = random.Random(21)
    rows = []
    for group in range(6):
        own = [f"g{group}x{i}" for i in range(240)]
        for d in range(40):
            text = list(own)
            for _ in range(2):
                text[rng.randrange(240)] = f"d{group}x{d}x{rng.randrange(10**6)}"
            rows.append((100 * group + d, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            edges = [(r["u"], r["v"]) for r in jaccard.candidate_edges(docs, 5, 80).collect()]
            assert len({x for e in edges for x in e}) == 240 and len(edges) <= 2 * 240
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs, 5, 80).collect()), key=str) == brute_components([(r[0], r[1]) for r in rows], 5, 80)


def test_a_forest_connects_what_its_edges_connect():
    rng = np.random.default_rng(17)
    for nodes, n in ((1, 0), (2, 1), (50, 30), (400, 350), (300, 3000)):
        names = rng.integers(0, 1 << 63, nodes).astype(np.uint64) * np.uint64(2)
        chain = rng.permutation(nodes)
        for edges in (names[rng.integers(0, nodes, (n, 2))], names[np.stack([chain[:-1], chain[1:]], 1)]):
            least = {int(x): int(x) for x in edges.ravel()}
            while True:
                now = dict(least)
                for a, b in edges.tolist():
                    least[a] = least[b] = min(least[a], least[b])
                if now == least:
                    break
            assert sorted(map(tuple, jaccard._forest(edges).tolist())) == sorted((r, x) for x, r in least.items() if r != x)


def test_trees_join_all_near_points_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 9, (40, 64))
    points = np.maximum(centres[rng.integers(0, 40, 700)] + (rng.random((700, 64)) < 0.04), 0).astype(np.int32)
    total = points.sum(1)
    both = np.minimum(points[:, None], points[None]).sum(2)
    want = 180 * both >= 80 * (total[:, None] + total[None])
    tree = jaccard.CountTree(points)
    got = np.zeros_like(want)
    for i, j in tree.pairs(tree, 80):
        got[i, j] = got[j, i] = True
    assert len(tree.levels) >= 4 and (got | np.eye(700, dtype=bool) == want).all()
    assert tree.tested[0] < 0.5 * 700 * 699 / 2
    other = jaccard.CountTree(points[:90])
    cross = np.zeros((700, 90), bool)
    for i, j in tree.pairs(other, 80):
        cross[i, j] = True
    assert (cross == want[:, :90]).all()


def test_one_of_each_with_ids_missing_and_repeated(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    near = text("a") + " more"
    rows = [(7, text("a"), "x"), (7, text("a"), "x"), (7, text("b"), "y"), (None, text("a"), "n"), (None, near, "n"), (None, text("c"), "c1"), (None, text("c"), "c2"), (3, near, "z"), (9, text("b"), "y"), (None, None, "v"), (None, "", "e")]
    got = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string"), k=5, percent=80).collect()
    assert Counter((r["doc_id"], r["row"]) for r in got if r["text"]) in (Counter([(3, "z"), (None, "c1")]), Counter([(3, "z"), (None, "c2")]))
    assert {r["row"] for r in got if not r["text"]} == {"v", "e"}


NAMES = ("gone_id", "again_id", "again_text", "row", "at", "id", "mix", "to_shard", "to_chunk", "before", "of", "n", "place", "start", "first", "part", "copies", "repeats", "file", "offset")


def test_stages_on_awkward_rows(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names in each stage."""
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None)], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    named = docs.withColumns({n: F.lit("mine") for n in NAMES})
    for name, stage in corpus_pipeline.STAGES:
        plain, more = stage(spark, docs, str(tmp_path)), stage(spark, named, str(tmp_path))
        assert plain.columns[: len(docs.columns)] == docs.columns, name
        key = lambda rows: Counter((r["doc_id"], r["text"], r["source"]) for r in rows.collect())
        assert key(plain) == key(more) and plain.count() > 0, name
        kept = [n for n in NAMES if n in more.columns]
        assert kept == list(NAMES) and {tuple(r) for r in more.select(*NAMES).distinct().collect()} == {("mine",) * len(NAMES)}, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


@given
def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    left = {i: r for i, r in rows.items() if i not in toxic}
    least = {i: c for i, _, c in brute_components([(i, r["text"]) for i, r in left.items()], 5, 80)}
    left = {i: r for i, r in left.items() if least[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    # Alignments of a pair with no two tokens in a row in common can't reach the share that is asked for.
    pairs = {i: set(zip(tokens(t), tokens(t)[1:], strict=False)) for i, t in items}
    close = [(i, r["text"], [x for x in items if pairs[x[0]] & set(zip(tokens(r["text"]), tokens(r["text"])[1:], strict=False))]) for i, r in left.items()]
    leaks = {d for i, text, some in close for d, _ in brute_overlaps([(i, text)], some)}
    left = {i: r for i, r in left.items() if i not in leaks}
    sizes = Counter()
    for r in left.values():
        sizes[r["source"]] += len(words(r["text"]))
    want = targets(dict(sizes))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} <= set(left) and leaks and toxic
    taken, times = Counter(), Counter(r["doc_id"] for r in got)
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    most = max(len(words(r["text"])) for r in left.values())
    assert max(times.values()) <= 3 and all(abs(taken[s] - want[s]) <= 2 * most for s in sizes)
    for shard in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["grown_shard"] in (r["shard"], 16) for r in got)


@given
def test_held_out_documents_of_the_given_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if r["lang"] is not None and held(r["doc_id"])}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert np.mean([got[i] == lang for i, lang in truth.items()]) > 0.97
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if held(r["doc_id"])}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert np.mean([got[i] for i, t in toxic.items() if t]) >= 0.6 and np.mean([got[i] for i, t in toxic.items() if not t]) < 0.02


@given
def test_secrets_of_the_given_tables_are_found(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    secrets = {i: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})', t)] for i, t in texts.items()}
    got = pii.op5(spark, DATA).collect()
    found = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("id:")] for r in got}
    assert sum(map(len, secrets.values())) >= 10 and all(set(secrets[i]) <= set(found[i]) for i in texts)
    extra = sum(len(found[i]) - len(secrets[i]) for i in texts)
    assert extra <= 0.1 * sum(map(len, secrets.values()))
    assert all(r["n_id"] == len(found[r["doc_id"]]) for r in got)


def test_patterns_on_both_sides_of_an_instance(spark):
    rng = random.Random(7)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1"
    rows = [f"the secret is {key()} yes" for _ in range(5)] + ["the secret is QX-7731-AB yes", "it is 12345678 now", "it is so", "there is more", "is it"]
    rows += [f"write to u{i}@mail.example.org at once" for i in range(6)] + ["call ZZ-555-19 at once", "look at once", "a sum of 99887766 or"]
    rows += [f"it is {i}2345678 now" for i in range(4)]
    rows += [f"a digest {key()} of file {i}" for i in range(2)] + ["é " + "wort " * 50 + "the secret is ÄB-12345 yes"]
    own = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    cues = pii.bootstrap(own, after=True)
    assert "secret is" in cues and "_ at" in cues and not {"is", "the secret is", "_ at once", "digest"} & set(cues)
    got = {r["doc_id"]: r["spans"] for r in pii.find(own).collect()}
    assert got[5] == "id:14:24" and got[16] == "id:5:14" and got[6] == got[7] == "" and got[len(rows) - 3] == got[len(rows) - 2] == ""


@given
def test_quality_verdicts_follow_the_learned_list(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality.learn(docs, labels) if hasattr(quality, "learn") else []
    got = {r["doc_id"]: r for r in quality.judge(docs, rules).collect()}
    bad = {r["doc_id"]: r["quality"] == 0 for r in labels.collect() if held(r["doc_id"])}
    assert all(not (r["base_failed"] and r["kept"]) for r in got.values())
    assert np.mean([not got[i]["kept"] for i, b in bad.items() if b]) > 0.8 and np.mean([not got[i]["kept"] for i, b in bad.items() if not b]) < 0.1


def test_audits_of_empty_and_renamed_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    none = merkle.records(empty, more={"altered": merkle.altered()})
    assert merkle.damaged(none).count() == 0 and merkle.audit(none, merkle.damaged(none)).count() == 0
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(60)], "page_id long, url string, html string")
    plain = merkle.records(pages).select("page_id", "file", "offset", "sha256").collect()
    named = pages.withColumns({n: F.lit("mine") for n in ("file", "offset", "length", "sha256", "at", "place", "status", "own")})
    assert sorted(map(tuple, merkle.records(named).select("page_id", "file", "offset", "sha256").collect())) == sorted(map(tuple, plain))


def test_targets_hold_for_other_rounds(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(rows, rounds=5).collect()
    assert max(r["repeats"] for r in got) <= 5 and all(math.isfinite(r["target"]) for r in got)
    total = sum(len(words(r["text"])) for r in rows.collect())
    assert sum(r["size"] * r["repeats"] * r["copies"] for r in got) <= total
    assert sharding.shard(rows).count() == 200
