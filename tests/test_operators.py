"""Boundaries and properties of the operators, against plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from photonlake import config, tiles
from photonlake.functions import columns as C
from photonlake.functions import json as json_rows
from photonlake.operators import duplicates, events, ledger, search, similar, workers
from photonlake.operators import photos as photo_rows
from photonlake.sources import scan

T0 = datetime(2026, 3, 14, 9, tzinfo=timezone.utc)


def points(spark, rows):
    rows = [(i, "lib", T0 + timedelta(minutes=m) if m is not None else None, src, lat, lon) for i, (m, src, lat, lon) in enumerate(rows)]
    return spark.createDataFrame(rows, "photo_id long, library_id string, captured_at timestamp, captured_at_source string, latitude double, longitude double")


def parts(frame):
    found = {}
    for r in frame.collect():
        found.setdefault((r["segment"], r["part"]), []).append((r["sequence"], r["photo_id"]))
    return [[p for _, p in sorted(v)] for _, v in sorted(found.items())]


def test_a_gap_of_exactly_the_limit_joins(spark):
    rows = points(spark, [(0, "exif", None, None), (240, "exif", None, None), (481, "exif", None, None)])
    assert parts(events.members(rows)) == [[0, 1], [2]]


def test_drift_is_bounded_by_the_anchor(spark):
    step = 300 / 111_195
    found = parts(events.members(points(spark, [(i, "exif", 30 + i * step, -97.0) for i in range(30)])))
    assert len(found) > 1 and max(map(len, found)) <= 6


def test_late_anchor_and_unlocated_members(spark):
    rows = points(spark, [(0, "exif", None, None), (1, "filesystem", 30.0, -97.0), (2, "exif", 30.0, None), (3, "exif", 30.001, -97.0), (None, None, 30.0, -97.0)])
    members = {r["photo_id"]: r for r in events.members(rows).collect()}
    assert members[0]["distance_meters"] is None and members[1]["distance_meters"] == 0.0 and members[2]["distance_meters"] is None
    assert 100 < members[3]["distance_meters"] < 120
    (made,) = events.clusters(events.members(rows)).collect()
    assert (made["photo_count"], made["located_count"], made["filesystem_dated_count"], made["confidence"]) == (4, 2, 1, "mixed")
    total = events.summary(rows, events.clusters(events.members(rows))).first()
    assert total["clustered"] + total["undated"] == rows.count()


def test_events_do_not_depend_on_input_order(spark):
    rng = random.Random(4)
    rows = points(spark, [(rng.randrange(3000), "exif", 30 + rng.random() / 20, -97.0) if rng.random() < 0.7 else (rng.randrange(3000), "exif", None, None) for _ in range(300)])
    assert parts(events.members(rows)) == parts(events.members(rows.orderBy(F.rand(3)).repartition(7)))


def photos(spark, rows):
    return spark.createDataFrame([(i, "lib", h, s, q, w, n, p, "processing", None if h is None else "x") for i, (h, s, q, w, n, p) in enumerate(rows)], "photo_id long, library_id string, phash long, sha256 string, quality_score double, width int, file_size_bytes long, relative_path string, state string, hashed_at string").withColumn("height", F.col("width"))


@pytest.mark.parametrize("threshold", [3, 12, 24])
def test_banded_pairs_lose_nothing(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 26))) for b in base for _ in range(8)]
    hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = photos(spark, [(h, f"s{i}", None, 100, 10, f"p{i}.jpg") for i, h in enumerate(hashes)])
    want = {(min(a, b), max(a, b)) for i, a in enumerate(hashes) for b in hashes[:i] if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= threshold}
    assert {(r["hash_a"], r["hash_b"]) for r in similar.pairs(rows, threshold).collect()} == want


def test_chains_are_one_group_and_quality_beats_pixels(spark):
    rows = photos(spark, [(0, "a", 0.5, 100, 10, "a.jpg"), (0xFF, "b", 0.9, 50, 10, "b.jpg"), (0xFFFF, "c", None, 200, 10, "c.jpg"), (-1, "d", None, 1, 1, "d.jpg"), (None, "e", None, 1, 1, "e.jpg"), (0, "a", None, 1, 1, "deep/copy.jpg")])
    made, members = similar.groups(similar.candidates(rows), 8)
    (group,) = made.collect()
    assert (group["photo_count"], group["max_distance"], group["group_id"]) == (3, 16, 0)
    assert group["suggested_keep_photo_id"] in (1, 2)
    assert sorted(r["rank"] for r in members.collect()) == [1, 2, 3]
    assert similar.listing(made, members).first()["chained"]


def test_thresholds_are_clamped():
    assert [config.effective_threshold(t) for t in (0, -3, 12, 99)] == [12, 0, 12, 24]
    assert config.effective_gap(0) == 4 * 3600 and config.effective_radius(-1) == 1500


def test_keeper_order_and_reclaimable(spark):
    rows = photos(spark, [(None, "x", None, 1, 7, "a/b/c.jpg"), (None, "x", None, 1, 7, "long-name.jpg"), (None, "x", None, 1, 7, "b.jpg"), (None, None, None, 1, 7, "n.jpg"), (None, None, None, 1, 7, "m.jpg")])
    (group,) = duplicates.groups(rows).collect()
    assert (group["photo_count"], group["reclaimable_bytes"], group["suggested_keep_photo_id"]) == (3, 14, 2)


@pytest.mark.parametrize(("text", "want"), [("a%b", "a\\%b"), ("a_b", "a\\_b"), ("\\", "\\\\"), ("plain", "plain")])
def test_escape(text, want):
    assert C.escape_like(text) == want


@pytest.mark.parametrize("params", [{"state": "gone"}, {"flag": "ugly"}, {"sort": "size"}, {"order": "up"}, {"has_gps": "maybe"}, {"from": "yesterday"}, {"from": "2024-02-02", "to": "2024-02-01"}, {"colour": "red"}])
def test_bad_parameters_are_errors(params):
    with pytest.raises(ValueError):
        search.parse(params)


def test_good_parameters():
    q = search.parse({"q": "x", "has_flags": "no", "order": "desc", "limit": "9999", "offset": "-4", "to": "2024-02-01"})
    assert (q.text, q.has_flags, q.descending, q.limit, q.offset) == ("x", False, True, 100, 0)
    assert q.taken_to == datetime(2024, 2, 1, tzinfo=timezone.utc)


LEDGER = "id long, status string, priority int, attempt_count int, max_attempts int, next_attempt_at timestamp, leased_by long, lease_expires_at timestamp, started_at timestamp, completed_at timestamp, last_error string"
NOON = datetime(2024, 1, 1, 12)


@pytest.fixture
def ledger_rows(spark):
    early, late = datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 13)
    rows = [
        (1, "running", 100, 5, 5, early, 3, early, early, None, None),
        (2, "running", 100, 1, 5, early, 3, late, early, None, "old"),
        (3, "running", 100, 1, 5, early, 4, early, early, None, None),
        (4, "pending", 200, 0, 5, early, None, None, None, None, None),
        (5, "pending", 100, 2, 5, early, None, None, early, None, None),
        (6, "pending", 50, 0, 5, late, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, LEDGER)


def test_ledger_transitions(spark, ledger_rows):
    rows = ledger_rows
    failed = {r["id"]: (r["status"], r["next_attempt_at"], r["leased_by"], r["last_error"]) for r in ledger.fail(rows, 3, NOON, "broken").collect()}
    assert failed == {1: ("dead", datetime(2024, 1, 1, 11), None, "broken"), 2: ("pending", datetime(2024, 1, 1, 12, 0, 2), None, "broken")}
    assert {(r["id"], r["status"], r["completed_at"]) for r in ledger.fail(rows, 3, NOON, "x", permanent=True).collect()} == {(1, "dead", NOON), (2, "dead", NOON)}
    assert [(r["id"], r["attempt_count"]) for r in ledger.defer(rows, 3, NOON, 2, "later").orderBy("id").collect()] == [(1, 4), (2, 0)]
    assert [r["id"] for r in ledger.complete(rows, 4, NOON).collect()] == [3] and ledger.complete(rows, 4, NOON, ids=[1]).isEmpty()
    assert {(r["id"], r["lease_expires_at"]) for r in ledger.renew(rows, 3, NOON).collect()} == {(1, datetime(2024, 1, 1, 12, 1)), (2, datetime(2024, 1, 1, 12, 1))}
    assert {(r["id"], r["attempt_count"], r["next_attempt_at"]) for r in ledger.release(rows, 3, NOON).collect()} == {(1, 5, NOON), (2, 1, NOON)}


def test_only_due_jobs_are_claimed(spark, ledger_rows):
    got = ledger.claim(ledger_rows, 9, 10, NOON).collect()
    assert [(r["id"], r["attempt_count"], r["leased_by"], r["started_at"]) for r in got] == [(5, 3, 9, datetime(2024, 1, 1, 11)), (4, 1, 9, NOON)]
    assert [r["id"] for r in ledger.claim(ledger_rows, 9, 1, NOON).collect()] == [5] and ledger.claim(ledger_rows, 9, 0, NOON).isEmpty()
    after = ledger.applied(ledger_rows, ledger.claim(ledger_rows, 9, 10, NOON))
    assert after.count() == 6 and after.columns == ledger_rows.columns and after.where("status = 'pending'").count() == 1
    begun = ledger.started(ledger.claim(ledger_rows, 9, 1, NOON), NOON).first()
    assert (begun["job_id"], begun["worker_id"], begun["attempt"], begun["outcome"]) == (5, 9, 3, None)


def test_reaping_closes_executions(spark, ledger_rows):
    reaped = ledger.reap(ledger_rows, NOON, 2)
    assert {(r["id"], r["status"], r["last_error"]) for r in reaped.collect()} == {(1, "dead", "lease expired: worker stopped responding (attempt 5 of 5)"), (3, "pending", "lease expired: worker stopped responding (attempt 1 of 5)")}
    assert tuple(ledger.reaped_counts(reaped).first()) == (1, 1)
    executions = spark.createDataFrame([(1, 5, None, None, None), (1, 4, NOON, "failed", "x"), (2, 1, None, None, None)], "job_id long, attempt int, finished_at timestamp, outcome string, error string")
    assert [tuple(r) for r in ledger.reaped_executions(executions, reaped, NOON).collect()] == [(1, 5, NOON, "abandoned", "lease expired")]


def test_workers(spark, ledger_rows):
    ago = lambda s: datetime(2024, 1, 1, 11, 59, 60 - s)
    rows = spark.createDataFrame([(3, "h3", 2, "active", ago(30), None), (4, "h4", 4, "active", ago(5), None), (5, "h5", 1, "dead", ago(20), ago(20)), (6, "h6", 1, "stopped", ago(40), ago(40))], "worker_id long, hostname string, slots int, status string, last_heartbeat_at timestamp, stopped_at timestamp").withColumn("started_at", F.lit(NOON))
    assert [(r["worker_id"], r["running"]) for r in workers.listing(rows, ledger_rows).collect()] == [(4, 1), (3, 2), (6, 0), (5, 0)]
    assert tuple(workers.rollup(rows, ledger_rows).first()) == (4, 2, 6, 3)
    assert [(r["worker_id"], r["running"]) for r in workers.victim(rows, ledger_rows).collect()] == [(3, 2)]
    assert {r["worker_id"] for r in workers.reap(rows, NOON).where("status = 'dead'").collect()} == {3, 5}
    assert {r["worker_id"] for r in workers.purge(rows, ledger_rows, NOON, 30).collect()} == {3, 4, 5}
    assert {r["worker_id"]: r["last_heartbeat_at"] for r in workers.heartbeat(rows, 5, NOON).collect()}[5] == ago(20)
    assert {r["worker_id"]: r["status"] for r in workers.unregister(rows, 4, NOON).collect()}[4] == "stopped"
    back = workers.register(rows, spark.createDataFrame([(5, "new", 8), (9, "h9", 1)], "worker_id long, hostname string, slots int"), NOON)
    assert {(r["worker_id"], r["hostname"], r["status"]) for r in back.where("worker_id >= 5").collect()} == {(5, "new", "active"), (6, "h6", "stopped"), (9, "h9", "active")}


def test_libraries(spark):
    schema = "id string, source_kind string, root_path string, name string, last_scan_started_at timestamp, last_scan_finished_at timestamp, created_at timestamp"
    old, later = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = spark.createDataFrame([("a", "local_fs", "/a", "A", old, None, old), ("b", "local_fs", "/b", "B", old, later, later)], schema)
    new = spark.createDataFrame([("c", "local_fs", "/a", "again"), ("d", "local_fs", "/d", "D")], "id string, source_kind string, root_path string, name string")
    assert {(r["name"], r["created"]) for r in scan.register_library(rows, new).collect()} == {("A", False), ("B", False), ("D", True)}
    assert [r["id"] for r in scan.libraries_in_order(rows).collect()] == ["b", "a"]
    starts = lambda x: {r["id"]: r["last_scan_started_at"] for r in x.collect()}
    assert starts(scan.begin_scan(rows, "a", NOON))["a"] == old and starts(scan.begin_scan(rows, "a", NOON, force=True))["a"] == NOON and starts(scan.begin_scan(rows, "b", NOON))["b"] == NOON
    assert [r["id"] for r in scan.interrupted(rows).collect()] == ["a"] and scan.interrupted(scan.reconcile(rows, NOON)).isEmpty()


def test_lookups_and_requests(spark):
    rows = spark.createDataFrame([(1, "x", None, None), (2, "y", NOON, 10)], "photo_id long, state string, thumbnailed_at timestamp, thumbnail_width int")
    assert photo_rows.lookup(rows, 2).first()["state"] == "y" and photo_rows.thumbnail_made_at(rows, 2).first()[0] == NOON
    for missing in (lambda: photo_rows.lookup(rows, 3), lambda: photo_rows.thumbnail_made_at(rows, 1)):
        with pytest.raises(LookupError):
            missing()
    assert json_rows.decoded(b'{"name": "x"}', ("name", "path")) == {"name": "x"}
    for body in (b'{"other": 1}', b"[1]", b'{"name": 1} {}', b"", b" " * (1 << 20) + b" {}"):
        with pytest.raises(ValueError):
            json_rows.decoded(body, ("name",))
    ids = spark.createDataFrame([("0123abcd-0000-1111-2222-0123456789ab",), ("0123ABCD-0000-1111-2222-0123456789ab",), ("x",), (None,)], "i string")
    assert [r[0] for r in ids.select(C.canonical_id(F.col("i"))).collect()] == [True, False, False, False]


def test_large_groups_in_ranges_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 16)
    rng = random.Random(3)
    hashes = [rng.getrandbits(63) for _ in range(120)]
    hashes += [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in hashes[:60]]
    rows = spark.createDataFrame([("a", h) for h in hashes] + [("b", h) for h in hashes[::7]], "library_id string, phash long")
    got = {(r["library_id"], r["hash_a"], r["hash_b"]): r["distance"] for r in similar.pairs(rows, 22).collect()}
    want = {}
    for lib, own in (("a", set(hashes)), ("b", set(hashes[::7]))):
        want |= {(lib, x, y): (x ^ y).bit_count() for x in own for y in own if x < y and (x ^ y).bit_count() <= 22}
    assert got == want and want
    times = spark.createDataFrame([(i % 2, i, datetime.fromtimestamp(rng.randrange(10**6), timezone.utc)) for i in range(500)], "library_id int, photo_id int, captured_at timestamp")
    by_library = {}
    for r in sorted(times.collect(), key=lambda r: (r["library_id"], r["captured_at"], r["photo_id"])):
        by_library.setdefault(r["library_id"], []).append((r["captured_at"], r["photo_id"]))
    want = {}
    for own in by_library.values():
        segment = 0
        for before, (at, i) in zip([None, *own], own, strict=False):
            segment += before is not None and (at - before[0]).total_seconds() > 3600
            want[i] = segment
    assert {r["photo_id"]: r["segment"] for r in events.time_segments(times, 3600).collect()} == want


def test_display(spark):
    row = spark.range(1).select(
        C.human_span(F.lit(59)), C.human_span(F.lit(60)), C.human_span(F.lit(4 * 3600 + 42 * 60)), C.human_span(F.lit(183_600)), C.human_bytes(F.lit(1023)), C.human_bytes(F.lit(1536)), C.human_metres(F.lit(999.4)), C.human_metres(F.lit(1500.0)), C.human_ago(F.lit(1)), C.uptime(F.lit(3725)), C.hex64(F.lit(255))
    )
    assert list(row.first()) == ["59s", "1m", "4h42m", "2d03h", "1023 B", "1.5 KB", "999m", "1.5km", "just now", "1h2m", "00000000000000ff"]


def test_haversine(spark):
    metres = spark.range(1).select(C.haversine(*map(F.lit, (30.2672, -97.7431, 32.7767, -96.7970)))).first()[0]
    assert abs(metres - 293_095.478) < 0.01
    assert abs(spark.range(1).select(C.haversine(*map(F.lit, (0.0, 179.9, 0.0, -179.9)))).first()[0] - 22_239.016) < 0.01
