"""Rows of photos: views, what stages write into them, and their relations in order."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from photonlake.operators import duplicates, photos, search
from photonlake.sources import scan

NOW, OLD = datetime(2024, 5, 1), datetime(2024, 1, 1)
TEXTS = ("photo_id", "library_id", "relative_path", "original_filename", "detected_format", "state", "last_error", "captured_at_source", "camera_make", "camera_model", "sha256")
TIMES = ("file_modified_at", "captured_at", "metadata_extracted_at", "hashed_at", "phashed_at", "quality_analyzed_at", "thumbnailed_at", "created_at", "updated_at")
DOUBLES = ("latitude", "longitude", *(s for s in photos.SCORES if s != "quality_flags"))
LONGS = ("file_size_bytes", "width", "height", "orientation", "phash", *photos.THUMBNAIL)
SCHEMA = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} timestamp" for c in TIMES), *(f"{c} double" for c in DOUBLES), *(f"{c} long" for c in LONGS), "quality_flags array<string>"])


@pytest.fixture
def rows(spark):
    names = [field.split(" ")[0] for field in SCHEMA.split(", ")]

    def row(**values):
        return tuple({"library_id": "lib", "state": "processing", "quality_flags": [], "file_size_bytes": 9, **values}.get(n) for n in names)

    made = [
        row(photo_id="a", relative_path="b/x.jpg", sha256="s", last_error="old", detected_format="jpeg", width=4, height=3, captured_at=OLD, quality_score=0.5, phash=-1),
        row(photo_id="b", relative_path="x.jpg", sha256="s", latitude=1.0, longitude=2.0),
        row(photo_id="c", relative_path="y.jpg", sha256="t", state="failed"),
    ]
    return spark.createDataFrame(made, SCHEMA)


def one(frame, key="a"):
    return frame.where(F.col("photo_id") == key).first()


def test_metadata_is_overwritten_as_a_whole(spark, rows):
    new = spark.createDataFrame([("a", None, None, None, None, None, None, None, None, None, "failed", "not an image", None), ("b", 5, 6, 1, NOW, "exif", None, None, "Make", None, "processing", None, "png")], "photo_id string, width long, height long, orientation long, captured_at timestamp, captured_at_source string, latitude double, longitude double, camera_make string, camera_model string, state string, last_error string, detected_format string")
    got = photos.set_metadata(rows, new, NOW)
    a, b, c = (one(got, k) for k in "abc")
    assert (a["width"], a["captured_at"], a["state"], a["last_error"], a["detected_format"], a["metadata_extracted_at"]) == (None, None, "failed", "not an image", "jpeg", NOW)
    assert (b["width"], b["latitude"], b["detected_format"], b["camera_make"]) == (5, None, "png", "Make")
    assert c["metadata_extracted_at"] is None and got.columns == rows.columns and got.count() == 3
    again = photos.set_metadata(got, new, NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_other_stages_keep_what_isnt_theirs(spark, rows):
    done = one(photos.set_hash(rows, spark.createDataFrame([("a", "h", None)], "photo_id string, sha256 string, last_error string"), NOW))
    assert (done["sha256"], done["hashed_at"], done["last_error"], done["phash"]) == ("h", NOW, "old", -1)
    done = one(photos.set_phash(rows, spark.createDataFrame([("a", 7, "blurred")], "photo_id string, phash long, last_error string"), NOW))
    assert (done["phash"], done["phashed_at"], done["last_error"]) == (7, NOW, "blurred")
    scores = spark.createDataFrame([("a", *[0.25] * 9, ["low_resolution"])], "photo_id string, " + ", ".join(f"{s} double" for s in photos.SCORES if s != "quality_flags") + ", quality_flags array<string>")
    done = one(photos.set_quality(rows, scores, NOW))
    assert (done["quality_score"], done["quality_flags"], done["quality_analyzed_at"], done["last_error"]) == (0.25, ["low_resolution"], NOW, "old")
    why = spark.createDataFrame([("a", "bad pixels")], "photo_id string, last_error string")
    for stage, column in (("quality", "quality_score"), ("phash", "phash"), ("thumbnail", "thumbnail_width")):
        done = one(photos.mark_failed(rows, stage, why, NOW))
        assert (done[column], done[photos.MARKERS[stage]], done["last_error"]) == (None, NOW, "bad pixels")
    done = one(photos.mark_missing(rows, why, NOW))
    assert (done["state"], done["width"], done["captured_at"], done["sha256"]) == ("missing", None, None, "s")
    assert {r["photo_id"] for r in photos.missing_a_stage(rows).collect()} == {"a", "b"}


def test_detail_has_the_view_and_relations_in_order(spark, rows):
    groups = duplicates.members(rows, duplicates.groups(rows))
    similar = spark.createDataFrame([("g", "a", 2, 5), ("g", "c", 1, 0)], "group_id string, photo_id string, rank int, distance int")
    events = spark.createDataFrame([("lib", 0, 0, k, n + 1, None) for n, k in enumerate("cab")], "library_id string, segment long, part long, photo_id string, sequence long, distance_meters double")
    shown, related = photos.detail(rows, "a", groups, similar, events)
    (view,) = shown.collect()
    assert len(shown.columns) == 30 and (view["phash"], view["duplicate_group_id"], view["similar_group_id"], view["cluster_id"]) == ("f" * 16, "lib/s", "g", "lib/0/0")
    assert [(r["kind"], r["photo_id"], r["is_self"]) for r in related.collect()] == [("duplicate", "b", False), ("duplicate", "a", True), ("similar", "c", False), ("similar", "a", True), ("event", "c", False), ("event", "a", True), ("event", "b", False)]
    assert photos.narrow(rows).columns == list(photos.NARROW) and len(photos.NARROW) == 21
    with pytest.raises(LookupError):
        photos.detail(rows, "zz", groups, similar, events)
    assert [r["photo_id"] for r in search.work_list(rows, "hash", 2).collect()] == ["a", "b"]


def test_contents_and_scans(spark):
    got = {r["path"]: r for r in scan.content_features(spark.createDataFrame([("a", bytearray(b"abc"), 3), ("b", bytearray(b"abcd"), 9), ("c", bytearray(b""), 0)], "path string, content binary, length long")).collect()}
    assert got["a"]["sha256"].startswith(got["a"]["short"]) and len(got["a"]["short"]) == 12 and got["a"]["note"] is None
    assert got["b"]["note"] == "file size changed since scan: 9 -> 4 bytes" and got["c"]["file_size_bytes"] == 0 and got["c"]["note"] is None
    rows = spark.createDataFrame([("a", OLD, None)], "id string, last_scan_started_at timestamp, last_scan_finished_at timestamp")
    assert scan.finish_scan(rows, "a", NOW).first()["last_scan_finished_at"] == NOW
    assert scan.may_start("complete") and scan.may_start("scanning", force=True) and not scan.may_start("scanning")
