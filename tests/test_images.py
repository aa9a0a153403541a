"""Pixels, headers and whole folders."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake import graph
from photonlake.functions import jpeg as encoder
from photonlake.operators import images
from photonlake.operators import photos as photo_rows
from photonlake.plans import pipeline
from photonlake.sources import corpus, scan
from photonlake.sources import thumbnails as stored
from photonlake.streaming import incremental


def scene(seed, w=320, h=240):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / w
    waves = sum(np.sin(x * f * 6 + p) * np.cos(y * g * 6 + q) for f, g, p, q in rng.uniform(0.5, 4, (4, 4)))
    fine = sum(np.sin(x * f + y * g) for f, g in rng.uniform(60, 200, (6, 2)))
    base = 128 + 22 * waves + 9 * fine
    return np.clip(np.stack([base, base + 10, base - 10], 2), 0, 255).astype(np.uint8)


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_hash_survives_scaling_and_separates_scenes():
    a = scene(1)
    small = np.clip(images.resize(a, 160, 120), 0, 255).astype(np.uint8)
    assert apart(images.dhash(a), images.dhash(small)) <= 6
    assert apart(images.dhash(a), images.dhash(scene(2))) > 12
    assert images.dhash(np.full((5, 5, 3), 9, np.uint8)) == 0


def test_quality_measurements():
    sharp = scene(3)
    blurred = np.clip(images.resize(np.clip(images.resize(sharp, 40, 30), 0, 255), 320, 240), 0, 255).astype(np.uint8)
    assert images.quality(sharp)[0] > 4 * images.quality(blurred)[0]
    flat = images.quality(np.full((100, 100, 3), 120, np.uint8))
    assert flat[0] == 0 and flat[2] < 1e-6
    assert images.quality(np.zeros((50, 50, 3), np.uint8))[3] == 1.0
    assert images.quality(np.full((50, 50, 3), 255, np.uint8))[4] == 1.0
    for shape in ((1, 1, 3), (2, 2, 3), (40, 3000, 3)):
        assert np.isfinite(images.quality(np.full(shape, 77, np.uint8))).all()


@pytest.mark.parametrize("turn", range(1, 9))
def test_orientations_are_permutations(turn):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    b = images.orient(a, turn)
    assert sorted(map(tuple, b.reshape(-1, 3))) == sorted(map(tuple, a.reshape(-1, 3)))
    back = {5: 5, 6: 8, 7: 7, 8: 6}.get(turn, turn)
    assert (images.orient(b, back) == a).all()


def test_orientation_six_turns_clockwise():
    a = np.zeros((2, 3, 3), np.uint8)
    a[0, 0] = 9
    assert images.orient(a, 6)[0, -1, 0] == 9


def test_thumbnail_shrinks_but_never_grows():
    assert images.thumbnail(scene(1, 800, 600)).shape == (300, 400, 3)
    assert images.thumbnail(scene(1, 100, 60)).shape == (60, 100, 3)
    clear = np.zeros((4, 4, 4), np.uint8)
    assert (images.thumbnail(clear) == 0xEE).all()


def tiff(entries, gps=()):
    body, data, at = b"", b"", 8 + 2 + 12 * (len(entries) + bool(gps)) + 4
    for tag, kind, count, raw in entries:
        if len(raw) > 4:
            body += struct.pack("<HHII", tag, kind, count, at + len(data))
            data += raw
        else:
            body += struct.pack("<HHI4s", tag, kind, count, raw.ljust(4, b"\0"))
    if gps:
        body += struct.pack("<HHII", 0x8825, 4, 1, at + len(data))
        start = at + len(data) + 2 + 12 * len(gps) + 4
        own, more = struct.pack("<H", len(gps)), b""
        for tag, kind, count, raw in gps:
            own += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", start + len(more)))
            more += raw if len(raw) > 4 else b""
        data += own + b"\0" * 4 + more
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries) + bool(gps)) + body + b"\0" * 4 + data


def jpeg(w, h, block=None):
    out = b"\xff\xd8"
    if block:
        out += b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xd9"


def place(d, m, s):
    return struct.pack("<6I", d, 1, m, 1, s, 1)


def test_metadata(spark):
    full = tiff([(0x0112, 3, 1, struct.pack("<H", 6)), (0x010F, 2, 6, b"Acme \0"), (0x0132, 2, 20, b"2026:03:14 09:00:00\0")], [(1, 2, 2, b"N\0"), (2, 5, 3, place(30, 15, 0)), (3, 2, 2, b"W\0"), (4, 5, 3, place(97, 30, 0))])
    null_island = tiff([(0x0132, 2, 20, b"1850:01:01 00:00:00\0")], [(1, 2, 2, b"N\0"), (2, 5, 3, place(0, 0, 0)), (3, 2, 2, b"E\0"), (4, 5, 3, place(0, 0, 0))])
    rows = [("a", jpeg(640, 480, full)), ("b", jpeg(640, 480, null_island)), ("c", b"text"), ("d", images.png(scene(1, 32, 24))), ("e", jpeg(10, 10, tiff([], [(1, 2, 2, b"N\0"), (2, 5, 3, place(1, 0, 0))]))), ("f", b"")]
    from datetime import datetime

    files = spark.createDataFrame([(p, bytearray(c), datetime(2026, 1, 1)) for p, c in rows], "path string, content binary, modificationTime timestamp")
    got = {r["path"]: r for r in images.metadata(files).collect()}
    a = got["a"]
    assert (a["width"], a["height"], a["orientation"], a["camera_make"], a["captured_at_source"], a["latitude"], a["longitude"], a["last_error"]) == (480, 640, 6, "Acme", "exif", 30.25, -97.5, None)
    assert a["captured_at"] == datetime(2026, 3, 14, 9)
    assert got["b"]["latitude"] is None and got["b"]["captured_at_source"] == "filesystem" and "capture time unreadable" in got["b"]["last_error"]
    assert got["c"]["state"] == "failed" and got["c"]["captured_at"] is None and got["f"]["state"] == "failed"
    assert (got["d"]["detected_format"], got["d"]["width"]) == ("png", 32)
    assert got["e"]["latitude"] is None and "half a place" in got["e"]["last_error"]


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.png": images.png(scene(1)), "sub/copy.png": images.png(scene(1)), "b.PNG": images.png(scene(2)), "dark.png": images.png(scene(3) // 8), "broken.png": b"\x89PNG\r\n\x1a\nxx", "_x.jpg": b"no", "notes.txt": b"hi", ".hidden/c.png": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.png").symlink_to(tmp_path / "a.png")
    return tmp_path


def test_scan(spark, folder):
    entries = scan.walk(spark, str(folder), "lib")
    s = scan.statistics(entries).first()
    assert (s["supported"], s["skipped_unsupported"], s["skipped_hidden"], s["directories"]) == (6, 1, 1, 1)
    known = scan.found(entries).where("relative_path = 'a.png'")
    assert tuple(scan.result(entries, known).first()) == (6, 5, 1)
    listed = {r["relative_path"] for r in scan.listing(spark, str(folder), "lib").collect()}
    assert {"a.png", "sub/copy.png", "b.PNG", "dark.png", "broken.png"} <= listed
    assert scan.relative_to(str(folder), str(folder / "sub/copy.png")) == "sub/copy.png"
    for bad in (folder.parent, folder):
        with pytest.raises(ValueError) as error:
            scan.relative_to(str(folder), str(bad))
        assert str(folder) not in str(error.value)


def test_whole_pipeline(spark, folder):
    got = pipeline.run(spark, str(folder), entries=scan.walk(spark, str(folder)))
    rows = {r["relative_path"]: r for r in got.photos.collect()}
    assert rows["broken.png"]["state"] == "failed" and rows["broken.png"]["phash"] is None and rows["broken.png"]["quality_score"] is None
    assert "possibly_underexposed" in rows["dark.png"]["quality_flags"]
    assert rows["a.png"]["phash"] == rows["sub/copy.png"]["phash"] == images.dhash(scene(1))
    assert got.duplicate_groups.first()["photo_count"] == 2
    summaries = {k: v.first() for k, v in pipeline.overview(got).items()}
    assert summaries["duplicates"]["groups"] == 1 and summaries["quality"]["analyzed"] == len(rows) - sum(r["quality_score"] is None for r in rows.values())
    again = pipeline.run(spark, str(folder), entries=scan.walk(spark, str(folder)))
    drop = ("hashed_at", "metadata_extracted_at")
    assert sorted(map(str, got.photos.drop(*drop).collect())) == sorted(map(str, again.photos.drop(*drop).collect()))


def test_thumbnails(spark, folder):
    from pyspark.sql import functions as F

    got = {r["path"].rsplit("/", 1)[-1]: r for r in images.thumbnails(images.pictures(spark, str(folder)).withColumn("orientation", F.lit(6)), "path").collect()}
    assert (got["a.png"]["thumbnail_width"], got["a.png"]["thumbnail_height"]) == (240, 320)
    assert images.header(bytes(got["a.png"]["thumbnail"]))[:3] == ("png", 240, 320)
    assert got["broken.png"]["thumbnail"] is None


@pytest.mark.parametrize(("shape", "quality"), [((1, 1), 82), ((37, 50), 82), ((64, 64), 30), ((16, 9), 100)])
def test_jpeg_is_read_back(spark, tmp_path, shape, quality):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    picture = np.stack([128 + 90 * np.sin(x / 9), 128 + 80 * np.cos(y / 7), 2 * x + y], 2).astype(np.uint8)
    data = encoder.encode(picture, quality)
    assert images.header(data)[:3] == ("jpeg", shape[1], shape[0])
    (tmp_path / "x.JpG").write_bytes(data)
    (row,) = images.pictures(spark, str(tmp_path)).collect()
    image = row["image"]
    got = np.frombuffer(bytes(image["data"]), np.uint8).reshape(image["height"], image["width"], 3)[..., ::-1]
    assert got.shape == picture.shape and np.abs(got.astype(int) - picture).mean() < (12 if quality < 50 else 5)


def test_thumbnails_are_stored_whole(spark, folder, tmp_path_factory):
    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("thumbnails")
    digits = F.md5("path")
    key = F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.substring(digits, 21, 12))
    rows = images.thumbnails(images.pictures(spark, str(folder)).withColumn("orientation", F.lit(1)), "path", quality=images.THUMBNAIL_QUALITY).withColumn("photo_id", key)
    for _ in range(2):
        got = stored.write(rows, str(out)).collect()
        files = sorted(str(p) for p in out.rglob("*") if p.is_file())
        assert files == sorted(r["path"] for r in got) and len(files) == rows.where("thumbnail is not null").count() > 2
    for r in got:
        data = stored.path_for(str(out), r["photo_id"]).read_bytes()
        assert len(data) == r["thumbnail_bytes"] and images.header(data)[:3] == ("jpeg", r["thumbnail_width"], r["thumbnail_height"])
    with pytest.raises(Exception, match="not canonical"):
        stored.write(rows.withColumn("photo_id", F.lit("../x")), str(out)).collect()


def test_names_in_any_case_have_pixels(spark, tmp_path):
    for name in ("a.Png", "b.pNG", "c.png", "d.PNG"):
        (tmp_path / name).write_bytes(images.png(scene(4, 40, 30)))
    rows = pipeline.photos(spark, str(tmp_path)).collect()
    assert pipeline.marked(pipeline.photos(spark, str(tmp_path)), "2026-01-01 00:00:00").where("phashed_at is not null and thumbnailed_at is null").count() == 4
    assert len(rows) == 4 and all(r["phash"] is not None and r["quality_score"] is not None for r in rows)


def test_samples_lie_between_their_neighbours():
    a = np.array([[0, 255]], np.uint8)[..., None].repeat(3, 2)
    assert images.sampled(a, 2, 1)[0, :, 0].tolist() == [0, 255] and images.sampled(a, 4, 1)[0, :, 0].tolist() == [0, 63, 191, 255]
    assert images.sampled(a, 1, 3)[:, 0, 0].tolist() == [127] * 3


def test_analysis_finds_what_the_corpus_holds(spark, tmp_path):
    manifest = corpus.generate(spark, str(tmp_path), width=160, height=120)
    want = corpus.truth(manifest).first()
    assert (want["files"], want["supported"], want["duplicate_groups"], want["duplicate_files"], want["near_duplicate_groups"], want["with_gps"]) == (46, 42, 3, 9, 6, 24)
    entries = scan.walk(spark, str(tmp_path))
    assert scan.statistics(entries).first()["supported"] == want["supported"]
    got = pipeline.run(spark, str(tmp_path), entries=entries)
    rows = {r["relative_path"]: r for r in got.photos.collect()}
    said = {r["rel_path"]: r for r in manifest.collect() if r["kind"] != "unsupported"}
    assert set(rows) == set(said) and {p for p, r in rows.items() if r["state"] == "failed"} == {p for p, r in said.items() if r["corrupt_stage"] == "header"}
    assert {p for p, r in rows.items() if r["phash"] is None} == {p for p, r in said.items() if r["corrupt_stage"]}
    for p, r in said.items():
        x = rows[p]
        if r["corrupt_stage"] != "header":
            assert (x["width"], x["height"], x["latitude"] is None) == (r["width"], r["height"], r["latitude"] is None), p
            assert (x["captured_at_source"] == "exif") == (r["captured_at"] is not None) and (r["captured_at"] is None or x["captured_at"] == r["captured_at"]), p
            assert r["latitude"] is None or abs(x["latitude"] - r["latitude"]) < 1e-6 and abs(x["longitude"] - r["longitude"]) < 1e-6
        if r["underexposed"] or r["overexposed"]:
            assert ("possibly_underexposed" if r["underexposed"] else "possibly_overexposed") in x["quality_flags"], p
    groups = {frozenset(r["p"]) for r in got.duplicate_members.groupBy("sha256").agg(F.collect_list("relative_path").alias("p")).collect()}
    named = lambda c: {frozenset(p for p, r in said.items() if r[c] == g) for g in {r[c] for r in said.values()} - {None}}
    assert groups == named("duplicate_group")
    similar = {frozenset(r["p"]) for r in got.similar_members.groupBy("group_id").agg(F.collect_list("relative_path").alias("p")).collect()}
    assert similar == named("similar_group")
    blurry = [rows[p]["sharpness_score"] for p, r in said.items() if r["blurry"]]
    assert max(blurry) < min(rows[p]["sharpness_score"] for p, r in said.items() if r["duplicate_group"])
    for _ in range(2):
        pipeline.store(got, str(tmp_path / ".tables"))
    kept = {n: spark.read.parquet(str(tmp_path / ".tables" / f"{n}.parquet")).count() for n in got._fields}
    assert kept == {n: t.count() for n, t in got._asdict().items()} and kept["photos"] == 42
    (tmp_path / "scene000.jpg").unlink()
    gone = scan.vanished(got.photos, scan.walk(spark, str(tmp_path), "library"))
    assert [r["photo_id"] for r in gone.collect()] == [rows["scene000.jpg"]["photo_id"]]
    after = photo_rows.mark_missing(pipeline.marked(got.photos, "2026-01-01 00:00:00"), gone, "2026-01-02 00:00:00").where("state = 'missing'").first()
    assert (after["relative_path"], after["captured_at"], after["width"], after["last_error"]) == ("scene000.jpg", None, None, "file not found")


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    graph.replace(spark.range(5), path)
    graph.replace(spark.read.parquet(path).where("id > 2"), path)
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {3, 4} and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_tables_of_a_scope_are_removed(spark):
    with graph.scratch(spark):
        inner = graph.cut(spark.range(3))
        files = [f.removeprefix("file:").replace("///", "/") for f in inner.inputFiles()]
        assert inner.count() == 3 and all(Path(f).exists() for f in files)
    outer = graph.cut(spark.range(2))
    assert not any(Path(f).exists() for f in files) and outer.count() == 2
    graph.discard(outer)
    assert not any(Path(f.removeprefix("file:")).exists() for f in outer.inputFiles())


def test_events_of_a_stream(spark, tmp_path):
    first = [("a", f"2024-01-01 0{h}:00:00") for h in (0, 4, 8)] + [("a", "2024-01-01 12:00:01"), ("b", "2024-01-01 00:00:00"), (None, None)]
    rows = spark.createDataFrame(first, "library_id string, t string").select("library_id", F.to_timestamp("t").alias("captured_at"))
    got = {(r["library_id"], r["photo_count"], str(r["started_at"])[11:]) for r in incremental.time_events(rows).collect()}
    assert got == {("a", 3, "00:00:00"), ("a", 1, "12:00:01"), ("b", 1, "00:00:00")}
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("c", "2024-02-01 00:00:00")], "library_id string, t string").select("library_id", F.to_timestamp("t").alias("captured_at"))
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = incremental.time_events(arriving).writeStream.format("memory").queryName("events_closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["library_id"], r["photo_count"]) for r in spark.table("events_closed").collect()} == {("a", 3), ("a", 1), ("b", 1)}


def test_arriving_files(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    q = incremental.arriving(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(distinct sha256) from arrived where path like '%png'").first()[0] >= 3
