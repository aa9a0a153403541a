"""Pixels: perceptual hash, quality measurements, thumbnails and headers of image files.

Pictures are decoded once, and all features of a picture are computed together.  Spark's image source
decodes JPEG, PNG, GIF and BMP in the JVM; WebP has no decoder there, so only its header is read.
Thumbnails are JPEG files, written by :mod:`photonlake.sources.thumbnails`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions import jpeg
from photonlake.functions.columns import clean_place, clean_text, display_size, exif_time, quality_scores

LONG_EDGE, THUMBNAIL_EDGE, THUMBNAIL_QUALITY, BACKGROUND = 512, 400, 82, 0xEE
#: The error of a file that is no image.
NO_IMAGE = "not an image"
#: The error of an image whose pixels break off.
BROKEN_OFF = "unexpected end of file"
MEASURED = "phash long, raw_laplacian_variance double, mean_luminance double, deviation double, shadow_clipping double, highlight_clipping double"


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def _weights(source: int, target: int, kernel: str) -> np.ndarray:
    """A target x source matrix that resamples one axis; wider than a pixel when it shrinks."""
    scale = source / target
    reach = max(scale, 1.0)
    offset = (np.arange(target)[:, None] + 0.5) * scale - 0.5 - np.arange(source)[None]
    x = np.abs(offset / reach)
    if kernel == "linear":
        w = np.maximum(1 - x, 0)
    else:
        w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, kernel: str = "cubic") -> np.ndarray:
    """Rows and columns resampled one after the other."""
    h, w = image.shape[:2]
    rows = np.tensordot(_weights(h, height, kernel), image.astype(float), (1, 0))
    return np.moveaxis(np.tensordot(_weights(w, width, kernel), rows, (1, 1)), 0, 1)


def _neighbours(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of an axis of ``target`` pixels the two of ``source`` around its middle, and the weight of the second."""
    at = (np.arange(target) + 0.5) * (source / target) - 0.5
    first = np.floor(at).astype(int)
    weight = at - first
    outside = (first < 0) | (first + 1 > source - 1)
    first = np.clip(first, 0, source - 1)
    return first, np.where(outside, first, first + 1), np.where(outside, 0.0, weight)


def sampled(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel from the four around its middle, in 16 bits a channel, cut to 8."""
    top, bottom, down = _neighbours(rgb.shape[0], height)
    left, right, across = _neighbours(rgb.shape[1], width)
    deep = lambda rows, columns: rgb[rows][:, columns].astype(float) * 257
    rows = [(1 - across)[None, :, None] * deep(r, left) + across[None, :, None] * deep(r, right) for r in (top, bottom)]
    mixed = (1 - down)[:, None, None] * rows[0] + down[:, None, None] * rows[1]
    return (mixed.astype(np.int64) >> 8).astype(np.uint8)


def dhash(rgb: np.ndarray) -> int:
    """64 comparisons of neighbours in a 9 by 8 picture, row by row from the lowest bit; as a signed long."""
    grey = luma(sampled(rgb[..., :3], 9, 8).astype(float))
    bits = (grey[:, :-1] > grey[:, 1:]).ravel()
    value = int(np.sum(np.where(bits, np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)), np.uint64(0)), dtype=np.uint64))
    return value - (1 << 64) if value >> 63 else value


def quality(rgb: np.ndarray) -> tuple[float, float, float, float, float]:
    """Variance of the Laplacian, mean, deviation, and shares of nearly black and nearly white, at a fixed scale."""
    h, w = rgb.shape[:2]
    long = max(h, w)
    grey = luma(np.clip(np.rint(resize(rgb, max(1, w * LONG_EDGE // long), max(1, h * LONG_EDGE // long))), 0, 255))
    variance = 0.0
    if min(grey.shape) >= 3:
        soft = np.pad(grey, 1, mode="edge")
        soft = (soft[:-2] + 2 * soft[1:-1] + soft[2:]) / 4
        soft = (soft[:, :-2] + 2 * soft[:, 1:-1] + soft[:, 2:]) / 4
        edge = soft[:-2, 1:-1] + soft[2:, 1:-1] + soft[1:-1, :-2] + soft[1:-1, 2:] - 4 * soft[1:-1, 1:-1]
        variance = float(edge.var())
        variance = 0.0 if variance < 1e-9 else variance
    return variance, float(grey.mean()), float(grey.std()), float((grey <= 2).mean()), float((grey >= 253).mean())


def orient(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is to be shown; orientations other than 2 to 8 change nothing."""
    if orientation in (5, 6, 7, 8):
        rgb = np.swapaxes(rgb, 0, 1)
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    if orientation in (3, 4, 7, 8):
        rgb = rgb[::-1]
    return rgb


def flatten(rgba: np.ndarray) -> np.ndarray:
    """Transparent pixels over a light grey."""
    if rgba.shape[2] < 4:
        return rgba
    alpha = rgba[..., 3:].astype(float) / 255
    return np.rint(rgba[..., :3] * alpha + BACKGROUND * (1 - alpha)).astype(np.uint8)


def thumbnail(image: np.ndarray, orientation: int = 1, edge: int = THUMBNAIL_EDGE) -> np.ndarray:
    """Flattened, shrunk to the edge but never enlarged, then turned."""
    rgb = flatten(image)
    h, w = rgb.shape[:2]
    if max(h, w) > edge:
        rgb = np.clip(np.rint(resize(rgb, max(1, w * edge // max(h, w)), max(1, h * edge // max(h, w)))), 0, 255).astype(np.uint8)
    return orient(rgb, orientation)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB file."""
    h, w = rgb.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb[..., :3]).reshape(h, w * 3)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def from_grey(rows: DataFrame, key: str) -> DataFrame:
    """(key, image) in the layout of Spark's image source, from (width, height, grey values by row)."""
    bytes_ = F.unhex(F.array_join(F.transform("grey", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return rows.select(key, F.struct("height", "width", F.lit(1).alias("nChannels"), bytes_.alias("data")).alias("image"))


def _raster(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """RGB or RGBA from the image source's BGR rows; None for what it couldn't decode."""
    if height is None or height <= 0 or width <= 0 or data is None or len(data) != height * width * channels:
        return None
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(image, 3, 2)
    return image[..., [2, 1, 0, 3][:channels]]


def measured(rows: DataFrame, key: str) -> DataFrame:
    """(key, width, height, hash, measurements, scores, flags) of rows (key, image); null where decoding failed."""
    kind = dict(rows.dtypes)[key]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("height", "width", "nChannels", "data")]
            for height, width, channels, data in zip(*columns, strict=True):
                image = _raster(height, width, channels, data)
                if image is None:
                    out.append((None,) * 8)
                    continue
                rgb = flatten(image)
                out.append((width, height, dhash(rgb), *quality(rgb)))
            found = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=[key, "width", "height", *(x.split()[0] for x in MEASURED.split(", "))])

    flat = rows.select(key, *(F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")))
    found = flat.mapInArrow(measure, f"{key} {kind}, width int, height int, {MEASURED}")
    scores = quality_scores(*(F.col(c) for c in ("raw_laplacian_variance", "mean_luminance", "deviation", "shadow_clipping", "highlight_clipping", "width", "height")))
    known = F.col("width").isNotNull()
    return found.withColumns({name: F.when(known, c).otherwise(F.array().cast("array<string>")) if name == "quality_flags" else F.when(known, c) for name, c in scores.items()}).drop("deviation")


def thumbnails(rows: DataFrame, key: str, edge: int = THUMBNAIL_EDGE, quality: int | None = None) -> DataFrame:
    """(key, width, height, bytes) of rows (key, image, orientation); null where decoding failed.

    PNG, without loss, or JPEG of a quality where one is given: THUMBNAIL_QUALITY is that of stored ones.
    """
    kind = dict(rows.dtypes)[key]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for height, width, channels, data, turn in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "nChannels", "data", "orientation")), strict=True):
                image = _raster(height, width, channels, data)
                small = None if image is None else thumbnail(image, turn or 1, edge)
                out.append((None, None, None) if small is None else (small.shape[1], small.shape[0], png(small) if quality is None else jpeg.encode(small, quality)))
            found = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.int32(), pa.binary()), strict=True))], names=[key, "thumbnail_width", "thumbnail_height", "thumbnail"])

    flat = rows.select(key, *(F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")), "orientation")
    return flat.mapInArrow(render, f"{key} {kind}, thumbnail_width int, thumbnail_height int, thumbnail binary")


def header(content: bytes) -> tuple[str, int, int, bytes | None] | None:
    """(format, width, height, TIFF block) by content; None if it is no image."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        block, at = None, 8
        while at + 8 <= len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"eXIf":
                block = content[at + 8 : at + 8 + size]
            at += size + 12
        return ("png", *struct.unpack(">II", content[16:24]), block)
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return ("gif", *struct.unpack("<HH", content[6:10]), None)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        kind = content[12:16]
        if kind == b"VP8X":
            return "webp", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little"), None
        if kind == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), None
        return ("webp", *(x & 0x3FFF for x in struct.unpack("<HH", content[26:30])), None)
    if content[:2] != b"\xff\xd8":
        return None
    block, at = None, 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            block = body[6:]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(body) < 5:
                return None
            height, width = struct.unpack(">HH", body[1:5])
            return "jpeg", width, height, block
        at += 2 + size
    return None


def complete(content: bytes) -> bool:
    """Whether a JPEG or PNG file ends where its pixels do; decoders fill up what a broken-off file lacks."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return content.rfind(b"IEND") > 0
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        if content[at + 1] == 0xDA:
            return content.find(b"\xff\xd9", at) > 0
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return content[:2] != b"\xff\xd8"


def tiff(block: bytes | None) -> dict[str, object]:
    """The tags of interest of a TIFF block: strings, numbers and places; what can't be read is left out."""
    if not block or block[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if block[:2] == b"II" else ">"
    found: dict[str, object] = {}

    def value(kind: int, count: int, raw: bytes) -> object:
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
        body = raw if size <= 4 else block[(at := struct.unpack(order + "I", raw)[0]) : at + size]
        if kind == 2:
            return body[:count].decode("utf-8", "replace")
        if kind == 3:
            return struct.unpack(order + "H", body[:2])[0]
        if kind == 4:
            return struct.unpack(order + "I", body[:4])[0]
        if kind == 5:
            parts = struct.unpack(order + f"{2 * count}I", body[: 8 * count])
            return [a / b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]
        return None

    def directory(at: int, names: dict[int, str]) -> None:
        (entries,) = struct.unpack(order + "H", block[at : at + 2])
        for i in range(entries):
            tag, kind, count, raw = struct.unpack(order + "HHI4s", block[at + 2 + 12 * i : at + 14 + 12 * i])
            if tag in names:
                found[names[tag]] = value(kind, count, raw)

    try:
        directory(struct.unpack(order + "I", block[4:8])[0], {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "time", 0x8769: "exif", 0x8825: "gps"})
        if isinstance(found.get("exif"), int):
            directory(found["exif"], {0x9003: "original", 0x9004: "digitized"})
        if isinstance(found.get("gps"), int):
            directory(found["gps"], {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"})
    except (struct.error, UnicodeDecodeError):
        pass
    return found


def _degrees(parts: object, ref: object) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3 or None in parts or not isinstance(ref, str):
        return None
    size = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -size if ref[:1] in ("S", "W") else size


RAW = "detected_format string, raw_width int, raw_height int, raw_orientation int, make string, model string, original string, digitized string, time string, raw_latitude double, raw_longitude double, half_place boolean, complete boolean"


def metadata(files: DataFrame, key: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """What the header and EXIF of rows (key, content, modificationTime) tell; a file that is no image is failed.

    The columns ``keep`` are passed on, so that what is made of the same contents needs no second read.
    """
    kind = dict(files.dtypes)[key]
    passed = [key, *keep]
    names = [x.split()[0] for x in RAW.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in RAW.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                head = header(content or b"")
                if head is None or head[1] <= 0 or head[2] <= 0:
                    out.append((None,) * len(names))
                    continue
                x = tiff(head[3])
                text = lambda n, x=x: v if isinstance(v := x.get(n), str) else None
                lat, lon = _degrees(x.get("lat"), x.get("lat_ref")), _degrees(x.get("lon"), x.get("lon_ref"))
                turn = x.get("orientation")
                out.append((*head[:3], turn if isinstance(turn, int) else None, text("make"), text("model"), text("original"), text("digitized"), text("time"), lat, lon, (lat is None) != (lon is None), complete(content)))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*passed, "modificationTime")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*passed, "modificationTime", *names])

    kept = "".join(f", {c} {dict(files.dtypes)[c]}" for c in keep)
    rows = files.select(*passed, "modificationTime", "content").mapInArrow(read, f"{key} {kind}{kept}, modificationTime timestamp, {RAW}")
    good = F.col("raw_orientation").between(1, 8)
    turn = F.when(good, F.col("raw_orientation"))
    width, height = display_size(F.col("raw_width"), F.col("raw_height"), F.coalesce(turn, F.lit(1)))
    lat, lon = clean_place(F.col("raw_latitude"), F.col("raw_longitude"))
    texts = [F.replace(c, F.lit("\x00"), F.lit("")) for c in ("original", "digitized", "time")]
    taken = exif_time(*texts)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("raw_orientation").isNotNull() & ~good, "orientation out of range"),
            F.when(F.coalesce(*(clean_text(x) for x in texts)).isNotNull() & taken.isNull(), "capture time unreadable"),
            F.when(F.col("half_place"), "half a place"),
            F.when(F.col("raw_latitude").isNotNull() & F.col("raw_longitude").isNotNull() & lat.isNull(), "place out of range"),
        )
    )
    image = F.col("detected_format").isNotNull()
    return rows.select(
        *passed, "detected_format", width.alias("width"), height.alias("height"), turn.alias("orientation"), F.when(image, F.coalesce(taken, F.col("modificationTime"))).alias("captured_at"),
        F.when(image & taken.isNotNull(), "exif").when(image & F.col("modificationTime").isNotNull(), "filesystem").alias("captured_at_source"), lat.alias("latitude"), lon.alias("longitude"),
        clean_text(F.col("make")).alias("camera_make"), clean_text(F.col("model")).alias("camera_model"), F.when(image, "processing").otherwise("failed").alias("state"),
        F.coalesce("complete", F.lit(False)).alias("complete"),
        F.when(~image, NO_IMAGE).when(F.size(warnings) > 0, F.concat(F.lit("metadata warnings: "), F.concat_ws("; ", warnings))).alias("last_error"),
    )


def _decoded(path: Column) -> Column:
    """A path without percent signs for blanks and the like; a plus sign is one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """(path, image) of the files below a folder, decoded, with paths as binaryFile gives them; what can't be decoded has a height of -1."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[jJ][pP][eE],[pP][nN][gG]}").load(root).select(F.regexp_replace(_decoded(F.col("image.origin")), "^file:/+", "file:/").alias("path"), "image")
