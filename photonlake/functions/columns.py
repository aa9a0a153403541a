"""Column functions: hashes, places, classifications and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photonlake.config import EARTH_RADIUS_METRES, FORMATS, QualityThresholds


def path_depth(path: Column) -> Column:
    """The number of slashes."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def format_of(path: Column) -> Column:
    """The format an extension names, in any case; null if unsupported."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair)), ext)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(value: Column) -> Column:
    """16 lower-case digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_METRES * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def located(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def escape_like(text: str) -> str:
    """A literal for LIKE with backslash as the escape."""
    for char in ("\\", "%", "_"):
        text = text.replace(char, "\\" + char)
    return text


def _one_place(x: Column) -> Column:
    """One decimal, rounded by the exact value of the double."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for power, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= F.lit(1024**power), F.concat(_one_place(n.cast("double") / float(1024**power)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def human_metres(m: Column) -> Column:
    return F.when(m < 1000, F.concat(F.replace(F.format_number(m, 0), F.lit(","), F.lit("")), F.lit("m"))).otherwise(F.concat(_one_place(m / 1000), F.lit("km")))


def human_span(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    days = F.format_string("%dd%02dh", F.floor(s / 86400), F.floor(s / 3600) % 24)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60))).when(s < 86400, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60)).otherwise(days)


def human_ago(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(seconds < 2, "just now").when(s < 60, F.format_string("%ds ago", s)).when(s < 3600, F.format_string("%dm ago", F.floor(s / 60))).otherwise(F.format_string("%dh ago", F.floor(s / 3600)))


def uptime(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh%dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def confidence(filesystem_dated: Column, photos: Column) -> Column:
    """How far an event's bounds rest on camera dates."""
    return F.when(filesystem_dated == 0, "high").when(filesystem_dated == photos, "low").otherwise("mixed")


def scan_state(started: Column, finished: Column) -> Column:
    return F.when(started.isNull(), "never_scanned").when(finished.isNull() | (finished < started), "scanning").otherwise("complete")


def attempts_remaining(attempts: Column, most: Column) -> Column:
    return F.greatest(most - attempts, F.lit(0))


def backoff_seconds(attempt: Column) -> Column:
    """The wait before the next try, without jitter: 2 s doubled for each try, 300 s at most."""
    return F.least(F.lit(300.0), 2.0 * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(30))))


def dedupe_key(job_type: Column, target: Column) -> Column:
    return F.concat_ws(":", job_type, target)


def exif_time(*texts: Column) -> Column:
    """The first text that reads as YYYY:MM:DD HH:MM:SS in or after 1900, as UTC."""
    parsed = [F.try_to_timestamp(F.trim(t), F.lit("yyyy:MM:dd HH:mm:ss")) for t in texts]
    return F.coalesce(*(F.when(F.year(p) >= 1900, p) for p in parsed))


def clean_text(text: Column) -> Column:
    """Without NULs and outer blanks; null if nothing is left."""
    return F.nullif(F.trim(F.replace(text, F.lit("\x00"), F.lit(""))), F.lit(""))


def clean_place(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Both coordinates, or null for both if one is missing or out of range or both are zero."""
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, lat), F.when(good, lon)


def display_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height as shown: swapped for orientations 5 to 8."""
    turned = orientation.between(5, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def quality_scores(variance: Column, mean: Column, deviation: Column, shadow: Column, highlight: Column, width: Column, height: Column, t: QualityThresholds = QualityThresholds()) -> dict[str, Column]:
    """Scores between 0 and 1 and the flags, in their fixed order, from measurements of an image."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    pixels = width.cast("long") * height.cast("long")
    sharp = F.when(variance <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(variance / t.full_sharpness)))
    band = F.when(mean < t.dark, (t.dark - mean) / t.dark).when(mean > t.bright, (mean - t.bright) / (255 - t.bright)).otherwise(0.0)
    exposure = unit(1 - band - 0.5 * shadow - 0.5 * highlight)
    contrast = F.least(F.lit(1.0), deviation / t.full_contrast)
    resolution = F.least(F.lit(1.0), pixels / t.full_pixels)
    tests = [
        ("possibly_blurry", sharp < t.sharpness),
        ("possibly_underexposed", mean < t.dark),
        ("possibly_overexposed", mean > t.bright),
        ("possibly_low_contrast", contrast < t.contrast),
        ("low_resolution", pixels < t.min_pixels),
        ("shadows_clipped", shadow > t.clipping),
        ("highlights_clipped", highlight > t.clipping),
    ]
    return {
        "sharpness_score": sharp,
        "exposure_score": exposure,
        "contrast_score": contrast,
        "resolution_score": resolution,
        "quality_score": unit(0.45 * sharp + 0.30 * exposure + 0.15 * contrast + 0.10 * resolution),
        "quality_flags": F.array_compact(F.array(*(F.when(test, name) for name, test in tests))),
    }


def canonical_id(value: Column) -> Column:
    """Whether a text is an id as it names files: lower-case hexadecimal digits in groups of 8, 4, 4, 4 and 12."""
    return F.coalesce(value.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))
