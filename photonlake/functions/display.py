"""Texts shown to people.  What isn't known is a dash, never a zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _or_dash(known: Column, text: Column) -> Column:
    return F.when(known, text).otherwise(F.lit(DASH))


def fixed(x: Column) -> Column:
    """One decimal; halves that a double holds exactly go up."""
    exact = F.when(x * 4 % 1 == 0, F.floor(x * 10 + 0.5) / 10).otherwise(x)
    return F.replace(F.format_number(exact, 1), F.lit(","), F.lit(""))


def shorten(text: Column, most: int) -> Column:
    """The beginning of a long text."""
    cut = F.left(text, F.lit(most)) if most <= 3 else F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def shorten_path(path: Column, most: int) -> Column:
    """The end of a long path, where paths differ."""
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(most - 3))))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def library_name(path: Column) -> Column:
    """The last folder of a path; the path itself where there is none."""
    last = F.regexp_replace(file_name(F.regexp_replace(path, "/+$", "")), ":$", "")
    return F.when(last.isin("", "."), path).otherwise(last)


def flag_text(flag: Column) -> Column:
    words = F.replace(flag, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 20))


def size_text(n: Column) -> Column:
    """Bytes with one decimal below 100 of a unit, none above."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n.cast("double") / float(1024**power)
        out = F.when(n >= F.lit(1024**power), F.concat(F.when(v < 100, fixed(v)).otherwise(F.floor(v + 0.5).cast("string")), F.lit(f" {unit}"))).otherwise(out)
    return _or_dash(n >= 0, out)


def score_text(score: Column) -> Column:
    return _or_dash(score.isNotNull(), F.format_number(score, 2))


def dimensions(width: Column, height: Column) -> Column:
    return _or_dash(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("×"), height.cast("string")))


def distance_text(metres: Column) -> Column:
    near = F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))
    return _or_dash(metres.isNotNull(), F.when(metres < 1000, near).otherwise(F.concat(fixed(metres / 1000), F.lit(" km"))))


def counted(n: Column, noun: str, plural: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {noun}").otherwise(f" {plural or noun + 's'}"))


def date_text(time: Column) -> Column:
    return _or_dash(time.isNotNull(), F.date_format(time, "d MMM yyyy"))


def time_text(time: Column) -> Column:
    return _or_dash(time.isNotNull(), F.date_format(time, "d MMM yyyy, HH:mm"))


def span_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60 + 0.5).cast("long")
    hours, rest = F.floor(minutes / 60), minutes % 60
    short = F.when(rest > 0, F.format_string("%d h %d min", hours, rest)).otherwise(F.format_string("%d h", hours))
    long = F.format_string("%d d %d h", F.floor(hours / 24), hours % 24)
    return _or_dash(seconds >= 0, F.when(minutes < 1, "under a minute").when(minutes < 60, F.format_string("%d min", minutes)).when(hours < 24, short).otherwise(long))
