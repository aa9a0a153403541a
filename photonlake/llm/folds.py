"""The split of labelled rows into those that are learned from and those that are held out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.llm.graph import sent
from photonlake.llm.names import unused


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 3; a null id is not, and isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of ``key``: all of them where there are fewer.

    Counts are taken over all rows, and joined to them as a table of one row for each value.
    """
    of, n = unused("of", rows), unused("n", rows)
    counts = sent(rows.groupBy(F.col(by).alias(of)).agg(F.count(F.lit(1)).alias(n)))
    place = F.pmod(F.xxhash64(F.lit("draw"), F.col(key)), F.lit(1 << 24)) / float(1 << 24)
    return rows.join(counts, F.col(by) == F.col(of)).where(place * F.col(n) < most).drop(of, n)
