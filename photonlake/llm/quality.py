"""Learned quality rules: a decision list over text statistics, grown and pruned by sequential covering.

Each rule is a conjunction of thresholds that holds for bad texts.  Rules are found one after another
on labelled statistics: grown on two thirds of the rows that no earlier rule covers, pruned on the
rest, and kept while they are precise there.  The list becomes one ordered Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.folds import drawn, held_out
from photonlake.llm.kernels import U64, Hasher, chunks, inside, lean, mix, schema_of, windows, words

#: Learned from about so many documents of each label (all where there are fewer).
SAMPLE_PER_LABEL = 4000
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A rule is kept with at least this precision on the rows kept for pruning, covering so many bad rows there.
MIN_PRECISION = 0.9
MIN_COVER = 3
MAX_RULES = 16
MAX_TERMS = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: What rules may compare: a count over another.
RATIOS = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}
STATS = "doc_id long," + ",".join(f"{c} long" for c in COUNTS)


class Term(NamedTuple):
    ratio: str
    above: bool
    limit: float


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id and COUNTS) of each row's whole text; all 0 for a null or empty text."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        tables = {"n_symbols": _table("#*$%&|<>"), "n_upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_marks": _table("!?;:\"'()[]{}=+~^_\\/@")}
        for batch in batches:
            out = {name: np.zeros(len(batch), np.int64) for name in COUNTS}
            for chunk in chunks(batch.column("text")):
                rows = slice(chunk.first, chunk.first + len(chunk.offsets) - 1)
                for name, values in _counts(chunk, hasher, tables).items():
                    out[name][rows] = values
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[name]) for name in COUNTS)], schema=schema_of(STATS))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, STATS)


def _repeats(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more with the same owner."""
    keys = mix(hashes ^ mix(owner.astype(U64) + U64(1)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return found


def _counts(chunk, hasher: Hasher, tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:  # noqa: ANN001
    data, offsets = chunk.data, chunk.offsets
    n = len(offsets) - 1
    found = words(chunk)
    sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])
    out = {name: sums(table[data]) for name, table in tables.items()}
    out["n_words"] = found.hi - found.lo
    covered = np.zeros(len(data) + 1, np.int8)
    covered[found.starts] = 1
    covered[found.ends] -= 1
    out["word_chars"] = sums((np.cumsum(covered[:-1]) > 0) & ((data & 0xC0) != 0x80))
    prefix = hasher.prefix(data)
    # Lines: cut at each \n and at the ends of documents; only those with a word count.
    cuts = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    line_end = np.sort(np.concatenate([cuts, offsets[1:]]))
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, cuts, "right") - 1]))
    solid = np.searchsorted(found.starts, line_end) > np.searchsorted(found.starts, line_start)
    line_start, line_end, line_doc = line_start[solid], line_end[solid], line_doc[solid]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    keys = mix(hasher.ranges(prefix, line_start, line_end) ^ mix(line_doc.astype(U64) + U64(1)))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[np.unique(keys, return_index=True)[1]], minlength=n)
    # Words in repeated windows.
    runs = windows(hasher.ranges(prefix, found.starts, found.ends), REPEAT_WINDOW)
    at, doc = inside(found.lo, found.hi, REPEAT_WINDOW)
    again = at[_repeats(runs[at], doc)] if len(at) else at
    mark = np.zeros(len(found.starts) + 1, np.int64)
    mark[again] += 1
    np.subtract.at(mark, again + REPEAT_WINDOW, 1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    out["n_repeat_words"] = hit[found.hi] - hit[found.lo]
    return out


def _matrix(rows: dict[str, np.ndarray]) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        columns = [rows[a].astype(float) if b is None else np.where(rows[b] > 0, rows[a] / np.maximum(rows[b], 1), 0.0) for a, b in RATIOS.values()]
    return np.stack(columns, 1)


def _holds(rule: list[Term], x: np.ndarray) -> np.ndarray:
    names = list(RATIOS)
    out = np.ones(len(x), bool)
    for term in rule:
        value = x[:, names.index(term.ratio)]
        out &= value > term.limit if term.above else value <= term.limit
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Term]:
    """Terms added one at a time by information gain, until no good row is covered."""
    rule: list[Term] = []
    inside_ = np.ones(len(x), bool)
    while len(rule) < MAX_TERMS and (inside_ & ~bad).any() and (inside_ & bad).any():
        p, n = (inside_ & bad).sum(), (inside_ & ~bad).sum()
        best: tuple[float, Term] | None = None
        for j, name in enumerate(RATIOS):
            limits = np.unique(np.quantile(x[inside_, j], np.linspace(0, 1, 129)))
            limits = (limits[1:] + limits[:-1]) / 2
            up = x[inside_, j][:, None] > limits[None]
            for above, hold in ((True, up), (False, ~up)):
                pp, nn = hold[bad[inside_]].sum(0), hold[~bad[inside_]].sum(0)
                gain = pp * (np.log2((pp + 1e-9) / (pp + nn + 1e-9)) - np.log2(p / (p + n)))
                if len(gain) and (best is None or gain.max() > best[0] + 1e-9):
                    best = (float(gain.max()), Term(name, above, float(limits[int(gain.argmax())])))
        if best is None or best[0] <= 1e-6:
            break
        rule.append(best[1])
        inside_ &= _holds([best[1]], x)
    return rule


def cover(x: np.ndarray, bad: np.ndarray) -> list[list[Term]]:
    """An ordered list of rules for the bad rows; empty where nothing precise is found."""
    rules: list[list[Term]] = []
    own = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        rule = _grow(x[left & ~own], bad[left & ~own])
        px, pb = x[left & own], bad[left & own]

        def worth(terms: list[Term], px: np.ndarray = px, pb: np.ndarray = pb) -> float:
            hold = _holds(terms, px)
            return (pb[hold].sum() - (~pb[hold]).sum()) / max(hold.sum(), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hold = _holds(rule, px)
        if not rule or pb[hold].sum() < MIN_COVER or pb[hold].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~_holds(rule, x)
    return rules


def learn(docs: DataFrame, labels: DataFrame) -> list[list[Term]]:
    """Rules from the labelled, not held-out documents; none where a label is missing.

    A document labelled twice counts as bad if a label says so.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = drawn(marks, "quality", "doc_id", SAMPLE_PER_LABEL)  # about two times SAMPLE_PER_LABEL rows
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")).join(chosen, "doc_id")
    got = rows.toPandas().sort_values(["doc_id", *COUNTS], kind="stable")
    bad = got["quality"].to_numpy() == 0
    if not len(got) or bad.all() or not bad.any():
        return []
    return cover(_matrix({name: got[name].to_numpy() for name in COUNTS}), bad)


def fired(rules: list[list[Term]]) -> Column:
    """The number of the first rule that holds, from 1; null if none does.  Works on columns named as COUNTS."""

    def term(t: Term) -> Column:
        a, b = RATIOS[t.ratio]
        value = F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        return value > t.limit if t.above else value <= t.limit

    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = term(rule[0])
        for t in rule[1:]:
            holds = holds & term(t)
        out = F.when(holds, number).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, rule) of each row of ``docs``, from its whole text.

    A null or empty text has counts of 0 and fails the base rule; equal texts get equal answers; null
    ids and other columns change nothing; without rules the base rule alone decides.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return statistics(docs).withColumns({"base_failed": base, "rule": fired(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
