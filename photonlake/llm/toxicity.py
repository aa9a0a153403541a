"""Toxicity from subword bags: character n-gram vectors averaged into a linear softmax, trained together.

A word is the mean of the vectors of its character n-grams, so an unseen misspelling shares most of
them with a word that was seen.  A window of words is the mean of its words; a document is as toxic as
its most toxic window, so that its length doesn't dilute an insult.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.folds import drawn, held_out
from photonlake.llm.graph import sent
from photonlake.llm.kernels import Chunk, chunks, lean, lower_table, schema_of, spread, words

#: Learned from about so many documents of each label (all where there are fewer), of any length.
SAMPLE_PER_LABEL = 1000
#: Characters of a text that serve for fitting, and in how many pieces they are taken from a longer one.
SAMPLE_CHARS = 12_000
SAMPLE_PIECES = 8
#: Lengths of n-grams in bytes, the word's two edges included; hashed vectors and their length.
GRAMS = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
DIM = 8
#: N-grams get a vector if their documents differ so much between labels, by the log-likelihood ratio, or
#: if they are in such a share (and number) of documents; rarer ones would only be learned by heart.
MIN_RATIO = 20.0
COMMON, COMMON_LEAST = 0.01, 40
EPOCHS = 24
#: Vectors that are summed at a time, about.
GATHERED = 1 << 17
#: Epochs at which windows of toxic documents are labelled anew.
RELABEL = (10, 16, 20)
#: Of a clean document every so-many-th window serves for fitting.
CLEAN_SHARE = 5
#: Words of a window.
WINDOW = 4
THRESHOLD = 0.7
RESULT = "doc_id long,held_out boolean,score double,predicted int"


class Model(NamedTuple):
    """What is left of vectors and softmax when scores are asked for: a number for each bucket."""

    bucket: np.ndarray
    bias: float
    slope: float
    shift: float


def grams(chunk: Chunk) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and validity of the n-grams at each place of the words laid out with one blank around each.

    Also where each word's n-grams begin, and the words [lo, hi) of each document.
    """
    found = words(chunk)
    lengths = found.ends - found.starts
    word, place = spread(lengths)
    text = np.full(int(lengths.sum()) + len(lengths) + 1, 0x20, np.uint8)
    begins = np.cumsum(lengths + 1) - lengths
    text[begins[word] + place] = lower_table()[chunk.data[found.starts[word] + place]]
    blanks = np.cumsum(text == 0x20, dtype=np.int32)
    buckets, valid = [], []
    code = np.zeros(len(text), np.uint32)
    for k in range(1, max(GRAMS) + 1):
        m = max(len(text) - k + 1, 0)
        code = code[:m] * np.uint32(0x01000193) + text[k - 1 : k - 1 + m] + np.uint32(1)
        if k in GRAMS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            buckets.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
            valid.append(blanks[k - 2 : k - 2 + m] == blanks[:m])
    return buckets, valid, begins - 1, found.lo, found.hi


def word_scores(chunk: Chunk, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean of the numbers of each word's n-grams; words [lo, hi) of each document."""
    buckets, valid, begins, lo, hi = grams(chunk)
    if not len(begins):
        return np.zeros(0), lo, hi
    sums = np.zeros(len(valid[0]) + max(GRAMS))
    counts = np.zeros(len(sums), np.int32)
    for own, good in zip(buckets, valid, strict=True):
        sums[: len(own)] += np.where(good, bucket[own], 0)
        counts[: len(own)] += good
    return np.add.reduceat(sums, begins) / np.maximum(np.add.reduceat(counts, begins), 1), lo, hi


def peaks(scores: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each document the greatest mean over WINDOW words (all words, if fewer); -inf without words."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    n = hi - lo
    counts = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
    doc, place = spread(counts)
    start = lo[doc] + place
    end = np.minimum(start + WINDOW, hi[doc])
    means = (total[end] - total[start]) / np.maximum(end - start, 1)
    out = np.full(len(n), -np.inf)
    some = counts > 0
    if some.any():
        out[some] = np.maximum.reduceat(means, (np.cumsum(counts) - counts)[some])
    return out


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Vectors and softmax fitted to windows, and a sigmoid from a document's peak to its label.

    A fifth of the documents is left out of the first fit and serves for the sigmoid only; then all are fitted.
    """
    hold = np.arange(len(texts)) % 5 == 0
    column = pa.array(texts, pa.large_string())
    first = _fitted(column, labels, hold)
    if first is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0)
    bucket, bias = first
    tops = np.full(len(texts), -np.inf)
    for chunk in chunks(column):
        tops[chunk.first : chunk.first + len(chunk.offsets) - 1] = peaks(*word_scores(chunk, bucket))
    slope, shift = _sigmoid(tops[hold] + bias, labels[hold], weights[hold])
    bucket, bias = _fitted(column, labels, np.zeros(len(texts), bool))
    return Model(bucket.astype(np.float32), bias, slope, shift)


def _fitted(column: pa.Array, labels: np.ndarray, hold: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Each bucket's part of the log odds, fitted to the windows of the documents that aren't held; None without words.

    Which windows of a toxic document are toxic isn't known: at first those with the n-grams that are
    over-represented in toxic documents, later those that the fit takes to be; the others count as clean.
    """
    vocabulary: dict[bytes, int] = {}
    piece_words: list[np.ndarray] = []
    piece_sizes: list[np.ndarray] = []
    piece_docs: list[np.ndarray] = []
    spread_of: list[np.ndarray] = []
    spread_docs: list[np.ndarray] = []
    lower = lower_table()
    for chunk in chunks(column):
        found = words(chunk)
        data = lower[chunk.data].tobytes()
        for i, (a, b) in enumerate(zip(found.lo, found.hi, strict=True)):
            if hold[chunk.first + i]:
                continue
            ids = np.array([vocabulary.setdefault(data[s:e], len(vocabulary)) for s, e in zip(found.starts[a:b].tolist(), found.ends[a:b].tolist(), strict=True)], np.int32)
            own = np.unique(ids)
            spread_of.append(own)
            spread_docs.append(np.full(len(own), chunk.first + i, np.int32))
            starts = np.arange(0, len(ids), WINDOW if labels[chunk.first + i] else WINDOW * CLEAN_SHARE)
            sizes = np.minimum(WINDOW, len(ids) - starts)
            piece, place = spread(sizes)
            piece_words.append(ids[starts[piece] + place])
            piece_sizes.append(sizes.astype(np.int32))
            piece_docs.append(np.full(len(sizes), chunk.first + i, np.int32))
    if not vocabulary:
        return None
    token_docs = (np.concatenate(spread_of), np.concatenate(spread_docs))
    what, bounds = _subwords(vocabulary)
    del vocabulary
    return _vectors(what, bounds, token_docs, np.concatenate(piece_words), np.concatenate(piece_sizes), np.concatenate(piece_docs), labels)


def _vectors(what: np.ndarray, bounds: np.ndarray, token_docs: tuple[np.ndarray, np.ndarray], flat: np.ndarray, sizes: np.ndarray, docs: np.ndarray, doc_labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Joint descent (Adam) on n-gram vectors and softmax; returns each bucket's part of the log odds.

    Word w has the buckets ``what`` [bounds[w], bounds[w + 1]); windows of ``sizes`` words lie end to end in ``flat``.
    """
    total = np.diff(bounds)
    evidence, telling = _evidence(what, bounds, token_docs, doc_labels)
    doubt = np.add.reduceat(evidence[what], bounds[:-1]) / np.maximum(total, 1)
    good = telling[what]
    if not good.any():
        return np.zeros(BUCKETS), 0.0
    word_of = np.repeat(np.arange(len(total), dtype=np.int32), total)[good]
    kept = what[good]
    del what, good
    present = np.zeros(BUCKETS, bool)
    present[kept] = True
    used = np.flatnonzero(present)
    slot_of = (np.cumsum(present, dtype=np.int32) - 1)[kept]
    del kept, present
    share = (1 / np.maximum(total, 1)).astype(np.float32)[:, None]
    by_slot = np.argsort(slot_of, kind="stable")
    slot_first = np.searchsorted(slot_of[by_slot], np.arange(len(used)))
    word_by_slot = word_of[by_slot]
    word_first = np.flatnonzero(np.concatenate([[True], word_of[1:] != word_of[:-1]]))
    del by_slot

    width = sizes[:, None].astype(np.float32)
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    piece_first = np.cumsum(sizes) - sizes
    by_token = np.argsort(flat, kind="stable")
    token = flat[by_token]
    piece_by_token = piece[by_token]

    # The evidence of a window is that of its strongest word, unless clean documents have the word too; within
    # a document, only windows near the top count.
    clean = doc_labels[token_docs[1]] == 0
    seen = [np.bincount(token_docs[0][own], minlength=len(total)) for own in (clean, ~clean)]
    chance = seen[0] * max((doc_labels > 0).sum(), 1) / max((doc_labels == 0).sum(), 1)
    excess = (np.maximum(seen[1] - chance, 0) / np.maximum(seen[1] + chance, 1)) ** 4
    strong = np.maximum.reduceat((excess * doubt)[flat], piece_first)
    peak = np.full(len(doc_labels), -np.inf)
    np.maximum.at(peak, docs, strong)
    labels = np.where(strong >= 0.5 * peak[docs], doc_labels[docs], 0.0)
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    top = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - labels.mean(), labels.mean()]) + 1e-6).astype(np.float32)
    having, word = word_of[word_first], np.zeros((len(total), DIM), np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, top, bias)]
    for t in range(1, EPOCHS + 1):
        word[having] = _gathered(vectors, slot_of, word_first)
        word *= share
        mean = np.add.reduceat(word[flat], piece_first) / width
        logits = mean @ top + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if t in RELABEL:
            peak = np.zeros(len(doc_labels))
            np.maximum.at(peak, docs, p[:, 1])
            labels = np.where((labels > 0) & (p[:, 1] < np.minimum(0.5, peak[docs])), 0.0, labels)
        gap = ((p - np.stack([1 - labels, labels], 1)) / len(sizes)).astype(np.float32)
        back = (gap @ top.T) / width
        word_back = _sums(back[piece_by_token], token, len(total)) * share
        own = [_gathered(word_back, word_by_slot, slot_first) + 1e-8 * vectors, mean.T @ gap, gap.sum(0)]
        for value, grad, (m, v) in zip((vectors, top, bias), own, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            size = np.sqrt(v / (1 - 0.99**t))
            value -= (0.2 * (m / (1 - 0.9**t)) / (size + size.mean())).astype(value.dtype)
    out = np.zeros(BUCKETS)
    out[used] = vectors @ (top[:, 1] - top[:, 0])
    return out, float(bias[1] - bias[0])


def _subwords(vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams, word after word, and where each word's begin, with the end."""
    text = b" ".join(vocabulary)
    buckets, valid, begins, _, _ = grams(Chunk(0, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    counts = []
    for good in valid:
        padded = np.zeros(len(text) + max(GRAMS), np.int32)
        padded[: len(good)] = good
        counts.append(np.add.reduceat(padded, begins))
    bounds = np.concatenate([[0], np.cumsum(sum(counts))])
    what, at = np.empty(bounds[-1], np.int32), bounds[:-1].copy()
    for own, good, n in zip(buckets, valid, counts, strict=True):
        what[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] = own[good]
        at += n
    return what, bounds


def _evidence(what: np.ndarray, bounds: np.ndarray, token_docs: tuple[np.ndarray, np.ndarray], doc_labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, its log-likelihood ratio if toxic documents outnumber what clean ones suggest (else 0), and whether it is telling."""
    counts = np.zeros((2, BUCKETS))
    cuts = np.flatnonzero(np.concatenate([[True], token_docs[1][1:] != token_docs[1][:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ids = token_docs[0][a:b]
        at, place = spread(bounds[ids + 1] - bounds[ids])
        counts[int(doc_labels[token_docs[1][a]] > 0), np.unique(what[bounds[ids][at] + place])] += 1
    seen = np.unique(token_docs[1])
    share = np.clip((doc_labels[seen] > 0).mean(), 1e-6, 1 - 1e-6)
    expected = np.maximum(counts.sum(0) * np.array([[1 - share], [share]]), 1e-9)
    ratio = 2 * (counts * np.log(np.maximum(counts, 1e-9) / expected)).sum(0)
    return np.where(counts[1] > expected[1], ratio, 0).astype(np.float32), (ratio >= MIN_RATIO) | (counts.sum(0) >= max(COMMON * len(seen), COMMON_LEAST))


def _gathered(rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows[at] from each of the places ``first`` to the next, some at a time."""
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(at), GATHERED)), len(first)))
    ends = np.append(first, len(at))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = np.add.reduceat(rows[at[first[a] : ends[b]]], first[a:b] - first[a])
    return out


def _sums(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by their group, in ascending order; 0 for groups without a row."""
    out = np.zeros((groups, rows.shape[1]), rows.dtype)
    if len(group):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[first]] = np.add.reduceat(rows, first)
    return out


def _sigmoid(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, by damped Newton steps with a small ridge."""
    good = np.isfinite(x)
    x, y, weight = x[good], y[good], weight[good]
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    z = np.stack([x, np.ones(len(x))], 1)
    theta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-3]) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ theta)
        theta = theta + np.clip(step, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def _pieces(text: Column) -> Column:
    """A text of up to SAMPLE_CHARS; of a longer one SAMPLE_PIECES stretches from its beginning to its end, so many together."""
    n, size = F.length(text), SAMPLE_CHARS // SAMPLE_PIECES
    parts = [F.substr(text, F.floor((n - size) * i / (SAMPLE_PIECES - 1)).cast("int") + 1, F.lit(size)) for i in range(SAMPLE_PIECES)]
    return F.when(n <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled, not held-out documents; None where one of the labels is missing.

    A document labelled twice is toxic if a label says so.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(marks.groupBy("toxic").count().collect())
    chosen = drawn(marks, "toxic", "doc_id", SAMPLE_PER_LABEL)
    of = dict(counts)

    @lean
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[str, int], int] = {}
        for batch in batches:
            for x in batch.to_pylist():
                key = x["text"], x["toxic"]
                least[key] = min(least.get(key, x["doc_id"]), x["doc_id"])
        rows = sorted(least.items(), key=lambda x: (x[1], x[0]))
        y = np.array([float(toxic > 0) for (_, toxic), _ in rows])
        if len(y) and y.min() < y.max():
            drawn_of = {toxic: sum(t == toxic for (_, t), _ in rows) for toxic in of}
            weight = np.array([of[toxic] / drawn_of[toxic] for (_, toxic), _ in rows])
            model = train([text for (text, _), _ in rows], y, weight / weight.mean())
            yield pa.RecordBatch.from_arrays([pa.array([model.bucket.tobytes()], pa.binary()), *(pa.array([x]) for x in model[1:])], names=list(Model._fields))

    # About two times SAMPLE_PER_LABEL rows, fitted by one task, so that the driver keeps nothing but the model.
    sample = docs.join(sent(chosen), "doc_id").where("text is not null").select("doc_id", _pieces(F.col("text")).alias("text"), F.col("toxic").cast("int").alias("toxic")).repartition(1)
    found = sample.mapInArrow(fit, "bucket binary, bias double, slope double, shift double").first()
    return found and Model(np.frombuffer(bytes(found["bucket"]), np.float32), *found[1:])


def probabilities(texts: pa.Array, model: Model | None) -> np.ndarray:
    """The score of each text; 0 without words or without a model."""
    out = np.zeros(len(texts))
    for chunk in chunks(texts) if model else ():
        top = peaks(*word_scores(chunk, model.bucket))
        some = np.isfinite(top)
        odds = model.slope * (np.where(some, top, 0) + model.bias) + model.shift
        out[chunk.first : chunk.first + len(top)] = some / (1 + np.exp(-np.clip(odds, -700, 700)))
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``, from its whole text.

    A null text and one without words have score 0, as has every text when there is no model.  Equal
    texts get equal answers; null ids and other columns change nothing.
    """

    @lean
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = probabilities(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], schema=schema_of(RESULT))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, RESULT)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, null and empty texts included."""

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column("text"), model) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
