"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each bit.  The
language whose codeword has the least weighted loss wins; weights say how well a bit is predicted for
a language.  A small gap to the second-best language marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.folds import drawn, held_out
from photonlake.llm.kernels import chunks, is_space, lean, lower_table, schema_of

#: Learned from about so many documents of a language (all where there are fewer), whole texts of any length.
SAMPLE_PER_LANGUAGE = 400
#: Hashed features; lengths of the byte n-grams.
FEATURES = 4096
GRAMS = (1, 2, 3)
#: A gap of weighted mean losses below this is ambiguous.
AMBIGUOUS = 0.15
UNKNOWN = "und"
RESULT = "doc_id long,held_out boolean,lang_pred string,score double,ambiguous boolean"


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, unit vectors of square roots of n-gram counts, whether the text has a letter)."""
    space, lower = is_space(), lower_table()
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    for chunk in chunks(column, rows=256):
        data, offsets = lower[chunk.data], chunk.offsets
        n = len(offsets) - 1
        second = np.zeros(len(data), bool)
        second[1:] = chunk.data[:-1] == 0xC3
        data[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20  # À-Þ to à-þ
        data[space[data]] = 0x20
        doc = np.repeat(np.arange(n), np.diff(offsets))
        counts = np.zeros(n * FEATURES)
        code = np.zeros(len(data), np.uint32)
        for k in range(1, max(GRAMS) + 1):
            m = len(data) - k + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(257) + data[k - 1 :] + np.uint32(1)
            if k in GRAMS:
                inside = doc[:m] == doc[k - 1 :]
                at = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int64) + doc[:m] * FEATURES
                counts += np.bincount(at[inside], minlength=n * FEATURES)
        found = np.sqrt(counts, dtype=np.float32).reshape(n, FEATURES)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
        letter = np.zeros(n, bool)
        letter[doc[ascii_letter[chunk.data]]] = True
        for i in np.flatnonzero(~letter & (np.diff(offsets) > 0)):
            letter[i] = any(c.isalpha() for c in chunk.data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
        yield chunk.first, found, letter


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code of up to 5 classes, else well separated random words."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        return np.array([[1, *c] for c in product((1, -1), repeat=k - 1) if -1 in c], np.float32).T
    rng = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(k)))
    best = None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        least = min(int((code[i] != code[:i]).sum(1).min()) for i in range(1, k))
        if (np.abs(code.sum(0)) < k).all() and (best is None or least > best[0]):
            best = (least, code)
    if best is None:
        raise ValueError(f"no codewords for {k} classes")
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150) -> Model:
    """Logistic classifiers of all bits together, languages weighing alike, by accelerated descent."""
    codes = codewords(len(languages))
    signs = codes[y]
    share = (1 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], codes.shape[1]), np.float32)
    b = np.zeros(codes.shape[1], np.float32)
    near, last, rate = w, b, 4.0
    for t in range(steps):
        pull = share * signs / (1 + np.exp(np.clip(signs * (x @ near + last), -30, 30)))
        new_w, new_b = near + rate * (x.T @ pull - 2e-4 * near), last + rate * pull.sum(0)
        near, last = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new_w, new_b
    right = (x @ w + b) * signs > 0
    trust = np.array([right[y == c].mean(0) for c in range(len(languages))]) + 0.05
    return Model(languages, codes, w, b, trust / trust.sum(1, keepdims=True))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, score, gap to the second-best in mean loss)."""
    margins = (x @ model.weights + model.bias)[:, None, :] * model.codes[None]
    loss = (np.logaddexp(0, -margins) * model.trust[None]).sum(2)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    share = np.exp(-model.codes.shape[1] * (loss - loss.min(1, keepdims=True)))
    gap = loss[np.arange(len(x)), order[:, 1]] - loss.min(1) if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return best, 1 / share.sum(1), gap


def learn(docs: DataFrame) -> Model | None:
    """A model of the languages of ``docs``; None where no row has a text and a language to learn from."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = drawn(known, "lang", "doc_id", SAMPLE_PER_LANGUAGE).select("doc_id", "text", "lang")

    @lean
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, letter in features(batch.column("text")):
                keep = np.flatnonzero(letter)
                ids, langs = (batch.column(c).slice(first, len(x)).take(pa.array(keep)) for c in ("doc_id", "lang"))
                yield pa.RecordBatch.from_arrays([ids, langs, pa.array([r.tobytes() for r in x[keep].astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])

    got = rows.mapInArrow(collect, "doc_id long, lang string, x binary").toPandas().sort_values(["lang", "doc_id"], kind="stable")
    if got.empty:
        return None
    languages = sorted(got["lang"].unique())
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    return fit(x, np.array([languages.index(v) for v in got["lang"]]), languages)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of each row of ``docs``, from its whole text.

    A null text, an empty one and one without a letter are ``und`` with score 0; so is every text when
    there is no model.  Equal texts get equal answers; other columns, null ids included, change nothing.
    """

    @lean
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, doubt = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
            for first, x, letter in features(batch.column("text")) if model else ():
                best, own, gap = decode(model, x)
                for i in np.flatnonzero(letter):
                    lang[first + i] = model.languages[best[i]]
                score[first : first + len(x)] = np.where(letter, own, 0)
                doubt[first : first + len(x)] = letter & (gap < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], schema=schema_of(RESULT))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, RESULT)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
