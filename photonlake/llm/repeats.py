"""Substring dedup by recompression: rounds of naming runs and pairs make equal passages share symbols.

Words are symbols.  In each round a bit of a symbol's name makes it a left or a right one; a left symbol
followed by a right one becomes one symbol, named by the two names; of the others, equal neighbours
become one symbol named by name and number.  Names are hashes of content, so all tasks give the same
name to the same symbol without exchanging a dictionary.  How a stretch is parsed depends on a few
neighbouring words only, and that context is kept for each symbol: a symbol whose context lies in a
window is found wherever the window's words occur.

The highest such symbol of a window, or the window itself if there is none, is its anchor.  An anchor
that only one word sequence has can't belong to a repeat.  Windows with shared anchors are compared as
a whole, by 96 bits of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.graph import cut, sent
from photonlake.llm.kernels import DEALT, U64, Chunk, Hasher, Words, chunks, deal, inside, lean, meeting, mix, partitions, schema_of, signed, unpack, unpack_kinds, windows, words

WINDOW = 13
ROUNDS = 4
#: Tuples that a task brings together before it sends them, at least.
MET = 1 << 18


def _beside(near: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of the neighbours; beside the first and last symbol of a document, a word outside it."""
    before = np.concatenate([start[:1] - 1, np.where(near, low[:-1], start[1:] - 1)])
    after = np.concatenate([np.where(near, high[1:], high[:-1] + 1), high[-1:] + 1])
    return before, after


def parse(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round the symbols it made, in order: (name, first word of the context, word after the context)."""
    start = np.arange(len(names))
    low, high = start.copy(), start + 1
    out = []
    for level in range(1, rounds + 1):
        n = len(names)
        if n < 2:
            break
        right = (mix(names ^ U64(level * 0x1000193)) >> U64(63)).astype(bool)
        near = doc[start[1:]] == doc[start[:-1]]
        merge = ~right[:-1] & right[1:] & near
        # A symbol left alone is so because of its neighbour; at the end of a document no window can tell.
        left_low, right_high = _beside(near, start, low, high)
        head, tail = np.zeros(n, bool), np.zeros(n, bool)
        head[:-1], tail[1:] = merge, merge
        alone = ~head & ~tail
        new_low = np.where(alone & right, np.minimum(low, left_low), low)
        new_high = np.where(alone & ~right, np.maximum(high, right_high), high)
        pair = np.flatnonzero(head)
        name = names.copy()
        name[pair] = mix(names[pair] * U64(0x9E3779B97F4A7C15) + mix(names[pair + 1] + U64(level)))
        new_high[pair] = high[pair + 1]
        keep = ~tail
        names, start, low, high, made = name[keep], start[keep], new_low[keep], new_high[keep], head[keep]
        # Runs of equal symbols that are left alone.
        n = len(names)
        near = doc[start[1:]] == doc[start[:-1]]
        left_low, right_high = _beside(near, start, low, high)
        low, high = np.where(made, low, np.minimum(low, left_low)), np.where(made, high, np.maximum(high, right_high))
        same = (names[1:] == names[:-1]) & near & ~made[1:] & ~made[:-1]
        first = np.concatenate([[True], ~same])
        begin = np.flatnonzero(first)
        size = np.diff(np.concatenate([begin, [n]]))
        high = high[begin + size - 1]
        names, start, low, made = names[begin], start[begin], low[begin], made[begin] | (size > 1)
        long = size > 1
        names[long] = mix(names[long] ^ mix(size[long].astype(U64) << U64(8)))
        out.append((names[made], low[made], high[made]))
    return out


def anchors(hashes: np.ndarray, found: Words, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, anchor) of each window; ``whole`` are the hashes of all windows."""
    at, doc = inside(found.lo, found.hi, WINDOW)
    owner = np.repeat(np.arange(len(found.lo)), found.hi - found.lo)
    anchor = whole[at].copy() if len(at) else np.zeros(0, U64)
    open_ = np.arange(len(at))
    factor = 0x9E3779B97F4A7C15
    powers, inverse = np.full(len(hashes) + 1, factor, U64), np.full(len(hashes) + 1, pow(factor, -1, 1 << 64), U64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes) * powers[:-1], dtype=U64)])
    for level, (name, low, high) in reversed(list(enumerate(parse(hashes, owner), 1))):
        if not len(open_) or not len(name):
            continue
        first = np.minimum(np.searchsorted(low, at[open_]), len(low) - 1)
        good = (low[first] >= at[open_]) & (high[first] <= at[open_] + WINDOW)
        chosen = first[good]
        # The words of the context, which lie in the window too, make the anchor rarer than the symbol alone.
        context = (upto[high[chosen]] - upto[low[chosen]]) * inverse[low[chosen]]
        anchor[open_[good]] = mix(mix(name[chosen] + U64(level)) ^ context)
        open_ = open_[~good]
    return at, doc, anchor


def _hashes(chunk: Chunk, hasher: Hasher) -> tuple[Words, np.ndarray]:
    found = words(chunk)
    return found, hasher.ranges(hasher.prefix(chunk.data), found.starts, found.ends)


def _sequences(hashes: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's word sequence, with its length in them."""
    n = (found.hi - found.lo).astype(U64)
    place = np.arange(len(hashes)) - np.repeat(found.lo, found.hi - found.lo)
    out = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ mix(place.astype(U64) * U64(seed * 2 + 1) + U64(seed))), dtype=U64)])
        out.append(mix(total[found.hi] - total[found.lo] ^ mix(n)))
    return out[0], out[1]


IDENTITY = "doc_id long,n_words long,h1 long,h2 long,kept_sha256 string"


def identities(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, h1, h2, kept_sha256) of each row's words, joined by one space."""

    @lean
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows, digests = np.zeros((len(batch), 3), U64), []
            for chunk in chunks(batch.column("text")):
                found, hashes = _hashes(chunk, hasher)
                own = slice(chunk.first, chunk.first + len(found.lo))
                rows[own, 0] = found.hi - found.lo
                rows[own, 1], rows[own, 2] = _sequences(hashes, found)
                raw = chunk.data.tobytes()
                digests += [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(signed(rows[:, c].copy())) for c in range(3)), pa.array(digests, pa.string())], schema=schema_of(IDENTITY))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(identify, IDENTITY)


def _by_key(batches: Iterator[pa.RecordBatch], key: str, values: str) -> Iterator[pa.RecordBatch]:
    """One row for each key of a partition of dealt tuples, with its values as binary."""
    keys, found = unpack(batches)
    order = np.argsort(keys, kind="stable")
    keys, found = keys[order], found[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for at in range(0, len(cuts) - 1, 4096):
        own = cuts[at : at + 4097]
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys[own[:-1]])), pa.array([found[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())], names=[key, values])


def _shared(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners) in order and each once; where a key begins, and where it has several owners."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    fresh = new.copy()
    fresh[1:] |= owners[1:] != owners[:-1]
    keys, owners, new = keys[fresh], owners[fresh], new[fresh]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return keys, owners, new, np.bincount(first, minlength=len(new))[first] > 1


def shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """(h1, anchors): of each word sequence, by hash, the anchors that another one has too.

    Sequences of a task that share an anchor are found there, and one of them stands for all in the exchange: an
    anchor that very many have is sent a few times by each task.
    """
    def make(parts: int):  # noqa: ANN202
        @lean
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            keys, owners = [], []

            def met() -> Iterator[pa.RecordBatch]:
                key, owner, new, many = _shared(np.concatenate(keys), np.concatenate(owners))
                yield deal(key[new], [owner[new]], parts)
                yield deal(owner[many], [key[many]], parts, kind=1)

            for batch in batches:
                for chunk in chunks(batch.column("text")):
                    found, hashes = _hashes(chunk, hasher)
                    sequence = _sequences(hashes, found)[0]
                    _, doc, anchor = anchors(hashes, found, windows(hashes, WINDOW))
                    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])[: len(anchor)]
                    keys.append(anchor[new])
                    owners.append(sequence[doc[new]])
                    if sum(map(len, keys)) >= MET:
                        yield from met()
                        keys, owners = [], []
            if keys:
                yield from met()

        return emit

    def meet_with(parts: int):  # noqa: ANN202
        @lean
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, known = unpack_kinds(batches, (U64,), (U64,))
            key, owner, _, many = _shared(*found)
            yield deal(np.concatenate([owner[many], known[0]]), [np.concatenate([key[many], known[1]])], parts)

        return meet

    found = meeting(docs.select("text").mapInArrow(make(parts), DEALT), parts).mapInArrow(meet_with(parts), DEALT)
    return meeting(found, parts).mapInArrow(lean(lambda batches: _by_key(batches, "h1", "anchors")), "h1 long, anchors binary")


def _late(keys: np.ndarray, other: np.ndarray, ids: np.ndarray, owners: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The tuples by window, and which of them are of a document that isn't the window's least."""
    docs = signed(ids)
    order = np.lexsort((docs, other >> U64(32), keys))
    keys, other, docs, owners = keys[order], other[order], docs[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (other[1:] >> U64(32) != other[:-1] >> U64(32))
    least = docs[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    return (keys, other, docs.view(U64), owners), docs > least


def repeated_windows(texts: DataFrame, parts: int) -> DataFrame:
    """(h1, doc_id, at): the windows of the rows (doc_id, h1, text, anchors) that start in a row with a smaller doc_id too.

    Only windows with one of the row's shared anchors are looked at; ``at`` has their first words.  Of the rows of a
    task that share a window, only those with the least doc_id go on; the others are settled.
    """
    def make(parts: int):  # noqa: ANN202
        @lean
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            got: list[list[np.ndarray]] = [[] for _ in range(4)]

            def met() -> Iterator[pa.RecordBatch]:
                (key, other, ids, owner), late = _late(*(np.concatenate(own) for own in got))
                yield deal(key[~late], [other[~late], ids[~late], owner[~late]], parts)
                yield deal(owner[late], [ids[late], other[late] & U64(0xFFFFFFFF)], parts, kind=1)

            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                owners = batch.column("h1").to_numpy(zero_copy_only=False).astype(np.int64)
                known = batch.column("anchors")
                for chunk in chunks(batch.column("text")):
                    found, hashes = _hashes(chunk, hasher)
                    whole = windows(hashes, WINDOW)
                    at, doc, anchor = anchors(hashes, found, whole)
                    cuts = np.searchsorted(doc, np.arange(len(found.lo) + 1))
                    good = np.zeros(len(at), bool)
                    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if a < b:
                            good[a:b] = np.isin(anchor[a:b], np.frombuffer(known[chunk.first + i].as_buffer(), U64))
                    at, doc = at[good], doc[good]
                    other = windows(mix(hashes ^ U64(0x2545F4914F6CDD1D)), WINDOW, seed=9)[at] if len(at) else np.zeros(0, U64)
                    place = (at - found.lo[doc]).astype(U64)
                    for own, values in zip(got, (whole[at] if len(at) else other, (other & U64(0xFFFFFFFF00000000)) | place, ids[chunk.first + doc].view(U64), owners[chunk.first + doc].view(U64)), strict=True):
                        own.append(values)
                    if sum(map(len, got[0])) >= MET:
                        yield from met()
                        got = [[] for _ in range(4)]
            if got[0]:
                yield from met()

        return emit

    def meet_with(parts: int):  # noqa: ANN202
        @lean
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, (owners, settled, places) = unpack_kinds(batches, (U64,) * 3, (U64,) * 2)
            (_, other, ids, owner), late = _late(*found)
            yield deal(np.concatenate([owner[late], owners]), [np.concatenate([ids[late], settled]), np.concatenate([other[late] & U64(0xFFFFFFFF), places])], parts)

        return meet

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, ids, at = unpack(batches, 2)
        order = np.lexsort((ids, owners))
        owners, ids, at = owners[order], ids[order], at[order].astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (ids[1:] != ids[:-1]), [True]])) if len(ids) else np.zeros(1, np.int64)
        for first in range(0, len(cuts) - 1, 4096):
            own = cuts[first : first + 4097]
            yield pa.RecordBatch.from_arrays([pa.array(signed(owners[own[:-1]])), pa.array(signed(ids[own[:-1]])), pa.array([at[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())], names=["h1", "doc_id", "at"])

    found = meeting(texts.mapInArrow(make(parts), DEALT), parts).mapInArrow(meet_with(parts), DEALT)
    return meeting(found, parts).mapInArrow(rows, "h1 long, doc_id long, at binary")


def _with_text(docs: DataFrame, rows: DataFrame, values: str) -> DataFrame:
    """(doc_id, text, h1, values) of rows (doc_id, h1, values): the texts whose words have the hash h1, for a
    doc_id may come with several.  Texts that no row asks for are left out before the shuffle.
    """

    @lean
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            own = [signed(_sequences(*reversed(_hashes(chunk, hasher)))[0]) for chunk in chunks(batch.column("text"))]
            keep = np.concatenate(own) == batch.column("h1").to_numpy(zero_copy_only=False) if own else np.zeros(0, bool)
            yield batch.filter(pa.array(keep))

    asked = docs.join(sent(rows.select("doc_id").distinct()), "doc_id", "left_semi")
    return asked.join(rows, "doc_id").select("doc_id", "text", "h1", values).mapInArrow(choose, f"doc_id long, text string, h1 long, {values} binary")


CUTS = "h1 long,doc_id long,n_removed long,kept_sha256 string,ranges string"


def remove(texts: DataFrame) -> DataFrame:
    """(h1, doc_id, n_removed, kept_sha256, ranges) of rows (h1, doc_id, text, at): what is left without the windows."""

    @lean
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, ranges = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                own = text.encode().split()
                change = np.zeros(len(own) + 1, np.int64)
                at = np.frombuffer(starts, np.int32)
                np.add.at(change, at, 1)
                np.subtract.at(change, at + WINDOW, 1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                counts.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g)).hexdigest())
                ranges.append(",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(ranges, pa.string())], schema=schema_of(CUTS))

    return texts.select("h1", "doc_id", "text", "at").mapInArrow(apply, CUTS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, ranges) of each row of ``docs``; ranges are the removed words, from:to.

    A null text counts as empty.  Of rows with equal words the one with the smallest id keeps them; rows
    with the same id don't remove each other's words; a row with a null id keeps all and removes nothing
    elsewhere.  Texts of fewer words than a window are kept.  Other columns change nothing; an empty table
    gives an empty result.
    """
    rows = cut(identities(docs))
    first = rows.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("n_words", "h1", "h2").agg(F.min("doc_id").alias("first"))
    first = cut(first)
    parts = partitions(docs.sparkSession, 4 * int(first.agg(F.sum("n_words")).first()[0] or 0))
    asked = cut(first.select(F.col("first").alias("doc_id"), "h1").join(shared_anchors(docs, parts), "h1"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = cut(repeated_windows(_with_text(own, asked, "anchors"), parts))
    found = remove(_with_text(own, late, "at"))
    found = found.select("h1", "doc_id", "n_removed", F.col("kept_sha256").alias("left"), "ranges").dropDuplicates(["h1", "doc_id"])
    all_ = rows.join(first, ["n_words", "h1", "h2"], "left").join(found, ["h1", "doc_id"], "left")
    copy = F.col("doc_id") > F.col("first")
    return all_.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left", "kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.concat(F.lit("0:"), F.col("n_words"))).otherwise(F.coalesce("ranges", F.lit(""))).alias("ranges"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = """
with docs as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
wins as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13)),
least as (select g, min(doc_id) as first from wins group by g),
late as (select distinct doc_id, unnest(range(i, i + 13)) as p from wins join least using (g) where doc_id > first),
gone as (select doc_id, list(p) as ps from late group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string(case when ps is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from docs d left join gone g using (doc_id)
"""
