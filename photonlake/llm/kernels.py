"""Vectorised text kernels on Arrow buffers: words, hashes and hash exchange between tasks.

Texts stay UTF-8 bytes: a word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in
UTF-8 equals the same rule on code points.  All hashes depend on content alone, never on the batch,
the partition or the process, so that independent tasks agree and a retried task repeats itself.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
Batches = Iterator[pa.RecordBatch]
U64 = np.uint64


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` on a partition; afterwards memory that its arrays took goes back to the system.

    Workers outlive their tasks, and what allocators keep for later adds up beside the JVM's heap.
    """

    @functools.wraps(work)
    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


class Chunk(NamedTuple):
    """Some consecutive documents of a batch: rows [first, first + len(offsets) - 1)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte ranges of the words of a chunk; those of document i are [lo[i], hi[i])."""

    starts: np.ndarray
    ends: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[Chunk]:
    """Whole documents of a string column (null as empty), about ``limit`` bytes and at most ``rows`` at a time."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, len(column))
        yield Chunk(first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    """A-Z to a-z; every other byte is kept."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(chunk: Chunk) -> Words:
    data, offsets = chunk.data, chunk.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        zero = np.zeros(len(offsets) - 1, np.int64)
        return Words(none, none, zero, zero)
    solid = ~is_space()[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(starts, ends, bounds[:-1], bounds[1:])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """64-bit hashes of byte ranges by prefix sums of a polynomial, for any number of ranges at once."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 0) -> None:
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(seed))
        self.powers = self.inverse = np.ones(0, U64)

    def _grow(self, n: int) -> None:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
            table = np.full(n, base, U64)
            table[0] = 1
            setattr(self, name, np.multiply.accumulate(table))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts] ^ ((ends - starts).astype(U64) << U64(48)))


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive items, in order; k - 1 fewer than there are items."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    factor = (0xC2B2AE3D27D4EB4F + 2 * seed) % (1 << 64)
    for j in range(k):
        out *= U64(factor)
        out += hashes[j : j + n]
    return mix(out ^ U64(k + (seed << 8)))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each item's group and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    return group, place


def inside(lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-item windows that stay in one document, and the document of each."""
    counts = np.maximum(hi - lo - k + 1, 0)
    doc, place = spread(counts)
    return lo[doc] + place, doc


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in ddl.split(","))])


def deal(keys: np.ndarray, values: list[np.ndarray], parts: int, kind: int = 0) -> pa.RecordBatch:
    """Rows (part, kind, keys, vals): the tuples of a task, packed by the part their key falls into.

    A row holds thousands of tuples as two binary columns, so that an exchange moves their bytes and no
    row object for each.  The values lie column after column.  ``kind`` tells apart the tuples of one exchange.
    """
    part = ((keys >> U64(33)) % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [keys[order], *(v[order] for v in values)]
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([columns[0][a:b].tobytes() for _, a, b in rows], pa.binary()), pa.array([b"".join(c[a:b].tobytes() for c in columns[1:]) for _, a, b in rows], pa.binary())],
        names=["part", "kind", "keys", "vals"],
    )


DEALT = "part int, kind int, keys binary, vals binary"


def unpack_kinds(batches: Iterator[pa.RecordBatch], *kinds: Sequence[type]) -> list[list[np.ndarray]]:
    """For each kind of dealt rows, the key and the values, of the types given, of all its tuples in a partition."""
    found: list[list[list[np.ndarray]]] = [[[np.zeros(0, U64)], *([np.zeros(0, t)] for t in types)] for types in kinds]
    for batch in batches:
        for kind, key, value in zip(batch.column("kind").to_pylist(), batch.column("keys"), batch.column("vals"), strict=True):
            keys, raw, at = np.frombuffer(key.as_buffer(), U64), value.as_buffer(), 0
            found[kind][0].append(keys.copy())
            for own, t in zip(found[kind][1:], kinds[kind], strict=True):
                own.append(np.frombuffer(raw, t, len(keys), at).copy())
                at += own[-1].nbytes
    return [[np.concatenate(own) for own in columns] for columns in found]


def unpack(batches: Iterator[pa.RecordBatch], width: int = 1) -> list[np.ndarray]:
    """The key and the ``width`` values of all tuples of a partition of dealt rows of one kind."""
    return unpack_kinds(batches, [U64] * width)[0]


def meeting(dealt: DataFrame, parts: int) -> DataFrame:
    """Dealt rows in the partitions that they name."""
    return dealt.repartitionById(parts, "part")


#: Bytes of dealt tuples that a partition gets, about.
PART_BYTES = 32 << 20


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Partitions for an exchange of so many bytes: those of the session at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
