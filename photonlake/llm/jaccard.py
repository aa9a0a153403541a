"""N-gram Jaccard join by count vectors: groups of hashed shingles, R-trees of their counts, exact checks.

A document is the set of its word shingles.  Shingles are hashed into groups; the counts of the groups
are a point, and the sum of coordinate minima of two points bounds the overlap of their sets.

In so many dimensions the boxes of unrelated documents overlap, so one tree over all documents prunes
little near its root.  A directory that loses no pair stands there instead.  Documents fall into classes
of size such that linked ones are in the same or the next class.  If at most D shingles differ between
linked sets, then of D + 1 + s groups s + 1 at least are equal in both: their contents, hashed, are keys,
of which linked sets share so many, less those of bare groups.  A set that shares fewer keys with all
others together is linked with none and leaves.  The others give up their most frequent keys, one less than
they must share; what the rest connects is a region.  Within a region, R-trees of points are joined level by
level; what their bound connects is a smaller region, to which the texts are brought, and the sets of the
pairs within the bound are intersected.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.graph import components, cut, discard, sent
from photonlake.llm.kernels import DEALT, U64, Chunk, Hasher, chunks, deal, lean, lower_table, meeting, mix, partitions, schema_of, signed, spread, unpack_kinds, windows, words
from photonlake.llm.names import unused

SHINGLE = 3
#: Linked: PERCENT of the union in common at least.
PERCENT = 90
#: Groups beyond D + 1: so many, and one more for each so many of D.  The more there are, the more keys linked
#: sets share and the fewer sets a common passage keeps, at the price of more keys.
SPARE, SPARE_EACH = 2, 4
#: Coordinates of the points compared within a region; children of a node of a tree.
COORDINATES = 64
FANOUT = 8
#: Sets of a region compared in one task by their points, and by their texts; shingles of the latter, about.
POINTS = 512
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
#: Keys that a task brings together before it sends them, at least.
MET = 1 << 19
#: Pairs of boxes that are compared at a time, and edges that are passed on at a time.
STEP = 1 << 15


class Sizes:
    """Classes of set sizes: class k holds [edges[k], edges[k + 1])."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
        self.edges = np.array(edges, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def differing(self, k: int) -> int:
        """The most shingles in which linked sets can differ, the smaller of class k."""
        return int(self.edges[k + 1] - 1) * (100 - self.percent) // self.percent


def shingles(chunk: Chunk, hasher: Hasher, lower: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Of each document the sorted hashes of its different shingles; with fewer than k words, of them all as one."""
    found = words(chunk)
    hashes = hasher.ranges(hasher.prefix(lower[chunk.data]), found.starts, found.ends)
    grams = windows(hashes, k)
    for lo, hi in zip(found.lo, found.hi, strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        else:
            yield windows(hashes[lo:hi], int(hi - lo), seed=1) if hi > lo else np.zeros(0, U64)


def identity(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return int(np.sum(mix(found ^ U64(0xA5A5A5A5)))), int(np.sum(mix(found + U64(0x5851F42D4C957F2D))))


def _class(n: int, h1: int) -> int:
    return (h1 ^ (n * 0x9E3779B97F4A7C15)) % (1 << 64)


@functools.lru_cache(maxsize=4096)
def _group_edges(groups: int) -> np.ndarray:
    return (np.arange(groups + 1, dtype=object) * (1 << 64) // groups)[1:-1].astype(U64)


def keyed(found: np.ndarray, level: int, sizes: Sizes) -> tuple[np.ndarray, int]:
    """The keys of a set on a level, one for the content of each group, and how many of them a set that it is linked with shares.

    Bare groups have a key only where they are more than the spare ones: then one key is all that is sure.
    """
    differ = sizes.differing(level)
    if differ < 1:
        return np.zeros(0, U64), 1  # linked sets are equal
    spare = SPARE + differ // SPARE_EACH
    groups = differ + 1 + spare
    cuts = np.concatenate([[0], np.searchsorted(found, _group_edges(groups)), [len(found)]])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(found ^ U64(0x1234567)), dtype=U64)])
    content = total[cuts[1:]] - total[cuts[:-1]]
    keys = mix(content ^ mix(np.arange(groups, dtype=U64) + U64(level << 32)))
    bare = cuts[1:] == cuts[:-1]
    none = int(bare.sum())
    return (keys, 1) if none > spare else (keys[~bare], 1 + spare - none)


def keys_of(found: np.ndarray, level: int, sizes: Sizes) -> np.ndarray:
    return keyed(found, level, sizes)[0]


#: Bits of what goes with a key: the lower of a set's two levels, and how many keys are needed there.
LOWER, NEED = 1 << 15, (1 << 15) - 1
#: What goes with the keys of the kinds of tuples that :func:`candidate_edges` exchanges.
ALONE = (U64, np.uint16)
IN_PIECE = (U64, U64, np.uint16)
LEADING = (U64, np.uint16, np.int64, U64)
COUNTED = (U64, np.int64)
MEMBER = (U64, np.uint16, np.int64)


def _sorted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Tuples by the first two columns, each once, and whether each begins a value of the first."""
    order = np.lexsort((columns[1], columns[0]))
    a, b = columns[0][order], columns[1][order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    fresh = new.copy()
    fresh[1:] |= b[1:] != b[:-1]
    return [c[order][fresh] for c in columns], new[fresh]


def _leaders(new: np.ndarray) -> np.ndarray:
    """For each tuple the place of the first one with its key."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _star(keys: np.ndarray, owners: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The edges from the first owner of each key to its others, each once."""
    least = owners[_leaders(new)]
    return np.unique(np.stack([least[~new], owners[~new]], 1), axis=0)


def _forest(edges: np.ndarray) -> np.ndarray:
    """Edges that connect what ``edges`` connect: from the least end of each component to its others, each once.

    Each round hooks roots onto their least neighbours, so two rounds halve them, as in :func:`photonlake.graph.connected`.
    """
    ids, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(edges.shape).T
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.concatenate([a, b]), np.concatenate([b, a]))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != np.arange(len(ids))
    return np.stack([ids[root[below]], ids[below]], 1)


def _owners(new: np.ndarray) -> np.ndarray:
    """For each tuple the number of tuples with its key."""
    lead = _leaders(new)
    return np.bincount(lead, minlength=len(new))[lead]


def candidate_edges(docs: DataFrame, k: int, percent: int, size: int = 0) -> DataFrame:
    """(u, v): different sets, by hash, that are connected in their region; ``size`` is that of all sets together.

    Of the keys that a set shares with others, as many as it needs less one may go: a set that it is linked with
    shares one that stays.  Those go that most sets have, in an order that is the same for all, so that of the keys
    that two linked sets share, the one that fewest sets have stays in both.

    Sets that share a key within a piece, MET keys of a task, are found there, and one of them stands for all in the
    exchange of keys: a key that very many sets have is sent a few times by each task.  Its number of sets comes
    back to the piece.

    Two sets of a region meet at many keys, in as many partitions.  Each partition of keys keeps a forest of its
    edges, and these meet by their greater ends and leave forests again, so that there are no more rows than
    different pairs in those forests, whatever the number of partitions in which a pair meets.
    """
    parts = partitions(docs.sparkSession, 12 * size)

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lower, sizes = Hasher(), lower_table(), Sizes(percent)
        seen: set[int] = set()
        keys, owners, marks = [], [], []

        def met() -> Iterator[pa.RecordBatch]:
            (key, owner, mark), new = _sorted(np.concatenate(keys), np.concatenate(owners), np.concatenate(marks))
            n = _owners(new)
            many, alone = n > 1, n == 1
            yield deal(key[alone], [owner[alone], mark[alone]], parts)
            if many.any():
                piece = np.full(len(key), np.sum(mix(key ^ mix(owner))), U64)
                yield deal(piece[many], [key[many], owner[many], mark[many]], parts, kind=1)
                lead = many & new
                yield deal(key[lead], [owner[lead], mark[lead], n[lead], piece[lead]], parts, kind=2)

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                for found in shingles(chunk, hasher, lower, k):
                    own = _class(len(found), identity(found)[0]) if len(found) else 0
                    if not len(found) or own in seen:
                        continue
                    seen.add(own)
                    level = int(sizes.of(len(found)))
                    for at in (level, level - 1) if level else (level,):
                        got, need = keyed(found, at, sizes)
                        keys.append(got)
                        owners.append(np.full(len(got), own, U64))
                        marks.append(np.full(len(got), min(need, NEED) | (LOWER if at < level else 0), np.uint16))
                if sum(map(len, keys)) >= MET:
                    yield from met()
                    seen, keys, owners, marks = set(), [], [], []
        if keys:
            yield from met()

    @lean
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, known, (lead, owner, mark, n, piece) = unpack_kinds(batches, ALONE, IN_PIECE, LEADING)
        keys, owners = np.concatenate([alone[0], lead]), np.concatenate([alone[1], owner])
        marks, counts = np.concatenate([alone[2], mark]), np.concatenate([np.ones(len(alone[0]), np.int64), n])
        order = np.lexsort((-counts, owners, keys))
        (key, owner, mark, n), new = _sorted(keys[order], owners[order], marks[order], counts[order])
        total = np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1] if len(key) else n
        some = total > 1
        yield deal(owner[some], [key[some], mark[some], total[some]], parts)
        yield deal(known[0], known[1:], parts, kind=1)
        if len(lead):
            at = np.searchsorted(key, lead)  # where its key begins
            yield deal(piece, [lead, total[at]], parts, kind=2)

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (piece, key, owner, mark), (of, leading, total) = unpack_kinds(batches, MEMBER, IN_PIECE, COUNTED)
        place = mix(of ^ mix(leading))
        order = np.argsort(place)
        if len(place):
            at = order[np.searchsorted(place[order], mix(piece ^ mix(key)))]
            known = [np.concatenate(x) for x in zip(known, (owner, key, mark, total[at]), strict=True)]
        yield deal(known[0], known[1:], parts)

    @lean
    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        [columns] = unpack_kinds(batches, MEMBER)
        (owner, key, mark, total), _ = _sorted(*columns)
        # Counted and put in order on each level of an owner.
        on = owner ^ mix((mark & LOWER).astype(U64))
        order = np.lexsort((key, -total, on))
        owner, key, mark, on = owner[order], key[order], mark[order], on[order]
        new = np.ones(len(on), bool)
        new[1:] = on[1:] != on[:-1]
        need = (mark & NEED).astype(np.int64)
        stay = (_owners(new) >= need) & (np.arange(len(on)) - _leaders(new) >= need - 1)
        (key, owner), new = _sorted(key[stay], owner[stay])
        yield deal(key[new], [owner[new]], parts)
        edges = _star(key, owner, new)
        yield deal(edges[:, 0].copy(), [edges[:, 1].copy()], parts, kind=1)

    @lean
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, owners), known = unpack_kinds(batches, (U64,), (U64,))
        (key, owner), new = _sorted(keys, owners)
        edges = _forest(np.concatenate([_star(key, owner, new), np.stack(known, 1)]))
        yield deal(edges[:, 1].copy(), [edges[:, 0].copy()], parts)

    @lean
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        [(node, least)] = unpack_kinds(batches, (U64,))
        edges = _forest(np.stack([least, node], 1))
        for at in range(0, len(edges), STEP):
            part = edges[at : at + STEP]
            yield pa.RecordBatch.from_arrays([pa.array(signed(part[:, 0].copy())), pa.array(signed(part[:, 1].copy()))], names=["u", "v"])

    rows = docs.select("text").mapInArrow(emit, DEALT)
    for work in (shared, counted, enough, connect):
        rows = meeting(rows, parts).mapInArrow(work, DEALT)
    return meeting(rows, parts).mapInArrow(once, "u long, v long")


IDENTITY = "doc_id long,n_shingles long,h1 long,h2 long,set_class long,point binary"


def identities(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, set_class, point): the size, hashes and group counts of each row's set."""

    @lean
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lower = Hasher(), lower_table()
        for batch in batches:
            rows, points = np.zeros((len(batch), 4), U64), [b""] * len(batch)
            for chunk in chunks(batch.column("text")):
                for i, found in enumerate(shingles(chunk, hasher, lower, k), chunk.first):
                    if len(found):
                        h1, h2 = identity(found)
                        rows[i] = len(found), h1, h2, _class(len(found), h1)
                        points[i] = point_of(found).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(signed(rows[:, c].copy())) for c in range(4)), pa.array(points, pa.binary())], schema=schema_of(IDENTITY))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(identify, IDENTITY)


def point_of(found: np.ndarray) -> np.ndarray:
    """The counts of a set's COORDINATES groups."""
    return np.bincount((found >> U64(7)).astype(np.int64) & (COORDINATES - 1), minlength=COORDINATES).astype(np.int32)


class CountTree:
    """A packed R-tree of points: each node has the box of up to FANOUT nodes below, up to one root.

    Points are packed by halving them at the coordinate with the greatest variance, so that near ones share
    their nodes.  ``tested`` counts the pairs of boxes that were compared, on each level from the points up.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.order = self._packed(points)
        own = points[self.order]
        self.levels = [(own, own, own.sum(1), own.sum(1))]
        while len(self.levels[-1][0]) > 1:
            low, high, least, most = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))
        self.tested = [0] * len(self.levels)

    @staticmethod
    def _packed(points: np.ndarray) -> np.ndarray:
        done, open_ = [], [np.arange(len(points))]
        while open_:
            own = open_.pop()
            if len(own) <= FANOUT:
                done.append(own)
                continue
            by = points[own]
            order = np.argsort(by[:, by.var(0).argmax()], kind="stable")
            # Whole nodes on the left, so that nodes of all levels begin where a half does.
            half = FANOUT ** max(1, math.ceil(math.log(len(own), FANOUT) - 1e-9) - 1)
            half = half * max(1, round(len(own) / half / 2))
            open_ += [own[order[half:]], own[order[:half]]]
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def _bounded(self, a: int, x: np.ndarray, other: CountTree, b: int, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the nodes x of level a and y of the other's level b may hold linked sets."""
        _, high, least, most = self.levels[a]
        _, other_high, other_least, other_most = other.levels[b]
        both = np.minimum(high[x], other_high[y]).sum(1)
        total = least[x] + other_least[y]
        return ((100 + percent) * both >= percent * total) & (100 * most[x] >= percent * other_least[y]) & (100 * other_most[y] >= percent * least[x])

    def pairs(self, other: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The points i of this tree and j of the other whose overlap may reach the percentage; with itself, each pair once."""
        same = other is self
        if not len(self.order) or not len(other.order):
            return
        todo = [(len(self.levels) - 1, len(other.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            a, b, x, y = todo.pop()
            if len(x) > STEP:
                todo += [(a, b, x[at : at + STEP], y[at : at + STEP]) for at in range(0, len(x), STEP)]
                continue
            self.tested[a] += len(x)
            good = self._bounded(a, x, other, b, y, percent)
            x, y = x[good], y[good]
            if not len(x):
                continue
            if a == b == 0:
                yield self.order[x], other.order[y]
                continue
            # The higher side goes down, or both.
            if a >= b:
                x, y = self._below(a, x, y)
            if b >= a:
                y, x = other._below(b, y, x)
            a, b = a - (a >= b), b - (b >= a)
            if same:
                keep = x <= y if a else x < y
                x, y = x[keep], y[keep]
            todo.append((a, b, x, y))

    def _below(self, level: int, nodes: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = nodes * FANOUT
        group, place = spread(np.minimum(first + FANOUT, len(self.levels[level - 1][0])) - first)
        return first[group] + place, beside[group]

    def near(self, point: np.ndarray, percent: int) -> np.ndarray:
        """The points whose overlap with ``point``, bounded by summed minima, may reach the percentage."""
        found = [j for _, j in CountTree(point[None]).pairs(self, percent)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Sets(list):
    """Sorted sets laid end to end."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        super().__init__(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets)
        self.first = np.cumsum(self.sizes) - self.sizes

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Whether the set is linked with each of the others."""
        out, own = np.zeros(len(others), bool), self[i]
        cuts = np.cumsum(self.sizes[others]) // (32 * STEP)
        for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(cuts)) + 1):
            sizes = self.sizes[others[part]]
            group, place = spread(sizes)
            values = self.flat[self.first[others[part]][group] + place]
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            both = np.add.reduceat(own[at] == values, np.cumsum(sizes) - sizes, dtype=np.int64)
            out[part] = 100 * both >= percent * (len(own) + sizes - both)
        return out


def links(points: np.ndarray, sets: Sets | None, side: np.ndarray, percent: int, every: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): links of sets of one side with each other, or of side 0 with side 1.

    All of them where ``every`` is asked for; otherwise links that connect what all links connect, and pairs
    that earlier links connect aren't checked.  Without sets, all pairs within the bound of their points count.
    """
    label = np.arange(len(points))
    across = side.any()
    asking, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if across else np.arange(len(points))
    if not len(asked) or not len(asking):
        return
    tree = CountTree(points[asking])
    for x, y in tree.pairs(CountTree(points[asked]) if across else tree, percent):
        x, y = asking[x], asked[y]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cuts = np.flatnonzero(np.diff(x)) + 1
        for i, others in zip(x[np.concatenate([[0], cuts])], np.split(y, cuts), strict=True):
            if not every:
                others = others[label[others] != label[i]]
            if sets is not None and len(others):
                others = others[sets.linked(int(i), others, percent)]
            if not every:
                others = others[np.unique(label[others], return_index=True)[1]]
                label[np.isin(label, label[others])] = label[i]
            if len(others):
                yield int(i), others


UNIT = ["region", "la", "ca", "lb", "cb"]


def units(members: DataFrame, percent: int, most: int, shingles_most: int | None = None) -> DataFrame:
    """``members`` (doc_id, n_shingles, region, ...) for each unit of work they take part in, with their side in it.

    A region of more than ``most`` members, or of more than so many shingles, is cut by size class and hash into
    cells; each pair of cells in the same class or in neighbouring ones is a unit.
    """
    edges = F.array(*(F.lit(int(e)) for e in Sizes(percent).edges if e < 1 << 40))
    sized = members.withColumn("level", F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))))
    load = F.count(F.lit(1)) / most
    load = F.greatest(load, F.sum("n_shingles") / shingles_most) if shingles_most else load
    counts = sized.groupBy("region", "level").agg(load.alias("n"))
    whole = counts.groupBy("region").agg(F.sum("n").alias("all"))
    cells = F.ceil(F.col("n"))
    beside = counts.select("region", F.col("level").alias("l"), cells.alias("c"))
    plan = counts.join(whole, "region").withColumn("cells", cells)
    for name, step in (("below", -1), ("above", 1)):
        plan = plan.join(beside.select("region", (F.col("l") - step).alias("level"), F.col("c").alias(name)), ["region", "level"], "left")
    placed = sized.join(sent(plan), ["region", "level"]).withColumn("cell", F.pmod(F.xxhash64("set_class"), F.col("cells")))
    unit = lambda la, ca, lb, cb, side: F.struct(la.cast("int").alias("la"), ca.cast("long").alias("ca"), lb.cast("int").alias("lb"), cb.cast("long").alias("cb"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    level, cell = F.col("level"), F.col("cell")
    same = F.transform(upto(F.col("cells")), lambda c: F.when(c < cell, unit(level, c, level, cell, 1)).otherwise(unit(level, cell, level, c, 0)))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda c: unit(level - 1, c, level, cell, 1))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda c: unit(level, cell, level + 1, c, 0))
    chosen = F.when(F.col("all") <= 1, F.array(unit(F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), 0))).otherwise(F.concat(same, down, up))
    return placed.select(*members.columns, F.explode(chosen).alias("unit")).select(*members.columns, "unit.*")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession) * 2, *UNIT).sortWithinPartitions(*UNIT, "set_class")


def _sides(unit: tuple, sides: list[int]) -> np.ndarray:
    return np.array(sides, np.int8) if unit[1:3] != unit[3:5] else np.zeros(len(sides), np.int8)


LINK = "u long,v long,more long"


def _edges(ids: list[int], found: Iterator[tuple[int, np.ndarray]], copies: list[int] | None = None) -> pa.RecordBatch:
    """(u, v, more) for a unit: edges that connect what is linked, and with ``copies`` how many rows each set is linked with (v null)."""
    own, label = np.array(ids, np.int64), np.arange(len(ids))
    u, v, more, weight = [], [], np.zeros(len(ids), np.int64), None if copies is None else np.array(copies, np.int64)
    for i, others in found:
        if weight is not None:
            more[i] += weight[others].sum()
            more[others] += weight[i]
        others = others[label[others] != label[i]]
        others = others[np.unique(label[others], return_index=True)[1]]
        if len(others):
            label[np.isin(label, label[others])] = label[i]
            u.append(np.full(len(others), own[i]))
            v.append(own[others])
    with_links = np.flatnonzero(more)
    ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ends[0], own[with_links]])), pa.concat_arrays([pa.array(ends[1]), pa.nulls(len(with_links), pa.int64())]), pa.array(np.concatenate([np.zeros(len(ends[0]), np.int64), more[with_links]]))],
        schema=schema_of(LINK),
    )


def near_regions(members: DataFrame, percent: int) -> DataFrame:
    """``members`` whose point is within the bound of another's of their region; regions become what the bound connects.

    Only points are moved here, so that a text is moved with those it may really be linked with.
    """

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, points, sides = None, [], [], []

        def close() -> pa.RecordBatch:
            return _edges(ids, links(np.stack(points), None, _sides(now, sides), percent, False))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*UNIT, "set_class", "point", "side")]
            for *unit, own, point, side in zip(*columns, strict=True):
                if tuple(unit) != now:
                    if len(ids) > 1:
                        yield close()
                    now, ids, points, sides = tuple(unit), [], [], []
                ids.append(own)
                points.append(np.frombuffer(point, np.int32))
                sides.append(side)
        if len(ids) > 1:
            yield close()

    rows = _dealt(units(members, percent, POINTS).select("set_class", "point", *UNIT, "side"))
    found = components(rows.mapInArrow(compare, LINK).select("u", "v"))
    return members.drop("region", "point").join(found.select(F.col("id").alias("set_class"), F.col("label").alias("region")), "set_class")


def region_links(members: DataFrame, docs: DataFrame, k: int, percent: int, count: bool) -> DataFrame:
    """(u, v, more): links between the members (doc_id, set_class, n_shingles, copies, region), compared region by region.

    With ``count``, also rows without v: ``more`` rows are linked with the set u in a unit.
    """
    work = units(members, percent, BLOCK, BLOCK_SHINGLES).select("doc_id", "set_class", "copies", *UNIT, "side")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent(members.select("doc_id").distinct()), "doc_id", "left_semi")
    dealt = _dealt(texts.join(work, "doc_id").select("text", "set_class", "copies", *UNIT, "side"))

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lower = Hasher(), lower_table()
        now, ids, sets, sides, copies, known = None, [], [], [], [], set()

        def close() -> pa.RecordBatch:
            points = np.stack([point_of(x) for x in sets])
            return _edges(ids, links(points, Sets(sets), _sides(now, sides), percent, count), copies if count else None)

        for batch in batches:
            unit_of = list(zip(*(batch.column(c).to_pylist() for c in UNIT), strict=True))
            own, side, n = (batch.column(c).to_pylist() for c in ("set_class", "side", "copies"))
            for chunk in chunks(batch.column("text")):
                for i, found in enumerate(shingles(chunk, hasher, lower, k), chunk.first):
                    if unit_of[i] != now:
                        if len(sets) > 1:
                            yield close()
                        now, ids, sets, sides, copies, known = unit_of[i], [], [], [], [], set()
                    # A doc_id that comes with several texts brings only the set that is meant, once.
                    if own[i] not in known and len(found) and int(np.array([_class(len(found), identity(found)[0])], U64).view(np.int64)[0]) == own[i]:
                        known.add(own[i])
                        ids.append(own[i])
                        sets.append(found)
                        sides.append(side[i])
                        copies.append(n[i])
        if len(sets) > 1:
            yield close()

    return dealt.mapInArrow(compare, LINK)


def join_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, count: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``: its set's size, the least doc_id that links reach.

    With ``count`` also n_links: with how many other rows that have an id the row is linked.

    A null or empty text, or one without words, has no shingles and is linked with nothing.  Equal sets are
    linked whatever their number: one of them stands for all.  Rows with the same id are one document, linked
    with what any of them is linked with.  A row with a null id keeps its size and has no component and no
    links; repeated rows get equal answers; other columns change nothing; an empty table gives an empty result.
    """
    rows = cut(identities(docs, k))
    one = rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "h1", "h2", "set_class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("point").alias("point"))
    one = cut(one)
    size = int(one.agg(F.sum("n_shingles")).first()[0] or 0)
    regions = components(candidate_edges(docs, k, percent, size))
    wide = cut(one.join(regions.select(F.col("id").alias("set_class"), F.col("label").alias("region")), "set_class").select(F.col("first").alias("doc_id"), "set_class", "n_shingles", "copies", "region", "point"))
    members = cut(near_regions(wide, percent))
    found = cut(region_links(members, docs, k, percent, count))
    # Documents are connected by the links of their sets, and sets by documents that come with several.
    sets = one.select("set_class", "first")
    ends = found.where("v is not null").select("u", "v").join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    several = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_class").alias("a"), F.max("set_class").alias("b")).where("a <> b").select("doc_id")
    both = several.join(rows.where("n_shingles > 0"), "doc_id").select("doc_id", "set_class").join(sets, "set_class").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    labels = components(ends.union(both))
    named = one.select("n_shingles", "h1", "h2", "set_class", "first", "copies").join(labels, F.col("first") == F.col("id"), "left").select("n_shingles", "h1", "h2", "set_class", "copies", F.coalesce("label", "first").alias("found"))
    if count:
        named = named.join(found.where("v is null").groupBy(F.col("u").alias("set_class")).agg(F.sum("more").alias("more")), "set_class", "left")
    named = cut(named)
    joined = rows.drop("set_class", "point").join(named, ["n_shingles", "h1", "h2"], "left")
    has_id = F.col("doc_id").isNotNull()
    n_links = [F.when(has_id & F.col("copies").isNotNull(), F.col("copies") - 1 + F.coalesce("more", F.lit(0))).otherwise(0).alias("n_links")] if count else []
    discard(wide, members, found)
    return joined.select("doc_id", "n_shingles", F.when(has_id, F.coalesce("found", "doc_id")).alias("component_id"), *n_links)


#: Rows without an id are numbered from here on, by their text.
NO_ID = 1 << 62


def first_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which no row with a smaller id is linked, at any remove, each once.

    Rows with a null id take part: one stays if no row that it is linked with has an id.  Of several rows with
    the same id and text, the first by their columns stays.  Rows without words are linked with nothing.  Other columns are passed on.
    """
    row, at, again_id, again_text, gone_id = (unused(name, docs) for name in ("row", "at", "again_id", "again_text", "gone_id"))
    text, own = F.xxhash64(F.col("text")), F.col("doc_id").cast("long")
    id_ = F.coalesce(own, F.lit(NO_ID) + text.bitwiseAND(F.lit(NO_ID - 1)))
    found = cut(join_components(docs.select(id_.alias("doc_id"), "text"), k, percent))
    gone = sent(found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct())
    kept = docs.join(gone, id_ == F.col(gone_id), "left_anti")
    repeated = found.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    repeated = sent(repeated.select(F.col("doc_id").alias(again_id)))
    alone = kept.join(repeated, id_ == F.col(again_id), "left_anti")
    orderable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = kept.join(repeated, id_ == F.col(again_id), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.struct(*(F.col(f"`{c}`") for c in orderable)).alias(at), id_.alias(again_id), text.alias(again_text))
    again = again.groupBy(again_id, again_text).agg(F.min_by(row, at).alias(row)).select(f"{row}.*")
    return alone.unionByName(again)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), count=True)


SQL = """
with recursive docs as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    else [array_to_string(w, ' ')] end) as g
  from docs where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select u, v from pairs join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * common >= 90 * (a.n + b.n - common)),
edges as (select u, v from links union all select v, u from links),
reach as (select doc_id, doc_id as other from docs union select r.doc_id, e.v from reach r join edges e on e.u = r.other)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, min(r.other) as component_id, (select count(*) from edges e where e.u = d.doc_id) as n_links
from docs d left join sizes s using (doc_id) join reach r using (doc_id) group by all
"""
