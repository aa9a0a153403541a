"""Personal data: fixed formats, and identifiers that bootstrapped contexts reveal.

Whole matches of the fixed formats, blanks included, and long hexadecimal keys are the seeds.  One to three words
before an instance, or one or two after it, are patterns, with digits and capitals levelled; a pattern is trusted if
most identifier-like tokens beside it are known and if it mostly stands beside such tokens.  Trusted
patterns make their other tokens known, which in turn supports further patterns; Spark repeats this on
the graph of patterns and instances until nothing is added.  A key alone is not taken for personal data:
like any other token it is found by a trusted pattern only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.graph import cut, discard, sent
from photonlake.llm.kernels import Hasher, chunks, inside, lean, lower_table, signed, windows, words

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: A pattern needs so many different known instances, this share of known ones among its identifier-like
#: tokens, and this share of such tokens among all that stand beside it.
MIN_KNOWN = 3
MIN_CONFIDENCE = 0.8
MIN_SELECTIVE = 0.3
#: Identifier-like: so long, with a digit, of these characters only, but for ASCII punctuation around.
MIN_LENGTH, MAX_LENGTH = 6, 64
TOKEN = re.compile(rb"[!-/:-@\[-`{-~]*([A-Za-z0-9][A-Za-z0-9_+/=.@%-]*[A-Za-z0-9=])[!-/:-@\[-`{-~]*")
#: A seed that is no personal datum by itself: so many hexadecimal digits, letters and digits among them.
KEY = re.compile(rb"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})")
#: Words before and after an instance that make patterns.
BEFORE, AFTER = 3, 2
#: What stands for the instance in a pattern of words after it.
HERE = "_ "
#: Patterns whose occurrences are counted in one pass over the texts.
COUNTED = 1 << 18
EDGES = b"\"'`.,;:!?()[]{}<>"
KEYED = re.compile(rb"([A-Za-z_]+[=:])(.*)", re.DOTALL)

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part reaches back to the end of the last match at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed formats by kind, leftmost and not overlapping, in code points."""
    digit = re.search("[0-9]", text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digit else [],
        "card": cards(text) if digit else [],
        "phone": phones(text) if digit and "+" in text else [],
    }


def join(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans.get(k, [])))


def _levelled() -> np.ndarray:
    """Bytes with A-Z as a-z and all digits as 0."""
    table = lower_table()
    table[48:58] = 48
    return table


LEVELLED = _levelled().tobytes()


class Words:
    """The words of a text by bytes."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        self.raw, self.starts, self.ends = raw, starts, ends

    def word(self, w: int) -> bytes:
        return self.raw[self.starts[w] : self.ends[w]]

    def patterns(self, a: int, b: int, first: int, last: int) -> list[str]:
        """The patterns of an instance at the bytes [a, b), which lies in the words first to last."""
        out, text, at = [], b"", first
        key = KEYED.fullmatch(self.raw[self.starts[first] : a])
        if key and not key[2].strip(EDGES):
            text = key[1]
        while True:
            if text:
                out.append(text)
            at -= 1
            if at < 0 or len(out) == BEFORE or self.ends[at] - self.starts[at] > MAX_LENGTH:
                break
            text = self.word(at) + (b" " + text if text else b"")
        found, text = [x.translate(LEVELLED).decode("utf-8", "replace") for x in out], ""
        for at in range(last + 1, min(last + 1 + AFTER, len(self.starts))):
            if self.ends[at] - self.starts[at] > MAX_LENGTH:
                break
            text += " " * bool(text) + self.word(at).translate(LEVELLED).decode("utf-8", "replace")
            found.append(HERE + text)
        return found


def _seeds(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The spans of the fixed formats in order; of overlapping ones the first."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s for own in spans.values() for s in own), key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def occurrences(text: str, spans: dict[str, list[tuple[int, int]]], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, str, bool, list[str]]]:
    """(start, end, instance, seed, patterns) of each seed and of each identifier-like token that overlaps no seed.

    Places are in code points; those of fixed formats, which are found without patterns, are -1.
    """
    raw = data.tobytes()
    own = Words(raw, starts, ends)
    upto = np.cumsum((data & 0xC0) != 0x80)  # code points that have begun
    taken = [(int(np.searchsorted(upto, a + 1)), int(np.searchsorted(upto, b)) + 1) for a, b in _seeds(spans)]
    for n, (a, b) in enumerate(taken):
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        taken[n] = a, b
        first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b - 1, "right")) - 1
        yield -1, -1, raw[a:b].decode(), True, own.patterns(a, b, first, last)
    seed_ends = np.array([b for _, b in taken], np.int64)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    for w in np.flatnonzero((digits[ends] > digits[starts]) & (ends - starts >= MIN_LENGTH)):
        word, from_ = own.word(w), int(starts[w])
        key = KEYED.match(word)
        at = key.end(1) if key else 0
        value = TOKEN.fullmatch(word, at)
        if not value or not MIN_LENGTH <= len(value[1]) <= MAX_LENGTH or not re.search(rb"[0-9]", value[1]):
            continue
        a, b = from_ + value.start(1), from_ + value.end(1)
        near = int(np.searchsorted(seed_ends, a, "right"))
        if near == len(taken) or taken[near][0] >= b:
            yield int(upto[a]) - 1, int(upto[a]) - 1 + b - a, value[1].decode(), KEY.fullmatch(value[1]) is not None, own.patterns(a, b, w, w)


FINDINGS = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base string,base_sha256 string,found array<struct<start:long,end:long,instance:string,seed:boolean,cues:array<string>>>"
_OCCURRENCE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("seed", pa.bool_()), ("cues", pa.list_(pa.string()))]))


def findings(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` the spans of the fixed formats, and all occurrences, from one pass over whole texts."""

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rows: list[tuple] = []
            for chunk in chunks(texts):
                own = words(chunk)
                digit = np.concatenate([[0], np.cumsum((chunk.data >= 48) & (chunk.data <= 57) | (chunk.data == 64))])
                for i, (lo, hi) in enumerate(zip(own.lo, own.hi, strict=True)):
                    from_, to = chunk.offsets[i], chunk.offsets[i + 1]
                    spans, found = {}, []
                    if digit[to] > digit[from_]:
                        text = texts[chunk.first + i].as_py()
                        spans = base_spans(text)
                        found = [dict(zip(("start", "end", "instance", "seed", "cues"), x, strict=True)) for x in occurrences(text, spans, chunk.data[from_:to], own.starts[lo:hi] - from_, own.ends[lo:hi] - from_)]
                    base = join(spans, KINDS)
                    rows.append((*(len(spans.get(k, [])) for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(), found))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [_OCCURRENCE]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, FINDINGS).withColumn("row", F.monotonically_increasing_id())


def _hashes(cues: Sequence[str]) -> np.ndarray:
    hasher, out = Hasher(), []
    for cue in cues:
        own = []
        for word in cue.removeprefix(HERE).split(" "):
            raw = np.frombuffer(word.encode(), np.uint8)
            own.append(hasher.ranges(hasher.prefix(raw), np.array([0]), np.array([len(raw)]))[0])
        own = np.array(own, np.uint64)
        out.append(windows(own, len(own))[0] if len(own) > 1 else own[0])
    return np.array(out, np.uint64)


def totals(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cue, total): how often the words of each candidate stand one after another in all texts.

    Candidates are counted in blocks of about COUNTED, so that what goes to the tasks is bounded.
    """
    spark = docs.sparkSession
    candidates = cut(candidates.select("cue"))
    blocks = -(-candidates.count() // COUNTED)
    out = spark.createDataFrame([], "cue string, total long")
    for block in range(blocks):
        cues = [r["cue"] for r in candidates.where(F.pmod(F.xxhash64("cue"), F.lit(blocks)) == block).collect()]  # COUNTED, about
        hashes = _hashes(cues)
        known = np.unique(hashes)

        @lean
        def count(batches: Iterator[pa.RecordBatch], known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
            hasher, table = Hasher(), _levelled()
            sums = np.zeros(len(known), np.int64)
            for batch in batches:
                for chunk in chunks(batch.column("text")):
                    own = words(chunk)
                    got = hasher.ranges(hasher.prefix(table[chunk.data]), own.starts, own.ends)
                    for k in range(1, BEFORE + 1):
                        grams = got if k == 1 else windows(got, k)[inside(own.lo, own.hi, k)[0]]
                        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                        sums += np.bincount(at[known[at] == grams], minlength=len(known))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(signed(known[some])), pa.array(sums[some])], names=["h", "total"])

        if cues:
            counted = docs.select("text").mapInArrow(count, "h long, total long").groupBy("h").agg(F.sum("total").alias("total"))
            named = spark.createDataFrame(list(zip(cues, signed(hashes).tolist(), strict=True)), "cue string, h long")
            out = out.union(named.join(counted, "h", "left").select("cue", F.coalesce("total", F.lit(0).cast("long"))))
    return cut(out)


def patterns(docs: DataFrame, found: DataFrame, after: bool = True) -> DataFrame:
    """(cue): the trusted patterns, from the ``findings`` of ``docs``; with ``after``, of words after an instance, too.

    Rounds go on until no pattern is added.
    """
    pairs = found.select(F.explode("found").alias("x")).select(F.explode("x.cues").alias("cue"), "x.instance", "x.seed")
    pairs = pairs if after else pairs.where(~F.startswith("cue", F.lit(HERE)))
    edges = cut(pairs.groupBy("cue", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    known = cut(edges.where("seed").select("instance").distinct())
    trusted = cut(edges.select("cue").limit(0))
    seen = cut(edges.select("cue", F.col("n").alias("total")).limit(0))
    # A key that its word begins with stands beside a value by itself.
    keyed = F.col("cue").rlike("(^|.* )[a-z_]+[=:]$") & ~F.startswith("cue", F.lit(HERE))
    while True:
        marked = edges.join(known.withColumn("known", F.lit(True)), "instance", "left")
        scored = marked.groupBy("cue").agg(F.count("known").alias("different"), F.sum("n").alias("n"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("good"))
        good = cut(scored.where((F.col("different") >= MIN_KNOWN) & (F.col("good") >= MIN_CONFIDENCE * F.col("n"))).join(trusted, "cue", "left_anti"))
        counted = totals(docs, good.where(~keyed).join(seen, "cue", "left_anti"))
        seen = cut(seen.union(counted))
        fresh = cut(good.join(seen, "cue", "left").where(F.col("n") >= MIN_SELECTIVE * F.coalesce("total", F.lit(0))).select("cue"))
        discard(good, counted)
        if fresh.isEmpty():
            discard(edges, known, seen)
            return trusted
        more = cut(known.union(edges.join(fresh, "cue").select("instance")).distinct())
        discard(known)
        known, trusted = more, cut(trusted.union(fresh))


def bootstrap(docs: DataFrame, after: bool = False) -> list[str]:
    """The trusted patterns, for reading: those of words before an instance, and with ``after`` of words after it.

    A pattern that says no more than a shorter trusted one is left out.
    """
    cues = {r["cue"] for r in patterns(docs, cut(findings(docs)), after).collect()}

    def shorter(cue: str) -> Iterator[str]:
        parts = cue.removeprefix(HERE).split(" ")
        for n in range(1, len(parts)):
            yield HERE + " ".join(parts[:n]) if cue.startswith(HERE) else " ".join(parts[n:])

    return sorted(c for c in cues if not any(x in cues for x in shorter(c)))


def spans_of(found: DataFrame, cues: DataFrame) -> DataFrame:
    """The result of :func:`find` from ``findings`` and trusted patterns (cue)."""
    places = found.select("row", F.explode("found").alias("x")).where("x.start >= 0").select("row", "x.start", "x.end", F.explode("x.cues").alias("cue"))
    places = places.join(sent(cues.distinct()), "cue", "left_semi").select("row", "start", "end").distinct()
    own = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("own"))
    joined = found.drop("found").join(own, "row", "left")
    text = F.array_join(F.transform("own", lambda x: F.concat(F.lit(f"{FOUND}:"), x["start"], F.lit(":"), x["end"])), ",")
    spans = F.when(F.col("own").isNull(), F.col("base")).when(F.col("base") == "", text).otherwise(F.concat("base", F.lit(","), text))
    n_id = F.coalesce(F.size("own"), F.lit(0)).cast("long")
    return joined.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.when(F.col("own").isNull(), 0).otherwise(n_id).cast("long").alias("n_id"))


def find(docs: DataFrame, cues: list[str] | None = None) -> DataFrame:
    """(doc_id, counts by kind, base_sha256, spans, n_id) of each row of ``docs``, from its whole text.

    ``cues`` are trusted patterns; without, they are learned from ``docs``.  A null text counts as empty: no
    spans.  Spans of trusted patterns never overlap one of a fixed format.  Equal texts get equal answers; null
    ids and other columns change nothing; an empty table gives an empty result.
    """
    found = cut(findings(docs))
    trusted = patterns(docs, found) if cues is None else docs.sparkSession.createDataFrame([(c,) for c in cues], "cue string")
    return spans_of(found, trusted)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
