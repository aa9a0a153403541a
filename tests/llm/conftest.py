import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="session")
def awkward():
    """Nulls everywhere, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One"), (6, "one two"), (7, "Ünï cödé \U0001f600 x"), (8, text(30_000)), (9, base), (10, base.upper()), (11, base.replace(" ", "\n")), (12, base + " tail"), (13, text(40) + " " + passage), (14, passage + "\r\n" + text(50))]
    rows += [(15 + k, " ".join(w if rng.random() > 0.03 else "zz" + str(k) for w in base.split())) for k in range(8)]
    rows += [(30 + k, text(rng.randint(1, 80))) for k in range(40)]
    rows += [(80, "same word " * 40), (81, "same word " * 30 + "end"), (82, "x" * 50_000), (83, "line a\nline b\nline a\n\nline a")]
    rows += [(4, "one"), (None, base), (None, "lost and found"), (9, base)]
    out = [(i, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "", "\U00010000")[k % 5] if k % 7 else "s1", len(t or "")) for k, (i, t) in enumerate(rows)]
    return out


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named as what operators make or use."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("mine") for n in ("size", "shard", "slot", "law", "chunk", "target", "rank", "n", "words", "label", "id", "region", "at", "h1", "first", "held_out", "score", "part", "keys", "seed", "i", "w")})
