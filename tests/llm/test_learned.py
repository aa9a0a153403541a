"""Language, toxicity and personal data: held-out accuracy, and plain Python where there is a right answer."""

import hashlib
import random
import re

import numpy as np
import pytest

from photonlake.llm import langid, pii, toxicity
from tests.llm.conftest import SCHEMA, held

SYLLABLES = {"aa": "ka lo mi nu te", "bb": "bra dro gli fne sch", "cc": "éa ñu çi öl ße"}


def speech(rng, language, n):
    parts = SYLLABLES[language].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 40)), lang, "s", 0) for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


def test_languages(spark, spoken, docs, clashing, empty, awkward):
    model = langid.learn(spoken)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.identify(spoken, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    tested = [i for i in truth if held(i)]
    assert tested and all(got[i]["held_out"] == held(i) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in tested]) > 0.95
    odd = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "中"), (None, "kalo")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False, False] and [r["score"] == 0 for r in odd][:3] == [True] * 3
    for rows in (docs, clashing):
        out = langid.identify(rows, model).collect()
        assert len(out) == len(awkward) and all(0 <= r["score"] <= 1 for r in out)
    assert langid.learn(empty) is None and {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("k", [2, 3, 5, 9])
def test_codewords_are_apart(k):
    code = langid.codewords(k)
    assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= 1
    assert (np.abs(code.sum(0)) < k).all()


def test_wrong_bits_are_corrected():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    for c in range(4):
        for bit in range(code.shape[1]):
            margins = 3 * code[c].copy()
            margins[bit] *= -0.5
            assert langid.decode(model, margins[None])[0][0] == c


@pytest.fixture(scope="module")
def insulting(spark):
    rng = random.Random(4)
    stems, rows, labels = ["grumpf", "blarg", "snozz"], [], []
    for i in range(1200):
        text = speech(rng, rng.choice(list(SYLLABLES)), rng.randint(10, 60)).split()
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(stems) + rng.choice(["", "er", "ig", "ol", "ity"]))
        rows.append((i, " ".join(text), "aa", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, insulting, docs, clashing, empty, awkward):
    rows, labels = insulting
    model = toxicity.learn(rows, labels)
    got = {r["doc_id"]: r for r in toxicity.score(rows, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    tested = [i for i in truth if held(i)]
    assert np.mean([got[i]["predicted"] for i in tested if truth[i]]) > 0.9
    assert np.mean([got[i]["predicted"] for i in tested if not truth[i]]) < 0.05
    unseen = spark.createDataFrame([(1, "ka lo snozzzer blargy mi nu"), (2, "ka lo mi nu"), (3, None), (4, "")], "doc_id long, text string")
    a, b, c, d = (r["score"] for r in toxicity.score(unseen, model).orderBy("doc_id").collect())
    assert a > 0.7 > b and c == d == 0
    for x in (docs, clashing):
        assert toxicity.score(x, model).count() == len(awkward)
    kept = toxicity.without_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == sum(not r["predicted"] for r in got.values())
    assert toxicity.learn(empty, labels) is None and toxicity.learn(rows, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def test_base_spans_on_random_texts():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("a@.b-+1 2(3)4é56_789%\n") for _ in range(rng.randint(0, 60)))
        spans = pii.base_spans(text)
        assert [(k, a, b) for k in pii.KINDS for a, b in spans[k]] == brute_spans(text), text
    text = "é 4111 1111 1111 1111 x@y.z.w 010.1.2.255.9 +1 (212) 555-0100"
    assert [k for k, _, _ in brute_spans(text)] == ["email", "ip", "card", "phone"]
    assert [(k, a, b) for k in pii.KINDS for a, b in pii.base_spans(text)[k]] == brute_spans(text)
    assert pii.base_spans("9" * 100_000) == {"email": [], "ip": [], "card": [], "phone": []}


def test_bootstrapped_identifiers(spark, docs, clashing, empty, awkward):
    rows = [(i, f"please write mailbox: u{i}@mail.example.org soon about the 1990s-era thing") for i in range(24)]
    rows += [(40 + i, f"é the mailbox: QX{i}77-{i}AB is new, the number 12{i}4x of the") for i in range(4)]
    rows += [(60, None), (61, ""), (None, "mailbox: ZZ12345")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    cues = pii.bootstrap(own)
    assert cues == ["mailbox:"]
    got = {r["doc_id"]: r for r in pii.find(own, cues).collect()}
    assert got[40]["spans"] == "id:15:24" and got[0]["spans"] == "email:22:41" and got[0]["n_email"] == 1
    assert got[60]["spans"] == got[61]["spans"] == "" and got[60]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[None]["spans"] == "id:9:16"
    assert pii.bootstrap(empty) == [] and pii.find(clashing, []).count() == len(awkward)
    for r in pii.find(docs, []).collect():
        assert r["n_email"] == 0


def test_cues_of_seeds_with_blanks_and_without_digits(spark):
    name = lambda i: "abcdefghij"[i]
    rows = [(i, f"é call phone: +1 (74{i}) 555-382{i} or so") for i in range(6)]
    rows += [(20 + i, f"  the Mailto <{name(i)}x@mail.example.org> there") for i in range(6)]
    rows += [(30, "phone: QX1177AB and"), (31, "card=TT99887 or"), (32, "mailto ZZ12345 is"), (33, "other QY1177AB is")]
    rows += [(50 + i, f"pay card={c} now") for i, c in enumerate(("4111 1111 1111 1111", "5500 0000 0000 0004", "5555 5555 5555 4444", "4012 8888 8888 1881"))]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    cues = pii.bootstrap(own)
    assert cues == ["card=", "mailto", "phone:"]
    got = {r["doc_id"]: r["spans"] for r in pii.find(own, cues).collect()}
    assert [got[i] for i in (30, 31, 32, 33)] == ["id:7:15", "id:5:12", "id:7:14", ""]
    assert got[0] == "phone:14:31"


def test_cues_are_followed_to_the_end(spark):
    texts = [f"ca: u{i}@mail.example.org" for i in range(20)] + [f"ca: ID-a{i}77" for i in range(4)]
    for old, new in zip("abcdefg", "bcdefgh", strict=True):
        texts += [f"c{new}: ID-{old}{i}77" for i in range(4)] * 5 + [f"c{new}: ID-{new}{i}77" for i in range(4)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert pii.bootstrap(own) == [f"c{c}:" for c in "abcdefgh"]
