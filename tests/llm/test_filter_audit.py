"""The byte transducer against regular expressions, the audit against applying filters in order."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm import filter_audit as fa


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def transduced(array):
    found = fa.transduce(array)
    return list(zip(*[found[name].tolist() for name in fa.COUNTS]))


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_transducer(monkeypatch, piece):
    monkeypatch.setattr(fa, "PIECE", piece)
    rng = random.Random(piece)
    texts = [None if rng.random() < 0.05 else "".join(rng.choice("ab A#é \n\x0b|漢😀\x00\x85") for _ in range(rng.choice([0, 0, 1, 5, 60]))) for _ in range(500)]
    texts += ["x" * 30_000 + " " + "x" * 29_999 + "y", " ".join("abcdefgh" + str(i % 7) for i in range(500)), "ä" * 9 + " " + "ä" * 9]
    assert transduced(pa.array(texts)) == [counts_of(t) for t in texts]
    assert transduced(pa.array(["no"] + texts)[1:]) == [counts_of(t) for t in texts]
    assert transduced(pa.array([], pa.string())) == []


def test_equal_digests_are_told_apart_by_their_bytes():
    words = [b"aaaaaaaa1", b"aaaaaaaa2", b"aaaaaaaa1", b"b", b"c", b"b"]
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    length = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    new = fa._first_of_its_kind(data, start, length, np.zeros(6, np.int64), np.zeros(6, np.uint64))
    assert {words[i] for i in np.flatnonzero(new)} == set(words) and new.sum() == 4


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, source in docs:
        n, distinct, capitals, points, symbols = counts_of(text)
        fails = {"A"} if n < 200 else set()
        fails |= {"B"} if 100 * distinct < 50 * n else set()
        fails |= {"C"} if 100 * capitals > 2 * points else set()
        fails |= {"D"} if symbols else set()
        fails |= {"E"} if i is not None and first[text or ""] < i else set()
        rows.append((source or "", fails, i in good, i in toxic))
    out, removed_in_all = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            everyone = list(left)
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                removed_in_all[part, name] += len(gone)
                redundant = sum(name in r[1] for r in everyone) - len(gone)
                alone = sum(r[1] == {name} for r in everyone)
                out[part, order, step] = (len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {(p, o, s): v + (removed_in_all[p, o[s - 1]],) for (p, o, s), v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_matches_applying_every_order(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "Cut", "a#b", "word " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)), " ".join(f"w{i}" for i in range(199))]
    docs = [(rng.choice([None, rng.randrange(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    docs += docs[:5]  # repeated rows
    labels = [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in list(range(0, 60, 2)) + [2, 4]]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"fails": F.lit("clash"), "n": F.lit(1), "digest": F.lit(0)})
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in fa.audit(d, m).collect()}
    assert found == brute(docs, labels)
    assert fa.audit(d.limit(0), m).count() == 0
    assert fa.audit(d, m.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
