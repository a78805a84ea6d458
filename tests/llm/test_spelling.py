"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import spelling as sp


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for word, n in counts.items():
        near = [(-m, other) for other, m in counts.items() if one_edit(word, other)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    rows = {}
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        rows[word] = (form, root, n, near, form_n)
    return rows


def found(df):
    rows = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def random_words(rng, n, letters):
    words = set()
    while len(words) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 9, 13])))
        words.add(word)
        at = rng.randrange(len(word))
        words.add(rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :], word + "a", "b" + word]))
    return [w for w in sorted(words) if len(w) >= 6]


@pytest.mark.parametrize(("letters", "hot", "seed"), [("ab", 16_384, 1), ("ab", 3, 2), ("abcdefgé÷", 1, 3), ("abcdefghij", 16_384, 4)])
def test_variants_match_brute_force(spark, letters, hot, seed):
    rng = random.Random(seed)
    words = random_words(rng, 350, letters) + ["aaaaaa", "aaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500]
    counts = {w: rng.choice([5, 6, 30, 200, 1000, 5000]) for w in dict.fromkeys(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(sp.variants(df, hot_words=hot)) == brute(counts)


def test_index_tracks_all_three_sets():
    words = ["abcdef", "abcdeg", "xbcdef", "abcdefg", "aabcdef", "abccdef", "abcdfe", "abcde"]
    letters = sp._letters(words, 8)
    sizes = np.array([len(w) for w in words])
    query, hit = sp.PositionIndex(letters, sizes, 6).near(letters[:1])
    assert {words[i] for i in hit} == {"abcdeg", "xbcdef", "abcdefg", "aabcdef", "abccdef"} and set(query) == {0}


def test_words_of_documents(spark):
    rng = random.Random(9)
    pieces = ["Straße", "ÉCOLES", "Wörter", "letters", "LETTERS", "lett3rs", "d'accord", "naïveté×x", "ab", "abcdef", "漢字letters", ""]
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 40])))) for i in range(300)] + [(7, None), (8, "LETTERS " * 5000), (None, "letters")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "key": F.lit(2)})
    expected, cut = Counter(), 0
    for key, text in docs + docs[:3]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run, cut = run[: h % len(run)] + run[h % len(run) + 1 :], cut + 1
            if len(run) >= 6:
                expected[run] += 1
    assert cut and {r["word"]: r["n"] for r in sp.word_counts(df).collect()} == dict(expected)
    counts = {w: n for w, n in expected.items() if n >= 5}
    assert found(sp.group_variants(df)) == brute(counts)
    assert sp.group_variants(df.limit(0)).count() == 0


def test_many_words_in_one_bucket(spark):
    """A third of the words share all but three letters: buckets are split, and no pair is lost or doubled."""
    letters = "abcdefghij"
    rest = random.Random(2)
    words = ["commonfront" + a + b + c for a in letters for b in letters for c in letters]
    words += ["".join(rest.choice(letters) for _ in range(12)) for _ in range(2000)]
    counts = {w: 5 for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    sizes = sp.buckets(df, hot_words=100).groupBy("key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    rows = sp.variants(df, hot_words=100).where("word like 'commonfront%'")
    assert [tuple(r) for r in rows.groupBy("n_near").count().collect()] == [(27, 1000)]
