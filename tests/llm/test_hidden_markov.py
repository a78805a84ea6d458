"""The chain against the sum over all paths, the counts against a plain dictionary."""

import math
import random
import re
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import hidden_markov as hm


def random_chain(rng, states, symbols):
    def rows(a, b):
        p = rng.random((a, b)) + 0.05
        return p / p.sum(1, keepdims=True)

    return hm.Chain(rows(1, states)[0], rows(states, states), rows(states, symbols).T)


def all_paths(chain, sequence):
    """(probability, path) of every path of states."""
    for path in product(range(len(chain.first)), repeat=len(sequence)):
        p = chain.first[path[0]] * chain.emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= chain.step[path[t - 1], path[t]] * chain.emit[sequence[t], path[t]]
        yield p, path


def flat(sequences):
    return np.concatenate([np.array(s, np.uint16) for s in sequences]), np.concatenate([[0], np.cumsum([len(s) for s in sequences])])


@pytest.mark.parametrize("together", [1, 7, 400_000])
def test_likelihood_and_expected_counts_equal_the_sum_over_paths(monkeypatch, together):
    monkeypatch.setattr(hm, "_TOKENS", together)
    rng = np.random.default_rng(together)
    chain = random_chain(rng, 3, 5)
    sequences = [rng.integers(0, 5, n).tolist() for n in (1, 6, 2, 2, 5, 1, 3)]
    found = hm.Expected.none(5, 3)
    hm.add_expected(chain, *flat(sequences), found)
    expected, logs = hm.Expected.none(5, 3), []
    for sequence in sequences:
        paths = list(all_paths(chain, sequence))
        whole = sum(p for p, _ in paths)
        logs.append(math.log10(whole))
        for p, path in paths:
            expected.first[path[0]] += p / whole
            for t, state in enumerate(path):
                expected.emit[sequence[t], state] += p / whole
                if t:
                    expected.step[path[t - 1], state] += p / whole
    assert np.allclose(hm.log_likelihoods(chain, *flat(sequences)), logs)
    for name in ("first", "step", "emit"):
        assert np.allclose(getattr(found, name), getattr(expected, name))
    assert math.isclose(found.likelihood, sum(logs))


def test_long_texts_do_not_underflow():
    chain = random_chain(np.random.default_rng(0), 4, 1000)
    symbols = np.random.default_rng(1).integers(0, 1000, 60_000).astype(np.uint16)
    found = hm.log_likelihoods(chain, symbols, np.array([0, 60_000]))[0]
    assert -60_000 * 4 < found < -60_000 * 2


PIECES = ["The", "the", "cat", "sat", "Ärger", "ÄRGER", "x", "\x85y", "mat.", "le", "chat", "noir"]


def documents():
    rng = random.Random(5)
    docs = []
    for i in range(400):
        kind = PIECES[:9] if i % 2 else PIECES[8:]
        words = [rng.choice(kind) if rng.random() < 0.9 else f"r{rng.randrange(200)}" for _ in range(rng.choice([0, 1, 9, 60]))]
        docs.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    return docs + [(400, None), (401, "unseen " * 3000), (None, "the nameless"), (7, docs[7][1])]


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def is_held(key):
    return key is not None and crc32(str(key).encode()) % 10 == 0


@pytest.mark.parametrize(("symbol_share", "frequent_share", "block"), [(20, 40, 600_000), (4096, 65_536, 50), (1, 1, 10)])
def test_base_columns_and_score_of_documents(spark, monkeypatch, symbol_share, frequent_share, block):
    monkeypatch.setattr(hm, "_BLOCK", block)
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"row": F.lit("clash"), "n": F.lit(1), "held_out": F.lit(2)})
    counts = Counter()
    for key, text in docs:
        if key is not None and not is_held(key):
            counts.update([*tokens(text), None])
    total, distinct = sum(counts.values()), len(counts)

    def base(text):
        return sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*tokens(text), None])

    expected = sorted((key is None, key or 0, is_held(key), len(tokens(text)) + 1, sum(counts[w] > 0 for w in [*tokens(text), None]), total, round(base(text), 6)) for key, text in docs)
    rows = hm.score_texts(df, states=3, rounds=3, symbol_share=symbol_share, frequent_share=frequent_share).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows)
    if symbol_share > 1:
        held = [r for r in rows if r["held_out"] and r["n_known"] > 5]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # two kinds of text are told apart


def test_score_is_the_chain_and_the_word_within_its_class(spark):
    """Recomputed in plain Python from the fitted chain; rounds of Baum-Welch never lose likelihood."""
    docs = documents()
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(docs)], "row long, id long, text string").select(
        "row", "id", F.lit(False).alias("held_out"), F.lit(True).alias("train"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    counts = hm.token_counts(df).cache()
    known = hm.vocabulary(counts, 20, 40, classes=16)
    own = set(known.words[: known.own_symbols])
    texts, rare = hm.read_texts(df, known)
    history = []
    chain = hm.fit(texts, known, states=3, rounds=6, history=history)
    assert all(b > a - 0.05 * abs(a) / 100 for a, b in zip(history, history[1:])) and history[-1] > history[0]
    # symbols and words within classes are distributions
    assert np.allclose(chain.emit.sum(0), 1) and np.allclose(chain.step.sum(1), 1)
    plain = {bytes(r["word"]): r["n"] for r in counts.collect()}
    mass = [0.1] * 16
    for word, n in plain.items():
        if word and word not in own:
            mass[hm.class_of(word, 16)] += n + 0.1
    assert np.allclose(mass, known.class_mass)
    found = {r["row"]: r["chain"] + r["within"] + (r["logs"] or 0.0) for r in hm.likelihoods(texts, chain).join(hm.rare_sums(rare, counts), "row", "left").collect()}
    for i, (_, text) in enumerate(docs):
        symbols, within = [], 0.0
        for word in (t.encode() for t in tokens(text)):
            if word in own:
                symbols.append(1 + known.words.index(word))
            else:
                kind = hm.class_of(word, 16)
                symbols.append(1 + known.own_symbols + kind)
                within += math.log10((plain.get(word, 0) + 0.1) / mass[kind])
        state, log = chain.first, within
        for t, symbol in enumerate([*symbols, 0]):
            state = (state @ chain.step if t else state) * chain.emit[symbol]
            log += math.log10(state.sum())
            state = state / state.sum()
        assert math.isclose(found[i], log, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = hm.score_texts(df, rounds=1).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [(1, 0, 0), (3, 0, 0)]
    assert all(r["base_score"] == pytest.approx(0) and math.isfinite(r["score"]) for r in rows)
    assert hm.score_texts(df.limit(0), rounds=1).count() == 0


def test_texts_and_rare_words_are_written_in_one_pass_without_a_sort(spark):
    texts = ["often often rare one", "often two rare", None, "rare often"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counts = hm.token_counts(docs)
    known = hm.vocabulary(counts, symbol_share=4, frequent_share=4)
    assert known.words == [b"often"]
    rows = docs.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("id"), F.lit(False).alias("held_out"), F.lit(True).alias("train"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    read, rare = hm.read_texts(rows, known)
    assert not any("kind=" in path for path in read.inputFiles())  # a folder per kind makes Spark sort every row by its kind
    assert read.orderBy("row").select("row", "n_tokens", "n_known").collect() == [(0, 5, 3), (1, 4, 2), (2, 1, 1), (3, 3, 2)]
    places = {bytes(r["word"]): (np.frombuffer(bytes(r["places"]), np.int32) + r["first"]).tolist() for r in rare.collect()}
    assert places == {b"rare": [0, 1, 3], b"one": [0], b"two": [1]}
