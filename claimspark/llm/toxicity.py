"""Toxicity categories by a classifier chain.

Each category has a linear model over word and word-stem features; later models also get the
probabilities of the earlier categories. Those inputs are out-of-fold predictions while the
later models are trained, and the earlier models' own predictions when documents are scored,
so that a later model learns how far an unseen earlier probability can be trusted.

Features are chosen from the training sample by a likelihood ratio against the last
category, counted on the cluster. The fits use a bounded sample (`SAMPLE_DOCS` labelled rows,
`FEATURES` features); scoring reads every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimspark.llm.common import bounded_batches, in_training, materialize, text_of

SAMPLE_DOCS = 4000
FEATURES = 768
FOLDS = 3
STEPS = 150
RIDGE = 1e-4
#: A category's rare positive rows weigh as much as the negative ones together, up to this factor: a missed document costs more than a second look.
MOST_WEIGHT = 8.0
#: Lengths of the stems beside the whole word.
STEMS = (4, 5, 6)
_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str) -> Counter:
    """How often the text holds each word and each stem, in lower case; stems end in an asterisk."""
    words = Counter(_LETTERS.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


@dataclass
class Chain:
    """Models in order: per category a weight per feature, per earlier category, and a constant.

    `marks` are the features that mark toxic text; they name the narrower categories in training and don't limit a score.
    """

    categories: tuple[str, ...]
    index: dict[str, int]
    weights: list[np.ndarray]
    marks: np.ndarray

    def matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)), np.float32)
        at = self.index.get
        for i, text in enumerate(texts):
            for name, n in features(text or "").items():
                k = at(name)
                if k is not None:
                    x[i, k] = n
        return np.log1p(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category; each column is an input of the next."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, _sigmoid(_inputs(x, out) @ w)])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _inputs(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.column_stack([x, earlier, np.ones(len(x))])


def _fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by accelerated gradient descent with a step from the inputs' norm."""
    x = x.astype(np.float32)
    weight = np.where(y == 1, min(MOST_WEIGHT, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))), 1.0).astype(np.float32)
    weight /= weight.sum()
    vector = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        vector = vector / max(np.linalg.norm(vector), 1e-12)
        vector = x.T @ (weight * (x @ vector))
    step = 1 / (0.25 * np.linalg.norm(vector) * 1.1 + RIDGE)
    w = ahead = np.zeros(x.shape[1], np.float32)
    ridge = np.full(x.shape[1], RIDGE, np.float32)
    ridge[-1] = 0
    for t in range(STEPS):
        new = ahead - step * (x.T @ (weight * (_sigmoid(x @ ahead) - y).astype(np.float32)) + ridge * ahead)
        ahead = (new + t / (t + 3) * (new - w)).astype(np.float32)
        w = new.astype(np.float32)
    return w.astype(np.float64)


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...], index: dict[str, int], marks: np.ndarray) -> Chain:
    """`labels` has a column per category, `folds` a number below `FOLDS` per row."""
    weights, held = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        inputs, y = _inputs(x, held), labels[:, k].astype(float)
        weights.append(_fit_linear(inputs, y))
        fresh = np.zeros(len(x))
        for fold in range(FOLDS):
            out = folds == fold
            if out.any():
                fresh[out] = _sigmoid(inputs[out] @ _fit_linear(inputs[~out], y[~out]))
        held = np.column_stack([held, fresh])
    return Chain(categories, index, weights, marks)


def _feature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for label, text in zip(frame["label"], frame["text"]):
            names = list(features(text or ""))
            yield pd.DataFrame({"name": names, "label": np.full(len(names), label, np.int32)})


def choose_features(sample: DataFrame, most: int = FEATURES) -> list[tuple[str, float]]:
    """The `most` features (name, lift) whose presence says most about `label`, by the likelihood ratio of the two counts."""
    totals = sample.agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("all")).first()
    yes, no = float(totals["yes"] or 0), float((totals["all"] or 0) - (totals["yes"] or 0))
    if not yes or not no:
        return []
    counts = sample.select("text", "label").mapInPandas(_feature_rows, "name string, label int").groupBy("name").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))

    def part(count: Column, mean: Column) -> Column:
        return F.when(count > 0, count * F.log(count / mean)).otherwise(0.0)

    both = F.col("a") + F.col("b")
    share = F.lit(yes / (yes + no))
    absent_yes, absent_no = F.lit(yes) - F.col("a"), F.lit(no) - F.col("b")
    absent = absent_yes + absent_no
    gain = part(F.col("a"), both * share) + part(F.col("b"), both * (1 - share)) + part(absent_yes, absent * share) + part(absent_no, absent * (1 - share))
    lift = F.log((F.col("a") + 0.5) / (yes + 1)) - F.log((F.col("b") + 0.5) / (no + 1))
    top = counts.filter("a + b >= 3").select("name", gain.alias("gain"), lift.alias("lift")).orderBy(F.desc("gain"), "name").limit(most)
    return [(r["name"], r["lift"]) for r in top.collect()]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(label_col), "id"), "id").limit(size)  # bounded, so it may be sent to every task
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return materialize(rows, "toxicity-sample")


#: Marks per text from which a toxic text counts as repeated or as severe.
REPEATED, SEVERE = 4, 8
#: Lift (log odds) from which a feature is a mark of toxic text.
MARK_LIFT = 3.0
CATEGORIES = ("severe", "repeated", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS, most: int = FEATURES) -> Chain | float:
    """A chain over `CATEGORIES`, from labels that only know the last, broadest category.

    `repeated` and `severe` are toxic texts with at least `REPEATED` and `SEVERE` words that mark toxic
    text. Gives the share of toxic rows instead (0 without any) if a label is missing from the sample.
    """
    bounded_batches(docs.sparkSession)
    rows = _sample(docs, labels, id_col, text_col, label_col, sample)
    chosen = choose_features(rows, most)
    if not chosen:
        share = rows.agg(F.avg("label")).first()[0]
        return float(share or 0.0)
    index = {name: i for i, (name, _) in enumerate(chosen)}
    marks = frozenset(name for name, lift in chosen if lift >= MARK_LIFT)
    at = np.array([index[name] for name in marks], int)
    empty = Chain(CATEGORIES, index, [], at)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = empty.matrix(list(frame["text"])).astype(np.float32)
            yield pd.DataFrame({"id": frame["id"].astype(str), "label": frame["label"], "marks": [_marks(t, marks) for t in frame["text"]], "x": [row.tobytes() for row in x]})

    found = rows.select(F.col("id").cast("string").alias("id"), "text", "label").mapInPandas(counted, "id string, label int, marks int, x binary").collect()
    found = sorted(found, key=lambda r: r["id"])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float32).reshape(len(found), -1)
    toxic = np.array([r["label"] for r in found]) == 1
    hits = np.array([r["marks"] for r in found])
    wanted = np.column_stack([toxic & (hits >= SEVERE), toxic & (hits >= REPEATED), toxic])
    # As many blank rows as toxic ones, none of them toxic: the constant of a model comes to mean a text that holds nothing known.
    blank = int(toxic.sum())
    x = np.concatenate([x, np.zeros((blank, x.shape[1]), np.float32)])
    wanted = np.concatenate([wanted, np.zeros((blank, wanted.shape[1]), bool)])
    return fit_chain(x, wanted, np.arange(len(x)) % FOLDS, CATEGORIES, index, at)


def _marks(text: str, marks: frozenset[str]) -> int:
    """Words of the text that are, or begin with, a mark."""
    words = Counter(_LETTERS.findall(text.lower()))
    return sum(n for word, n in words.items() if word in marks or any(word[:size] + "*" in marks for size in STEMS if len(word) > size))


def chain_column(text: Column, chain: Chain | float) -> Column:
    """A struct of one probability per category. Null counts as the empty text."""
    result = ", ".join(f"{c} double" for c in CATEGORIES)

    @pandas_udf(result)
    def scored(texts: pd.Series) -> pd.DataFrame:
        if isinstance(chain, float):
            return pd.DataFrame(np.full((len(texts), len(CATEGORIES)), chain), columns=list(CATEGORIES))
        parts = [chain.predict(chain.matrix(list(texts[i : i + 512]))) for i in range(0, len(texts), 512)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES))), columns=list(CATEGORIES))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id_col, held_out, p_severe, p_repeated, score (of toxic), predicted, is_toxic.

    Labels are learnt only from rows whose crc32 of the identifier as text doesn't leave 1 by 3. Null
    and empty texts score what the models give a text without known words. Repeated rows are scored each; other columns are ignored.
    """
    chain = train(docs, labels.filter(in_training(id_col)), id_col, text_col, label_col)
    narrow = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    scored = narrow.select("id", chain_column(F.col("text"), chain).alias("p"))
    score = F.col("p.toxic")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(~in_training("id"), F.lit(False)).alias("held_out"),
        F.col("p.severe").alias("p_severe"),
        F.col("p.repeated").alias("p_repeated"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        (score >= 0.5).alias("is_toxic"),
    )
