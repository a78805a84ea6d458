"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. A line is described by its own numbers (length, case,
signs, repetition) and by those of the lines before and after it; the chain adds how
labels follow each other. Labels exist for documents only, so the fit alternates: lines of good documents
are good; lines of bad documents start bad, later the chain's own marginals set them, with at least the
worst line of each staying bad. The score is the length-weighted mean of the forward-backward
marginals, passed through a logistic curve fitted on the same sample.

The fit uses a bounded sample of labelled rows, each with its whole text: at most `SAMPLE_DOCS` rows with `SAMPLE_LINES`
lines in all. Scoring reads every line of every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimspark.llm.common import bounded_batches, chunks, in_training, materialize

SAMPLE_DOCS = 6000
SAMPLE_LINES = 120_000
ROUNDS = 3
STEPS = 100
RIDGE = 1e-3

_UPPER, _LOWER, _DIGIT, _SIGN, _STOP, _COMMA, _HIGH = range(1, 8)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for group, signs in ((_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, b"abcdefghijklmnopqrstuvwxyz"), (_DIGIT, b"0123456789"), (_SIGN, b"#*$%&|<>@^~=_\\/{}[]+"), (_STOP, b".?!"), (_COMMA, b",;:'\"()-")):
        table[list(signs)] = group
    table[0xC2:0xF5] = _HIGH  # first byte of a letter outside ASCII
    return table


_CLASS = _classes()
_STEPS_OF = ((3, (0.3, 0.6)), (4, (0.1, 0.4)), (5, (0.1, 0.4)), (6, (0.3, 0.6, 0.85)), (7, (0.1, 0.4)), (11, (0.1, 0.3)))
OWN = 14 + sum(len(steps) for _, steps in _STEPS_OF)
WIDTH = 1 + 3 * OWN


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of every line with a word, lines per text, and words per line."""
    lines, per_text, rows = [], np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        seen = set()
        for line in text.split("\n"):
            words = line.split()
            n = len(words)
            if not n:
                continue
            per_text[i] += 1
            lines.append(line)
            rows.append((n, len(set(words)), sum(map(eq, words, words[1:])), line in seen, words[-1][-1] in ".?!", words[0][:1].isupper(), words.count("|")))
            seen.add(line)
    if not rows:
        return np.zeros((0, OWN), np.float32), per_text, np.zeros(0)
    raw = "\n".join(lines).encode("utf-8", "surrogatepass")
    letters = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(letters == 10) + 1])
    kinds = _CLASS[letters]
    count = {k: np.add.reduceat((kinds == k).astype(np.int32), starts).astype(np.float64) for k in range(1, 8)}
    n, distinct, same, again, closed, capital, bars = np.array(rows, np.float64).T
    alpha = count[_UPPER] + count[_LOWER] + count[_HIGH]
    out = np.empty((len(rows), OWN), np.float32)
    base = (
        np.log1p(n) / 5,
        np.minimum((alpha + count[_DIGIT]) / n / 10, 2),
        1.0 / n,
        count[_UPPER] / np.maximum(alpha, 1),
        np.minimum(count[_SIGN] / n, 2) / 2,
        np.minimum(count[_STOP] / n, 2) / 2,
        distinct / n,
        same / n,
        np.minimum(count[_DIGIT] / n, 2) / 2,
        np.minimum(count[_COMMA] / n, 2) / 2,
        again,
        bars / n,
        closed,
        capital,
    )
    for k, column in enumerate(base):
        out[:, k] = column
    at = len(base)
    for k, steps in _STEPS_OF:
        for step in steps:
            out[:, at] = out[:, k] > step
            at += 1
    return out, per_text, n


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A constant, the own features and those of the line before and after within the text (zeros at its ends)."""
    out = np.zeros((len(own), WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    if len(own):
        lengths = per_text[per_text > 0]
        ends = np.cumsum(lengths)
        first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
        first[ends - lengths] = True
        last[ends - 1] = True
        out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
        out[first, 1 + OWN : 1 + 2 * OWN] = 0
        out[:-1, 1 + 2 * OWN :] = own[1:]
        out[last, 1 + 2 * OWN :] = 0
    return out


def forward_backward(node: np.ndarray, step: np.ndarray, per_text: np.ndarray, edges: bool = False):
    """Marginals of label 1 for each line, and with `edges` the summed 2 x 2 marginals of neighbours.

    `node`: score of label 1 over label 0 per line; `step`: 2 x 2 scores of following labels.
    """
    lengths = per_text[per_text > 0]
    total = len(node)
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    score = np.zeros((total, 2))
    score[:, 1] = node
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    start, size = (ends - lengths)[order], lengths[order]
    ahead, back = score.copy(), np.zeros((total, 2))
    for t in range(1, size[0]):
        rows = start[: np.searchsorted(-size, -t, "left")] + t
        before = ahead[rows - 1]
        for j in (0, 1):
            ahead[rows, j] += np.logaddexp(before[:, 0] + step[0, j], before[:, 1] + step[1, j])
    for t in range(size[0] - 2, -1, -1):
        rows = start[: np.searchsorted(-size, -(t + 1), "left")] + t
        after = score[rows + 1] + back[rows + 1]
        for i in (0, 1):
            back[rows, i] = np.logaddexp(after[:, 0] + step[i, 0], after[:, 1] + step[i, 1])
    whole = np.repeat(np.logaddexp(ahead[ends - 1, 0], ahead[ends - 1, 1]), lengths)
    marginal = np.exp(ahead[:, 1] + back[:, 1] - whole)
    pairs = np.zeros((2, 2))
    if edges:
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        rows = np.flatnonzero(inner)
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(ahead[rows, i] + step[i, j] + score[rows + 1, j] + back[rows + 1, j] - whole[rows]).sum()
    return marginal, pairs


@dataclass
class LineModel:
    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]

    def marginals(self, own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return forward_backward(with_neighbours(own, per_text) @ self.weights, self.step, per_text)[0]

    def score(self, texts: list[str]) -> np.ndarray:
        """Quality of each whole text in [0, 1]; a text without words has no good line."""
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            own, per_text, words = line_features(texts[a:b])
            out[a:b] = self.apply_curve(weighted_mean(self.marginals(own, per_text), words, per_text))
        return out

    def apply_curve(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * _logit(mean))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def weighted_mean(marginal: np.ndarray, words: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(per_text)), per_text)
    weight = np.bincount(text, words, len(per_text))
    return np.bincount(text, marginal * words, len(per_text)) / np.maximum(weight, 1)


def _fit_chain(x: np.ndarray, labels: np.ndarray, per_text: np.ndarray, weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the given line labels, by Adam on the exact gradient."""
    lengths = per_text[per_text > 0]
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths) - 1] = False
    rows = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[rows].astype(int), labels[rows + 1].astype(int)), 1)
    params = np.concatenate([weights, step.ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, STEPS + 1):
        marginal, pairs = forward_backward(x @ params[:-4], params[-4:].reshape(2, 2), per_text, edges=True)
        gradient = np.concatenate([x.T @ (marginal - labels), (pairs - seen).ravel()]) / len(x) + RIDGE * params
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def _fit_curve(mean: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    x = np.stack([np.ones(len(mean)), _logit(mean)], 1)
    w = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - labels) + 1e-3 * (w - [0.0, 1.0]))
    return float(w[0]), float(w[1])


def fit(own: np.ndarray, per_text: np.ndarray, words: np.ndarray, quality: np.ndarray) -> LineModel:
    """A model from the lines of sampled documents, `quality` per document (1 good, 0 bad)."""
    x = with_neighbours(own, per_text).astype(np.float64)
    text = np.repeat(np.arange(len(per_text)), per_text)
    labels = quality[text].astype(np.float64)
    weights, step = np.zeros(WIDTH), np.zeros((2, 2))
    bad = labels == 0
    for _ in range(ROUNDS):
        weights, step = _fit_chain(x, labels, per_text, weights, step)
        marginal, _ = forward_backward(x @ weights, step, per_text)
        fresh = np.where(bad, marginal > 0.5, labels).astype(np.float64)
        blame = np.where(bad, (1 - marginal) * words, -1.0)
        order = np.lexsort((-blame, text))
        worst = order[np.concatenate([[True], np.diff(text[order]) != 0])]
        fresh[worst[bad[worst]]] = 0
        if np.array_equal(fresh, labels):
            break
        labels = fresh
    marginal, _ = forward_backward(x @ weights, step, per_text)
    has = per_text > 0
    return LineModel(weights, step, _fit_curve(weighted_mean(marginal, words, per_text)[has], quality[has]))


def _featured(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        own, per_text, words = line_features([text or ""])
        rows.append((int(per_text[0]), own.tobytes(), words.astype(np.float64).tobytes()))
    return pd.DataFrame(rows, columns=["lines", "own", "words"])


def _last_within(lines: list[tuple[int, int]], most: int) -> int | None:
    """Of (place, lines) the last place up to which the rows have at most `most` lines together."""
    last, total = None, 0
    for place, n in sorted(lines):
        total += n
        if total > most:
            break
        last = place
    return last


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> LineModel | float:
    """A model from at most `sample` labelled rows, those with the smallest hash of their identifier, and at most `sample_lines` lines.

    Gives the share of good rows instead (0.5 without any) if one of the two labels is missing.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(sample)  # bounded, so it may be sent to every task
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    features = pandas_udf(_featured, "lines int, own binary, words binary")("text").alias("w")
    found = narrow.select(F.xxhash64(F.lit("quality"), "id").alias("place"), "quality", features).select("place", "quality", "w.*")
    found = materialize(found, "quality-sample")
    found = found.where((F.col("lines") > 0) & (F.col("lines") <= sample_lines // 10))  # no single text is the sample
    last = _last_within([(r["place"], r["lines"]) for r in found.select("place", "lines").collect()], sample_lines)
    rows = found.where(F.col("place") <= last).collect() if last is not None else []
    rows = sorted(rows, key=lambda r: (r["quality"], r["lines"], bytes(r["own"])))
    quality = np.array([r["quality"] for r in rows], np.float64)
    if len(set(quality)) < 2:
        return float(quality.mean()) if len(quality) else 0.5
    own = np.concatenate([np.frombuffer(bytes(r["own"]), np.float32).reshape(-1, OWN) for r in rows])
    words = np.concatenate([np.frombuffer(bytes(r["words"]), np.float64) for r in rows])
    return fit(own, np.array([r["lines"] for r in rows], np.int64), words, quality)


def quality_column(text: Column, model: LineModel | float) -> Column:
    """The score of a text column: 0 to 1, higher for good text. Null counts as the empty text."""

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series(np.full(len(texts), model))
        return pd.Series(model.score([t or "" for t in texts]))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted.

    Null and empty texts have no good line and get the lowest score. A null identifier is
    not held out, and its label can't be learnt. Repeated rows are scored each. Labels, language,
    source and identifier are no inputs of a score.
    """
    model = train(docs, labels.filter(in_training(id_col)), id_col, text_col, label_col, sample)
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    scored = narrow.select(id_col, F.coalesce(~in_training(id_col), F.lit(False)).alias("held_out"), quality_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """Rows of `docs` with a score of at least `least`, with all their columns; no text is shuffled."""
    model = train(docs, labels.filter(in_training(id_col)), id_col, text_col, label_col)
    return docs.filter(quality_column(F.col(text_col), model) >= least)
