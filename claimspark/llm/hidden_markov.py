"""A hidden Markov language model over whole texts.

States follow each other by a first-order chain and emit symbols. The END symbol closes every text; words with at least one
of `SYMBOL_SHARE` training tokens are symbols of their own; every other word belongs to one of `CLASSES` symbols by its
last two bytes and is then drawn within its class by its count. So the chain has a bounded number of parameters, while the counts
behind it grow with the corpus. Training is Baum-Welch: each task runs the scaled forward and backward recursions over
its texts and gives expected counts, Spark adds them up, and the driver divides. The score of a text is the exact
log10 likelihood of its tokens, the sum over all paths of states.

Words are bytes: texts in UTF-8 with A to Z lower-cased, split at ASCII white space, which is what `bytes` does.

Frequent words (one of `FREQUENT_SHARE` training tokens, so at most that many words) are looked up where the texts are read.
Rare words go, with the places that hold them, block by block to a join with the table of counts.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as chained
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import bounded_batches, materialize, shared_dir

STATES = 8
ROUNDS = 5
SYMBOL_SHARE = 4_096
FREQUENT_SHARE = 65_536
CLASSES = 1_024
ADDED = 0.1  # to every count
#: The entry of the table of counts that counts the ends of texts; no word is empty.
END = b""
_FLUSH = 300_000  # distinct words a task counts before it hands them on
_BLOCK = 900_000  # rare tokens of a block of texts
_TOKENS = 400_000  # tokens of short texts whose recursions run side by side


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


# ---- counts --------------------------------------------------------------------------


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
            counts[END] += 1
            if len(counts) >= _FLUSH:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def _bytes_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over the tokens of all texts; the word of no bytes counts the ends. Null texts are empty."""
    bounded_batches(texts.sparkSession)
    counted = texts.select(_bytes_of(text_col).alias("text")).mapInArrow(_count_tokens, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _class_column(word: Column, classes: int) -> Column:
    tail = F.when(F.length(word) > 2, F.substring(word, F.length(word) - 1, F.lit(2))).otherwise(word)
    return (F.crc32(tail) % classes).cast("int")


def class_of(word: bytes, classes: int = CLASSES) -> int:
    return crc32(word[-2:]) % classes


@dataclass
class Vocabulary:
    """What every task knows about words: frequent ones, sums per class, and totals."""

    total: int  # training tokens
    distinct: int
    ends: int
    words: list[bytes]  # frequent ones, symbols first
    counts: np.ndarray
    own_symbols: int
    class_mass: np.ndarray  # count of words and places for unseen ones, per class
    classes: int

    @property
    def symbols(self) -> int:
        return 1 + self.own_symbols + self.classes

    @property
    def base_mass(self) -> float:
        return self.total + ADDED * (self.distinct + 1)

    def symbol_weights(self) -> np.ndarray:
        """Training counts of the symbols: END, own ones, classes."""
        return np.concatenate([[self.ends], self.counts[: self.own_symbols], np.maximum(self.class_mass - ADDED, 0)])


def vocabulary(counts: DataFrame, symbol_share: int = SYMBOL_SHARE, frequent_share: int = FREQUENT_SHARE, classes: int = CLASSES) -> Vocabulary:
    """At most `frequent_share` words and `classes` sums come to the driver, for a word must hold its share of all tokens."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    found = {r["word"]: r["n"] for r in counts.where((F.col("n") * frequent_share >= total) | (F.col("word") == END)).collect()}
    found = {bytes(w): n for w, n in found.items()}
    ends = found.pop(END, 0)
    words = sorted(found, key=lambda w: (found[w] * symbol_share < total, w))
    own = sum(found[w] * symbol_share >= total for w in words)
    rest = counts.where((F.col("n") * symbol_share < total) & (F.col("word") != END))
    mass = np.full(classes, ADDED)
    for r in rest.groupBy(_class_column(F.col("word"), classes).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["c"]] = r["n"] + ADDED * (r["v"] + 1)
    return Vocabulary(total, distinct, ends, words, np.array([found[w] for w in words], float), own, mass, classes)


# ---- reading texts as symbols ----------------------------------------------------------


_TEXTS = "row long, id {id}, held_out boolean, train boolean, n_tokens long, n_known long, base double, within double, symbols binary"
_RARE = "word binary, first long, places binary"


class _Reader:
    """Texts as symbols, with what the frequent words alone say, and blocks of places of rare words."""

    def __init__(self, known: Vocabulary) -> None:
        self.known = known
        self._frequent = {w: i for i, w in enumerate(known.words)}
        classes = np.array([class_of(w, known.classes) for w in known.words], np.int64)
        own = np.arange(len(known.words)) < known.own_symbols
        self._symbol = np.where(own, 1 + np.arange(len(known.words)), 1 + known.own_symbols + classes).astype(np.uint16)
        self._base = np.log10((known.counts + ADDED) / known.base_mass)
        self._within = np.where(own, 0.0, np.log10((known.counts + ADDED) / known.class_mass[classes]) if len(classes) else 0.0)
        self._class_log = np.log10(known.class_mass)
        self._end_base = float(np.log10((known.ends + ADDED) / known.base_mass))
        self._tails: dict[bytes, int] = {}  # classes by the last two bytes
        self._start_block(0)

    def _start_block(self, first: int) -> None:
        self.first = first
        # one lookup per token: frequent words have their numbers, and a word that is new to the block gets the next one
        self._numbers: defaultdict[bytes, int] = defaultdict(None, self._frequent)
        self._numbers.default_factory = self._numbers.__len__
        self._rare_class = np.zeros(0, np.int64)
        self._rare_word: list[np.ndarray] = []
        self._rare_row: list[np.ndarray] = []
        self._held = 0

    def texts(self, rows: list[int], about: list[pa.Array], raw: list[bytes]) -> pa.RecordBatch:
        known, numbers, frequent = self.known, self._numbers, len(self._frequent)
        split = [words_of(t) for t in raw]
        sizes = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter(map(numbers.__getitem__, chained.from_iterable(split)), np.int64, sizes.sum())
        text = np.repeat(np.arange(len(raw)), sizes)
        common = codes < frequent
        tails = [w[-2:] for w in islice(numbers, frequent + len(self._rare_class), None)]
        for tail in set(tails).difference(self._tails):
            self._tails[tail] = class_of(tail, known.classes)
        new = np.fromiter(map(self._tails.__getitem__, tails), np.int64, len(tails))
        self._rare_class = np.concatenate([self._rare_class, new])
        symbols = np.concatenate([self._symbol, (1 + known.own_symbols + self._rare_class).astype(np.uint16)])[codes]
        base = np.concatenate([self._base, np.full(len(self._rare_class), -np.log10(known.base_mass))])[codes]
        within = np.concatenate([self._within, -self._class_log[self._rare_class]])[codes]
        rare = np.flatnonzero(~common)
        if len(rare):
            self._rare_word.append((codes[rare] - frequent).astype(np.int32))
            self._rare_row.append((np.array(rows, np.int64)[text[rare]] - self.first).astype(np.int32))
            self._held += len(rare)
        # every text ends with END
        upto = np.cumsum(sizes)
        all_symbols = np.insert(symbols, upto, 0)
        offsets = np.concatenate([[0], np.cumsum((sizes + 1) * 2)]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(all_symbols.tobytes())])
        n = len(raw)
        sums = [np.bincount(text, values, n).astype(float) for values in (common, base, within)]  # no words: integers
        end_known = int(known.ends > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), *about, pa.array(sizes + 1), pa.array(sums[0].astype(np.int64) + end_known), pa.array(sums[1] + self._end_base), pa.array(sums[2]), packed],
            ["row", "id", "held_out", "train", "n_tokens", "n_known", "base", "within", "symbols"],
        )

    def block(self) -> pa.RecordBatch | None:
        """Rare words of the block with the texts that hold them, once per occurrence."""
        if not self._held:
            return None
        word, row = np.concatenate(self._rare_word), np.concatenate(self._rare_row)
        order = np.argsort(word, kind="stable")
        sizes = np.bincount(word, minlength=len(self._rare_class))
        offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
        places = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(row[order].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(list(islice(self._numbers, len(self._frequent), None)), pa.binary()), pa.array(np.full(len(sizes), self.first)), places], ["word", "first", "places"])


def _read(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Rows of texts, which have symbols, and of rare words, which have a word; the other columns are null."""

    def widened(batch: pa.RecordBatch, id_type: pa.DataType) -> pa.RecordBatch:
        n, there = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
        return pa.RecordBatch.from_arrays([there[name] if name in there else pa.nulls(n, kept or id_type) for name, kept in _COLUMNS.items()], list(_COLUMNS))

    reader, id_type = _Reader(known), pa.null()
    for batch in batches:
        id_type = batch.column(1).type
        rows, raw = batch.column(0).to_pylist(), batch.column(4).to_pylist()
        start = 0
        while start < len(rows):
            end, size = start, 0
            while end < len(rows) and (end == start or size + len(raw[end]) <= 1_000_000):
                size += len(raw[end])
                end += 1
            if not reader._held:
                reader._start_block(rows[start])
            about = [batch.column(i).slice(start, end - start) for i in (1, 2, 3)]
            yield widened(reader.texts(rows[start:end], about, raw[start:end]), id_type)
            if reader._held >= _BLOCK:
                yield widened(reader.block(), id_type)
                reader._start_block(0)
            start = end
    if reader._held:
        yield widened(reader.block(), id_type)


#: Columns of the written rows; the identifier keeps its type.
_COLUMNS = {
    "row": pa.int64(), "id": None, "held_out": pa.bool_(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "within": pa.float64(),
    "symbols": pa.binary(), "word": pa.binary(), "first": pa.int64(), "places": pa.binary(),
}


def read_texts(texts: DataFrame, known: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Texts (row, id, held_out, train, text) as symbols, and the rare words with the rows that hold them; one pass, written once."""
    spark = texts.sparkSession
    bounded_batches(spark)
    schema = f"{_TEXTS}, {_RARE}".replace("{id}", texts.schema["id"].dataType.simpleString())
    path = f"{shared_dir(spark)}/hidden-markov-{uuid.uuid4().hex}"
    read = texts.mapInArrow(lambda batches: _read(batches, known), schema)
    read.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back.where("symbols is not null").drop("word", "first", "places"), back.where("word is not null").select("word", "first", "places")


# ---- the chain -----------------------------------------------------------------------


@dataclass
class Chain:
    """Probabilities of the first state, of following states, and of symbols per state (one row per symbol)."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def start_chain(weights: np.ndarray, states: int = STATES, seed: int = 13) -> Chain:
    """States that differ slightly at random from the overall shares of symbols and tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (weights + 1.0)[:, None] * rng.uniform(0.5, 1.5, (len(weights), states))
    step = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Chain(np.full(states, 1.0 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts, longest first, in groups of bounded size whose recursions run side by side."""
    order = np.argsort(-sizes, kind="stable")
    upto = np.cumsum(sizes[order])
    start = 0
    while start < len(order):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + _TOKENS, "right")))
        yield order[start:end]
        start = end


def _side_by_side(symbols: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the chosen texts (longest first) by time, then text; the bounds of each time, and the text of each symbol."""
    sizes = (offsets[1:] - offsets[:-1])[chosen]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts that have a token at each time
    bounds = np.concatenate([[0], np.cumsum(active)])
    text = np.arange(bounds[-1]) - np.repeat(bounds[:-1], active)
    own = symbols[offsets[:-1][chosen][text] + np.repeat(np.arange(len(active)), active)]
    return own, bounds, text


def _forward(chain: Chain, emitted: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales per token."""
    ahead, scale = np.empty_like(emitted), np.empty((len(emitted), 1))
    ones = np.ones((emitted.shape[1], 1))
    np.multiply(emitted[: bounds[1]], chain.first, out=ahead[: bounds[1]])
    for t in range(len(bounds) - 1):
        at, end = bounds[t], bounds[t + 1]
        state = ahead[at:end]
        if t:
            before = bounds[t - 1]
            np.matmul(ahead[before : before + end - at], chain.step, out=state)
            state *= emitted[at:end]
        total = np.matmul(state, ones, out=scale[at:end])
        state /= total
    return ahead, scale[:, 0]


def log_likelihoods(chain: Chain, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence symbols[offsets[i]:offsets[i + 1]]; none is empty."""
    out = np.zeros(len(offsets) - 1)
    for chosen in _groups(offsets[1:] - offsets[:-1]):
        own, bounds, text = _side_by_side(symbols, offsets, chosen)
        _, scale = _forward(chain, chain.emit[own], bounds)
        out[chosen] = np.bincount(text, np.log10(scale), len(chosen))
    return out


@dataclass
class Expected:
    """Expected counts of first states, steps and emissions, and the log10 likelihood behind them."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def none(cls, symbols: int, states: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def add_expected(chain: Chain, symbols: np.ndarray, offsets: np.ndarray, into: Expected) -> None:
    """Forward and backward over each sequence; adds the expected counts."""
    n_symbols, states = chain.emit.shape
    for chosen in _groups(offsets[1:] - offsets[:-1]):
        own, bounds, _ = _side_by_side(symbols, offsets, chosen)
        emitted = chain.emit[own]
        ahead, scale = _forward(chain, emitted, bounds)
        into.likelihood += float(np.log10(scale).sum())
        emitted /= scale[:, None]
        followed, back_step = np.zeros((states, states)), chain.step.T.copy()
        later = np.empty((len(chosen), states))  # scaled backward probabilities at one time; none, so 1, where a text ends
        for t in range(len(bounds) - 2, 0, -1):
            at, end, before = bounds[t], bounds[t + 1], bounds[t - 1]
            behind = emitted[at:end]
            reached = bounds[t + 2] - end if t + 2 < len(bounds) else 0
            behind[:reached] *= later[:reached]
            earlier = ahead[before : before + end - at]
            followed += earlier.T @ behind
            earlier *= np.matmul(behind, back_step, out=later[: end - at])  # now the posterior of each state
        into.step += chain.step * followed
        into.first += ahead[: bounds[1]].sum(0)
        for s in range(states):
            into.emit[:, s] += np.bincount(own, ahead[:, s], n_symbols)


def maximised(counts: Expected) -> Chain:
    """The chain that the expected counts make likeliest, with a little added to each count."""
    first = counts.first + ADDED
    step = counts.step + ADDED
    emit = counts.emit + ADDED
    return Chain(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    symbols = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16)
    return symbols, (offsets - offsets[0]) // 2


def fit(texts: DataFrame, known: Vocabulary, states: int = STATES, rounds: int = ROUNDS, history: list[float] | None = None) -> Chain:
    """Baum-Welch over the training rows of `read_texts`, all of them in every round.

    A task adds up its texts and gives one row per symbol; Spark adds the tasks' rows. The driver receives the
    sums: one row of `states` numbers per symbol, which the vocabulary bounds. `history` receives the likelihood before each round.
    """
    chain = start_chain(known.symbol_weights(), states)
    n = known.symbols
    names = [f"s{i}" for i in range(states)]
    schema = "symbol int, " + ", ".join(f"{name} double" for name in names)
    train = texts.where("train").select("symbols")
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], chain: Chain = chain) -> Iterator[pa.RecordBatch]:
            found = Expected.none(n, states)
            for batch in batches:
                if batch.num_rows:
                    add_expected(chain, *_sequences(batch.column(0)), found)
            extra = np.zeros((1, states))
            extra[0, 0] = found.likelihood
            table = np.concatenate([found.emit, found.first[None], found.step, extra])
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(table[used, s]) for s in range(states)]], ["symbol", *names])

        sums = train.mapInArrow(expect, schema).groupBy("symbol").agg(*[F.sum(name).alias(name) for name in names])
        table = np.zeros((n + states + 2, states))
        for r in sums.collect():
            table[r["symbol"]] = r[1:]
        if history is not None:
            history.append(float(table[-1, 0]))
        chain = maximised(Expected(table[n], table[n + 1 : -1], table[:n]))
    return chain


# ---- scores --------------------------------------------------------------------------


def _rare_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (first, places, n): per row and batch the sums of log10(n + ADDED) and of known rare tokens."""
    for batch in batches:
        if not batch.num_rows:
            continue
        first, n = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 2))
        places = batch.column(1).cast(pa.large_binary())
        _, offsets, values = places.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(places) + 1, places.offset * 8)
        place = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
        sizes = np.diff(offsets) // 4
        rows, inverse = np.unique(np.repeat(first, sizes) + place, return_inverse=True)
        count = np.repeat(n, sizes)
        logs, known = np.bincount(inverse, np.log10(count + ADDED)).astype(float), np.bincount(inverse, count > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(logs), pa.array(known.astype(np.int64))], ["row", "logs", "known"])


def rare_sums(rare: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, logs, known) from the rare words and the table of counts. A word is one row per block of texts, however often it occurs."""
    counted = rare.join(counts, "word", "left").select("first", "places", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    parts = counted.mapInArrow(_rare_sums, "row long, logs double, known long")
    return parts.groupBy("row").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))


def likelihoods(texts: DataFrame, chain: Chain) -> DataFrame:
    """Texts with `chain`, the log10 likelihood of their symbols, in place of the symbols."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log_likelihoods(chain, *_sequences(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield batch.drop_columns(["symbols"]).append_column("chain", pa.array(found))

    narrow = texts.select("row", "symbols", "id", "held_out", "n_tokens", "n_known", "base", "within")
    schema = narrow.drop("symbols").schema.add("chain", "double")
    return narrow.mapInArrow(score, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, symbol_share: int = SYMBOL_SHARE, frequent_share: int = FREQUENT_SHARE) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(identifier as text) isn't divisible by ten; a row without identifier is neither
    learnt from nor held out. Null and empty texts are one END. Repeated rows count and are scored each. With nothing to learn
    from, every token has the same base probability of 1 and the chain's start decides the score.
    """
    bounded_batches(docs.sparkSession)
    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("train"), _bytes_of(text_col).alias("text"))
    counts = materialize(token_counts(narrow.where("train")), "token-counts")
    known = vocabulary(counts, symbol_share, frequent_share)
    rows = narrow.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "train", "text")
    texts, rare = read_texts(rows, known)
    chain = fit(texts, known, states, rounds)
    scored = likelihoods(texts, chain).join(rare_sums(rare, counts), "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("chain") + F.col("within") + logs).alias("score"),
    )
