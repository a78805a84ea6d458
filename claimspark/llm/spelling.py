"""Groups of spelling variants: words one inserted, deleted or replaced letter apart, and the form each derives from.

Candidates come from shared parts: the place of the one edit lies in one of four windows of the shorter
word, and everything outside that window is equal, so words meet in the bucket of (length, window, rest). A bucket that is
too large is split by halves of its window, which stays exact, down to windows of one place.

Within buckets a bit-sliced position index finds the pairs: for each (position, letter) a bitset over the words of
a pack says which have that letter there. A word runs over its letters once and updates, for 64 words at a time, the set of words
equal so far (no error), the set with one letter replaced, and the set read one position further on (one letter more).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import bounded_batches, materialize

#: Letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is this many times as frequent as its variant.
RATIO = 5
#: One occurrence in so many, chosen by identifier and run, loses a letter.
NOISE = 199
WINDOWS = 4
#: Buckets with more words are split by finer windows.
HOT_WORDS = 16_384
_SLOTS = 1 << 20  # hash slots that are counted to find such buckets
_FLUSH = 200_000  # distinct words a task counts before it hands them on
_PACK = 2_048  # words of small buckets that share an index
_CELLS = 1 << 22  # letters of a pack
_QUERIES = 1_024


# ---- words ---------------------------------------------------------------------------


def noisy(key: object, run: str, noise: int | None = NOISE) -> str:
    """The run as it is read in a document: now and then without one of its letters."""
    h = crc32(f"{'' if key is None else key}:{run}".encode())
    if noise and h % noise == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def _count_words(batches: Iterator[pa.RecordBatch], least: int, noise: int | None) -> Iterator[pa.RecordBatch]:
    # a shorter run can't become long enough
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall
    counts: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            lowered = text.encode().lower().decode()  # bytes.lower changes A to Z alone
            for run, n in Counter(find(lowered)).items():
                word = noisy(key, run, noise)
                if len(word) >= least:
                    counts[word] += n
            if len(counts) >= _FLUSH:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, noise: int | None = NOISE) -> DataFrame:
    """(word, n): maximal runs of letters with A to Z lower-cased, of at least `least_length` code points."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    counted = narrow.mapInArrow(lambda batches: _count_words(batches, least_length, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# ---- buckets -------------------------------------------------------------------------


def _bucket_key() -> Column:
    """Everything of a word but its window: a letters at the front, and behind it what the shorter word has after b."""
    rest = F.greatest(F.lit(0), F.col("short_length") - F.col("b"))
    front = F.substring("word", F.lit(1), F.col("a"))
    back = F.when(rest > 0, F.substring("word", F.length("word") - rest + 1, rest)).otherwise("")
    return F.concat_ws(":", "short_length", "a", "b", F.concat(front, back))


def _bucketed(rows: DataFrame, windows: int) -> DataFrame:
    """Cut the window [a, b) of each row into up to `windows` parts, one row each, with the key of its bucket."""
    width = F.col("b") - F.col("a")
    parts = F.least(width, F.lit(windows))
    at = F.explode(F.sequence(F.lit(0), parts - 1)).alias("i")
    cut = rows.select("word", "n", "short_length", "a", width.alias("_width"), parts.alias("_parts"), at)

    def edge(i: Column) -> Column:
        return (F.col("a") + F.floor(F.col("_width") * i / F.col("_parts"))).cast("int")

    cut = cut.select("word", "n", "short_length", edge(F.col("i")).alias("_low"), edge(F.col("i") + 1).alias("b")).withColumnRenamed("_low", "a")
    return cut.withColumn("key", _bucket_key())


def buckets(words: DataFrame, hot_words: int = HOT_WORDS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows of (word, n, short_length, a, b, key), in which words one edit apart share exactly one `key` with the edit in its window.

    A word comes as the shorter one of a pair (or one of two equally long ones) and as the longer one. Buckets with more
    than `hot_words` words are cut finer until they have fewer words or a window of one place. To find them
    rows are counted by hash slot; at most 2^20 counts come back.
    """
    length = F.length("word")
    roles = F.explode(F.array(length, length - 1)).alias("short_length")
    rows = words.select("word", "n", roles).where(F.col("short_length") >= least_length)
    rows = _bucketed(rows.select("*", F.lit(0).alias("a"), (F.col("short_length") + 1).alias("b")), WINDOWS)
    slot = F.pmod(F.xxhash64("key"), F.lit(_SLOTS))
    done = None
    while True:
        rows = rows.withColumn("slot", slot)
        full = rows.where("b - a > 1").groupBy("slot").count().where(F.col("count") > hot_words).select("slot")
        full = [r["slot"] for r in full.collect()]
        if not full:
            rows = rows.drop("slot")
            return rows if done is None else done.unionByName(rows)
        spark = words.sparkSession
        marked = rows.join(F.broadcast(spark.createDataFrame([(s, True) for s in full], "slot long, hot boolean")), "slot", "left")  # at most 2^20 numbers
        marked = materialize(marked.withColumn("hot", F.coalesce("hot", F.lit(False)) & (F.col("b") - F.col("a") > 1)), "spelling-buckets")
        cold = marked.where("not hot").drop("hot", "slot")
        done = cold if done is None else done.unionByName(cold)
        rows = _bucketed(marked.where("hot").drop("hot", "slot", "key"), 2)


# ---- the index -----------------------------------------------------------------------


class PositionIndex:
    """Bitsets over words by (position, letter), and the words one edit away from a word of `length` letters."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, length: int) -> None:
        """`letters`: one row of letter numbers per word, at least `length` + 2 wide, 0 beyond its end."""
        self.length, self.size = length, len(letters)
        padded = -(-max(self.size, 1) // 64) * 64
        self.blocks = padded // 64
        alphabet = np.unique(letters)
        self._row = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
        self._row[alphabet] = np.arange(len(alphabet))
        self._bits = np.zeros((length + 1, len(alphabet), self.blocks), np.uint64)
        holder = np.zeros((padded, len(alphabet)), bool)
        for p in range(length + 1):
            holder[: self.size] = letters[:, p, None] == alphabet
            self._bits[p] = np.packbits(holder, axis=0, bitorder="little").T.copy().view(np.uint64)
        self._same_length = self._set(sizes == length)
        self._longer = self._set(sizes == length + 1)

    def _set(self, members: np.ndarray) -> np.ndarray:
        held = np.zeros(self.blocks * 64, bool)
        held[: self.size] = members
        return np.packbits(held, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of `queries`, word of the index) with one letter replaced, or one letter more in the word."""
        n = len(queries)
        equal = np.full((n, self.blocks), ~np.uint64(0))
        replaced = np.zeros((n, self.blocks), np.uint64)
        shifted = np.zeros((n, self.blocks), np.uint64)
        for i in range(self.length):
            letter = self._row[queries[:, i]]
            here, next_place = self._bits[i][letter], self._bits[i + 1][letter]
            replaced = (replaced & here) | (equal & ~here)
            shifted = (shifted | equal) & next_place
            equal &= here
        hits = (replaced & self._same_length) | ((shifted | equal) & self._longer)
        query, block = np.nonzero(hits)
        bits = np.unpackbits(hits[query, block][:, None].view(np.uint8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return query[at], block[at] * 64 + bit


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points, 0 beyond the end."""
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def _pack_pairs(words: list[str], bucket: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of one bucket, the shorter first, whose edit lies in the bucket's window.

    Equally long words come in both orders. `bucket` numbers the bucket, `low` and `high` its window per word.
    """
    sizes = np.array([len(w) for w in words])
    letters = _letters(words, length + 2)
    index = PositionIndex(letters, sizes, length)
    short = np.flatnonzero(sizes == length)
    left, right = [], []
    for start in range(0, len(short), _QUERIES):
        asked = short[start : start + _QUERIES]
        query, found = index.near(letters[asked])
        query = asked[query]
        fit = bucket[query] == bucket[found]
        query, found = query[fit], found[fit]
        # where the words part is the place of the edit
        place = (letters[query] != letters[found]).argmax(1)
        fit = (place >= low[query]) & (place < high[query])
        left.append(query[fit])
        right.append(found[fit])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *left]), np.concatenate([nothing, *right])


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (short_length, key): (word, other, other_n) for all near words."""
    kept: dict[str, list] = {"word": [], "n": [], "short_length": [], "a": [], "b": [], "key": []}

    def work(upto: int) -> Iterator[pa.RecordBatch]:
        keys = kept["key"][:upto]
        starts = [i for i in range(upto) if not i or keys[i] != keys[i - 1]] + [upto]
        start = 0
        pack: list[tuple[int, int]] = []

        def close() -> Iterator[pa.RecordBatch]:
            rows = [i for s, e in pack for i in range(s, e)]
            words, counts = [kept["word"][i] for i in rows], [kept["n"][i] for i in rows]
            numbers = np.repeat(np.arange(len(pack)), [e - s for s, e in pack])
            low, high = np.array([kept["a"][i] for i in rows]), np.array([kept["b"][i] for i in rows])
            length = kept["short_length"][rows[0]]
            left, right = _pack_pairs(words, numbers, length, low, high)
            longer = np.flatnonzero([len(words[j]) > length for j in right])
            a = np.concatenate([left, right[longer]])
            b = np.concatenate([right, left[longer]])
            if len(a):
                names = pa.array(words, pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(np.array(counts, np.int64)[b])], ["word", "other", "other_n"])

        size = 0
        for start, end in zip(starts, starts[1:]):
            if end - start < 2:
                continue
            length = kept["short_length"][start]
            if pack and (kept["short_length"][pack[0][0]] != length or size + end - start > _PACK or (size + end - start) * (length + 2) > _CELLS):
                yield from close()
                pack, size = [], 0
            pack.append((start, end))
            size += end - start
        if pack:
            yield from close()

    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns):
            kept[name] += column.to_pylist()
        last = len(kept["key"])
        while last and kept["key"][last - 1] == kept["key"][-1]:
            last -= 1  # the last bucket may go on in the next batch
        yield from work(last)
        kept = {name: values[last:] for name, values in kept.items()}
    yield from work(len(kept["key"]))


def near_words(words: DataFrame, hot_words: int = HOT_WORDS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, other, other_n): each pair of distinct words (word, n) that differ by one edit, once in either direction.

    A task holds one bucket and one Arrow batch at a time.
    """
    bounded_batches(words.sparkSession)
    rows = buckets(words, hot_words, least_length).select("word", "n", "short_length", "a", "b", "key")
    dealt = rows.repartition("key").sortWithinPartitions("short_length", "key")
    return dealt.mapInArrow(_near_rows, "word string, other string, other_n long")


# ---- groups --------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers doubled until none moves. A form is more frequent than its word, so there are no rings."""
    ahead = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_step = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(ahead.join(next_step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ahead = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return ahead


def variants(words: DataFrame, ratio: int = RATIO, hot_words: int = HOT_WORDS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, form, root, n, n_near and form_n of every distinct word of (word, n).

    The form is the most frequent near word, at a tie the first one in code-point order, if it is at least `ratio` times
    as frequent; else form and form_n are null. The root is the end of the chain of forms, the word itself without a form. Words
    shorter than `least_length` take no part. Without words there are no rows.
    """
    words = words.where(F.length("word") >= least_length)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_words(words, hot_words, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    good = -F.col("best.minus") >= ratio * F.col("n")
    with_form = materialize(
        words.join(near, "word", "left").select(
            "word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.minus")).alias("form_n")
        ),
        "spelling-forms",
    )
    ends = roots(with_form.where("form is not null"))
    return with_form.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, noise: int | None = NOISE) -> DataFrame:
    """Spelling variants among the words of all texts with at least `least_count` occurrences; see `variants`.

    Null and empty texts have no words; repeated rows count each. A null identifier is read as the empty text where the noise
    needs it. `noise` None takes the texts as they are.
    """
    counted = word_counts(docs, id_col, text_col, least_length, noise).where(F.col("n") >= least_count)
    return variants(materialize(counted, "spelling-words"), ratio, least_length=least_length)
