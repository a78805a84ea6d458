"""What each of several filters takes away, in every order in which they can be applied.

A table-driven byte transducer reads each text once as UTF-8. Its next state and its output depend on the
state and the class of the byte: it counts words, capitals, code points and symbols, and marks where words start and end. A
definite automaton, its state after a byte follows from that byte's class, so the table can be looked up for
all bytes of a batch at once. The spans of the words go into an open-addressing hash table per batch; a span
counts as seen only after its bytes were compared.

Filters are then a set of bits per row, and rows become counts per (part, bits): at most 32 per part. Orders, steps and
Shapley values are arithmetic on those counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from claimspark.llm.common import bounded_batches, materialize, text_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Characters that filter D looks for.
SYMBOLS = b"#$%&*|"

# Classes of bytes, states, and bits of the output.
_SPACE, _CAPITAL, _SYMBOL, _PLAIN, _LEAD, _FOLLOWING = range(6)
_BETWEEN, _INSIDE = 0, 1
_STARTS, _ENDS, _POINT, _IS_CAPITAL, _IS_SYMBOL = 1, 2, 4, 8, 16
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64
#: Bytes that are looked at together; one longer text is looked at alone.
PIECE = 1 << 20


def _byte_classes() -> np.ndarray:
    table = np.full(256, _PLAIN, np.uint8)
    table[0x80:0xC0] = _FOLLOWING
    table[0xC0:] = _LEAD
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[ord("A") : ord("Z") + 1] = _CAPITAL
    table[list(SYMBOLS)] = _SYMBOL
    return table


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """State after a byte, by its class, and output by (state before, class)."""
    after = np.full(6, _INSIDE, np.uint8)
    after[_SPACE] = _BETWEEN
    output = np.zeros((2, 6), np.uint8)
    for state in (_BETWEEN, _INSIDE):
        for kind in range(6):
            out = _POINT if kind != _FOLLOWING else 0
            out |= {_CAPITAL: _IS_CAPITAL, _SYMBOL: _IS_SYMBOL}.get(kind, 0)
            if state == _BETWEEN and kind != _SPACE:
                out |= _STARTS
            if state == _INSIDE and kind == _SPACE:
                out |= _ENDS
            output[state, kind] = out
    return after, output


_CLASS = _byte_classes()
_AFTER, _OUTPUT = _transducer()
_STATE_OF_BYTE = _AFTER[_CLASS]
_OUTPUT_OF_BYTE = _OUTPUT[:, _CLASS]  # by (state before, byte)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _load(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one number; bytes beyond `left` are cleared. `data` has eight bytes to spare."""
    whole = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))[at]
    keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
    return np.where(keep >= 64, whole, whole & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether spans of equal length hold equal bytes."""
    same = np.ones(len(a), bool)
    at, open_rows = 0, np.arange(len(a))
    while len(open_rows):
        left = length[open_rows] - at
        equal = _load(data, a[open_rows] + at, left) == _load(data, b[open_rows] + at, left)
        same[open_rows[~equal]] = False
        at += 8
        open_rows = open_rows[equal & (left > 8)]
    return same


def _first_of_its_kind(data: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Spans that are the first to hold their bytes within their text.

    All spans try to enter an open-addressing table at once; of those that want an empty slot one gets it. A span whose slot
    holds the same text, digest, length and bytes is a repetition; any other one goes on to the next slot.
    """
    n = len(start)
    size = 1 << max(4, int(2 * n).bit_length())
    table = np.full(size, -1, np.int64)
    slot = ((digest >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    new = np.zeros(n, bool)
    waiting = np.arange(n)
    while len(waiting):
        wanted = slot[waiting]
        empty = table[wanted] < 0
        table[wanted[empty][::-1]] = waiting[empty][::-1]
        holder = table[wanted]
        own = holder == waiting
        new[waiting[own]] = True
        like = ~own & (digest[holder] == digest[waiting]) & (length[holder] == length[waiting]) & (text[holder] == text[waiting])
        rows = np.flatnonzero(like)
        like[rows] = _same_bytes(data, start[waiting[rows]], start[holder[rows]], length[waiting[rows]])
        waiting = waiting[~own & ~like]
        slot[waiting] = (slot[waiting] + 1) & (size - 1)
    return new


def _transduce(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text of neighbouring texts that end at `ends` in `data` (which has eight more bytes)."""
    texts, total = len(ends), int(ends[-1]) if len(ends) else 0
    starts_of_text = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    body = data[:total]
    state = np.empty(total + 1, np.uint8)  # before each byte, and after the last one
    state[0] = _BETWEEN
    state[1:] = _STATE_OF_BYTE[body]
    last = state[ends]  # before the next text resets it
    nonempty = ends > starts_of_text
    state[starts_of_text[nonempty]] = _BETWEEN
    out = _OUTPUT_OF_BYTE[state[:total], body]
    bounds = starts_of_text

    def per_text(bit: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum((out & bit) != 0)])
        return upto[ends] - upto[bounds]

    begin = np.flatnonzero(out & _STARTS)
    end = np.flatnonzero(out & _ENDS)
    open_at_end = ends[nonempty & (last == _INSIDE)]
    end = np.sort(np.concatenate([end, open_at_end]))
    words = per_text(_STARTS)
    text = np.repeat(np.arange(texts), words)
    powers = _powers(total, _BASE)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    digest = (prefix[end] - prefix[begin]) * _powers(total, pow(_BASE, -1, 1 << 64))[begin]
    digest ^= (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    digest = (digest ^ (digest >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    new = _first_of_its_kind(data, begin, end - begin, text, digest)
    return {
        "words": words,
        "distinct": np.bincount(text[new], minlength=texts),
        "capitals": per_text(_IS_CAPITAL),
        "points": per_text(_POINT),
        "symbols": per_text(_IS_SYMBOL),
    }


COUNTS = ("words", "distinct", "capitals", "points", "symbols")


def transduce(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of every text; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    found: dict[str, list[np.ndarray]] = {name: [] for name in COUNTS}
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        piece = np.zeros(int(offsets[b] - offsets[a]) + 8, np.uint8)
        piece[:-8] = raw[offsets[a] : offsets[b]]
        for name, values_of in _transduce(piece, offsets[a + 1 : b + 1] - offsets[a]).items():
            found[name].append(values_of)
        a = b
    return {name: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64) for name, parts in found.items()}


@arrow_udf(StructType([StructField(name, LongType()) for name in COUNTS]))
def _counts(texts: pa.Array) -> pa.Array:
    found = transduce(texts)
    return pa.StructArray.from_arrays([pa.array(found[name]) for name in COUNTS], list(COUNTS))


def failures(counts: Column, later_copy: Column) -> list[Column]:
    """The conditions of filters A to E."""
    return [
        counts["words"] < LEAST_WORDS,
        100 * counts["distinct"] < 50 * counts["words"],
        100 * counts["capitals"] > 2 * counts["points"],
        counts["symbols"] > 0,
        later_copy,
    ]


def failing_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per input row: part, fails (bit i: filter i), good, toxic.

    Texts are read once; then only digests and bits are shuffled. Rows without an identifier are neither
    later nor earlier copies and have no label, so they skip the joins.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    own = failures(F.col("c"), F.lit(False))
    bits = sum((F.coalesce(f, F.lit(False)).cast("int") * F.lit(1 << i) for i, f in enumerate(own)), F.lit(0))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        _counts(text).alias("c"),
    ).select("id", "part", "digest", bits.alias("fails"))
    narrow = materialize(narrow, "filter-bits")
    marks = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    named = narrow.where("id is not null")
    firsts = named.groupBy("digest").agg(F.min("id").alias("id"))
    # by identifier and digest, which is spread evenly: a text with many copies has one row in `firsts`
    firsts = firsts.withColumn("first", F.lit(True))
    joined = named.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    copy = F.col("first").isNull()
    flagged = joined.select(
        "part",
        (F.col("fails") + copy.cast("int") * F.lit(1 << FILTERS.index("E"))).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    nameless = narrow.where("id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return flagged.unionByName(nameless)


def _sum_over(values: Column, keep) -> Column:
    """Sum of those elements of an array (by set of failed filters) whose index passes `keep`."""
    terms = F.transform(values, lambda v, i: F.when(keep(i), v).otherwise(F.lit(0)))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, v: acc + v)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what the step's filter removes, finds removed already, or removes alone.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Counts are
    per row, so repeated rows count each; null texts are empty texts and null parts the empty part. A text is a later
    copy if a smaller identifier has the same text; rows with equal identifier and text are no copies of each other, and rows
    without identifier of none. Of several labels of a document any good and any toxic one counts. Without
    documents there are no parts and no rows.
    """
    n_sets = 1 << len(FILTERS)
    rows = failing_rows(docs, labels, id_col, text_col, part_col)

    def per_set(what: Column) -> Column:
        return F.array(*[F.count_if((F.col("fails") == s) & what) for s in range(n_sets)])

    counts = rows.groupBy("part").agg(per_set(F.lit(True)).alias("n"), per_set(F.col("good")).alias("good"), per_set(F.col("toxic")).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (
        counts.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("_letter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("_before", F.substring("filter_order", F.lit(1), F.col("step") - 1))
    )

    def bits(letters: Column) -> Column:
        return sum((F.when(F.instr(letters, name) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(FILTERS)), F.lit(0))

    steps = steps.withColumns({"_own": bits(F.col("_letter")), "_earlier": bits(F.col("_before"))})
    own, earlier = F.col("_own"), F.col("_earlier")

    def fails(i: Column, what: Column) -> Column:
        return i.bitwiseAND(what) != 0

    def removed_now(i: Column) -> Column:
        return fails(i, own) & ~fails(i, earlier)

    orders_won = F.array(*[F.lit(0 if not s else factorial(len(FILTERS)) // bin(s).count("1")) for s in range(n_sets)])
    weighted = F.zip_with("n", orders_won, lambda n, w: n * w)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        _sum_over(F.col("n"), lambda i: ~fails(i, own) & ~fails(i, earlier)).alias("kept"),
        _sum_over(F.col("n"), removed_now).alias("removed"),
        _sum_over(F.col("n"), lambda i: fails(i, own) & fails(i, earlier)).alias("redundant"),
        _sum_over(F.col("n"), lambda i: i == own).alias("unique_fails"),
        _sum_over(F.col("good"), removed_now).alias("good_lost"),
        _sum_over(F.col("toxic"), removed_now).alias("toxic_lost"),
        _sum_over(weighted, lambda i: fails(i, own)).alias("shapley"),
    )
