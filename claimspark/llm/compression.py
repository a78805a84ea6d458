"""Quality rules from zstandard ratios: repetitive or incompressible text leaves its band.

A ratio is compressed by raw bytes, of the whole document and of each fixed chunk. The
limits depend on the length, because a compressor has little to refer to in short text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimspark.llm.common import WORD, bounded_batches

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_HAS_WORD = re.compile(WORD)
_ASCII = bytes(range(128))


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least `least_bytes` bytes."""

    least_bytes: int
    low: float
    high: float


#: Lower limits from the labelled training rows that pass the base rule (24,000 good and 1,800 bad ones of the test tables, in four
#: languages of Latin script) at level 3: the lowest ratio of good rows less about 0.005 from 256 bytes on. Bad rows are more repetitive:
#: their median lies below the limit from 1,024 bytes on. Upper limits lie between the highest ratio of good rows and that of base64: 0.74
#: and 0.92-0.85 from 256 bytes on, 0.68 and 0.84-0.80 from 512, 0.60 and 0.80-0.77 from 1 kB, 0.55 and 0.77 from 2 kB, 0.51 and 0.76 from 4 kB,
#: 0.44 and 0.76 from 16 kB; English technical prose measures 0.59, 0.54, 0.51 and 0.46 at 2, 4, 8 and 16 kB. Hexadecimal digits (0.51-0.54 from
#: 2 kB on) compress like prose and can't be told by a ratio. No labelled row is below 256 bytes, and no good one above 64 kB: there the limits are
#: carried on, with room.
BANDS = (
    Band(0, 0.0, 1.5),
    Band(128, 0.22, 0.98),
    Band(192, 0.22, 0.92),
    Band(256, 0.52, 0.86),
    Band(384, 0.525, 0.82),
    Band(512, 0.51, 0.76),
    Band(768, 0.49, 0.76),
    Band(1024, 0.472, 0.68),
    Band(1536, 0.458, 0.68),
    Band(2048, 0.45, 0.62),
    Band(3072, 0.442, 0.62),
    Band(4096, 0.43, 0.58),
    Band(6144, 0.42, 0.58),
    Band(8192, 0.412, 0.58),
    Band(12288, 0.408, 0.58),
    Band(16384, 0.397, 0.56),
    Band(32768, 0.387, 0.56),
    Band(65536, 0.355, 0.54),
)
#: For texts of which more than a third of the bytes are no ASCII: no labelled row is in such a script, so only clear repetition fails.
OTHER_SCRIPTS = (Band(0, 0.0, 1.5), Band(256, 0.12, 1.2), Band(4096, 0.10, 1.1), Band(65536, 0.08, 1.05))
CHUNK_BYTES = 2048
#: A document fails if chunks with more than this share of its bytes are outside their band.
BAD_CHUNK_SHARE = 0.5
LEVEL = 3

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, zstd_ratio double, n_chunks long, low_chunks long, high_chunks long, bad_chunk_share double, band_failed boolean"
)


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text holds twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*[words[i:] for i in range(width)]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    seen, count = set(), 0
    for line in lines:
        if line in seen:
            count += 1
        elif _HAS_WORD.search(line):
            seen.add(line)
    return count


def band_of(bands: tuple[Band, ...], n_bytes: int) -> Band:
    best = bands[0]
    for band in bands:
        if n_bytes >= band.least_bytes:
            best = band
    return best


def judge(text: str, compressor, bands: tuple[Band, ...], chunk_bytes: int, bad_share: float, other_scripts: tuple[Band, ...] = OTHER_SCRIPTS) -> tuple:
    """The row of `RESULT` for one whole text."""
    words = _WORDS.findall(text)
    n, repeats = len(words), repeated_words(words)
    base = n < 50 or 100 * repeats > 50 * n
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    if not raw.isascii() and 3 * len(raw.translate(None, _ASCII)) > size:
        bands = other_scripts
    ratio = len(compressor.compress(raw)) / size if size else 0.0
    whole = band_of(bands, size)
    chunks = low = high = bad_bytes = 0
    for start in range(0, size, chunk_bytes):
        part = raw[start : start + chunk_bytes]
        share = len(compressor.compress(part)) / len(part)
        band = band_of(bands, len(part))
        chunks += 1
        low += share < band.low
        high += share > band.high
        if not band.low <= share <= band.high:
            bad_bytes += len(part)
    bad = bad_bytes / size if size else 0.0
    failed = bool(size) and (not whole.low <= ratio <= whole.high or bad > bad_share)
    return (
        n,
        sum(map(len, words)),
        len(_SYMBOLS.findall(text)),
        duplicate_lines(text),
        repeats,
        base,
        not base and not failed,
        ratio,
        chunks,
        low,
        high,
        bad,
        failed,
    )


def compression_columns(text: Column, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_CHUNK_SHARE, level: int = LEVEL) -> Column:
    """A struct of `RESULT` for a text column; null counts as the empty text."""
    names = [part.split()[0] for part in RESULT.split(", ")]

    @pandas_udf(RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=level)
        return pd.DataFrame([judge(t or "", compressor, bands, chunk_bytes, bad_share) for t in texts], columns=names)

    return judged(text)


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: id_col, the counts, base_failed, kept and the ratios behind it.

    Empty and null texts have no words and fail the base rule. Repeated rows are judged each
    on their own. Other input columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    judged = narrow.select(F.col("id").alias(id_col), compression_columns(F.col("text"), **settings).alias("r"))
    return judged.select(id_col, "r.*")
