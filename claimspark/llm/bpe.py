"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

Greedy longest matches, taken back where two neighbours could not stand side by side, give
the same tokens as applying the merges by rank, in time linear in the word. Two tokens are
compatible if no merge of lower rank would have crossed their border; answers are kept in a
table as they are found. Both tables are built once per Python worker from the vocabulary
file, whose path is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimspark.llm.common import bounded_batches

#: Words whose tokens a worker remembers: the newer half, and the half before it, from which words in use are taken over.
WORD_CACHE = 300_000
#: Slots of the table of compatible pairs (a power of two): 8 bytes each, and a later pair replaces an earlier one.
PAIR_SLOTS = 1 << 20
#: White space of the vocabulary's patterns: the Unicode property, without the separators 1C to 1F.
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


class WordTokens(dict):
    """Tokens of the words met so far; a missing word is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        tokens = self.older.get(word) or array("I", self.encode(word)).tobytes()
        if len(word) <= 64:
            if len(self) >= WORD_CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[word] = tokens
        return tokens


@functools.cache
def word_patterns() -> tuple[frozenset, re.Pattern, re.Pattern]:
    """The vocabulary's split into contractions, letters, single digits and other signs.

    Python's own classes count numerals such as one half or roman eight as word characters. The set
    holds them, the first pattern is for texts without, the second for texts with.
    """
    rare = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("Nl", "No")]
    ranges, start = [], None
    for c, after in zip(rare, [*rare[1:], -1]):
        start = c if start is None else start
        if after != c + 1:
            ranges.append(f"\\U{start:08X}-\\U{c:08X}")
            start = None
    rare_class, short = "".join(ranges), "'(?:s|t|re|ve|m|ll|d)"
    other = rf"(?:[^\w{_SPACE}]|_)+"
    return (
        frozenset(map(chr, rare)),
        re.compile(rf"[^\W\d_]+|\d|{short}|{other}"),
        re.compile(rf"[^\W\d_{rare_class}]+|\d|[{rare_class}]|{short}|{other}"),
    )


class Vocabulary:
    """Merges, split points, matches and the decoding table of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab, letters = model["vocab"], byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_hint = os.path.commonprefix(sorted(special)) if special else ""
        self.rare, self.words, self.words_exact = word_patterns()
        # One symbol per byte, and one per byte at the end of a word: strings in which a merge is plain concatenation.
        symbol = {letters[b]: letters[b] for b in range(256)} | {letters[b] + self.end: chr(0x1000 + b) for b in range(256)}
        self.last = [chr(0x1000 + b) for b in range(256)]
        self.letters = letters
        spelled = {name: symbol[name] for name in symbol if name in vocab}
        self.rank: dict[int, int] = {vocab[name]: -1 for name in spelled}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            name, pair = left + right, (vocab[left], vocab[right])
            self.merged.setdefault(pair, vocab[name])
            if vocab[name] not in self.rank:
                self.rank[vocab[name]], self.parts[vocab[name]] = rank, pair
                spelled[name] = spelled[left] + spelled[right]
        self.fits = array("q", bytes(8 * PAIR_SLOTS))
        self.string = {vocab[name]: s for name, s in spelled.items()}
        self.length = {token: len(s) for token, s in self.string.items()}
        # A token that its own merges can't reach never appears.
        reachable = {s: t for t, s in self.string.items() if t not in self.parts or self.compatible(*self.parts[t], under=self.rank[t])}
        self.matches = ahocorasick.Automaton()
        for s, token in reachable.items():
            self.matches.add_word(s, (len(s), token))
        self.matches.make_automaton()
        self.shorter = {token: next((reachable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in reachable), None) for s, token in reachable.items()}
        names = {i: name for name, i in vocab.items()} | {i: name for name, i in special.items()}
        pieces = [names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        self.cache = WordTokens(self.encode_word)

    def compatible(self, left: int, right: int, under: int | None = None) -> bool:
        """Whether merging by rank leaves `left` and `right` apart when they stand side by side.

        Walks back through the merges along the border, the latest first: a pair of pieces that
        meets there would have merged if its rank came before the merges that used the pieces up.
        `under` only looks at merges of a lower rank: whether the two parts of a token get made.
        """
        key = left << 32 | right
        slot = (left * 648_881 + right) & (PAIR_SLOTS - 1)
        if under is None:
            # a slot holds the pair, a bit that marks it as filled, and the answer
            known = self.fits[slot]
            if known >> 1 == key << 1 | 1:
                return known & 1 == 1
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = float("inf") if under is None else under
        a, b, answer = left, right, True
        while True:
            whole = merged.get((a, b))
            if whole is not None and rank[whole] < limit:
                answer = False
                break
            # Undo the later of the two merges; on the right side it also wins a tie, as pairs are merged from the left.
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[a] > rank[b]:
                limit = min(limit, rank[a])
                a = parts[a][1]
            else:
                limit = min(limit, rank[b] + 1)
                b = parts[b][0]
        if under is None:
            self.fits[slot] = key << 2 | 2 | answer
        return answer

    def encode_symbols(self, text: str) -> list[int]:
        """Tokens of one word, given as symbols."""
        n = len(text)
        longest: list[int | None] = [None] * n
        best = [0] * n
        for end, (size, token) in self.matches.iter(text):
            start = end - size + 1
            if size > best[start]:
                best[start], longest[start] = size, token
        if best[0] == n:
            return [longest[0]]
        open_at = bytearray(b"\x01" * (n + 1))
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            size = self.length[token]
            if open_at[at + size] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at += size
                if at == n:
                    return tokens
                token = longest[at]
                continue
            token = self.shorter[token]
            while token is None:
                # Nothing fits here: close the position and shorten the token before it.
                open_at[at] = 0
                back = tokens.pop()
                at -= self.length[back]
                token = self.shorter[back]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        letters = self.letters
        return self.encode_symbols("".join([letters[b] for b in raw[:-1]]) + self.last[raw[-1]])

    def normalize(self, text: str) -> str:
        """NFC and lower case, letter by letter: a final sigma has no form of its own."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def words_of(self, text: str) -> list[str]:
        if not text.isascii() and not self.rare.isdisjoint(text):
            return self.words_exact.findall(text)
        return self.words.findall(text)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        known, special = self.cache.__getitem__, self.special
        if not (self.special_split and self.special_hint in text):
            return b"".join(map(known, self.words_of(self.normalize(text))))
        out = []
        for piece in self.special_split.split(text):
            if piece in special:
                out.append(special[piece].to_bytes(4, "little"))
            else:
                out += map(known, self.words_of(self.normalize(piece)))
        return b"".join(out)

    def decode(self, ids: np.ndarray, block: int = 100_000) -> bytes:
        """The tokens' names with one space between, in UTF-8, gathered from the offset table."""
        out = []
        for start in range(0, len(ids), block):
            part = np.asarray(ids[start : start + block], np.int64)
            begin = self.offsets[part]
            size = self.offsets[part + 1] - begin
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
            out.append(self.blob[index].tobytes())
        return b"".join(out)[:-1]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


RESULT = "ids array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_column(text: Column, path: str) -> Column:
    """A struct of `RESULT`: the token ids and what they decode to. Null counts as empty."""

    @pandas_udf(RESULT)
    def encoded(texts: pd.Series) -> pd.DataFrame:
        vocab, rows = vocabulary(path), []
        for text in texts:
            ids = np.frombuffer(vocab.encode(text or ""), "<u4")
            rows.append((ids.astype(np.int32), vocab.decode(ids).decode("utf-8")))
        return pd.DataFrame(rows, columns=["ids", "decoded"])

    return encoded(text)


def digest_column(text: Column, path: str) -> Column:
    """A struct of `DIGESTS` of the same round trip, made where the ids are, so that they need not be moved."""

    @pandas_udf(DIGESTS)
    def digested(texts: pd.Series) -> pd.DataFrame:
        vocab, rows = vocabulary(path), []
        for text in texts:
            raw = vocab.encode(text or "")
            decoded = vocab.decode(np.frombuffer(raw, "<u4"))
            rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digested(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: id_col with ids and decoded, or with their digests.

    Null and empty texts have no tokens and decode to the empty text. Repeated rows are
    encoded each; other input columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    column = digest_column(F.col("text"), path) if digests else encode_column(F.col("text"), path)
    return narrow.select(F.col("id").alias(id_col), column.alias("r")).select(id_col, "r.*")
