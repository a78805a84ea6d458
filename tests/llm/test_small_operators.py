"""Brute-force comparisons on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimspark.llm import bloom, bpe, compression, exact_dedup, mixing, url_filter
from claimspark.llm.queries import RULES, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "a  b\tc",
    "a b c",
    " a b c",
    "",
    None,
    " \n ",
    "x" * 200_000,
    "one two three four five\none two three four five\n\nsix # $ | <b>",
    "word " * 400,
    "\n".join(f"line {i} has its own words and number {i * 7919 % 1000}" for i in range(80)),
    "ÄÖ ÄÖ ÄÖ ÄÖ",
    "\u00a0 not ascii white space \u00a0",
]


def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(100 - i, t) for i, t in enumerate(TEXTS)]
    return out + [(3, ""), (7, TEXTS[7]), (None, "a b c"), (None, None)]


def frame(spark, data=None):
    data = rows() if data is None else data
    columns = "doc_id long, text string, source string, digest string, run int, key string, size int, rank double"
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 4}" if i != 2 else None, "d", 1, "k", 5, 0.5) for i, t in data], columns).repartition(5)


def test_runs_are_merged_without_moving_rows(spark):
    """However many rounds there are: one exchange for the distinct digests of the runs, one that deals them by range."""
    digests = exact_dedup.digest_table(spark.range(400).selectExpr("id as doc_id", "cast(id % 90 as string) as text"))
    for runs in (2, 5, 40):
        dealt = digests.withColumn("run", (F.col("row") % runs).cast("int"))
        merged = exact_dedup.merge_runs(dealt)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        rounds = int(np.ceil(np.log2(runs)))
        assert plan.count("Exchange ") == 2 and plan.count("Exchange rangepartitioning") == 1 and plan.count("SortAggregate(") >= rounds + 1
        assert merged.count() == 90 and merged.agg(F.sum("size")).first()[0] == 400
        assert {r["size"] for r in merged.where("keep_id < 40").collect()} == {5} and merged.where("keep_id >= 90").count() == 0


def test_exact_groups(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows():
        groups[norm(t)].append(i)
    for fan_in in (2, 8):
        got = exact_dedup.exact_groups(frame(spark), fan_in=fan_in).collect()
        assert len(got) == len(rows())
        per_text = defaultdict(list)
        for r in got:
            per_text[bytes(r.digest).hex()].append(r)
        for text, ids in groups.items():
            found = per_text[hashlib.sha256(text.encode()).hexdigest()]
            best = min(i for i in ids if i is not None)
            assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, ids))
            assert {(r.keep_id, r.group_size) for r in found} == {(best, len(ids))}
            assert [r.doc_id for r in found if r.kept] == [best]


def test_drop_exact_copies(spark):
    df = frame(spark)
    kept = exact_dedup.drop_exact_copies(df)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert kept.columns == df.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter({norm(t): 1 for _, t in rows()})
    assert exact_dedup.drop_exact_copies(frame(spark, []).limit(0)).collect() == []


def test_bloom_keeps_every_key(spark):
    listed = spark.range(3000).selectExpr("concat('k', id) as canonical")
    for blocks in (1, 16, 65_536):
        filter_ = bloom.build_filter(listed, blocks=blocks)
        assert bloom.possible_hits(listed, filter_, blocks=blocks).filter("not possible").count() == 0
    other = spark.range(20_000).selectExpr("concat('x', id) as canonical")
    assert bloom.possible_hits(other, bloom.build_filter(listed), "canonical").filter("possible").count() < 200
    with pytest.raises(ValueError):
        bloom.build_filter(listed, blocks=10**9)


URLS = [
    None,
    "",
    "no scheme/en/",
    "http://Example.COM/en/a?x=/fr/",
    "https://www.example.com/en/b#c",
    "https://a.b.example.com/en/",
    "http://net/fr/x",
    "http://a.net/es",
    "http://a.net/es/",
    "http://a.net/de/list",
    "http://A.net/de/list/",
    "https://www.a.net/de/list.html?utm=1",
    "http://com",
    "http://xcom/",
    "http://notexample.com/en/",
    "ftp://q://r/s",
    "http://ÄB.net/fr/",
    "http://a.net:80/fr/",
]


def test_url_filter(spark):
    def parts(url):
        at = (url or "").find("://")
        if at < 0:
            return "", ""
        rest = url[at + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), path

    def canonical(host, path):
        return re.sub(r"^www\.", "", host) + re.sub(r"(/+|\.html?)\Z", "", path)

    listed = ["http://a.net/de/list", "http://a.net/de/list", None, "", "x", "http://xcom/"]
    names = {canonical(*parts(u)) for u in listed} - {""}
    pages = spark.createDataFrame([(i, u, "h", "p", True) for i, u in enumerate(URLS + URLS)], "page_id int, url string, host string, path string, listed boolean")
    blocked = spark.createDataFrame([(u, "z") for u in listed], "url string, page_id string")
    for blocks in (1, 65_536):
        got = {r.page_id: r for r in url_filter.judge_urls(pages, blocked, RULES, blocks=blocks).collect()}
        assert len(got) == 2 * len(URLS)
        for i, url in enumerate(URLS + URLS):
            host, path = parts(url)
            fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            best = max(fits, key=lambda r: len(r.name), default=None)
            verdict = best.verdict if best else "block" if canonical(host, path) in names else "allow"
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best.name, verdict), url
    assert url_filter.judge_urls(pages.limit(0), blocked.limit(0), RULES).collect() == []


def test_compression_rules(spark):
    got = compression.compression_rules(frame(spark)).collect()
    assert len(got) == len(rows())
    facts = {}
    for text in set(TEXTS):
        t = text or ""
        words, lines = WORD.findall(t), t.split("\n")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        dup = sum(bool(WORD.search(line)) and line in lines[:k] for k, line in enumerate(lines))
        base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        facts[t] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), base)
    want = Counter(facts[t or ""] for _, t in rows())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.kept and (r.base_failed or r.band_failed)) for r in got)


def made_prose(rng, n, words=20_000):
    """Words of a vocabulary as rich as that of ordinary text; the ratio is that of labelled good rows."""
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(words)]
    weight = 1 / np.arange(1, words + 1) ** 0.6
    return " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))


def test_compression_verdict_recomputed(spark):
    """Every column of the method from its definition, over texts of all kinds and lengths."""
    rng, random_ = np.random.default_rng(5), random.Random(5)
    texts = [made_prose(rng, n, 3000)[: random_.randrange(1, 9000)] for n in (20, 90, 400, 1500, 1500)]
    texts += [base64.encodebytes(rng.bytes(n)).decode() for n in (200, 3000)] + ["ab " * n for n in (40, 60, 3000)]
    texts += ["".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 20_000, n)) for n in (60, 1000, 5000)] + ["漢字 " * 800, "é" * 3000, None, ""]
    texts += [texts[2] + " " + texts[6], texts[3] + "漢字" * 700]
    compressor = zstandard.ZstdCompressor(level=3)

    def limits(raw, size):
        bands = compression.OTHER_SCRIPTS if 3 * sum(b > 127 for b in raw) > len(raw) else compression.BANDS
        return max((b for b in bands if b.least_bytes <= size), key=lambda b: b.least_bytes)

    for r in compression.compression_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        raw = (texts[r.doc_id] or "").encode()
        ratios = [(len(compressor.compress(raw[i : i + 2048])) / len(raw[i : i + 2048]), len(raw[i : i + 2048])) for i in range(0, len(raw), 2048)]
        low = [n for x, n in ratios if x < limits(raw, n).low]
        high = [n for x, n in ratios if x > limits(raw, n).high]
        whole = len(compressor.compress(raw)) / len(raw) if raw else 0.0
        bad = sum(low + high) / len(raw) if raw else 0.0
        failed = bool(raw) and (not limits(raw, len(raw)).low <= whole <= limits(raw, len(raw)).high or bad > 0.5)
        assert (r.n_chunks, r.low_chunks, r.high_chunks, r.band_failed, r.kept) == (len(ratios), len(low), len(high), failed, not failed and not r.base_failed), r
        assert r.zstd_ratio == pytest.approx(whole) and r.bad_chunk_share == pytest.approx(bad)


def test_compression_bands_reject_bad_rows_that_the_base_rule_keeps(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    judged = compression.compression_rules(docs).where("not base_failed").join(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), "doc_id")
    found = {(r["quality"], r["band_failed"]): r["count"] for r in judged.groupBy("quality", "band_failed").count().collect()}
    good = found.get((1, True), 0) / max(1, found.get((1, True), 0) + found.get((1, False), 0))
    bad = found.get((0, True), 0) / max(1, found.get((0, True), 0) + found.get((0, False), 0))
    assert good <= 0.01 and bad >= 0.2, found


def test_compression_bands_catch_repetition_and_noise():
    compressor = zstandard.ZstdCompressor(level=3)
    rng = np.random.default_rng(1)
    prose = made_prose(rng, 900)
    noise = " ".join(bytes(rng.integers(33, 127, 20, dtype=np.uint8)).decode() for _ in range(300))
    distinct = " ".join(f"{a}{b}" for a in "abcdefghij" for b in range(100))
    fails = lambda t: compression.judge(t, compressor, compression.BANDS, compression.CHUNK_BYTES, compression.BAD_CHUNK_SHARE)[-1]
    assert not fails(prose)
    assert fails(noise) and fails("the same thing " * 300)
    assert compression.judge("", compressor, compression.BANDS, 2048, 0.5)[-1] is False
    assert isinstance(fails(distinct), bool)


def test_compression_bands_catch_base64_and_keys():
    compressor, rng = zstandard.ZstdCompressor(level=3), np.random.default_rng(3)
    judged = lambda t: dict(zip([p.split()[0] for p in compression.RESULT.split(", ")], compression.judge(t, compressor, compression.BANDS, compression.CHUNK_BYTES, compression.BAD_CHUNK_SHARE)))
    for size in (256, 400, 600, 1200, 2048, 3200, 9000, 16_500, 70_000):
        block = base64.encodebytes(rng.bytes(size)).decode()[:size]
        keys = " ".join(bytes(rng.integers(33, 127, 20, dtype=np.uint8)).decode() for _ in range(size // 20))[:size]
        assert judged(block)["band_failed"] and judged(keys)["band_failed"], size
    assert judged(block)["high_chunks"] == judged(block)["n_chunks"]
    prose = lambda n: made_prose(rng, n)
    for n in (120, 300, 700, 3000, 15_000):
        assert not judged(prose(n))["band_failed"], n
    mixed = judged(prose(900)[:4096] + base64.encodebytes(rng.bytes(5000)).decode()[:6144])
    assert mixed["high_chunks"] == 3 and mixed["n_chunks"] == 5 and mixed["band_failed"]


BPE_TEXTS = TEXTS + [
    "Hello  World's café 12345 <|endoftext|> x<|startoftext|>y İSTANBUL ΑΣ ퟿ é",
    "don't DON'T I'LL ½²³Ⅷ \x85 \x1c\x1d ﬁ ß ẞ 𝕏 ‿ ÅÅ",
    "'s't're'" * 30,
    "abcdefghijklmnopqrstuvwxyz" * 40,
    "the" * 500,
    "\u200b\ufeff\u0301 _a_b_ 1a2b",
]


def test_bpe_matches_the_library(spark):
    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(BPE_TEXTS)], "doc_id long, text string, ids array<int>")
    full = {r.doc_id: r for r in bpe.encode_documents(df, path).collect()}
    short = {r.doc_id: r for r in bpe.encode_documents(df, path, digests=True).collect()}
    for i, text in enumerate(BPE_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert full[i].ids == ids and full[i].decoded == decoded, repr(text)[:80]
        assert short[i].n_tokens == len(ids)
        assert short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_on_random_words():
    vocabulary, library = bpe.vocabulary(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    rng = np.random.default_rng(3)
    for _ in range(1500):
        text = "".join(rng.choice(list("aabeehtinogr's "), rng.integers(1, 40)))
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def sources():
    rng = np.random.default_rng(7)
    data, i = [], 0
    for source, n in (("b", 400), ("a", 60), (None, 30), ("c", 5), ("zero", 2)):
        for _ in range(n):
            words = int(rng.integers(1, 60)) if source != "zero" else 0
            data.append((i, " ".join(["w"] * words) if words else None, source, "x", 9))
            i += 1
    data.append((i, " ".join(["w"] * 900), "a", "x", 9))
    return data


def test_mix_meets_targets(spark):
    data = sources()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, rank string, target int")
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(data)
    sizes = defaultdict(int)
    for _, t, s, *_ in data:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        free -= above
    taken = defaultdict(int)
    longest = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1, s
        whole = int(target[s] / sizes[s]) if sizes[s] else 0
        assert all(r.copies in (whole, whole + 1) for r in got if r.source == s and r.size)
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).collect() == [] and mixing.take_mix(df).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix_sources(blank).collect()} == {(0, 0.0, 0)}


def test_pareto_order_prefers_higher_inclusion_odds(spark):
    data = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "a") for i in range(2000)] + [(9000 + i, " ".join(["w"] * 100), "b") for i in range(2000)]
    got = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).filter("source = 'b' or source = 'a'").collect()
    rate = lambda size: np.mean([r.copies for r in got if r.source == "a" and r.size == size])
    assert rate(64) > rate(4)
