"""Near-duplicates by ProbMinHash, banding and exact verification.

Shingles are runs of five words, weighted by how often a text holds them. Each shingle is a
Poisson process whose rate is its weight: exponential arrivals fall on random signature slots,
and a slot keeps the shingle that arrives first. A process ends as soon as it is later than the
latest slot. Two signatures agree in a slot with the probability Jaccard similarity of the texts.

`BANDS` bands of `ROWS` slots propose pairs: one of similarity 0.8 is missed with a chance of
(1 - 0.8^4)^20 = 3e-5. Pairs are then verified on the full weighted sets.

Large groups rarely become all pairs. Texts with equal weighted sets are one node. In a bucket every
node is paired with one hub, first with the smallest of all its buckets alone, which connects most
large groups; later pairs only count if their nodes are in two components. What is left are buckets whose
nodes beside the hub lie in several components: there every pair of two components is compared, in the first band
that the pair shares, by tasks of two blocks of nodes each. So every pair that shares a band and isn't in
one component by then is compared, however many third texts share the bucket; texts that share a long
passage without being near cost the square of their number, of a few bytes a comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimspark.llm.bloom import build_filter, drop_listed, possible_hits
from claimspark.llm.common import WORD, bounded_batches, chunks, materialize, merged, text_of
from claimspark.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 4
BANDS = 20
SLOTS = ROWS * BANDS
#: Shingles in a block of nodes, with `NODE` more for each node's signature and objects; a task holds two blocks.
BLOCK = 200_000
NODE = 64
#: Characters of neighbouring texts that are made to shingles together.
PIECE = 400_000
#: Equal slots that a pair of similarity 0.8 reaches but for a chance of 3e-7 (five standard deviations).
LEAST_SLOTS = 46
_WORD = re.compile(WORD)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Result types of the functions of the same names.
_SKETCH = "n int, set_key binary, slots binary, bands array<long>"
_SETS = "set_key binary, shingles binary"
_EQUAL_SLOTS = "int"
_VERIFY = "double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        if len(self) >= 60_000:
            self.clear()
        self[word] = value
        return value


_HASHES = _WordHash()


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and their counts of each text; a text of fewer words is one shingle, one without words none."""
    known, factor, out = _HASHES.__getitem__, np.uint64(0x100000001B3), []
    for text in texts:
        words = _WORD.findall(text)
        if not words:
            out.append((np.zeros(0, np.uint64), np.zeros(0)))
            continue
        if len(words) < width:
            words = [*words, *[""] * (width - len(words))]
        h = np.fromiter(map(known, words), np.uint64, len(words))
        n = len(h) - width + 1
        s = h[:n].copy()
        for i in range(1, width):
            s *= factor
            s ^= h[i : n + i]
            s ^= s >> np.uint64(29)
        s = np.sort(_mix(s))
        first = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.flatnonzero(first)
        out.append((s[at], np.diff(np.append(at, n)).astype(np.float64)))
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: per set and slot the 32-bit tag of the shingle that arrives first."""
    sizes = [len(s) for s, _ in sets]
    best = np.full(len(sets) * slots, np.inf)
    element = np.concatenate([s for s, _ in sets] or [np.zeros(0, np.uint64)])
    rate = np.concatenate([w for _, w in sets] or [np.zeros(0)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tag = (element >> np.uint64(32)).astype(np.uint32)
    time = np.zeros(len(element))
    arrivals, step = [], 0
    while len(element):
        step += 1
        x = _mix(element + np.uint64((int(_GOLDEN) * step) % 2**64))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        place = owner * slots + (_mix(x) % np.uint64(slots)).astype(np.int64)
        better = time < best[place]
        np.minimum.at(best, place[better], time[better])
        arrivals.append((place[better], time[better], tag[better]))
        latest = best.reshape(-1, slots).max(1)
        going = time < latest[owner]
        element, rate, owner, tag, time = element[going], rate[going], owner[going], tag[going], time[going]
    out = np.zeros(len(sets) * slots, np.uint32)
    for place, when, who in reversed(arrivals):
        first = when == best[place]
        out[place[first]] = who[first]
    return out.reshape(-1, slots)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets; the plain one if all weights are equal."""
    place = np.minimum(np.searchsorted(b, a), len(b) - 1) if len(b) else np.zeros(0, int)
    at = np.flatnonzero(b[place] == a) if len(b) else place
    if not len(at):
        return 0.0
    bt = place[at]
    if wa.max() == wb.max() == 1:
        return len(at) / (len(a) + len(b) - len(at))
    ratio = wa[at] / wb[bt]
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], wa[at][order], wb[bt][order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    upto = np.cumsum(y)
    beyond = x.sum() - np.cumsum(x)
    # For shingle i: sum over d of max(wa_d, ratio_i * wb_d), as a share of its own weight.
    whole = only_a + beyond + ratio * (only_b + upto)
    return float((x / whole).sum())


def _pack(elements: np.ndarray, counts: np.ndarray) -> bytes:
    """The set as 32-bit tags with their counts (equal tags within a text are added up)."""
    tags, where = np.unique((elements >> np.uint64(32)).astype("<u4"), return_inverse=True)
    weights = np.bincount(where, counts, len(tags))
    odd = np.flatnonzero(weights != 1)
    return np.uint32(len(tags)).tobytes() + tags.tobytes() + odd.astype("<u4").tobytes() + weights[odd].astype("<u4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(raw, "<u4")
    n = int(whole[0])
    odd, weights = whole[1 + n :].reshape(2, -1)
    counts = np.ones(n)
    counts[odd] = weights
    return whole[1 : 1 + n], counts


def _set_key(elements: np.ndarray, counts: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes() + counts.tobytes())


def _sketch(texts: pd.Series) -> pd.DataFrame:
    texts, rows = list(texts), []
    for a, b in chunks(texts, PIECE):
        sets = shingle_sets(texts[a:b])
        marks = signatures(sets)
        wide = marks.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLDEN, wide.shape[:2]).copy()
        for i in range(ROWS):
            key = _mix(key ^ wide[:, :, i]) + _GOLDEN
        key = key.view(np.int64)
        short = _mix(marks.astype(np.uint64)).astype(np.uint8)
        rows += [(len(s), _set_key(s, w), short[i].tobytes(), key[i]) for i, (s, w) in enumerate(sets)]
    return pd.DataFrame(rows, columns=["n", "set_key", "slots", "bands"])


def _sets(texts: pd.Series) -> pd.DataFrame:
    texts, rows = list(texts), []
    for a, b in chunks(texts, PIECE):
        rows += [(_set_key(s, w), _pack(s, w)) for s, w in shingle_sets(texts[a:b])]
    return pd.DataFrame(rows, columns=["set_key", "shingles"])


def _equal_slots(left: pd.Series, right: pd.Series) -> pd.Series:
    if not len(left):
        return pd.Series([], dtype="int32")
    x = np.frombuffer(b"".join(left), np.uint8).reshape(-1, SLOTS)
    y = np.frombuffer(b"".join(right), np.uint8).reshape(-1, SLOTS)
    return pd.Series((x == y).sum(1).astype(np.int32))


def _verify(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(*_unpack(a), *_unpack(b)) for a, b in zip(left, right)], dtype="float64")


def _with_roots(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, node, ...) with the component of the node and of the hub so far."""
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    both = merged(merged(buckets, roots, "node", "left"), hub_roots, "hub", "left")
    return both.withColumns({"root": F.coalesce("root", "node"), "hub_root": F.coalesce("hub_root", "hub")})


def _pairs(rooted: DataFrame) -> DataFrame:
    """Pairs of a node and its bucket's hub from `_with_roots`, if they are in two components."""
    return rooted.filter("root != hub_root").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _with_hub(rows: DataFrame, hub) -> DataFrame:
    """Rows (bucket, node, ...) of buckets with several nodes, with size and hub."""
    groups = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), hub.alias("hub")).filter("size > 1")
    return merged(rows, groups, "bucket")


class _Verifier:
    """Verified links of proposed pairs. Shingle sets are made in one pass over the texts, for the nodes of `buckets`, and kept."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, buckets: DataFrame, threshold: float):
        self.texts, self.nodes, self.buckets, self.threshold = texts, nodes, buckets, threshold
        self._sets: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """Rows (a, b) of at least the threshold; None if the signatures leave no pair to look at."""
        left = self.nodes.select(F.col("node").alias("a"), F.col("slots").alias("left"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("slots").alias("right"))
        close = merged(merged(pairs, left, "a"), right, "b").filter(pandas_udf(_equal_slots, _EQUAL_SLOTS)("left", "right") >= LEAST_SLOTS)
        close = materialize(close.select("a", "b"), "close-pairs")
        if not close.limit(1).count():
            return None
        sets = self.sets()
        both = merged(close, sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        both = merged(both, sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        return materialize(both.filter(pandas_udf(_verify, _VERIFY)("left", "right") >= self.threshold).select("a", "b"), "links")

    def sets(self) -> DataFrame:
        """(node, shingles) of every node that shares a bucket."""
        if self._sets is None:
            shared = self.buckets.select("node").distinct()
            wanted = materialize(merged(self.nodes, shared, "node", "left_semi").select("node", "set_key", F.col("id_text").alias("key")), "wanted")
            # Texts that the filter holds back are certain not to be asked for.
            some = possible_hits(self.texts, build_filter(wanted, "key"), "key").filter("possible")
            # Not deterministic in name, so that no test of its result moves below the filter and runs it on every text.
            made = some.select(pandas_udf(_sets, _SETS).asNondeterministic()("text").alias("s")).select("s.*")
            sets = merged(made, wanted.select("node", "set_key"), "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))
            self._sets = materialize(sets, "shingle-sets")
        return self._sets

    def leftover_links(self, buckets: DataFrame, roots: DataFrame) -> DataFrame | None:
        """Links among the nodes beside the hub of buckets that still hold several components; None if there are no such buckets."""
        rows = _with_roots(buckets.filter("node != hub and size > 2"), roots).select("bucket", "band", "node", "root")
        mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
        rows = materialize(merged(merged(rows, mixed, "bucket"), self.nodes.select("node", "n"), "node"), "mixed-buckets")
        if not rows.limit(1).count():
            return None
        wide = merged(merged(self.nodes.select("node", "slots", "bands"), rows.select("node").distinct(), "node", "left_semi"), self.sets(), "node")
        tasks = merged(_tasks(rows), wide, "node").repartition("task").sortWithinPartitions("task", "side")
        return materialize(tasks.mapInPandas(_task_links(self.threshold), "a long, b long").distinct(), "links")


def _tasks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (task, side, band, node, root): the nodes of every two blocks of a bucket that may hold two components.

    A component of more than `block` shingles has blocks of its own, which needn't meet each other; the rest share blocks.
    """
    parts = rows.groupBy("bucket", "root").agg(F.sum(F.col("n") + NODE).alias("weight"))
    parts = parts.withColumn("own", F.when(F.col("weight") > block, F.col("root")).otherwise(F.lit(-1).cast("long")))
    sizes = parts.groupBy("bucket", "own").agg(F.ceil(F.sum("weight") / block).cast("int").alias("parts"))
    each = sizes.select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = each.groupBy("bucket").agg(F.collect_list(F.struct("own", "part")).alias("others"))
    placed = merged(merged(merged(rows, parts.select("bucket", "root", "own"), ["bucket", "root"]), sizes, ["bucket", "own"]), others, "bucket")
    placed = placed.withColumn("mine", F.struct("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    apart = F.filter("others", lambda o: (o["own"] != F.col("own")) | (F.col("own") == -1))
    met = placed.select("bucket", "band", "node", "root", "mine", F.explode(apart).alias("other"))
    task = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    return met.select(task.alias("task"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "band", "node", "root")


def _compared(band: int, side: np.ndarray, node: np.ndarray, root: np.ndarray, slots: np.ndarray, bands: np.ndarray, packed: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of one task, enough to connect its components: pairs of both sides, or of all nodes if there is one side."""
    n = len(node)
    beyond = int(np.searchsorted(side, 1))
    one_side = beyond in (0, n)
    label = np.unique(root, return_inverse=True)[1]
    if label.max() == 0:
        return []
    marks = np.frombuffer(b"".join(slots), np.uint8).reshape(-1, SLOTS)
    earlier = np.stack(bands)[:, :band]
    sets, places, member, links = [], [], None, []
    for i in range(n if one_side else beyond):
        start = i + 1 if one_side else beyond
        at = start + np.flatnonzero(label[start:] != label[i])
        at = at[(marks[at] == marks[i]).sum(1) >= LEAST_SLOTS]
        at = at[~(earlier[at] == earlier[i]).any(1)]
        if not len(at):
            continue
        if member is None:
            sets = [_unpack(raw) for raw in packed]
            values, place = np.unique(np.concatenate([tags for tags, _ in sets]), return_inverse=True)
            places = np.split(place, np.cumsum([len(tags) for tags, _ in sets])[:-1])
            plain = np.array([counts.max() == 1 for _, counts in sets])
            lengths = np.array([len(tags) for tags, _ in sets])
            member = np.zeros(len(values), bool)
        near = np.zeros(len(at), bool)
        easy = plain[at] & plain[i]
        if easy.any():
            some = at[easy]
            member[places[i]] = True
            common = np.add.reduceat(member[np.concatenate([places[j] for j in some])], np.cumsum(lengths[some]) - lengths[some], dtype=np.int64)
            member[places[i]] = False
            near[easy] = common / (lengths[i] + lengths[some] - common) >= threshold
        for k in np.flatnonzero(~easy):
            near[k] = similarity(*sets[i], *sets[at[k]]) >= threshold
        for j in at[near]:
            if label[j] != label[i]:
                links.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
                label[label == label[j]] = label[i]
    return links


def _task_links(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = ["side", "node", "root", "slots", "bands", "shingles"]

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, band, links = [], None, 0, []

        def finished() -> list[tuple[int, int]]:
            return _compared(band, *[np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*held)], threshold) if held else []

        for frame in frames:
            tasks, columns = frame["task"].to_numpy(), [frame[c].to_numpy() for c in names]
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1), len(tasks)] if len(tasks) else []
            for a, b in zip(cuts, cuts[1:]):
                if tasks[a] != now:
                    links += finished()
                    held, now, band = [], tasks[a], int(frame["band"].iat[a])
                held.append([c[a:b] for c in columns])
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
            links = []
        yield pd.DataFrame(finished(), columns=["a", "b"], dtype="int64")

    return linked


def _grown(links: DataFrame, more: DataFrame | None) -> DataFrame:
    return links if more is None else materialize(links.unionByName(more), "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, class_id, class_size, kept.

    Classes are the connected components of texts with a probability Jaccard of at least
    `threshold`; copies belong to the class of their text. class_id is the smallest
    identifier of the class.
    The first row of the class with that identifier is kept (nulls come last). A null, an
    empty text or one without words is near to nothing and a class of its own. Ties and
    repeated rows are copies. Other input columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    texts = texts.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    sketch = texts.select("id", F.col("key").alias("id_text"), F.monotonically_increasing_id().alias("row"), pandas_udf(_sketch, _SKETCH)("text").alias("s"))
    sketch = materialize(sketch.select("id", "id_text", "row", "s.*"), "sketches")
    worded = sketch.filter("n > 0")
    owners = materialize(worded.groupBy("set_key").agg(F.min("row").alias("node")), "nodes")
    nodes = merged(worded.withColumnRenamed("row", "node"), owners.select("node"), "node", "left_semi")
    nodes = materialize(nodes.select("node", "id_text", "n", "set_key", "slots", "bands"), "node-sketches")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "mark")).select("node", "band", F.xxhash64("band", "mark").alias("bucket"))
    buckets = materialize(_with_hub(rows, F.min("node")), "buckets")
    verifier = _Verifier(texts, nodes, buckets, threshold)
    # First one pair per node, with the smallest hub of its buckets: it settles most large groups.
    closest = buckets.filter("node != hub").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    links = _grown(spark.createDataFrame([], "a long, b long"), verifier.links(closest))
    roots = materialize(components(links), "roots")
    # Then whatever may join two components: other hubs, and last the nodes of mixed buckets among each other.
    rooted = _with_roots(buckets, roots)
    for found in (lambda: verifier.links(_pairs(rooted)), lambda: verifier.leftover_links(buckets, roots)):
        more = found()
        if more is not None:
            links = _grown(links, more)
            roots = materialize(components(links), "roots")
    known = merged(owners, roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    placed = merged(sketch, known, "set_key", "left").withColumn("root", F.when(F.col("n") > 0, F.col("root")).otherwise(-1 - F.col("row")))
    placed = materialize(placed.select("id", "row", "root"), "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
    classes = placed.groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size"))
    several = classes.filter("class_size > 1").select("root", "class_size", F.col("first.id").alias("class_id"), F.col("first.row").alias("first_row"))
    joined = merged(placed, several, "root", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("first_row").isNull() | (F.col("first_row") == F.col("row"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class, all columns as they are. Identifiers name documents: rows that share one with a kept row stay."""
    groups = near_groups(docs, id_col, text_col, threshold).filter("class_size > 1")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    gone = materialize(groups.groupBy(key.alias("key")).agg(F.max("kept").alias("any_kept")).filter("not any_kept"), "near-copies")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    return drop_listed(packed, "key", gone).select([F.col("doc").getField(c).alias(c) for c in docs.columns])
