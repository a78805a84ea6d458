import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimspark.llm import near_dup
from claimspark.llm.common import materialize
from claimspark.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    words = near_dup._WORD.findall(text or "")
    if not words:
        return Counter()
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def probability_jaccard(a, b):
    every = set(a) | set(b)
    if max(a.values()) == max(b.values()) == 1:
        return len(set(a) & set(b)) / len(every)
    return sum(1 / sum(max(a[d] / a[i], b[d] / b[i]) for d in every) for i in set(a) & set(b))


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and (sets[i] == sets[j] or (len(set(sets[i]) & set(sets[j])) and probability_jaccard(sets[i], sets[j]) >= 0.8)):
            parent[root(i)] = root(j)
    classes = {}
    for i, (key, _) in enumerate(rows):
        classes.setdefault(root(i), []).append(key)
    return {frozenset(v) for v in classes.values()}


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return words


def fixture():
    rnd, rows = random.Random(5), []
    passage = rnd.choices(WORDS, k=60)
    for k in range(12):
        base = rnd.choices(WORDS, k=rnd.randint(8, 300))
        rows += [" ".join(edited(base, rnd, e)) for e in (0, 0, 1, 2, 4, 8)]
    for k in range(20):
        rows.append(" ".join(rnd.choices(WORDS, k=rnd.randint(20, 200)) + passage))
    for k in range(40):
        rows.append(" ".join(edited(passage * 3, rnd, 1)))
    rows += ["", " \n", None, None, "one", "one", "two words", " ".join(["again"] * 3000), " ".join(["again"] * 3000 + ["end"]), "x" * 50_000]
    return list(enumerate(rows))


def test_classes_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "a", i % 3, 7) for i, t in rows], "doc_id long, text string, node string, band int, root int").repartition(5)
    got = near_dup.near_groups(df).collect()
    assert len(got) == len(rows)
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert all(k == min(v) for k, v in classes.items())
    assert {frozenset(v) for v in classes.values()} == brute_force(rows)
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == len(classes[r.class_id]) for r in got)


def test_one_row_of_each_class_stays(spark):
    text = " ".join(WORDS[:50])
    rows = [(3, text, "n"), (1, text + " more", "n"), (None, text, "n"), (7, None, "n"), (8, "", "n"), (9, "other words here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_groups(df).collect() == []


def test_slots_agree_with_the_similarity():
    rnd = random.Random(2)
    a = rnd.choices(WORDS, k=400)
    b = edited(a, rnd, 12)
    sets = near_dup.shingle_sets([" ".join(a), " ".join(b)])
    marks = near_dup.signatures(sets, 4000)
    exact = near_dup.similarity(*sets[0], *sets[1])
    assert abs((marks[0] == marks[1]).mean() - exact) < 0.04
    assert abs(exact - probability_jaccard(shingles(" ".join(a)), shingles(" ".join(b)))) < 1e-9


def test_weights_count():
    a, b = Counter({"p": 5, "q": 1}), Counter({"p": 1, "q": 1, "r": 2})
    keys = {"p": 1, "q": 2, "r": 3}
    arrays = [(np.array([keys[k] for k in sorted(c)]), np.array([c[k] for k in sorted(c)], float)) for c in (a, b)]
    assert abs(near_dup.similarity(*arrays[0], *arrays[1]) - probability_jaccard(a, b)) < 1e-12
    tags, counts = near_dup._unpack(near_dup._pack(np.array([1 << 40, 5 << 32], np.uint64), np.array([3.0, 1.0])))
    assert dict(zip(tags.tolist(), counts.tolist())) == {1 << 8: 3, 5: 1}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


def test_near_copies_among_templated_texts(spark):
    """Thousands of texts share a passage (similarity 0.74); pairs of 0.83 among them are all found, and nothing else."""
    rnd, fresh = random.Random(9), itertools.count()
    template = [f"t{i}" for i in range(259)]

    def own(k):
        return [f"u{next(fresh)}" for _ in range(k)]

    texts = [template + own(45) for _ in range(2000)]
    texts += [template + texts[i][259:277] + own(27) for i in range(60)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    sets = [set(zip(*[words[k:] for k in range(5)])) for words in texts]
    shared = set(zip(*[template[k:] for k in range(5)]))
    rest, holders = [s - shared for s in sets], {}
    for i, s in enumerate(rest):
        for x in s:
            holders.setdefault(x, []).append(i)
    # Every text holds the whole template, so only texts that share something else can pass 0.8.
    assert len(shared) / (2 * min(map(len, sets)) - len(shared)) < 0.8
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    wanted = {frozenset(p) for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert len(wanted) == 60
    df = spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string")
    classes = {}
    for r in near_dup.near_groups(df).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == wanted


def test_blocks_of_a_bucket_meet(spark):
    """Every two nodes of two components meet in exactly one task, also where a component is larger than a block."""
    rows = [(1, 0, i, 0 if i < 40 else i, 10) for i in range(60)]
    tasks = near_dup._tasks(spark.createDataFrame(rows, "bucket long, band int, node long, root long, n int"), 50).collect()
    held, met = {}, Counter()
    for r in tasks:
        held.setdefault(r.task, []).append(r)
    for group in held.values():
        one_side = len({r.side for r in group}) == 1
        met.update(frozenset((a.node, b.node)) for a, b in itertools.combinations(group, 2) if a.root != b.root and (one_side or a.side != b.side))
    assert set(met) == {frozenset((a, b)) for a, b in itertools.combinations(range(60), 2) if b >= 40} and max(met.values()) == 1


def test_no_table_that_grows_with_the_nodes_is_broadcast(spark):
    """an exploded array counts as one row in Spark's estimate, so the bucket rows of a quarter million nodes went to the driver."""
    nodes = spark.range(300).select(F.col("id").alias("node"), F.array(*[(F.col("id") + i) % 40 for i in range(20)]).alias("bands"))
    nodes = materialize(nodes, "few-nodes")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    hubs = near_dup._with_hub(rows, F.min("node"))
    edges = components(hubs.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    for df in (hubs, near_dup._with_roots(hubs, edges)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert hubs.where("size > 1").count() == 6000 and {r.root for r in edges.collect()} == {0}
