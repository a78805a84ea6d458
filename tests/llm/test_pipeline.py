"""Every stage of the pipeline on its own input, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from test_near_dup import brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from claimspark.llm.common import materialize, table
from claimspark.llm.line_crf import score_documents
from claimspark.llm.queries import vocabulary_path

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents").filter("length(text) < 20000")
    columns, rows = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact dedup", "near dedup", "mixing", "bpe"]
    given = docs
    for name, stage in stages.items():
        rows[name] = (given.collect(), (done := materialize(stage(spark, given, SMALL), "stage")).collect())
        assert name == "bpe" or done.columns == columns
        given = done

    before, after = rows["quality"]
    good = {r.doc_id for r in score_documents(docs, table(spark, SMALL, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in after} == good and set(after) <= set(before)

    before, after = rows["exact dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())

    before, after = rows["near dedup"]
    assert sorted(r.doc_id for r in after) == sorted(map(min, brute_force([(r.doc_id, r.text) for r in before])))

    before, after = rows["mixing"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    copies, words, taken = Counter(r.doc_id for r in after), defaultdict(int), defaultdict(int)
    for r in before:
        words[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
    assert max(copies.values()) <= 3 and {r.doc_id for r in after} <= set(size)
    longest = defaultdict(int)
    for r in before:
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    assert abs(sum(taken.values()) - sum(words.values())) <= sum(longest.values()) / 2 + len(words)

    before, after = rows["bpe"]
    library = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == want


def test_run_writes_and_rereads(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
