"""The pipeline on the smallest tables, stage by stage, against plain Python."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers

import corpus_pipeline
from quire.llm import bpe, mixing, quality, simhash, toxicity
from quire.llm.common import read
from tests.llm.test_text_operators import brute_fingerprint, groups_of

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == columns
    before, after = seen["quality_rules"]
    good = {r.id for r in quality.judge(before).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == good
    before, after = seen["toxicity"]
    model = toxicity.train(before, read(spark, SMALL, "labels"))
    scorer = toxicity.Scorer(model)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if scorer(r.text.encode()) < 0.5}
    before, after = seen["simhash_dedup"]
    prints = {r.doc_id: brute_fingerprint(r.text) for r in before.collect()}
    keys = sorted(prints)
    group = groups_of([(a, b) for a in keys for b in keys if b < a and (prints[a] ^ prints[b]).bit_count() <= simhash.BUDGET], keys)
    assert {r.doc_id for r in after.collect()} == set(group.values())
    before, after = seen["mixing"]
    sizes = collections.Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()))))
    most = max(len(r.text.split()) for r in before.collect())
    taken = collections.Counter()
    for r in after.collect():
        taken[r.source] += len(r.text.encode().split())
    assert all(abs(taken[s] - targets[s]) <= most for s in order)
    assert max(collections.Counter(r.doc_id for r in after.collect()).values()) <= 2
    before, after = seen["bpe"]
    made = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for r in before.collect():
        ids = made.encode(r.text, add_special_tokens=False).ids
        plain = made.decode(ids, skip_special_tokens=False)
        wanted.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    assert sorted(map(tuple, after.collect())) == sorted(wanted)
