"""The pipeline's stages on sf0.001, each held against a plain version of its decision on its own input."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from newsloom.llm import decontaminate, quality_classifier, quality_rules
from newsloom.session import cut_lineage
from tests.conftest import SF_SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "decontamination", "packing"]
    seen = []
    for _, stage in P.STAGES:
        seen.append(docs)
        out = cut_lineage(stage(spark, docs, SF_SMALL))
        docs = out
    first, ruled, classed, unique, clean = seen
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    for df in (ruled, classed, unique, clean):
        assert df.columns == first.columns
    rules = {r.doc_id for r in quality_rules.quality_rules(first).where("kept").collect()}
    assert set(texts(ruled)) == rules
    good = {r.doc_id for r in quality_classifier.classify(ruled, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).where("score >= 0.3").collect()}
    assert set(texts(classed)) == good
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts(classed).items() if (w := t.encode().lower().split())}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a].add(b)
    kept, left = set(), set(sets)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += links[i]
        kept.add(min(group))
        left -= group
    assert set(texts(unique)) == kept
    items = [decontaminate.alnum_words(r.text.encode()) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    windows = {b" ".join(w[k:k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    held = lambda t: any(b" " + w + b" " in b" " + b" ".join(decontaminate.alnum_words(t.encode())) + b" " for w in windows)
    assert set(texts(clean)) == {i for i, t in texts(unique).items() if not held(t)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts(clean).items()}
    rows = docs.collect()
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start:r.start + r.length].tobytes())


def test_empty_tables_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = cut_lineage(stage(spark, docs, SF_SMALL))
        assert docs.count() == 0
