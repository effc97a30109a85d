import hashlib
import re
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest

from lorekeep.llm import personal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def near(sets):
    """Per set the first one that links of 0.8 or more reach."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def by_hand(rows, items, context):
    """The pipeline text by text; ``context``: spans that bootstrapped patterns add."""
    kept = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    kept.sort(key=lambda r: r.doc_id)
    found = near([five_words(r.text) for r in kept])
    kept = [r for k, r in enumerate(kept) if found[k] == k]
    dirty = brute.contamination({r.doc_id: r.text for r in kept}, items)
    kept = [r for r in kept if not dirty[r.doc_id][4]]
    texts = [personal.masked(r.text, [(a, b, k) for k, a, b in brute.base(r.text, brute.PERSONAL)] + context.get(r.doc_id, [])) for r in kept]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = brute.token_ids(texts, "byte_bpe_50k.json")
    return Counter((r.doc_id, len(i), sha(np.array(i, "<u4").tobytes()), sha(t.encode())) for r, t, i in zip(kept, texts, ids))


def test_stages(spark, small, read):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    context = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "PII":
            spans = personal.personal_spans(docs).collect()
            context = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if s.kind == "context"] for r in spans}
        docs = stage(spark, docs, small)
        assert docs.columns == COLUMNS
    items = [tuple(r) for r in read(small, "benchmark")]
    want = by_hand(read(small), items, context)
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == want


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_edges(spark, name, request, tmp_path):
    folder = request.getfixturevalue(name)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    pages.write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert bool(rows) == (name == "odd")


def test_near_copies(spark):
    """Near copies of the corpus have 0.8 of their five-word shingles in common."""
    base = [f"w{k}" for k in range(50)]
    changed = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(base))
    # One word of fifty: 41 of 51 shingles are the same; of three words 45 of 51, below 0.9.
    rows = [(1, changed()), (2, changed(25)), (3, changed(10, 30)), (4, "other words than those of all the rest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}
