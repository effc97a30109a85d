import random
from collections import Counter

import pytest

from lorekeep.llm import jaccard
from lorekeep.llm.components import components
from lorekeep.llm.queries import QUERIES


def shingle_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def clusters(sets):
    """Least id of each row's component, all pairs compared."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def expected(rows):
    sets = [shingle_set(r.text) for r in rows]
    found = clusters(sets)
    least = {}
    for r, c in zip(rows, found):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s), least.get(c)) for r, s, c in zip(rows, sets, found))


def test_query(spark, folder, read):
    assert Counter(map(tuple, QUERIES["op9_near_duplicates"](spark, folder).collect())) == expected(read(folder))


def test_empty(spark, empty):
    assert QUERIES["op9_near_duplicates"](spark, empty).collect() == []
    assert jaccard.one_of_each(spark.read.parquet(f"{empty}/documents.parquet")).collect() == []


@pytest.fixture(scope="module")
def edited(spark):
    """Chains and groups of near copies around the threshold, copies, short texts."""
    rng, texts = random.Random(8), []
    for size in (1, 2, 3, 8, 25, 60, 150, 400):
        for _ in range(3):
            words = [f"w{rng.randrange(60 if size > 100 else 400)}" for _ in range(size)]
            for _ in range(12):
                texts.append(" ".join(words))
                for _ in range(rng.randrange(1, max(2, size // 30))):
                    words[rng.randrange(size)] = f"v{rng.randrange(200)}"
    base = [f"b{k}" for k in range(90)]
    texts += [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(90)] + [" ".join(base).upper()] * 5
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_edited(edited):
    got = Counter(tuple(r)[:3] for r in jaccard.near_duplicates(edited).collect())
    want = expected(edited.collect())
    assert got == want and len({c for _, _, c in want}) < edited.count()


def test_one_of_each(spark, edited, odd, read):
    got = sorted(r.doc_id for r in jaccard.one_of_each(edited).collect())
    assert got == sorted({c for _, _, c in expected(edited.collect())})
    rows = jaccard.one_of_each(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    full = [r for r in read(odd) if shingle_set(r.text)]
    found = clusters([shingle_set(r.text) for r in full])
    assert len([r for r in rows if shingle_set(r.text)]) == len(set(found))
    assert len([r for r in rows if not shingle_set(r.text)]) == len(read(odd)) - len(full)


def test_few_verified(spark, monkeypatch):
    """A large group of near copies costs pairs in proportion to its size."""
    words = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join([*words[:k], f"n{k}", *words[k + 1 :]])) for k in range(300)]
    seen = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda docs, pairs, *a: seen.append(pairs.count()) or verified(docs, pairs, *a))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(seen) < 12 * len(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_component(spark):
    """Components without any id, or with an id in common, are not one component."""
    words = lambda k: " ".join(f"{'abcdef'[k]}{j}" for j in range(30))
    rows = [(None, words(0)), (None, words(0) + " z"), (None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (8, words(4))]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text[0] for r in kept) == ["a", "b", "c", "d", "e"]
