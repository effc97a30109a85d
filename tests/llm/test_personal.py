import random
from collections import Counter

import brute
import pytest

from lorekeep.llm import personal
from lorekeep.llm.queries import QUERIES


def test_base(spark, folder, read):
    rows = QUERIES["op5_personal_data"](spark, folder).collect()
    got = Counter(tuple(r)[:6] for r in rows)
    assert got == Counter((r.doc_id, *brute.span_row(r.text, brute.PERSONAL)) for r in read(folder))


def test_random_texts():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("019.@-+ (a_%") for _ in range(rng.randrange(60)))
        base = [(k, a, b) for a, b, k in personal.base_spans(text)]
        assert base == brute.base(text, brute.PERSONAL), text


def test_empty(spark, empty):
    assert QUERIES["op5_personal_data"](spark, empty).collect() == []


@pytest.fixture(scope="module")
def contexts(spark):
    """Mails after "write to" and badge numbers after it and after "badge holder"; numbers
    after words that are followed by anything."""
    rows = [(k, f"one of many lines\nplease write to: me{k}@mail.org today", None) for k in range(20)]
    rows += [(100 + k, f"you can write to: KX-{4000 + 7 * k}/B at the desk", None) for k in range(4)]
    rows += [(150 + k, f"our badge holder: KX-{4000 + 7 * k}/B left", None) for k in range(4)]
    rows += [(200, "ask the badge holder: KX-99871/Q about it", None), (201, "page of many 10245 and one of many 99887", None)]
    rows += [(300 + k, f"this is one of many words that nobody counts {k}", None) for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, found string")


def test_bootstrapping(contexts):
    found = {r.doc_id: r.spans for r in personal.personal_spans(contexts).collect()}
    texts = {r.doc_id: r.text for r in contexts.collect()}
    named = {k: [texts[k][s.start : s.end] for s in v if s.kind == "context"] for k, v in found.items()}
    assert all(named[100 + k] == [f"KX-{4000 + 7 * k}/B"] for k in range(4))
    # Reached by a pattern whose instances the first pattern made known.
    assert named[200] == ["KX-99871/Q"]
    assert named[201] == [] and not any(named[300 + k] for k in range(30))


def test_mask(contexts):
    masked = {r.doc_id: r for r in personal.mask(contexts).collect()}
    assert masked[0].text == "one of many lines\nplease write to: [EMAIL] today"
    assert masked[200].text == "ask the badge holder: [CONTEXT] about it"
    assert masked[300].text == "this is one of many words that nobody counts 0"
    assert len(masked) == contexts.count() and masked[0].found is None


def test_masked_overlaps():
    assert personal.masked("abcdefgh", [(1, 4, "ip"), (3, 6, "card"), (6, 7, "email")]) == "a[IP][EMAIL]h"


def test_mask_keeps_rows(spark, odd, read):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = personal.mask(docs).collect()
    assert len(rows) == docs.count()
    clean = Counter(tuple(r) for r in read(odd) if not brute.base(r.text, brute.PERSONAL))
    assert not clean - Counter(map(tuple, rows))


def test_repeated_rows(contexts):
    """A table in which every row stands twice names the same."""
    spans = lambda df: {(r.doc_id, str(r.spans)) for r in personal.personal_spans(df).collect()}
    assert spans(contexts.unionAll(contexts)) == spans(contexts)


def test_few_digits(spark):
    """Identifiers of few digits or none are named by good patterns; everyday numbers that
    follow one once make no pattern good."""
    rows = [(k, f"please write to: me{k}@mail.org today") for k in range(40)]
    tokens = ["user@localhost", "@handle", "j.doe@corp", "AB-123"]
    rows += [(100 + k, f"or write to: {t} at once") for k, t in enumerate(tokens)]
    rows += [(200 + k, f"you write to: {k} people") for k in range(5)]
    rows += [(300 + 10 * k + j, f"see page number {k} here, in week number {k}, chapter {j}") for k in range(5) for j in range(6)]
    found = {r.doc_id: r.spans for r in personal.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for k, t in enumerate(tokens):
        assert [texts[100 + k][s.start : s.end] for s in found[100 + k]] == [t]
    assert not any(found[k] for k in found if k >= 300)
