"""Worked examples, edge cases and brute force for the scores."""

import math
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.vocabulary import english_stop_words
from lorekeep.operators import graph
from lorekeep.operators import metrics as m
from lorekeep.operators.similarity import pair_similarity

CASES = "case_id long, query string, expected_answer string, actual_answer string, retrieved_docs array<string>, relevant_docs array<string>, response_time double"
EXAMPLES = [
    (
        1,
        "When do the tomato beds get water?",
        "tomato beds get water from the north tank at dawn",
        "At dawn the gardener gives the tomato beds water. It comes from a tank behind the shed.",
        ["The north tank fills at night.", "Every bed has a hose of its own.", "Bread is baked on friday."],
        ["The north tank fills at night.", "Every bed has a hose of its own."],
        2.0,
    ),
    (
        2,
        "which pump feeds the pond",
        "The red pump feeds the pond.",
        "A red pump feeds it.",
        ["the red one by the gate", "which pump feeds the pond", "bread is baked on friday", "a valve stops the flow"],
        ["the red one by the gate", "a valve stops the flow"],
        0.5,
    ),
]


def brute_similarity(a, b, cap=1000):
    stop = set(english_stop_words())
    cut = lambda t: Counter(
        w for w in re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (t or "").lower())).split() if len(w) > 1 and w not in stop
    )
    x, y = cut(a), cut(b)
    vocabulary = sorted(set(x) | set(y), key=lambda t: (-(x[t] + y[t]), t.encode()))[:cap]
    idf = lambda t: math.log(3 / (1 + (t in x) + (t in y))) + 1
    u, v = [x[t] * idf(t) for t in vocabulary], [y[t] * idf(t) for t in vocabulary]
    norm = math.sqrt(sum(i * i for i in u) * sum(i * i for i in v))
    return sum(i * j for i, j in zip(u, v)) / norm if norm else 0.0


def similarities(spark, pairs, **kw):
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a string, b string")
    return {r["n"]: r["similarity"] for r in pair_similarity(df, ["n"], "a", "b", **kw).collect()}


def test_worked_examples(spark):
    rows = {r["case_id"]: r for r in m.evaluate(spark.createDataFrame(EXAMPLES, CASES)).collect()}
    assert [rows[n]["precision"] for n in (1, 2)] == pytest.approx([2 / 3, 2 / 4])
    assert rows[1]["recall"] == rows[2]["recall"] == 1.0
    assert [rows[n]["f1_score"] for n in (1, 2)] == pytest.approx([4 / 5, 2 / 3])
    # In the second case a document says what the question says, but is not a relevant one.
    assert [rows[n]["accuracy"] for n in (1, 2)] == pytest.approx([1.0, 3 / 4])
    assert rows[1]["num_retrieved_docs"] == rows[1]["num_relevant_docs"] == 3
    assert [rows[n]["num_relevant_true"] for n in (1, 2)] == [2, 2]
    for n, length, done in ((1, 0.6, 8 / 10), (2, 0.8, 3 / 5)):
        sim = brute_similarity(EXAMPLES[n - 1][2], EXAMPLES[n - 1][3])
        assert rows[n]["semantic_similarity"] == pytest.approx(sim)
        assert rows[n]["answer_quality_score"] == pytest.approx(0.4 * sim + 0.2 * length + 0.2 * done + 0.2 * 0.8)


def test_examples_one_by_one(spark):
    df = spark.createDataFrame(EXAMPLES, CASES)
    rows = df.select(
        tx.length_score("actual_answer", "expected_answer").alias("l"),
        tx.completeness("actual_answer", "expected_answer").alias("c"),
        tx.clarity("actual_answer").alias("k"),
    ).collect()
    # 87 characters for 49, 20 for 28; 8 of 10 terms, 3 of 5; short sentences with full stops.
    assert [r["l"] for r in rows] == [0.6, 0.8]
    assert [r["c"] for r in rows] == pytest.approx([8 / 10, 3 / 5])
    assert [r["k"] for r in rows] == pytest.approx([0.8, 0.8])


def test_similarity_edges(spark):
    got = similarities(
        spark,
        [("", "a text"), (None, None), ("the of and", "the of and"), ("?!.", "..."), ("L'été été", "été"), ("cat", "CAT!"), ("x", "x")],
    )
    assert got[0] == got[1] == got[2] == got[3] == 0.0
    assert got[4] == pytest.approx(brute_similarity("L'été été", "été"))
    assert got[5] == pytest.approx(1.0)
    assert got[6] == 0.0


def test_vocabulary_cap(spark):
    a = " ".join(f"w{i}" for i in range(40)) + " w3 w3 w9"
    b = " ".join(f"w{i}" for i in range(20, 70)) + " w9 w66"
    assert similarities(spark, [(a, b)], max_features=25)[0] == pytest.approx(brute_similarity(a, b, 25))


WORDS = st.lists(st.sampled_from("the cat sat été naïve x1 a_b don't Über re-do 東京 a".split()), max_size=30).map(" ".join)


def test_similarity_is_brute_force_and_symmetric(spark):
    pairs = []

    @settings(max_examples=60, database=None)
    @given(WORDS, WORDS)
    def draw(a, b):
        pairs.append((a, b))

    draw()
    there, back = similarities(spark, pairs), similarities(spark, [(b, a) for a, b in pairs])
    for n, (a, b) in enumerate(pairs):
        assert there[n] == pytest.approx(brute_similarity(a, b), abs=1e-12)
        assert there[n] == pytest.approx(back[n], abs=1e-12)
        assert -1e-12 <= there[n] <= 1 + 1e-12


def test_one_hot_document(spark):
    """A third of all pairs shares one document."""
    hot = "word " * 500 + " ".join(f"t{i}" for i in range(300))
    pairs = [("t1 t2", hot) if n % 3 == 0 else (f"t{n} word", f"t{n}") for n in range(300)]
    got = similarities(spark, pairs)
    assert len(got) == 300
    assert got[0] == pytest.approx(brute_similarity(*pairs[0]))
    assert got[1] == pytest.approx(brute_similarity(*pairs[1]))


def test_stop_words_are_sparks_list(spark):
    cleaned = (re.sub(r"[^\w\s]", " ", w.lower()).strip() for w in StopWordsRemover.loadDefaultStopWords("english"))
    assert sorted({w for w in cleaned if w and " " not in w}) == sorted(set(english_stop_words()))


def test_length_bands_are_inclusive(spark):
    sizes = [29, 30, 49, 50, 79, 80, 100, 120, 121, 150, 151, 200, 201]
    df = spark.createDataFrame([("x" * n, "y" * 100) for n in sizes] + [("", "y"), (None, "y"), ("x", "")], "a string, e string")
    got = [r[0] for r in df.select(tx.length_score("a", "e")).collect()]
    assert got == [0.3, 0.6, 0.6, 0.8, 0.8, 1.0, 1.0, 1.0, 0.8, 0.8, 0.6, 0.6, 0.3, 0.0, 0.0, 0.0]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [(None,), ("",), ("  A,b\t_c  é! ",), ("one two three",), ("...",)], "t string"
    )
    assert [r[0] for r in df.select(tx.clean_text("t")).collect()] == ["", "", "a b _c é", "one two three", ""]
    counts = [r[0] for r in df.filter("t is not null").select(tx.word_count("t")).collect()]
    assert counts == [len(s.split()) for s in ("", "  A,b\t_c  é! ", "one two three", "...")]
    clear = spark.createDataFrame([("no stop",), (" ".join(["w"] * 16) + ". " + " ".join(["w"] * 16),), ("w " * 30,)], "t string")
    assert [r[0] for r in clear.select(tx.clarity("t")).collect()] == pytest.approx([0.65, 1.0, 0.65])


def test_clarity_is_the_mean_over_pieces(spark):
    texts = ["a b. c d! e?", "a.b.c", ". .", "x y z", "w " * 17 + ".", "a... b!? c"]

    def brute(t):
        parts = re.split(r"[.!?]+", t)
        mean = sum(len(p.split()) for p in parts) / len(parts)
        band = 1.0 if 15 <= mean <= 20 else 0.8 if 10 <= mean <= 25 else 0.6
        return (band + (1.0 if len(parts) > 1 else 0.7)) / 2

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.clarity("t")).collect()] == pytest.approx([brute(t) for t in texts])


def test_list_scores(spark):
    df = spark.createDataFrame(
        [([], []), ([], ["a"]), (["a"], []), (["a", "a", "b"], ["a", "c"]), (["a"], ["a"])],
        "r array<string>, v array<string>",
    )
    got = df.select(m.precision(F.col("r"), F.col("v")).alias("p"), m.recall(F.col("r"), F.col("v")).alias("q")).collect()
    assert [r["p"] for r in got] == pytest.approx([0, 0, 0, 1 / 3, 1])
    assert [r["q"] for r in got] == pytest.approx([1, 0, 0, 1 / 2, 1])


def test_accuracy_of_arrays(spark):
    df = spark.createDataFrame([([True, False], [True, True])], "p array<boolean>, t array<boolean>")
    assert df.select(m.accuracy("p", "t")).first()[0] == 0.5
    bad = spark.createDataFrame([([True], [True, True])], "p array<boolean>, t array<boolean>")
    with pytest.raises(Exception, match="same length"):
        bad.select(m.accuracy("p", "t")).collect()


def test_rejects(spark):
    rows = [(1, None, "e", "a", ["x"], ["x"], 1.0), (2, "q", "e", "a", [], ["x"], 1.0), (3, "q", "e", "a", None, None, None)]
    rows.append((4, "q", "e", "a", ["x"], None, None))
    df = spark.createDataFrame(rows, CASES)
    assert {r["case_id"]: r["reason"] for r in m.rejected_cases(df).collect()} == {
        1: "missing field",
        2: "nothing retrieved",
        3: "nothing retrieved",
    }
    done = m.evaluate(df).collect()
    assert [(r["case_id"], r["response_time"], r["recall"]) for r in done] == [(4, 0.0, 0.0)]


def test_summary_of_nothing(spark):
    empty = m.evaluate(spark.createDataFrame([], CASES))
    assert m.summarise(empty).collect() == []


def test_relevance_list_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([(1, "red cat", "e", "a", ["red cat", "b", "red cat", "red"], ["b"], 0.0)], CASES)
    scores = m.relevance_lists(m.relevance_scores(df)).first()["relevance_scores"]
    assert scores == pytest.approx([1.0, 1.0, 1.0, brute_similarity("red cat", "red")])


def test_markdown(spark):
    md = "# Title\n\nSome *soft* and **bold** `code`, [link](http://x) ![img](y).\n\n\n\n* one\n2. two\n> said\n---\n```py\nx = a * b * c\n```\n"
    got = spark.createDataFrame([(md,)], "t string").select(tx.markdown_text("t")).first()[0]
    assert got == "Title\n\nSome soft and bold code, link img.\n\none\ntwo\nsaid\n\nx = a * b * c"


def test_odd_texts_take_no_long(spark):
    """Long runs of one thing: linear work, no exhausted stack."""
    n = 200_000
    odd = {
        "strip": tx.strip(F.concat(F.lit("a"), F.repeat(F.lit(" "), n), F.lit("b"))),
        "tags": tx.page_text(F.repeat(F.lit("<"), n)),
        "scripts": tx.page_text(F.repeat(F.lit("<script>"), n)),
        "links": tx.markdown_text(F.repeat(F.lit("["), n)),
        "entities": F.array_join(graph._phrases(F.repeat(F.lit("Word "), n)), "|"),
        "words": tx.word_count(F.repeat(F.lit("? "), n)).cast("string"),
    }
    start = time.monotonic()
    row = spark.range(1).select(*[F.length(c).alias(k) for k, c in odd.items()]).first().asDict()
    assert row == {"strip": n + 2, "tags": n, "scripts": 0, "links": n, "entities": 5 * n - 1, "words": 6}
    assert time.monotonic() - start < 30


def test_strip_is_pythons(spark):
    texts = [" a b\t", " x　", "\x1cq\x85", "", " \n", "​z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.strip("t")).collect()] == [t.strip() for t in texts]
