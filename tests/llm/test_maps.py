"""Operators that are one map: secrets, repetition, decontamination; and packed ids."""

from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import decontaminate, packed, repetition, secrets
from lorekeep.llm.queries import QUERIES

NAMES = ["op2_token_ids", "op4_secret_scan", "op6_decontamination", "op10_quality_rules"]


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_secrets(spark, folder, read):
    got = Counter(tuple(r)[:5] for r in QUERIES["op4_secret_scan"](spark, folder).collect())
    assert got == Counter((r.doc_id, *brute.span_row(r.text, brute.SECRETS)) for r in read(folder))


@pytest.mark.parametrize(
    "text, literals",
    [
        ("k = 'aG93bWFueXRpbWVz1'\ndb_password = k", ["aG93bWFueXRpbWVz1"]),
        ("<dbPassword>Zx81kQp0!vv</dbPassword>", ["Zx81kQp0!vv"]),
        ('private_key: "Qm9iYnk" + "Zx81kQp0!vv"', ["Zx81kQp0!vv"]),
        ("monkey = 'aG93bWFueXRpbWVz1'", []),
        ("Note: the token is in the vault", []),
        ("client_secret = 'your_secret_here1'", []),
        ("secret_name = '${VAULT_ONE_TWO}'", []),
    ],
)
def test_assignments(text, literals):
    assert [text[a:b] for kind, a, b, _ in secrets.spans(text, True) if kind == "literal"] == literals


def test_repetition(spark, folder, read):
    rows = QUERIES["op10_quality_rules"](spark, folder).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((r.doc_id, *brute.repetition(r.text)) for r in read(folder))
    assert not any(r.kept and r.base_failed for r in rows)


def test_repetition_verdict(spark):
    plain = [f"w{k}" for k in range(100)]
    passage = [f"p{k}" for k in range(30)]
    lines = "\n".join(["one line of words that comes again"] * 8 + [" ".join(plain[:60])])
    texts = {0: plain, 1: plain + passage, 2: passage + plain[:60] + passage + plain[60:70] + passage, 3: [lines]}
    docs = spark.createDataFrame([(k, " ".join(t), "x") for k, t in texts.items()], "doc_id int, text string, kept string")
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    assert [got[k].kept for k in range(4)] == [True, True, False, False]
    chars = sum(map(len, texts[2]))
    assert got[2].window_share == pytest.approx(3 * sum(map(len, passage)) / chars)


@pytest.mark.parametrize("limit", [decontaminate.MAX_WINDOWS, 0])
def test_contamination(spark, folder, read, limit):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = decontaminate.benchmark_hits(docs, items, ["doc_id", "text"], limit)
    named = [("null" if r.item_id is None else r.item_id, r.text) for r in read(folder, "benchmark")]
    want = brute.contamination({r.text: r.text for r in read(folder)}, named)
    for r in rows.collect():
        assert (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]))) == want[r.text][:4]
    kept = Counter(r.text for r in decontaminate.decontaminate(docs, items).collect())
    assert kept == Counter(r.text for r in read(folder) if not want[r.text][4])


def test_contamination_query(spark, small, read):
    want = brute.contamination({r.doc_id: r.text for r in read(small)}, [tuple(r) for r in read(small, "benchmark")])
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op6_decontamination"](spark, small).collect()} == want


def test_packed(spark, folder, read, tmp_path):
    rows = sorted(read(folder), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    ids = [[*x, 1] for x in brute.token_ids([r.text for r in rows], "word_bpe_49k.json")]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r.doc_id, int(s), len(x), brute.crc(x)) for r, s, x in zip(rows, starts, ids)]
    got = [tuple(r) for r in QUERIES["op2_token_ids"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_random_access(spark, small, read, monkeypatch):
    import public_tokenizers

    from lorekeep.session import fresh_path

    path = fresh_path(spark, "ids")
    packed.write_ids(spark.read.parquet(f"{small}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text for r in sorted(read(small), key=lambda r: r.doc_id)]
    flat = np.concatenate([[*x, 1] for x in brute.token_ids(texts, "word_bpe_49k.json")])
    for a, b in [(0, 1), (4095, 4097), (10_000, 30_001), (len(flat) - 5, len(flat)), (7, 7)]:
        assert packed.read_ids(spark, path, a, b).tolist() == flat[a:b].tolist()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_pack(bits, ids):
    ids = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    data = packed.pack(ids, bits)
    assert len(data) == -(-len(ids) // 64) * 8 * bits
    assert packed.unpack(data, bits, len(ids)).tolist() == ids.tolist()


def test_documents_keep_columns_named_like_the_hits(spark):
    passage = " ".join(f"w{n}" for n in range(14))
    rows = [(1, passage, 7, "mine", None), (2, "a clean text", 8, None, [1]), (3, None, None, "x", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Words int, items string, n_hit array<int>")
    items = spark.createDataFrame([("q1", passage)], "item_id string, text string")
    out = decontaminate.decontaminate(docs, items)
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == rows[1:]
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []
