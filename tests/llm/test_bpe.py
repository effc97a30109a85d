import hashlib
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest

from lorekeep.llm import bpe
from lorekeep.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    ids = brute.token_ids([r.text for r in rows], "byte_bpe_50k.json")
    hashed = lambda b: hashlib.sha256(b).hexdigest()
    return Counter((r.doc_id, len(x), hashed(np.array(x, "<u4").tobytes()), hashed((r.text or "").encode())) for r, x in zip(rows, ids))


def test_query(spark, folder, read):
    assert Counter(map(tuple, QUERIES["op3_bpe_chunks"](spark, folder).collect())) == want(read(folder))


def test_empty(spark, empty):
    assert QUERIES["op3_bpe_chunks"](spark, empty).collect() == []


def test_shared_passages(spark, small, read):
    """Passages set into other texts at any place, cut and joined anywhere."""
    rng = random.Random(3)
    texts = [r.text for r in read(small)][:60]
    parts = ["x" * 3000, "日本語テキスト" * 400, "a  b\n\n  c " * 200, "word " * 500, *texts[:6]]
    rows = []
    for k in range(80):
        pieces = [rng.choice(texts + parts)[rng.randrange(50) :] for _ in range(rng.randrange(1, 5))]
        rows.append((k, rng.choice(["", " ", "\n"]).join(pieces)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, bpe.digests(docs, PATH).collect())) == want(docs.collect())
    back = bpe.decode_ids(bpe.encode_ids(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == rows


def test_chunks_come_back():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(20_000)).encode()
    one, two = (set(bpe.codec(PATH).chunks(p + passage)) for p in (b"left ", b"a longer beginning "))
    assert len(one & two) >= len(one) - 2 > 5


@pytest.mark.parametrize("text", ["", "a", " a b", "no_blank_at_all" * 50, "a\n b  c   d\t e é ñ " * 40])
def test_join(text):
    codec, data, rng = bpe.codec(PATH), text.encode(), random.Random(2)
    expected = np.array(brute.token_ids([text], "byte_bpe_50k.json")[0], "<u4").tobytes()
    for _ in range(20):
        at = sorted(k for k in rng.sample(range(len(text) + 1), min(len(text), 4)))
        cut = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        assert codec.join([codec.encode_chunk(c.encode()) for c in cut if c] or [(b"", -1, -1)]) == expected
    assert codec.decode(expected) == data
