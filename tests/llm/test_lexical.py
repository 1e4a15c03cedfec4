"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eluent.llm import lexical

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, top=10):
    docs = [(i, Counter(cut(t))) for i, t in docs if i is not None and cut(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in terms.items() if c[t])
            if s > 0:
                scores.append((-s, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


@pytest.fixture
def tables(spark):
    def make(docs, items):
        return (
            spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, score int").repartition(3),
            spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank int"),
        )

    return make


@pytest.fixture
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(80)]
    p = 1 / np.arange(1, 81)
    text = lambda low, high: " ".join(rng.choice(words, rng.integers(low, high), p=p / p.sum()))
    docs = [(int(i), text(0, 60)) for i in rng.permutation(400)]
    docs += [(1000 + i, "w3 w4 w5 Copy") for i in range(150)] + [(2000, None), (2001, ""), (None, "w1 w2"), (7, "w1 w70"), (7, "w1 w70"), (2002, "été É w9"), (2003, text(5000, 5001))]
    items = [(i, text(1, 12)) for i in range(30)] + [(40, "w3 w4 copy copy"), (41, None), (42, "absent"), (None, "w1"), (43, "É w9"), (44, "w70"), (44, "w71 w70")]
    return docs, items


@pytest.mark.parametrize(("shard", "slice_", "probe"), [(4_000_000, 200_000, 3), (300, 200_000, 1), (1000, 40, 3)])
def test_against_plain_version(tables, corpus, shard, slice_, probe):
    docs, items = corpus
    got = lexical.search(*tables(docs, items), shard=shard, slice_rows=slice_, probe=probe)
    assert sorted(map(tuple, got.collect())) == plain(docs, items)


def test_empty_tables_and_long_texts(tables):
    docs, items = tables([(1, "a b")], [(1, "a")])
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
    rows = [(i, "some words to look at " * 40_000 + f"and {i}") for i in range(3)] + [(9, "y" * 1_000_000), (10, "and 2")]
    asked = [(1, "and 2 words " * 3), (2, "y" * 1_000_000)]
    assert sorted(map(tuple, lexical.search(*tables(rows, asked)).collect())) == plain(rows, asked)


def test_equal_documents_are_not_all_searched(monkeypatch):
    from eluent.llm import packed

    n = 20_000
    data = packed.pack(ids=np.arange(n), n=np.full(n, 2), doc=np.tile(np.arange(n, dtype=np.int32), 2), tf=np.ones(2 * n, np.int32), term=np.array([1, 2], np.int32), df=np.array([n, n]))
    shard = lexical.Shard(data, np.array([0, 5, 7]), n, 2 * n)
    seen = []
    highest = shard.highest
    monkeypatch.setattr(shard, "highest", lambda a, b: seen.append(len(a)) or highest(a, b))
    ids, scores = shard.best(np.array([1, 2]), np.array([1, 1]), 10)
    assert ids.tolist() == list(range(10)) and len(set(scores.tolist())) == 1 and sum(seen) < 500
