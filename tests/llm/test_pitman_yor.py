"""Seating against its exact distribution, probabilities against closed forms, and held-out texts against the base."""

import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from eluent.llm import pitman_yor as py


def exact(c, a, d):
    """The distribution of tables of one dish: generalised Stirling numbers times powers of the weight of a new table."""
    s = [[0.0] * (c + 2) for _ in range(c + 1)]
    s[0][0] = 1.0
    for n in range(c):
        for t in range(n + 2):
            s[n + 1][t] = (s[n][t - 1] if t else 0.0) + (n - t * d) * s[n][t]
    p = np.array([s[c][t] * a**t if t else 0.0 for t in range(c + 1)])
    return p / p.sum()


@pytest.mark.parametrize(("c", "a", "d"), [(2, 0.3, 0.5), (5, 1.5, 0.7), (12, 0.2, 0.8)])
def test_gibbs_steps_reach_the_exact_distribution_of_tables(c, a, d):
    rng, n = np.random.default_rng(2), 20_000
    counts, weights = np.full(n, c), np.full(n, a)
    owner, size = py.seat(counts, weights, d, rng)
    for _ in range(30 * c):
        owner, size = py.reseat(owner, size, counts, weights, d, rng)
        assert np.array_equal(np.bincount(owner, size, minlength=n), counts) and (size > 0).all()
    got = np.bincount(np.bincount(owner), minlength=c + 1) / n
    assert np.abs(got - exact(c, a, d)).max() < 0.015


def test_seats_of_very_many_customers():
    rng = np.random.default_rng(2)
    c, a = np.array([1, 3_000_000, 40, 200_000]), np.array([0.5, 2.0, 0.1, 1e-6])
    owner, size = py.seat(c, a, 0.5, rng)
    assert np.array_equal(np.bincount(owner, size), c) and (np.diff(owner) >= 0).all()
    t = np.bincount(owner)
    assert t[0] == 1 and t[3] == 1 and 5 < t[1] < 500
    more = c > 1
    o, s = py.reseat(np.searchsorted(np.flatnonzero(more), owner[more[owner]]), size[more[owner]], c[more], a[more], 0.5, rng)
    assert np.array_equal(np.bincount(o, s), c[more])


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, out boolean, kind string, src int").repartition(3)

    return make


def test_closed_form_where_nothing_repeats(table):
    rows = [(1, "a b c", False), (2, "A b", True), (3, "", True), (4, None, True), (5, "zz a", True), (None, "c", True), (2, "A b", True)]
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 4)) for r in py.scores(table(rows), F.col("out")).collect())
    d, words, tokens = 0.95, 4, 4  # each dish has one customer, at one table, in each of its restaurants
    even = (py.THETA + d * 4) / (words + 1)
    parent = lambda w: ((1 - d) * (w in "abc ") + even) / (py.THETA + 4)
    after = {" ": "a", "a": "b", "b": "c", "c": " "}

    def p(u, w):
        if u not in after:
            return parent(w)
        return ((1 - d) * (after[u] == w) + (py.THETA + d) * parent(w)) / (py.THETA + 1)

    assert abs(sum(p("a", w) for w in (*"abc ", "zz")) - 1) < 1e-9
    want = Counter()
    for doc_id, text, _ in rows:
        words_ = [*(text or "").lower().split(), " "]
        base = sum(log10(((w in after) + 0.1) / (tokens + 0.1 * (words + 1))) for w in words_)
        want[doc_id, len(words_), sum(w in after for w in words_), tokens, round(base, 9), round(sum(log10(p(u, w)) for u, w in zip([" ", *words_], words_, strict=False)), 4)] += 1
    assert got == want


def chain(n_docs, seed):
    """Texts in which a word tells much about the next, with a long tail of rare words."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_docs):
        w, words = 0, []
        for _ in range(rng.integers(0, 60)):
            w = int((3 * w + rng.integers(1, 6)) % 40) if rng.random() < 0.9 else 40 + int(rng.pareto(0.7) * 10) % 5000
            words.append(f"w{w}")
        out.append((i, " ".join(words), bool(zlib.crc32(str(i).encode()) % 10 == 0)))
    return out


def test_held_out_texts_and_many_buckets(table):
    rows = chain(600, 4)
    seen = []
    for bucket, block, hot in ((2_000_000, 4_000_000, 400), (700, 900, 400), (700, 900, 5)):
        seen.append({r["doc_id"]: r for r in py.scores(table(rows), bucket=bucket, block=block, hot=hot).collect()})
    counts = Counter(w for _, t, out in rows if not out for w in [*t.split(), " "])
    total, words = sum(counts.values()), len(counts)
    for got in seen:
        assert len(got) == len(rows)
        for doc_id, text, out in rows:
            r, tokens = got[doc_id], [*text.split(), " "]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, len(tokens), sum(counts[w] > 0 for w in tokens), total)
            assert abs(r["base_score"] - sum(log10((counts[w] + 0.1) / (total + 0.1 * (words + 1))) for w in tokens)) < 1e-9 * max(1, len(tokens))
        held = [r for r in got.values() if r["held_out"]]
        n = sum(r["n_tokens"] for r in held)
        perplexity = {k: exp(-log(10) * sum(r[k] for r in held) / n) for k in ("base_score", "score")}
        assert perplexity["score"] < 0.5 * perplexity["base_score"]
    whole, cut = (sum(r["score"] for r in got.values()) for got in seen[:2])
    assert abs(whole / cut - 1) < 0.02  # buckets are seated by their own draws
    assert {k: r["score"] for k, r in seen[0].items()} != {k: r["base_score"] for k, r in seen[0].items()}


def test_no_training_texts_long_texts_and_empty_table(table):
    got = py.scores(table([(1, "a b", True), (2, None, True)]), F.col("out")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"]) < 1e-6 and abs(r["base_score"]) < 1e-9 for r in got) and len(got) == 2
    assert py.scores(table([(1, "a", True)]).limit(0)).count() == 0
    got = {r["doc_id"]: r for r in py.scores(table([(1, "some words again " * 80_000, False), (2, "x" * 1_000_000, False), (3, "some words", True)]), F.col("out")).collect()}
    assert got[1]["n_tokens"] == 240_001 and got[3]["score"] > got[3]["base_score"]
