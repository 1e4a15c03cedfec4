"""Source divergence audit against a plain version, and its parts on their own."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eluent.llm import divergence


def plain(rows, top=200):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in words:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        groups = [s for x, s in counts if x == lang]

        def price(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = price(counts[lang, source])
        f = lambda a, b: (a - b) ** 2 // b
        pair = []
        for other in groups:
            if other != source:
                q = price(counts[lang, other])
                pair.append((-sum(f(p[t], q[t]) for t in kept), other.encode(), other))
        whole = price(sum((counts[lang, s] for s in groups), Counter()))
        term = [(-f(p[t], whole[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        out += [(lang, source, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pair))]
        out += [(lang, source, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(term)[:top])]
    return sorted(out)


@pytest.fixture
def table(spark):
    def make(rows):
        rows = [(i, *r, "x", 7) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n int").repartition(3)

    return make


def test_against_plain_version(table):
    rng = np.random.default_rng(3)
    names = [f"w{chr(97 + i)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ÉTÉ", "STRASSE", "straße", "z"]
    rows = [(" ".join(rng.choice(names, rng.integers(0, 40), p=np.arange(1, 66) / sum(range(1, 66)))), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 5)}") for _ in range(120)]
    rows += [(None, None, None), ("", "en", None), ("alone", "de", "only"), ("wa wa-wa_wa1wa", None, "s1"), ("12 34", "xx", "a"), ("!", "xx", "b"), *[("same text " * 50, "en", "s1")] * 30]
    want = plain(rows)
    for section in (1 << 16, 7):  # the second cuts each language into many sections
        assert sorted(map(tuple, divergence.audit(table(rows), section=section).collect())) == want
    assert sorted(map(tuple, divergence.audit(table(rows), top=4).collect())) == plain(rows, 4)


def test_empty_tables_and_long_texts(table):
    assert divergence.audit(table([]).limit(0)).count() == 0
    long = "many Words of one kind " * 50_000
    rows = [(long, "en", "a"), (long + "more", "en", "b"), (long, "en", "b"), ("x" * 1_000_000, "en", "a")]
    assert sorted(map(tuple, divergence.audit(table(rows)).collect())) == plain(rows)


def test_galloping_finds_what_is_there():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1000), (1000, 1000), (700, 100_000)):
        a, b = (np.sort(rng.choice(2 * max(n, m, 1), k, replace=False)) for k in (n, m))
        at = divergence.gallop(a, b)
        assert [(x, int(b[i]) if i >= 0 else None) for x, i in zip(a.tolist(), at, strict=True)] == [(x, x if x in set(b.tolist()) else None) for x in a.tolist()]


def test_prices_do_not_overflow():
    counts = np.array([0, 1, 10**12, 10**15 - 5])
    assert divergence.prices(counts, 10**15, 10**6).tolist() == [1 + 10**9 * (int(c) + 1) // (10**15 + 10**6) for c in counts]
    assert divergence.prices(np.array([6]), 6, 1).tolist() == [10**9 + 1]


def test_counts_handed_on_in_parts_add_up(table):
    batches = table([("a b a", "en", "s"), ("b c", "en", "t"), ("c", "fr", "s")] * 5).select("lang", "source", "text").coalesce(1).toArrow().to_batches()
    for most in (1, 4, 1000):
        n, docs = Counter(), Counter()
        for b in divergence._counted(iter(batches), most):
            for r in b.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        assert n == {("en", "s", "a"): 10, ("en", "s", "b"): 5, ("en", "t", "b"): 5, ("en", "t", "c"): 5, ("fr", "s", "c"): 5} and set(docs.values()) == {5}
