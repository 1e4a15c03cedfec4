import random

import numpy as np
import pytest

from eluent.llm import common, graph, ngram_join


def brute(rows):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    at = {i: i for i, _ in rows if i is not None}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                at[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(a), root(i) if i is not None else -1) for i, a in sets)


def run(docs):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in ngram_join.components(docs).collect())


def test_against_brute_force(docs_of):
    r = random.Random(1)
    word = lambda: r.choice("abcdefghij") + r.choice("klmno")
    rows = [(0, None), (1, ""), (2, "   "), (3, "one two"), (4, "One TWO"), (5, "one two three"), (6, "É a b c d"), (7, "é a b c d"), (None, "one two"), (8, "x " * 3000)]
    for f in range(6):
        base = [word() for _ in range(r.choice([6, 12, 40, 150]))]
        for _ in range(6):
            t = list(base)
            for _ in range(r.randint(0, len(base) // 20 + 1)):
                t[r.randrange(len(t))] = word()
            rows.append((len(rows) + 10 * f, " ".join(t)))
    rows.append(rows[-1])  # a repeated row
    assert run(docs_of(rows)) == brute(rows)


def test_hot_group_and_common_passage(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(3))
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for _ in range(40):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = word()
        rows.append((len(rows), " ".join(t)))
    rows += [(100 + i, " ".join([word() for _ in range(50)] + passage)) for i in range(25)]
    rows += [(200 + i, rows[0][1]) for i in range(10)]
    assert run(docs_of(rows)) == brute(rows)


def test_empty(docs_of):
    assert run(docs_of([])) == []


@pytest.mark.parametrize("n", [1, 4, 5, 9, 37, 400])
def test_bands_agree_somewhere(n):
    r = np.random.default_rng(n)
    a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
    for m in range(n, n * 100 // 80 + 1):
        shared = -(-4 * (n + m) // 9)
        if shared > min(n, m):
            continue
        b = np.unique(np.concatenate([a[:shared], r.integers(0, 2**63, m - shared).astype(np.uint64)]))
        common_levels = set(ngram_join.levels(len(a))) & set(ngram_join.levels(len(b)))
        assert any(set(ngram_join.bands(a, k).tolist()) & set(ngram_join.bands(b, k).tolist()) for k in common_levels)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(7, 7)] + [(i, i + 1) for i in range(600, 640)]
    at = {x: x for e in links for x in e}
    for _ in at:
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: v for k, v in at.items() if any(k in e and e[0] != e[1] for e in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_are_stable():
    known = common.WordHash()
    assert (common.shingles(b"A b c D e f", known) == common.shingles(b"a B c d e f", common.WordHash())).all()
    assert len(common.shingles(b"a a a a a a a", known)) == 1


def _copies(r, base, n, changes, word):
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, changes)):
            t[r.randrange(len(t))] = word()
        yield " ".join(t)


def test_hot_versions_that_stars_leave_apart(docs_of, monkeypatch):
    """A text, a version of it that drifts away in steps, and copies of both: some links run between copies that no centre reaches."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SALTED", 5)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(3))
    rows, base = [], [word() for _ in range(70)]
    for _ in range(6):
        rows += _copies(r, base, 14, 4, word)
        base = base[3:] + [word() for _ in range(3)]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(rows)]
    assert run(docs_of(rows)) == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """20,000 near copies are told apart from what drifted too far, by a comparison of all for the brute-force side."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(3000)]
    base = [r.choice(words) for _ in range(200)]
    rows = list(enumerate(_copies(r, base, 20_000, 4, lambda: r.choice(words))))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    sets = [frozenset(map(hash, zip(*(w[k:] for k in range(5)), strict=False))) for w in (t.split() for _, t in rows)]
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert sorted(got) == list(range(20_000))
    first = min(range(20_000), key=lambda i: len(sets[i] ^ frozenset(map(hash, zip(*(base[k:] for k in range(5)), strict=False)))))
    near = {i for i, s in enumerate(sets) if link(s, sets[first])}
    assert len(near) > 15_000 and len({got[i] for i in near}) == 1
    for i in [i for i in got if got[i] != got[first]][:20]:  # what is apart links with nothing in the large group
        assert not any(link(sets[i], s) for j, s in enumerate(sets) if got[j] == got[first])
