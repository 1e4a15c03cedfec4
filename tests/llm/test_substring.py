import hashlib
import random

from eluent.llm import substring


def brute(rows, n=13):
    seen = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            if i is not None:
                seen[tuple(w[k : k + n])] = min(seen.get(tuple(w[k : k + n]), i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and seen[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def run(docs):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, substring.dedup(docs).collect()))


def test_against_brute_force(docs_of):
    r = random.Random(1)
    word = lambda: r.choice("abc") + r.choice("dé")
    passages = [" ".join(word() for _ in range(n)) for n in (12, 13, 14, 30, 60)]
    rows = [(0, None), (1, ""), (2, "a\tb\n\nc"), (None, passages[3]), (3, "w " * 400), (4, "w " * 300)]
    for i in range(40):
        parts = [" ".join(str(r.random()) for _ in range(r.randint(0, 9))), r.choice(passages), " ".join(str(r.random()) for _ in range(4)), r.choice(passages)]
        rows.append((10 + r.randrange(60) if i % 4 else 100 + i, " ".join(parts)))
    rows += [(300 + i, rows[-1][1]) for i in range(5)] + [rows[-2]]
    assert run(docs_of(rows)) == brute(rows)


def test_short_documents_stay(docs_of):
    rows = [(i, "a b c d e f g h i j k l") for i in range(5)]
    assert run(docs_of(rows)) == brute(rows)
    assert run(docs_of([])) == []


def _planted(seed):
    """Passages of 6 to 400 words that repeat across documents, whole, cut short and between other words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (6, 12, 13, 25, 26, 27, 60, 120, 400)]
    rows = []
    for i in range(36):
        p = passages[i % 9]
        k = r.randint(0, len(p) // 8) if i > 17 else 0
        rows.append((7 * i % 36, " ".join([word() for _ in range(r.randint(0, 30))] + p[k:] + [word() for _ in range(r.randint(0, 30))])))
    return rows + [(50, "w " * 1000), (51, "w " * 900), (52, None), (None, rows[0][1]), (53, rows[8][1]), (54, "x y z")]


def test_passages_of_6_to_400_words(docs_of):
    rows = _planted(4)
    assert run(docs_of(rows)) == brute(rows)


def test_other_windows(docs_of):
    rows = _planted(5)
    for n in (1, 5, 27):
        got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, substring.dedup(docs_of(rows), n).collect()))
        assert got == brute(rows, n)


def test_longest_doubles_until_nothing_repeats(docs_of):
    rows = _planted(6)
    expected, length, left = {}, 13, True
    while left:
        holders = {}
        for i, t in rows:
            w = (t or "").split()
            for k in range(len(w) - length + 1):
                if i is not None:
                    holders.setdefault(tuple(w[k : k + length]), set()).add(i)
        left = {i for x in holders.values() if len(x) > 1 for i in x}
        expected.update(dict.fromkeys(left, length))
        length *= 2
    assert dict(map(tuple, substring.longest(docs_of(rows)).collect())) == expected
    assert max(expected.values()) >= 208


def test_levels():
    assert substring.levels(13) == [6, 13] and substring.levels(52) == [6, 13, 26, 52] and substring.levels(5) == [5]
