import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eluent.llm import ann, chat, decontam, langid, mixing, rollups


def test_mixing(docs_of):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 30), f"s{r.choice([0, 0, 0, 0, 1, 2, 3])}") for i in range(600)] + [(700, None, "s1"), (None, "a b", "s1"), (701, "a b c", None), (701, "a b c", None)]
    docs = docs_of(rows)
    got = mixing.decisions(docs).collect()
    assert len(got) == len(rows) and all(g["taken"] <= 2 * g["size"] for g in got)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(size.values()), {}, set(names)
    while True:  # the excess over the caps is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    taken = {}
    for g in got:
        s = source[g["doc_id"], g["size"]]
        assert g["source_size"] == size[s] and g["target"] == pytest.approx(target[s])
        taken[s] = taken.get(s, 0) + g["taken"]
    assert all(abs(taken[s] - target[s]) <= max(30, 0.02 * target[s]) for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.decisions(docs).collect()))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).where("doc_id is not null").count() > 0
    assert mixing.decisions(docs_of([])).count() == 0
    assert [g["taken"] for g in mixing.decisions(docs_of([(1, "", "a")])).collect()] == [0]


def test_decontamination(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(30))
    cut = item.split()
    docs = docs_of([(1, f"x y {item} z"), (2, "far from it " * 50), (3, None), (4, ""), (5, item.upper()), (6, " ".join(cut[:26])), (7, " ".join(cut[:24])), (8, "tiny item"), (9, "a tiny item b"), (None, item), (1, "another row")])
    items = spark.createDataFrame([(0, item, 1), (1, None, 1), (2, "", 1), (3, "Tiny item", 1), (None, item, 1)], "item_id long, text string, doc_id long")
    got = sorted(map(tuple, decontam.leaks(docs, items).collect()))
    assert got == [(1, 0, 26, 26), (5, 0, 26, 26), (6, 0, 22, 26), (8, 3, 1, 1)]
    assert sorted(r["doc_id"] or -1 for r in decontam.clean(docs, items).collect()) == [-1, 2, 3, 4, 7, 9]
    assert decontam.leaks(docs_of([]), items).count() == 0
    assert decontam.leaks(docs, items.where("item_id > 9")).count() == 0


def test_decontamination_by_size_classes(spark, docs_of, monkeypatch):
    """More sketch hashes than are looked up one by one: short items above the bound and long ones below it, against exact containment."""
    monkeypatch.setattr(decontam, "BITS", 4096)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    texts = [[word() for _ in range(n)] for n in (5, 6, 7, 8, 20, 40, 80, 200, 3)]
    docs = []
    for k in range(60):
        t = list(r.choice(texts))
        if k % 3:
            t[r.randrange(len(t))] = word()
        docs.append((k, " ".join([word() for _ in range(r.randint(0, 9))] + t + [word() for _ in range(r.randint(0, 9))])))
    cut = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    want = sorted((k, i, len(cut(t) & cut(d.split())), len(cut(t))) for k, d in docs for i, t in enumerate(texts) if 100 * len(cut(t) & cut(d.split())) >= 80 * len(cut(t)))
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    assert len(want) > 25 and sorted(map(tuple, decontam.leaks(docs_of(docs), items).collect())) == want


def test_decontamination_of_many_short_items(spark, docs_of):
    """A document that holds a thousand items of five words, among as many that it does not hold."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = [" ".join(word() for _ in range(5)) for _ in range(2000)]
    docs = docs_of([(1, " ".join(texts[:1000])), (2, " ".join(word() for _ in range(20_000))), (3, texts[1500])])
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = decontam.leaks(docs, items).collect()
    assert sorted((g["doc_id"], g["item_id"]) for g in got) == [(1, i) for i in range(1000)] + [(3, 1500)] and all(g["n_shared"] == g["n_item"] == 1 for g in got)
    keys = decontam.sketches(items)
    assert [x["size"] for x in keys.select("size").distinct().collect()] == [0] and keys.count() == 2000


def test_a_short_quote_of_what_many_messages_say(spark):
    """Each of many messages holds the quoted word in a text of its own; it is met by the first of them."""
    n = 20_000
    rows = [(1, 0, "user", "Is it so?"), *((1, k, "user", f"yes, number {k}") for k in range(1, n)), (1, n, "assistant", "> number\n> yes\nWhy?"), (1, n + 1, "user", "> Yes.\nIndeed.")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {g["turn"]: g["parent"] for g in chat.linked(messages).where("parent is not null").collect()}
    assert got == {n + 1: 1}  # the two words of the other reply stand in no message in its order


def test_hilbert_is_a_path():
    n = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = ann.hilbert(cells, n)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_nearest(rows, every, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        d = np.min([np.sqrt(np.square(x - x[k]).sum(axis=1)) for k in np.flatnonzero(ids == q)], axis=0)
        best = {}
        for i, s in zip(ids.tolist(), d.tolist(), strict=True):
            if i != q:
                best[i] = min(best.get(i, np.inf), s)
        out[q] = sorted((s, i) for i, s in best.items())[:top]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[40:60] = x[40]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [1.0]), (1006, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = {}
    for g in ann.search(df).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["score"], g["vec_id"]))
    want = brute_nearest(rows, 100, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([k for k, _, _ in sorted(v)] == list(range(1, 11)) and sorted((s, i) for _, s, i in v) == [(s, i) for _, s, i in sorted(v)] for v in got.values())
    few = ann.search(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(g["query_id"], g["rank"]) for g in sorted(few, key=lambda g: g["rank"])] == [(0, 1), (0, 2)]
    assert ann.search(df.where("vec_id > 1000")).count() in (0, 10)
    assert ann.search(df.limit(0)).count() == 0


def test_neighbours_seen_by_narrow_windows(spark, monkeypatch):
    """Vectors around a few hundred centres: a query meets under a fifth of the rows, and recall stays above 0.9."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((300, 32))
    x = centres[r.integers(0, 300, 6000)] + 0.15 * r.standard_normal((6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "CURVES", 8)
    seen = ann.CURVES * 0.02
    assert seen < 0.2
    got = {}
    for g in ann.search(df, reach=0.02).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    want = brute_nearest(rows, 100, 10)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_evenly_spread_vectors(spark):
    """The registered parameters, where no direction stands out: what the given vectors are like."""
    r = np.random.default_rng(6)
    x = r.standard_normal((3000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    got = {}
    for g in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    want = brute_nearest(rows, 100, 10)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("top", [10, 25])
def test_neighbours_of_repeated_ids(spark, top):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in [*range(200)] * 2]
    near = np.array(rows[100][1])
    rows += [(7, (near + 0.01 * r.standard_normal(8)).tolist()) for _ in range(30)] + [rows[3]] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for g in ann.search(df, top=top).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["score"], g["vec_id"]))
    want = brute_nearest(rows, 100, top)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all([s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]]) for q in want)


WORDS = {"en": "the and of with thing house water", "de": "der und die haus wasser nicht schön", "fr": "le et la maison avec eau être", "es": "el y la casa con agua niño"}


def test_language(spark):
    r = random.Random(1)
    say = lambda lang, n: " ".join(r.choice(WORDS[lang].split()) for _ in range(n))
    rows = [(i, say(lang, 40), lang, "h") for i, lang in enumerate(list(WORDS) * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en", "h"), (901, "123 !!", "fr", None), (902, say("de", 40), None, None), (903, say("es", 60), "en", "h"), (None, say("en", 20), "en", "h"), (904, "x" * 100_000, "en", "h")], "doc_id long, text string, lang string, source string")
    got = {g["id"]: g for g in langid.identify_documents(docs).collect()}
    assert all(got[i]["lang"] == lang for i, _, lang, _ in rows)
    assert got[900]["lang"] is None and got[901]["lang"] is None and got[902]["lang"] == "de" and got[903]["best"] == "es" and got[None]["lang"] == "en"
    assert langid.identify_documents(docs.limit(0)).count() == 0


def test_other_languages_and_gibberish(spark):
    r = random.Random(3)
    say = lambda words, n: " ".join(r.choice(words.split()) for _ in range(n))
    gibberish = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(60))
    clean = [(i, say(WORDS[lang], 40), lang, "h") for i, lang in enumerate(list(WORDS) * 30)]
    foreign = {900: say("talo oli pieni mutta kaunis puutarha", 40), 901: say("dom był mały ale piękny ogród", 40), 902: say("küçük evin güzel bahçesi çocuklar oynuyor", 40), 903: gibberish, 904: "x" * 1000, 905: say("дом был маленький сад", 40)}
    both = {910 + i: say(WORDS[a], 20) + " " + say(WORDS[b], 20) for i, (a, b) in enumerate([("en", "de"), ("fr", "es"), ("en", "fr"), ("de", "es")])}
    schema = "doc_id long, text string, lang string, source string"
    model = langid.fit(spark.createDataFrame(clean, schema).selectExpr("doc_id as id", "text", "lang"))
    for declared in (None, "en"):
        rows = [*clean, *((i, t, declared, "h") for i, t in {**foreign, **both}.items())]
        got = {g["id"]: g for g in langid.identify_documents(spark.createDataFrame(rows, schema), model).collect()}
        assert all(got[i]["lang"] == lang for i, _, lang, _ in clean)
        assert [i for i in foreign if got[i]["lang"] is not None] == []
        assert [i for i in both if got[i]["lang"] is None] == []
    alone = langid.fit(spark.createDataFrame(clean, schema).where("lang = 'de'").selectExpr("doc_id as id", "text", "lang"))
    got = {g["id"]: g["lang"] for g in langid.identify_documents(spark.createDataFrame([*clean[:4], (903, gibberish, None, "h")], schema), alone).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 903)] == [None, "de", None, None, None]


def test_pages(spark):
    train = spark.createDataFrame([(i, f"{WORDS[k]} " * 5, k) for i, k in enumerate(WORDS)], "id long, text string, lang string")
    model = langid.fit(train)
    pages = [(i, f"https://www.h{k}.example.{k}:80/x?y", f'<!DOCTYPE html><html lang="{k}-XX"><style>the and</style><body><p>{WORDS[k]} &amp; {WORDS[k]}</p><script>of with</script></body></html>') for i, k in enumerate(WORDS)]
    df = spark.createDataFrame([*pages, (10, None, None), (11, "nonsense", "<html><p>der und die haus wasser nicht</p>"), (12, "https://a.example.de/", "<p></p>")], "page_id long, url string, html string")
    got = {g["id"]: g["lang"] for g in langid.identify(langid.evidence_of_pages(df), model, markup=True).collect()}
    assert got == {**{i: k for i, k in enumerate(WORDS)}, 10: None, 11: "de", 12: None}
    host = langid.evidence_of_pages(df).where("id = 1").first()
    assert (host["declared"], host["suffix"], host["domain"], host["host"]) == ("de", "de", "example.de", "www.hde.example.de")


def test_quotes(spark):
    rows = [
        (1, 0, "a", "First point.\nSecond  Point."), (1, 1, "b", "Other thread."), (1, 2, "c", "On Monday a wrote:\n> first POINT.\nI agree."),
        (1, 3, "a", "c wrote:\n> I agree.\n>> First point.\nThanks."), (1, 4, "d", "> nowhere said\nHm."), (1, 5, "e", "> > Second point.\nMore."), (1, 6, "f", "> Other thread.\n> Other thread.\n> First point.\nBoth."),
        (2, 0, "a", None), (None, 0, "a", "lost"), (2, None, "b", "no turn"), (2, 0, "a", None),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {(g["conv_id"], g["turn"]): g for g in chat.linked(df).collect()}
    assert len(got) == 9
    assert {t: got[1, t]["parent"] for t in range(7)} == {0: None, 1: None, 2: 0, 3: 2, 4: None, 5: 0, 6: 1}
    assert [t for _, t in sorted((got[1, t]["position"], t) for t in range(7))] == [0, 2, 3, 5, 1, 6, 4]
    assert (got[1, 3]["root"], got[1, 3]["depth"]) == (0, 2)
    assert got[1, 2]["text"] == "I agree." and got[1, 3]["text"] == "Thanks." and got[2, 0]["text"] == "" and got[2, -1]["position"] == 0
    parts = chat.conversations(df, 3).orderBy("conv_id", "part").collect()
    assert [(p["conv_id"], p["part"], p["n_messages"]) for p in parts] == [(1, 0, 3), (1, 1, 3), (1, 2, 1), (2, 0, 2)]
    assert parts[0]["chat"] == "<|a|>\nFirst point.\nSecond  Point.\n<|c|>\nI agree.\n<|a|>\nThanks."
    assert chat.conversations(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, i, "a", f"line {i}" + (f"\n> line {i - 1}" if i else "")) for i in range(70)]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(g["depth"] == g["turn"] == g["position"] and g["root"] == 0 for g in got)


def test_wrapped_and_partial_quotes(spark):
    long = "The first paragraph has one sentence about water, stones and rivers. Its second sentence tells of an old house by the sea! A third one ends it."
    rows = [
        (0, long), (1, "Nothing in common here. The old house stood empty."), (2, "> The first paragraph has one sentence\n> about water, stones and\n> rivers. Its second sentence tells\n> of an old house by the sea!\nWrapped."),
        (3, "> tells of an old house by the sea\nPart of a line."), (4, "> old house stood\nA few words."), (5, "> of an old house by the lake\nA changed word."),
        (6, ">> second sentence tells of an\n>> old house\n> Part of\n> a line.\nTwo levels."), (7, "> house by\n\n> the sea\nTwo passages."), (8, "> tory of an old hou\nParts of words."), (9, "> never said before this turn\nx"), (10, "never said before this turn"),
    ]
    df = spark.createDataFrame([(1, t, "a", x) for t, x in rows] + [(2, 0, "a", "> tells of an old house by the sea")], "conv_id long, turn long, role string, text string")
    got = {(g["conv_id"], g["turn"]): g["parent"] for g in chat.linked(df).collect()}
    assert [got[1, t] for t in range(11)] == [None, None, 0, 0, 1, None, 3, 0, None, None, None]
    assert got[2, 0] is None


def brute_chat(rows, part):
    """(conv_id, part, turns, chat) by plain walks over each conversation."""
    wrote = re.compile(chat.WROTE)
    level = lambda x: len(re.match(r"(?:[ \t]*>)*", x)[0].replace(" ", "").replace("\t", ""))
    normal = lambda x: re.sub(r"\s+", " ", re.sub(r"^(?:[ \t]*>)*", "", x).lower()).strip(" ")
    words = lambda x: " ".join(re.sub(r"[^\w]|_", " ", x.lower()).split())
    rows = {(c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c is not None}
    out = []
    for conv in sorted({r[0] for r in rows}):
        said = []
        for _, turn, role, text in sorted(r for r in rows if r[0] == conv):
            lines = re.split(r"\r?\n", text)
            own = [x for i, x in enumerate(lines) if level(x) == 0 and not (wrote.match(x) and i + 1 < len(lines) and level(lines[i + 1]) > 0)]
            said.append((turn, role, lines, "\n".join(own).strip(" ")))
        parent, first = {}, {}
        for turn, _, lines, _ in sorted(said, key=lambda m: m[0]):
            for x in lines:
                if level(x) == 0 and normal(x):
                    first.setdefault(normal(x), turn)
        votes = {}
        for turn, _, lines, _ in said:
            passages, last = [], None
            for i, x in enumerate(lines):
                if level(x) == 0 or not normal(x):
                    continue
                at = first.get(normal(x))
                if at is not None and at < turn:
                    votes.setdefault(turn, []).append((level(x), at))
                elif last == (i - 1, level(x)):
                    passages[-1][1].append(normal(x))
                    last = (i, level(x))
                else:
                    passages.append((level(x), [normal(x)]))
                    last = (i, level(x))
            for k, parts in passages:
                for sentence in re.split(r"(?<=[.!?…])\s+", " ".join(parts)):
                    if unit := words(sentence):
                        found = [t for t, _, _, own in said if f" {unit} " in f" {words(own)} "]
                        if found and min(found) < turn:
                            votes.setdefault(turn, []).append((k, min(found)))
        for turn, v in votes.items():
            low = min(k for k, _ in v)
            count = {at: sum(x == (low, at) for x in v) for _, at in v if (low, at) in v}
            parent[turn] = max(count, key=lambda at: (count[at], at))
        answers = {}
        for turn, at in parent.items():
            answers.setdefault(at, []).append(turn)
        order, todo = [], sorted({m[0] for m in said} - parent.keys(), reverse=True)
        while todo:
            t = todo.pop()
            order.append(t)
            todo += sorted(answers.get(t, []), reverse=True)
        flat = [(m[0], m[1], m[3]) for t in order for m in said if m[0] == t]
        for i in range(0, len(flat), part):
            out.append((conv, i // part, [m[0] for m in flat[i : i + part]], "\n".join(f"<|{r}|>\n{x}" for _, r, x in flat[i : i + part])))
    return out


def test_history_against_plain_walks(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    schema = "conv_id long, turn long, role string, text string"
    odd = spark.createDataFrame([(5, None, None, None), (5, 1, "user", "One line.\n\n> quoted"), (5, 1, "user", "One line.\n\n> quoted"), (5, 3, "user", ""), (7, 3, "a", "two words. " * 60), (7, 5, "a", "one")], schema)
    messages = table.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id > 10").union(odd)
    said = chat.history(messages)
    assert said.count() > 1.3 * messages.count() and messages.exceptAll(said).where("turn is not null and text is not null and role is not null").isEmpty()
    linked = chat.linked(said).where("parent is not null")
    assert linked.where(f"turn >= {chat.LATER}").count() > 30 and linked.where("depth = 2").count() > 15
    got = [(p["conv_id"], p["part"], p["turns"], p["chat"]) for p in chat.conversations(said, 7).orderBy("conv_id", "part").collect()]
    assert got == brute_chat([tuple(r) for r in said.collect()], 7)


def test_long_messages(spark):
    rows = [(1, 1, "a", "two words. " * 60_000), (1, 3, "b", "no end " * 80_000), (1, 5, "c", "> no end no end no end no end no end no end no end\nYes.")]
    began = time.time()
    got = chat.linked(chat.history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert time.time() - began < 90 and len(got) == 9
    assert {g["turn"]: g["parent"] for g in got if g["turn"] < 6} == {1: None, 3: None, 5: 3}


def test_two_messages_of_one_turn_and_equal_votes(spark):
    rows = [(1, 0, "a", "alpha one"), (1, 0, "b", "beta two"), (1, 1, "c", "gamma three"), (1, 2, "d", "> alpha one\n> gamma three\nBoth."), (1, 3, "e", "> beta two\nOf the second.")]
    df = spark.createDataFrame(rows + [(None, 3, "e", "> beta two")] + rows[:1], "conv_id long, turn long, role string, text string")
    got = {(g["turn"], g["role"]): g["parent"] for g in chat.linked(df).collect()}
    assert got == {(0, "a"): None, (0, "b"): None, (1, "c"): None, (2, "d"): 1, (3, "e"): 0}


def test_threads_of_a_long_chain_and_a_tree(spark):
    r = random.Random(4)
    tree = {i: r.choice([r.randrange(i), i - 1, 0]) for i in range(1, 150)}
    rows = [(1, i, i - 1) for i in range(1, 2000)] + [(2, i, p) for i, p in tree.items()] + [(2, 300 + i, 299 + i) for i in range(1, 4)]
    df = chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, parent long"))
    assert {f.dataType.simpleString() for f in df.schema} == {"bigint"}  # nothing grows with the depth
    got = {(g["conv_id"], g["turn"]): tuple(g)[2:] for g in df.collect()}
    want, place, todo = {(1, i): (i - 1 if i else None, 0, i, i) for i in range(2000)}, 0, [(0, None, 0)]
    while todo:
        t, parent, depth = todo.pop()
        want[2, t] = (parent, 0, depth, place)
        place += 1
        todo += [(c, t, depth + 1) for c in sorted((c for c, p in tree.items() if p == t), reverse=True)]
    want |= {(2, 300 + i): (299 + i if i else None, 300, i, i) for i in range(4)}
    assert got == want


def test_rollups(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    change = lambda *rows: spark.createDataFrame(list(rows), schema)
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = change(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", 7, None), ("insert", "b", "en", "v1", None, None))
    assert r.commit(1, first) and not r.commit(1, first)
    assert r.commit(2, change(("delete", "a", "en", "v1", 5, None), ("delete", "b", "en", "v1", 0, None), ("revise", None, "en", "v1", 9, 7)))
    assert r.commit(3, change())
    assert sorted(map(str, map(tuple, r.totals().collect()))) == ["('a', 'en', 'v1', 1, 10)", "(None, 'en', 'v1', 1, 9)"]
    (tmp_path / "r" / "batch=4").mkdir()
    (tmp_path / "r" / "batch=4" / "part-0.parquet").write_bytes(b"broken off")
    assert r.commit(4, change(("insert", "a", "en", "v1", 1, None))) and r.totals().where("source = 'a'").first()["tokens"] == 11
    with pytest.raises(ValueError, match="other changes"):
        r.commit(2, change(("delete", "a", "en", "v1", 4, None)))
    before = sorted(map(str, r.totals().collect()))
    r.compact()
    assert sorted(map(str, r.totals().collect())) == before and not r.commit(1, first)
    assert r.commit(5, change(("insert", "c", "de", "v1", 3, None), ("insert", "c", "de", "v1", 3, None)))
    assert r.totals().where("source = 'c'").first()["docs"] == 2
    r.compact()
    assert sorted(map(str, r.totals().collect())) == sorted([*before, *map(str, r.totals().where("source = 'c'").collect())])
    with pytest.raises(Exception, match="unknown op"):
        r.commit(6, change(("upsert", "a", "en", "v1", 1, None)))


def test_rank(spark):
    from eluent.llm import common

    rows = [(i % 7, i) for i in range(500)]
    got = common.with_rank(spark.createDataFrame(rows, "a int, b int"), [F.col("a"), F.col("b")], "r", {"before": F.col("b")}).orderBy("r").collect()
    total = 0
    for k, ((a, b), g) in enumerate(zip(sorted(rows), got, strict=True)):
        assert tuple(g) == (a, b, k, total)
        total += b
