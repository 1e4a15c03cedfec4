"""Language ID against a plain fusion of the same evidence, and on held-out rows."""

import math
import time

import pytest
from pyspark.sql import functions as F

from eluent.llm import langid, queries

DATA = "/root/testdata/sf0.001"


def plain(rows, model, markup):
    """id -> (lang, best, posterior) of (id, text, declared, suffix, domain, host), one row after the other."""
    score, k = langid._scorer(model), len(model.languages) + 1
    scored = []
    for i, text, *seen in rows:
        text = text or ""
        g = langid._grams((langid.page_text(text) if markup else text).encode())
        s = score(g).tolist() if len(g) else None
        scored.append((i, s, s.index(max(s)) if s else None, dict(zip(("declared", "suffix", "domain", "host"), seen, strict=True))))
    total = [sum(c == j for _, _, c, _ in scored) for j in range(k)]
    counts = {}
    for _, _, c, seen in scored:
        for level, v in seen.items():
            if c is not None and v is not None:
                counts.setdefault((level, v), [0] * k)[c] += 1
    kinds = {level: len({v for lv, v in counts if lv == level}) or 1 for level in ("declared", "suffix")}
    out = []
    for i, s, c, seen in scored:
        if s is None:
            out.append((i, None, None, None))
            continue
        own = [float(j == c) for j in range(k)]
        of = lambda level: [n - o for n, o in zip(counts[level, seen[level]], own, strict=True)] if (level, seen[level]) in counts else [0.0] * k  # noqa: B023, E731
        prior = [(total[j] - own[j] + 1) / (sum(total) + k - 1) for j in range(k)]
        for level in ("suffix", "domain", "host"):
            n = of(level)
            prior = [(n[j] + langid.SMOOTHING * prior[j]) / (sum(n) + langid.SMOOTHING) for j in range(k)]
        logs = []
        for j in range(k):
            x = s[j] + math.log(prior[j])
            for level in ("declared", "suffix"):
                if seen[level] is not None:
                    x += math.log((of(level)[j] + langid.SMOOTHING / kinds[level]) / (total[j] - own[j] + langid.SMOOTHING))
            logs.append(x)
        known = logs[:-1]
        top = max(known)
        share = sum(math.exp(x - top) for x in known)
        of_known, in_known = 1 / share, 1 / (1 + math.exp(min(logs[-1] - top, 700)) / share)
        best = model.languages[known.index(top)]
        out.append((i, best if min(of_known, in_known) >= langid.LEAST else None, best, of_known * in_known))
    return out


def compared(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "", r[3] or 0)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)


def test_query_against_plain_fusion(spark):
    docs, pages = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/pages.parquet")
    model = langid.fit(docs.selectExpr("doc_id as id", "text", "lang"))
    found = queries.op3_language_id(spark, DATA).collect()
    for column, evidence, markup in (("doc_id", langid.evidence_of_documents(docs), False), ("page_id", langid.evidence_of_pages(pages), True)):
        rows = [tuple(r) for r in evidence.select("id", "text", "declared", "suffix", "domain", "host").collect()]
        compared([(r[column], r["lang"], r["best"], r["posterior"]) for r in found if r[column] is not None], plain(rows, model, markup))


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 40")
    model = langid.fit(docs.where("doc_id % 2 = 0").selectExpr("doc_id as id", "text", "lang"))
    got = langid.identify_documents(docs.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string")), model)
    right = got.join(docs.selectExpr("doc_id as id", "lang as real"), "id").agg(F.avg((F.col("best") == F.col("real")).cast("double")), F.avg(F.col("lang").isNotNull().cast("double"))).first()
    assert right[0] >= 0.97 and right[1] >= 0.97


def test_languages_come_from_the_labels_and_ties(spark):
    say = {"xx": "blem vorg quist ", "yy": "onda trill mape ", "aa": "kuri solm besk "}
    rows = [(i, w * 15, k, "h") for i, (k, w) in enumerate(list(say.items()) * 10)] + [(100, "blem vorg quist onda trill mape " * 8, None, None), (100, "blem vorg quist onda trill mape " * 8, None, None), (101, "", "xx", "h"), (None, say["yy"] * 9, "yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("id", "scores", "choice", "host", "declared", "prior", "n_host", "logs", "known", "top")})
    got = langid.identify_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["lang"])
    assert all(by[i] == [k] for i, k in enumerate(list(say) * 10)) and by[101] == [None] and by[None] == ["yy"]
    assert len(by[100]) == 2 and len({str(r) for r in got if r["id"] == 100}) == 1
    none = spark.createDataFrame([(1, "blem vorg", None, "h")], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in langid.identify_documents(none).collect()] == [(1, None, None, None)]


def test_pages_that_do_not_end(spark):
    for markup in ("<" * 1_000_000, "<script>" * 120_000, "<!-- " * 200_000, "<style>a" * 120_000 + ">", "a<b" * 300_000, "</script" + " " * 1_000_000):
        began = time.time()
        langid.page_text(markup)
        assert time.time() - began < 5
    assert langid.page_text("a<b>c</b><!-- x > y -->d<script>var x = '<p>';</script >e<STYLE>f</style>g < h") == "a c  d e g  < h"
    assert langid.page_text("one <script> two > three") == "one   two > three" and langid.page_text("one <!-- two > three") == "one   three"
    assert langid.evidence_of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
