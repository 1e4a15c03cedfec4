"""Language identification by Bayesian evidence fusion.

Evidence for a row: its text, the language that its markup declares, the suffix of its address, and its host. A text model (character
trigrams, multinomial) gives likelihoods of the languages that the labelled rows are in; it is fitted on a sample of at most ``SAMPLE`` of them. Over all rows,
grouped counts of the text model's own choices then give how often a language comes with a declaration or a suffix, and a prior for each host, smoothed towards its
domain, that towards its suffix, and that towards the whole corpus. A row's own choice is taken out of all of these counts before they judge it, so that
its text counts once. The logarithms add up to a posterior.

A further hypothesis, 'other', stands for any other language and for gibberish. Its text model is the flattened background of the known ones
(square roots of their mean probabilities), and it has counts and priors like the others. It is held against the best mixture of them,
so that a text in two of them is no stranger.

Neighbouring trigrams depend on each other, so that log likelihoods are tempered: each trigram counts as ``TEMPER`` of an independent one, in texts of any length.
Texts of no letters carry no likelihood; a missing declaration, suffix or host adds nothing. Rows without letters are rejected (language null),
as are rows whose known languages together, or whose best among them, have a posterior below ``LEAST``. The posterior given
is that of the best of them among all. A null text is empty. Ties go to the language first in
alphabetical order. Rows with null ids and repeated rows are judged each for itself. Without any labelled row all are rejected. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows the text model is fitted on, buckets of trigrams, and the least posterior.
SAMPLE, BUCKETS, SEED, LEAST = 4_000, 1 << 14, 11, 0.5
#: Independent trigrams that one trigram of a text counts as.
TEMPER = 0.5
#: Rows' worth of trust in the level above: host in domain, domain in suffix, suffix in corpus; and in an even spread.
SMOOTHING = 20.0
#: Rounds of expectation maximisation for the mixture of a text's languages.
ROUNDS = 8


class Model(NamedTuple):
    """Languages in alphabetical order, and their log likelihoods (languages x buckets)."""

    languages: tuple[str, ...]
    logs: np.ndarray


def _grams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams with a letter in them, of text whose runs of other bytes are one blank."""
    x = np.frombuffer(b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower())) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.int64)
    g = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]).astype(np.uint64)
    return (common.mixed(g) >> np.uint64(64 - 14)).astype(np.int64)


def fit(labelled: DataFrame) -> Model:
    """The text model of rows (id, text, lang); the sample is the ``SAMPLE`` rows of the smallest id hashes. Its languages are the model's."""
    known = labelled.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("id").isNotNull())
    sample = known.select("id", "lang").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE)
    ids = common.saved(sample, "sample")
    languages = tuple(sorted(r["lang"] for r in ids.select("lang").distinct().collect()))  # of at most SAMPLE rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in common.batches(it, 500):
            for x, lang in zip(common.text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                if lang in place:
                    counts[place[lang]] = counts.get(place[lang], 0) + np.bincount(_grams(x), minlength=BUCKETS)
        for i, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(i * BUCKETS + at), pa.array(n[at])], names=["at", "n"])

    place = {lang: i for i, lang in enumerate(languages)}
    rows = known.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi").select("text", "lang").mapInArrow(run, "at long, n long")
    counts = np.full(len(languages) * BUCKETS, 0.5)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most languages x buckets
        counts[r["at"]] += r["n"]
    counts = counts.reshape(len(languages), BUCKETS)
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


_RAW = re.compile(r"<(script|style)\b", re.IGNORECASE)
_CLOSING = {k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style")}


def page_text(markup: str) -> str:
    """What stands outside of tags, comments, scripts and styles. Ends that are missing are looked for once, so that a page is read a fixed number
    of times, however malformed it is."""
    out, at, missing = [], 0, set()

    def after(end: str, start: int) -> int:
        if end in missing:
            return -1
        if end in _CLOSING:
            found = _CLOSING[end].search(markup, start)
            place = found.end() if found else -1
        else:
            place = markup.find(end, start)
            place += len(end) if place >= 0 else 0
        if place < 0:
            missing.add(end)
        return place

    while (tag := markup.find("<", at)) >= 0:
        out.append(markup[at:tag])
        raw, end = _RAW.match(markup, tag), -1
        if raw:
            end = after(raw[1].lower(), tag)
        elif markup.startswith("<!--", tag):
            end = after("-->", tag + 4)
        if end < 0:
            end = after(">", tag)
        if end < 0:  # no tag ends any more
            at = tag
            break
        at = end
    out.append(markup[at:])
    return html.unescape(" ".join(out))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """id, markup, declared, suffix, domain, host of pages (page_id, url, html)."""
    url = F.lower(F.col("url").cast("string"))
    host = F.nullif(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    declared = F.lower(F.regexp_extract(F.col("html").cast("string"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("id"), F.col("html").cast("string").alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), host.alias("host"),
    )


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, text, lang, source): the language they come with is the declared one, their source the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host"))


def _scorer(model: Model):
    """Scores of the languages and 'other' for the buckets of a text."""
    known = np.exp(model.logs)
    root = np.sqrt(known.mean(axis=0))
    background = np.log(root / root.sum())

    def score(g: np.ndarray) -> np.ndarray:
        n, evidence = np.bincount(g, minlength=BUCKETS), TEMPER * len(g)
        at = np.flatnonzero(n)
        share = n[at] / len(g)
        out = np.append(model.logs[:, at] @ share * evidence, background[at] @ share * evidence)
        p, w = known[:, at], np.full(len(known), 1 / len(known))
        for _ in range(ROUNDS):
            w = w * (p @ (share / (w @ p)))
        best = out[:-1].max()
        out[-1] += best - max(np.log(w @ p) @ share * evidence, best)  # as far from the best as from the mixture
        return out

    return score


def _scores(model: Model, markup: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for b in common.batches(it, 500):
            at = b.schema.get_field_index("text")
            texts = common.text_bytes(b.column(at))
            if markup:
                texts = [page_text(x.decode()).encode() for x in texts]
            out = []
            for x in texts:
                g = _grams(x)
                out.append(score(g) if len(g) else None)
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=[*(f.name for f in b.schema if f.name != "text"), "scores"])

    return run


def identify(evidence: DataFrame, model: Model, markup: bool = False) -> DataFrame:
    """id, lang (null: rejected), best, posterior for each row of ``evidence`` (id, text, declared, suffix, domain, host)."""
    none = F.lit(None).cast("string")
    if not model.languages:
        return evidence.select("id", none.alias("lang"), none.alias("best"), F.lit(None).cast("double").alias("posterior"))
    k = range(len(model.languages) + 1)
    fields = ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in evidence.columns if c != "text")
    rows = common.saved(evidence.mapInArrow(_scores(model, markup), f"{fields}, scores array<double>"), "scores")
    rows = rows.withColumn("choice", F.array_position("scores", F.array_max("scores")) - 1)
    chosen = rows.where("choice is not null")
    counted = F.array(*(F.count(F.when(F.col("choice") == i, 1)) for i in k))
    total = chosen.agg(counted.alias("n")).first()["n"]

    def by(column: str) -> DataFrame:
        """A row for each value: how often each hypothesis was chosen with it."""
        return common.saved(chosen.where(F.col(column).isNotNull()).groupBy(column).agg(counted.alias(f"n_{column}")), column)

    levels = {c: by(c) for c in ("declared", "suffix", "domain", "host")}
    out = rows
    for c, counts in levels.items():
        out = out.join(counts, c, "left")  # few values are broadcast by Spark; the rows of a hot one are split
    own = [F.when(F.col("choice") == i, 1.0).otherwise(0.0) for i in k]
    judged = F.when(F.col("choice").isNotNull(), 1.0).otherwise(0.0)

    def others(column: str, i: int) -> Column:
        """How often ``i`` was chosen with this row's value in other rows."""
        return F.coalesce(F.element_at(f"n_{column}", i + 1) - own[i], F.lit(0.0))

    # priors from the corpus down to the host, each smoothed towards the one above; each level is a column of its own
    number = len(total)
    out = out.withColumn("prior", F.array(*((F.lit(float(n)) - own[i] + 1.0) / (F.lit(float(sum(total)) + number) - judged) for i, n in enumerate(total))))
    for c in ("suffix", "domain", "host"):
        seen = sum((others(c, i) for i in k), F.lit(0.0))
        out = out.withColumn("prior", F.array(*((others(c, i) + SMOOTHING * F.element_at("prior", i + 1)) / (seen + SMOOTHING) for i in k)))

    kinds = {c: float(levels[c].count() or 1) for c in ("declared", "suffix")}

    def given(column: str, i: int) -> Column:
        """log P(seen | language), smoothed towards an even spread over what is seen."""
        p = (others(column, i) + SMOOTHING / kinds[column]) / (F.lit(float(total[i])) - own[i] + SMOOTHING)
        return F.when(F.col(column).isNotNull(), F.log(p)).otherwise(F.lit(0.0))

    logs = F.array(*(F.element_at("scores", i + 1) + given("declared", i) + given("suffix", i) + F.log(F.element_at("prior", i + 1)) for i in k))
    out = out.select("id", logs.alias("logs")).withColumn("known", F.slice("logs", 1, len(model.languages))).withColumn("top", F.array_max("known"))
    share = F.aggregate("known", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = out.withColumns({"of_known": 1 / share, "in_known": 1 / (1 + F.exp(F.element_at("logs", -1) - F.col("top")) / share)})
    best = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("known", F.col("top")).cast("int"))
    full = F.forall("logs", lambda x: x.isNotNull())
    kept = (F.col("in_known") >= LEAST) & (F.col("of_known") >= LEAST)
    return out.select("id", F.when(full & kept, best).alias("lang"), F.when(full, best).alias("best"), F.when(full, F.round(F.col("of_known") * F.col("in_known"), 6)).alias("posterior"))


def identify_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    if model is None:
        model = fit(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("lang")))
    return identify(evidence_of_documents(docs), model)
