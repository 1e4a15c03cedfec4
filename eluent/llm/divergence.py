"""Source divergence audit: how far the vocabulary of each source lies from that of each other source of its language, and by which terms.

Terms are counted for each language and source; a language keeps those that ``MIN_DOCS`` of its documents hold. A group (a source of a language, or the
language) gives a kept term the price ``1 + floor(UNIT * (count + 1) / (N + V))``, N being its counts' sum and V the kept terms. A term of price p in
a group and q in another differs by ``floor((p - q)^2 / q)``.

Sources meet in pair tasks: for each unordered pair the two sorted (term id, count) arrays are co-grouped, cut into sections of ``SECTION`` ids so that no task
holds a vocabulary. A galloping intersection finds the terms of both; those, the terms of one side, and the terms of neither, which all have one
price, are added up both ways. Terms are counted in tasks before anything is shuffled, so a hot source or term is a row for each task.

A null text, lang or source is ''. A group without terms has counts of 0 throughout; a language without kept terms has pairs of value 0 and no terms.
Rows of one doc_id are documents of their own; extra columns are ignored; an empty table gives no rows. All arithmetic is exact for counts below 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, packed

#: What terms are made of: ASCII letters and whatever lies beyond ASCII.
_TABLE = packed.cutter([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
UNIT, MIN_DOCS, TOP = 1_000_000_000, 3, 200
SECTION = 1 << 16
#: Terms of documents that a task counts before it hands on.
FLUSH = 4_000_000


def _counted(it: Iterator[pa.RecordBatch], most: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: what each ``most`` terms of documents add up to."""
    codes, groups, keys, counts, held = packed.Codes(), {}, [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        names, words = list(groups), pa.array(list(codes), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, where, np.concatenate(counts))
        docs = np.bincount(where, minlength=len(found)).astype(np.int64)
        for i in range(0, len(found), 100_000):
            part = slice(i, i + 100_000)
            of = pa.array(found[part] >> 32)
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), words.take(pa.array(found[part] & 0xFFFFFFFF)), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])

    for b in it:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.text_bytes(b.column(2)), strict=True):
            words = text.translate(_TABLE).split()
            if not words:
                continue
            own, n = np.unique(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), return_counts=True)
            keys.append(own | groups.setdefault((lang, source), len(groups)) << 32)
            counts.append(n)
            held += len(own)
            if held >= most:
                yield from flush()
                codes, groups, keys, counts, held = packed.Codes(), {}, [], [], 0
    yield from flush()


def prices(count: np.ndarray | int, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)), digit by digit, so that nothing overflows."""
    left, of, out = np.asarray(count, np.int64) + 1, np.int64(total + terms), np.int64(0)
    for _ in range(3):  # three digits of a thousand are UNIT
        left = left * 1000
        out, left = out * 1000 + left // of, left % of
    return out + 1


def gallop(small: np.ndarray, large: np.ndarray, block: int = 256) -> np.ndarray:
    """Where each entry of ``small`` stands in ``large``, -1 if it doesn't; both ascend. Each block of needles starts where the one before ended and
    doubles its reach until it covers its last needle."""
    out, start = np.full(len(small), -1, np.int64), 0
    for i in range(0, len(small), block):
        needles = small[i : i + block]
        reach = len(needles)
        while start + reach < len(large) and large[start + reach - 1] < needles[-1]:
            reach *= 2
        part = large[start : start + reach]
        at = np.searchsorted(part, needles)
        hit = at < len(part)
        hit[hit] = part[at[hit]] == needles[hit]
        out[i : i + block][hit] = start + at[hit]
        start += int(at[-1])
    return out


def both_ways(a: dict, b: dict, total_a: int, total_b: int, terms: int, here: int) -> tuple[int, int]:
    """The differences a to b and b to a over a section of ``here`` of the language's ``terms`` kept terms."""
    p_a, p_b = prices(a["n"], total_a, terms), prices(b["n"], total_b, terms)
    none_a, none_b = prices(0, total_a, terms), prices(0, total_b, terms)
    swap = len(a["id"]) > len(b["id"])
    at = gallop(b["id"], a["id"]) if swap else gallop(a["id"], b["id"])
    mine, other = (at[at >= 0], np.flatnonzero(at >= 0)) if swap else (np.flatnonzero(at >= 0), at[at >= 0])
    only_a, only_b = np.delete(p_a, mine), np.delete(p_b, other)
    neither = here - len(p_a) - len(p_b) + len(mine)
    off = lambda p, q: (p - q) * (p - q) // q
    ab = off(p_a[mine], p_b[other]).sum() + off(only_a, none_b).sum() + off(none_a, only_b).sum() + neither * off(none_a, none_b)
    ba = off(p_b[other], p_a[mine]).sum() + off(only_b, none_a).sum() + off(none_b, only_a).sum() + neither * off(none_b, none_a)
    return int(ab), int(ba)


def _pair_task(size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.to_pylist()[0], right.to_pylist()[0]
        here = min(size, a["terms"] - a["section"] * size)
        ab, ba = both_ways(packed.unpack(a["counts"]), packed.unpack(b["counts"]), a["total"], b["total"], a["terms"], here)
        return pa.table({"lang": [a["lang"]] * 2, "source": [a["one"], a["two"]], "item": [a["two"], a["one"]], "value": pa.array([ab, ba], pa.int64())})

    return run


def _packed_section(t: pa.Table) -> pa.Table:
    ids, n = t["id"].to_numpy(), t["n"].to_numpy()
    order = np.argsort(ids)
    return pa.table({"lang": t["lang"][:1], "source": t["source"][:1], "section": t["section"][:1], "counts": pa.array([packed.pack(id=ids[order], n=n[order])], pa.binary())})


def _price(n: str, total: str, terms: str = "terms") -> Column:
    return F.expr(f"1 + bigint((cast({n} + 1 as decimal(20, 0)) * {UNIT}) div ({total} + {terms}))")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n, lang_n: the counts of terms that enough documents of the language hold; one exchange by language and term."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    return cells.where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n")


def audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, section: int = SECTION) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of each language the other sources (part ``pair``) and its ``top`` outstanding terms (part
    ``term``), the furthest first."""
    kept = common.saved(kept_terms(docs, min_docs), "kept-terms")
    ids = common.saved(common.with_rank(kept.select("lang", "term").distinct(), [F.col("lang"), F.col("term")], "id"), "term-ids")
    of_lang = ids.groupBy("lang").agg(F.count("*").alias("terms"), F.min("id").alias("first"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "terms", "first"])
    groups = common.saved(groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "groups")

    place = F.col("id") - F.col("first")
    cells = kept.join(ids, ["lang", "term"]).join(groups.select("lang", "source", "first"), ["lang", "source"])
    cells = cells.select("lang", "source", F.floor(place / section).cast("int").alias("section"), (place % section).cast("int").alias("id"), "n")
    sections = cells.groupBy("lang", "source", "section").applyInArrow(_packed_section, "lang string, source string, section int, counts binary")
    whole = groups.where("terms > 0").select("lang", "source", "total", "terms", F.explode(F.expr(f"sequence(0, int((terms - 1) div {section}))")).alias("section"))
    empty = packed.pack(id=np.zeros(0, np.int32), n=np.zeros(0, np.int64))
    sections = common.saved(whole.join(sections, ["lang", "source", "section"], "left").withColumn("counts", F.coalesce("counts", F.lit(empty))), "sections")
    names = groups.select("lang", "source")
    pairs = names.withColumnRenamed("source", "one").join(names.withColumnRenamed("source", "two"), "lang").where("one < two")
    key = ["lang", "one", "two", "section"]
    left = sections.join(pairs.withColumn("source", F.col("one")), ["lang", "source"]).select(*key, "total", "terms", "counts")
    right = sections.join(pairs.withColumn("source", F.col("two")), ["lang", "source"]).select(*key, "total", "terms", "counts").toDF(*key, "total", "terms", "counts")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_pair_task(section), "lang string, source string, item string, value long")
    nothing = pairs.select("lang", F.explode(F.expr("array(struct(one as source, two as item), struct(two as source, one as item))")).alias("x")).select("lang", "x.*", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = met.union(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))

    term = kept.join(groups.drop("first"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _price("n", "total").alias("p"), _price("lang_n", "lang_total").alias("q"))
    term = term.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["item", "value", F.col("rank").cast("int").alias("rank")]
    return pair.select("lang", "source", F.lit("pair").alias("part"), *columns).union(term.select("lang", "source", F.lit("term"), *columns))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
priced AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (v.total + v.v) AS of_lang
  FROM sizes s JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, q.source AS item, sum(((p.p - q.p) * (p.p - q.p)) // q.p) AS value FROM priced p JOIN priced q ON p.lang = q.lang AND p.term = q.term AND p.source <> q.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - of_lang) * (p - of_lang)) // of_lang AS value FROM priced WHERE n > 0 AND p > of_lang),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
