"""Ranked lexical search: the best documents for each item by weighted, length-normalised term impacts in whole numbers.

``N`` documents have terms, ``L`` in all; a term that ``df`` of them hold weighs ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``; in a document of ``n`` terms
that holds it ``tf`` times it has the impact ``w ((UNIT tf) div (1000 tf + 8 m))`` with ``m = 100 - 75 + ((75 n N) div L)``. An item's score adds up the impacts of its terms, repeats included.

Tasks cut the documents into shards of about ``SHARD`` terms and keep the posting lists of the items' terms alone. In a shard each list has a sparse table that gives the
place of the largest impact of any stretch in two lookups. A search holds intervals of documents, each with the sum of its terms' largest impacts as bound; it takes
those of the highest bounds, scores the document with the largest impact in each in full, and splits the interval there, until no bound reaches
the answers so far. Where bounds tie with the last answer, an interval is only searched if it has smaller ids, so that thousands of equal documents cost no more than a few. A first
pass makes ``PROBE`` steps in each shard; the last of the best answers of all shards is the floor that bounds are held against in the second pass, which goes to the end. Spark ranks what the shards find.

The items' terms are what every task must know: they come in slices of about ``SLICE`` (item, term) rows, each a pass over the documents, so that what is sent to tasks has a bound
whatever the number of items.

Terms are runs of ASCII letters and digits and of what lies beyond ASCII, A-Z lower-cased. Null texts have none. Rows with a null doc_id or item_id take no part; rows of one item_id
are one item with the terms of all; rows of one doc_id are documents of their own. Items without a match, and empty tables, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from . import common, packed

_TABLE = packed.cutter([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
TOP, UNIT = 10, 1_000_000_000
SHARD, SLICE = 4_000_000, 200_000
#: Intervals split at a time: few at first, until there are answers to hold bounds against.
FIRST, MOST = 4, 64
PROBE = 3


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids, terms, n = [], [], []
        for item, text in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1)), strict=True):
            for term in text.translate(_TABLE).split():
                ids.append(item)
                terms.append(term)
                n.append(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["item_id", "term", "n"])


def _shards(codes: dict[bytes, int], size: int):
    """For each shard: documents and terms in all, the items' terms in it with their documents, and its postings. ``codes`` count from 1."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, times, total, docs = [], [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            doc = np.repeat(place, [len(x) for x in terms]) if terms else np.zeros(0, np.int32)
            term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, times))
            by = np.lexsort((doc, term))
            doc, term, tf = doc[by], term[by].astype(np.int32), tf[by].astype(np.int32)
            start = packed.runs(term)
            df = np.diff(start, append=len(term))
            data = packed.pack(ids=np.array(ids, np.int64)[order], n=np.array(lengths, np.int64)[order], doc=doc, tf=tf, term=term[start], df=df)
            yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total]), pa.array([term[start].tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["docs", "total", "terms", "dfs", "data"])

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1)), strict=True):
                words = text.translate(_TABLE).split()
                if not words:
                    continue
                docs, total = docs + 1, total + len(words)
                known = [c for c in map(codes.get, words) if c]
                if known:
                    own, tf = np.unique(np.array(known, np.int64), return_counts=True)
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append(own)
                    times.append(tf)
                if total >= size:
                    yield from flush()
                    ids, lengths, terms, times, total, docs = [], [], [], [], 0, 0
        if docs:
            yield from flush()

    return run


class Shard:
    """Posting lists by term, and a sparse table over all of them."""

    def __init__(self, data: bytes, weights: np.ndarray, n_docs: int, n_terms: int):
        x = packed.unpack(data)
        self.ids, self.doc = x["ids"], x["doc"]
        tf, df = x["tf"].astype(np.int64), x["df"]
        m = 100 - 75 + 75 * x["n"] * n_docs // n_terms
        term = np.repeat(x["term"], df).astype(np.int64)
        self.impact = weights[term] * (UNIT * tf // (1000 * tf + 8 * m[self.doc]))
        self.key = term << 32 | self.doc
        ends = np.cumsum(df)
        self.lists = {t: (e - d, e) for t, d, e in zip(x["term"].tolist(), df.tolist(), ends.tolist(), strict=True)}
        self.table = [np.arange(len(term), dtype=np.int32)]
        for level in range(1, int(df.max(initial=1)).bit_length()):
            half, below = 1 << level - 1, self.table[-1]
            left, right = below[: len(below) - half], below[half:]
            self.table.append(np.where(self.impact[right] > self.impact[left], right, left))
        self.level = np.zeros(int(df.max(initial=1)) + 2, np.int64)
        for i in range(2, len(self.level)):
            self.level[i] = self.level[i >> 1] + 1

    def highest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the largest impact of each stretch from a to before b; value 0 where there is none."""
        full = b > a
        at, value = np.zeros(a.shape, np.int64), np.zeros(a.shape, np.int64)
        start, end = a[full], b[full]
        level = self.level[end - start]
        one, two = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        for k in np.unique(level):
            of = level == k
            one[of], two[of] = self.table[k][start[of]], self.table[k][end[of] - (1 << k)]
        at[full] = best = np.where(self.impact[two] > self.impact[one], two, one)
        value[full] = self.impact[best]
        return at, value

    def best(self, terms: np.ndarray, times: np.ndarray, top: int, floor: tuple[int, int] | None = None, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the ``top`` documents for ``terms``, each counted ``times``: the highest score first, then the smallest id. Those
        after ``floor`` (score, id) may be missing; so may any others if the search ends after some ``steps``."""
        held = np.array([t in self.lists for t in terms.tolist()], bool)
        terms, times = terms[held], times[held]
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return self.ids[docs], scores
        a, b = (np.array([[self.lists[t][i] for t in terms.tolist()]], np.int64) for i in (0, 1))
        at, value = self.highest(a, b)
        value *= times
        bound, low, width = value.sum(axis=1), np.zeros(1, np.int64), FIRST
        if floor is not None:  # the floor in this shard's order: the place of the first larger id
            floor = floor[0], int(np.searchsorted(self.ids, floor[1], side="right"))
        step = 0
        while len(bound) and step != steps:
            step += 1
            if floor is not None:
                keep = (bound > floor[0]) | (bound == floor[0]) & (low < floor[1])
                a, b, at, value, bound, low = (x[keep] for x in (a, b, at, value, bound, low))
                if not len(bound):
                    break
            if len(scores) == top:
                keep = (bound > scores[-1]) | (bound == scores[-1]) & (low < docs[-1])
                a, b, at, value, bound, low = (x[keep] for x in (a, b, at, value, bound, low))
                if not len(bound):
                    break
            order = np.lexsort((low, -bound))
            now, rest = order[:width], order[width:]
            rows = np.arange(len(now))
            split = self.doc[at[now][rows, value[now].argmax(axis=1)]].astype(np.int64)
            place = np.clip(np.searchsorted(self.key, (terms << 32)[None, :] | split[:, None]), a[now], b[now])
            there = (place < b[now]) & (self.doc[np.minimum(place, len(self.doc) - 1)] == split[:, None])
            found = np.where(there, self.impact[np.minimum(place, len(self.doc) - 1)] * times, 0).sum(axis=1)
            scores, docs = np.concatenate((scores, found)), np.concatenate((docs, split))
            keep = np.lexsort((docs, -scores))[:top]
            scores, docs = scores[keep], docs[keep]
            new_a, new_b = np.concatenate((a[now], place + there)), np.concatenate((place, b[now]))
            new_at, new_value = self.highest(new_a, new_b)
            new_value *= times
            new_bound, new_low = new_value.sum(axis=1), np.concatenate((low[now], split + 1))
            some = new_bound > 0
            a, b, at, value = (np.concatenate((x[rest], y[some])) for x, y in ((a, new_a), (b, new_b), (at, new_at), (value, new_value)))
            bound, low = np.concatenate((bound[rest], new_bound[some])), np.concatenate((low[rest], new_low[some]))
            width = min(MOST, 2 * width)
        some = scores > 0
        return self.ids[docs[some]], scores[some]


def _search(items: bytes, weights: np.ndarray, n_docs: int, n_terms: int, top: int, steps: int | None = None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = packed.unpack(items)
        cuts = packed.cuts(x["item"])
        floors = dict(zip(x["floor_item"].tolist(), zip(x["floor_score"].tolist(), x["floor_doc"].tolist(), strict=True), strict=True))
        for b in it:
            for data in b.column(0).to_pylist():
                shard = Shard(data, weights, n_docs, n_terms)
                out = [(int(x["item"][i]), *shard.best(x["term"][i:j], x["n"][i:j], top, floors.get(int(x["item"][i])), steps)) for i, j in cuts]
                item = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in (1, 2))], names=["item_id", "doc_id", "score"])

    return run


def _slice(docs: DataFrame, asked: DataFrame, top: int, shard: int, probe: int) -> DataFrame | None:
    """item_id, doc_id, score: the best of each shard for the items of one slice, a table of bounded size."""
    rows = asked.orderBy("item_id", "term").collect()  # about SLICE rows
    codes = {t: i + 1 for i, t in enumerate(sorted({r["term"].encode() for r in rows}))}
    shards = common.saved(docs.mapInArrow(_shards(codes, shard), "docs long, total long, terms array<int>, dfs array<long>, data binary"), "shards")
    n, n_docs, n_terms = shards.agg(F.count("*"), F.sum("docs"), F.sum("total")).first()
    if not n:
        return None
    weights = np.zeros(len(codes) + 1, np.int64)
    for r in shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect():  # a row for each term of the slice
        weights[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    asks = {"item": [r["item_id"] for r in rows], "term": [codes[r["term"].encode()] for r in rows], "n": [r["n"] for r in rows]}

    def run(floors: list[Row], steps: int | None) -> DataFrame:
        known = asks | {"floor_item": [r["item_id"] for r in floors], "floor_score": [r["score"] for r in floors], "floor_doc": [r["doc_id"] for r in floors]}
        items = packed.pack(**{k: np.array(v, np.int64) for k, v in known.items()})
        return shards.select("data").repartition(n).mapInArrow(_search(items, weights, n_docs, n_terms, top, steps), "item_id long, doc_id long, score long")

    probed = common.saved(ranked(run([], probe), top).where(F.col("rank") == top), "floors")
    return run(probed.collect(), None)  # a row for each item of the slice at most


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard: int = SHARD, slice_rows: int = SLICE, probe: int = PROBE) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents for each item."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = common.saved(items.mapInArrow(_terms, "item_id long, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n")), "asked")
    slices = -(-asked.count() // slice_rows)
    found = [_slice(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i), top, shard, probe) for i in range(slices)]
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for part in found:
        out = out if part is None else out.union(part)
    return ranked(out, top)


SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS row, doc_id, len(terms) AS n, terms FROM cut WHERE len(terms) > 0),
sizes AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM sizes) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held GROUP BY term),
scored AS (
  SELECT item_id, row, doc_id, sum(times * w * ((1000000000::BIGINT * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM held JOIN asked USING (term) JOIN weights USING (term), sizes GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
