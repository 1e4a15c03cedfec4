"""Substring dedup by windows, level by level at twice the length.

A window can only repeat if the windows of half its length inside it do. So levels run from a short length to twice that and on up
to ``WINDOW`` words (6 and 13): at each, only windows are looked at whose shorter windows repeated at the level before, and a level without
survivors ends the search. Of the shorter windows only the one with the smallest hash in each longer window is counted: equal longer windows
choose equal ones. Each level is a saved table. ``dedup`` needs no level beyond ``WINDOW``, whose windows cover longer passages; ``longest`` goes on
from there, doubling until no candidates survive.

Words are what stands between ASCII white space, unchanged. A window belongs to one document. Each word is removed that is covered by
a window whose word sequence also starts in a document with a smaller doc_id. Documents whose whole word sequence equals that of a
smaller doc_id are settled first, by a hash of the whole, and take no part in the levels.

Null texts have no words. Documents with fewer words than a window lose none. Rows of one doc_id count as one document that
starts windows in each of its rows; a row with a null doc_id loses nothing and takes nothing. Whether a window repeats is decided on 96 bits of two
hashes of its words, from independent word hashes; shorter windows, which only leave candidates out, on the first 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the windows that are removed, and of the shortest at which the levels may begin.
WINDOW, FIRST = 13, 6
FULL = "h long, check int, doc_id long"


def levels(window: int) -> list[int]:
    """Lengths up to ``window``, each twice the one before or one more."""
    out = [window]
    while out[0] // 2 >= FIRST:
        out.insert(0, out[0] // 2)
    return out


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _least(g: np.ndarray, more: int) -> np.ndarray:
    """The smallest of each ``more + 1`` consecutive entries."""
    if len(g) <= more:
        return g[:0]
    out = g[: len(g) - more].copy()
    for k in range(1, more + 1):
        np.minimum(out, g[k : k + len(out)], out=out)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _prints(short: int, longer: int):
    """doc_id, n_words, the hash of all words, and for each window of ``longer`` words the smallest hash of those of ``short`` words in it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.WordHash()
        for b in common.batches(it, 500):
            words = [x.split() for x in common.text_bytes(b.column(1))]
            least = [np.unique(_least(common.windows(common.hashed_words(w, known), short), longer - short)) for w in words]
            whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(whole, pa.string()), _lists(least)], names=["doc_id", "n_words", "sha256", "least"])

    return run


def _again(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def _middle(short: int, length: int, longer: int):
    """Level ``length``: for each window of ``longer`` words the smallest hash of those of ``length`` words, where the smallest ``short`` ones of all of these repeat."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.WordHash()
        for b in common.batches(it, 500):
            found = []
            for x, again in zip(common.text_bytes(b.column(1)), _again(b.column(2)), strict=True):
                h = common.hashed_words(x.split(), known)
                gone = ~np.isin(_least(common.windows(h, short), length - short), again)
                g, more = common.windows(h, length), longer - length
                before = np.concatenate([[0], np.cumsum(gone)])
                found.append(np.unique(_least(g, more)[before[more + 1 :] == before[: len(before) - more - 1]]) if len(g) > more else g[:0])
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(found)], names=["doc_id", "least"])

    return run


def _flat(doc_ids: list, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """h, check, doc_id of each distinct window of a row."""
    out: list[list[np.ndarray]] = [[], []]
    for h, check in pairs:
        h, at = np.unique(h, return_index=True)
        out[0].append(h)
        out[1].append((check[at] >> np.uint64(32)).astype(np.uint32))
    ids = np.repeat(np.array(doc_ids, np.int64), list(map(len, out[0])))
    h = np.concatenate([*out[0], np.zeros(0, np.uint64)]).view(np.int64)
    check = np.concatenate([*out[1], np.zeros(0, np.uint32)]).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), pa.array(ids)], names=["h", "check", "doc_id"])


def _full(short: int, length: int):
    """Both hashes of the windows of ``length`` words whose smallest ``short`` one repeats."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = common.WordHash(), common.WordHash(1)
        for b in common.batches(it, 500):
            found = []
            for x, again in zip(common.text_bytes(b.column(1)), _again(b.column(2)), strict=True):
                words = x.split()
                h = common.hashed_words(words, known)
                keep = np.isin(_least(common.windows(h, short), length - short), again)
                found.append((common.windows(h, length)[keep], common.windows(common.hashed_words(words, other), length)[keep]))
            yield _flat(b.column(0).to_pylist(), found)

    return run


def _doubled(length: int):
    """Both hashes of the windows of twice ``length`` words whose halves repeat."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = common.WordHash(), common.WordHash(1)
        for b in common.batches(it, 500):
            found = []
            for x, again in zip(common.text_bytes(b.column(1)), _again(b.column(2)), strict=True):
                words = x.split()
                h = common.hashed_words(words, known)
                ok = np.isin(common.windows(h, length), again)
                keep = ok[:-length] & ok[length:] if len(ok) > length else ok[:0]
                found.append((common.windows(h, 2 * length)[keep], common.windows(common.hashed_words(words, other), 2 * length)[keep]))
            yield _flat(b.column(0).to_pylist(), found)

    return run


def _kept(window: int):
    """n_removed and the hash of the kept words, from (doc_id, text, windows to remove)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.WordHash()
        for b in common.batches(it, 500):
            out: list[list] = [[], [], [], []]
            for x, gone in zip(common.text_bytes(b.column(1)), _again(b.column(2)), strict=True):
                words = x.split()
                hit = np.isin(common.windows(common.hashed_words(words, known), window), gone)
                step = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(hit)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                keep = np.cumsum(step)[:-1] == 0
                text = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                for o, v in zip(out, (len(words), int((~keep).sum()), hashlib.sha256(text).hexdigest(), text.decode()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _first_seen(windows: DataFrame, *keys: str) -> DataFrame:
    """keys and the smallest doc_id, of windows in at least two documents. Combined before the shuffle, so that no window is hot."""
    return windows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*keys, "first")


def _repeated(least: DataFrame) -> DataFrame:
    """doc_id, again: of each document's windows (doc_id, least) those that other documents have too."""
    rows = least.select("doc_id", F.explode("least").alias("h"))
    again = common.saved(_first_seen(rows, "h").select("h"), "short")
    return common.saved(rows.join(again, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("again")), "candidates")  # of one document


def _windows(rows: DataFrame, least: DataFrame, window: int) -> DataFrame:
    """h, check, doc_id of the windows of ``rows`` that may repeat, from the first level (doc_id, least)."""
    steps = levels(window)
    if len(steps) == 1:  # the first level is the last
        steps = [window, window]
    candidates = _repeated(least)
    for short, length, longer in zip(steps, steps[1:], steps[2:], strict=False):
        if candidates.isEmpty():
            break
        rows_left = rows.join(candidates, "doc_id")
        candidates = _repeated(common.saved(rows_left.mapInArrow(_middle(short, length, longer), "doc_id long, least array<long>"), "level"))
    return common.saved(rows.join(candidates, "doc_id").mapInArrow(_full(steps[-2], window), FULL), "windows")


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What repeats: (doc_id, gone) with the hashes of each document's windows that start in an earlier one; and the rows' totals
    (doc_id, n_words, sha256, copy), where copies of earlier documents take no part in the former."""
    rows, steps = _rows(docs), levels(window)
    prints = common.saved(rows.mapInArrow(_prints(steps[0], steps[min(1, len(steps) - 1)]), "doc_id long, n_words long, sha256 string, least array<long>"), "prints")
    totals = prints.drop("least")
    first = totals.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha256", "first")
    earlier = totals.join(common.saved(first, "first"), "sha256", "left").groupBy("doc_id").agg(F.min(F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).alias("copy"))
    copies = common.saved(earlier.where("copy").select("doc_id"), "copies")
    totals = common.semi_join(totals, copies.withColumn("copy", F.lit(True)), "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    own = common.semi_join(rows.where(F.col("doc_id").isNotNull()), copies, "doc_id", "left_anti")
    least = common.semi_join(prints.where(F.col("doc_id").isNotNull()).select("doc_id", "least"), copies, "doc_id", "left_anti")
    full = _windows(own, least, window)
    seen = full.join(_first_seen(full, "h", "check"), ["h", "check"]).where("first < doc_id")
    return common.saved(seen.groupBy("doc_id").agg(F.collect_list("h").alias("gone")), "gone"), totals


def longest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, longest: words of the longest windows that a document shares with another one, ``window`` times a power of two, for those that
    share any. Windows that repeat at one length alone are extended to twice that length, until no candidates survive."""
    rows, steps = _rows(docs).where(F.col("doc_id").isNotNull()), levels(window)
    prints = common.saved(rows.mapInArrow(_prints(steps[0], steps[min(1, len(steps) - 1)]), "doc_id long, n_words long, sha256 string, least array<long>"), "prints")
    full, length, found = _windows(rows, prints.select("doc_id", "least"), window), window, None
    while True:
        alive = full.join(_first_seen(full, "h", "check"), ["h", "check"], "left_semi")
        alive = common.saved(alive.groupBy("doc_id").agg(F.collect_list("h").alias("again")), "alive")
        reached = alive.select("doc_id", F.lit(length).cast("long").alias("longest"))
        found = reached if found is None else found.union(reached)
        if alive.isEmpty():
            return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        full = common.saved(rows.join(alive, "doc_id").mapInArrow(_doubled(length), FULL), "windows")
        length *= 2


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``."""
    gone, totals = repeats(docs, window)
    ids = gone.select("doc_id")
    whole = F.col("copy") & (F.col("n_words") >= window)
    settled = common.semi_join(totals, ids, "doc_id", "left_anti").select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"), F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha256")).alias("kept_sha256"))
    cut = common.semi_join(_rows(docs), ids, "doc_id").join(gone, "doc_id").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return settled.unionByName(cut.drop("kept"))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(words) - 11), lambda i: array_to_string(words[i:i + 12], ' ')) AS grams FROM t WHERE len(words) >= 13),
k AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
f AS (SELECT gram, min(doc_id) AS first FROM k GROUP BY gram),
r AS (SELECT DISTINCT k.doc_id, k.i + o.o AS i FROM k JOIN f ON f.gram = k.gram CROSS JOIN (SELECT unnest(range(13)) AS o) o WHERE f.first < k.doc_id),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
x AS (SELECT w.doc_id, count(*) AS n_words, count(r.i) AS n_removed, string_agg(CASE WHEN r.i IS NULL THEN w.word END, ' ' ORDER BY w.i) AS kept
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(x.n_words, 0) AS n_words, coalesce(x.n_removed, 0) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256 FROM t LEFT JOIN x ON x.doc_id = t.doc_id
"""
