"""Benchmark decontamination: size-partitioned MinHash containment search, by DataFrame functions alone.

An item of ``q`` distinct 5-word shingles lies in a document if at least 80 % of them occur there. So of any ``q - ceil(0.8 q) + 1`` of
its shingles one at least occurs in such a document; the sketch of an item takes those with the smallest hashes, a MinHash
sketch whose length depends on the item's size: the smaller an item, the higher lie the hashes of its sketch. Items are partitioned by size, a class for each power of two, with its largest
sketch hash as bound: short items lift the bound of their own class alone. Of a document's shingles those that a bitmap of the sketches' hashes may hold are kept, before any join; each meets the classes
whose bound it is under. A document that shares a hash of a sketch is a candidate, and is verified by exact containment: of its shingles
those that a bitmap of all the items' shingles may hold are written out in words, and counted for each item. Shingles are made a row each, in generated code, and hashed from their words there.

Words are what stands between ASCII white space, with A-Z lower-cased. An item or document of fewer than five words is one shingle; without
words it has none, and is neither found nor leaked into. Rows of equal id are one document or item with the shingles of all. Null
ids take no part. Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, PERCENT = 5, 80
#: A bitmap has this many bits for each hash, and 2 MB at most, whatever the number of items: beyond it more shingles go on to the join.
SPARSE, BITS = 64, 1 << 24


def _words(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(common.ascii_lower(text), r"[\x20\x09-\x0D]+"), "")
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), words.alias("words")).where(F.size("words") > 0)


def _each(words: DataFrame, key: str, *others: str) -> DataFrame:
    """A row for each shingle, named by the place ``i`` of its first word."""
    places = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE)).otherwise(F.array(F.lit(0)))
    return words.select(key, "words", *others, F.explode(places).alias("i"))


def _of(many, whole) -> Column:
    """``many`` of the five words at ``i``, or ``whole`` of all words of a shorter text."""
    return F.when(F.size("words") >= SHINGLE, many(*(F.col("words")[F.col("i") + k] for k in range(SHINGLE)))).otherwise(whole(F.array_join("words", " ")))


def _hash() -> Column:
    return _of(F.xxhash64, F.xxhash64)


def _text() -> Column:
    return _of(lambda *w: F.concat_ws(" ", *w), lambda w: w)


def _bitmap(hashes: DataFrame) -> tuple[DataFrame, int]:
    """One row of ``bits``, an array of longs, and the number of its slots: those of the ``hashes`` (h) are set."""
    slots = min(BITS, 1 << max(12, (max(1, hashes.count()) * SPARSE - 1).bit_length()))
    slot = F.col("h").bitwiseAND(slots - 1)
    words = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    full = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # slots / 64 entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(slots // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return common.saved(full.select(dense.alias("bits")), "bitmap"), slots


def _kept(words: DataFrame, key: str, bitmap: tuple[DataFrame, int], value: Column, name: str) -> DataFrame:
    """key and ``value`` of the shingles whose hash the bitmap may hold; it is one row of 2 MB at most."""
    bits, slots = bitmap
    rows = _each(words.join(F.broadcast(bits)), key, "bits")
    word = F.get("bits", F.shiftright(_hash().bitwiseAND(slots - 1), 6).cast("int"))
    return rows.where(F.call_function("getbit", word, _hash().bitwiseAND(63).cast("int")) == 1).select(key, value.alias(name))


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, size (the power of two of its number of shingles), h: the smallest hashes of each item."""
    hashes = _each(_words(items, "item_id"), "item_id").select("item_id", _hash().alias("h")).distinct()
    sets = hashes.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hashes"))  # of one item
    q = F.size("hashes")
    k = (q - F.ceil(q * percent / 100) + 1).cast("int")
    return sets.select("item_id", F.floor(F.log2(q)).cast("int").alias("size"), F.explode(F.slice("hashes", F.lit(1), k)).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: items of which at least ``percent`` of the shingles occur in the document."""
    keys = common.saved(sketches(items, percent), "sketches")
    bounds = keys.groupBy("size").agg(F.max("h").alias("bound")).collect()  # as many as a number has binary digits
    few = keys.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS
    words = _words(docs, "doc_id")
    small = _kept(words, "doc_id", _bitmap(keys.select("h").distinct()), _hash(), "h")
    under = F.array_compact(F.array(*(F.when(F.col("h") <= r["bound"], F.lit(r["size"])) for r in bounds))) if bounds else F.array().cast("array<int>")
    small = small.select("doc_id", "h", F.explode(under).alias("size"))
    pairs = common.saved(small.join(F.broadcast(keys) if few else keys, ["size", "h"]).select("doc_id", "item_id").distinct(), "candidates")
    ids = common.saved(pairs.select("doc_id").distinct(), "candidate-ids")

    of_items = common.saved(_each(_words(items, "item_id"), "item_id").select("item_id", _text().alias("s"), _hash().alias("h")).distinct(), "items")
    inside = _kept(common.semi_join(words, ids, "doc_id"), "doc_id", _bitmap(of_items.select("h").distinct()), _text(), "s").distinct()
    # an item's number of shingles rides along; a pair that is no candidate is too far off to count
    sized = of_items.drop("h").join(of_items.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")
    met = inside.join(sized, "s").join(pairs, ["doc_id", "item_id"], "left_semi")
    found = met.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return found.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "n_shared", "n_item")


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those of documents that hold an item, with their columns as they are. Rows with a null doc_id stay."""
    held = common.saved(leaks(docs, items, percent).select("doc_id").distinct(), "leaks")
    return common.semi_join_ids(docs, held, "left_anti")


SQL = r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
t AS (SELECT kind, id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
      FROM w WHERE id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
             ELSE [array_to_string(words, ' ')] END) AS shingle FROM t WHERE len(words) > 0),
i AS (SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 'i')
SELECT s.id AS doc_id, i.item_id, count(*) AS n_shared, i.n_item
FROM s JOIN i ON s.kind = 'd' AND s.shingle = i.shingle
GROUP BY s.id, i.item_id, i.n_item HAVING count(*) * 100 >= i.n_item * 80
"""
