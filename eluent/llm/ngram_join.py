"""N-gram Jaccard join by parity sketches.

A document is its set of 5-word shingles. Its parity sketch has a long row of bits; every shingle flips the one that its hash
names. A shingle in one of two sets changes one bit at most, so the Hamming distance of two sketches is a lower bound of the
symmetric difference of the sets. Sets with a Jaccard similarity of 0.8 differ in at most ``(a + b) / 9`` shingles. A sketch is cut into more bands
than that, so that two such sketches agree in a band at least (pigeonhole). The number of bands goes up in powers of two with the set's
size; a document sends its bands for its own size band, and for the next one where a larger partner could lie in it. A band is sent as the
XOR of codes of its odd bits.

Bands with no odd bit, and bands that more than ``HOT`` documents share (those inside a common passage), need not be met by a document that has
more other bands than a partner can differ in: one of those then agrees. Only documents with too few others, the members of large groups of near copies, are
compared in hot bands too: each with the least changed document of each of its bands, not all with all. What these stars connect needs
nothing more; documents that they leave apart from the rest of their bands meet the others in blocks of bounded size, where the triangle
inequality allows a link. All others are compared pair by pair within bands, unless they are connected already. Everywhere
the sets themselves decide, so that the links are exact.

Documents with equal sets are one document in all of this and expanded at the end. Words are what stands between ASCII white space, with A-Z
lower-cased. With fewer than five words, the whole sequence is the one shingle. Documents without words have no shingles and are linked with nothing,
not even with each other. Rows of one doc_id with different texts are linked as one node; n_shingles is each row's own. Rows with a
null doc_id are returned with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

SHINGLE, PERCENT = 5, 80
HOT, BLOCK = 48, 256
#: Pairs that one copy of a centre's set serves, rounds of further centres before blocks are compared, and bands by which a document picks its centres.
SALTED, ROUNDS, PICKED = 1024, 2, 4
LEVELS = ["sent0", "sent1", "most0", "most1"]


def most_different(a: int, b: int) -> int:
    """Shingles in one of two sets of these sizes only, at most, if they link."""
    return (a + b) // 9


def levels(n: int) -> list[int]:
    """Numbers of bands for which a set of ``n`` sends its sketch: its own, and those of any larger partner."""

    def bands(size: int) -> int:
        need = most_different(size, size) * 11 // 10 + 2
        return 1 << (need - 1).bit_length()

    low, high = bands(n), bands(n * 100 // PERCENT)
    return [low] if low == high else [low, high]


def most_at(n: int, m: int) -> int:
    """Bands in which a set of ``n`` and a partner met at ``m`` bands differ, at most: the larger of the two has its own level there."""
    return min(most_different(n, n * 100 // PERCENT), ((m - 1) * 10 - 1) // 11)


def places(shingles: np.ndarray, m: int) -> np.ndarray:
    """The band of each of the sorted shingle hashes."""
    return ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def _keys(codes: np.ndarray, place: np.ndarray, m: int, empty: int) -> np.ndarray:
    """The lowest bit tells a document's two levels apart, the next one bands without odd bits."""
    keys = common.mixed(codes ^ common.mixed(place + np.uint64(m << 32)))
    return keys & ~np.uint64(3) | np.uint64(parity(m) + 2 * empty)


def bands(shingles: np.ndarray, m: int) -> np.ndarray:
    """Keys of the bands to send, from sorted shingle hashes: those with odd bits, and the others too if those are too few."""
    place = places(shingles, m)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    keys = _keys(np.bitwise_xor.reduceat(common.mixed(shingles), starts), place[starts], m, 0)
    if len(keys) > most_at(len(shingles), m):
        return keys
    others = np.setdiff1d(np.arange(m, dtype=np.uint64), place[starts])
    return np.concatenate([keys, _keys(np.zeros(len(others), np.uint64), others, m, 1)])


def parity(m: int) -> int:
    return m.bit_length() & 1


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, a 128-bit sum of the set, at its even and odd level how many bands have odd bits and how many may differ, and
    the keys of the bands to send. A text is cut into shingles once for all of these."""
    known = common.WordHash()
    for b in common.batches(it, 200):
        sets = [common.shingles(x, known, SHINGLE) for x in common.text_bytes(b.column(1))]
        sums = [(s.sum(dtype=np.uint64), common.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
        x, y = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in zip(*sums, strict=True))
        sent, most, keys = np.zeros((len(sets), 2), np.int64), np.zeros((len(sets), 2), np.int64), []
        for i, s in enumerate(sets):
            own = []
            for m in levels(len(s)) if len(s) else ():
                sent[i, parity(m)], most[i, parity(m)] = len(np.unique(places(s, m))), most_at(len(s), m)
                own.append(bands(s, m))
            keys.append(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), x, y, *(pa.array(z[:, k]) for z in (sent, most) for k in (0, 1)), lists], names=["doc_id", "n_shingles", "sum1", "sum2", *LEVELS, "keys"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = common.WordHash()
    for b in common.batches(it, 500):
        sets = [common.shingles(x, known, SHINGLE).view(np.int64) for x in common.text_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``a`` links with each of ``b``. Shared shingles are counted in slices, so that memory stays bounded."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fa, fb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    vocabulary = np.intersect1d(fa, fb)
    shared = np.zeros((len(a), len(b)), np.float32)
    if len(vocabulary):
        ia, ib = np.searchsorted(vocabulary, fa), np.searchsorted(vocabulary, fb)
        oka = vocabulary[np.minimum(ia, len(vocabulary) - 1)] == fa
        okb = vocabulary[np.minimum(ib, len(vocabulary) - 1)] == fb
        ra, ia, rb, ib = ra[oka], ia[oka], rb[okb], ib[okb]
        for low in range(0, len(vocabulary), 8192):
            x, y = (np.zeros((k, min(8192, len(vocabulary) - low)), np.float32) for k in (len(a), len(b)))
            for z, r, i in ((x, ra, ia), (y, rb, ib)):
                here = (i >= low) & (i < low + z.shape[1])
                z[r[here], i[here] - low] = 1
            shared += x @ y.T
    union = na[:, None] + nb[None, :] - shared
    return 100 * shared >= PERCENT * union


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """As few of ``pairs`` as connect what they connect."""
    parent, out = list(range(n)), []
    for x, y in pairs.tolist():
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            out.append((x, y))
    return out


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks between documents that are not yet connected, as a spanning forest."""
    sets = [np.asarray(s, np.int64) for s in group["shingles"]]
    ids, parts, right = group["doc_id"].to_numpy(), group["component"].to_numpy(), group["side"].to_numpy() == 1
    left = np.flatnonzero(~right)
    other = np.flatnonzero(right) if right.any() else left
    new = linked([sets[i] for i in left], [sets[i] for i in other]) & (parts[left][:, None] != parts[other][None, :])
    x, y = np.nonzero(new)
    tree = [(int(ids[i]), int(ids[j])) for i, j in _forest(np.column_stack([left[x], other[y]]), len(ids))]
    return pd.DataFrame(tree, columns=["a", "b"], dtype="int64")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return common.saved(common.semi_join(docs, ids, "doc_id").mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")


def _measured(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (a, b) with na, nb and the number of shingles they share. A set ``b`` that many pairs name goes out in a copy for each ``SALTED`` of them."""
    hot = common.saved(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("copies")), "hot-sets", rows)
    salt = F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("salt")
    x = common.semi_join(pairs, hot, "b", "inner").select("a", "b", salt).join(sets.selectExpr("doc_id as a", "shingles as x"), "a")
    y = hot.join(sets.selectExpr("doc_id as b", "shingles as y"), "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return x.join(y, ["b", "salt"]).select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("same"))


_LINK = f"100 * same >= {PERCENT} * (na + nb - same)"


def _centres(dense: DataFrame, *first: Column) -> DataFrame:
    """key, b: the member of each band with the most hot bands, the least changed copy; ties to the smallest id. ``first`` go before that."""
    best = F.max(F.struct(*first, "hot", (-F.col("doc_id")).alias("least")))
    return dense.groupBy("key").agg(best.alias("x")).select("key", (-F.col("x.least")).alias("b"))


def _stars(dense: DataFrame, centres: DataFrame, rows: int, turn: int | None = None) -> DataFrame:
    """a, b: each document with the centres of its bands; of ``PICKED`` of them, others each ``turn``, if that is told. Near copies share most of their
    bands, so that the bands of the smallest hashes lead nearly all to the same centre."""
    centres = common.saved(centres, "centres", rows)
    if turn is not None:
        least = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64(F.lit(turn), "key").alias("h"), "key"))), 1, PICKED)  # of the bands of one document
        dense = dense.groupBy("doc_id").agg(least.alias("k")).select("doc_id", F.explode("k.key").alias("key"))
    return common.semi_join(dense, centres, "key", "left").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def _joined(dense: DataFrame, found: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Components of the links found so far, and what ``dense`` (at most ``rows``) has in bands that hold more than one of them, with ``component``."""
    reached = common.saved(graph.components(found), "reached", rows)
    parts = common.saved(common.semi_join(dense.drop("component"), reached.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "parts", rows)
    mixed = common.saved(parts.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"), "mixed", rows)
    return reached, common.saved(common.semi_join(parts, mixed, "key"), "open", rows)


def _hot_links(dense: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all that links within hot bands, and their components, from (key, doc_id, hot).

    First every document is compared with the centres of some of its bands, as often as that connects more. Bands whose documents are all
    connected need nothing further. In the others, only documents outside of the largest component are compared with the rest, see ``_rest``.
    """
    rows = dense.count()
    found = common.saved(_measured(_stars(dense, _centres(dense), rows, -1), sets, rows).where(_LINK).select("a", "b"), "star-links", rows)
    reached, left = _joined(dense, found, rows)
    for i in range(ROUNDS):
        if left.isEmpty():
            return found, reached
        # a centre in another component of the band each time
        pairs = _stars(left, _centres(left, F.xxhash64(F.lit(i), "component")), rows, i)
        more = common.saved(_measured(pairs, sets, rows).where(_LINK).select("a", "b"), "star-links", rows)
        if more.isEmpty():
            break
        found = common.saved(found.union(more), "star-links", 2 * rows)
        reached, left = _joined(dense, found, rows)
    if left.isEmpty():
        return found, reached
    found = common.saved(found.union(_rest(left, sets, rows)), "hot-links")
    return found, common.saved(graph.components(found), "reached", rows)


def _rest(left: DataFrame, sets: DataFrame, n_rows: int) -> DataFrame:
    """Links between documents of different components in the bands ``left`` (key, doc_id, hot, component).

    Bands that share documents make a cluster. Its documents outside of its largest component meet all others in blocks of ``BLOCK``, ordered by their
    distance from one document of the cluster. The symmetric difference is a metric, so two blocks whose distances are
    further apart than any linked pair may be are not compared.
    """
    cluster = graph.components(_stars(left, _centres(left), n_rows)).select(F.col("component").alias("cluster"), F.col("id").alias("doc_id"))
    rows = common.saved(left.groupBy("doc_id", "component").agg(F.max("hot").alias("hot")), "left", n_rows)
    rows = common.saved(common.semi_join(rows, common.saved(cluster, "clusters", n_rows), "doc_id", "inner"), "clustered", n_rows)
    parts = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("component")).alias("c")))["c"].alias("c")).select("cluster", (-F.col("c")).alias("largest"))
    pivots = rows.groupBy("cluster").agg((-F.max(F.struct("hot", (-F.col("doc_id")).alias("c")))["c"]).alias("b"))
    rows = common.saved(common.semi_join(rows, common.saved(largest.join(pivots, "cluster"), "cluster-ends", n_rows), "cluster", "inner"), "clustered", n_rows)
    away = _measured(rows.select(F.col("doc_id").alias("a"), "b"), sets, n_rows).select(F.col("a").alias("doc_id"), F.col("na").alias("n"), (F.col("na") + F.col("nb") - 2 * F.col("same")).alias("t"))
    placed = rows.join(away, "doc_id").select("cluster", "doc_id", "component", "n", "t", (F.col("component") == F.col("largest")).alias("main"))
    placed = common.with_rank(placed, [F.col(c) for c in ("cluster", "main", "t", "doc_id")])
    begins = placed.groupBy("cluster", "main").agg(F.min("rank").alias("first"))
    placed = common.saved(common.semi_join(placed, common.saved(begins, "begins", n_rows), ["cluster", "main"], "inner").withColumn("block", F.floor((F.col("rank") - F.col("first")) / BLOCK)), "blocks")
    ends = [f(c).alias(f"{k}_{c}") for c in ("t", "n", "component") for k, f in (("min", F.min), ("max", F.max))]
    blocks = common.saved(placed.groupBy("cluster", "main", "block").agg(*ends), "block-ends")
    x, y = (blocks.select("cluster", *(F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c != "cluster")) for s in "xy")
    met = x.where("not main_x").join(y, "cluster").where("main_y or block_x <= block_y")
    met = met.where("greatest(min_t_x - max_t_y, min_t_y - max_t_x) <= (max_n_x + max_n_y) div 9")
    met = met.where(f"100 * least(max_n_x, max_n_y) >= {PERCENT} * greatest(min_n_x, min_n_y)")
    met = met.where("not (min_component_x = max_component_y and max_component_x = min_component_y)").withColumn("met", F.monotonically_increasing_id())
    met = common.saved(met.select("cluster", "met", "block_x", "main_y", "block_y"), "met")
    other = met.where("main_y or block_x <> block_y").select("cluster", F.col("main_y").alias("main"), F.col("block_y").alias("block"), "met", F.lit(1).alias("side"))
    sides = met.select("cluster", F.lit(False).alias("main"), F.col("block_x").alias("block"), "met", F.lit(0).alias("side")).union(other)
    groups = placed.join(sides, ["cluster", "main", "block"]).select("met", "side", "doc_id", "component").join(sets, "doc_id")
    return groups.groupBy("met").applyInPandas(_block_links, "a long, b long")


def _candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, n_shingles, levels, keys): bands (key, doc_id, n) that several documents share, what each sends (doc_id, level, n_shingles, cold, hot, most),
    and the hot bands (key, doc_id, hot) of the documents that need them."""
    entries = prints.select("doc_id", F.explode("keys").alias("key"))
    several = common.saved(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    shared = common.saved(entries.join(several, "key"), "shared")
    # what each document sends at a level, and how much of that is hot
    level, odd = F.col("key").bitwiseAND(1).cast("int").alias("level"), F.when(F.col("key").bitwiseAND(2) == 0, 1)
    hot = shared.where(F.col("n") > HOT)
    sent = prints.select("doc_id", "n_shingles", F.posexplode(F.array(*(F.struct(F.col(f"sent{k}").alias("sent"), F.col(f"most{k}").alias("most")) for k in (0, 1)))).alias("level", "x"))
    sent = sent.join(hot.groupBy("doc_id", level).agg(F.count(odd).alias("hot"), F.count("*").alias("all_hot")), ["doc_id", "level"], "left")
    sent = common.saved(sent.select("doc_id", "level", "n_shingles", (F.col("x.sent") - F.coalesce("hot", F.lit(0))).alias("cold"), "all_hot", "x.most"), "sent")
    needy = common.saved(sent.where("all_hot is not null and cold <= most").select("doc_id", "level", F.col("all_hot").alias("hot")), "needy")
    dense = common.saved(hot.select("key", "doc_id", level).join(needy, ["doc_id", "level"]).select("key", "doc_id", "hot"), "hot")
    return shared, sent, dense


def _cold_pairs(shared: DataFrame, sent: DataFrame, reached: DataFrame | None) -> DataFrame:
    """a, b to compare: documents that share a band of at most ``HOT``, are not yet connected, and whose bands do not tell that too much differs."""
    level, odd = F.col("key").bitwiseAND(1).cast("int").alias("level"), F.when(F.col("key").bitwiseAND(2) == 0, 1)
    cold = shared.where(F.col("n") <= HOT).select("key", "doc_id")
    known = F.lit(None).cast("long").alias("component")
    cold = cold.select("key", "doc_id", known) if reached is None else common.semi_join(cold, reached.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    x, y = cold.selectExpr("key", "doc_id as a", "component as c"), cold.selectExpr("key", "doc_id as b", "component as d")
    pairs = x.join(y, "key").where("a < b and not coalesce(c = d, false)")  # in a band of at most HOT documents
    pairs = pairs.groupBy("a", "b", level).agg(F.count(odd).alias("agree"))
    # bands that differ are no more than shingles that differ: the Hamming distance of the sketches
    size = F.col("n_shingles")
    pairs = pairs.join(sent.select(F.col("doc_id").alias("a"), "level", size.alias("na"), "cold"), ["a", "level"])
    pairs = pairs.join(sent.select(F.col("doc_id").alias("b"), "level", size.alias("nb")), ["b", "level"])
    near = (F.col("cold") - F.col("agree") <= F.expr("(na + nb) div 9")) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return common.saved(pairs.where(near).select("a", "b").distinct(), "pairs")


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """a, b: links between the documents of ``prints`` (what ``_prints`` returns, one row for each set); of those that hot bands connect, enough
    to connect them, of others all."""
    shared, sent, dense = _candidates(prints)
    reached, found = None, None
    if not dense.isEmpty():
        found, reached = _hot_links(dense, _sets_of(docs, common.saved(dense.select("doc_id").distinct(), "ids")))
    pairs = _cold_pairs(shared, sent, reached)
    sets = _sets_of(docs, common.saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids"))
    a, b = sets.selectExpr("doc_id as a", "shingles as x"), sets.selectExpr("doc_id as b", "shingles as y")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("same"))
    single = both.where(_LINK).select("a", "b")
    return common.saved(single if found is None else single.union(found), "verified")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives (a, b), and membership (doc_id, n_shingles, representative) for each row; the latter is null
    where there are no shingles or no doc_id."""
    rows = _rows(docs)
    prints = common.saved(rows.mapInArrow(_prints, "doc_id long, n_shingles long, sum1 long, sum2 long, " + ", ".join(f"{c} long" for c in LEVELS) + ", keys array<long>"), "prints")
    key = ["n_shingles", "sum1", "sum2"]
    classes = common.saved(prints.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("representative")), "classes")
    members = prints.select("doc_id", *key).join(classes, key, "left")
    members = common.saved(members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("representative")).alias("representative")), "members")
    ids = classes.select(F.col("representative").alias("doc_id")).distinct()
    found = links(rows.where("doc_id is not null"), common.semi_join(prints.drop("sum1", "sum2"), ids, "doc_id"))
    # texts of one doc_id are one node
    lone = members.where("representative is not null").groupBy("doc_id").agg(F.min("representative").alias("a"), F.collect_set("representative").alias("r"))
    return found.union(lone.where(F.size("r") > 1).select("a", F.explode("r").alias("b"))).where("a <> b"), members


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    found, members = join(docs)
    reached = common.saved(graph.components(found), "components")
    out = members.join(reached.withColumnRenamed("id", "representative"), "representative", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "representative", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
             WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM t),
u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
          HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM s JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.shingles)
"""
