"""Chat formatting by quotation linking, by DataFrame functions alone.

A line that begins with ``>`` marks is quoted, at the level of their number. Quoted lines are normalised (lower case, white space as one
blank) and hashed; the original of a line is the first message of the conversation that has it unquoted. Consecutive quoted lines of one
level without an earlier original are a passage, so that quotes may be wrapped anew or cite a part of a line: each sentence of it is looked
up by its windows of words, whatever the line breaks and punctuation, and its original is the first message that holds its words in
a row. Sentences with a changed or left-out word are not found. A message answers the
original of its lowest quote level that has one, by the number of lines and sentences, then the later one. Conversations are then ordered by replies: a
message, then its answers and theirs, each by turn; messages that quote nothing known begin threads of their own. Quoted lines and the
attribution line above them are left out.

A conversation may hold a large share of all rows, so that the output is sharded: it comes in parts of at most ``PART`` messages, numbered in
order, and no step gathers one; ``linked`` gives the whole of it as ordered rows. Rows
with a null conv_id are left out. A null turn is turn -1, null texts and roles are empty. Rows that repeat in full count once; others of one turn are kept side by
side and answered together. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from . import common

PART = 64
#: Words of the windows by which longer sentences are looked up.
SPAN = 6
#: What ends an attribution line, in the languages at hand.
WROTE = r"(?i)^\s*\S.*\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), r"[ \t]", ""))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, r"^(?:[ \t]*>)*", "")), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (level, text, hash) and the text without quotes."""
    rows = messages.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.struct(_level(x).alias("level"), x.alias("text"), F.xxhash64(_normal(x)).alias("hash"), (F.length(_normal(x)) > 0).alias("full")))
    rows = rows.withColumn("lines", lines)
    above = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(WROTE) & F.coalesce(F.get(F.col("lines"), i + 1)["level"] > 0, F.lit(False))))
    # of lines that stand in the text, the hash is enough
    short = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), F.when(x["level"] > 0, x["text"]).alias("text"), x["hash"].alias("hash"), x["full"].alias("full")))
    return rows.select("conv_id", "turn", "role", short.alias("lines"), F.trim(F.array_join(F.transform(above, lambda x: x["text"]), "\n")).alias("text"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")


def _spans(said: Column, n: int) -> Column:
    """Hashes of the distinct windows of ``n`` words of ``said`` (words between blanks)."""

    def every(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *(w[i + j] for j in range(n))))))

    return F.coalesce(let(F.split(said, " "), lambda w: F.when(F.size(w) >= n, every(w))), F.array().cast("array<bigint>"))


def _sentences(lines: DataFrame) -> DataFrame:
    """conv_id, turn, level, unit (words between blanks) of the passages that the quoted lines (conv_id, turn, row, pos, level, normal) make up."""
    of_row = lines.groupBy("conv_id", "turn", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "level", "normal"))).alias("q"))  # of one message
    before = lambda i: F.get(F.col("q"), i - 1)
    goes_on = lambda x, i: F.coalesce((before(i)["pos"] == x["pos"] - 1) & (before(i)["level"] == x["level"]), F.lit(False))
    joined = F.array_join(F.transform("q", lambda x, i: F.concat(F.when(goes_on(x, i), F.lit(" ")).otherwise(F.concat(F.lit("\n"), x["level"].cast("string"), F.lit(":"))), x["normal"])), "")
    passages = of_row.select("conv_id", "turn", F.explode(F.split(joined, "\n")).alias("p")).where("p <> ''")
    # the level comes first, so that no sentence carries its passage along
    passages = passages.select("conv_id", "turn", F.substring_index("p", ":", 1).cast("int").alias("level"), F.split(F.regexp_replace("p", r"^\d+:", ""), r"(?<=[.!?…])\s+").alias("s"))
    sentences = passages.select("conv_id", "turn", "level", F.explode("s").alias("s"))
    return sentences.select("conv_id", "turn", "level", F.array_join(_words(F.col("s")), " ").alias("unit")).where("unit <> ''")


def _originals(units: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, unit, parent: the first turn whose words hold those of the unit in a row."""
    n = F.least(F.size(F.split("unit", " ")), F.lit(SPAN)).alias("n")
    distinct = common.saved(units.select("conv_id", "unit", n).distinct().withColumn("uid", F.monotonically_increasing_id()), "units")
    spans = F.when(F.col("n") == SPAN, _spans(F.col("unit"), SPAN)).otherwise(F.array(F.xxhash64("unit")))
    keys = common.saved(distinct.select("conv_id", "uid", "n", F.explode(spans).alias("h")), "unit-spans")
    sizes = [r["n"] for r in keys.select("n").distinct().collect()]  # SPAN at most
    said = rows.select("conv_id", "turn", F.array_join(_words(F.col("text")), " ").alias("said")).where("said <> ''").groupBy("conv_id", "said").agg(F.min("turn").alias("turn"))
    asked = common.saved(distinct.select("conv_id").distinct(), "asked")
    said = common.saved(common.semi_join(said, asked, "conv_id").withColumn("id", F.monotonically_increasing_id()), "said")
    # a row for each word and size, hashed in generated code
    placed = said.select("conv_id", "id", "turn", F.split("said", " ").alias("w")).select("conv_id", "id", "turn", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    of_size = lambda k: F.when(F.col("i") + k <= F.size("w"), F.xxhash64(F.concat_ws(" ", *(F.col("w")[F.col("i") + j] for j in range(k)))))
    spans = F.explode(F.array(*(F.struct(F.lit(k).alias("n"), of_size(k).alias("h")) for k in sizes)))
    held = placed.select("conv_id", "id", "turn", spans.alias("x")).select("conv_id", "id", "turn", "x.n", "x.h").where("h is not null")
    # few asked windows are broadcast, so that the others need no shuffle
    held = common.saved(common.semi_join(held, common.saved(keys.select("conv_id", "n", "h").distinct(), "asked-spans"), ["conv_id", "n", "h"]), "spans")
    # a unit is met by the rarest of its windows, and only if each of them occurs: first by the earliest message that holds it, which is the answer if it holds the unit, as it
    # does for units of one window. So a short unit that very many messages hold is met by one of them
    windows = held.groupBy("conv_id", "n", "h").agg(F.count("*").alias("often"), F.min(F.struct("turn", "id")).alias("first"))
    seen = keys.join(windows, ["conv_id", "n", "h"], "left")
    rarest = seen.groupBy("conv_id", "uid", "n").agg(F.min(F.struct("often", "h", "first")).alias("x"), F.min(F.col("often").isNotNull()).alias("all")).where("all")
    rarest = common.saved(rarest.select("conv_id", "uid", "n", "x.h", F.col("x.first.id").alias("id")), "rarest")
    exact = F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "unit", F.lit(" ")))
    units = distinct.select("uid", "unit")
    met = lambda pairs: pairs.select("uid", "id").join(said, "id").join(units, "uid").where(exact)
    found = common.saved(met(rarest).select("conv_id", "uid", "unit", F.col("turn").alias("parent")), "first-met")
    rest = common.saved(rarest.join(found.select("uid"), "uid", "left_anti").drop("id"), "rest")
    out = found.select("conv_id", "unit", "parent")
    if rest.isEmpty():
        return out
    return out.unionByName(met(rest.join(held, ["conv_id", "n", "h"])).groupBy("conv_id", "unit").agg(F.min("turn").alias("parent")))


def parents(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent for each turn that quotes an earlier one."""
    lines = rows.select("conv_id", "turn", "row", F.posexplode("lines").alias("pos", "x")).where("x.full")
    lines = lines.select("conv_id", "turn", "row", "pos", "x.level", "x.hash", _normal(F.col("x.text")).alias("normal"))
    quoted = lines.where("level > 0")
    asked = quoted.select("conv_id", "hash").distinct()
    first = lines.where("level = 0").join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent"))
    whole = common.saved(quoted.drop("normal").join(first, ["conv_id", "hash"]).where("parent < turn"), "whole")
    found = whole.select("conv_id", "turn", "level", "parent")
    units = common.saved(_sentences(quoted.join(whole.select("row", "pos"), ["row", "pos"], "left_anti")), "sentences")
    if not units.isEmpty():
        found = found.unionByName(units.join(_originals(units, rows), ["conv_id", "unit"]).where("parent < turn").select("conv_id", "turn", "level", "parent"))
    votes = found.groupBy("conv_id", "turn", "level", "parent").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "parent"))["parent"].alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth, place (from 0, in reply order) of each turn in a thread with replies, from (conv_id, turn, parent).

    Each thread is an Euler tour: a turn is entered after its earlier sibling is left, else after its parent is entered, and left after its last
    answer is left. The steps before one are summed by pointer doubling; a step is a few longs, however deep its thread.
    """
    links = links.select("conv_id", "turn", "parent")
    ranked = common.with_rank(links, [F.col("conv_id"), F.col("parent"), F.col("turn")])
    earlier = ranked.select((F.col("rank") + 1).alias("rank"), F.col("conv_id").alias("_conv"), F.col("parent").alias("_parent"), F.col("turn").alias("_turn"))
    sibling = F.when((F.col("_conv") == F.col("conv_id")) & (F.col("_parent") == F.col("parent")), F.col("_turn"))
    enter = ranked.join(earlier, "rank", "left").select("conv_id", "turn", F.lit(False).alias("leave"), F.coalesce(sibling, "parent").alias("to_turn"), sibling.isNotNull().alias("to_leave"), F.lit(None).cast("long").alias("root"))
    last = links.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.max("turn").alias("last"))
    turns = links.select("conv_id", "turn").union(last.select("conv_id", "turn")).distinct()
    first = last.join(links, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", F.lit(False), F.lit(None).cast("long"), F.lit(False), "turn")
    leave = turns.join(last, ["conv_id", "turn"], "left").select("conv_id", "turn", F.lit(True), F.coalesce("last", "turn"), F.col("last").isNotNull(), F.lit(None).cast("long"))
    entered = F.when(F.col("leave"), 0).otherwise(1).cast("long")
    known = common.saved(enter.union(first).union(leave).withColumns({"n": entered, "level": 2 * entered - 1}), "tour")
    columns = known.columns
    while not (open_ := known.where("to_turn is not null")).isEmpty():
        up = known.select("conv_id", F.col("turn").alias("to_turn"), F.col("leave").alias("to_leave"), *(F.col(c).alias(f"_{c}") for c in ("to_turn", "to_leave", "root", "n", "level")))
        further = open_.join(up, ["conv_id", "to_turn", "to_leave"]).select("conv_id", "turn", "leave", F.col("_to_turn").alias("to_turn"), F.col("_to_leave").alias("to_leave"), F.col("_root").alias("root"), (F.col("n") + F.col("_n")).alias("n"), (F.col("level") + F.col("_level")).alias("level"))
        known = common.saved(further.select(*columns).union(known.where("to_turn is null")), "tour")
    places = known.where(~F.col("leave")).select("conv_id", "turn", "root", (F.col("level") - 1).alias("depth"), (F.col("n") - 1).alias("place"))
    return places.join(links, ["conv_id", "turn"], "left").select("conv_id", "turn", "parent", "root", "depth", "place")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, position (from 0, in reply order), turn, parent (or null), root, depth, role, text without quotes."""
    rows = common.saved(parsed(messages).withColumn("row", F.monotonically_increasing_id()), "messages")
    links = common.saved(parents(rows), "replies")
    placed = rows.select("row", "conv_id", "turn", "role", F.xxhash64("text").alias("hash")).join(common.saved(threads(links), "threads"), ["conv_id", "turn"], "left")
    placed = placed.withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("int"), "place": F.coalesce("place", F.lit(0))})
    # the texts stay behind while the rows are ordered
    ranked = common.with_rank(placed, [F.col(c) for c in ("conv_id", "root", "place", "role", "hash", "row")])
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"))
    ranked = common.saved(ranked.join(first, "conv_id").select("row", (F.col("rank") - F.col("first")).alias("position"), "parent", "root", "depth"), "order")
    return ranked.join(rows.select("row", "conv_id", "turn", "role", "text"), "row").select("conv_id", "position", "turn", "parent", "root", "depth", "role", "text")


#: Turns of derived replies, and of the answers to these, begin so far behind those they quote.
LATER = 1 << 40


def history(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: ``messages`` as they are and, for each one of an odd turn with words, a reply that quotes its first line and an
    answer that quotes the reply and, one level deeper, that line. By turn, a reply quotes the whole line, the line wrapped anew, or words from its middle."""
    turn, text = F.coalesce(F.col("turn").cast("long"), F.lit(-1)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("line", F.get(F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike(r"^[ \t>]*$") & (_level(x) == 0)), 0))
    rows = rows.withColumn("words", F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    n, said = F.size("words"), lambda a, k: F.array_join(F.slice("words", a, k), " ")
    half = F.greatest(F.floor(n / 2), F.lit(1)).cast("int")
    wrapped = F.concat(said(F.lit(1), half), F.lit("\n> "), said(half + 1, n))
    quote = F.when((F.col("turn") % 3 == 0) & (n > 1), wrapped).when((F.col("turn") % 3 == 2) & (n > 9), said(F.lit(2), F.lit(8))).otherwise(said(F.lit(1), n))
    point = F.concat(F.lit("Reply to turn "), F.col("turn"), F.lit("."))
    reply = F.concat("role", F.lit(" wrote:\n> "), quote, F.lit("\n"), point)
    answer = F.concat(F.lit("reader wrote:\n>> "), said(F.lit(1), n), F.lit("\n> "), point, F.lit("\nAnswer on turn "), F.col("turn"), F.lit("."))
    of = lambda k, role, text: F.struct((F.col("turn") + k * LATER).alias("turn"), role.alias("role"), text.alias("text"))
    own = of(0, F.col("role"), F.col("text"))
    some = (F.col("turn") % 2 == 1) & (n > 0)
    every = F.when(some, F.array(own, of(1, F.lit("reader"), reply), of(2, F.lit("writer"), answer))).otherwise(F.array(own))
    return rows.select("conv_id", F.explode(every).alias("m")).select("conv_id", "m.*")


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, n_messages, turns, chat: each conversation as chat text, in parts of at most ``part`` messages."""
    rows = linked(messages).withColumn("part", F.floor(F.col("position") / part))
    said = F.sort_array(F.collect_list(F.struct("position", "turn", "role", "text")))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_messages"), said.alias("said"))
    chat = F.array_join(F.transform("said", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"])), "\n")
    return parts.select("conv_id", "part", "n_messages", F.transform("said", lambda m: m["turn"]).alias("turns"), chat.alias("chat"))
