"""Chat formatting by quotation linking, in DataFrame expressions only.

A line's quote level is the number of ``>`` marks it starts with.  Runs of
lines of one level are quoted passages; their normalised forms are hashed and
joined to the messages of the same conversation that first said them, as a
whole or by paragraphs; a passage that so finds none (a line, a sentence, a
trimmed or re-wrapped part) is joined by its windows of words.  The latest
original of the outermost passages is the message replied to.  Threads
are found by doubling along these replies, and a conversation's messages are
rendered thread after thread, quotes and their attribution lines left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialize

MARKS = r"^(?:[\x20\t]*>)+"
ATTRIBUTION = r"^[\x20\t]*(?:On\b.{1,200}\bwrote|.{1,120}\b(?:wrote|writes|said))[\x20\t]*:[\x20\t]*$"
WINDOW = 5
_LINES = "array<struct<level:int,body:string>>"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)

    def one(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, MARKS + r"[\x20\t]?", "")).otherwise(x).alias("body"))

    return F.transform(parts, one)


def _passages(lines: Column) -> Column:
    """array<struct<level, body>> of runs of quoted lines of one level."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast(_LINES).alias("out"))

    def step(a: Column, x: Column) -> Column:
        size = F.size(a["out"])
        tail = F.element_at(a["out"], -1)
        grown = F.concat(F.slice(a["out"], 1, size - 1), F.array(F.struct(x["level"].alias("level"), F.concat(tail["body"], F.lit("\n"), x["body"]).alias("body"))))
        fresh = F.concat(a["out"], F.array(F.struct(x["level"].alias("level"), x["body"].alias("body"))))
        return F.struct(x["level"].alias("last"), F.when(x["level"] == 0, a["out"]).when((x["level"] == a["last"]) & (size > 0), grown).otherwise(fresh).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def _own(lines: Column) -> Column:
    """Lines of level 0 but attributions that stand right before a quote."""
    after = F.transform(lines, lambda x, i: F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0)))
    kept = F.filter(F.zip_with(lines, after, lambda x, n: F.struct(x["level"].alias("level"), x["body"].alias("body"), n.alias("next"))), lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["body"].rlike(ATTRIBUTION)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def _units(text: Column) -> Column:
    """Hashes of a passage as a whole and of its paragraphs."""
    parts = F.array_union(F.array(_normal(text)), F.transform(F.split(text, r"\n[\x20\t]*\n", -1), _normal))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.md5(x))


def _windows(text: Column) -> Column:
    """Hashes of a passage's runs of WINDOW words, wherever its lines end."""
    words = F.split(_normal(text), " ")
    count = F.size(words) - (WINDOW - 1)
    each = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " ")))
    return F.when(count > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (own text) and passages of each message."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("__tl_text"))
    lines = base.withColumn("__tl_lines", F.when(F.col("__tl_text").contains(">"), _lines(F.col("__tl_text"))))
    trimmed = F.regexp_replace(F.regexp_replace("__tl_text", "\r\n?", "\n"), r"^\s+|\s+$", "")
    return lines.select(
        "conv_id", "turn", "role",
        F.when(F.col("__tl_lines").isNull(), trimmed).otherwise(_own(F.col("__tl_lines"))).alias("body"),
        F.coalesce(_passages(F.col("__tl_lines")), F.array().cast(_LINES)).alias("passages"),
    )


def _originals(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted`` (conv_id, turn, hash, ...) with original: the turn that said
    the hash first, if it is an earlier one."""
    wanted = quoted.select("conv_id", "hash").distinct()
    said = said.join(wanted, ["conv_id", "hash"], "left_semi")
    first = materialize(said.groupBy("conv_id", "hash").agg(F.min("turn").alias("original")), "originals")
    return quoted.join(first, ["conv_id", "hash"]).filter("original < turn")


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage and original: where each quoted passage
    that an earlier message of the conversation said was said first.

    Of its whole and its paragraphs the latest original counts; if they have
    none, the message that first said most of its windows, of several the
    latest.  A part of a paragraph of fewer than WINDOW words has no link."""
    parsed = parsed.filter("conv_id is not null and turn is not null")
    places = ["conv_id", "turn", "level", "passage"]
    passages = parsed.filter(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("passage", "p")).select("conv_id", "turn", "passage", F.col("p.level").alias("level"), F.col("p.body").alias("quote"))
    quoted = materialize(passages.select(*places, F.explode(_units(F.col("quote"))).alias("hash")).distinct(), "quoted")
    said = parsed.select("conv_id", "turn", F.explode(_units(F.col("body"))).alias("hash"))
    whole = materialize(_originals(quoted, said).groupBy(*places).agg(F.max("original").alias("original")), "whole-links")
    rest = passages.distinct().join(whole.select(*places), places, "left_anti")
    rest = materialize(rest.select(*places, F.explode(_windows(F.col("quote"))).alias("hash")).distinct(), "quoted-windows")
    own = parsed.join(rest.select("conv_id").distinct(), "conv_id", "left_semi")
    said = own.select("conv_id", "turn", F.explode(_windows(F.col("body"))).alias("hash"))
    votes = _originals(rest, said).groupBy(*places, "original").agg(F.count("*").alias("n"))
    parts = votes.groupBy(*places).agg(F.max(F.struct("n", "original")).alias("m")).select(*places, F.col("m.original").alias("original"))
    return whole.unionByName(parts)


def _roots(replies: DataFrame, max_rounds: int = 40) -> DataFrame:
    """conv_id, turn, root and depth of every reply (conv_id, turn, parent)."""
    state = materialize(replies.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(max_rounds):
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        after = materialize(state.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "threads")
        discard(state)
        state = after
        if state.filter("moved").isEmpty():
            return state.drop("moved")
    raise RuntimeError("threads did not settle")


def _positions(rows: DataFrame, span: int = 512) -> DataFrame:
    """Adds position, from 0, by (root, turn) within conv_id.

    Counted in three levels, of ``span`` roots and of ``span`` turns, so even
    a conversation that holds most rows is sorted in pieces."""
    a, b = F.floor(F.col("root") / span).alias("__a"), F.floor(F.col("turn") / span).alias("__b")
    rows = rows.select("*", a, b)
    small = materialize(rows.filter("conv_id is not null").groupBy("conv_id", "__a", "root", "__b").agg(F.count("*").alias("n")), "position-counts")
    upto = lambda keys, order: W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    tops = small.groupBy("conv_id", "__a").agg(F.sum("n").alias("n")).select("conv_id", "__a", F.coalesce(F.sum("n").over(upto(["conv_id"], ["__a"])), F.lit(0)).alias("__top"))
    mids = small.select("conv_id", "__a", "root", "__b", F.coalesce(F.sum("n").over(upto(["conv_id", "__a"], ["root", "__b"])), F.lit(0)).alias("__mid"))
    bases = materialize(mids.join(tops, ["conv_id", "__a"]).select("conv_id", "root", "__b", (F.col("__mid") + F.col("__top")).alias("__base")), "position-bases")
    within = W.partitionBy("conv_id", "root", "__b").orderBy("turn", "role", "body")
    ranked = rows.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(bases, ["conv_id", "root", "__b"], "left").withColumn("position", (F.col("__rank") + F.col("__base")).cast("long")).drop("__a", "__b", "__rank", "__base")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, position, turn, role, parent, root, depth,
    n_quoted, n_linked and content.

    parent is the message replied to: of the passages of the lowest level that
    link at all, the latest original.  root is the message a thread starts
    with (itself without a parent), depth the replies between.  position, from
    0 in a conversation, is by (root, turn).  content is
    ``<|role|>`` and the own text.  A null text is empty, a null role
    ``unknown``; rows with a null conv_id or turn have no link and no position;
    rows that share (conv_id, turn) are one place in the thread and are all
    kept, each with its own content; an empty table gives none.  A text is
    parsed whole whatever its length, and each of its passages is hashed once.
    Only conv_id, turn, role and text are read, so other columns never clash.
    """
    parsed = materialize(parse(messages), "messages")
    linked = materialize(links(parsed), "links")
    lowest = linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("original"))).alias("m"), F.count("*").alias("n_linked"))
    replies = materialize(lowest.select("conv_id", "turn", (-F.col("m")["col2"]).alias("parent"), "n_linked"), "replies")
    threads = _roots(replies)
    known = replies.join(threads, ["conv_id", "turn"])
    rows = parsed.join(materialize(known, "threads"), ["conv_id", "turn"], "left")
    rows = rows.select("conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    rows = materialize(rows, "threaded")
    placed = _positions(rows)
    return placed.select("conv_id", "position", "turn", "role", "parent", "root", "depth", "n_quoted", "n_linked", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body")).alias("content"))
