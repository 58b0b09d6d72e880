"""Link quotations to the messages they come from and order conversations by reply. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.llm.once import held
from hazardloom.session import discard, written

PREFIX = r"^[ \t]*>(?:[ \t]*>)*"  # quotation marks at the beginning of a line


def normal(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def runs(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """The messages with ``runs``: stretches of lines of one quote level, as array of (level, text) without the marks."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\n|\r")
    d = held(messages, "_lines", lines)
    mark = lambda line: F.regexp_extract(line, PREFIX, 0)
    d = held(d, "_levels", F.transform("_lines", lambda line: F.length(F.regexp_replace(mark(line), "[^>]", ""))))
    body = lambda line: F.regexp_replace(line, PREFIX + r"[ \t]?", "")
    d = held(d, "_bodies", F.transform("_lines", body))
    levels = F.col("_levels")
    begins = F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: (i == 0) | (F.get(levels, i) != F.get(levels, i - 1)))
    d = held(d, "_starts", begins)
    starts = F.col("_starts")
    run = F.transform(starts, lambda s, j: F.struct(
        F.get(levels, s).alias("level"),
        F.array_join(F.slice(F.col("_bodies"), s + 1, F.coalesce(F.get(starts, j + 1), F.size(levels)) - s), "\n").alias("text"),
    ))
    return held(d, "runs", run).drop("_lines", "_levels", "_bodies", "_starts")


def units(run: Column) -> Column:
    """What of a run can be met again: the whole, its paragraphs and its lines, normalised; no empty ones, no repeats."""
    parts = F.concat(F.array(run), F.split(run, r"\n[ \t]*\n"), F.split(run, r"\n"))
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda u: u != ""))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source, chars): how much a message quotes at a level from which earlier message.

    A passage's source is the first message of the conversation that has it unquoted. There is one row for each passage of a
    conversation on that side of the join, so common lines and large conversations multiply nothing.
    """
    each = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("runs").alias("run"))
    each = each.select("conv_id", "turn", F.col("run.level").alias("level"), F.explode(units(F.col("run.text"))).alias("unit"))
    each = each.select("conv_id", "turn", "level", F.md5("unit").alias("hash"), F.length("unit").alias("chars"))
    source = each.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = each.where("level > 0").distinct()
    met = quoted.join(source, ["conv_id", "hash"]).where("source < turn")
    return met.groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"))


def parents(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the message most quoted at the lowest linked level; of equals the latest."""
    top = F.max_by("source", F.struct(-F.col("level"), F.col("chars"), F.col("source")))
    return found.groupBy("conv_id", "turn").agg(top.alias("parent"))


def roots(parent: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of all messages with a parent, by doubling the steps each round."""
    state = written(parent.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "steps")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        if state.join(up, ["conv_id", "root"], "left_semi").isEmpty():
            return state
        after = state.join(up, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")
        )
        after = written(after, "steps")
        discard(state)
        state = after


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Per input row: conv_id, turn, role, ``parent`` (turn it replies to, or null), ``thread`` (turn its thread began with),
    ``depth``, ``position`` in the conversation (from 0, thread by thread, each in order of turns) and ``text`` without quotes.

    Quote levels nest (``>``, ``>>``, ``> >``). The lines left are joined by line feeds, without empty lines at the ends. A null text
    stays null. Rows without conversation or turn have no links and are their own thread; rows that share conversation and turn
    share parent and thread and follow each other in order of role and text. An empty table gives no rows. Other
    columns are not read. No task holds a whole conversation: positions come from a range sort and offsets of its parts.
    """
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parsed = runs(m)
    parent = written(parents(links(parsed)), "parents")
    thread = parent.join(roots(parent), ["conv_id", "turn"])
    own = F.array_join(F.transform(F.filter("runs", lambda r: r.level == 0), lambda r: r.text), "\n")
    clean = F.when(F.col("text").isNotNull(), F.regexp_replace(own, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", ""))
    rows = parsed.select("conv_id", "turn", "role", clean.alias("text")).join(thread, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "text"
    )
    keys = ["conv_id", "thread", "turn", "role", "text"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = written(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    part = placed.groupBy("conv_id", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("_n")
    part = part.withColumn("_before", before)
    p, q = placed.alias("p"), part.alias("q")
    met = p.join(q, F.col("p.conv_id").eqNullSafe(F.col("q.conv_id")) & (F.col("p._part") == F.col("q._part")))
    position = F.col("_row") - F.col("_first") + F.col("_before")
    return met.select("p.conv_id", "turn", "role", "parent", "thread", "depth", position.alias("position"), "text")
