"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks. DataFrame operations only.

The schedule is a row of slots. Slot i gets the point frac((i + 1) / golden ratio), which falls into one source's part of the
unit interval, so any stretch of the schedule holds the sources in their target proportions. The r-th slot of a source takes the
r-th block of that source's words in shuffled order; after the last word the order starts again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.session import written

GOLDEN = 0.6180339887498949
CELLS = 1024  # equal parts of the unit interval in which points and sources meet
ROWS_PER_GROUP = 2_000
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """Per row: id, source, size in words, a hash ``h`` to shuffle by, and ``row``, what tells rows of equal id and text apart; no text."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))).alias("h"), (F.lit(0).cast("bigint") if row is None else row).alias("row"),
    )


def source_targets(rows: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """One row per source: number ``k`` (by code point, null last), ``n`` rows, ``source_size``, ``target`` and ``take`` words.

    The sources share ``share`` times all words by weight, but none gets more than MAX_REPEATS times its words; what
    they can't take goes to the others by weight. With sources in order of (words / weight), those that
    reach their limit come first, so one running sum finds them. Windows here run over one row per source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int")).cast("double")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    t = t.withColumn("k", F.row_number().over(order).cast("bigint")).withColumn("w", w)
    t = t.withColumn("cap", F.col("source_size") * float(MAX_REPEATS))
    by = Window.orderBy(F.col("cap") / F.col("w"), "k")
    below, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
    t = t.withColumn("left_w", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("budget", F.sum("source_size").over(all_) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - F.col("before")) / F.col("left_w"))  # if all below are full
    t = t.withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    t = t.withColumn("line", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("cap") / F.col("w"))).over(all_))
    target = F.least("cap", F.coalesce(F.col("line") * F.col("w"), F.col("cap")))
    t = t.withColumn("target", target).withColumn("take", F.least(F.round("target"), F.col("cap")).cast("bigint"))
    return t.select("k", "source", "n", "source_size", "target", "take")


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with words, each with the place ``at`` of its first word in its source's shuffled order.

    A source's rows are dealt by hash to groups of about ROWS_PER_GROUP. Sums of groups give each group's start, a window
    inside the group the rest, so that no task sees a whole source.
    """
    group = F.pmod("h", F.ceil(F.col("n") / ROWS_PER_GROUP).cast("bigint"))
    r = rows.where("size > 0").join(sources, rows.source.eqNullSafe(sources.source)).select(
        "k", "doc_id", "size", "h", "row", "source_size", "take", group.alias("g")
    )
    sums = r.groupBy("k", "g").agg(F.sum("size").alias("words"))
    start = F.sum("words").over(Window.partitionBy("k").orderBy("g")) - F.col("words")
    starts = sums.select("k", "g", start.alias("start"))
    inner = Window.partitionBy("k", "g").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("at", F.sum("size").over(inner) - F.col("size")).join(starts, ["k", "g"])
    return r.select("k", "doc_id", "h", "row", "size", "source_size", "take", (F.col("at") + F.col("start")).alias("at"))


def pieces(places: DataFrame, block: int) -> DataFrame:
    """What each block of each source holds: ``k``, ``rank`` (of the block), row, ``epoch``, ``start`` in the row, ``length``."""
    e = places.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    lo = F.col("at") + F.col("epoch") * F.col("source_size")
    e = e.withColumn("lo", lo).withColumn("hi", F.least(lo + F.col("size"), F.col("take"))).where("lo < hi")
    first, last = F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)
    e = e.withColumn("rank", F.explode(F.sequence(first, last)))
    a, b = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    return e.select("k", "rank", "doc_id", "row", "size", "at", "epoch", (a - F.col("lo")).alias("start"), (b - a).alias("length"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The slots in order: ``slot``, source number ``k`` and ``rank``, the slot's number among its source's slots.

    Slots beyond a source's blocks stay empty and aren't listed. The few blocks that a source still misses at the end, as its
    points deviate from its share by a handful, follow in slots after the others.
    """
    spark = sources.sparkSession
    need = sources.where("take > 0").select("k", F.ceil(F.col("take") / block).cast("bigint").alias("need"), "take")
    need = need.withColumn("upper", F.sum("take").over(Window.orderBy("k")) / F.sum("take").over(Window.partitionBy()))
    need = need.withColumn("lower", F.coalesce(F.lag("upper").over(Window.orderBy("k")), F.lit(0.0)))
    parts = need.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lower") * CELLS), F.least(F.floor(F.col("upper") * CELLS), F.lit(CELLS - 1))))
    )
    n = int(need.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0])
    chunk = max(ROWS_PER_GROUP, math.isqrt(n))
    slots = spark.range(n).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0)))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).withColumn("chunk", F.floor(F.col("slot") / chunk))
    held = slots.join(parts, "cell").where("u >= lower AND (u < upper OR upper = 1)").select("slot", "chunk", "k", "need")
    counts = held.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("k", "chunk", (F.sum("c").over(Window.partitionBy("k").orderBy("chunk")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    ranked = held.withColumn("inside", inside).join(before, ["k", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside")).where("rank < need").select("slot", "k", "rank")
    had = counts.groupBy("k").agg(F.sum("c").alias("had"))
    missing = need.join(had, "k", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    late = missing.withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("need") - 1)))
    tops = need.agg(F.max("k")).first()[0] or 0
    return ranked.union(late.select((F.lit(n) + F.col("rank") * (tops + 1) + F.col("k")).alias("slot"), "k", "rank"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, block: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, sources, places, mixture).

    ``mixture`` is the mix in order: slot, source number, and the words [start, start + length) that each piece takes from
    a row, identified by its source number ``k`` and place ``at``. Every source's pieces add up to its target rounded to
    words; no row is taken more than MAX_REPEATS times. The order depends on ids and texts alone, so reruns agree; equal rows
    are interchangeable. Null ids and sources are values like others; rows without words are in no block; an empty table has an
    empty mixture. Other columns are not read.
    """
    rows = written(sized(docs, id_col, text_col, source_col, row), "sizes")
    sources = written(source_targets(rows, weights, share), "sources")
    places = written(placed(rows, sources), "places")
    held = pieces(places, block)
    mixture = held.join(schedule(sources, block), ["k", "rank"])
    return rows, sources, places, mixture


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """Per input row: doc_id, size, source_size, target (of its source) and ``taken``, the words of it in the mixture."""
    rows, sources, places, mixture = mix(docs, **options)
    taken = mixture.groupBy("k", "at").agg(F.sum("length").alias("taken"))
    full = places.select("k", "at", "doc_id", "size").join(taken, ["k", "at"], "left").select(
        "doc_id", "k", "size", F.coalesce("taken", F.lit(0)).alias("taken")
    )
    s = sources.select("k", "source", "source_size", "target")
    without = rows.where("size = 0").join(s, rows.source.eqNullSafe(s.source)).select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")
    )
    return full.join(s, "k").select("doc_id", "size", "source_size", "target", "taken").union(without)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mixture holds them: all columns, one row for each time a document is used.

    A document that is taken whole keeps its text. Where a source's target ends inside a document, the text is cut to
    its first words, with single spaces. A document that the mixture takes no word of has no row. A row is known by a hash of all its
    columns: rows that share id and text but nothing else are documents of their own, and only rows equal in all columns
    share their uses, which are counted, not listed.
    """
    text_col, block = options.get("text_col", "text"), options.get("block", 1024)
    # the row goes along as one column, so that no name of its columns can clash
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    key = F.struct(F.col(options.get("id_col", "doc_id")).alias("id"), F.xxhash64(row).alias("row"))
    _, _, _, mixture = mix(docs, **options, row=F.xxhash64(row))
    used = mixture.groupBy("k", "at", "epoch").agg(
        F.first(F.struct(F.col("doc_id").alias("id"), "row")).alias("_key"), F.sum("length").alias("_words"), F.first("size").alias("_size")
    )
    stretch = F.floor(F.col("at") / (1000 * block)).alias("_stretch")  # bounds how many uses one row stands for
    used = used.groupBy("_key", "_words", "_size", stretch).agg(F.count(F.lit(1)).alias("_uses"))
    d = docs.select(key.alias("_key"), row.alias("_row"))
    one = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # these rows are equal in all columns
    met = d.withColumn("_n", one).where("_n = 1").join(used, "_key")
    met = met.withColumn("_use", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_uses"))))
    text = F.col("_row").getField(text_col)
    words = F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("_words").cast("int"))
    cut = F.when(F.col("_words") < F.col("_size"), F.array_join(words, " ")).otherwise(text)
    return met.select(F.col("_row").withField(f"`{text_col}`", cut).alias("_row")).select("_row.*")
