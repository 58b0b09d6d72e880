"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits exactly if some value lies within h bits of both. So every fingerprint emits all
values of its ball of h bits, and those that share a value meet in one shuffle. All that meet at one value are
within 2h bits of each other: a star in each meeting keeps every connection without listing its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.llm.components import connected_components
from hazardloom.llm.workers import sliced
from hazardloom.session import written

SEED = 42
CHUNK = 65_536  # shingles whose bits are held at once


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 (what ``bytes`` calls white space is that class)."""
    return (text or "").encode().lower().split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words, repeats included, joined by one space; fewer words make one run, none makes none."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - k].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]


def simhash(parts: list[bytes], seed: int = SEED) -> int:
    """64 bits, signed: a bit is 1 if more than half of the parts' hashes have it; no parts give 0."""
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(parts), CHUNK):
        h = np.array([digest(p, seed) for p in parts[at : at + CHUNK]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: the id and its ``fingerprint`` (long). Null and empty texts have 0."""

    def each(batches):
        for b in sliced(batches):
            prints = [simhash(shingles_of(words_of(t), shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, fingerprint bigint")


def ball(bits: int, h: int) -> list[int]:
    """Masks of up to h of the lowest ``bits`` bits, as signed longs."""
    masks = [sum(1 << b for b in c) for n in range(h + 1) for c in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def meetings(prints: DataFrame, column: str, bits: int = 64, radius: int = 2) -> DataFrame:
    """Every row once for each value of the ball around its fingerprint, in column ``variant``."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: then all that meet at a value are linked")
    masks = F.array(*(F.lit(m).cast("bigint") for m in ball(bits, radius // 2)))
    return prints.withColumn("_mask", F.explode(masks)).withColumn(
        "variant", F.col(column).bitwiseXOR(F.col("_mask"))
    ).drop("_mask")


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links that connect all of the distinct ``fingerprint`` values within ``radius`` bits: columns ``src``, ``dst``.

    A meeting holds at most as many fingerprints as its ball, whatever the number of copies.
    """
    met = meetings(prints.select("fingerprint"), "fingerprint", 64, radius)
    first = F.min("fingerprint").over(Window.partitionBy("variant"))
    return (
        met.withColumn("src", first).where(F.col("fingerprint") != F.col("src"))
        .select("src", F.col("fingerprint").alias("dst")).distinct()
        .where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """Per input row: the id, ``fingerprint`` (long) and ``component_id``, the smallest id in its linked component.

    Texts with the same fingerprint are linked too. Null ids never name a component unless it has no other id. An empty
    table gives an empty result; repeated rows come back as often as they came in; other columns are not read.
    Copies are reduced to one row per fingerprint, combined before the shuffle, before anything is compared.
    """
    each = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = each.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    roots = connected_components(fingerprint_links(distinct, radius)).toDF("fingerprint", "root")
    member = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(member.join(names, "root").select("fingerprint", "component_id"), "components")
    return each.join(named, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def near_duplicate_survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """The input rows without near-duplicates: of each component (see ``simhash_components``) the row with the smallest id stays.

    Rows without id stay only in components that have none; rows of equal id differ by a hash of all their columns, of
    which the smallest stays; of rows that repeat in all columns one stays. All columns are kept; texts without words are copies of each
    other; an empty table stays empty.
    """
    # rows go along as one column, so that no name of their columns can clash
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    key = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(row).alias("h"))
    d = docs.select(key.alias("_key"), F.col(text_col).alias("_text"), row.alias("_row"))
    each = written(fingerprints(d, "_key", "_text", shingle), "fingerprints")
    distinct = written(each.groupBy("fingerprint").agg(F.min("_key").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct, radius)).toDF("fingerprint", "root")
    groups = distinct.join(roots, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root"))
    stay = groups.agg(F.min("least").alias("_key")).select("_key")
    one = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # these rows are equal in all columns
    return d.select("_key", "_row").join(stay, "_key", "left_semi").withColumn("_n", one).where("_n = 1").select("_row.*")
