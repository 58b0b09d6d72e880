"""Hard negatives by a secondary sort: pair scores in packed keys, one shuffle by anchor, one pass over each sorted partition.

A key is (anchor, descending score, positives first, id) as bytes that sort in that order. The shuffle deals them out by anchor and sorts
them within partitions; an iterator then reads each anchor once, opens a window at each of its positives and emits the negatives that
fall into it, holding nothing but its open windows. Before the shuffle a block of rows keeps of an anchor only what can still be among
the first: first its best rows of the same label, then, with the positives known, the best of each positive's window.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.llm.vectors import HIGHEST, LOWEST, products, stacked, usable
from hazardloom.session import written

BLOCK, ANCHORS = 4096, 4096  # rows and anchors that meet in one task
SLICE = 256  # anchors scored at once
KEY = ">QQBQ"


def pack(anchor: int, score: int, positive: bool, id_: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id."""
    return struct.pack(KEY, anchor - LOWEST, HIGHEST - score, not positive, id_ - LOWEST)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, id_ = struct.unpack(KEY, key)
    return anchor + LOWEST, HIGHEST - score, not negative, id_ + LOWEST


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """Smallest and largest negative score with least % of the positive's <= it <= most % of it."""
    return -(-least * positive // 100), most * positive // 100


def first_of(scores: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores among those that fit, ties to the earlier place."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        s = scores[at]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above, ties = at[s > edge], at[s == edge]
        at = np.concatenate([above, ties[: k - len(above)]])
    return at


def stream(keys: Iterable[bytes], positives: int, negatives: int, least: int, most: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys, holding only the open windows."""
    anchor, windows, seen = None, [], 0
    for key in keys:
        a, score, positive, id_ = unpack(key)
        if a != anchor:
            anchor, windows, seen = a, [], 0
        if positive:
            if seen < positives:
                windows.append([id_, score, *window(score, least, most), 0])
                seen += 1
            continue
        for w in windows:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield a, w[0], w[4], id_, w[1], score
        windows = [w for w in windows if w[4] < negatives and score >= w[2]]


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
                   scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor and positive.

    Anchors are the ids divisible by ``every``; scores are integer inner products of floor(``scale`` * x) with the anchor, larger first,
    ties to the smaller id. Positives are the first ``positives`` other rows of the anchor's label. Negatives are the first
    ``negatives`` rows of other labels that score between ``least`` and ``most`` percent of the positive; a positive below 0 has
    none. Rows without id or label, null vectors, vectors with null or non-finite components or of another than the most
    frequent length take no part. Rows with the anchor's own id are neither positive nor negative; an anchor id that comes more than
    once asks with its smallest (vector, label); other repeated rows count as often as they come. Scores beyond 64 bits are bound
    to them. Other columns are not read; an empty table gives no rows.
    """
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark = vectors.sparkSession
    known = vectors.select(
        F.struct(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label")).alias("key"), F.col(vec_col).alias("vec")
    ).where("key.id IS NOT NULL AND key.label IS NOT NULL")
    rows, n, _ = usable(known, "key", "vec")
    if not n:
        return spark.createDataFrame([], out)
    # a written number, so that repeated ids spread over blocks and a repeated task deals alike
    rows = written(rows.select("id.*", "vec", F.monotonically_increasing_id().alias("no")), "vectors")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "label")).alias("m")).select("id", "m.*")
    asked = written(asked, "anchors")
    blocks, groups = -(-n // block), max(1, -(-asked.count() // anchors))
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("no"), F.lit(blocks))).drop("no").withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def meet(anchored: DataFrame, unit) -> DataFrame:
        each = anchored.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        return dealt.groupBy("g", "s").cogroup(each.groupBy("g", "s")).applyInArrow(unit, "anchor bigint, score bigint, id bigint")

    def scored(left: pa.Table, right: pa.Table):
        """Per slice of anchors: their places in ``right``, scores, the rows' ids (sorted), and who shares a label or an id."""
        left = left.take(pa.array(np.argsort(left.column("id").to_numpy(), kind="stable")))
        (x, q), ids, own = (np.floor(stacked(t) * scale) for t in (left, right)), left.column("id").to_numpy(), right.column("id").to_numpy()
        labels, own_labels = left.column("label").to_numpy(), right.column("label").to_numpy()
        for at in range(0, len(own) if len(ids) else 0, SLICE):
            part = slice(at, at + SLICE)
            yield at, products(q[part], x), ids, own_labels[part, None] == labels, own[part, None] == ids

    def table(found: list) -> pa.Table:
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3)]
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["anchor", "score", "id"])

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        found, own = [], right.column("id").to_numpy()
        for at, scores, ids, alike, self_ in scored(left, right):
            for i, s in enumerate(scores):
                top = first_of(s, alike[i] & ~self_[i], positives)
                found.append((np.full(len(top), own[at + i]), s[top], ids[top]))
        return table(found)

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        found, own, bars = [], right.column("id").to_numpy(), right.column("bars").to_pylist()
        for at, scores, ids, alike, self_ in scored(left, right):
            for i, s in enumerate(scores):
                other, top = ~alike[i] & ~self_[i], set()
                for p in set(bars[at + i]):
                    low, high = window(p, least, most)
                    top.update(first_of(s, other & (s >= low) & (s <= high), negatives).tolist() if low <= high else ())
                top = np.array(sorted(top), dtype=np.int64)
                found.append((np.full(len(top), own[at + i]), s[top], ids[top]))
        return table(found)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = written(meet(asked, same).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= positives).drop("_r"), "positives")
    bars = near.groupBy("anchor").agg(F.collect_list("score").alias("bars"))  # at most ``positives`` of each
    far = meet(asked.join(bars, asked.id == bars.anchor).drop("anchor"), others)

    def packed(batches):
        for b in batches:
            keys = [pack(*r) for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "score", "positive", "id")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("anchor"), pa.array(keys, pa.binary())], names=["anchor", "key"])

    def windows(batches):
        keys = (k for b in batches for k in b.column(1).to_pylist())
        batch = []
        for r in stream(keys, positives, negatives, least, most):
            batch.append(r)
            if len(batch) == 10_000:
                yield _result(batch)
                batch = []
        yield _result(batch)

    pairs = near.withColumn("positive", F.lit(True)).unionByName(far.withColumn("positive", F.lit(False)))
    # repartitionAndSortWithinPartitions of the packed keys
    keyed = pairs.mapInArrow(packed, "anchor bigint, key binary").repartition("anchor").sortWithinPartitions("key")
    return keyed.mapInArrow(windows, out)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
