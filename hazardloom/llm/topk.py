"""Exact top-k inner products of integer vectors by columnar branch-and-bound.

Candidates lie in stripes in vertical layout, one row per dimension. Block of dimensions by block of dimensions a query adds up its
partial products; what the dimensions left can still add is at most the product of the two remaining norms, and candidates that
can't reach the query's k-th best any more are taken out of the arrays.

Every query begins with a bar for all stripes, its k-th best score among pilot vectors. Stripes hold candidates of one band of norms, so
bands whose largest norm times the query's stays below the bar don't meet the query at all, before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.vectors import EXACT, best, products, queries_of, ranked, stacked, usable
from hazardloom.session import written

STRIPE, GROUP = 4096, 512  # vectors and queries of a work unit
PILOT = 2048  # vectors of the largest norms, which give each query its first bar
BANDS = 64  # bands of norms, at most; a band holds a stripe or more
SLACK = 1e-9  # what doubles may be off in norms and their products, as a share
BLOCK = 8  # dimensions added at once


def search_stripe(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int, block: int = BLOCK, bars: np.ndarray | None = None):
    """(query, id, score) of the k best of a stripe for each query; x and q hold whole numbers. Also the share of products made.

    Scores below a query's entry in ``bars`` are of no use to it and may be left out.
    """
    (m, dim), n = q.shape, len(ids)
    seeds = min(n, 16 * k)
    ends = [*range(block, dim, block), dim]
    starts = [0, *ends[:-1]]
    rest_x = [np.sqrt((x[:, e:] ** 2).sum(axis=1)) * (1 + SLACK) for e in ends]
    rest_q = [np.sqrt((q[:, e:] ** 2).sum(axis=1)) for e in ends]
    columns = np.ascontiguousarray(x.T)
    own = query_ids[:, None] == ids[None, :]
    bars = np.full(m, -np.inf) if bars is None else bars
    if seeds >= k:
        known = np.where(own[:, :seeds], -np.inf, q @ columns[:, :seeds])
        bars = np.maximum(bars, np.partition(known, seeds - k, axis=1)[:, seeds - k])
    partial, made = np.zeros((m, n)), 0
    for b, (s, e) in enumerate(zip(starts, ends, strict=True)):  # all pairs at once, until most are out
        partial += q[:, s:e] @ columns[s:e]
        made += m * n * (e - s)
        alive = partial + 1e-6 >= bars[:, None] - rest_q[b][:, None] * rest_x[b][None, :]
        if 4 * np.count_nonzero(alive) < m * n:
            break
    alive &= ~own
    out = []
    for i in range(m):
        at, bar = np.flatnonzero(alive[i]), bars[i]
        sums = partial[i, at]
        for c in range(b + 1, len(ends)):  # the few left, compacted for each query
            if k <= len(at):  # what is sure already may raise the bar
                bar = max(bar, np.partition(sums - rest_q[c - 1][i] * rest_x[c - 1][at] - 1e-6, -k)[-k])
            sums = sums + q[i, starts[c] : ends[c]] @ columns[starts[c] : ends[c], at]
            made += len(at) * (ends[c] - starts[c])
            stay = sums + rest_q[c][i] * rest_x[c][at] + 1e-6 >= bar
            at, sums = at[stay], sums[stay]
        top = best(sums, ids[at], k)
        out.append((np.full(len(top), query_ids[i]), ids[at][top], sums[top]))
    share = made / max(1, m * n * dim)
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3, share


def search_whole(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int):
    """As ``search_stripe`` for products that doubles don't hold: all are made, modulo 2^64, and bound to 64 bits beyond."""
    out = []
    for at in range(0, len(q), 64):
        for query, scores in zip(query_ids[at : at + 64], products(q[at : at + 64], x), strict=True):
            other = np.flatnonzero(ids != query)
            top = other[np.lexsort((ids[other], ~scores[other]))[:k]]  # ~s falls as s rises, at every 64-bit number
            out.append((np.full(len(top), query), ids[top], scores[top]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def first_bars(q: np.ndarray, query_ids: np.ndarray, pilot: np.ndarray, pilot_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the pilot vectors but its own; minus infinity where there are fewer or doubles don't hold the scores."""
    if len(pilot) < k or np.abs(q).max(initial=0) * np.abs(pilot).max(initial=0) * q.shape[1] >= EXACT:
        return np.full(len(q), -np.inf)
    scores = np.where(query_ids[:, None] == pilot_ids[None, :], -np.inf, q @ pilot.T)
    return np.partition(scores, len(pilot) - k, axis=1)[:, len(pilot) - k]


def groups_by_reach(queries: list[int], group: int) -> tuple[list[int], list[int], list[int]]:
    """Group queries by the bands they reach. ``queries[r]`` is the number of queries that reach the first r bands.

    Returns for each reach its first group and number of groups, and for each band how many groups, from group 0 on, reach it. Reaches that
    few queries share join the next larger one, so there are at most twice as many groups as full ones, and one.
    """
    first, number = [0] * len(queries), [1] * len(queries)
    met, made, members, held_ = [0] * (len(queries) - 1), 0, [], 0
    for r in range(len(queries) - 1, -1, -1):
        members, held_ = [*members, r], held_ + queries[r]
        if held_ and (held_ >= group or r == 0):
            n = -(-held_ // group)
            for v in members:
                first[v], number[v] = made, n
            made += n
            for band in range(max(v for v in members if queries[v])):
                met[band] = made
            members, held_ = [], 0
    return first, number, met


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id",
                vec_col: str = "embedding", stripe: int = STRIPE, group: int = GROUP, pilot: int = PILOT, bands: int = BANDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query, exactly.

    A component x becomes floor(scale * x). Queries are the rows whose id is divisible by ``every``; all other rows that take
    part (see ``usable``) are candidates, repeated ones as often as they occur, but for rows with the query's own id.
    Stripes of candidates meet groups of queries, each of bounded size; a query then merges its k best of each stripe.
    Candidates are dealt to stripes by band of norms and row, so rows of one id or one vector spread like others. A query meets the
    bands, from the largest norms down, that can reach its k-th best among ``pilot`` vectors of the largest norms; queries that reach equally
    far are grouped, so a band's candidates go only to groups that reach it. Scores beyond 64 bits are bound to them. An empty table gives
    no rows. To the driver come the pilot vectors and three numbers for each of at most ``bands`` + 1 bands.
    """
    rows, n, _ = usable(vectors, id_col, vec_col)
    if not n:
        return rows.selectExpr("id AS query_id", "1 AS rank", "id AS vec_id", "0L AS score")

    def whole(batches):
        for b in batches:
            if b.num_rows:
                x = np.floor(stacked(pa.Table.from_batches([b])) * scale)
                with np.errstate(over="ignore"):
                    norm = np.sqrt((x**2).sum(axis=1))
                flat = pa.array(x.ravel())
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, flat), pa.array(norm)], names=["id", "vec", "norm"])

    held = rows.mapInArrow(whole, "id bigint, vec array<double>, norm double")
    held = written(held.withColumn("row", F.monotonically_increasing_id()), "whole")
    bands = min(bands, -(-n // stripe))
    edges = held.agg(F.percentile_approx("norm", [1 - i / bands for i in range(1, bands)])).first()[0] if bands > 1 else []
    edges = sorted(set(edges), reverse=True)  # band b holds norms from edges[b] up that no band before it holds
    lit = lambda values, kind: F.lit(list(values)).cast(f"array<{kind}>")
    held = held.withColumn("band", F.size(F.filter(lit(edges, "double"), lambda e: F.col("norm") < e)))
    size, largest = [0] * (len(edges) + 1), [0.0] * (len(edges) + 1)
    for r in held.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect():
        size[r.band], largest[r.band] = r.n, r.top
    tops = np.array(largest)
    top = held.orderBy(F.desc("norm"), "row").limit(pilot).select("id", "vec").collect()
    pilot_ids, pilot_x = np.array([r.id for r in top]), np.array([r.vec for r in top])

    def reach(batches):
        for b in batches:
            if b.num_rows:
                q, ids = stacked(pa.Table.from_batches([b])), b.column(0).to_numpy()
                bars = first_bars(q, ids, pilot_x, pilot_ids, k)
                with np.errstate(over="ignore", invalid="ignore"):
                    most = np.sqrt((q**2).sum(axis=1))[:, None] * tops[None, :] * (1 + SLACK) + 1e-6
                most = np.where(np.isnan(most), np.inf, most)  # zero times a norm beyond doubles
                far = len(tops) - (most >= bars[:, None])[:, ::-1].argmax(axis=1)  # the last band that can reach the bar
                far = np.where((most >= bars[:, None]).any(axis=1), far, 0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bars), pa.array(far.astype(np.int32))], names=["id", "vec", "bar", "far"])

    asked = written(queries_of(held.select("id", "vec"), every).mapInArrow(reach, "id bigint, vec array<double>, bar double, far int"), "asked")
    queries = [0] * (len(size) + 1)
    for r in asked.groupBy("far").count().collect():
        queries[r.far] = r["count"]
    first, number, met = groups_by_reach(queries, group)
    parts = [-(-c // stripe) for c in size]
    before = np.concatenate([[0], np.cumsum(parts)]).tolist()  # stripes of earlier bands
    of = lambda values, at: F.get(lit(values, "bigint"), F.col(at))
    count_up = lambda end: F.explode(F.when(end > 0, F.sequence(F.lit(0).cast("bigint"), end - 1)))
    candidates = held.withColumn("s", of(before, "band") + F.pmod(F.xxhash64("row"), of(parts, "band"))).withColumn("g", count_up(of(met, "band")))
    asked = asked.withColumn("g", of(first, "far") + F.pmod(F.xxhash64("id", F.lit(1)), of(number, "far"))).withColumn("s", count_up(of(before, "far")))

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = stacked(left), stacked(right)
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        if not len(ids) or not len(query_ids):
            got = [np.zeros(0, dtype=np.int64)] * 3
        elif np.abs(x).max() * np.abs(q).max() * x.shape[1] < EXACT:
            got = search_stripe(x, ids, q, query_ids, k, bars=right.column("bar").to_numpy())[0]
        else:
            got = search_whole(x, ids, q, query_ids, k)
        return pa.table([pa.array(c.astype(np.int64)) for c in got], names=["query_id", "vec_id", "score"])

    left, right = candidates.select("g", "s", "id", "vec").groupBy("g", "s"), asked.select("g", "s", "id", "vec", "bar").groupBy("g", "s")
    return ranked(left.cogroup(right).applyInArrow(unit, "query_id bigint, vec_id bigint, score bigint"), k)
