"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling.

With one more component, sqrt(M^2 - |x|^2) for candidates (M their largest norm) and 0 for queries, the largest inner product is the
smallest distance. A random rotation spreads what distinguishes vectors evenly over the dimensions, so a distance over the first d
of D dimensions, times sqrt(D / d), estimates the whole one; a test at every block of dimensions abandons candidates that are
too far with high probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.vectors import best, queries_of, ranked, stacked, usable
from hazardloom.session import written

SAMPLE = 65_536  # vectors, at most, that the lists' centres are fitted on
PER_CENTRE = 64  # vectors of the sample for each centre
BAR_SAMPLE = 2048  # vectors that give each query its first distance to beat
RECALL = 0.96  # of the nearest, that the probed lists of a query should hold
BLOCK = 8
EPSILON = 2.1  # of the test: a candidate is abandoned if its estimate exceeds the bar by EPSILON / sqrt(d)
LIST_PART, QUERY_PART = 4096, 256
SEED = 42


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Candidates with the component that makes all norms equal."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, largest**2 - (x**2).sum(axis=1)))])


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to a term that is the same for all centres."""
    return (centres**2).sum(axis=1) - 2 * x @ centres.T


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Centres by Lloyd rounds; a centre without vectors stays where it was."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        label = np.concatenate([nearest_centres(c, centres).argmin(axis=1) for c in np.array_split(sample, max(1, len(sample) // 4096))])
        count = np.bincount(label, minlength=lists)
        order = np.argsort(label, kind="stable")
        sums = np.add.reduceat(sample[order], np.minimum(np.cumsum(count) - count, len(sample) - 1))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def scan_part(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, bars: np.ndarray, turn: np.ndarray,
              largest: float, k: int, block: int = BLOCK, epsilon: float = EPSILON):
    """(query, id, score) of the k nearest found in part of a list; ``bars`` are squared distances to beat. Also the share scanned.

    Pairs of a query and a candidate lie in flat arrays, from which each test takes those it abandons.
    """
    columns = np.ascontiguousarray((lifted(x, largest) @ turn).T)
    turned = np.ascontiguousarray((np.column_stack([q, np.zeros(len(q))]) @ turn).T)
    dim, m, n = len(columns), len(q), len(ids)
    seeds = min(n, 2 * k)
    foreign = query_ids[:, None] != ids[None, :]
    known = np.where(foreign[:, :seeds], (q**2).sum(axis=1)[:, None] + largest**2 - 2 * q @ x[:seeds].T, np.inf)
    bar = np.minimum(bars, np.partition(known, k - 1, axis=1)[:, k - 1]) if seeds >= k else bars
    at_q, at_x = np.nonzero(foreign)
    partial, made = np.zeros(len(at_q)), 0
    for e in [*range(block, dim, block), dim]:
        start = (e - 1) // block * block
        made += len(at_q) * (e - start)
        for d in range(start, e):
            partial += (columns[d][at_x] - turned[d][at_q]) ** 2
        slack = (1 + epsilon / np.sqrt(e)) ** 2 if e < dim else 1 + 1e-9
        stay = partial * (dim / e) <= bar[at_q] * slack
        at_q, at_x, partial = at_q[stay], at_x[stay], partial[stay]
    alive = np.zeros((m, n), dtype=bool)
    alive[at_q, at_x] = True
    alive[:, :seeds] |= foreign[:, :seeds]  # so that a query with few finds still has some
    out = []
    for i in range(m):
        keep = np.flatnonzero(alive[i])
        score = x[keep] @ q[i]
        top = best(score, ids[keep], k)
        out.append((np.full(len(top), query_ids[i]), ids[keep][top], score[top]))
    share = made / max(1, m * n * dim)
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3, share


def probes_needed(sample: np.ndarray, centres: np.ndarray, largest: float, k: int, recall: float, most: int = 512) -> int:
    """Lists to probe so that ``recall`` of the k nearest are found, measured with queries from the sample.

    In all data the k nearest are nearer than in the sample, so this number is on the safe side there.
    """
    q, kept_ = sample[:most], min(k, len(sample) - 1)
    if kept_ < 1:
        return len(centres)
    label = np.concatenate([nearest_centres(c, centres).argmin(axis=1) for c in np.array_split(lifted(sample, largest), max(1, len(sample) // 4096))])
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argpartition(-score, kept_ - 1, axis=1)[:, :kept_]
    place = nearest_centres(np.column_stack([q, np.zeros(len(q))]), centres).argsort(axis=1).argsort(axis=1)
    places = np.sort(np.take_along_axis(place, label[top], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by inner product in doubles on the original vectors.

    Queries are the rows whose id is divisible by ``every``; candidates all rows that take part (see ``usable``; zero vectors
    don't) but those with the query's own id. About sqrt(n) lists are fitted on a sample of at most ``sample`` vectors, and every
    vector is put in its list. A query probes its nearest lists, as many as the sample needs for ``recall`` and until they hold
    8k vectors. Lists are scanned in parts of bounded size for groups of queries of bounded size. If there are no more
    than 8k candidates, all of them are scanned. There are at most ``sample`` / PER_CENTRE lists, so beyond the square of that number of
    vectors ``sample`` should grow with the root of the table. Repeated rows are candidates as often as they come, a repeated query
    asks with its smallest vector; null ids take no part; other columns are not read. An empty table gives no rows.
    """
    rows, _, dim = usable(vectors, id_col, vec_col)
    rows = written(rows.where(F.exists("vec", lambda v: v != 0)), "usable")  # five passes follow
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    n, norm = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    lists = int(max(1, min(round(n**0.5), sample // PER_CENTRE, n // 8)))
    drawn = np.array([r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, max(BAR_SAMPLE, PER_CENTRE * lists))).collect()])
    turn, largest = rotation(dim + 1), float(norm)
    centres, bar_sample = fit_centres(lifted(drawn, largest), lists), drawn[:BAR_SAMPLE]

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = stacked(pa.Table.from_batches([b]))
                label = nearest_centres(lifted(x, largest), centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label.astype(np.int32))], names=["id", "vec", "list"])

    held = written(rows.mapInArrow(assign, "id bigint, vec array<double>, list int"), "lists")
    size = np.zeros(lists, dtype=np.int64)
    for r in held.groupBy("list").count().collect():  # one row per list
        size[r["list"]] = r["count"]
    probes = probes_needed(drawn, centres, largest, k, recall)

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = stacked(pa.Table.from_batches([b]))
            order = nearest_centres(np.column_stack([q, np.zeros(len(q))]), centres).argsort(axis=1)
            enough = (np.cumsum(size[order], axis=1) < 8 * k).sum(axis=1) + 1
            count = np.minimum(lists, np.maximum(probes, enough))
            distance = (q**2).sum(axis=1)[:, None] + largest**2 - 2 * q @ bar_sample.T
            # the k-th and one more, as the query itself may be in the sample
            bar = np.partition(distance, k, axis=1)[:, k] if len(bar_sample) > k else np.full(len(q), np.inf)
            row = np.repeat(np.arange(len(q)), count)
            chosen = np.concatenate([o[:c] for o, c in zip(order, count, strict=True)])
            take = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [take.column(0), take.column(1), pa.array(bar[row]), pa.array(chosen.astype(np.int32))], names=["id", "vec", "bar", "list"]
            )

    asked = written(queries_of(rows, every).mapInArrow(probe, "id bigint, vec array<double>, bar double, list int"), "probes")
    readers = np.zeros(lists, dtype=np.int64)
    for r in asked.groupBy("list").count().collect():
        readers[r["list"]] = r["count"]
    spark = vectors.sparkSession
    shape = [(i, int(max(1, -(-size[i] // LIST_PART))), int(max(1, -(-readers[i] // QUERY_PART)))) for i in range(lists)]
    shape = F.broadcast(spark.createDataFrame(shape, "list int, parts int, groups int"))  # a row per list
    part, group = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.pmod(F.xxhash64("id"), "groups").cast("int")
    left = held.join(shape, "list").withColumn("part", part).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = asked.join(shape, "list").withColumn("group", group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def unit(a: pa.Table, b: pa.Table) -> pa.Table:
        got = [np.zeros(0)] * 3
        if a.num_rows and b.num_rows:
            got = scan_part(stacked(a), a.column("id").to_numpy(), stacked(b), b.column("id").to_numpy(), b.column("bar").to_numpy(), turn, largest, k)[0]
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(c.astype(t)) for c, t in zip(got, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["list", "part", "group"]
    found = left.select(*keys, "id", "vec").groupBy(*keys).cogroup(right.select(*keys, "id", "vec", "bar").groupBy(*keys))
    return ranked(found.applyInArrow(unit, "query_id bigint, vec_id bigint, score double"), k)
