"""Concordance index and integrated Brier score."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, TIMES, PanelColumns
from hazardloom.functions.curves import SLICE, as_arrays, as_arrow, as_matrix, as_numpy, curve_source, slices
from hazardloom.functions.dominance import bucket_counts, span_counts
from hazardloom.operators.hazard import HazardModel, predict
from hazardloom.operators.ranks import sums_above
from hazardloom.session import discard, small_batches, written

VALUES_PER_BUCKET = 50_000
BUCKETS, SPANS = 256, 64  # ranges of the prediction and of the outcome; more, once they would hold over VALUES_PER_BUCKET points
_EXACT = "decimal(38,0)"


def _product(a: str, b: str):
    """Sum of products of two counts, exact at any size."""
    return F.coalesce(F.sum((F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast(_EXACT)), F.lit(0)).cast(_EXACT)


def _ranges(n: int, least: int, most: int) -> int:
    """Into how many ranges to cut ``n`` points: about ``most`` at most, of ``least`` points at least, unless they would hold over VALUES_PER_BUCKET."""
    size = max(1, least, min(VALUES_PER_BUCKET, -(-n // most)))
    return max(1, -(-n // size))


def concordance(
    df: DataFrame, duration: str = "duration", predicted: str = "predicted", event: str = "failure",
    values_per_bucket: int = VALUES_PER_BUCKET,
) -> DataFrame:
    """One row: pairs, concordant, tied (decimals) and ci = (concordant + tied / 2) / pairs, exact.

    A pair counts if the earlier duration is an event; at equal durations an event precedes a censoring. Durations may be any
    numbers. Rows with a missing value are left out; a NaN prediction is an error. No pair is ever
    built. Rows are first counted per (duration, event, prediction), so copies and ties collapse before anything else, and
    cut into ranges of the prediction and into ranges of the outcome (duration, event). A range of the prediction holds
    ``values_per_bucket`` points, or more where that would make over ``BUCKETS`` ranges, but VALUES_PER_BUCKET then at most. Each pair is
    counted once: on the arrays of its range of the prediction if it has one in common; else on the arrays of its range of the outcome,
    by the range numbers; else from the small table of points per pair of ranges, bit by bit over the prediction's range numbers: at the
    highest bit where they differ, the side with the bit set has all the larger predictions, so running sums over the ranges of the
    outcome decide. A point is thus shuffled a fixed number of times, however many ranges there are.
    """
    points = written(
        df.select(
            F.col(duration).cast("double").alias("d"), F.when(F.col(event).cast("boolean"), 0).otherwise(1).alias("e"),
            F.col(predicted).cast("double").alias("p"), F.col(event).alias("_e"),
        ).where("d IS NOT NULL AND p IS NOT NULL AND _e IS NOT NULL").groupBy("d", "e", "p").agg(F.count(F.lit(1)).alias("n")),
        "points",
    )
    n_points, bad = points.agg(F.count(F.lit(1)), F.count_if(F.isnan("p") | F.isnan("d"))).first()
    if bad:
        raise ValueError("durations and predictions must not be NaN")
    buckets = _ranges(n_points, values_per_bucket, BUCKETS)
    spans = _ranges(n_points, values_per_bucket, SPANS)
    # equal predictions share a range, and so do equal outcomes
    coded = points.repartitionByRange(buckets, "p").withColumn("b", F.spark_partition_id())
    coded = written(coded.repartitionByRange(spans, "d", "e").withColumn("s", F.spark_partition_id()), "buckets")

    inside = coded.groupBy("b").applyInArrow(bucket_counts, f"concordant {_EXACT}, tied {_EXACT}")
    met = coded.groupBy("s", "d", "e", "b").agg(F.sum("n").alias("n"))
    beside = met.groupBy("s").applyInArrow(span_counts, f"pairs {_EXACT}, concordant {_EXACT}")

    # counts per two ranges; only events are left members
    counts = [F.sum(F.when(F.col("e") == 0, F.col("n")).otherwise(0)).alias("ni"), F.sum("n").alias("nj")]
    cells = written(coded.groupBy("b", "s").agg(*counts), "cells")
    right = F.expr("shiftright(b, k) & 1 = 1")
    sides = (
        cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(buckets.bit_length() - 1, 0)))))
        .groupBy("k", F.expr("shiftright(b, k + 1)").alias("pre"), "s")
        .agg(F.sum(F.when(~right, F.col("ni")).otherwise(0)).alias("ni"), F.sum(F.when(right, F.col("nj")).otherwise(0)).alias("nj"))
    )
    across = sums_above(sides, ["k", "pre"], "s", "nj", spans, "_after").agg(_product("ni", "_after").alias("concordant"))
    whole = cells.groupBy("s").agg(F.sum("ni").alias("ni"), F.sum("nj").alias("nj"))  # one row per range of the outcome
    pairs = sums_above(whole, [], "s", "nj", spans, "_later").agg(_product("ni", "_later").alias("pairs"))

    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [beside, inside, across, pairs])
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(_EXACT).alias(c) for c in ("pairs", "concordant", "tied")])
    ci = (F.col("concordant").cast("double") + F.col("tied").cast("double") / 2) / F.nullif(F.col("pairs").cast("double"), F.lit(0.0))
    result = written(total.withColumn("ci", ci), "concordance")
    for table in (points, coded, cells):
        discard(table)
    return result


_FACTS = "duration double, event boolean, predicted double, errors array<double>, known array<bigint>"


def scored_facts(predictions: DataFrame, times=TIMES, cols: PanelColumns = PANEL, rows: bool = True) -> DataFrame:
    """What both scores need, in one pass over the curves: per row its duration, event and expected time, and per task one more row
    with the sums of squared errors and the numbers of rows with known status at every grid point (``errors``, ``known``).

    The sums of tasks add up, so a curve is read once and never unrolled into rows. S(t) is compared with 1 for rows still running after
    t and with 0 for failed rows; rows censored by t are left out. Rows without a curve are left out altogether. Without
    ``rows`` only the tasks' sums come. Predictions that are ``fillable`` come as the column that their curves follow from: the worker
    computes a slice of curves, scores it and lets it go, and no second worker of the task holds curves.
    """
    grid = np.asarray(times, dtype=float)
    source = curve_source(predictions)
    inputs, curves = source or (predictions, lambda column: as_matrix(column, len(grid)))
    given = source is None  # curves may then be missing

    def add(b, errors, known):
        """The batch's facts; its curves go when it ends, before the next batch is read."""
        if given and b.column(2).null_count:
            b = b.filter(b.column(2).is_valid())
        ends = as_numpy(b.column(0))[:, None]
        failed = as_numpy(b.column(1).cast(pa.int8()))[:, None] > 0  # missing: NaN, not failed
        area = np.empty(b.num_rows)
        for at in slices(b.num_rows):
            surv = curves(b.column(2)[at]).reshape(at.stop - at.start, len(grid))
            alive = ends[at] > grid
            seen = alive | failed[at]
            errors += np.where(seen, (alive - surv) ** 2, 0.0).sum(axis=0)
            known += seen.sum(axis=0)
            area[at] = np.trapezoid(surv, x=grid, axis=1)
        none = [pa.nulls(b.num_rows, pa.list_(t)) for t in (pa.float64(), pa.int64())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_arrow(area), *none], names=names)

    def each(batches):
        errors, known = np.zeros(len(grid)), np.zeros(len(grid), dtype=np.int64)
        for b in batches:
            b = add(b, errors, known)
            if rows and b.num_rows:
                yield b
            del b
        sums = [as_arrays(v[None, :]) for v in (errors, known)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.float64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.float64()), *sums], names=names)

    names = ["duration", "event", "predicted", "errors", "known"]
    surv = F.col("surv").cast("array<double>") if given else F.col("surv")
    needed = inputs.select(F.col("duration").cast("double"), F.col(cols.label).cast("boolean"), surv)
    return needed.mapInArrow(each, _FACTS)


def written_facts(predictions: DataFrame, times=TIMES, cols: PanelColumns = PANEL, rows: bool = True) -> DataFrame:
    """``scored_facts``, written. A worker holds the curves of SLICE rows at once: a batch of the usual 10,000 is 13 MB, of which the workers
    of a task keep several."""
    with small_batches(predictions.sparkSession, SLICE):
        return written(scored_facts(predictions, times, cols, rows), "facts")


def brier_of(facts: DataFrame, times=TIMES) -> DataFrame:
    """(t, brier, n_known) from the tasks' sums in ``scored_facts``; grid points at which no row is known are left out."""
    grid = F.array(*[F.lit(int(t)).alias("t") for t in times]).alias("t")
    sums = facts.where(F.col("errors").isNotNull()).select(F.inline(F.arrays_zip(grid, "errors", "known")))  # one row per task becomes the grid
    points = sums.groupBy("t").agg(F.sum("errors").alias("errors"), F.sum("known").alias("known")).where("known > 0")
    return points.select("t", (F.col("errors") / F.col("known")).alias("brier"), F.col("known").alias("n_known"))


def brier_curve(predictions: DataFrame, times=TIMES, cols: PanelColumns = PANEL) -> DataFrame:
    """(t, brier, n_known): mean squared error of S(t) over the rows whose status at t is known."""
    return brier_of(written_facts(predictions, times, cols, rows=False), times)


def integrated_brier(curve: DataFrame) -> DataFrame:
    """One row ``ibs_known``: trapezoid area of the Brier curve over its span."""
    step = Window.orderBy("t")  # one row per grid point
    piece = (F.col("brier") + F.lag("brier").over(step)) / 2 * (F.col("t") - F.lag("t").over(step))
    return curve.withColumn("_piece", piece).agg(
        (F.sum("_piece") / F.nullif((F.max("t") - F.min("t")).cast("double"), F.lit(0.0))).alias("ibs_known")
    )


def score_predictions(predictions: DataFrame, times=TIMES, cols: PanelColumns = PANEL, digits: int | None = None) -> DataFrame:
    """One row (ci, ibs). Both come from one pass over the curves; ``digits`` rounds expected times before they are ranked."""
    facts = written_facts(predictions, times, cols)
    predicted = F.col("predicted") if digits is None else F.round("predicted", digits)
    ci = concordance(facts.where("errors IS NULL").withColumn("predicted", predicted), event="event")
    ibs = integrated_brier(brier_of(facts, times)).select(F.col("ibs_known").alias("ibs"))
    both = ci.select("ci").unionByName(ibs, allowMissingColumns=True).agg(F.max("ci").alias("ci"), F.max("ibs").alias("ibs"))
    result = written(both, "scores")
    discard(facts)
    discard(ci)
    return result


def score(model: HazardModel, df: DataFrame, times=TIMES, cols: PanelColumns = PANEL) -> DataFrame:
    """Predict prepared rows and score them: one row (ci, ibs)."""
    return score_predictions(predict(model, df, times, "score", cols), times, cols)
