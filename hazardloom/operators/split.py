"""Truncated devices and the train/test assignment of devices.

All decisions are made on one row per device; panel rows are only touched when a part of the panel is selected.
"""

from __future__ import annotations

from datetime import date as Date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.columns import PANEL, TEST_SIZE, PanelColumns
from hazardloom.functions import hash_order
from hazardloom.operators.keyed import lookup
from hazardloom.session import written

RANKED = 50_000  # devices of a label that are ranked together, about


def device_facts(df: DataFrame, horizon: Date | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """(device, label, truncated): the largest label, and whether a non-failure row lies on the last day.

    ``horizon`` is that last day; by default the newest date of ``df``, for which the devices are written once so that
    the panel is scanned once.
    """
    is_open = (~F.col(cols.label).eqNullSafe(F.lit(1))).cast("int")
    devices = df.where(F.col(cols.id).isNotNull()).groupBy(cols.id).agg(
        F.coalesce(F.max(cols.label), F.lit(0)).cast("int").alias("label"),
        F.max(F.unix_date(cols.date) * 2 + is_open).alias("_last_open"),
    ).withColumn("_day", F.shiftright("_last_open", 1))
    if horizon is not None:
        on_last = F.col("_day") == F.unix_date(F.lit(horizon))
    else:
        devices = written(devices, "devices")
        newest = devices.agg(F.max("_day").alias("_day")).withColumn("_on_last", F.lit(True))
        devices = devices.join(F.broadcast(newest), "_day", "left")
        on_last = F.col("_on_last")
    return devices.select(
        cols.id, "label", F.coalesce(on_last & (F.col("_last_open") % 2 == 1), F.lit(False)).alias("truncated")
    )


def truncated_ids(df: DataFrame, horizon: Date | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Devices still running on the last day."""
    return device_facts(df, horizon, cols).where("truncated").select(cols.id)


def remove_truncated(df: DataFrame, horizon: Date | None = None, cols: PanelColumns = PANEL) -> tuple[DataFrame, DataFrame]:
    """The rows of all other devices, and the truncated devices."""
    ids = truncated_ids(df, horizon, cols)
    return lookup(df, ids, cols.id, "left_anti"), ids


def stratify(facts: DataFrame, test_size: float = TEST_SIZE, seed: int = 42, cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``split``: per label, the first round(n * test_size) devices in hash order are the test part.

    The last hash of the test part is found by radix selection: devices are counted per label and hash prefix, of as many digits as
    leave about RANKED devices to each; running sums of those counts name the prefix in which the cut falls, and only its
    devices are ranked. One hash per label then decides for every device.
    """
    hashed = written(facts.withColumn("_hash", hash_order(cols.id, seed=seed)), "hashed")
    n, digits = hashed.count(), 0
    while n > RANKED * 16**digits:
        digits += 1
    prefixed = hashed.withColumn("_prefix", F.substring("_hash", 1, digits))
    by_label = Window.partitionBy("label")
    sizes = prefixed.groupBy("label", "_prefix").agg(F.count(F.lit(1)).alias("_n")).select(
        "label", "_prefix", "_n",
        F.sum("_n").over(by_label.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.round(F.sum("_n").over(by_label) * F.lit(test_size)).alias("_cut"),
    )
    # where the cut falls; of the devices before it all, of those in it ``need`` are test devices. One row per label comes to the driver.
    found = sizes.where("_upto > _cut").groupBy("label").agg(F.min(F.struct("_prefix", (F.col("_cut") - F.col("_upto") + F.col("_n")).alias("need"))).alias("m"))
    edges = {r.label: (r.m["_prefix"], int(r.m["need"])) for r in found.collect()}
    last = {label: prefix for label, (prefix, _) in edges.items()}  # where no device of the prefix is a test device
    wanted = [(F.col("label") == label) & (F.col("_prefix") == prefix) for label, (prefix, need) in edges.items() if need]
    if wanted:
        ranked = prefixed.where(reduce(or_, wanted)).withColumn("_rank", F.row_number().over(by_label.orderBy("_hash")))
        need = reduce(or_, [(F.col("label") == label) & (F.col("_rank") == n) for label, (_, n) in edges.items()])
        last |= {r.label: r["_hash"] for r in ranked.where(need).select("label", "_hash").collect()}
    train = reduce(or_, [(F.col("label") == label) & (F.col("_hash") > h) for label, h in last.items()], F.lit(False))
    return hashed.select(*facts.columns, F.when(train, "train").otherwise("test").alias("split"))  # a label without a cut is all test


def stratified_split(df: DataFrame, test_size: float = TEST_SIZE, seed: int = 42, cols: PanelColumns = PANEL) -> DataFrame:
    """(device, label, split), stratified by whether the device ever failed."""
    return stratify(device_facts(df, None, cols).drop("truncated"), test_size, seed, cols)


def split_rows(df: DataFrame, devices: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Panel rows of the given devices."""
    return lookup(df, devices.select(cols.id), cols.id, "left_semi")


def initial_split(
    df: DataFrame, test_size: float = TEST_SIZE, seed: int = 42, rm_truncated_from_test: bool = True,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Assignment table (device, split, truncated); train and test are its rows that are not truncated."""
    return _assignment(stratify(device_facts(df, None, cols), test_size, seed, cols), rm_truncated_from_test, cols)


def _assignment(stratified: DataFrame, rm_truncated_from_test: bool, cols: PanelColumns) -> DataFrame:
    held = F.col("truncated") if rm_truncated_from_test else F.col("truncated") & (F.col("split") == "train")
    return stratified.select(cols.id, "split", held.alias("truncated"))


def find_untruncated(new: DataFrame, state: DataFrame, horizon: Date | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Devices the state holds as truncated that have rows in the new data and are not truncated there."""
    running = device_facts(new, horizon, cols).where("NOT truncated").select(cols.id)
    return running.intersect(state.where("truncated").select(cols.id))


def new_devices(new: DataFrame, state: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Devices of the new data the state does not know."""
    return new.where(F.col(cols.id).isNotNull()).select(cols.id).distinct().subtract(state.select(cols.id))


def update_split(
    new: DataFrame, state: DataFrame, test_size: float = TEST_SIZE, seed: int = 42, rm_truncated_from_test: bool = True,
    horizon: Date | None = None, cols: PanelColumns = PANEL,
) -> DataFrame:
    """Next version of the assignment table.

    Devices that are no longer truncated return to their old side; unknown devices are split like the first ones.
    """
    facts = device_facts(new, horizon, cols)
    seen = facts.select(cols.id, F.col("truncated").alias("_still"))
    known = state.join(seen, cols.id, "left").select(
        cols.id, "split", (F.col("truncated") & F.coalesce("_still", F.lit(True))).alias("truncated")
    )
    fresh = stratify(facts.join(state.select(cols.id), cols.id, "left_anti"), test_size, seed, cols)
    return known.unionByName(_assignment(fresh, rm_truncated_from_test, cols))
