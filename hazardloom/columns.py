"""Column names, defaults and the raw schema of a device panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelColumns:
    """Names the operators use. ``row_key`` is a unique row identity written at ingest.

    It stands for the file order: the row with the smallest key comes first.
    """

    id: str = "serial_number"
    date: str = "date"
    time: str = "time"
    label: str = "failure"
    category: str = "model"
    season: str = "season"
    row_key: str = "row_key"
    lifetime: str = "max_lifetime"
    measure_prefix: str = "smart"

    def measures(self, columns) -> list[str]:
        return [c for c in columns if c.startswith(self.measure_prefix)]

    def not_features(self) -> set[str]:
        return {self.id, self.date, self.time, self.label, self.row_key, self.lifetime, "split", "batch", "batchnum", "truncated"}


PANEL = PanelColumns()

# Defaults that results depend on.
ROWS_PER_BATCH = 500_000
TEST_SIZE = 0.2
TRAIN_SAMPLES = 10
NAN_FRACTION = 0.5
TIMES = tuple(range(1, 160))
HIDDEN_UNITS = 64
EPOCHS = 10
STATIC_STATS = [
    "data_size",
    "min_date",
    "max_date",
    "mean_lifetime",
    "max_lifetime",
    "na_rate",
    "truncated_rate",
    "survival_rate",
    "failure_rate",
    "double_failures",
    "mean_time_between_observ",
    "mean_observ_per_day",
]
DYNAMIC_STATS = [
    "mean_lifetime",
    "max_lifetime",
    "na_rate",
    "survival_rate",
    "failure_rate",
    "mean_observ_per_day",
]

# Columns that are never features.
UNUSED_FEATURES = [
    "smart_1_normalized", "smart_2_normalized", "smart_3_normalized", "smart_4_normalized", "smart_5_normalized",
    "smart_7_normalized", "smart_8_normalized", "smart_9_normalized", "smart_10_normalized", "smart_11_normalized",
    "smart_12_normalized", "smart_13_normalized", "smart_15_normalized", "smart_183_normalized",
    "smart_184_normalized", "smart_187_normalized", "smart_188_normalized", "smart_189_normalized",
    "smart_190_normalized", "smart_191_normalized", "smart_192_normalized", "smart_193_normalized",
    "smart_194_normalized", "smart_195_normalized", "smart_196_normalized", "smart_197_normalized",
    "smart_198_normalized", "smart_199_normalized", "smart_200_normalized", "smart_201_normalized",
    "smart_223_normalized", "smart_225_normalized", "smart_240_normalized", "smart_241_normalized",
    "smart_242_normalized", "smart_250_normalized", "smart_251_normalized", "smart_252_normalized",
    "smart_254_normalized", "smart_255_normalized",
]

_TYPED = {
    "date": T.DateType(),
    "serial_number": T.StringType(),
    "model": T.StringType(),
    "capacity_bytes": T.LongType(),
    "failure": T.IntegerType(),
    "row_key": T.LongType(),
    "time": T.IntegerType(),
    "max_lifetime": T.IntegerType(),
}


def raw_type(name: str, cols: PanelColumns = PANEL) -> T.DataType:
    """Type of a raw column, by name: known columns are typed, measures are doubles, the rest is text."""
    if name in _TYPED:
        return _TYPED[name]
    return T.DoubleType() if name.startswith(cols.measure_prefix) else T.StringType()
