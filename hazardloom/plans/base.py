"""Shared pieces of the registered queries: rounding and common inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.plans.panel import PANEL_CTE

_SMALL_INTS = (T.ByteType, T.ShortType, T.IntegerType)


def tidy(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Round doubles (unless ``digits`` is None) and widen integers, as the SQL does, so that both sides compare exactly."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType) and digits is not None:
            c = F.round(c, digits) + 0.0
        elif isinstance(f.dataType, _SMALL_INTS) or isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PANEL_CTE.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()
