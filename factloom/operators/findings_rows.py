"""What all rule readings share: the registry's record and the shape of a finding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: int
    slug: str
    posture: str
    scope: str
    engine: str
    fn: Callable[..., DataFrame]


def finding(rows: DataFrame, message: Column, cause: Column | None = None, salience: Column | float = 1.0) -> DataFrame:
    s = salience if isinstance(salience, Column) else F.lit(float(salience))
    return rows.select("rel", "line", "col", "symbol", message.alias("message"), (cause if cause is not None else message).alias("cause"), s.cast("double").alias("salience"))


def text(fmt: str, *cols) -> Column:
    return F.format_string(fmt, *cols)
