"""Column roles of an interaction log, and the checks that need no data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InsufficientData(ValueError):
    """Too few eligible items, users or rows for what was asked."""


@dataclass(frozen=True)
class Schema:
    """Names the columns of a log. ``order`` are tie-breakers that make row order total:
    a table has no row positions, so "latest" goes by ``time``, then by these."""

    user: str = "user_id"
    item: str = "item_id"
    value: str | None = "value"
    time: str | None = None
    order: tuple[str, ...] = ()
    context: tuple[str, ...] = ()

    def timed(self) -> tuple[str, ...]:
        return ((self.time,) if self.time else ()) + self.order

    def without_time(self) -> Schema:
        return replace(self, time=None)

    def check(self, df: DataFrame) -> None:
        """Column presence and types; ids are integers, strings or dates, never floats."""
        missing = [c for c in (self.user, self.item, *(x for x in (self.value, self.time) if x), *self.order, *self.context) if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are not in {df.columns}")
        for c in (self.user, self.item):
            if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
                raise TypeError(f"{c}: ids must not be fractional numbers, which collide when rounded; cast them first")
        if self.value and not isinstance(df.schema[self.value].dataType, T.NumericType):
            raise TypeError(f"{self.value}: interaction values must be numbers")
        if self.time and isinstance(df.schema[self.time].dataType, T.StringType):
            raise TypeError(f"{self.time}: times must be numbers, dates or timestamps")


def interactions(df: DataFrame, schema: Schema = Schema(), *, strict: bool = False) -> DataFrame:
    """``df`` with the standard names user_id, item_id, value (1.0 where the schema names
    none), time, the order columns and the context.

    With ``strict`` a null id, a value or time that is null or not finite raises while the
    query runs; without it such rows are dropped.
    """
    schema.check(df)
    value = F.col(schema.value).cast("double") if schema.value else F.lit(1.0)
    columns = [F.col(schema.user).alias("user_id"), F.col(schema.item).alias("item_id"), value.alias("value")]
    if schema.time:
        columns.append(F.col(schema.time).alias("time"))
    out = df.select(*columns, *[c for c in (*schema.order, *schema.context) if c not in ("user_id", "item_id", "value", "time")])
    sound = F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    if schema.time:
        sound = sound & F.col("time").isNotNull()
    if strict:
        ok = F.assert_true(sound, F.lit("an interaction lacks an id, a finite value or a time"))
        return out.withColumn("value", F.when(ok.isNull(), F.col("value")))
    return out.filter(sound)


def matrix(log: DataFrame) -> DataFrame:
    """R(user_id, item_id, r): values summed over repeated pairs; sums of zero stay."""
    return log.groupBy("user_id", "item_id").agg(F.sum("value").alias("r"))
