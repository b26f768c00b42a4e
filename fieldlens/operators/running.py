"""Running sums and ranks over a whole table, without all rows in one task.

The key's range is cut at approximate quantiles. Sums run within each bucket;
the buckets' totals, a few rows, give what comes before each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a running sum.
BUCKETS = 64


def running(rows: DataFrame, key: str, sums: dict[str, str], falling: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """rows with a running sum for each out: column of sums, up to and with the row, in order of the key (whose values are distinct)."""
    kind = rows.schema[key].dataType
    run = Window.orderBy(F.col(key).desc() if falling else F.col(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not isinstance(kind, T.NumericType):
        return rows.withColumns({out: F.sum(c).over(run) for out, c in sums.items()})
    cuts = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast(kind) for c in sorted(set(cuts))]) if cuts else F.array().cast(T.ArrayType(kind))
    cut = rows.withColumn("_b", F.size(F.filter(bounds, lambda b: b <= F.col(key))))
    order = F.col(key).desc() if falling else F.col(key)
    inner = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy(F.col("_b").desc() if falling else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = totals.select("_b", *[F.coalesce(F.sum(f"_t_{out}").over(outer), F.lit(0)).alias(f"_p_{out}") for out in sums])
    local = cut.withColumns({out: F.sum(c).over(inner) for out, c in sums.items()})
    return local.join(F.broadcast(before), "_b").withColumns({out: F.col(out) + F.col(f"_p_{out}") for out in sums}).select(*rows.columns, *sums)


def ranked(rows: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """rows with their 0-based rank by a key of distinct values."""
    return running(rows.withColumn("_one", F.lit(1).cast("long")), key, {out: "_one"}).withColumn(out, F.col(out) - 1).drop("_one")
