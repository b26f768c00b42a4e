"""Unions of result sets and of annotation databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stacked(sets: list[DataFrame]) -> DataFrame:
    """All rows with the ordinal of their set as source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source", F.lit(i)) for i, s in enumerate(sets)])


def combined(sets: list[DataFrame], key: str = "file", unique: bool = True) -> DataFrame:
    """Union of image tables. unique: a key in two sets raises; else the first row with detections stays, without any the last."""
    rows = stacked(sets)
    if unique:
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        ok = rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated: "), F.col(key).cast("string")))).otherwise(F.col(key)))
        return ok.drop("_n", "source")
    has = F.col("detections").isNotNull()
    by = Window.partitionBy(key).orderBy(has.desc(), F.when(has, F.col("source")).otherwise(-F.col("source")))
    return rows.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "source")


def prefixed(df: DataFrame, source: int, columns: list[str]) -> DataFrame:
    """Ids made unique by their database: ds000_..."""
    return df.withColumns({c: F.concat(F.format_string("ds%03d_", F.lit(source)), F.col(c).cast("string")) for c in columns})


def insert_only(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known with the new keys of another table; rows of known keys must agree."""
    value = [c for c in known.columns if c != key]
    both = new.alias("n").join(known.alias("k"), key, "left")
    clash = F.col(f"k.{value[0]}").isNotNull() & ~reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in value])
    fresh = both.withColumn(key, F.when(clash, F.raise_error(F.concat(F.lit("conflict: "), F.col(key).cast("string"))).cast(new.schema[key].dataType)).otherwise(F.col(key)))
    return known.unionByName(fresh.select(key, *[F.col(f"n.{c}").alias(c) for c in value]).join(known.select(key), key, "left_anti"))


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and where it is: both, a or b."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").select(key, F.when(F.col("_a").isNull(), "b").when(F.col("_b").isNull(), "a").otherwise("both").alias("side"))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only one of two tables has (as often as it has them more)."""
    only_a, only_b = a.exceptAll(b.select(a.columns)), b.select(a.columns).exceptAll(a)
    return only_a.select(F.lit("a").alias("s")).union(only_b.select(F.lit("b"))).agg(F.count_if(F.col("s") == "a").alias("only_a"), F.count_if(F.col("s") == "b").alias("only_b"))


def labels_disjoint(a: Column, b: Column) -> Column:
    return ~F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def filtered_sets(include: DataFrame, exclude: DataFrame, key: str) -> DataFrame:
    """A label specification's nodes: union of what it includes, without what it excludes."""
    return include.select(key).distinct().join(exclude.select(key).distinct(), key, "left_anti")
