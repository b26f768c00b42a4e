"""Classification smoothing in a group (an image or a sequence), as chained window stages.

Rows: group, det_ord, class, class_conf, conf and category of detections with
their top class. Each pass recounts the classes of eligible detections.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Smoothing:
    conf: float = 0.15
    class_conf: float = 0.5
    least_to_overwrite_other: int = 2
    least_to_overwrite_rare: int = 4
    most_rare: int = 1
    other: tuple[str, ...] = ("other", "unknown", "no cv result", "animal", "blank", "mammal")
    categories: tuple[str, ...] | None = None
    least_family: int = 2
    most_family: int = -1


def _count(rows: DataFrame, group: str) -> DataFrame:
    """rows with n (eligible detections of the row's class in its group) and first (their first det_ord)."""
    each = Window.partitionBy(group, "class")
    ok = F.col("eligible")
    return rows.withColumn("n", F.sum(F.when(ok, 1).otherwise(0)).over(each)).withColumn("first", F.min(F.when(ok, F.col("det_ord"))).over(each))


def _dominant(group: str, prefer: Column) -> tuple[Column, Column, Column]:
    """(class, count, classes) of a group's most frequent class; ties: preferred, then first seen."""
    key = F.when(F.col("eligible"), F.struct((-F.col("n")).alias("n"), prefer.alias("p"), F.col("first").alias("f"), F.col("class").alias("c")))
    best = F.min(key).over(Window.partitionBy(group))
    kinds = F.size(F.collect_set(F.when(F.col("eligible"), F.col("class"))).over(Window.partitionBy(group)))
    return best["c"], -best["n"], kinds


def smooth(rows: DataFrame, how: Smoothing = Smoothing(), group: str = "image_id", descriptions: DataFrame | None = None) -> DataFrame:
    """rows with class replaced: other classes by the dominant one, rare ones by the dominant one, parents by their best child.

    descriptions: class, description (clean taxonomy strings); a class is a parent of another whose
    description has its own as a part. Without them only the first two passes run, as
    no class is related to another.
    """
    ok = (F.col("conf") >= how.conf) & (F.col("class_conf") >= how.class_conf) & F.col("class").isNotNull()
    if how.categories is not None:
        ok &= F.col("category").isin(*how.categories)
    columns = rows.columns
    out = rows.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    if descriptions is not None:
        out = out.join(descriptions.select("class", F.col("description").alias("own")), "class", "left")
    is_other = F.col("class").isin(*how.other)

    def set_class(df: DataFrame, when: Column, value: Column) -> DataFrame:
        df = df.withColumn("_to", F.when(F.col("eligible") & when, value))
        df = df.withColumn("class", F.coalesce("_to", "class")).drop("_to")
        if descriptions is not None:
            df = df.drop("own").join(descriptions.select("class", F.col("description").alias("own")), "class", "left")
        return df

    # others to the dominant class; the preference on ties holds for the first pass alone
    dom, n_dom, kinds = _dominant(group, is_other.cast("int"))
    out = _count(out, group).withColumn("dom", dom).withColumn("n_dom", n_dom).withColumn("kinds", kinds)
    out = set_class(out, (F.col("kinds") > 1) & is_other & ~F.col("dom").isin(*how.other) & (F.col("n_dom") >= how.least_to_overwrite_other), F.col("dom"))
    # rare classes to the dominant one
    dom, n_dom, kinds = _dominant(group, F.lit(0))
    out = _count(out, group).withColumn("dom", dom).withColumn("n_dom", n_dom).withColumn("kinds", kinds)
    rare = (F.col("kinds") > 1) & ~F.col("dom").isin(*how.other) & (F.col("n_dom") >= how.least_to_overwrite_rare) & (F.col("n") < F.col("n_dom")) & (F.col("n") <= how.most_rare)
    if descriptions is not None:
        names = descriptions.select(F.col("class").alias("dom"), F.col("description").alias("dom_text"))
        out = out.join(names, "dom", "left")
        rare &= (F.coalesce("own", F.lit("")) != "") & ~F.col("own").contains(F.col("dom_text"))
    out = set_class(out, rare, F.col("dom"))
    if descriptions is not None:
        # parents to the best child that is there: deepest, then most frequent
        out = _count(out.drop("dom_text"), group)
        level = F.size(F.filter(F.split("own", ";"), lambda t: t != ""))
        seen = F.collect_set(F.when(F.col("eligible"), F.struct("class", F.col("own").alias("text"), (level + F.col("n") * 0.01).alias("score")))).over(Window.partitionBy(group))
        out = out.withColumn("_seen", seen)
        children = F.filter("_seen", lambda s: s["text"].contains(F.col("own")) & (s["text"] != F.col("own")))
        best = F.array_max(F.transform(children, lambda s: F.struct(s["score"].alias("score"), s["class"].alias("class"))))
        out = set_class(out, (F.coalesce("own", F.lit("")) != "") & (F.size(children) > 0), best["class"]).drop("_seen")
        # same family, off unless most_family allows it
        if how.most_family >= 0:
            out = _count(out, group).withColumn("family", F.when(F.size(F.split("own", ";")) >= 3, F.array_join(F.slice(F.split("own", ";"), 1, 3), ";")))
            each = Window.partitionBy(group, "family")
            top = F.max(F.when(F.col("eligible"), F.struct("n", (-F.col("first")).alias("f"), "class"))).over(each)
            out = out.withColumn("_top", top)
            out = set_class(out, F.col("family").isNotNull() & (F.col("_top.n") >= how.least_family) & (F.col("n") <= how.most_family) & (F.col("n") < F.col("_top.n")), F.col("_top.class"))
    return out.select(*columns)


def class_counts(rows: DataFrame, group: str = "image_id", conf: float = 0.15, class_conf: float = 0.5) -> DataFrame:
    """group, class, n: classes of relevant detections; order by n desc, first."""
    ok = rows.filter((F.col("conf") >= conf) & (F.col("class_conf") >= class_conf))
    return ok.groupBy(group, "class").agg(F.count(F.lit(1)).alias("n"), F.min("det_ord").alias("first"))


def count_text(counts: DataFrame, names: DataFrame | None = None, group: str = "image_id") -> DataFrame:
    """group, text: "name (n), ..." in falling count."""
    rows = counts if names is None else counts.join(names.select("class", "name"), "class", "left")
    name = F.col("class") if names is None else F.col("name")
    shown = F.when(F.coalesce(name, F.lit("")) == "", "undefined category").otherwise(name)
    rows = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", F.concat(shown, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))).alias("l"))
    return rows.select(group, F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("text"))
