"""Category maps: remapping, merging, collapsing. Maps are small, and hold one row per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")


def remapped(detections: DataFrame, names: dict[str, str], renames: dict[str, str], target: dict[str, str], invalid: str = "unknown") -> DataFrame:
    """detections with category ids of another map: id to name to new name to new id.

    names: by old id. target: by new id. What has no new id becomes the next
    free one, for "unknown"; invalid="error" raises instead.
    """
    ids = {n: i for i, n in target.items()}
    free = target and str(max(map(int, target)) + 1) or "0"
    to = {i: ids[renames.get(n, n)] for i, n in names.items() if renames.get(n, n) in ids}
    old = F.col("category").cast("string")
    other = F.lit(ids.get("unknown", free)) if invalid == "unknown" else F.raise_error(F.concat(F.lit("no target for category "), F.coalesce(old, F.lit("null")))).cast("string")
    return detections.withColumn("category", F.coalesce(F.try_element_at(lookup(to), old), other))


def remap_annotations(annotations: DataFrame, categories: DataFrame, target: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """annotations with ids of the target's categories by (renamed) name; the others are dropped. categories, target: id, name."""
    name = F.coalesce(F.try_element_at(lookup(renames or {}), F.col("name")), F.col("name"))
    pairs = categories.withColumn("name", name).alias("c").join(target.alias("t"), "name").select(F.col("c.id").alias("category_id"), F.col("t.id").alias("_new"))
    return annotations.join(pairs, "category_id").withColumn("category_id", F.col("_new")).drop("_new")


def merged_categories(target: DataFrame, source: DataFrame) -> DataFrame:
    """old_id, new_id, name for each source class: the target's id by name, else next ids in the source's order. Both: id, name."""
    known = source.alias("s").join(target.alias("t"), "name", "left").select(F.col("s.id").alias("old_id"), F.col("t.id").alias("new_id"), "name")
    top = target.agg(F.coalesce(F.max(F.col("id").cast("int")), F.lit(-1)).alias("top"))
    fresh = known.filter("new_id is null").withColumn("k", F.row_number().over(Window.orderBy(F.col("old_id").cast("int"))))  # categories only
    numbered = fresh.join(F.broadcast(top)).select("old_id", (F.col("top") + F.col("k")).cast("string").alias("new_id"), "name")
    return known.filter("new_id is not null").unionByName(numbered)


def first_seen(rows: DataFrame, name: str, order: str) -> DataFrame:
    """name, id: 0-based ids in the order in which the names come first."""
    return rows.groupBy(name).agg(F.min(order).alias("_o")).select(name, (F.row_number().over(Window.orderBy("_o", name)) - 1).cast("string").alias("id"))


def combined_redundant(categories: DataFrame, uses: DataFrame) -> DataFrame:
    """old_id, new_id, name, description of classes that share a name.

    categories: id, name, description. uses: id, n. New ids go by first old id;
    descriptions by falling use, joined by |.
    """
    used = categories.join(uses, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = used.groupBy("name").agg(F.min(F.col("id").cast("int")).alias("first"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "description"))).alias("d"))
    ids = per.select("name", (F.row_number().over(Window.orderBy("first")) - 1).cast("string").alias("new_id"), F.array_join(F.array_distinct(F.transform("d", lambda x: x["description"])), "|").alias("description"))
    return categories.select(F.col("id").alias("old_id"), "name").join(ids, "name").select("old_id", "new_id", "name", "description")


def classes_only_for(images: DataFrame, categories: list[str]) -> DataFrame:
    """Classifications go from detections of other categories."""
    return images.withColumn("detections", F.transform("detections", lambda d: d.withField("classifications", F.when(d["category"].isin(categories), d["classifications"]))))


def size_category(measure: Column, ladder: list[tuple[float, str]], default: str, smallest_is_default: bool = True) -> Column:
    """A class by size. smallest_is_default: the highest limit that is reached counts; else the lowest that isn't passed."""
    out = None
    for limit, name in sorted(ladder, reverse=smallest_is_default):
        hit = measure >= limit if smallest_is_default else measure <= limit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def inverted(m: Column) -> Column:
    """Values to keys; of equal values the last key counts."""
    values = F.array_distinct(F.map_values(m))
    return F.map_from_arrays(values, F.transform(values, lambda v: F.element_at(F.filter(F.map_entries(m), lambda e: e["value"] == v), -1)["key"]))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def dense_ids(categories: DataFrame) -> DataFrame:
    """id, new_id: 0-based in the order of id."""
    return categories.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("new_id"))


def union_categories(sources: DataFrame) -> DataFrame:
    """name, id over several databases: empty is 0, others in first-seen order. sources: source, ord, name."""
    named = sources.withColumn("name", F.lower("name")).groupBy("name").agg(F.min(F.struct("source", "ord")).alias("o"))
    return named.select("name", (F.row_number().over(Window.orderBy(F.col("name") != "empty", "o")) - F.lit(1)).alias("id"))


def sum_by_target(wide: DataFrame, groups: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Class probabilities summed by target class."""
    return wide.select(*keep, *[sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias(t) for t, cols in groups.items()])


def assigned_targets(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """class, target where the class's nodes all lie in the target's, else other; a partial overlap raises. Both: name, nodes."""
    pairs = classes.select(F.col("name").alias("class"), "nodes").join(targets.select(F.col("name").alias("target"), F.col("nodes").alias("t")), F.arrays_overlap("nodes", "t"), "left")
    partial = F.col("target").isNotNull() & (F.size(F.array_except("nodes", "t")) > 0)
    name = F.when(partial, F.raise_error(F.concat(F.lit("partial overlap of "), F.col("class")))).otherwise(F.coalesce("target", F.lit("other")))
    return pairs.select("class", name.cast("string").alias("target"))
