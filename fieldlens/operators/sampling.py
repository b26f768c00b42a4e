"""Samples, batches and splits. Seeds enter a hash of the id, so a sample doesn't depend on partitions."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators.running import ranked


def shuffled(ident: str, seed: int) -> Column:
    """An order that looks random and is fixed by the seed."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")))


def sample(rows: DataFrame, n: int, seed: int, ident: str = "image_id") -> DataFrame:
    return rows.orderBy(shuffled(ident, seed), ident).limit(n)


def per_group(rows: DataFrame, keys: list[str], n: int, seed: int, ident: str = "image_id") -> DataFrame:
    """n rows of each group at most."""
    by = Window.partitionBy(*keys).orderBy(shuffled(ident, seed), ident)
    return rows.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= n).drop("_r")


def by_category(images: DataFrame, annotations: DataFrame, limits: dict[str, int], default: int = -1, seed: int = 0) -> DataFrame:
    """Images sampled per category (images without annotations are one), as a union; limit -1 takes all."""
    from fieldlens.operators.categories import lookup

    named = images.select("image_id").join(annotations.select("image_id", "name").distinct(), "image_id", "left").select("image_id", F.coalesce("name", F.lit("no_annotations")).alias("name"))
    limit = F.coalesce(F.try_element_at(lookup({k: str(v) for k, v in limits.items()}), F.col("name")).cast("int"), F.lit(default))
    by = Window.partitionBy("name").orderBy(shuffled("image_id", seed), "image_id")
    kept = named.withColumn("_r", F.row_number().over(by)).filter((limit < 0) | (F.col("_r") <= limit)).select("image_id").distinct()
    return images.join(kept, "image_id", "left_semi")


def by_priority(rows: DataFrame, quota: int, seed: int = 0, label: str = "label", tier: str = "tier", ident: str = "image_id") -> DataFrame:
    """quota rows per label, lower tiers first."""
    by = Window.partitionBy(label).orderBy(tier, shuffled(ident, seed), ident)
    return rows.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= quota).drop("_r")


def proportional(cells: DataFrame, most: int, n: str = "n") -> DataFrame:
    """cells with take: counts scaled to a total, one at least."""
    total = cells.agg(F.sum(n).alias("_t"))
    scaled = F.when(F.col("_t") <= most, F.col(n)).otherwise(F.greatest(F.lit(1), F.floor(F.col(n) * most / F.col("_t"))))
    return cells.join(F.broadcast(total)).withColumn("take", scaled.cast("long")).drop("_t")


def chunks_of(rows: DataFrame, size: int, order: str) -> DataFrame:
    """rows with chunk: runs of so many rows in the order (a column of distinct values)."""
    return ranked(rows, order, "_r").withColumn("chunk", F.floor(F.col("_r") / size).cast("long")).drop("_r")


def n_chunks(rows: DataFrame, n: int, order: str, balanced: bool = False) -> DataFrame:
    """n chunks: contiguous, the first ones with one more; balanced deals round robin."""
    if balanced:
        return ranked(rows, order, "_r").withColumn("chunk", F.col("_r") % n).drop("_r")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    small, more = F.floor(F.col("_n") / n), F.col("_n") % n
    head = more * (small + 1)  # rows of the chunks that have one more
    chunk = F.when(F.col("_r") < head, F.floor(F.col("_r") / (small + 1))).otherwise(more + F.floor((F.col("_r") - head) / F.greatest(small, F.lit(1))))
    return ranked(rows, order, "_r").join(F.broadcast(total)).withColumn("chunk", chunk.cast("long")).drop("_r", "_n")


def sorted_locations(sizes: DataFrame, prioritized: list[str] | None = None) -> DataFrame:
    """Locations by size, those of prioritised datasets first."""
    first = F.col("dataset").isin(prioritized) if prioritized else F.lit(False)
    return sizes.orderBy(first.desc(), "n", "location")


def _numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """location, _p for the locations of counts in their order, and how many these are."""
    places = counts.select("location").distinct().withColumn("_p", F.row_number().over(Window.orderBy("location")) - 1)
    return places, places.count()


def _draws(spark: SparkSession, seeds: int, schema: str, draw: Callable[[int], Iterable[tuple]]) -> DataFrame:
    """Rows of draw(seed) for each seed from 0, as seed and the columns of the schema."""
    schema = f"seed long, {schema}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(seed, *row) for seed in batch["id"].tolist() for row in draw(seed)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(0, seeds).repartition(min(seeds, 16), "id").mapInPandas(run, schema)


def split_search(counts: DataFrame, seeds: int = 10_000, share: float = 0.15, most_errors: dict[str, float] | None = None, weights: dict[str, float] | None = None, most_error: float | None = 0.1, complete: bool = True) -> DataFrame:
    """seed, error, location of the validation locations of the best of many random splits.

    counts: location, category, n > 0 (of locations, so of moderate size). Each seed
    draws int(share * locations) of the sorted locations, as random.sample does. The
    error is the mean over categories of the weighted distance of their share to
    the wanted one; of equal ones the first seed's is taken. A split whose
    distance exceeds a category's limit (most_errors, else most_error; None:
    no limit) is out, and so is, if complete, one in which a category has no
    validation or no training rows. It is an error if no split is left.
    """
    from fieldlens.operators.categories import lookup

    places, n = _numbered(counts)
    take = int(share * n)
    drawn = _draws(counts.sparkSession, seeds, "_p int", lambda seed: [(p,) for p in random.Random(seed).sample(range(n), take)]).join(F.broadcast(places), "_p").drop("_p")
    total = counts.groupBy("category").agg(F.sum("n").alias("_n"))
    val = drawn.join(counts.select("location", "category", "n"), "location").groupBy("seed", "category").agg(F.sum("n").alias("_v"))
    all_of = counts.sparkSession.range(0, seeds).withColumnRenamed("id", "seed").crossJoin(F.broadcast(total))
    f = F.coalesce("_v", F.lit(0)) / F.col("_n")
    per = all_of.join(val, ["seed", "category"], "left").withColumn("_f", f).withColumn("_e", F.abs(F.col("_f") - share))

    def of_category(values: dict[str, float] | None, default: float | None) -> Column:
        other = F.lit(default).cast("double")
        return F.coalesce(F.try_element_at(lookup({k: str(v) for k, v in values.items()}), F.col("category").cast("string")).cast("double"), other) if values else other

    bad = F.coalesce(F.col("_e") > of_category(most_errors, most_error), F.lit(False))
    if complete:
        bad = bad | F.col("_f").isin(0.0, 1.0)
    err = per.groupBy("seed").agg(F.avg(F.col("_e") * of_category(weights, 1.0)).alias("error"), F.bool_or(bad).alias("_bad")).filter("not _bad")
    best = err.agg(F.min(F.struct("error", "seed")).alias("b"))
    best = best.select(F.when(F.col("b").isNull(), F.raise_error(F.lit("no split meets all limits"))).otherwise(F.col("b")).alias("b"))
    return drawn.join(F.broadcast(best.select("b.seed", "b.error")), "seed").select("seed", "error", "location")


def split_random(counts: DataFrame, val: float, test: float = 0.0, seeds: int = 10_000) -> DataFrame:
    """seed, score, location, split of the best of many random splits to train, val and, with a share for it, test.

    counts: label, location, n > 0. Each seed permutes the locations and moves the number for train,
    and for val if there is a test set, by up to 3% of all locations. The score is the sum over splits and
    labels of twice the squared distance of the images' share to the wanted one
    and that of the locations' share; of equal scores the first seed's is taken.
    """
    places, n = _numbered(counts)
    train = 1.0 - val - test
    names = ["train", "val", "test"] if test > 0 else ["train", "val"]

    def draw(seed: int) -> list[tuple]:
        rnd = np.random.default_rng(seed)
        a = int(n * (train + rnd.uniform(-0.03, 0.03)))
        b = a + int(n * (val + rnd.uniform(-0.03, 0.03))) if test > 0 else n
        return [(p, "train" if k < a else "val" if k < b else "test") for k, p in enumerate(rnd.permutation(n).tolist())]

    drawn = _draws(counts.sparkSession, seeds, "_p int, split string", draw).join(F.broadcast(places), "_p").drop("_p")
    label = counts.select("label", "location", "n")
    total = label.groupBy("label").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    have = drawn.join(label, "location").groupBy("seed", "split", "label").agg(F.sum("n").alias("_sn"), F.count(F.lit(1)).alias("_sk"))
    wanted = counts.sparkSession.createDataFrame([(s, {"train": train, "val": val, "test": test}[s]) for s in names], "split string, _t double")
    each = counts.sparkSession.range(0, seeds).withColumnRenamed("id", "seed").crossJoin(F.broadcast(wanted)).crossJoin(F.broadcast(total))
    rows = each.join(have, ["seed", "split", "label"], "left")
    images, locs = F.coalesce("_sn", F.lit(0)) / F.col("_n") - F.col("_t"), F.coalesce("_sk", F.lit(0)) / F.col("_k") - F.col("_t")
    best = rows.groupBy("seed").agg(F.sum(2 * images * images + locs * locs).alias("score")).agg(F.min(F.struct("score", "seed")).alias("b"))
    return drawn.join(F.broadcast(best.select("b.seed", "b.score")), "seed").select("seed", "score", "location", "split")


def greedy_split(counts: DataFrame, test: float, val: float) -> list[tuple[str, str]]:
    """(location, split): locations go label by label, rarest first, to test, then val, then train, until a label's share is met.

    counts: label, location, n. The order of decisions matters, so this runs over the
    location counts on the driver: it needs a few numbers per location.
    """
    rows = [(r["label"], r["location"], r["n"]) for r in counts.collect()]
    total: dict[str, int] = {}
    for label, _, n in rows:
        total[label] = total.get(label, 0) + n
    out: dict[str, str] = {}
    have = {(label, s): 0 for label in total for s in ("test", "val")}
    for label in sorted(total, key=lambda k: (total[k], k)):
        for _, loc, _ in sorted((r for r in rows if r[0] == label), key=lambda r: (r[2], r[1])):
            if loc in out:
                continue
            for s, share in (("test", test), ("val", val)):
                if have[label, s] < share * total[label]:
                    out[loc] = s
                    for k, place, n in rows:
                        if place == loc:
                            have[k, s] += n
                    break
            else:
                out[loc] = "train"
    return sorted(out.items())
