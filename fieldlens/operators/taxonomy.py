"""Taxonomy hierarchies, taxa lists and geofence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(nodes: DataFrame, most_levels: int = 32) -> DataFrame:
    """node_id, ancestor_id, depth (0: itself) of nodes (node_id, parent_id), which form a hierarchy of bounded depth.

    A recursive query; a node may have several parents.
    """
    spark = nodes.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE up(node_id, ancestor_id, depth) AS (
          SELECT node_id, node_id, 0 FROM {{nodes}}
          UNION ALL
          SELECT u.node_id, n.parent_id, u.depth + 1 FROM up u JOIN {{nodes}} n ON u.ancestor_id = n.node_id
          WHERE n.parent_id >= 0 AND u.depth < {int(most_levels)})
        SELECT node_id, ancestor_id, min(depth) AS depth FROM up GROUP BY node_id, ancestor_id""",
        nodes=nodes,
    )


def descendant_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node_id, labels: those of a node and all below it. labels: node_id, label."""
    return ancestors(nodes).join(labels, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def lowest_common(closure: DataFrame, groups: DataFrame) -> DataFrame:
    """group, node_id: the lowest node above all of a group's nodes. groups: group, node_id."""
    size = groups.groupBy("group").agg(F.count_distinct("node_id").alias("k"))
    shared = groups.distinct().join(closure, "node_id").groupBy("group", "ancestor_id").agg(F.count_distinct("node_id").alias("hit"), F.max("depth").alias("far"))
    all_of = shared.join(size, "group").filter("hit = k")
    return all_of.groupBy("group").agg(F.min(F.struct("far", "ancestor_id")).alias("m")).select("group", F.col("m.ancestor_id").alias("node_id"))


def single_parent(nodes: DataFrame, closure: DataFrame, overrides: dict | None = None) -> DataFrame:
    """node_id, parent_id with one parent each: the deeper of two of which one is above the other, else the override, else the least id."""
    from fieldlens.operators.categories import lookup

    depth = closure.groupBy("node_id").agg(F.max("depth").alias("level"))
    ranked = nodes.select("node_id", "parent_id").join(depth.select(F.col("node_id").alias("parent_id"), "level"), "parent_id", "left")
    given = F.try_element_at(lookup({str(k): str(v) for k, v in (overrides or {}).items()}), F.col("node_id").cast("string"))
    by = Window.partitionBy("node_id").orderBy((F.col("parent_id").cast("string") == given).desc_nulls_last(), F.col("level").desc_nulls_last(), "parent_id")
    return ranked.withColumn("_r", F.row_number().over(by)).filter("_r = 1").select("node_id", "parent_id")


def maximal_matches(matches: DataFrame, closure: DataFrame) -> DataFrame:
    """Matches (node_id) that don't lie below another match."""
    above = closure.filter("depth > 0").join(matches.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("node_id").distinct()
    return matches.join(above, "node_id", "left_anti")


def query_forms(q: Column) -> Column:
    """Forms in which a name is looked up, in order: as it is, without open endings, without rank words."""
    low = F.trim(F.lower(F.translate(q, "_", " ")))
    bare = F.trim(F.regexp_replace(low, r"(\s+sp+\.?|\.|\s*-\s*\w+)$", ""))
    ranks = F.trim(F.regexp_replace(bare, r"\b(unidentified|unknown|species|genus|family|order|class|group)\b", ""))
    return F.array_distinct(F.array(low, bare, F.regexp_replace(ranks, r"\s+", " ")))


def preferred_match(queries: DataFrame, names: DataFrame, preference: str) -> DataFrame:
    """query, taxon_id, source: forms in order, the preferred source first, vertebrates first, then the taxon's order. names: name, taxon_id, source, phylum, ord."""
    forms = queries.select("query", F.posexplode(query_forms(F.col("query"))).alias("form", "name"))
    by = Window.partitionBy("query").orderBy("form", (F.col("source") == preference).desc(), (F.col("phylum") == "chordata").desc(), "ord")
    return forms.join(names, "name").withColumn("_r", F.row_number().over(by)).filter("_r = 1").select("query", "taxon_id", "source")


def without_leaves(path: Column, levels: int = 1) -> Column:
    """A path (leaf first) without its lowest levels."""
    return F.slice(path, levels + 1, F.greatest(F.size(path) - levels, F.lit(0)))


def parse_entries(text: Column) -> Column:
    """[(id, 'level', 'name', [names]), ...] as text to an array of (id, level, name, common)."""
    entries = F.regexp_extract_all(text, F.lit(r"\(\s*(\d+)\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*\[([^\]]*)\]\s*\)"), F.lit(0))
    form = r"\(\s*(\d+)\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*\[([^\]]*)\]\s*\)"
    return F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e, form, 1).try_cast("long").alias("id"),
            F.regexp_extract(e, form, 2).alias("level"),
            F.regexp_extract(e, form, 3).alias("name"),
            F.filter(F.transform(F.split(F.regexp_extract(e, form, 4), ","), lambda c: F.trim(F.regexp_replace(c, "['\"]", ""))), lambda c: c != "").alias("common"),
        ),
    )


def edges(entries: Column) -> Column:
    """(child, parent) of neighbouring entries of a path."""
    return F.filter(F.transform(entries, lambda e, i: F.struct(e["id"].alias("node_id"), F.get(entries, i + 1)["id"].alias("parent_id"))), lambda p: p["parent_id"].isNotNull())


def restricted(classes: DataFrame, allowed: DataFrame, walk_down: bool = False, other: str = "animal") -> DataFrame:
    """id, to: each class's nearest allowed taxon at or above it, else other.

    classes: id, taxonomy (five tokens). allowed: taxon (the tokens up to its
    level, joined by ;). walk_down: a class above the list goes down while there
    is only one allowed taxon below it.
    """
    t = F.split("taxonomy", ";")
    used = F.size(F.filter(t, lambda x: x != ""))
    ups = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(t, F.lit(1), F.greatest(used - d, F.lit(0))), ";").alias("taxon")))
    rows = classes.select("id", "taxonomy", F.explode(ups).alias("u")).filter("u.taxon <> ''").select("id", "u.depth", "u.taxon")
    near = rows.join(allowed.select("taxon").distinct(), "taxon").groupBy("id").agg(F.min(F.struct("depth", "taxon")).alias("m")).select("id", F.col("m.taxon").alias("to"))
    out = classes.select("id", "taxonomy").join(near, "id", "left")
    if walk_down:
        parts = F.split("taxon", ";")
        below = allowed.select("taxon", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ";"))).alias("above"))
        single = below.groupBy("above").agg(F.count_distinct("taxon").alias("k"), F.min("taxon").alias("child")).filter("k = 1").select("above", "child")
        trimmed = F.regexp_replace("taxonomy", ";+$", "")
        out = out.join(single, trimmed == F.col("above"), "left").withColumn("to", F.coalesce("to", "child"))
    return out.select("id", F.coalesce("to", F.lit(other)).alias("to"))


def geofence_status(rows: DataFrame) -> DataFrame:
    """rows with status and allowed.

    rows: country, state (null: not known), allow, block: a taxon's rules as
    map<country, array<state>>, null where it has none; an empty array is the
    whole country. Blocks win over allows, a list of allows blocks all other
    countries, and in the USA rules by state come last.
    """
    none = F.create_map().cast("map<string,array<string>>")
    allow, block, c, s = F.coalesce("allow", none), F.coalesce("block", none), F.col("country"), F.upper("state")
    in_allow, in_block = F.map_contains_key(allow, c), F.map_contains_key(block, c)
    base = (
        F.when(in_block, F.when(in_allow, "blocked_over_allow").otherwise("blocked"))
        .when(in_allow, "allowed")
        .when(F.size(allow) > 0, "block_not_on_country_allow_list")
        .otherwise("allow_not_on_block_list")
    )
    a, b = F.try_element_at(allow, c), F.try_element_at(block, c)

    def states(rule: Column) -> tuple[Column, Column, Column, Column]:
        there = rule.isNotNull()
        whole = there & (F.size(rule) == 0)
        some = there & (F.size(rule) > 0)
        mine = some & s.isNotNull() & F.coalesce(F.array_contains(rule, s), F.lit(False))
        return whole, mine, some & s.isNotNull() & ~mine, some & s.isNull()

    a_whole, a_mine, a_else, a_open = states(a)
    b_whole, b_mine, b_else, b_open = states(b)
    usa = (
        F.when(b_whole, "block_usa_wide")
        .when(a_whole | a_open | b_open, "allow_usa_wide")
        .when(b_mine, "block_by_state")
        .when(a_mine, "allow_by_state")
        .when(b_else, "allow_other_states_blocked")
        .when(a_else, "block_other_states_allowed")
        .otherwise(base)
    )
    status = F.when((F.size(allow) == 0) & (F.size(block) == 0), "allow_by_default").when(c == "USA", usa).otherwise(base)
    return rows.withColumn("status", status).withColumn("allowed", F.col("status").startswith("allow"))


def parse_geofence(text: Column) -> Column:
    """Rules as JSON: taxon to allow or block to country to states."""
    return F.from_json(text, "map<string,map<string,map<string,array<string>>>>")


def geofence_matrix(rules: DataFrame, regions: DataFrame) -> DataFrame:
    """taxon and one column per region, 1 where allowed. rules: taxon, allow, block. regions: country, state (a list of bounded length)."""
    named = regions.withColumn("region", F.concat_ws(":", "country", "state"))
    listed = named.agg(F.collect_list(F.struct("country", "state", "region")).alias("r"))
    each = rules.join(F.broadcast(listed)).select("taxon", "allow", "block", F.explode("r").alias("r")).select("taxon", "allow", "block", "r.*")
    values = sorted(r["region"] for r in named.select("region").distinct().collect())  # regions of the world
    return geofence_status(each).groupBy("taxon").pivot("region", values).agg(F.max(F.when(F.col("allowed"), 1)))


def rule_lines(taxon: str, allow: list[str] = (), block: list[str] = (), allow_states: list[str] = (), block_states: list[str] = ()) -> list[str]:
    """taxon,allow|block,COUNTRY,STATE lines; states are of the USA."""
    out = [f"{taxon},{kind},{c}," for kind, cs in (("allow", allow), ("block", block)) for c in cs]
    return out + [f"{taxon},{kind},USA,{s}" for kind, ss in (("allow", allow_states), ("block", block_states)) for s in ss]


def block_all_except(taxon: str, allowed: set[str], blocked: set[str], exceptions: set[str]) -> list[str]:
    """Lines that leave a taxon allowed in the exceptions only; one of them that is blocked already is an error."""
    if exceptions & blocked:
        raise ValueError(f"already blocked: {sorted(exceptions & blocked)}")
    return rule_lines(taxon, allow=sorted(exceptions - allowed), block=sorted(allowed - exceptions - blocked))


def resolved(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """name, taxonomy: a five-token string, a common name or a binomial, looked up in that order. taxa: taxonomy, common, binomial."""
    forms = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("name")) for k, c in enumerate(("taxonomy", "common", "binomial"))])
    keys = taxa.select("taxonomy", F.explode(forms).alias("f")).select("taxonomy", "f.*").filter("name <> ''")
    low = names.select(F.col("name").alias("asked"), F.lower(F.trim("name")).alias("name"))
    return low.join(keys, "name").groupBy("asked").agg(F.min(F.struct("k", "taxonomy")).alias("m")).select(F.col("asked").alias("name"), F.col("m.taxonomy").alias("taxonomy"))


def load_taxa(lines: DataFrame) -> DataFrame:
    """taxon_id, taxonomy, common, binomial, latin from lines (ord, line) of seven tokens; of equal taxonomies the last counts."""
    t = F.split(F.lower("line"), ";")
    rows = lines.select("ord", t[0].alias("taxon_id"), F.array_join(F.slice(t, 2, 5), ";").alias("taxonomy"), t[6].alias("common"), F.when(t[5] != "", F.concat_ws(" ", t[4], t[5])).otherwise("").alias("binomial"), F.coalesce(F.when(t[5] != "", F.concat_ws(" ", t[4], t[5])), *[F.nullif(t[i], F.lit("")) for i in (4, 3, 2, 1)]).alias("latin"))
    by = Window.partitionBy("taxonomy").orderBy(F.col("ord").desc())
    return rows.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "ord")


def rolled_up(scores: DataFrame, target: float) -> DataFrame:
    """crop_id, taxon, score: the top class if it reaches the target, else the first higher level whose summed score does. scores: crop_id, taxonomy, score."""
    t = F.split("taxonomy", ";")
    ups = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda d: F.struct(d.alias("up"), F.array_join(F.slice(t, F.lit(1), 5 - d), ";").alias("taxon")))
    rows = scores.select("crop_id", "score", F.explode(ups).alias("u")).groupBy("crop_id", "u.up", "u.taxon").agg(F.sum("score").alias("score"))
    by = Window.partitionBy("crop_id").orderBy("up", F.col("score").desc(), "taxon")
    return rows.filter(F.col("score") >= target).withColumn("_r", F.row_number().over(by)).filter("_r = 1").select("crop_id", "taxon", "score")
