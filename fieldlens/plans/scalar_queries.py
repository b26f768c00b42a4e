"""Queries over scalar functions, taxonomy, geofence rules and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import geometry, numbers, paths, strings, taxa, times
from fieldlens.operators import combine, crops, sampling, taxonomy
from fieldlens.plans.fixtures import Tables, fx
from fieldlens.plans.registry import query

PATHS = """WITH p AS (SELECT image_id, CASE image_id % 6 WHEN 0 THEN 'site' || location || '/100RECNX/IMG_' || image_id || '.JPG' WHEN 1 THEN 'site' || location || '\\101EK113\\IMG_' || image_id || '.jpeg'
 WHEN 2 THEN 'C:\\data\\clip ' || image_id || '.mp4' WHEN 3 THEN '/mnt/d/x/' || image_id || '.tar.png' WHEN 4 THEN 'a/b/frame' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '.jpg' ELSE 'notes.' || image_id || '/readme' END AS p FROM (SELECT o_orderkey AS image_id, o_custkey % 150 AS location FROM orders))"""


def _paths(spark, sf):
    i = Tables(spark, sf)["fx_images"]
    n, loc = F.col("image_id").cast("string"), F.col("location").cast("string")
    L = F.lit
    p = (
        F.when(F.col("image_id") % 6 == 0, F.concat(L("site"), loc, L("/100RECNX/IMG_"), n, L(".JPG")))
        .when(F.col("image_id") % 6 == 1, F.concat(L("site"), loc, L("\\101EK113\\IMG_"), n, L(".jpeg")))
        .when(F.col("image_id") % 6 == 2, F.concat(L("C:\\data\\clip "), n, L(".mp4")))
        .when(F.col("image_id") % 6 == 3, F.concat(L("/mnt/d/x/"), n, L(".tar.png")))
        .when(F.col("image_id") % 6 == 4, F.concat(L("a/b/frame"), F.lpad(n, 6, "0"), L(".jpg")))
        .otherwise(F.concat(L("notes."), n, L("/readme")))
    )
    return i.select("image_id", p.alias("p"))


@query("path_parts", PATHS + r""" SELECT image_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(p, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(p, '([^/]*)$', 1), '(\.[^.]*)$', 1) AS ext,
 regexp_matches(lower(p), '\.(jpg|jpeg|gif|png|tif|tiff|bmp|webp|avif)$') AS image, regexp_matches(lower(p), '\.(mp4|avi|mpeg|mpg|mov|mkv|flv)$') AS video, regexp_matches(p, '^([/\\]|[A-Za-z]:)') AS "absolute" FROM p""")
def path_parts(spark, sf):
    p = F.col("p")
    return _paths(spark, sf).select("image_id", paths.dirname(p).alias("folder"), paths.basename(p).alias("name"), paths.extension(p).alias("ext"), paths.is_image(p).alias("image"), paths.is_video(p).alias("video"), paths.is_absolute(p).alias("absolute"))


@query("path_rewrites", PATHS + r""" SELECT image_id, regexp_extract(regexp_replace(regexp_replace(replace(p, '\', '/'), '/\d+RECNX/', '/', 'g'), '/\d+EK\d+/', '/', 'g'), '^(.*)/[^/]*$', 1) AS camera,
 CASE WHEN regexp_matches(p, '^/mnt/[A-Za-z](/.*)?$') THEN regexp_extract(p, '^/mnt/([A-Za-z])', 1) || ':\' || replace(regexp_extract(p, '^/mnt/[A-Za-z]/(.*)$', 1), '/', '\') END AS windows,
 CASE WHEN regexp_matches(p, '^[A-Za-z]:') THEN '/mnt/' || lower(substr(p, 1, 1)) || '/' || regexp_extract(replace(p, '\', '/'), '^[A-Za-z]:/(.*)$', 1) END AS wsl,
 CAST(nullif(regexp_extract(p, 'frame(\d+)\.jpg$', 1), '') AS INT) AS frame, CASE WHEN len(string_split(p, '/')) > 1 THEN string_split(p, '/')[1] ELSE '' END AS first_folder FROM p""")
def path_rewrites(spark, sf):
    p = F.col("p")
    return _paths(spark, sf).select("image_id", paths.camera_folder(p).alias("camera"), paths.wsl_to_windows(p).alias("windows"), paths.windows_to_wsl(p).alias("wsl"), paths.frame_number(p).alias("frame"), F.get(F.split(paths.dirname(p), "/"), F.lit(0)).alias("first_folder"))


@query("crop_names_all", PATHS + r""" SELECT image_id, p, regexp_replace(p, '(\.[^./\\]*)?$', '.crop_' || lpad(CAST(image_id % 12 AS VARCHAR), 3, '0') || '\1') AS crop FROM p""")
def crop_names_all(spark, sf):
    """Over all forms of paths."""
    return _paths(spark, sf).select("image_id", "p", paths.crop_name(F.col("p"), F.col("image_id") % 12).alias("crop"))


@query("string_forms", """SELECT c_custkey AS id, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g') AS slug,
 CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS DOUBLE) * 1024 WHEN 1 THEN c_custkey * 1048576.0 WHEN 2 THEN CAST(c_custkey AS DOUBLE) ELSE 0.0 END AS bytes,
 c_custkey % 3 = 0 AS flag, c_custkey % 5 = 0 AS blank FROM customer""")
def string_forms(spark, sf):
    c = Tables(spark, sf)["customer"]
    k = F.col("c_custkey")
    n = k.cast("string")
    size = F.when(k % 4 == 0, F.concat(n, F.lit("KB"))).when(k % 4 == 1, F.concat(n, F.lit(" M"))).when(k % 4 == 2, n).otherwise(F.concat(n, F.lit("X")))
    flag = F.when(k % 3 == 0, " Yes ").otherwise("F")
    blank = F.when(k % 5 == 0, " \t").otherwise("x")
    return c.select(k.alias("id"), strings.slug(F.col("c_name")).alias("slug"), strings.to_bytes(size).alias("bytes"), strings.parse_bool(flag).alias("flag"), strings.is_blank(blank).alias("blank"))


@query("key_values", "SELECT c_custkey AS id, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nation, 'n=' || c_nationkey || ' s=' || c_mktsegment AS text FROM customer")
def key_values(spark, sf):
    c = Tables(spark, sf)["customer"]
    m = strings.key_values(F.array(F.concat(F.lit("s = "), F.col("c_mktsegment")), F.concat(F.lit("n="), F.col("c_nationkey").cast("string"))))
    return c.select(F.col("c_custkey").alias("id"), m.alias("m")).select("id", F.col("m")["s"].alias("seg"), F.col("m")["n"].alias("nation"), strings.joined_map(F.col("m")).alias("text"))


@query("floor_values", "SELECT c_custkey AS id, floor(c_acctbal * 10) / 10.0 AS low FROM customer")
def floor_values(spark, sf):
    return Tables(spark, sf)["customer"].select(F.col("c_custkey").alias("id"), numbers.floor_to(F.col("c_acctbal").cast("double"), 1).alias("low"))


TAXA = """WITH t AS (SELECT p_partkey AS id, 'guid' || p_partkey || ';' || CASE p_partkey % 7 WHEN 0 THEN ';;;;;blank' WHEN 1 THEN 'mammalia;;;;;' WHEN 2 THEN 'mammalia;carnivora;;;;' WHEN 3 THEN 'mammalia;carnivora;felidae;;;' WHEN 4 THEN 'mammalia;carnivora;felidae;panthera;;'
 WHEN 5 THEN 'mammalia;carnivora;felidae;panthera;leo;' ELSE 'mammalia;carnivora;felidae;panthera;leo leo;african lion' END AS s FROM part)"""


def _taxa(spark, sf):
    k = F.col("p_partkey")
    s = F.element_at(F.array(*map(F.lit, (";;;;;blank", "mammalia;;;;;", "mammalia;carnivora;;;;", "mammalia;carnivora;felidae;;;", "mammalia;carnivora;felidae;panthera;;", "mammalia;carnivora;felidae;panthera;leo;", "mammalia;carnivora;felidae;panthera;leo leo;african lion"))), (k % 7 + 1).cast("int"))
    return Tables(spark, sf)["part"].select(k.alias("id"), F.concat(F.lit("guid"), k.cast("string"), F.lit(";"), s).alias("s"))


@query("taxon_strings", TAXA + """ SELECT id, CASE id % 7 WHEN 0 THEN 'blank' WHEN 1 THEN 'mammalia class' WHEN 2 THEN 'carnivora order' WHEN 3 THEN 'felidae family' WHEN 4 THEN 'panthera species' WHEN 5 THEN 'panthera leo' ELSE 'african lion' END AS name,
 CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE id % 7 + 2 END AS INT) AS level, array_to_string(string_split(s, ';')[2:6], ';') AS taxonomy, string_split(s, ';')[2] AS kingdom, id % 7 <> 0 AS animal, CASE id % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'class' WHEN 2 THEN 'order' WHEN 3 THEN 'family' WHEN 4 THEN 'genus' WHEN 5 THEN 'species' ELSE 'subspecies' END AS level_name FROM t""")
def taxon_strings(spark, sf):
    s = F.col("s")
    return _taxa(spark, sf).select("id", taxa.display_name(s).alias("name"), taxa.level(s).alias("level"), taxa.five_tokens(s).alias("taxonomy"), taxa.token(s, 1).alias("kingdom"), taxa.is_animal(s).alias("animal"), taxa.level_name(taxa.level(s)).alias("level_name"))


@query("taxonomy_ancestors", fx("fx_taxonomy").replace("WITH ", "WITH RECURSIVE ", 1) + ", up AS (SELECT node_id, node_id AS ancestor_id, 0 AS depth FROM fx_taxonomy UNION ALL SELECT u.node_id, n.parent_id, u.depth + 1 FROM up u JOIN fx_taxonomy n ON u.ancestor_id = n.node_id WHERE n.parent_id >= 0) SELECT node_id, ancestor_id, min(depth) AS depth FROM up GROUP BY ALL")
def taxonomy_ancestors(spark, sf):
    return taxonomy.ancestors(Tables(spark, sf)["fx_taxonomy"])


@query("taxonomy_labels", "SELECT CAST(1000 + n_regionkey AS BIGINT) AS node_id, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS labels FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT CAST(c_nationkey AS BIGINT), string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer GROUP BY 1")
def taxonomy_labels(spark, sf):
    t = Tables(spark, sf)
    labels = t["customer"].select(F.col("c_nationkey").cast("long").alias("node_id"), F.col("c_mktsegment").alias("label"))
    return taxonomy.descendant_labels(t["fx_taxonomy"], labels).select("node_id", F.array_join("labels", ",").alias("labels"))


@query("taxonomy_common_ancestor_all", "SELECT c_mktsegment || '/' || n_regionkey AS \"group\", CASE WHEN count(DISTINCT n_nationkey) = 1 THEN CAST(min(n_nationkey) AS BIGINT) ELSE CAST(1000 + min(n_regionkey) AS BIGINT) END AS node_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def taxonomy_common_ancestor_all(spark, sf):
    """Lowest common nodes of all customers' nations, by segment and region."""
    t = Tables(spark, sf)
    named = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    groups = named.select(F.concat_ws("/", "c_mktsegment", "n_regionkey").alias("group"), F.col("c_nationkey").cast("long").alias("node_id"))
    return taxonomy.lowest_common(taxonomy.ancestors(t["fx_taxonomy"]), groups)


@query("geofence_decisions", """WITH s AS (SELECT s_suppkey AS id, CASE s_nationkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'CAN' WHEN 2 THEN 'MEX' ELSE 'BRA' END AS country, CASE s_suppkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' END AS state, s_suppkey % 6 AS rule FROM supplier),
 r AS (SELECT *, CASE rule
 WHEN 0 THEN 'allow_by_default'
 WHEN 1 THEN CASE country WHEN 'USA' THEN 'allow_usa_wide' WHEN 'CAN' THEN 'allowed' ELSE 'block_not_on_country_allow_list' END
 WHEN 2 THEN CASE country WHEN 'MEX' THEN 'blocked' ELSE 'allow_not_on_block_list' END
 WHEN 3 THEN CASE country WHEN 'USA' THEN CASE state WHEN 'CA' THEN 'allow_by_state' WHEN 'TX' THEN 'block_other_states_allowed' ELSE 'allow_usa_wide' END ELSE 'block_not_on_country_allow_list' END
 WHEN 4 THEN CASE country WHEN 'USA' THEN CASE state WHEN 'TX' THEN 'block_by_state' WHEN 'CA' THEN 'allow_other_states_blocked' ELSE 'allow_usa_wide' END ELSE 'allow_not_on_block_list' END
 ELSE CASE country WHEN 'USA' THEN 'block_usa_wide' WHEN 'BRA' THEN 'blocked_over_allow' ELSE 'block_not_on_country_allow_list' END END AS status FROM s)
 SELECT id, status, starts_with(status, 'allow') AS allowed FROM r""")
def geofence_decisions(spark, sf):
    s = Tables(spark, sf)["supplier"]
    country = F.element_at(F.array(*map(F.lit, ("USA", "CAN", "MEX", "BRA"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    state = F.when(F.col("s_suppkey") % 3 == 0, "ca").when(F.col("s_suppkey") % 3 == 1, "TX")
    rules = taxonomy.parse_geofence(F.lit('{"1":{"allow":{"USA":[],"CAN":[]}},"2":{"block":{"MEX":[]}},"3":{"allow":{"USA":["CA"]}},"4":{"block":{"USA":["TX"]}},"5":{"block":{"USA":[],"BRA":[]},"allow":{"BRA":[]}}}'))
    rows = s.select(F.col("s_suppkey").alias("id"), country.alias("country"), state.alias("state"), F.try_element_at(rules, (F.col("s_suppkey") % 6).cast("string")).alias("r"))
    rows = rows.withColumn("allow", F.try_element_at("r", F.lit("allow"))).withColumn("block", F.try_element_at("r", F.lit("block")))
    return taxonomy.geofence_status(rows).select("id", "status", "allowed")


@query("restrict_taxa", TAXA + """ SELECT id, CASE id % 7 WHEN 3 THEN 'mammalia;carnivora;felidae' WHEN 4 THEN 'mammalia;carnivora;felidae' WHEN 5 THEN 'mammalia;carnivora;felidae' WHEN 6 THEN 'mammalia;carnivora;felidae;panthera;leo leo' ELSE 'animal' END AS "to" FROM t""")
def restrict_taxa(spark, sf):
    rows = _taxa(spark, sf).select("id", taxa.five_tokens(F.col("s")).alias("taxonomy"))
    allowed = spark.createDataFrame([("mammalia;carnivora;felidae",), ("mammalia;carnivora;felidae;panthera;leo leo",)], "taxon string")
    return taxonomy.restricted(rows, allowed)


@query("tile_grid_all", """WITH i AS (SELECT o_orderkey AS image_id, 600 + o_orderkey % 900 AS w, 400 + o_orderkey % 700 AS h FROM orders),
 x AS (SELECT DISTINCT image_id, unnest(CASE WHEN w <= 640 THEN [0] ELSE list_concat(range(0, w - 640 + 1, 320), [w - 640]) END) AS tile_x FROM i), y AS (SELECT DISTINCT image_id, unnest(CASE WHEN h <= 640 THEN [0] ELSE list_concat(range(0, h - 640 + 1, 320), [h - 640]) END) AS tile_y FROM i)
 SELECT x.image_id, tile_x, tile_y FROM x JOIN y ON x.image_id = y.image_id""")
def tile_grid_all(spark, sf):
    """Over all images."""
    k = F.col("image_id")
    t = crops.tile_table(Tables(spark, sf)["fx_images"].select("image_id", (600 + k % 900).cast("int").alias("width"), (400 + k % 700).cast("int").alias("height")), 640)
    return t.select("image_id", F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y"))


@query("tile_results", fx("fx_detections") + " SELECT image_id, det_ord, round((100 + x * 640) / 1500, 9) AS x, round((50 + y * 640) / 1000, 9) AS y, round(w * 640 / 1500, 9) AS w, round(h * 640 / 1000, 9) AS h FROM fx_detections")
def tile_results(spark, sf):
    d = Tables(spark, sf)["fx_detections"].withColumn("tile_x", F.lit(100)).withColumn("tile_y", F.lit(50)).withColumn("category", F.col("det_ord"))
    i = d.select("image_id").distinct().withColumn("width", F.lit(1500)).withColumn("height", F.lit(1000))
    return crops.tiles_to_images(d, i, 640).select("image_id", F.col("category").alias("det_ord"), *[F.round(c, 9).alias(c) for c in "xywh"])


@query("gps_positions", "SELECT c_custkey AS id, round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey % 90 + 30 / 60.0 + 36 / 3600.0), 9) AS lat, CASE WHEN c_custkey % 9 = 0 THEN 'no_exif_info' WHEN c_custkey % 9 = 1 THEN 'null_island' ELSE 'success' END AS status FROM customer")
def gps_positions(spark, sf):
    k = F.col("c_custkey")
    lat = geometry.degrees((k % 90).cast("double"), F.lit(30.0), F.lit(36.0), F.when(k % 2 == 0, "S").otherwise("N"))
    zero = k % 9 == 1
    status = geometry.gps_status(k % 9 != 0, F.lit(True), F.when(zero, 0.0).otherwise(lat), F.when(zero, 0.0).otherwise(lat))
    return Tables(spark, sf)["customer"].select(k.alias("id"), F.round(lat, 9).alias("lat"), status.alias("status"))


@query("exif_times", "SELECT event_id AS id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS exif, year(ts) BETWEEN 1990 AND 2025 AS ok FROM events")
def exif_times(spark, sf):
    e = Tables(spark, sf)["events"].select(F.col("event_id").alias("id"), times.format_exif(F.col("ts")).alias("exif"))
    back = times.parse_exif(F.col("exif"))
    return e.select("id", "exif", (times.plausible(back) != "").alias("ok"))


@query("url_folders", "SELECT page_id, regexp_extract(url, '([^/]*/[^/]*|[^/]*)$', 1) AS tail FROM pages")
def url_folders(spark, sf):
    return Tables(spark, sf)["pages"].select("page_id", strings.bucket_path(F.col("url")).alias("tail"))


@query("text_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def text_digests(spark, sf):
    return Tables(spark, sf)["documents"].select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("union_categories", "WITH s AS (SELECT 0 AS source, n_nationkey AS ord, lower(n_name) AS name FROM nation UNION ALL SELECT 1, r_regionkey, CASE WHEN r_regionkey = 3 THEN 'empty' ELSE lower(r_name) END FROM region), m AS (SELECT name, min(source * 1000 + ord) AS o FROM s GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY name <> 'empty', o) - 1 AS INT) AS id FROM m")
def union_categories(spark, sf):
    from fieldlens.operators.categories import union_categories as u

    t = Tables(spark, sf)
    a = t["nation"].select(F.lit(0).alias("source"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"))
    b = t["region"].select(F.lit(1).alias("source"), F.col("r_regionkey").cast("long").alias("ord"), F.when(F.col("r_regionkey") == 3, "Empty").otherwise(F.col("r_name")).alias("name"))
    return u(a.unionByName(b))


@query("table_differences", "SELECT CAST(count(*) FILTER (WHERE n_regionkey = 1) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE n_regionkey = 2) AS BIGINT) AS only_b FROM nation")
def table_differences(spark, sf):
    n = Tables(spark, sf)["nation"]
    return combine.identical(n.filter("n_regionkey <> 2"), n.filter("n_regionkey <> 1"))


@query("split_locations")
def split_locations(spark, sf):
    c = Tables(spark, sf)["fx_images"].groupBy("location", (F.col("image_id") % 3).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.split_search(c)


@query("roll_up_scores", "WITH s AS (SELECT c_custkey AS crop_id, 'a;b;c;d;e' AS taxonomy, 0.4 AS score FROM customer UNION ALL SELECT c_custkey, 'a;b;c;d;f', CASE WHEN c_custkey % 2 = 0 THEN 0.35 ELSE 0.1 END FROM customer UNION ALL SELECT c_custkey, 'a;b;x;y;z', 0.2 FROM customer) SELECT crop_id, CASE WHEN crop_id % 2 = 0 THEN 'a;b;c;d' ELSE 'a;b' END AS taxon, round(CASE WHEN crop_id % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE 0.7 END, 9) AS score FROM (SELECT DISTINCT crop_id FROM s)")
def roll_up_scores(spark, sf):
    c = Tables(spark, sf)["customer"].select(F.col("c_custkey").alias("crop_id"))
    odd = F.when(F.col("crop_id") % 2 == 0, 0.35).otherwise(0.1)
    s = c.select("crop_id", F.lit("a;b;c;d;e").alias("taxonomy"), F.lit(0.4).alias("score")).unionByName(c.select("crop_id", F.lit("a;b;c;d;f").alias("taxonomy"), odd.alias("score"))).unionByName(c.select("crop_id", F.lit("a;b;x;y;z").alias("taxonomy"), F.lit(0.2).alias("score")))
    return taxonomy.rolled_up(s, 0.65).select("crop_id", "taxon", F.round("score", 9).alias("score"))
