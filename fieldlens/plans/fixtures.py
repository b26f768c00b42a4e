"""Observation tables derived from the driver's tables, for queries and their oracles.

orders play images, lineitem detections, part the classes of detections, events
captures with a location and a time, conversations video frames, nations and
regions a taxonomy. FX is the same as a WITH clause, for the oracle SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_images": "select o_orderkey as image_id, o_custkey % 150 as location, o_orderdate as captured_at, case when o_orderkey % 97 = 0 then 'inference failed' end as failure from orders",
    "fx_detections": """select l.l_orderkey as image_id,
 cast(row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax) - 1 as bigint) as det_ord,
 1 + l.l_suppkey % 3 as category, l.l_quantity / cast(50 as double) as conf, l.l_discount * 5.0 as x, l.l_tax * 5.0 as y,
 (1 + l.l_partkey % 4) / cast(10 as double) as w, (1 + l.l_suppkey % 4) / cast(10 as double) as h, l.l_partkey as part_id
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey where l.l_orderkey % 97 <> 0""",
    "fx_classes": "select d.image_id, d.det_ord, p.p_type as class_name, p.p_size / cast(50 as double) as class_conf from fx_detections d join part p on d.part_id = p.p_partkey",
    "fx_truth": "select image_id, category, x, y, w, h from fx_detections where (image_id * 7 + det_ord) % 5 < 2",
    "fx_capture": "select event_id as image_id, user_id as location, ts as captured_at, event_type as category, value / cast(500 as double) as conf from events",
    "fx_frames": "select conv_id as video_id, turn as frame_number, role as category, (length(text) % 100) / cast(100 as double) as conf from conversations",
    "fx_taxonomy": "select cast(n_nationkey as bigint) as node_id, n_name as node_name, cast(1000 + n_regionkey as bigint) as parent_id, 'nation' as level from nation union all select cast(1000 + r_regionkey as bigint), r_name, cast(-1 as bigint), 'region' from region",
    "fx_scored": "select d.doc_id, (d.n_chars % 101) / cast(100 as double) as score, l.quality as truth from documents d join labels l on d.doc_id = l.doc_id",
}
NEEDS = {
    "fx_images": ["orders"], "fx_detections": ["lineitem", "orders"], "fx_classes": ["fx_detections", "part"], "fx_truth": ["fx_detections"],
    "fx_capture": ["events"], "fx_frames": ["conversations"], "fx_taxonomy": ["nation", "region"], "fx_scored": ["documents", "labels"],
}


def closure(names: tuple[str, ...]) -> list[str]:
    """Views in an order in which each comes after those that it reads."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*closure(tuple(v for v in NEEDS[n] if v in VIEWS)), n] if x not in out]
    return out


def fx(*names: str) -> str:
    """A WITH clause, open for further parts, for oracle SQL."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in closure(names))


class Tables:
    """Base tables and views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cache  # noqa: B019  (lives as long as its Tables)
    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = VIEWS[name]
        import re

        for n in NEEDS[name]:
            sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **{n: self[n] for n in NEEDS[name]})
