"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for yes and no.
YES, NO = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def is_float(s: Column) -> Column:
    return F.coalesce(F.trim(s).try_cast("double").isNotNull(), F.lit(False))


def is_int(s: Column) -> Column:
    return F.coalesce(F.trim(s).rlike(r"^[+-]?\d+$"), F.lit(False))


def to_bytes(s: Column) -> Column:
    """2G, 10GB, 30 MB, 17 as a number of bytes; 0 for anything else."""
    q = F.regexp_replace(s, r"\s+", "")
    form = r"^(\d+\.?\d*|\.\d+)([KMGT]?)B?$"
    n, unit = F.regexp_extract(q, form, 1).try_cast("double"), F.regexp_extract(q, form, 2)
    k = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.coalesce(n * F.pow(F.lit(1024.0), k), F.lit(0.0))


def without_ansi(s: Column) -> Column:
    return F.regexp_replace(s, r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "")


def slug(s: Column) -> Column:
    """Lower-case letters and digits with single hyphens between; accents are dropped from Latin letters."""
    from fieldlens.functions.paths import _ACCENTED, _PLAIN

    low = F.lower(F.translate(s, _ACCENTED, _PLAIN))
    kept = F.regexp_replace(F.regexp_replace(low, r"[^\x00-\x7F]", ""), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def key_value(s: Column, sep: str = "=") -> Column:
    """(key, value) of key=value, trimmed, split at the first sign."""
    at = F.instr(s, sep)
    return F.when(at > 0, F.struct(F.trim(F.substring(s, F.lit(1), at - 1)).alias("key"), F.trim(F.substring(s, at + len(sep), F.length(s))).alias("value")))


def key_values(items: Column, sep: str = "=") -> Column:
    """A list of key=value as a map; of equal keys the last counts."""
    pairs = F.filter(F.transform(items, lambda s: key_value(s, sep)), lambda p: p.isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def joined_map(m: Column, between: str = " ", sep: str = "=") -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(sep), e["value"])), between)


def parse_bool(s: Column, strict: bool = False) -> Column:
    """Yes and no words as booleans; an error for others."""
    q = F.lower(F.trim(s))
    yes, no = (("true",), ("false",)) if strict else (YES, NO)
    return F.when(q.isin(*yes), True).when(q.isin(*no), False).when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def to_bool(s: Column) -> Column:
    """true, false or a number as a boolean, else null."""
    q = F.lower(F.trim(s))
    return F.when(q == "true", True).when(q == "false", False).otherwise(q.try_cast("int") != 0)


def is_blank(s: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(F.trim(F.regexp_replace(s, r"\s", " ")) == "", F.lit(True))


def is_signed_url(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^https?://") & s.contains("core.windows.net") & s.contains("?"), F.lit(False))


def inside_signed_url(folder: Column, path: Column) -> Column:
    """The url of a path inside a signed folder url; null if that isn't one."""
    safe = F.replace(F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("%20"))
    head, query = F.substring_index(folder, "?", 1), F.regexp_extract(folder, r"^[^?]*\?(.*)$", 1)
    return F.when(is_signed_url(folder), F.concat(F.regexp_replace(head, "/$", ""), F.lit("/"), safe, F.lit("?"), query))


def other_base(url: Column, base: str, new_base: str) -> Column:
    """A url below another base; null if it isn't below the first."""
    return F.when(url.startswith(base), F.concat(F.lit(new_base), F.substring(url, len(base) + 1, 1 << 20)))


def bucket_path(url: Column, mode: str = "deployment") -> Column:
    """gs://bucket/a/.../d/f.jpg as a relative path: none keeps all folders, guid the file, deployment the last folder and the file."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^gs://[^/]*/", ""), r"_thumb(\.[^.]*)?$", "$1")
    if mode == "none":
        return rest
    return F.regexp_extract(rest, r"([^/]*)$" if mode == "guid" else r"([^/]*/[^/]*|[^/]*)$", 1)


def with_underscores(s: Column) -> Column:
    return F.translate(s, " ", "_")


def is_unidentified(identified_by: Column) -> Column:
    return F.coalesce(F.lower(identified_by), F.lit("computer vision")) == "computer vision"
