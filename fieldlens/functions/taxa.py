"""Taxonomy strings: id;class;order;family;genus;species;common, or the middle five."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the levels 0 to 8.
LEVELS = ("unknown", "kingdom", "phylum", "class", "order", "family", "genus", "species", "subspecies")
#: What a name gets after it when a taxon has no common name, by token 0 to 4.
SUFFIXES = (" category", " class", " order", " family", " species")


def fields(s: Column) -> Column:
    return F.transform(F.split(s, ";"), F.trim)


def has_fields(s: Column, n: int) -> Column:
    return F.coalesce((F.size(F.split(s, ";")) == n) & (s == F.lower(s)), F.lit(False))


def is_prediction(s: Column) -> Column:
    return has_fields(s, 7)


def is_taxonomy(s: Column) -> Column:
    return has_fields(s, 5)


def display_name(s: Column) -> Column:
    """The common name of a prediction string, or one from its deepest token."""
    t = fields(s)
    binomial = F.when(t[5] != "", F.trim(F.concat_ws(" ", t[4], t[5])))
    names = [F.when(t[i] != "", F.concat(t[i], F.lit(SUFFIXES[i]))) for i in (4, 3, 2, 1, 0)]
    return F.coalesce(F.nullif(t[6], F.lit("")), binomial, *names, F.lit("empty_prediction_string"))


def five_tokens(s: Column, first_only: bool = True) -> Column:
    """A five-token string from seven or five tokens; of several strings joined by | the first."""
    one = F.substring_index(s, "|", 1) if first_only else s
    t = F.split(one, ";")
    return F.array_join(F.when(F.size(t) == 7, F.slice(t, 2, 5)).otherwise(t), ";")


def level(s: Column) -> Column:
    """0 if not taxonomic, else 3 (class) to 7 (species) or 8 (subspecies, a species with a space)."""
    t = F.split(five_tokens(s), ";")
    empty = [t[i] == "" for i in range(5)]
    return F.when(empty[0], 0).when(empty[1], 3).when(empty[2], 4).when(empty[3], 5).when(empty[4], 6).when(~t[4].contains(" "), 7).otherwise(8)


def level_name(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), k)


def level_of_name(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), name), F.lit(0).cast("long")) - 1


def is_taxonomic(s: Column) -> Column:
    return level(s) > 0


def token(s: Column, i: int) -> Column:
    return F.get(F.split(s, ";"), F.lit(i))


def is_human(s: Column) -> Column:
    return s.contains("homo;sapiens") | (token(s, 6) == "human")


def is_vehicle(s: Column) -> Column:
    return token(s, 6) == "vehicle"


def is_animal(s: Column) -> Column:
    """Has a class and isn't human, or is the animal of no known class."""
    return ~is_human(s) & ((token(s, 1) != "") | (token(s, 6) == "animal"))


def prediction(*parts: Column) -> Column:
    """Seven fields as a prediction string."""
    return F.concat_ws(";", *[F.coalesce(F.lower(p), F.lit("")) for p in parts])


def clean_description(s: Column) -> Column:
    return F.lower(F.trim(F.substring_index(s, "|", 1)))
