"""Times: camera formats, and dates found in noisy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXIF = "yyyy:MM:dd HH:mm:ss"
#: Shapes of dates in text read from images, in order of trial, with the format once their blanks are gone.
DATE, DAY = r"(\d{4}) ?([-/]) ?(\d\d) ?[-/] ?(\d\d)", r"(\d\d) ?([-/]) ?(\d\d) ?[-/] ?(\d{4})"
SHAPES = (
    (r"\d{4} ?- ?\d\d ?- ?\d\d +\d+ ?:? ?\d\d ?: ?\d\d *[ap]m", "yyyy-MM-dd h:mm:ssa"),
    (r"\d\d ?/ ?\d\d ?/ ?\d{4} +\d+ ?: ?\d\d ?: ?\d\d *[ap]m", "MM/dd/yyyy h:mm:ssa"),
    (r"\d{4} ?/ ?\d\d ?/ ?\d\d +\d+ ?: ?\d\d ?: ?\d\d *[ap]m", "yyyy/MM/dd h:mm:ssa"),
    (r"\d\d ?/ ?\d\d ?/ ?\d{4} +\d+ ?: ?\d\d *[ap]m", "MM/dd/yyyy h:mma"),
    (r"\d{4} ?/ ?\d\d ?/ ?\d\d +\d+ ?: ?\d\d *[ap]m", "yyyy/MM/dd h:mma"),
    (r"\d{4} ?- ?\d\d ?- ?\d\d *\d\d ?: ?\d\d ?: ?\d\d", "yyyy-MM-dd HH:mm:ss"),
    (r"\d\d ?- ?\d\d ?- ?\d{4} *\d\d ?: ?\d\d ?: ?\d\d", "MM-dd-yyyy HH:mm:ss"),
    (r"\d{4} ?/ ?\d\d ?/ ?\d\d *\d\d ?: ?\d\d ?: ?\d\d", "yyyy/MM/dd HH:mm:ss"),
    (r"\d\d ?/ ?\d\d ?/ ?\d{4} *\d\d ?: ?\d\d ?: ?\d\d", "MM/dd/yyyy HH:mm:ss"),
)


def parse_exif(s: Column) -> Column:
    """Null where the text isn't of that form."""
    return F.try_to_timestamp(s, F.lit(EXIF))


def format_exif(ts: Column) -> Column:
    return F.date_format(ts, EXIF)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def parse_any(s: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", EXIF, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss"), on_failure: str = "null") -> Column:
    """The first format that fits. on_failure: null, or error."""
    got = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    return got if on_failure == "null" else F.when(s.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("not a time: "), s)).cast("timestamp")).otherwise(got)


def find_in_text(s: Column) -> Column:
    """The first shape's date in a text, by their order of trial."""
    q = F.lower(F.regexp_replace(s, r"\s+", " "))
    found = []
    for shape, form in SHAPES:
        hit = F.regexp_replace(F.regexp_extract(q, shape, 0), r" ?([-/:]) ?", "$1")
        day, rest = F.regexp_extract(hit, r"^([\d/-]{10})", 1), F.regexp_replace(F.regexp_replace(hit, r"^[\d/-]{10}", ""), " ", "")
        found.append(F.try_to_timestamp(F.concat_ws(" ", day, F.upper(rest)), F.lit(form)))
    return F.coalesce(*found)


def plausible(ts: Column, first_year: int = 1990, last_year: int = 2025) -> Column:
    """Formatted if the year is in range, else empty."""
    return F.coalesce(F.when(F.year(ts).between(first_year, last_year), F.date_format(ts, "MM-dd-yyyy HH:mm:ss")), F.lit(""))


def trusted(ts: Column, as_of: Column, first_year: int) -> Column:
    """Null if before that year, or within a day of as_of or later."""
    return F.when((F.year(ts) >= first_year) & (ts < as_of - F.expr("interval 1 day")), ts)


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
