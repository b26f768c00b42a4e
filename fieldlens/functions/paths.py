"""Path and file-name expressions; / and \\ both separate where stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of images and of videos, and cameras' overflow folders.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".gif", ".png", ".tif", ".tiff", ".bmp", ".webp", ".avif")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mpeg", ".mpg", ".mov", ".mkv", ".flv")
OVERFLOW_FOLDERS = (r"\d+RECNX", r"\d+EK\d+", r"\d+_BTCF", r"\d+MEDIA", r"\d+DSCIM")
#: Characters that clean names may have.
NAME_CHARACTERS = r"~\-_.() A-Za-z0-9"


def forward(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def dirname(p: Column) -> Column:
    return F.when(p.rlike(r"^/[^/]*$"), "/").otherwise(F.regexp_extract(p, r"^(.*)/[^/]*$", 1))


def extension(p: Column) -> Column:
    """With its point; names that start with their only point have none."""
    return F.regexp_extract(basename(p), r"[^.].*?(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    name = basename(p)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(p)))


def parts(p: Column) -> Column:
    """(folder, name, ext)."""
    return F.struct(dirname(p).alias("folder"), stem(p).alias("name"), extension(p).alias("ext"))


def tokens(p: Column) -> Column:
    """The components of a path; a leading slash is one."""
    q = forward(p)
    rest = F.filter(F.split(q, "/"), lambda t: t != "")
    return F.when(q.startswith("/"), F.concat(F.array(F.lit("/")), rest)).otherwise(rest)


def is_absolute(p: Column) -> Column:
    return p.rlike(r"^([/\\]|[A-Za-z]:)")


def join(*ps: Column) -> Column:
    """Components with a slash between each two."""
    return F.regexp_replace(F.concat_ws("/", *ps), r"/+", "/")


def _ends(p: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(extension(forward(p))).isin(*extensions)


def is_image(p: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return _ends(p, extensions)


def is_video(p: Column, extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> Column:
    return _ends(p, extensions)


def images_of(ps: Column) -> Column:
    """Those of an array of paths that are images."""
    return F.filter(ps, is_image)


def videos_of(ps: Column) -> Column:
    return F.filter(ps, is_video)


def before_extension(p: Column, s: Column, separator: str = ".") -> Column:
    """name.ext to name.s.ext."""
    ext = extension(p)
    return F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(ext)), F.lit(separator), s, ext)


def camera_folder(p: Column) -> Column:
    """The folder of an image without overflow folders."""
    q = forward(p)
    for f in OVERFLOW_FOLDERS:
        q = F.regexp_replace(q, f"/{f}/", "/")
    return dirname(q)


def folder_level(p: Column, level: int) -> Column:
    """Component of the folder at that level, null if there is none."""
    return F.get(F.split(dirname(forward(p)), "/"), F.lit(level))


def last_folder_first(p: Column) -> Column:
    """a/b/c.jpg to b/a/c.jpg: the first folder becomes the last one."""
    t = F.split(p, "/")
    n = F.size(t)
    return F.when(n >= 3, F.concat_ws("/", F.slice(t, F.lit(2), n - 2), t[0], F.element_at(t, -1))).otherwise(p)


def clean_name(p: Column, lower: bool = False, space: str | None = None, limit: int = 255, separators: bool = False) -> Column:
    """Only plain characters; accents are dropped from Latin letters.

    separators: keep colons and slashes. space: what white space becomes.
    """
    plain = F.translate(p, _ACCENTED, _PLAIN)
    out = F.regexp_replace(plain, f"[^{NAME_CHARACTERS}{':/' + re.escape(chr(92)) if separators else ''}]", "")
    out = F.trim(F.substring(out, 1, limit))
    if space is not None:
        out = F.regexp_replace(out, r"\s+", space)
    return F.lower(out) if lower else out


def flatten(p: Column, by: str = "~") -> Column:
    """A path as one name."""
    return F.translate(clean_name(p, separators=True), ":\\/", by * 3)


def wsl_to_windows(p: Column, keep: bool = False) -> Column:
    r"""/mnt/c/a/b to c:\a\b; else null, or the path itself."""
    hit = F.concat(F.regexp_extract(p, r"^/mnt/([A-Za-z])(/.*)?$", 1), F.lit(":\\"), F.replace(F.regexp_extract(p, r"^/mnt/[A-Za-z]/(.*)$", 1), F.lit("/"), F.lit("\\")))
    return F.when(p.rlike(r"^/mnt/[A-Za-z](/.*)?$"), hit).otherwise(p if keep else F.lit(None))


def windows_to_wsl(p: Column, keep: bool = False) -> Column:
    q = forward(p)
    rest = F.regexp_extract(q, r"^[A-Za-z]:/?(.*)$", 1)
    hit = F.concat(F.lit("/mnt/"), F.lower(F.substring(q, 1, 1)), F.when(rest == "", "").otherwise(F.concat(F.lit("/"), rest)))
    return F.when(q.rlike(r"^[A-Za-z]:(/.*)?$"), hit).otherwise(p if keep else F.lit(None))


def crop_name(p: Column, crop: Column) -> Column:
    return before_extension(p, F.concat(F.lit("crop_"), F.lpad(crop.cast("string"), 3, "0")))


def frame_name(n: Column) -> Column:
    return F.format_string("frame%06d.jpg", n.cast("int"))


def frame_number(p: Column) -> Column:
    """Number of a frame's file; null where the name has none."""
    return F.regexp_extract(basename(forward(p)), r"^frame(\d+)\.jpg$", 1).try_cast("int")


def patch_name(name: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", name, F.lpad(x.cast("string"), 4, "0"), F.lpad(y.cast("string"), 4, "0"))


def dated_name(p: Column, taken: Column) -> Column:
    """A flat name with the time taken before the extension."""
    stamp = F.coalesce(F.translate(taken, ": ", "--"), F.lit("unknown_datetime"))
    return before_extension(F.replace(p, F.lit("/"), F.lit("_")), stamp)


#: Latin letters with marks, and those letters.
_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"
