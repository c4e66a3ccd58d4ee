"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    return F.lower(F.trim(text))


def tokens(text: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.split(normalised(text), r"[ \t\r\n]+"))


def route(url: Column) -> Column:
    """Path of a URL; segments that are a UUID or digits become {id}, no path "/"."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    named = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(ID_SEGMENT), "{id}").otherwise(s))
    return F.when(path == "", "/").otherwise(F.array_join(named, "/"))


def sanitised(message: Column, folder: Column | str = "", most: int = 300) -> Column:
    """The work folder becomes <worker-dir>, absolute paths <path>; at most so many
    characters stay."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    out = F.when(folder == "", message).otherwise(F.replace(message, folder, F.lit("<worker-dir>")))
    out = F.regexp_replace(out, WINDOWS_PATH, "<path>")
    return F.substring(F.regexp_replace(out, POSIX_PATH, "$1<path>"), 1, most)


def workload_name(name: Column) -> Column:
    return F.translate(name, "_", "-")


def is_workload_name(name: Column) -> Column:
    return name.rlike(WORKLOAD_NAME)


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


def is_semver(version: Column) -> Column:
    return version.rlike(SEMVER)


def block_pair(key: Column) -> Column:
    """(left, right) of a key map.<i>x<j>; null if it has another form."""
    part = lambda k: F.regexp_extract(key, r"\Amap\.([0-9]+)x([0-9]+)\z", k)
    return F.when(part(1) != "", F.struct(part(1).cast("long").alias("left"), part(2).cast("long").alias("right")))


def index_key(key: Column) -> Column:
    """The index of a key map.<i>; null if it has another form."""
    return F.nullif(F.regexp_extract(key, r"\Amap\.([0-9]+)\z", 1), F.lit("")).cast("long")


def ranged_float(cell: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A cell as a double within bounds; null if it isn't one (NaN included)."""
    x = cell.try_cast("double")
    return F.when(~F.isnan(x) & x.between(low, high), x)


def truncated_ms(seconds: Column) -> Column:
    """Rounded to milliseconds toward zero."""
    return F.when(seconds < 0, F.ceil(seconds * 1000)).otherwise(F.floor(seconds * 1000)) / 1000


def is_csv(media: Column, name: Column) -> Column:
    """Whether an artifact can be shown as CSV: by media type, else by its name."""
    kind = F.trim(F.element_at(F.split(F.lower(media), ";"), 1))
    return F.coalesce(kind == "text/csv", F.lit(False)) | F.coalesce(F.endswith(F.lower(name), F.lit(".csv")), F.lit(False))


#: The forms of names, versions, ids and paths.
WORKLOAD_NAME = r"\A[a-z][a-z0-9]*(-[a-z0-9]+)*\z"
IDENTIFIER = r"\A[a-z][a-z0-9]*([-_.][a-z0-9]+)*\z"
SEMVER = r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?\z"
ID_SEGMENT = r"\A([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\z"
WINDOWS_PATH = r"[A-Za-z]:\\[^\s'\"\],)]+"
POSIX_PATH = r"(^|[\s'\"(\[=])/[^\s'\"\],)]+"
