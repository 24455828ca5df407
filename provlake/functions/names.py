"""Display names, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column, sep: str, i: int) -> Column:
    return F.try_element_at(F.split(c, sep), F.lit(i))


def file_name(path: Column) -> Column:
    """The last part of a path; of a path that ends in a slash, the one before."""
    last = _part(path, "/", -1)
    return F.when(last != "", last).otherwise(_part(path, "/", -2))


def short_artifact(name: str, kind: str) -> Column:
    """STR05: an artifact's name shortened by type; a name that hasn't the type's form stays as it is."""
    n, k = F.col(name), F.col(kind)
    colon = lambda i: _part(n, ":", i)
    four = lambda c: F.substring(c, 1, 4)
    below = F.when(F.instr(n, "/") > 0, F.expr(f"substring({name}, instr({name}, '/') + 1)"))
    short = (
        F.when(k == "Metrics", F.concat(colon(1), F.lit(":"), four(colon(2)), F.lit(":"), colon(3)))
        .when(k == "Model", F.concat(_part(colon(-3), "/", -1), F.lit(":"), four(colon(-2))))
        .when(k == "Dataset", F.concat(file_name(colon(1)), F.lit(":"), four(colon(-1))))
        .when(k == "Dataslice", F.concat(_part(below, ":", 1), F.lit(":"), four(colon(-1))))
        .when(k == "Step_Metrics", F.concat(_part(below, ":", 1), F.lit(":"), four(colon(-3)), F.lit(":"), colon(-2), F.lit(":"), four(colon(-1))))
    )
    return F.coalesce(short, n)


def execution_label(stage: str, uuid: str) -> Column:
    """STR06, STR07: the stage without its pipeline, an underscore, and the first four characters of the first uuid."""
    return F.concat(F.expr(f"substring({stage}, instr({stage}, '/') + 1)"), F.lit("_"), F.substring(F.col(uuid), 1, 4))


def pipeline_url(url: str, pipeline: Column) -> Column:
    """STR08: of a comma list of pipeline:url, the last that names the pipeline, without its first part; null if none does."""
    mine = F.filter(F.split(F.col(url), ","), lambda u: F.contains(u, pipeline))
    picked = F.try_element_at(mine, F.lit(-1))
    return F.when(F.instr(picked, ":") > 0, picked.substr(F.instr(picked, ":") + 1, F.length(picked))).when(picked.isNotNull(), "")


def object_path(url: Column) -> Column:
    """STR09: the last four parts of a storage URL."""
    parts = F.split(url, "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 3), F.lit(4)), "/")


def bucket_name(url: Column) -> Column:
    """STR09: the third part of an object store's URL."""
    return _part(url, "/", 3)


def host_name(url: Column) -> Column:
    """STR11."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def cached_url(url: Column, cache: Column) -> Column:
    """STR10: scheme and host of the cache, path of the URL."""
    return F.concat(F.regexp_extract(cache, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*(/[^?#]*)?", 1))


def content_key(md5: Column) -> Column:
    """HSH02, SRC14: the object key of a content hash."""
    return F.concat_ws("/", F.substring(md5, 1, 2), md5.substr(F.lit(3), F.length(md5)))


def clean_key(key: Column) -> Column:
    """STR12: hyphens become underscores, everything but word characters goes."""
    return F.regexp_replace(F.replace(key, F.lit("-"), F.lit("_")), r"\W+", "")


def squeeze(text: Column) -> Column:
    """STR14: runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
