"""Side files, manifests, lock files and dumps (SRC06-19, SNK03-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import content_key, squeeze


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SRC06."""
    return spark.read.parquet(path)


def write_metrics(steps: DataFrame, path: str, order: str = "SequenceNumber") -> None:
    """SNK03: step metrics with their sequence numbers first."""
    rest = [c for c in steps.columns if c != order]
    steps.select(F.col(order).cast("long"), *rest).write.mode("overwrite").parquet(path)


def read_slice(spark: SparkSession, path: str) -> DataFrame:
    """SRC07: a data slice: Path, hash and further columns."""
    return spark.read.parquet(path)


def write_slice(rows: DataFrame, path: str) -> None:
    """SNK04: one row for each Path, the last one given."""
    rows.dropDuplicates(["Path"]).write.mode("overwrite").parquet(path)


def update_slice(rows: DataFrame, record: str, values: dict[str, str]) -> DataFrame:
    """SNK05: the slice with some columns of one record replaced; a KeyError if the record isn't there."""
    if rows.where(F.col("Path") == record).isEmpty():
        raise KeyError(record)
    hit = F.col("Path") == record
    return rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k) if k in rows.columns else F.lit(None)) for k, v in values.items()})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: id, label and text, without header."""
    return spark.read.csv(path, sep="\t", schema="id string, label int, text string", quote="")


def parse_posts(lines: DataFrame, tag: str, column: str = "value") -> DataFrame:
    """SRC11, STR14: XML lines `<row Id= Title= Body= Tags= />` as id, label (whether the tag is there) and text; other lines go."""
    attribute = lambda name: F.regexp_extract(F.col(column), rf'\s{name}="([^"]*)"', 1)
    plain = lambda c: _entities(c)
    rows = lines.where(F.trim(column).startswith("<row ") & F.trim(column).endswith("/>") & (attribute("Id") != ""))
    return rows.select(attribute("Id").alias("id"), plain(attribute("Tags")).contains(f"<{tag}>").cast("int").alias("label"), squeeze(F.concat_ws(" ", plain(attribute("Title")), plain(attribute("Body")))).alias("text"))


def _entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#xA;", "\n"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def read_posts(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """SRC11 from files, gzip or plain."""
    return parse_posts(spark.read.text(path), tag)


def manifest_objects(manifests: DataFrame, column: str = "value") -> DataFrame:
    """SRC14, SRC16: directory manifests (JSON lists of relpath and md5) as rows: relpath, md5 and object key."""
    items = F.explode(F.from_json(column, "array<struct<relpath:string,md5:string>>")).alias("item")
    return manifests.select(items).select("item.relpath", "item.md5", content_key(F.col("item.md5")).alias("key"))


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """SRC17, HSH01: expected (key, md5) with whether files (key, content) hold it: ok, different or missing."""
    found = files.select("key", F.md5("content").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("md5"), "ok").otherwise("different")
    return expected.join(found, "key", "left").select("key", "md5", state.alias("state"))


def transfer_counts(states: DataFrame) -> DataFrame:
    """AGG14: total, ok and failed."""
    return states.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") != "ok").alias("failed"))


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """SRC15: all objects below a folder of any store that Spark reads: key (last two path parts) and content."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.array_join(F.slice(parts, -2, 2), "/").alias("key"), "content")


def lock_stages(spark: SparkSession, lock: dict) -> DataFrame:
    """SRC09, SRC18: a parsed lock file as rows: stage, command, direction (deps, outs), path and md5."""
    rows = [(stage, body.get("cmd"), side, item.get("path"), item.get("md5")) for stage, body in lock.get("stages", {}).items() for side in ("deps", "outs") for item in body.get(side, [])]
    return spark.createDataFrame(rows, "stage string, command string, direction string, path string, md5 string")


def lineage_strings(stages: DataFrame, pipeline: str) -> DataFrame:
    """SRC18: of each stage of a lock file its lineage string: command, stage and pipeline, joined by commas."""
    return stages.select("stage", F.concat_ws(",", "command", "stage", F.lit(pipeline)).alias("lineage")).distinct()


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """SRC09 from a YAML file, where a YAML library is installed."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("reading lock files takes the yaml package") from e
    text = spark.read.text(path, wholetext=True).first()[0]
    return lock_stages(spark, yaml.safe_load(text))


def union_servers(stores: dict[str, DataFrame]) -> DataFrame:
    """SRC13, SET01: the same table of several servers, with a column server; columns that one lacks are null."""
    out = None
    for server, df in stores.items():
        tagged = df.withColumn("server", F.lit(server))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no server")
    return out
