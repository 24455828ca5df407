"""A metadata store: named DataFrames, lazily read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import PIPELINE_TYPE, STAGE_TYPE, TABLES


class Late(Mapping):
    """Tables by name that are made when they are first asked for, so that a merge does only what its reader needs."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class MetadataStore:
    """The tables of schema.TABLES by name; a table that is not given is empty."""

    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], TABLES[name])

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> MetadataStore:
        """A folder with one Parquet table for each name."""
        return cls(spark, {t: spark.read.schema(s).parquet(f"{path}/{t}") for t, s in TABLES.items()})

    def write_parquet(self, path: str) -> None:
        """Write every table; events and properties in files of the key that joins them."""
        for t, schema in TABLES.items():
            df = getattr(self, t).select(*(F.col(f.name).cast(f.dataType) for f in schema))
            key = {"event": "execution_id", "executionproperty": "execution_id", "artifactproperty": "artifact_id"}.get(t)
            (df.repartition(key) if key else df).write.mode("overwrite").parquet(f"{path}/{t}")

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, partitions: int = 32, **options: str) -> MetadataStore:
        """A relational store. Tables with an id are read in ranges of it; filters and column choices go to the database."""
        tables = {}
        for t, schema in TABLES.items():
            reader = spark.read.format("jdbc").options(url=url, dbtable=f'"{t}"', **options)
            key = next((f.name for f in schema if f.name in ("id", "artifact_id", "execution_id")), None)
            if key and partitions > 1:
                low, high = spark.read.format("jdbc").options(url=url, query=f'SELECT min({key}) AS a, max({key}) AS b FROM "{t}"', **options).load().first()
                if low is not None and high > low:
                    reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions)
            tables[t] = reader.load()
        return cls(spark, tables)

    @property
    def pipelines(self) -> DataFrame:
        """Contexts that are pipelines."""
        return self.context.join(self.type.where(F.col("name") == PIPELINE_TYPE).select(F.col("id").alias("type_id")), "type_id", "left_semi")

    @property
    def stages(self) -> DataFrame:
        """Contexts that are stages, with pipeline_id; a stage of two pipelines has two rows."""
        kinds = self.type.where(F.col("name") == STAGE_TYPE).select(F.col("id").alias("type_id"))
        links = self.parentcontext.select(F.col("context_id").alias("id"), F.col("parent_context_id").alias("pipeline_id"))
        return self.context.join(kinds, "type_id", "left_semi").join(links, "id")

    def create_views(self) -> None:
        """Every table as a temporary view."""
        for t in TABLES:
            getattr(self, t).createOrReplaceTempView(t)
