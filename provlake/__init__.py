"""Provenance analytics on Spark: pipelines, stages, executions, artifacts and the events between them, as DataFrames."""

from .store import MetadataStore

__all__ = ["MetadataStore"]
