"""A thin command line over a store in Parquet: python -m provlake COMMAND STORE [...]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import browse, catalog, export, lineage, writer
from .store import MetadataStore


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in (("pipelines", ()), ("stages", ("pipeline",)), ("executions", ("pipeline", "stage")), ("artifacts", ("pipeline", "stage", "kind")), ("ancestors", ("artifact",)), ("descendants", ("artifact",)), ("export", ("path",)), ("find", ("name",)), ("step", ("pipeline", "target", "to"))):
        c = sub.add_parser(name)
        c.add_argument("store")
        for x in extra:
            c.add_argument(x, type=int if x == "artifact" else str)
        if name == "step":
            c.add_argument("values", nargs="*", metavar="name=value")
        if name in ("executions", "artifacts"):
            c.add_argument("--page", type=int, default=1)
            c.add_argument("--size", type=int, default=20)
            c.add_argument("--search", default="")
    return p


def run(args: argparse.Namespace, store: MetadataStore) -> DataFrame | None:
    """The rows that a command shows; export writes and shows none."""
    page = browse.Page(args.page, args.size, search=args.search, descending=args.command == "executions") if hasattr(args, "page") else None
    if args.command == "step":  # the store with the step's run goes to another place
        recorder = writer.Recorder(args.pipeline)
        writer.run_step(args.target, dict(v.split("=", 1) for v in args.values), recorder)
        return recorder.commit(store).write_parquet(args.to)
    if args.command == "export":
        return export.write_json(store, args.path)
    return {
        "pipelines": lambda: catalog.pipelines(store).select("id", "name"),
        "stages": lambda: browse.stages(store, args.pipeline),
        "executions": lambda: browse.executions_page(store, args.pipeline, args.stage, page),
        "artifacts": lambda: browse.artifacts_page(store, args.pipeline, args.stage, args.kind, page),
        "ancestors": lambda: lineage.ancestors(store, args.artifact).orderBy("hops", "id"),
        "descendants": lambda: lineage.descendants(store, args.artifact).orderBy("hops", "id"),
        "find": lambda: catalog.search_artifacts(store, args.name),
    }[args.command]()


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("provlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = run(args, MetadataStore.from_parquet(spark, args.store))
    if rows is not None:
        rows.show(getattr(args, "size", 50), truncate=False)


if __name__ == "__main__":
    main()
