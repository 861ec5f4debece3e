"""python -m tripleframe COMMAND: build, query, add, sub, export, backup, restore, show, drop, monitor, serve."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .catalog import Catalog
from .sources import rdf, results


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tripleframe")
    parser.add_argument("--root", default="tripleframe-data")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"build": ["store", "files+"], "query": ["store", "text"], "add": ["store", "file"], "sub": ["store", "file"], "export": ["store", "path"], "backup": ["store", "path"], "restore": ["store", "path"], "show": [], "drop": ["store"], "monitor": ["store"], "serve": ["store"]}.items():
        p = commands.add_parser(name)
        for a in args:
            p.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
        p.add_argument("--format", default=None)
        p.add_argument("--port", type=int, default=8000)
    opts = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tripleframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark, opts.root)
    if opts.command == "show":
        print("\n".join(catalog.show()))
    elif opts.command == "build":
        print(catalog.build(opts.store, opts.files).quads.count())
    elif opts.command == "drop":
        catalog.drop(opts.store)
    elif opts.command == "restore":
        catalog.restore(opts.store, opts.path)
        catalog.checkpoint(opts.store)
    else:
        catalog.load(opts.store)
        if opts.command == "query":
            answer = catalog.query(opts.store, opts.text)
            if answer.kind == "select":
                print("".join(results.lines_of_select(answer.value, opts.format)) if opts.format else results.table_text(answer.value))
            else:
                print(rdf.ntriples_body(answer.value) if answer.kind == "construct" else answer.value)
            if answer.kind == "update":
                _replace(catalog, opts.store)
        elif opts.command in ("add", "sub"):
            print(catalog.batch(opts.store, opts.file, opts.command == "sub"))
            _replace(catalog, opts.store)
        elif opts.command == "monitor":
            print(catalog.monitor(opts.store))
        elif opts.command == "serve":
            from .service import Service

            Service(catalog, default=opts.store).server(opts.port).serve_forever()
        else:
            getattr(catalog, opts.command)(opts.store, opts.path)
    return 0


def _replace(catalog: Catalog, name: str) -> None:
    """The store's plan does not read the saved folder (its base was written apart), so it can be overwritten."""
    catalog.checkpoint(name)


if __name__ == "__main__":
    raise SystemExit(main())
