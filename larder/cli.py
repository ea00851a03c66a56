"""Command line: python -m larder COMMAND --data DIR --out DIR."""

from __future__ import annotations

import argparse
import json
import sys

from larder import pipelines, schemas
from larder.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init-db", "prepare-db", "analyze-texts", "build-embeddings", "classify-texts", "analyze-linguistics", "export-notebook"):
        c = sub.add_parser(name)
        c.add_argument("--data", default="data")
        c.add_argument("--out", default="results")
        c.add_argument("--run", type=int, default=1)
        if name == "analyze-texts":
            c.add_argument("--clusters", type=int, default=0)
            c.add_argument("--neighbors", type=int, default=5)
        if name == "build-embeddings":
            c.add_argument("--dimension", type=int, default=32)
            c.add_argument("--window", type=int, default=2)
            c.add_argument("--neighbors", type=int, default=5)
        if name == "export-notebook":
            c.add_argument("--file", default=None, help="the notebook to write; report.ipynb in the results by default")
        if name == "classify-texts":
            c.add_argument("--target", choices=("difficulty", "cost"), default="difficulty")
            c.add_argument("--test-ratio", type=float, default=0.25)
    c = sub.add_parser("fixture")
    for option in ("--category-fixture", "--category-url", "--recipe-fixture", "--recipe-url"):
        c.add_argument(option, required=True)
    c.add_argument("--out", default="results")
    c.add_argument("--run", type=int, default=1)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--data", default="data")
    c.add_argument("--out", default="results")
    c.add_argument("--limit", type=int, default=5)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    spark = session()
    try:
        if a.command == "init-db":
            schemas.create_empty(spark, a.data)
            got: dict = {"tables": len(schemas.TABLES)}
        elif a.command == "prepare-db":
            got = pipelines.prepare(spark, a.data, a.out, a.run)
        elif a.command == "analyze-texts":
            got = pipelines.analyze(spark, a.data, a.out, a.run, a.clusters, a.neighbors)
        elif a.command == "build-embeddings":
            got = pipelines.embed(spark, a.data, a.out, a.run, a.dimension, a.window, a.neighbors)
        elif a.command == "classify-texts":
            got = pipelines.classify_texts(spark, a.data, a.out, a.run, a.target, a.test_ratio)
        elif a.command == "analyze-linguistics":
            got = pipelines.annotate(spark, a.data, a.out, a.run)
        elif a.command == "fixture":
            got = pipelines.fixture(spark, a.out, a.run, (a.category_fixture, a.category_url), (a.recipe_fixture, a.recipe_url))
        elif a.command == "search":
            got = {"hits": [r.asDict() for r in pipelines.search(spark, a.data, a.out, a.query, a.limit).collect()]}
        else:
            path = a.file or f"{a.out}/report.ipynb"
            pipelines.export_notebook(spark, a.data, path, a.out)
            got = {"notebook": path}
    except (ValueError, OSError) as e:
        p.error(str(e))
    print(json.dumps(got, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
