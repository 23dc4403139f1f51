"""A thin command line: python -m strataline COMMAND ...; results are printed as JSON lines."""

from __future__ import annotations

import argparse

from .session import session


def main() -> None:
    p = argparse.ArgumentParser(prog="strataline")
    p.add_argument("--store", default="strataline-store", help="where the index is kept")
    p.add_argument("--project", default="default")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--dry-run", action="store_true", help="show what would be indexed")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "estimate", "scan", "syntax", "docs", "structure"):
        sub.add_parser(name).add_argument("root")
    query = sub.add_parser("query", help="run a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    sub.add_parser("queries")
    a = p.parse_args()

    if a.command == "queries":
        from . import plans

        for q in plans.REGISTRY.values():
            print(q.name, *q.covers)
        return
    spark = session(a.master)
    from .plans.api import Engine
    from .sources import files

    engine = Engine(spark, a.store, a.project)
    if a.command == "query":
        from . import plans

        out = plans.queries()[a.name](spark, a.folder)
    elif a.command == "index":
        out = engine.estimate(a.root) if a.dry_run else engine.index(a.root)
    elif a.command == "estimate":
        out = engine.estimate(a.root)
    else:
        texts = files.texts(files.source_files(spark, a.root))
        out = {
            "scan": lambda: engine.scan_project(texts.select("path", "text")),
            "syntax": lambda: engine.scan_syntax(texts.select("path", "text")),
            "docs": lambda: engine.doc_gaps(texts.select("path", "text")),
            "structure": lambda: engine.structure(texts, True),
        }[a.command]()
    for line in out.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    main()
