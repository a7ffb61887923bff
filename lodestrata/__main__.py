"""Command line: generate, catalog, migrate, load, build, score, status, report, drift, parity."""

from __future__ import annotations

import argparse
import datetime as dt
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    c = p.add_subparsers(dest="command", required=True)
    g = c.add_parser("generate", help="write an extract")
    g.add_argument("--scale", choices=("small", "full"), default="small")
    g.add_argument("--seed", type=int)
    g.add_argument("--as-of", type=dt.date.fromisoformat)
    g.add_argument("--out", required=True)
    g.add_argument("--no-defects", action="store_true")
    c.add_parser("catalog", help="write the data catalog").add_argument("--out", required=True)
    for name, text in (("load", "land an extract"), ("build", "build the warehouse"), ("score", "compare found with seeded defects"), ("status", "show versions and runs"), ("report", "show a report")):
        s = c.add_parser(name, help=text)
        s.add_argument("--store", required=True)
        if name in ("load", "score"):
            s.add_argument("--extract", required=True)
        if name == "build":
            s.add_argument("--lenient", action="store_true", help="text that does not fit its type becomes null")
        if name == "score":
            s.add_argument("--strict", action="store_true", help="fail unless every seeded defect is found and nothing else")
        if name == "report":
            s.add_argument("name")
            s.add_argument("--group", action="append", default=[], help="read as a member of this group")
    s = c.add_parser("migrate", help="apply numbered SQL files")
    s.add_argument("--store", required=True)
    s.add_argument("--folder", required=True)
    s = c.add_parser("drift", help="compare declared tables with those of a store")
    s.add_argument("--store", required=True)
    s.add_argument("--sql", help="a file with CREATE TABLE statements; without it landed datasets are compared with the registry")
    s = c.add_parser("parity", help="compare the reports of two stores")
    s.add_argument("--store", required=True)
    s.add_argument("--other", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from lodestrata.sources import registry

    if args.command == "catalog":
        with open(args.out, "w", encoding="utf-8", newline="\n") as f:
            f.write(registry.catalog())
        return 0

    from pyspark.sql import SparkSession

    from lodestrata.operators import tables
    from lodestrata.plans import checks, policy, rules, views, warehouse
    from lodestrata.sources import extract, generate, migrate
    from lodestrata.sources.store import Store

    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    if args.command == "generate":
        seed, day = args.seed if args.seed is not None else generate.DEFAULT_SEED, args.as_of or generate.DEFAULT_DAY
        manifest = generate.generate(spark, args.out, args.scale, seed, day, not args.no_defects)
        print(f"{manifest['total_rows']} rows, {len(manifest['injections'])} defects")
        return 0
    store = Store(spark, args.store)
    if args.command == "load":
        try:
            print(f"landing version {extract.load(spark, args.extract, store)}")
        except extract.LoadError as problem:
            print(problem, file=sys.stderr)
            return 1
    elif args.command == "build":
        try:
            print(f"warehouse version {warehouse.build(spark, store, args.lenient)}")
        except warehouse.BuildError as problem:
            print(problem, file=sys.stderr)
            return 1
    elif args.command == "status":
        print(f"landing {store.history(extract.AREA)}, warehouse {store.history(warehouse.AREA)}")
        if (runs := store.log(warehouse.RUNS)) is not None:
            runs.orderBy("started_at").show(50, truncate=False)
            print("latest run:", warehouse.latest_run(store))
    elif args.command == "score":
        t = store.read(warehouse.AREA)
        seeded = extract.injections(spark, extract.read_manifest(spark, args.extract))
        card = rules.score(t["dq_exception"], seeded).orderBy("rule_code")
        card.show(50, truncate=False)
        if args.strict and card.where("missed > 0 or false_positives > 0 or not implemented").count():
            return 1
    elif args.command == "report":
        t = store.read(warehouse.AREA)
        frame = policy.read(t, policy.principal(*args.group), args.name) if args.group else views.VIEWS[args.name](t)
        (views.ordered(args.name, frame) if args.name in views.VIEWS else frame).show(100, truncate=False)
    elif args.command == "parity":
        mine, other = store.read(warehouse.AREA), Store(spark, args.other).read(warehouse.AREA)
        results = {name: tables.parity(view(mine), view(other)) for name, view in views.VIEWS.items()}
        for name, result in results.items():
            print(f"{name:<32} {'match' if result.ok else 'MISMATCH':<9} {result.rows[0]} and {result.rows[1]} rows, {result.differing} differ{'' if result.same_columns else ', other columns'}")
            for left, right in result.diffs:
                print(f"    {left} | {right}")
        return 0 if all(r.ok for r in results.values()) else 1
    elif args.command == "migrate":
        try:
            print(", ".join(f"{m.version} {m.name}" for m in migrate.run(store, args.folder)) or "nothing to apply")
        except migrate.MigrationError as problem:
            print(problem, file=sys.stderr)
            return 1
    elif args.command == "drift":
        if args.sql:
            with open(args.sql, encoding="utf-8") as f:
                declared, found = checks.declared_in(f.read()), store.read(warehouse.AREA)
        else:
            declared, found = {n: list(d.columns) for n, d in registry.DATASETS.items()}, store.read(extract.AREA)
        problems = checks.drift(declared, {n: df.columns for n, df in found.items()})
        print("\n".join(problems) or "no drift")
        return 1 if problems else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
