"""Command line: check-health, embed, search-hpo, search-mondo and run-demo."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .functions.udfs import embedder
from .operators import ontology, resolution
from .plans import composites
from .session import session
from .sources import readers, sinks


def _search(spark, args, prefix: str) -> int:
    terms = readers.ontology_terms(readers.ontology_stanzas(spark, args.obo), prefix)
    entries = ontology.search_entries(terms)
    asked = spark.createDataFrame([(args.term,)], "term string")
    hits = resolution.assertion_search(asked, entries, ontology.token_postings(entries), args.limit, filter_negated=args.filter_negated).orderBy("rank").collect()
    for hit in hits:
        print(json.dumps(hit.asDict()))
    return 0 if hits else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    health = commands.add_parser("check-health", help="whether tables can be read: NAME=PATH ...")
    health.add_argument("tables", nargs="*")
    embed = commands.add_parser("embed", help="the vector of a text")
    embed.add_argument("text")
    for name in ("search-hpo", "search-mondo"):
        search = commands.add_parser(name, help="entries of an ontology file for a term")
        search.add_argument("term")
        search.add_argument("--obo", required=True)
        search.add_argument("--limit", type=int, default=5)
        search.add_argument("--filter-negated", action="store_true")
    demo = commands.add_parser("run-demo", help="training records into a case table")
    demo.add_argument("records", help="a Parquet table of id, created_at, patient_id, clinical_note and suspected_condition")
    demo.add_argument("table", help="the case table to append to")
    demo.add_argument("--limit", type=int, default=5)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "check-health":
        rows = readers.ping(spark, dict(x.split("=", 1) for x in args.tables)).collect() if args.tables else []
        for row in rows:
            print(json.dumps(row.asDict()))
        print(json.dumps({"spark": spark.version, "ok": all(r["ok"] for r in rows)}))
        return 0 if all(r["ok"] for r in rows) else 1
    if args.command == "embed":
        row = spark.createDataFrame([(args.text,)], "text string").select(embedder()("text").alias("v")).first()
        print(json.dumps(list(row["v"])))
        return 0
    if args.command == "run-demo":
        cases = composites.training_cases(spark.read.parquet(args.records), embedder(), args.limit)
        sinks.append(cases, args.table)
        print(json.dumps({"cases": spark.read.parquet(args.table).agg(F.count("*")).first()[0]}))
        return 0
    return _search(spark, args, "HP" if args.command == "search-hpo" else "MONDO")


if __name__ == "__main__":
    sys.exit(main())
