"""Command-line dataset tools (run with spark-submit or ``python -m grainset.cli``).

    copy        regex-selected copy with not-null filtering and repartitioning
    stamp       write the row-group catalog and schema side tables of a dataset
    index       build value -> row-group indexes for fields of a stamped dataset
    report      print the schema and the per-index value counts
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import rowgroups as RG
from .session import ship_package
from .sources import writer as W


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("grainset-cli").getOrCreate()
    ship_package(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="grainset")
    sub = ap.add_subparsers(dest="cmd", required=True)

    cp = sub.add_parser("copy", help="copy a dataset")
    cp.add_argument("source")
    cp.add_argument("target")
    cp.add_argument("--field-regex", nargs="*", default=None)
    cp.add_argument("--not-null-fields", nargs="*", default=None)
    cp.add_argument("--overwrite-output", action="store_true")
    cp.add_argument("--partition-count", type=int, default=None)
    cp.add_argument("--row-group-size-mb", type=int, default=None)

    st = sub.add_parser("stamp", help="write catalog and schema side tables")
    st.add_argument("dataset")

    ix = sub.add_parser("index", help="build single-field indexes")
    ix.add_argument("dataset")
    ix.add_argument("--field", action="append", required=True, help="field to index (repeatable)")
    ix.add_argument("--not-null", action="append", default=[], help="field for a not-null index")

    rp = sub.add_parser("report", help="schema and index value counts")
    rp.add_argument("dataset")
    rp.add_argument("--skip-index", nargs="*", default=None)
    rp.add_argument("--print-values", action="store_true")

    args = ap.parse_args(argv)
    spark = _session()
    if args.cmd == "copy":
        W.copy_dataset(spark, args.source, args.target, args.field_regex, args.not_null_fields,
                       args.overwrite_output, args.partition_count, args.row_group_size_mb)
    elif args.cmd == "stamp":
        W.stamp_metadata(spark, args.dataset)
    elif args.cmd == "index":
        indexers = [RG.SingleFieldIndexer(f"{f}_index", f) for f in args.field]
        indexers += [RG.FieldNotNullIndexer(f"{f}_not_null", f) for f in args.not_null]
        W.build_dataset_indexes(spark, args.dataset, indexers)
    elif args.cmd == "report":
        text, report = W.metadata_report(spark, args.dataset, args.skip_index)
        print(text)
        if report is not None:
            counts = report.groupBy("index_name").count().orderBy("index_name")
            for r in counts.toLocalIterator():
                print(f"index {r['index_name']}: {r['count']} values")
            if args.print_values:
                for r in report.orderBy("index_name", "value").toLocalIterator():
                    print(f"  {r['index_name']}\t{r['value']}\t{r['n_pieces']} row groups")
    return 0


if __name__ == "__main__":
    sys.exit(main())
