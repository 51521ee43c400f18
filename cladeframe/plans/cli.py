"""The command line: python -m cladeframe.plans.cli prep | annotate | filter | n2ref | report2tsv."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from cladeframe.plans import commands


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeframe", description="Taxonomic read processing on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def positive(text: str) -> int:
        if (n := int(text)) < 1:
            raise argparse.ArgumentTypeError("must be 1 or more")
        return n

    def add(name: str, help: str):
        return sub.add_parser(name, help=help)

    def cram(p) -> None:
        p.add_argument("--cram-reference", metavar="FASTA", help="reference of CRAM files, which need an external decoder")

    def compressed(p) -> None:
        p.add_argument("--threads", type=positive, default=1, help="accepted; Spark's executors compress")
        p.add_argument("--compression-level", type=int, default=5, choices=range(10), metavar="0..9", dest="level")

    def unordered(p) -> None:
        p.add_argument("--unordered", action="store_true", help="accepted; reads and assignments always meet by name, in any order")

    p = add("prep", "reads or alignments to FASTA templates")
    p.add_argument("files", nargs="*", metavar="FILE", help="one or two inputs, standard input by default")
    p.add_argument("-i", "--input", nargs="+", default=[])
    p.add_argument("--per-record", action="store_true")
    p.add_argument("-o", "--output", default="-")
    cram(p)
    p = add("annotate", "tag alignments with the taxon of their read")
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-a", "--assignments", "-c", "--classifications", required=True, dest="classifications")
    p.add_argument("-o", "--output", default="-")
    taxonomy = p.add_mutually_exclusive_group()
    taxonomy.add_argument("-R", "--kraken-report", dest="report")
    taxonomy.add_argument("-d", "--kraken-db", dest="database")
    unordered(p)
    cram(p)
    compressed(p)
    p = add("filter", "keep or reject by taxon")
    p.add_argument("files", nargs="*", metavar="FILE", help="one or two inputs, standard input by default")
    p.add_argument("-i", "--input", nargs="+", default=[])
    p.add_argument("-o", "--output", nargs="+", default=["-"])
    p.add_argument("-R", "--kraken-report", dest="report")
    p.add_argument("-m", "--metrics")
    p.add_argument("-t", "--taxon-id", "--taxon-ids", type=int, nargs="+", action="extend", required=True, dest="taxon_ids")
    p.add_argument("-r", "--rejects", nargs="+", default=[])
    p.add_argument("-c", "--classifications")
    for short, flag in (("-a", "allow-ancestors"), ("-d", "include-descendants"), ("-u", "include-unclassified")):
        p.add_argument(short, f"--{flag}", action="store_true")
    for flag in ("keep-unannotated", "per-record"):
        p.add_argument(f"--{flag}", action="store_true")
    for limit in ("max-edit-distance", "max-indels", "max-indel-length", "n-adjustment"):
        p.add_argument(f"--rescue-{limit}", type=int)
    unordered(p)
    cram(p)
    compressed(p)
    p = add("n2ref", "restore uncalled bases from a reference")
    p.add_argument("files", nargs="*", metavar="FILE", help="input and output, standard streams by default")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--reference", "-f", required=True)
    p.add_argument("-q", "--qual", "--quality", type=int, choices=range(94), metavar="0..93", dest="quality")
    compressed(p)
    p = add("report2tsv", "flatten a hierarchical report")
    p.add_argument("files", nargs="*", metavar="FILE", help="input and output, standard streams by default")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    return top


def _one(place: list[str], k: int, flag: str | None, name: str) -> str:
    """What stands at a place or after a flag, not both; a standard stream if neither."""
    if len(place) > k and flag is not None:
        raise ValueError(f"give {name} by its place or by --{name}, not both")
    return place[k] if len(place) > k else flag if flag is not None else "-"


def _arguments(argv: list[str] | None) -> dict:
    args = vars(_parser().parse_args(argv))
    command, place = args["command"], args.pop("files", [])
    for known in ("threads", "unordered", *(["cram_reference"] if command != "prep" else [])):
        args.pop(known, None)
    if command in ("prep", "filter"):
        if place and args["input"]:
            raise ValueError("give inputs by their place or by --input, not both")
        args["input"] = place or args["input"] or ["-"]
        if any(len(args.get(k, ())) > 2 for k in ("input", "rejects")):
            raise ValueError("one or two files go together")
    elif command in ("n2ref", "report2tsv"):
        if len(place) > 2:
            raise ValueError("an input and an output are all the files there are")
        args |= {name: _one(place, k, args[name], name) for k, name in enumerate(("input", "output"))}
    return args


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    try:
        args = _arguments(argv)
        spark = SparkSession.builder.appName("cladeframe").getOrCreate()
        command = args.pop("command")
        if command == "prep":
            commands.run_prep(spark, args["input"], args["output"], args["per_record"], args["cram_reference"])
        elif command == "filter":
            names = {f for f in commands.FilterOptions.__dataclass_fields__ if f != "limits"}
            options = commands.FilterOptions(**{k: v for k, v in args.items() if k in names})
            commands.run_filter(spark, args["input"], args["output"], options, args["rejects"], args["classifications"], args["report"], args["metrics"], args["level"])
        else:
            {"annotate": commands.run_annotate, "n2ref": commands.run_n2ref, "report2tsv": commands.run_report2tsv}[command](spark, **args)
    except Exception as problem:
        logging.getLogger("cladeframe").error("%s", problem)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
