"""Command line: convert, batch, images, paper-yml, bibtex, config."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from . import settings as S


def _titles(values: list[str] | None) -> tuple[str, ...]:
    """Repeated and comma-separated values, trimmed."""
    return tuple(t.strip() for v in values or [] for t in v.split(",") if t.strip())


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirework")
    p.add_argument("--profile", default="default")
    sub = p.add_subparsers(dest="verb", required=True)
    inputs = {"convert": "HTML files", "batch": "a file of inputs, one a line", "images": "HTML files", "paper-yml": "Atom answers (XML files)", "bibtex": "HTML files"}
    for name, help_ in inputs.items():
        v = sub.add_parser(name)
        v.add_argument("input", help=help_)
        v.add_argument("--output", default=None)
        if name in ("convert", "batch"):
            v.add_argument("--section", action="append")
            v.add_argument("--mode", choices=("include", "exclude"), default="exclude")
            v.add_argument("--anchors", action="store_true", default=None)
            v.add_argument("--json", choices=("none", "meta", "document", "full"), default="none")
        if name == "batch":
            v.add_argument("--parser", choices=("html", "latex"), default="html")
            v.add_argument("--fetcher", default=None, help="module:function that makes a fetcher")
            v.add_argument("--fail-fast", action="store_true")
            v.add_argument("--delay", type=float, default=0.0)
        if name == "bibtex":
            v.add_argument("--dois", default=None, help="records by DOI (Parquet: id, record)")
            v.add_argument("--arxiv", default=None, help="records by arXiv id (Parquet: id, record)")
    c = sub.add_parser("config")
    c.add_argument("action", choices=("show", "validate", "init", "get"))
    c.add_argument("key", nargs="?")
    return p


def _config(a: argparse.Namespace, conf: dict) -> int:
    if a.action == "init":
        path = a.key or "quirework.json"
        if os.path.exists(path):
            print(f"{path} exists", file=sys.stderr)
            return 1
        with open(path, "w") as f:
            json.dump(conf, f, indent=2)
        return 0
    value: object = conf
    for k in (a.key or "").split(".") if a.key else []:
        if not isinstance(value, dict) or k not in value:
            print(f"no setting {a.key!r}", file=sys.stderr)
            return 2
        value = value[k]
    print("valid" if a.action == "validate" else json.dumps(value, indent=2))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        conf = S.load(a.profile, options={"output": {"anchors": getattr(a, "anchors", None)}})
    except S.SettingsError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    if a.verb == "config":
        return _config(a, conf)
    from pyspark.sql import functions as F

    from .functions.session import local_session
    from .operators import citations, metadata
    from .plans import batch, pipeline
    from .sources import inputs, sinks

    spark = local_session()
    options = pipeline.Options(getattr(a, "mode", "exclude"), _titles(getattr(a, "section", None)), conf["output"]["anchors"], reference_titles=tuple(conf["sections"]["reference_titles"]))
    if a.verb == "batch":
        make = None
        if a.fetcher:
            module, _, function = a.fetcher.partition(":")
            make = getattr(importlib.import_module(module), function)
        lines = inputs.batch_lines(spark, a.input)
        http = conf["http"]
        documents, outcomes = batch.run_batch(lines, options, make, a.parser, tries=http["retries"] + 1, backoff_s=http["backoff_s"], partitions=conf["batch"]["concurrency"], delay_s=a.delay)
        if a.fail_fast:
            outcomes = batch.until_first_error(outcomes)
            documents = documents.join(outcomes.select(F.col("n").alias("doc_id")), "doc_id", "left_semi")
        if a.output:
            sinks.write_markdown(documents, a.output)
        outcomes.orderBy("n").show(truncate=False)
        counts = batch.report(outcomes)
        counts.show()
        return batch.exit_code(counts)
    if a.verb == "paper-yml":
        answers = spark.read.text(a.input, wholetext=True).select(metadata.atom_entry(F.col("value")).alias("e")).select("e.*").filter("arxiv_id is not null")
        records = metadata.paper_record(metadata.with_defaults(answers))
        if a.output:
            sinks.write_records(records, a.output)
        else:
            records.show(truncate=False)
        return 0
    pages = inputs.local_pages(spark, a.input).withColumnRenamed("path", "doc_id")
    if a.verb == "images":
        batch.images_only(pages).show(truncate=False)
    elif a.verb == "bibtex":
        kind = "id string, record struct<title:string,authors:array<string>,year:string,journal:string>"
        records = [spark.read.schema(kind).parquet(x) if x else spark.createDataFrame([], kind) for x in (a.dois, a.arxiv)]
        entries = citations.bibtex(citations.resolve(citations.from_pages(pages), *records), "doc_id")
        if a.output:
            sinks.write_bundle(a.output, bibtex=entries)
        else:
            entries.show(truncate=False)
    else:
        t = pipeline.convert(pages, options=options)
        md = pipeline.to_markdown(t)
        if a.output:
            sinks.write_markdown(md, a.output)
            sinks.write_svgs(pipeline.to_assets(t), a.output + "-images")
            if a.json != "none":
                sinks.write_bundle(a.output + "-bundle", json=pipeline.to_json(t, a.json))
        else:
            md.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
