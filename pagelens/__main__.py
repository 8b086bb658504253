"""`python -m pagelens COMMAND`: init, crawl, status, export, retry, archive, purge."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys

from pagelens import logs
from pagelens.config import Config, ConfigError, build, load, starter


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="write a first configuration").add_argument("path")
    crawl = sub.add_parser("crawl", help="run or resume a crawl over a snapshot")
    crawl.add_argument("snapshot")
    crawl.add_argument("--config")
    crawl.add_argument("--seed", action="append")
    crawl.add_argument("--out")
    crawl.add_argument("--set", action="append", default=[], metavar="KEY=JSON", help="a dotted key and its value")
    crawl.add_argument("--images-only", metavar="FILE")
    for flag in ("--dry-run", "--overwrite", "--friendly"):
        crawl.add_argument(flag, action="store_true")
    for name, what in (("status", "counts, top hosts and errors"), ("purge", "delete what runs have written")):
        sub.add_parser(name, help=what).add_argument("out")
    export = sub.add_parser("export", help="write the manifests again")
    export.add_argument("out")
    export.add_argument("--friendly", action="store_true")
    export.add_argument("--one-file", action="store_true", help="each manifest as one file, not a folder of parts")
    retry = sub.add_parser("retry", help="queue what failed and go on")
    retry.add_argument("out")
    retry.add_argument("snapshot")
    archive = sub.add_parser("archive", help="queue the rows of an archive index")
    archive.add_argument("out")
    archive.add_argument("index")
    archive.add_argument("domain")
    return p


def _stops():
    """Says whether the run should end. The first interrupt asks for it after the round that is under way, the second breaks off at once."""
    asked: list[int] = []

    def on_signal(number, frame) -> None:
        if asked:
            raise KeyboardInterrupt
        asked.append(number)
        print("stopping after this round; once more to break off", file=sys.stderr)

    signal.signal(signal.SIGINT, on_signal)
    return lambda: bool(asked)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        try:
            starter(args.path)
        except FileExistsError:
            print(f"{args.path} exists", file=sys.stderr)
            return 1
        return 0
    from pyspark.sql import SparkSession

    from pagelens.session import Session
    from pagelens.sources import readers
    from pagelens.state import Store

    spark = SparkSession.builder.appName("pagelens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "crawl":
            logs.setup(None if sys.stderr.isatty() else os.devnull)
            over = {k: json.loads(v) for k, _, v in (x.partition("=") for x in args.set)} | {"seeds": args.seed, "out": args.out}
            images = readers.url_list(spark, args.images_only) if args.images_only else None
            status, code = Session(spark, load(args.config, over)).crawl(readers.responses(spark, args.snapshot), dry_run=args.dry_run, overwrite=args.overwrite, images_only=images, friendly=args.friendly, stop=_stops())
            print(status)
            return code
        meta = Store(spark, args.out).meta()
        if not meta:
            raise ConfigError(f"{args.out} holds no run")
        session = Session(spark, build(Config, meta["config"] | {"out": args.out}).settle())
        if args.command == "status":
            print(json.dumps(session.status(), indent=1))
        elif args.command == "export":
            print("\n".join(session.export(args.friendly, args.one_file).values()))
        elif args.command == "purge":
            print("\n".join(session.purge()))
        elif args.command == "archive":
            print("added {}, skipped {}".format(*session.queue_archive(readers.cdx(spark, args.index), args.domain)))
        else:
            status, code = session.retry(readers.responses(spark, args.snapshot))
            print(status)
            return code
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
