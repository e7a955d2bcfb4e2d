"""Command line: `python -m quillgrid.cli parse PAGES.json... --out DIR` and `languages`."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import settings as S


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgrid", description="Page JSON of a layout engine to Markdown")
    commands = top.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="write Markdown for page JSON files")
    parse.add_argument("paths", nargs="+")
    parse.add_argument("--out", help="folder for the Markdown; default: beside the first file")
    parse.add_argument("--output", choices=S.MODES, help="flowing text, page layout, or what suits the page")
    parse.add_argument("--settings", help="file of PARSE_... lines")
    commands.add_parser("languages", help="list the languages that are tried, in order")
    return top


def main(argv: list[str] | None = None) -> int:
    """0, or 1 with a message for what a user can mend."""
    args = parser().parse_args(argv)
    try:
        if args.command == "languages":
            print("\n".join(S.load().languages()))
            return 0
        settings = S.load(file=args.settings, output_mode=args.output)
        missing = [p for p in args.paths if "://" not in p and not Path(p).exists()]
        if missing:
            raise FileNotFoundError(f"no such file: {', '.join(missing)}")
        return _parse(args, settings)
    except (FileNotFoundError, RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _parse(args: argparse.Namespace, settings: S.Settings) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import documents as D
    from .operators import reports as R
    from .sources import pages as P

    spark = SparkSession.builder.getOrCreate()
    pages = P.read_page_json(spark, args.paths)
    bad = [r["path"] for r in pages.where("corrupt").select("path").limit(5).collect()]
    if bad:
        raise ValueError(f"not a page object: {', '.join(bad)}")
    blocks = P.page_blocks(pages).withColumnsRenamed({"path": "page", "content": "text"})
    docs = D.from_blocks(blocks).select(F.col("page").alias("doc_id"), D.markdown(settings.output_mode).alias("markdown"))
    out = S.output_dir(args.paths[0], args.out) / "markdown"
    R.write_markdown(docs, str(out))
    print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
