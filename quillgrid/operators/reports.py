"""Sinks: Markdown, search text, reports and error logs, and the manifest of what a run writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import Settings, output_plan

BOM = "﻿"


def write_markdown(docs: DataFrame, path: str) -> None:
    """(doc_id, markdown) as a table of (doc_id, file): each document's file as bytes, UTF-8 with a byte-order mark and a
    line end; raises for empty ones. One file for each task, not for each document; export() hands out single files."""
    text = T.strip(F.col("markdown"))
    checked = F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("empty markdown"))).otherwise(F.concat(F.lit(BOM), text, F.lit("\n")))
    docs.select("doc_id", F.encode(checked, "UTF-8").alias("file")).write.parquet(path)


def export(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, path) of (doc_id, file) rows written as folder/<doc_id>.md, for those who want single files on this
    machine."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            paths = []
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = Path(folder) / f"{str(doc_id).replace('/', '_')}.md"
                at.write_bytes(data.as_py())
                paths.append(str(at))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return files.select(F.col("doc_id").cast("string"), "file").mapInArrow(run, "doc_id string, path string")


def write_search_text(layers: DataFrame, path: str) -> None:
    """(doc_id, full_text) as Parquet, a line end behind each text."""
    layers.select("doc_id", F.concat("full_text", F.lit("\n")).alias("value")).write.parquet(path)


def report(name: str, *columns: str) -> Column:
    """A report row's JSON: the columns as fields, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name)


def write_reports(rows: DataFrame, path: str, kind: str) -> None:
    """(doc_id, report): JSON texts, in a folder for each kind."""
    rows.select("doc_id", "report").write.mode("overwrite").json(f"{path}/kind={kind}")


def error_rows(checks: DataFrame, prefix: str = "") -> DataFrame:
    """(doc_id, error_id, message): a row for each failed check of (doc_id, name, passed, detail)."""
    failed = checks.where(~F.coalesce(F.col("passed"), F.lit(False)))
    return failed.select("doc_id", F.concat(F.lit(prefix), "name").alias("error_id"), F.coalesce("detail", F.lit("")).alias("message"))


def append_errors(checks: DataFrame, path: str, prefix: str = "") -> None:
    """Adds error_rows to a log of JSON lines."""
    error_rows(checks, prefix).write.mode("append").json(path)


def manifest(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, output, path) of (doc_id, path): what a run writes for an input; PDFs only for images and if asked for."""
    plan = output_plan(settings)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    debug = settings.debug_output_dir.strip("/\\") or "ocr"
    name, folder = F.regexp_extract(stem, r"([^/]*)$", 1), F.regexp_extract(stem, r"^(.*/)?[^/]*$", 1)
    places = {"structural": F.concat(stem, F.lit("_structural.pdf")), "facsimile": F.concat(folder, F.lit(f"{debug}/"), name, F.lit("_facsimile.pdf")), "clean": F.concat(stem, F.lit("_clean.pdf"))}
    places |= {k: F.concat(folder, F.lit(f"{debug}/"), name, F.lit(f"_{k}.pdf")) for k in ("debug_overlay", "debug_search_layer")}
    from ..sources.pages import input_kind

    image = (input_kind(F.col("path")) == "image") & settings.write_pdf
    outputs = [F.struct(F.lit("markdown").alias("output"), F.concat(stem, F.lit(".md")).alias("p"))]
    outputs += [F.when(image, F.struct(F.lit(k).alias("output"), places[k].alias("p"))) for k, wanted in plan.items() if wanted]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*outputs))).alias("o")).select("doc_id", "o.output", F.col("o.p").alias("path"))


def hygiene_checks(files: DataFrame, emit_facsimile: bool) -> DataFrame:
    """(doc_id, name, passed, detail) of written files (doc_id, place: root or debug, name, bytes): Markdown and structural
    PDF exist and aren't empty; no test or facsimile PDFs where none belong. Documents without files have a row of nulls."""
    has = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    root, debug, pdf = F.col("place") == "root", F.col("place") == "debug", F.col("name").endswith(".pdf")
    checks = {
        "markdown_exists": has(root & F.col("name").endswith(".md") & (F.col("bytes") > 0)), "structural_pdf_exists": has(root & F.col("name").endswith("_structural.pdf") & (F.col("bytes") > 0)),
        "no_test_pdf_in_root": ~has(root & F.col("name").endswith("_test.pdf")), "no_facsimile_in_root": ~has(root & pdf & F.contains("name", F.lit("_facsimile"))),
    }
    if not emit_facsimile:
        checks["no_facsimile_in_ocr_by_default"] = ~has(debug & pdf & F.contains("name", F.lit("_facsimile")))
    rows = files.groupBy("doc_id").agg(*[v.alias(k) for k, v in checks.items()])
    return rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("passed"), F.lit("").alias("detail")) for k in checks])).alias("c")).select("doc_id", "c.*")


def distinct_paths(paths: Column) -> Column:
    """Paths in order, each once."""
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))
