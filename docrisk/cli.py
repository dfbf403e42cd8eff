"""Command line: a folder, a file, JSON text or JSON on stdin; the report as a workbook, the run as JSON on stdout."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.operators import legacy, parsing, reports, rules
from docrisk.plans import sinks
from docrisk.session import build_session, ship_package
from docrisk.sources import files

SCHEMA = "doc_id long, text string, name string, filename string"


def fail(message: str) -> int:
    print(json.dumps({"success": False, "error": message}, ensure_ascii=False))
    return 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docrisk", description="Screen a collection of documents")
    p.add_argument("--file", "-f")
    p.add_argument("--folder", "-d")
    p.add_argument("--json", "-j")
    p.add_argument("--output", "-o")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--debug-dir")
    p.add_argument("--save-extracted-text", nargs="?", const="extraction_debug")
    p.add_argument("--console", action="store_true", help="totals and one line per document on stderr, too")
    p.add_argument("--pdf-list", metavar="JSON", help="write the texts of the folder's PDF files as a JSON list and stop")
    p.add_argument("--profile", choices=("current", "legacy"), default="current")
    p.add_argument("--as-of", default=date.today().strftime("%Y-%m"), help="the month that open ends run to, as YYYY-MM")
    a = p.parse_args(argv)
    text = a.json
    if text is None and not a.file and not a.folder:
        text = sys.stdin.read()
        if not text:
            p.print_help()
            return 0
    if text is not None:
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            return fail(f"invalid JSON: {e}")
    spark = ship_package(build_session())
    old = a.profile == "legacy"
    if a.pdf_list and a.folder:
        rows = files.pdf_list(spark, a.folder).persist()
        for r in rows.where(F.length(F.btrim("text")) < 50).select("name").toLocalIterator():
            print(f"little text in {r['name']}", file=sys.stderr)
        print(json.dumps({"success": True, "output": a.pdf_list, "count": sinks.json_list(rows, a.pdf_list)}, ensure_ascii=False))
        return 0
    if text is not None:
        given = files.json_elements(spark.createDataFrame([(text,)], "j string"), "j", [])
        docs = given.select((F.col("item_no") + 1).cast("long").alias("doc_id"), "text", "name", "filename")
    else:
        source = a.folder or a.file
        found = files.scan(spark, source, recursive=bool(a.folder) and not a.no_recursive, legacy=old) if a.folder else spark.read.format("binaryFile").load(source).withColumn("filename", F.substring_index("path", "/", -1))
        if found.isEmpty():
            return fail("no documents found")
        docs = files.documents(files.extract(found), skip_failed=old)
    output, debug = sinks.locations(a.output, a.folder, a.file, a.debug_dir or a.save_extracted_text)
    year, month = map(int, a.as_of.split("-"))
    if old:
        try:
            rows = legacy.screen(legacy.parse(docs)).persist()
            sinks.legacy_report(rows, output)
            listed = rows.select("doc_id", "name", "overall", "summary").orderBy("doc_id").toLocalIterator()
            details = [{"name": r["name"], "overall": lx.LEVELS[r["overall"]], "summary": r["summary"]} for r in listed]
        except Exception as e:  # the earlier profile reports every error in its JSON
            return fail(str(e))
        n = {x: sum(r["overall"] == x for r in details) for x in lx.LEVELS}
        print(json.dumps({"success": True, "output": output, "count": len(details), "high_risk": n["高"], "medium_risk": n["中"], "low_risk": n["低"], "details": details}, ensure_ascii=False))
        return 0
    parsed = parsing.parse(docs).persist()
    screened = rules.screen(parsed, (year, month)).persist()
    if debug:
        sinks.debug_files(parsed, debug)
    sinks.report(screened, output)
    print(json.dumps(sinks.run_json(screened, output, debug), ensure_ascii=False))
    print(reports.reply(screened, output, debug).first()["reply"], file=sys.stderr)
    if a.console:
        print("\n".join(sinks.console(screened)), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
