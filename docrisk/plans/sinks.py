"""Spreadsheets, debug files and the run's JSON. Workbooks and JSON are for result sets of bounded size."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.functions import text
from docrisk.operators import reports
from docrisk.operators.profile import FIELDS

MOST_ROWS = 100_000
# Sheets, headers and fills by level.
OVERVIEW = ("序号", "姓名", "文件名", "文本长度", "解析质量", "整体风险", "学历", "经历", "时间线", "薪资", "技能夸大", "表述模糊", "专业匹配", "风险点摘要")
DETAIL = ("序号", "姓名", "风险维度", "风险等级", "具体风险点", "触发原文")
LEGACY_OVERVIEW = ("序号", "姓名", "整体风险", "学历", "经历", "时间线", "薪资", "技能夸大", "表述模糊", "风险点摘要")
LEGACY_DETAIL = ("序号", "姓名", "风险维度", "风险等级", "具体风险点")
USAGE_NOTE = "本报告适合初筛排序和人工复核，不适合直接作为简历真实性结论。"
FILLS = {"低": "C6EFCE", "中": "FFEB9C", "高": "FFC7CE"}
HEADER_FILL = "4472C4"


def bounded(df: DataFrame, most: int = MOST_ROWS) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows don't go into a workbook; write the table instead")
    return rows


def _column(i: int) -> str:
    s = ""
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path: str, sheets: list[tuple[str, list[list]]]) -> str:
    """A workbook of (name, rows); first rows are styled as headers, level labels are filled, ``=`` begins a formula."""
    styles = {level: i + 2 for i, level in enumerate(FILLS)}
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in (HEADER_FILL, *FILLS.values()))
    style_xml = (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
        f'<fills count="{2 + 1 + len(FILLS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{2 + len(FILLS)}"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/>{"".join(f"<xf fillId={chr(34)}{i + 3}{chr(34)} applyFill={chr(34)}1{chr(34)}/>" for i in range(len(FILLS)))}</cellXfs></styleSheet>'
    )
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')  # fmt: skip
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
                   + f'<Relationship Id="r{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", style_xml)
        for i, (_, rows) in enumerate(sheets, 1):
            out = [f'<worksheet xmlns="{main}"><sheetData>']
            for r, row in enumerate(rows, 1):
                out.append(f'<row r="{r}">')
                for c, v in enumerate(row, 1):
                    if v is None or v == "":
                        continue
                    at, style = f"{_column(c)}{r}", f' s="{1 if r == 1 else styles.get(v, 0)}"'
                    if isinstance(v, (int, float)):
                        out.append(f'<c r="{at}"{style}><v>{v}</v></c>')
                    elif v.startswith("="):
                        out.append(f'<c r="{at}"{style}><f>{escape(v[1:])}</f></c>')
                    else:
                        clean = "".join(ch for ch in v if ch >= " " or ch in "\t\n")[:32767]
                        out.append(f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
                out.append("</row>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", "".join(out) + "</sheetData></worksheet>")
    return path


def report(screened: DataFrame, path: str) -> str:
    """The three sheets: overview, details, statistics with the shortlists below."""
    over = bounded(reports.overview(screened))
    seq = {r["doc_id"]: r["seq"] for r in over}
    keys = [k for k, _ in lx.DIMENSIONS]
    first = [list(OVERVIEW)] + [[r["seq"], r["name"], r["filename"], r["text_length"], r["quality"], r["overall"], *(r[k] for k in keys), r["summary"]] for r in sorted(over, key=lambda r: r["seq"])]
    found = sorted(bounded(reports.detail(screened)), key=lambda r: (r["doc_id"], r["dimension_no"]))
    second = [list(DETAIL)] + [[seq[r["doc_id"]], r["name"], r["dimension"], r["level"], r["flag"], r["evidence"]] for r in found]
    return write_xlsx(path, [("风险总览", first), ("详细分析", second), ("汇总统计", _summary_sheet([(r[1], r[5], r[-1]) for r in first[1:]]))])


def _summary_sheet(rows: list[tuple[str, str, str]]) -> list[list]:
    """Counts per level with their shares, and the shortlists below; ``rows`` are (name, level, summary)."""
    third: list[list] = [["简历风险评估汇总"], [], ["风险等级分布"], [], ["风险等级", "人数", "占比"]]
    third += [[x, sum(r[1] == x for r in rows), f"=B{6 + i}/SUM(B$6:B$8)"] for i, x in enumerate(reversed(lx.LEVELS))]
    third += [[], []]
    for title, level in (("高风险候选人", "高"), ("中风险候选人", "中")):
        listed = [r for r in rows if r[1] == level]
        if listed or level == "高":
            third += [[title], ["序号", "姓名", "主要风险点"]] + [[i, r[0], r[2][:60]] for i, r in enumerate(listed, 1)] + [[], []]
    return third


def legacy_report(screened: DataFrame, path: str) -> str:
    """The earlier profile's workbook: an overview of ten columns, details of five, the summary sheet."""
    six = [k for k, _ in lx.DIMENSIONS if k != "professional_match"]
    level = lambda n: lx.LEVELS[n]
    rows = sorted(bounded(screened.select("doc_id", "name", "overall", "levels", "findings", "summary")), key=lambda r: r["doc_id"])
    first = [list(LEGACY_OVERVIEW)] + [[i, r["name"], level(r["overall"]), *(level(r["levels"][k]) for k in six), r["summary"]] for i, r in enumerate(rows, 1)]
    second = [list(LEGACY_DETAIL)]
    for i, r in enumerate(rows, 1):
        second += [[i, r["name"], k, level(r["levels"][k]), f["flag"]] for k in six for f in r["findings"] if f["dimension"] == k]
    return write_xlsx(path, [("风险总览", first), ("详细分析", second), ("汇总统计", _summary_sheet([(r[1], r[2], r[-1]) for r in first[1:]]))])


def json_list(rows: DataFrame, path: str) -> int:
    """A JSON file with the list of (name, text) objects in the order given, one row at a time, so that nothing is held; the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in rows.select("name", "text").toLocalIterator():
            f.write((", " if n else "") + json.dumps({"name": r["name"], "text": r["text"]}, ensure_ascii=False))
            n += 1
        f.write("]")
    return n


def console(screened: DataFrame) -> list[str]:
    """The lines of a run on a terminal: totals, then one line per document."""
    t = reports.totals(screened).first()
    lines = [r["line"] for r in reports.digest(screened).orderBy("doc_id").toLocalIterator()]
    return ["=== 评估结果汇总 ===", f"总计: {t['n']} 份简历", f"高风险: {t['high']} | 中风险: {t['medium']} | 低风险: {t['low']}", "", "=== 详细结果 ===", *lines]


def profile_workbook(profiles: DataFrame, path: str) -> str:
    rows = sorted(bounded(profiles), key=lambda r: r["doc_id"])
    return write_xlsx(path, [("简历信息汇总", [list(FIELDS)] + [[r[c] for c in FIELDS] for r in rows])])


def debug_files(parsed: DataFrame, folder: str) -> None:
    """Per document its text and its sections, written by the tasks into a shared folder."""
    stem = text.safe_stem(F.coalesce(F.nullif("filename", F.lit("")), F.col("name")), F.concat(F.lit("document-"), F.col("doc_id").cast("string")))
    rows = reports.numbered(parsed, "doc_id").withColumn("_prefix", F.format_string("%03d-%s", "seq", stem))
    columns = ("education", "work_experience", "project_experience", "skills")

    def write(part) -> None:
        target = Path(folder)
        target.mkdir(parents=True, exist_ok=True)
        for r in part:
            (target / f"{r['_prefix']}.txt").write_text(r["raw_text"], encoding="utf-8")
            sections = {"name": r["name"], "filename": r["filename"], "text_length": len(r["raw_text"]), "parse_quality": r["parse_quality"].asDict(), "sections": {c: list(r[c]) for c in columns}}
            (target / f"{r['_prefix']}.sections.json").write_text(json.dumps(sections, ensure_ascii=False, indent=2), encoding="utf-8")

    rows.select("_prefix", "name", "filename", "raw_text", "parse_quality", *columns).foreachPartition(write)


def run_json(screened: DataFrame, output: str | None, debug_dir: str | None) -> dict:
    """The run's result as one object, its details in the order of the documents."""
    t = reports.totals(screened).first()
    stats = {r["part"]: json.loads(r["value"]) for r in reports.summary_stats(screened).collect()}
    stats["top_medium_candidates"] = [{"name": r["name"], "filename": r["filename"], "summary": r["summary"], "parse_quality": r["quality"]} for r in reports.top_medium(screened).collect()]
    stats |= {"output_files": {"report": output, "debug_dir": debug_dir}, "usage_note": USAGE_NOTE}
    rows = screened.select("doc_id", "name", "overall", "summary", F.col("parse_quality.quality").alias("quality")).orderBy("doc_id")
    details = [{"name": r["name"], "overall": lx.LEVELS[r["overall"]], "summary": r["summary"], "parse_quality": r["quality"]} for r in rows.toLocalIterator()]
    return {"success": True, "output": output, "count": t["n"], "high_risk": t["high"], "medium_risk": t["medium"], "low_risk": t["low"], "debug_dir": debug_dir, "summary_stats": stats, "details": details}


def locations(output: str | None, folder: str | None, file: str | None, debug: str | None) -> tuple[str, str | None]:
    """Report and debug paths; relative ones lie under the folder, the file's folder or the working directory."""
    base = Path(folder) if folder else Path(file).parent if file else None
    under = lambda p: str(Path(p) if base is None or Path(p).is_absolute() else base / p)
    return under(output or "resume_risk_report.xlsx"), under(debug) if debug else None
