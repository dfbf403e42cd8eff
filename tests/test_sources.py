"""Folders, codecs, JSON, workbooks, debug files, command line and stream on files that the tests make."""

import io
import json
import zipfile

from docrisk import cli
from docrisk.operators import legacy, parsing, profile, rules
from docrisk.plans import sinks
from docrisk.sources import codecs, files
from docrisk.streaming import folder as stream

TEXT = "工作经历\n2018.01-2020.06 云上科技有限公司 数据开发工程师\n专业技能\n精通SQL\n教育背景\n2014.09-2018.06 青石大学 计算机 本科"
SCHEMA = "doc_id long, text string, name string, filename string"


def docx(*paragraphs):
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def make(folder):
    (folder / "sub").mkdir()
    (folder / "x_extraction_debug").mkdir()
    (folder / "岗位-周小舟.txt").write_text(TEXT, encoding="utf-8")
    (folder / "甲.txt").write_bytes(TEXT.encode("gbk"))
    (folder / "sub" / "乙.docx").write_bytes(docx(*TEXT.split("\n")))
    (folder / "sub" / "坏.docx").write_bytes(b"no zip")
    for skipped in ("~$锁.docx", "风险评估报告.xlsx", "x_extraction_debug/丙.txt", "图.png"):
        (folder / skipped).write_text("x")


def test_scan_and_extract(spark, tmp_path):
    make(tmp_path)
    rows = {r["filename"]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"岗位-周小舟.txt", "甲.txt", "乙.docx", "坏.docx"}
    assert rows["甲.txt"]["text"] == rows["乙.docx"]["text"] == TEXT and rows["坏.docx"]["text"] == "" and "BadZipFile" in rows["坏.docx"]["error"]
    assert files.scan(spark, str(tmp_path), recursive=False).count() == 2 and files.scan(spark, str(tmp_path / "none")).count() == 0
    docs = files.documents(files.extract(files.scan(spark, str(tmp_path)))).collect()
    assert sorted(r["doc_id"] for r in docs) == [1, 2, 3, 4] and {r["name"] for r in docs} == {"周小舟", "甲", "乙", "坏"}


def test_codecs(tmp_path):
    path = sinks.write_xlsx(str(tmp_path / "a.xlsx"), [("一", [["甲", 3, 0, None], ["=B1", "x<y"]]), ("二", [["乙"]])])
    with open(path, "rb") as f:
        assert codecs.xlsx_text(f.read()) == "甲 3 \nx<y \n乙 \n"
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 30 >>\nstream\nBT (Hello) Tj T* (World) Tj ET\nendstream\nendobj"
    assert codecs.extract("a.PDF", pdf)[0] == ["Hello\nWorld"] and codecs.extract("a.pdf", b"")[1] and codecs.extract("a.txt", b"\xff\xff\xff")[1]


def test_json(spark):
    cases = ['[{"text":null,"content":"x"},{"content":"y","name":"n"},"z",7]', '{"text":"w","filename":"f"}', "not json", None, "[]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k long, j string")
    rows = sorted((r["k"], r["item_no"], r["text"], r["name"]) for r in files.json_elements(df, "j", ["k"]).collect())
    assert [r[:3] for r in rows] == [(0, 0, ""), (0, 1, "y"), (0, 2, "z"), (0, 3, "7"), (1, 0, "w")] and rows[1][3] == "n"


def test_report_and_debug_files(spark, tmp_path):
    parsed = parsing.parse(spark.createDataFrame([(1, TEXT, "周小舟", "a/b:c.pdf"), (2, "短", None, None)], SCHEMA))
    screened = rules.screen(parsed)
    with open(sinks.report(screened, str(tmp_path / "r.xlsx")), "rb") as f:
        got = codecs.xlsx_text(f.read())
    assert "解析质量" in got and "文本长度" in got and "触发原文" in got and "周小舟" in got
    sinks.debug_files(parsed, str(tmp_path / "debug"))
    names = sorted(p.name for p in (tmp_path / "debug").iterdir())
    assert names[:2] == ["001-b_c.sections.json", "001-b_c.txt"] and len(names) == 4
    assert json.loads((tmp_path / "debug" / names[0]).read_text())["sections"]["skills"] == ["精通SQL"]
    assert sinks.run_json(screened, "o", None)["count"] == 2


def test_locations():
    assert sinks.locations("r.xlsx", "/d", None, "x") == ("/d/r.xlsx", "/d/x") and sinks.locations(None, None, "/e/f.pdf", None) == ("/e/resume_risk_report.xlsx", None)
    assert sinks.locations("/abs.xlsx", "/d", None, None) == ("/abs.xlsx", None) and sinks.locations(None, None, None, None)[0] == "resume_risk_report.xlsx"


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["--json", "{bad"]) == 1 and json.loads(capsys.readouterr().out)["success"] is False
    out = str(tmp_path / "r.xlsx")
    assert cli.main(["--json", json.dumps([{"text": TEXT, "name": "甲"}, {"content": "短"}]), "--output", out, "--as-of", "2025-06"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["success"] and got["count"] == 2 and got["details"][0]["name"] == "甲"
    (tmp_path / "in").mkdir()
    make(tmp_path / "in")
    assert cli.main(["--folder", str(tmp_path / "in"), "--profile", "legacy"]) == 0 and json.loads(capsys.readouterr().out)["count"] >= 1
    assert cli.main(["--folder", str(tmp_path / "none")]) == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(tmp_path / "in")
    q = stream.screen_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    rows = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(rows) == {"周小舟", "甲", "乙", "坏"} and rows["甲"]["overall"] == 0


def test_legacy_workbook_console_and_errors(spark, tmp_path, capsys):
    rows = legacy.screen(legacy.parse(spark.createDataFrame([(1, TEXT, "周小舟", "a.pdf"), (2, "短", None, None)], SCHEMA)))
    with open(sinks.legacy_report(rows, str(tmp_path / "l.xlsx")), "rb") as f:
        got = codecs.xlsx_text(f.read())
    assert "周小舟" in got and "风险点摘要" in got and "中风险候选人" in got and "触发原文" not in got
    screened = rules.screen(parsing.parse(spark.createDataFrame([(1, TEXT, "周小舟", "a.pdf"), (2, "短", None, None)], SCHEMA)))
    lines = sinks.console(screened)
    assert lines[1] == "总计: 2 份简历" and len(lines) == 7 and "周小舟" in lines[5]
    stats = sinks.run_json(screened, "o.xlsx", "dbg")["summary_stats"]
    assert stats["output_files"] == {"report": "o.xlsx", "debug_dir": "dbg"} and stats["usage_note"] and stats["top_medium_candidates"]
    assert cli.main(["--json", json.dumps([{"text": TEXT}]), "--profile", "legacy", "--output", str(tmp_path / "none" / "x.xlsx")]) == 1
    assert json.loads(capsys.readouterr().out)["success"] is False


def test_pdf_list_to_profiles(spark, tmp_path, capsys):
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 30 >>\nstream\nBT (Hello) Tj T* (World) Tj ET\nendstream\nendobj"
    (tmp_path / "sub").mkdir()
    for name in ("b.pdf", "a.PDF", "sub/c.pdf"):
        (tmp_path / name).write_bytes(pdf)
    (tmp_path / "d.txt").write_text(TEXT, encoding="utf-8")
    out = str(tmp_path / "list.json")
    assert cli.main(["--folder", str(tmp_path), "--pdf-list", out]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["count"] == 2 and "little text" in said.err
    assert json.loads((tmp_path / "list.json").read_text()) == [{"name": "a.PDF", "text": "Hello\nWorld"}, {"name": "b", "text": "Hello\nWorld"}]
    listed = files.json_list(spark, out).selectExpr("monotonically_increasing_id() + 1 AS doc_id", "text", "name", "name AS filename")
    path = sinks.profile_workbook(profile.extract(listed), str(tmp_path / "p.xlsx"))
    with open(path, "rb") as f:
        assert "姓名" in codecs.xlsx_text(f.read())
    empty = spark.createDataFrame([], "name string, text string")
    assert sinks.json_list(empty, out) == 0 and (tmp_path / "list.json").read_text() == "[]"
