"""Text of binary files, from bytes: (text, error). A bad file gives an empty text and its error, never a failed job."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """The body's paragraphs, one per line; tables, headers and footers aren't read."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out = []
    for p in body.findall(f"{W}p") if body is not None else []:
        out.append("".join({f"{W}t": n.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(n.tag, "") for n in p.iter()))
    return "\n".join(out)


def xlsx_text(data: bytes) -> str:
    """All rows of all sheets: values that aren't empty, zero or false, each followed by a blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        lines = []
        for name in sheets:
            for row in ElementTree.fromstring(z.read(name)).iter(f"{S}row"):
                cells = []
                for c in row.findall(f"{S}c"):
                    kind, v = c.get("t"), c.find(f"{S}v")
                    value = "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    if kind == "b":
                        value = "True" if value == "1" else ""
                    if value and not (kind in (None, "n") and float(value) == 0):
                        cells.append(value + " ")
                lines.append("".join(cells))
    return "".join(line + "\n" for line in lines)


def plain_text(data: bytes) -> str:
    for encoding in ("utf-8", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor GBK")


def _pdf_strings(content: bytes) -> str:
    out = []
    for m in re.finditer(rb"\((?:\\.|[^\\()])*\)|T\*|'|TD|Td|ET", content, re.S):
        t = m[0]
        if t[:1] == b"(":
            out.append(re.sub(rb"\\([nrtbf()\\])", lambda e: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e[1], e[1]), t[1:-1]).decode("latin-1"))
        else:
            out.append("\n")
    return "".join(out)


def pdf_candidates(data: bytes) -> list[str]:
    """Texts by every engine at hand, each failing on its own: two libraries if installed, then the small reader."""
    out = []
    for engine in (_pdf_plumber, _pdf_reader, _pdf_small):
        try:
            text = engine(data)
        except Exception:  # noqa: BLE001, S112  the other engines may still read it
            continue
        if text.strip():
            out.append(text)
    return out


def _pdf_plumber(data: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return "".join(t + "\n" for page in pdf.pages if (t := page.extract_text()))


def _pdf_reader(data: bytes) -> str:
    from PyPDF2 import PdfReader

    return "".join(t + "\n" for page in PdfReader(io.BytesIO(data)).pages if (t := page.extract_text()))


def _pdf_small(data: bytes) -> str:
    """Flate or plain content streams with simple strings; no font maps."""
    out = []
    for m in re.finditer(rb"<<(.{0,400}?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = zlib.decompress(m[2]) if b"FlateDecode" in m[1] else m[2]
        if b"BT" in body:
            out.append(_pdf_strings(body))
    return re.sub(r"\n{2,}", "\n", "\n".join(out)).strip("\n")


def extract(filename: str, data: bytes) -> tuple[list[str], str | None]:
    """Candidate texts of a file by its suffix, and an error if there is none."""
    suffix = filename[filename.rfind(".") :].lower() if "." in filename else ""
    try:
        if suffix == ".pdf":
            found = pdf_candidates(data)
            return found, None if found else "no engine could read the file"
        reader = docx_text if suffix in (".docx", ".doc") else xlsx_text if suffix in (".xlsx", ".xls") else plain_text
        return [reader(data)], None
    except Exception as e:  # noqa: BLE001
        return [], f"{type(e).__name__}: {e}"
