"""Spreadsheet files (.xlsx) by the standard library: a reader, and a writer for the report.

Only what the engine needs of the format: inline and shared strings, numbers,
booleans; a frozen and filtered first row, column widths, one fill.  Runs on
the driver, over tables that are small by their nature.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Sequence
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

#: XML namespaces of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Fill of highlighted rows; least and most width of a column, cells looked at for it.
FILL, LEAST, MOST, LOOKED = "FFC6EFCE", 10, 48, 200


def _letter(index: int) -> str:
    out = ""
    while index >= 0:
        out, index = chr(65 + index % 26) + out, index // 26 - 1
    return out


def _cell(row: int, column: int, value: object, style: int) -> str:
    at = f'r="{_letter(column)}{row}"' + (f' s="{style}"' if style else "")
    if value is None or value != value:
        return f"<c {at}/>"
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf"):
        return f"<c {at}><v>{value!r}</v></c>"
    text = " || ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(columns: Sequence[str], rows: list[Sequence], marked: set[int]) -> str:
    widths = []
    for i, name in enumerate(columns):
        longest = max([len(str(name)), *(len(str(r[i])) for r in rows[: LOOKED - 1] if r[i] is not None)])
        widths.append(f'<col min="{i + 1}" max="{i + 1}" width="{min(MOST, max(LEAST, longest + 2))}" customWidth="1"/>')
    lines = [f'<row r="1">{"".join(_cell(1, i, c, 0) for i, c in enumerate(columns))}</row>']
    for n, row in enumerate(rows, 2):
        lines.append(f'<row r="{n}">{"".join(_cell(n, i, v, 1 if n - 2 in marked else 0) for i, v in enumerate(row))}</row>')
    last = f"{_letter(max(0, len(columns) - 1))}{len(rows) + 1}"
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0">'
        '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{"".join(widths)}</cols><sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>'
    )


def write(path: str | Path, sheets: dict[str, tuple[Sequence[str], list[Sequence]]], marked: dict[str, set[int]] | None = None) -> None:
    """Write sheets (name -> columns, rows) in order; ``marked`` names the rows, from 0, that are filled green."""
    marked = marked or {}
    names = list(sheets)
    style = (
        f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts>'
        f'<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{FILL}"/></patternFill></fill></fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>'
    )
    book = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    links += f'<Relationship Id="rId{len(names) + 1}" Type="{RELS}/styles" Target="styles.xml"/>'
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        )
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>{book}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", style)
        for i, name in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(*sheets[name], marked.get(name, set())))


def _column(reference: str) -> int:
    index = 0
    for c in re.match("[A-Z]+", reference)[0]:
        index = 26 * index + ord(c) - 64
    return index - 1


def read(path: str | Path, sheet: str | int = 0) -> tuple[list[str], list[list[str | None]]]:
    """(columns, rows) of a sheet, by name or position; every cell as text, empty ones None."""
    tag = lambda t: f"{{{MAIN}}}{t}"
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        found = [(s.get("name"), s.get(f"{{{RELS}}}id")) for s in book.iter(tag("sheet"))]
        names = [n for n, _ in found]
        if (isinstance(sheet, str) and sheet not in names) or (isinstance(sheet, int) and not 0 <= sheet < len(names)):
            raise ValueError(f"{path}: no sheet {sheet!r}; it has {names}")
        link = dict(found)[sheet] if isinstance(sheet, str) else found[sheet][1]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        target = targets[link].lstrip("/")
        grid = []
        for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(tag("row")):
            cells: dict[int, str] = {}
            for c in row.iter(tag("c")):
                value = c.findtext(tag("v"))
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(tag("t")))
                elif c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                if value not in (None, ""):
                    cells[_column(c.get("r"))] = value
            grid.append(cells)
    if not grid:
        return [], []
    width = max((max(c, default=-1) for c in grid), default=-1) + 1
    head = [grid[0].get(i) or f"column_{i}" for i in range(width)]
    return head, [[c.get(i) for i in range(width)] for c in grid[1:]]
