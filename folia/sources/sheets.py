"""Workbooks (.xlsx) by the standard library: cells, merged ranges, and charts as tables."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

ROWS, COLUMNS, UNZIPPED = 10_000, 256, 512 << 20
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
TEXT = "{http://schemas.openxmlformats.org/drawingml/2006/main}t"
#: Number formats that are dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def cell_range(ref: str) -> tuple[int, int, int, int] | None:
    """(first row, first column, last row, last column) of A1:B2; None for a reference to another workbook."""
    if "[" in ref:
        return None
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?", ref.rpartition("!")[2])
    if not m:
        return None
    a, b = column_number(m[1]), int(m[2])
    return b, a, int(m[4] or b), column_number(m[3]) if m[3] else a


def shown(v, is_date: bool) -> str:
    """A number without a needless .0, a date as ISO."""
    if isinstance(v, float):
        if is_date:
            when = dt.datetime(1899, 12, 30) + dt.timedelta(days=v)
            return when.date().isoformat() if when.time() == dt.time() else when.isoformat(sep=" ", timespec="seconds")
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    return "" if v is None else str(v)


class Workbook:
    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        if sum(i.file_size for i in self.zip.infolist()) > UNZIPPED:
            raise ValueError("the workbook unpacks to more than the limit")
        names = set(self.zip.namelist())
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            self.shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")]
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            root = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
            styles = root.find(f"{MAIN}cellXfs")
            for x in styles if styles is not None else ():
                k = int(x.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, ""))
                self.dates.append(k in DATE_FORMATS or bool(re.search("[dmyhs]", code, re.I)))
        links = self._links("xl/workbook.xml")
        self.sheets = {s.get("name"): links[s.get(LINK)] for s in self._xml("xl/workbook.xml").iter(f"{MAIN}sheet")}

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _links(self, name: str, kind: str = "") -> dict[str, str]:
        folder, _, file = name.rpartition("/")
        rels = f"{folder}/_rels/{file}.rels"
        if rels not in self.zip.namelist():
            return {}
        out = {}
        for r in self._xml(rels):
            if r.get("Type", "").endswith(kind):
                parts = [] if r.get("Target").startswith("/") else folder.split("/")
                for p in r.get("Target").strip("/").split("/"):
                    parts = parts[:-1] if p == ".." else [*parts, p]
                out[r.get("Id")] = "/".join(parts)
        return out

    def cells(self, sheet: str) -> dict[tuple[int, int], str]:
        """Texts of the cells that are not blank; merged cells all have their first one's."""
        root, out = self._xml(self.sheets[sheet]), {}
        for c in root.iter(f"{MAIN}c"):
            v, kind = c.find(f"{MAIN}v"), c.get("t", "n")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                text = self.shared[int(v.text)]
            elif kind == "n":
                style = int(c.get("s", 0))
                text = shown(float(v.text), style < len(self.dates) and self.dates[style])
            else:
                text = {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text
            if text.strip() and (at := cell_range(c.get("r", ""))):
                out[at[0], at[1]] = text
        for m in root.iter(f"{MAIN}mergeCell"):
            at = cell_range(m.get("ref", ""))
            if at and (at[0], at[1]) in out:  # of a larger range what a table can show
                out |= {(r, c): out[at[0], at[1]] for r in range(at[0], min(at[2], at[0] + ROWS) + 1) for c in range(at[1], min(at[3], at[1] + COLUMNS) + 1)}
        return out

    def charts(self, sheet: str) -> list[ElementTree.Element]:
        drawings = self._links(self.sheets[sheet], "/drawing").values()
        return [self._xml(c) for d in drawings for c in self._links(d, "/chart").values()]


def data_rows(cells: dict[tuple[int, int], str]) -> list[list[str]]:
    """The used range, clamped to a header and ROWS rows, and to COLUMNS columns."""
    if not cells:
        return []
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    bottom, right = min(max(r for r, _ in cells), top + ROWS), min(max(c for _, c in cells), left + COLUMNS - 1)
    return [[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]


def _points(ref: ElementTree.Element | None) -> list[str]:
    if ref is None:
        return []
    found = {int(p.get("idx")): (p.findtext(f"{CHART}v") or "") for p in ref.iter(f"{CHART}pt")}
    return [found.get(k, "") for k in range(max(found, default=-1) + 1)]


def _title(e: ElementTree.Element | None) -> str:
    return "" if e is None else "".join(t.text or "" for t in e.iter(TEXT)).strip() or (e.findtext(f".//{CHART}v") or "")


#: Elements of a chart's plot and what the chart is called by them.
KINDS = {
    "barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "line3DChart": "line", "pieChart": "pie", "pie3DChart": "pie", "areaChart": "area", "area3DChart": "area",
    "doughnutChart": "doughnut", "scatterChart": "scatter", "radarChart": "radar", "bubbleChart": "bubble", "surfaceChart": "surface", "stockChart": "stock",
}


class Series:
    """A series of a chart: its name, values, categories and where its values come from."""

    def __init__(self, s: ElementTree.Element, nth: int):
        part = lambda *names: next((e for e in (s.find(f"{CHART}{n}") for n in names) if e is not None), None)
        values = part("val", "yVal")
        self.name = _title(part("tx")) or f"Series {nth}"
        self.source = None if values is None else values.findtext(f".//{CHART}f")
        self.external = bool(self.source and "[" in self.source)
        self.values = [] if self.external else _points(values)[:ROWS]
        self.categories = _points(part("cat", "xVal"))[:ROWS]

    def header(self, unit: str) -> str:
        return self.name if not unit or unit.lower() in self.name.lower() else f"{self.name} ({unit})"


def chart_markdown(root: ElementTree.Element) -> str:
    """A chart as its table: a heading with its kind, title and source, then series with the same categories as columns of one
    table, others each for itself. Axis titles name the categories and the values' unit."""
    from folia.sources.mail import grid

    title = _title(root.find(f".//{CHART}chart/{CHART}title")) or "(untitled)"
    kind = next((KINDS[e.tag.removeprefix(CHART)] for e in root.iter() if e.tag.removeprefix(CHART) in KINDS), "chart")
    axes = root.findall(f".//{CHART}catAx") + root.findall(f".//{CHART}dateAx")
    x, y = (_title(a[0].find(f"{CHART}title")) if a and kind not in ("pie", "doughnut") else "" for a in (axes, root.findall(f".//{CHART}valAx")))
    series = [Series(s, k) for k, s in enumerate(root.iter(f"{CHART}ser"), 1)]
    source = next((s.source for s in series if s.source), None)
    out = [f"### Chart ({kind}): {title}" + (f" — source: {source}" if source else "")]
    if not series:
        out.append("_(no series)_")
    elif all(s.values and s.categories for s in series) and len({tuple(s.categories) for s in series}) == 1:
        column = lambda s: [*s.values, *[""] * len(s.categories)][: len(s.categories)]
        rows = zip(series[0].categories, *map(column, series), strict=True)
        out.append(grid([[x or "Category", *(s.header(y) for s in series)], *map(list, rows)]))
    else:
        for s in series:
            if not s.values:
                out.append(f"**Series: {s.name}** _({'external reference' if s.external else 'no data'})_")
            elif len(s.categories) == len(s.values):
                out.append(grid([[x or "Category", s.header(y)], *map(list, zip(s.categories, s.values, strict=True))]))
            else:
                out.append(grid([[s.header(y)], *([v] for v in s.values)]))
    return "\n\n".join(out)


def sheet_class(cells: dict, charts: list) -> str:
    """empty, chart, mixed or data."""
    return {(False, False): "empty", (False, True): "chart", (True, True): "mixed"}.get((bool(cells), bool(charts)), "data")


def workbook_markdown(raw: bytes) -> str:
    """Each sheet under its heading: its cells as a table, then its charts; a sheet without either says that it is empty."""
    from folia.sources.mail import grid

    book, out = Workbook(raw), []
    for name in book.sheets:
        cells, charts = book.cells(name), book.charts(name)
        out.append(f"## Sheet: {name}")
        if sheet_class(cells, charts) == "empty":
            out.append("_(empty sheet)_")
        if cells:
            out.append(grid(data_rows(cells)))
        out += map(chart_markdown, charts)
    return "\n\n".join(out)


#: Fixed value: pictures of a workbook that are taken.
PICTURES = 20


def pictures(raw: bytes, most: int = PICTURES) -> list[tuple[str, int, bytes]]:
    """(sheet, index, content) of the pictures that a workbook's sheets show, in their order; a picture that several show counts once."""
    book, seen, out = Workbook(raw), set(), []
    for name, part in book.sheets.items():
        for drawing in book._links(part, "/drawing").values():
            for target in book._links(drawing, "/image").values():
                if target not in seen and target in book.zip.namelist() and len(out) < most:
                    seen.add(target)
                    out.append((name, len(out) + 1, book.zip.read(target)))
    return out
