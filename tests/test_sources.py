"""Readers on files that the tests write."""

import io
import struct
import zipfile

from folia.sources import mail, msg, sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(**targets):
    rows = "".join(f'<Relationship Id="{k}" Type="{REL}/{t[0]}" Target="{t[1]}"/>' for k, t in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def chart(*series):
    def points(tag, values):
        return f"<c:{tag}><c:strRef><c:strCache>" + "".join(f'<c:pt idx="{k}"><c:v>{v}</c:v></c:pt>' for k, v in enumerate(values)) + f"</c:strCache></c:strRef></c:{tag}>"

    body = "".join(f"<c:ser><c:tx><c:strRef><c:strCache><c:pt idx='0'><c:v>{n}</c:v></c:pt></c:strCache></c:strRef></c:tx>{points('cat', c)}{points('val', v)}</c:ser>" for n, c, v in series)
    return f'<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:chart><c:plotArea><c:barChart>{body}</c:barChart></c:plotArea></c:chart></c:chartSpace>'


def workbook(sheet, *charts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(rId1=("worksheet", "worksheets/sheet1.xml")))
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>a|b</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}>{sheet}</worksheet>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rels(rId1=("drawing", "../drawings/drawing1.xml")))
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", rels(**{f"rId{k}": ("chart", f"../charts/chart{k}.xml") for k in range(len(charts))}))
        for k, c in enumerate(charts):
            z.writestr(f"xl/charts/chart{k}.xml", c)
    return out.getvalue()


def test_workbook():
    sheet = (
        '<sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="B3"><v>3</v></c><c r="C3" s="1"><v>45292</v></c></row>'
        '<row><c r="B4"><v>1.5</v></c></row></sheetData><mergeCells><mergeCell ref="B4:C4"/></mergeCells>'
    )
    got = sheets.workbook_markdown(workbook(sheet, chart(("S", "xy", "12"), ("T", "xy", "34")), chart(("U", "x", "1"), ("V", "y", "2"))))
    assert got.startswith("## Sheet: One\n\n| a\\|b | two runs |\n| --- | --- |\n| 3 | 2024-01-01 |\n| 1.5 | 1.5 |")
    assert "| Category | S | T |\n| --- | --- | --- |\n| x | 1 | 3 |\n| y | 2 | 4 |" in got and got.count("### Chart") == 2
    assert sheets.cell_range("[1]S!A1") is None and sheets.cell_range("S!$B$2:$C$4") == (2, 2, 4, 3) and sheets.column_number("AA") == 27


def test_charts():
    body = '<c:{k}Chart><c:ser><c:tx><c:v>{n}</c:v></c:tx><c:val><c:numRef><c:f>{f}</c:f><c:numCache>{p}</c:numCache></c:numRef></c:val></c:ser></c:{k}Chart>'
    whole = '<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><c:chart>{}<c:plotArea>{}</c:plotArea></c:chart></c:chartSpace>'
    title = "<c:title><c:tx><c:rich><a:p><a:r><a:t>Sales</a:t></a:r></a:p></c:rich></c:tx></c:title>"
    unit = "<c:valAx><c:title><c:tx><c:rich><a:p><a:r><a:t>USD</a:t></a:r></a:p></c:rich></c:tx></c:title></c:valAx>"
    points = '<c:pt idx="0"><c:v>1</c:v></c:pt><c:pt idx="1"><c:v>2</c:v></c:pt>'
    made = lambda head, parts: sheets.chart_markdown(sheets.ElementTree.fromstring(whole.format(head, parts)))
    one = made(title, body.format(k="line", n="Revenue", f="S!$B$2:$B$3", p=points) + unit)
    assert one == "### Chart (line): Sales — source: S!$B$2:$B$3\n\n| Revenue (USD) |\n| --- |\n| 1 |\n| 2 |"
    assert made("", body.format(k="pie", n="In USD", f="[1]S!A1", p=points) + unit) == "### Chart (pie): (untitled) — source: [1]S!A1\n\n**Series: In USD** _(external reference)_"
    assert made("", "<c:barChart/>") == "### Chart (bar): (untitled)\n\n_(no series)_"
    assert sheets.workbook_markdown(workbook("<sheetData/>")) == "## Sheet: One\n\n_(empty sheet)_"
    assert [sheets.sheet_class(*x) for x in (({}, []), ({}, [1]), ({1: 1}, [1]), ({1: 1}, []))] == ["empty", "chart", "mixed", "data"]


def test_broken_files(spark, tmp_path):
    """A folder with a broken file of each kind is read whole."""
    files = {
        "a.txt": b"caf\xe9 \xff", "b.md": b"\xc3", "c.html": b"<p>x\xff", "d.csv": b"a,b\n\xff,1\n", "e.eml": b"\xff\xfe no mail", "f.msg": b"no compound file", "g.xlsx": b"PK no zip",
        "h.rtf": b"{\\rtf1 x}", "i.xls": b"\xd0\xcf", "j.ods": b"PK", "k.pdf": b"%PDF",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r for r in mail.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == set(files) - {"k.pdf"} and got["a.txt"].text == "caf\ufffd \ufffd" and got["b.md"].text == "\ufffd" and got["c.html"].text == "x\ufffd"
    assert "\ufffd" in got["d.csv"].text and got["e.eml"].error is None
    for name in ("f.msg", "g.xlsx", "h.rtf", "i.xls", "j.ods"):
        assert got[name].text is None and got[name].error
    assert "converter" in got["h.rtf"].error and "converter" in got["i.xls"].error
    from folia.operators import document

    raw = document.response(document.raw_documents(mail.read_files(spark, str(tmp_path)).where("path like '%a.txt'"))).first().json
    assert '"modality":"deterministic"' in raw and '"total_pages":1' in raw and "metadata" not in raw


def test_csv():
    assert mail.csv_markdown(b'a,b\n"x|y","1\n2"\nz\n') == "| a | b |\n| --- | --- |\n| x\\|y | 1 2 |\n| z |  |"
    assert mail.csv_markdown(b"h\n1\n2\n3\n", 2) == "| h |\n| --- |\n| 1 |" and mail.csv_markdown(b"") == ""


def test_eml():
    raw = (
        b"Subject: Hi\r\nFrom: a@b\r\nTo: c@d\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        b"<p>Body <b>here</b></p>\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=f.pdf\r\n\r\nx\r\n--x--\r\n"
    )
    assert mail.eml_markdown(raw) == "**Subject:** Hi\n**From:** a@b\n**To:** c@d\n**Attachments:** f.pdf\n\nBody **here**"


def props(**values):
    rows = b"".join(struct.pack("<HHI", 0x0003 if k != "t" else 0x0040, p, 0) + struct.pack("<Q", v) for k, (p, v) in values.items())
    return b"\0" * 32 + rows


def test_message():
    streams = {
        "__substg1.0_0037001F": "Sübject\0".encode("utf-16-le"), "__substg1.0_0C1A001E": "M\xfcller".encode("cp1252"), "__substg1.0_1000001F": "Body".encode("utf-16-le"),
        "__properties_version1.0": props(a=(msg.MESSAGE_PAGE, 1252), t=(msg.SUBMITTED, 133485408000000000)),
        "__attach_version1.0_#00000000/__substg1.0_3707001F": "long name.pdf".encode("utf-16-le"), "__recip_version1.0_#0/__substg1.0_3001001F": b"x\0",
    }
    assert msg.Message(streams).markdown() == "**Subject:** Sübject\n**From:** Müller\n**Date:** 2024-01-01T00:00:00\n**Attachments:** long name.pdf\n\nBody"
    assert msg.filetime(0) is None and msg.stream_id("__substg1.0_0037001F") == (0x37, 0x1F) and msg.stream_id("x") is None


def compound(name, data):
    """A compound file with one stream of 4096 bytes or more."""
    sectors = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
    fat = [0xFFFFFFFD, msg.END, *[k + 3 for k in range(len(sectors) - 1)], msg.END]
    fat += [msg.FREE] * (128 - len(fat))

    def entry(n, kind, child, start, size):
        e = n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(n) + 2, kind, 1) + struct.pack("<III", msg.FREE, msg.FREE, child)
        return (e.ljust(116, b"\0") + struct.pack("<IQ", start, size)).ljust(128, b"\0")

    folder = (entry("Root Entry", 5, 1, msg.END, 0) + entry(name, 2, msg.FREE, 2, len(data))).ljust(512, b"\0")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<III", 0, 1, 1)
    head += struct.pack("<IIIIII", 0, 4096, msg.END, 0, msg.END, 0) + struct.pack("<109I", 0, *[msg.FREE] * 108)
    return head + struct.pack("<128I", *fat) + folder + b"".join(sectors)


def test_compound_file():
    body = ("Long body. " * 400).encode("utf-16-le")
    assert msg.msg_markdown(compound("__substg1.0_1000001F", body)).startswith("Long body. Long body.")


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain ü")
    (tmp_path / "b.html").write_text("<h1>T</h1>")
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.md").write_text("x" * 200)
    got = {r.path.rpartition("/")[2]: r for r in mail.read_files(spark, str(tmp_path), most=100).collect()}
    assert got["a.txt"].text == "plain ü" and got["b.html"].text == "# T" and got["c.xlsx"].error.startswith("BadZipFile")
    assert got["e.md"].error == "over the size limit" and set(got) == {"a.txt", "b.html", "c.xlsx", "e.md"}
    assert len(got["a.txt"].doc_id) == 16


def test_pictures(spark, tmp_path):
    def book(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="A" sheetId="1" r:id="rId1"/><sheet name="B" sheetId="2" r:id="rId2"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", rels(rId1=("worksheet", "worksheets/sheet1.xml"), rId2=("worksheet", "worksheets/sheet2.xml")))
            for k in (1, 2):
                z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}><sheetData/></worksheet>")
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", rels(rId1=("drawing", f"../drawings/drawing{k}.xml")))
                z.writestr(f"xl/drawings/drawing{k}.xml", "<x/>")
                z.writestr(f"xl/drawings/_rels/drawing{k}.xml.rels", rels(**{f"rId{j}": ("image", f"../media/image{j}.png") for j in range(n)}))
            for j in range(n):
                z.writestr(f"xl/media/image{j}.png", f"picture {j}")
        return out.getvalue()

    assert sheets.pictures(book(2)) == [("A", 1, b"picture 0"), ("A", 2, b"picture 1")] and len(sheets.pictures(book(25))) == 20
    (tmp_path / "a.xlsx").write_bytes(book(1))
    (tmp_path / "b.xlsm").write_bytes(b"broken")
    got = mail.workbook_pictures(spark, str(tmp_path)).collect()
    assert [(r.figure_id, r.sheet, bytes(r.content)) for r in got] == [(f"{got[0].doc_id}_embedded_f1", "A", b"picture 0")]
