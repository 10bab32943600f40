import io
import zipfile

from quarry.operators import chunking, traces
from quarry.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    return packed({"word/document.xml": f"<w:document {W}><w:body>{p('Hello')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>{p('Bye')}</w:body></w:document>"})


def xlsx(n):
    rows = "".join(f'<row><c t="inlineStr"><is><t>item number {i}</t></is></c><c><v>{i}</v></c></row>' for i in range(n))
    return packed({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Stock" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
    })


def test_office_formats():
    assert files.docx_text(docx()) == "Hello\n\nBye\n\na | b"
    text = files.xlsx_text(xlsx(40))
    assert all(g.startswith("[Sheet: Stock]\nitem number 0 | 0") for g in text.split("\n\n"))
    assert text.count("item number 39") == 1


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody", encoding="utf-8")
    (tmp_path / "blank.txt").write_text("  ")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "skip.html").write_text("x")
    (tmp_path / "d.DOCX").write_bytes(docx())
    (tmp_path / "p.png").write_bytes(b"img")
    rows = {r["source"]: r for r in files.loaded(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "bad.txt", "d.DOCX", "p.png"}
    assert rows["bad.txt"]["text"] is None and rows["bad.txt"]["error"]
    assert rows["p.png"]["error"]
    assert files.folder_stats(files.listed(spark, str(tmp_path))).first()["files"] == 5
    whole = files.whole_documents(files.loaded(spark, str(tmp_path)))
    assert chunking.chunked(whole).filter("source = 'a.md'").first()["text"] == "# T\nbody"


def test_csv_starts_with_a_byte_order_mark(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1, "名")], "id int, name string").coalesce(1), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfid")


def test_traces_skip_bad_lines_and_mask(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id":"1","ts":"2026-01-02 03:04:05","kind":"generation","status":"ok","duration_ms":5,"usage":{"input":3,"output":4},"input":"mail a@b.cn"}\nnot json\n{"id":"2","ts":"soon","kind":"span"}\n', encoding="utf-8")
    rows = traces.read_traces(spark, str(tmp_path / "t.jsonl"))
    assert sorted((r["id"], r["ts"] is None, r["output_tokens"]) for r in rows.collect()) == [("1", False, 4), ("2", True, 0)]
    traces.write_traces(rows, str(tmp_path / "out"))
    assert "[EMAIL]" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
