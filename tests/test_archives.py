"""Zipped, paged and workbook sources, and the wide matrix."""

import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest

from tideline.contracts import ContractError
from tideline.sources import archives as A
from tideline.sources import files as S


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_zipped_lines(spark):
    rows = [("a.zip", zipped(one="x\ty\r\nz", two="")), ("b.zip", zipped(one="ü")), ("none", None)]
    got = {(x["path"], x["member"], x["value"]) for x in A.zipped_lines(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {("a.zip", "one", "x\ty"), ("a.zip", "one", "z"), ("b.zip", "one", "ü")}
    with pytest.raises(Exception, match="zip"):
        A.zipped_lines(spark.createDataFrame([("c", b"no archive")], "path string, content binary")).collect()


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(*labels):
    rows = ['<row r="4"><c r="A4" t="s"><v>0</v></c><c r="B4" t="inlineStr"><is><t>2025-M12</t></is></c><c r="C4" t="inlineStr"><is><t>2026-Q1</t></is></c><c r="AA4" t="inlineStr"><is><t>note</t></is></c></row>']
    for i, label in enumerate(labels):
        rows.append(f'<row r="{5 + i}"><c r="A{5 + i}" t="inlineStr"><is><t>{label}</t></is></c><c r="B{5 + i}"><v>{i}.5</v></c><c r="C{5 + i}"><v>n/a</v></c><c r="AA{5 + i}"><v>7</v></c></row>')
    return zipped(xl__worksheets__sheet1_xml=f"<worksheet {NS}><sheetData>{''.join(rows)}</sheetData></worksheet>", xl__sharedStrings_xml=f"<sst {NS}><si><t>Item</t></si></sst>")


def test_workbooks(spark):
    files = spark.createDataFrame([("w.xlsx", workbook("Imports", "Exports, total")), ("none.xlsx", None)], "path string, content binary")
    cells = A.workbook_cells(files)
    assert {(x["row"], x["col"], x["value"]) for x in cells.where("row = 4").collect()} == {(4, 1, "Item"), (4, 2, "2025-M12"), (4, 3, "2026-Q1"), (4, 27, "note")}
    (x,) = A.labelled_row(cells, "^Exports").collect()
    assert (x["period"], x["value"], x["known_at"]) == (dt.date(2025, 12, 31), 1.5, dt.date(2026, 1, 14))
    with pytest.raises(Exception, match="2 rows match"):
        A.labelled_row(cells, "ports").collect()
    assert A.labelled_row(cells, "nothing").count() == 0


def test_pages_and_data_source(spark, tmp_path):
    data = [[str(i), None] for i in range(5)]
    page = lambda start: json.dumps({"history": {"columns": ["ID", "X"], "data": data[start : start + 2]}})
    texts = A.pages(page, block="history")
    assert len(texts) == 3
    with pytest.raises(ContractError):
        A.pages(lambda start: page(0), block="history")
    for i, t in enumerate(texts):
        (tmp_path / f"p{i}.json").write_text(t)
    A.register(spark)
    got = spark.read.format("paged_json").option("block", "history").load(str(tmp_path)).orderBy("page", "position").collect()
    assert [(x["page"], x["data"][0], x["data"][1], x["columns"]) for x in got][-1] == ("p2.json", "4", None, ["ID", "X"])


def test_matrix_and_empty_columns(spark):
    d = dt.date(2026, 1, 1)
    rows = [("a", d, 1.0), ("b", d, 2.0), ("a", d + dt.timedelta(1), 3.0), ("b", d + dt.timedelta(2), 4.0), ("a", d + dt.timedelta(3), 0.0)]
    df = spark.createDataFrame(rows, "instrument_id string, trade_date date, close double")
    got = [(x["trade_date"].day, x["a"], x["b"], x["c"]) for x in S.price_matrix(df, target="a", instruments=["a", "b", "c"]).orderBy("trade_date").collect()]
    assert got == [(1, 1.0, 2.0, None), (2, 3.0, None, None)]
    wide = spark.createDataFrame([(1, None, 2.0)], "k int, extra__x double, extra__y double")
    assert S.drop_empty_columns(wide, "extra__").columns == ["k", "extra__y"] and S.drop_empty_columns(wide, "none").columns == wide.columns


def test_scans_are_kept_verified_and_written(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("k,v\n1,x\n")
    first = S.scan_once(spark, str(f), "k int, v string")
    assert S.scan_once(spark, str(f), "k int, v string") is first and first.count() == 1
    f.write_text("k,v\n1,x\n2,yy\n")
    assert S.scan_once(spark, str(f), "k int, v string").count() == 2
    digest = hashlib.sha256(f.read_bytes()).hexdigest()
    assert S.verified_csv(spark, str(f), "k int, v string", digest).count() == 2
    with pytest.raises(ContractError):
        S.verified_csv(spark, str(f), "k int, v string", "0" * 64)
    made = S.write_set({"folds": spark.range(3).toDF("fold"), "none": spark.range(0).toDF("x")}, str(tmp_path / "set"), {"folds": ["fold"]})
    assert made == {"folds": 3, "none": 0} and json.loads((tmp_path / "set/manifest.json").read_text()) == made
