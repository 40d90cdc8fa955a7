"""Packed and paged sources: zipped exports, workbooks, paged JSON, and a batch data source over them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideline.contracts import ContractError

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def zipped_lines(files: DataFrame, *, content: str = "content", name: str = "path") -> DataFrame:
    """(path, member, value): the text lines of every member of zip files held in a binary column; an archive that cannot be read fails. Archives are opened where they lie, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(blob.as_py())) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            while lines := f.readlines(1 << 22):
                                text = [x.decode("utf-8", "replace").rstrip("\r\n") for x in lines]
                                yield pa.RecordBatch.from_arrays([pa.array([path] * len(text)), pa.array([member] * len(text)), pa.array(text)], names=["path", "member", "value"])

    return files.where(F.col(content).isNotNull()).select(F.col(name).cast("string").alias("path"), content).mapInArrow(run, "path string, member string, value string")


def _cells(blob: bytes) -> list[tuple[int, int, str]]:
    """(row, column, text) of the cells of a workbook's first sheet, counted from 1."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        first = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for cell in ElementTree.fromstring(z.read(first)).iter(f"{_SHEET}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            value = cell.find(f"{_SHEET}v")
            inline = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            text = inline if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
            if text is not None:
                out.append((int(row), column, text))
    return out


def workbook_cells(files: DataFrame, *, content: str = "content", name: str = "path") -> DataFrame:
    """(path, row, col, value): the filled cells of each workbook's first sheet, values as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, cols, texts = zip(*_cells(blob.as_py())) if blob.is_valid else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(texts, pa.string())], names=["path", "row", "col", "value"])

    return files.select(F.col(name).cast("string").alias("path"), content).mapInArrow(run, "path string, row int, col int, value string")


def labelled_row(cells: DataFrame, pattern: str, *, header_row: int = 4, delay_days: int = 14) -> DataFrame:
    """(path, period, value, known_at) of the one row of each workbook whose first cell matches the pattern, by the headers yyyy-Mmm or yyyy-Qq; none or several such rows fail. A value is public delay_days after its period's end."""
    hits = cells.where((F.col("col") == 1) & (F.col("row") > header_row) & F.col("value").rlike(pattern)).groupBy("path").agg(F.count("*").alias("n"), F.min("row").alias("hit"))
    one = hits.select("path", F.when(F.col("n") == 1, F.col("hit")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" rows match in "), F.col("path")))).alias("hit"))
    heads = cells.where(F.col("row") == header_row).select("path", "col", F.col("value").alias("head"))
    values = cells.join(one, "path").where((F.col("row") == F.col("hit")) & (F.col("col") > 1)).select("path", "col", F.col("value").try_cast("double").alias("value"))
    part = lambda p: F.nullif(F.regexp_extract("head", p, 1), F.lit("")).try_cast("int")
    year, month, quarter = part(r"^(\d{4})-"), part(r"-[MМ](\d{1,2})$"), part(r"-Q([1-4])$")
    end = F.last_day(F.make_date(year, F.coalesce(month, quarter * 3), F.lit(1)))
    joined = values.join(heads, ["path", "col"]).select("path", end.alias("period"), "value").where("period is not null and value is not null")
    return joined.withColumn("known_at", F.date_add("period", delay_days))


def pages(fetch: Callable[[int], str], *, block: str, size_of: Callable[[str], int] | None = None, most: int = 10_000) -> list[str]:
    """The payloads of a paged JSON endpoint, page after page from row 0 until one comes back empty; `fetch` takes the first row's number. Fails if a page repeats or there are more than `most`."""
    count = size_of or (lambda text: len(json.loads(text)[block]["data"]))
    out, start = [], 0
    while True:
        text = fetch(start)
        n = count(text)
        if not n:
            return out
        if out and text == out[-1]:
            raise ContractError(f"page at {start} repeats the one before")
        out.append(text)
        start += n
        if len(out) > most:
            raise ContractError(f"more than {most} pages")


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class PagedJson(DataSource):
    """spark.read.format('paged_json').option('block', ...).load(folder): one partition a page file, rows (page, position, columns, data) of the block; register with `register`."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page string, position int, columns array<string>, data array<string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.block = options["path"], options.get("block", "history")

    def partitions(self) -> list[_Page]:
        from pathlib import Path

        return [_Page(str(p)) for p in sorted(Path(self.folder.removeprefix("file:")).glob("*.json"))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            block = json.load(f)[self.block]
        for i, row in enumerate(block["data"]):
            yield partition.value.rsplit("/", 1)[-1], i, block["columns"], [None if v is None else str(v) for v in row]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
