"""Readers and writers: catalogue XML, JSON lines, CSV, chart pages, and steps that keep their results."""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import shared_folder

_CONTROL = re.compile(r"<(?:\w+:)?controlfield\b([^<>]*)>([^<]*)")
_DATA = re.compile(r"<(?:\w+:)?datafield\b([^<>]*)>")
_SUB = re.compile(r"<(?:\w+:)?subfield\b([^<>]*)>([^<]*)")
_DATA_END = re.compile(r"</(?:\w+:)?datafield\s*>")
_ATTRIBUTE = re.compile(r"""([\w:]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(r"&(#\d{1,7}|#x[0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);")


def recover_record(text: str) -> dict[str, list]:
    """The fields of a record with a syntax fault, as far as their tags can be read; stray & stays as it is."""
    plain = lambda x: _REFERENCE.sub(lambda m: html.unescape(m[0]), x)
    named = lambda x: {m[1]: plain(m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(x)}
    control = [{"_tag": named(m[1]).get("tag"), "_VALUE": plain(m[2])} for m in _CONTROL.finditer(text)]
    starts = list(_DATA.finditer(text))
    data = []
    for k, m in enumerate(starts):
        inside = _DATA_END.split(text[m.end() : starts[k + 1].start() if k + 1 < len(starts) else len(text)])[0]
        own = named(m[1])
        data.append({"_tag": own.get("tag"), "_ind1": own.get("ind1"), "_ind2": own.get("ind2"), "subfield": [{"_code": named(s[1]).get("code"), "_VALUE": plain(s[2])} for s in _SUB.finditer(inside)]})
    return {"controlfield": control, "datafield": data}


_NAMESPACE = re.compile(r"<(/?)[\w.-]+:")
_CATALOGUE = "controlfield array<struct<tag:string,text:string>>, datafield array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,text:string>>>>"


class _Columns:
    """Fields of many records as flat columns with list offsets."""

    def __init__(self) -> None:
        self.control: tuple[list, list] = [], []
        self.data: tuple[list, list, list] = [], [], []
        self.sub: tuple[list, list] = [], []
        self.control_ends, self.data_ends, self.sub_ends = [0], [0], [0]

    def add(self, control, data) -> None:
        """A record: (tag, text) of its control fields; (tag, ind1, ind2, subfields) of its data fields, each subfield (code, text)."""
        for f in control:
            for column, x in zip(self.control, f, strict=True):
                column.append(x)
        for *f, subs in data:
            for column, x in zip(self.data, f, strict=True):
                column.append(x)
            for s in subs:
                for column, x in zip(self.sub, s, strict=True):
                    column.append(x)
            self.sub_ends.append(len(self.sub[0]))
        self.control_ends.append(len(self.control[0]))
        self.data_ends.append(len(self.data[0]))

    def batch(self) -> pa.RecordBatch:
        text = lambda columns, names: pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names)
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        subs = lists(self.sub_ends, text(self.sub, ["code", "text"]))
        data = pa.StructArray.from_arrays([*(pa.array(c, pa.string()) for c in self.data), subs], ["tag", "ind1", "ind2", "subfield"])
        return pa.RecordBatch.from_arrays([lists(self.control_ends, text(self.control, ["tag", "text"])), lists(self.data_ends, data)], names=["controlfield", "datafield"])


def _parsed(text: str) -> tuple[list, list]:
    """Fields of a sound record; a syntax fault raises ``ParseError``."""
    root = ElementTree.fromstring(text)
    control, data = [], []
    value = lambda e: (e.text or "").strip() or None
    for e in root:
        if e.tag == "controlfield":
            control.append((e.get("tag"), value(e)))
        elif e.tag == "datafield":
            data.append((e.get("tag"), e.get("ind1"), e.get("ind2"), [(s.get("code"), value(s)) for s in e if s.tag == "subfield"]))
    return control, data


def read_catalogue(spark: SparkSession, path: str, *, row_tag: str = "record") -> DataFrame:
    """Catalogue records from XML, split by the end of ``row_tag``, in the shape of the nkc_records table.

    Files are cut anywhere and each task reads the records that begin in its part. Each record is parsed by itself, in Arrow batches,
    by the C parser. Prefixes of namespaces are ignored (with a prefix, ``row_tag`` has it too). A record with a syntax fault is kept, with
    the fields that ``recover_record`` reads. Texts come without outer white space, empty ones as null. A
    file that is named .gz but holds plain text must be read under another name first (``plain_copy``): the codec
    is chosen by the name.
    """
    begin = re.compile(rf"<{re.escape(row_tag)}[\s>]")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Columns()
            for text in batch.column(0).to_pylist():
                found = begin.search(text)
                if not found:
                    continue  # what stands after the last record
                record = text[found.start() :] + f"</{row_tag}>"
                plain = _NAMESPACE.sub(r"<\1", record)
                try:
                    out.add(*_parsed(plain))
                except (ElementTree.ParseError, ValueError):
                    fields = recover_record(record)
                    out.add([(f["_tag"], f["_VALUE"].strip() or None) for f in fields["controlfield"]], [(f["_tag"], f["_ind1"], f["_ind2"], [(x["_code"], x["_VALUE"].strip() or None) for x in f["subfield"]]) for f in fields["datafield"]])
            yield out.batch()

    rows = spark.read.option("lineSep", f"</{row_tag}>").text(path).mapInArrow(parse, _CATALOGUE)
    return rows.select(F.monotonically_increasing_id().alias("line_no"), "controlfield", "datafield")


def plain_copy(spark: SparkSession, path: str) -> str:
    """A copy of a plain file without the misleading .gz in its name, in the shared folder; the path itself if it is compressed or not so named."""
    if not path.endswith(".gz"):
        return path
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source = hadoop.Path(path)
    files = source.getFileSystem(conf)
    stream = files.open(source)
    head = [stream.read(), stream.read()]
    stream.close()
    if head == [0x1F, 0x8B]:
        return path
    target = hadoop.Path(f"{shared_folder(spark)}/plain-{uuid.uuid4().hex}/{source.getName().removesuffix('.gz')}")
    hadoop.FileUtil.copy(files, source, target.getFileSystem(conf), target, False, conf)
    return str(target)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, *, partitions: int | None = None) -> DataFrame:
    """JSON lines under a declared schema. A gzip file is one task: give ``partitions`` to spread its rows at once."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.repartition(partitions) if partitions else rows


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``line_no, json_text`` for the tolerant readers."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("json_text"))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, fill: bool = False) -> DataFrame:
    """CSV with a header under a declared schema; with ``fill`` missing text is an empty string."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.fillna("") if fill else rows


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header and a fixed order of columns."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def step(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force: bool = False) -> DataFrame:
    """The Parquet table at ``path``; built and written first if it is missing or ``force`` is set."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if force or not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _ChartPage(HTMLParser):
    """Headings and body rows of the first table of class ranking."""

    def __init__(self) -> None:
        super().__init__()
        self.inside = 0  # nesting of tables within the chart
        self.done = False
        self.headings: list[str] = []
        self.bodies: list[list[list[str]]] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.done:
            return
        if tag == "table":
            if self.inside or "ranking" in (dict(attrs).get("class") or "").split():
                self.inside += 1
            return
        if not self.inside:
            return
        if tag == "tbody":
            self.bodies.append([])
        elif tag == "tr" and self.bodies:
            self.bodies[-1].append([])
        elif tag == "h2" or (tag == "td" and self.bodies and self.bodies[-1]):
            self.text = []

    def handle_data(self, data: str) -> None:
        if self.text is not None and data.strip():
            self.text.append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if not self.inside:
            return
        if tag == "table":
            self.inside -= 1
            self.done = self.inside == 0
        elif tag in ("h2", "td") and self.text is not None:
            words = "".join(self.text)
            if tag == "h2":
                self.headings.append(words)
            else:
                self.bodies[-1][-1].append(words)
            self.text = None


def chart_entries(page: str) -> list[tuple[str, int, str, str, str, str]]:
    """(category, rank, isbn, author, title, publisher) of a chart page.

    The n-th heading names the n-th body; the rank is the row's place in its body, counting rows of fewer than
    four cells, which are left out themselves.
    """
    parser = _ChartPage()
    parser.feed(page)
    parser.close()
    return [(name, rank, *cells[:4]) for name, rows in zip(parser.headings, parser.bodies, strict=False) for rank, cells in enumerate(rows, 1) if len(cells) >= 4]


_TEXTS = ["isbn", "author", "title", "publisher"]
_ENTRY = T.StructType([T.StructField("category", T.StringType()), T.StructField("rank", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in _TEXTS]])


@F.pandas_udf(T.ArrayType(_ENTRY))
def _entries(pages: pd.Series) -> pd.Series:
    names = ["category", "rank", *_TEXTS]
    return pages.map(lambda p: [dict(zip(names, e, strict=True)) for e in chart_entries(p)] if p else [])


def chart_rows(pages: DataFrame) -> DataFrame:
    """Chart rows from saved pages (year, week, html); null and empty pages give none."""
    return pages.select("year", "week", F.explode(_entries("html")).alias("e")).select("year", "week", "e.*")
