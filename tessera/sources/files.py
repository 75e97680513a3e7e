"""Document files as rows: binary files read by Spark, decoded and rendered as text by their kind.

Every reader is a function of (path, content), so files are read in parallel by
``spark.read.format("binaryFile")``; one file is one row.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of each kind that can be read here.
KINDS = {"txt": "text", "text": "text", "md": "text", "hl7": "text", "csv": "csv", "tsv": "csv", "xml": "xml", "cda": "xml", "json": "json", "fhir": "json", "docx": "docx", "xlsx": "xlsx"}
#: Kinds known but read elsewhere (page geometry and optical recognition are no part of this library).
ELSEWHERE = ["pdf", "doc", "png", "jpg", "jpeg", "tif", "tiff", "bmp"]
ENCODINGS = ("utf-8-sig", "utf-16", "cp1252", "latin-1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def supported(path: Column) -> Column:
    return suffix(path).isin([*KINDS, *ELSEWHERE])


def decode(content: bytes) -> str:
    """The first encoding that fits; UTF-16 only with its byte order mark."""
    for name in ENCODINGS:
        if name == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def flatten_json(value, path: str = "") -> list[str]:
    """Lines 'a.b[0]: value'; nulls are left out."""
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in flatten_json(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [line for i, v in enumerate(value) for line in flatten_json(v, f"{path}[{i}]")]
    return [] if value is None else [f"{path}: {value}"]


def render_csv(text: str) -> str:
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = csv.reader(io.StringIO(text), dialect)
    return "\n".join(" | ".join(cell.strip() for cell in row) for row in rows if any(cell.strip() for cell in row))


def render_xml(text: str) -> str:
    lines = []
    for element in ElementTree.fromstring(text).iter():
        if element.text and element.text.strip():
            lines.append(f"{element.tag.rsplit('}', 1)[-1]}: {element.text.strip()}")
    return "\n".join(lines)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def render_docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(line for line in lines if line.strip())


def render_xlsx(content: bytes) -> str:
    """Every sheet's rows as 'a | b'; blank rows are dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        lines = []
        for name in sorted((n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n)):
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
    return "\n".join(lines)


def render(path: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file."""
    kind = KINDS.get(path.rsplit(".", 1)[-1].lower())
    try:
        if kind is None:
            return None, "unsupported"
        if kind == "docx":
            return render_docx(content), None
        if kind == "xlsx":
            return render_xlsx(content), None
        text = decode(content).replace("\r\n", "\n").replace("\r", "\n")
        if kind == "csv":
            return render_csv(text), None
        if kind == "xml":
            return render_xml(text), None
        if kind == "json":
            return "\n".join(flatten_json(json.loads(text))), None
        return text, None
    except Exception as error:  # noqa: BLE001  a broken file is a row with its error
        return None, f"{type(error).__name__}: {error}"[:200]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def rendered(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([render(p, bytes(c)) for p, c in zip(paths, contents, strict=True)], columns=["text", "error"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, file_hash, kind, text, error of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    out = files.select("path", F.sha2("content", 256).alias("file_hash"), suffix(F.col("path")).alias("kind"), rendered("path", "content").alias("r"))
    return out.select("path", "file_hash", "kind", "r.text", "r.error")


def pages(documents: DataFrame) -> DataFrame:
    """One row for each page: form feeds divide pages, numbered from 1."""
    return documents.select("path", F.posexplode(F.split("text", "\f")).alias("_p", "page_text")).select("path", (F.col("_p") + 1).alias("page"), "page_text")


def staged(new: DataFrame, known: DataFrame) -> DataFrame:
    """New files with the document that already holds the same bytes, if any: known (document_id, file_hash)."""
    first = known.groupBy("file_hash").agg(F.min("document_id").alias("duplicate_of"))
    return new.join(first, "file_hash", "left")


def read_gold(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the unreadable ones kept in _corrupt."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
