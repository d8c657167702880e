"""Directories of files: listing, hashing, parsing by format."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

IGNORED = r"(^~\$.*|.*\.(tmp|part|crdownload|download)$)"
#: MIME types by extension. Fixed values.
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "txt": "text/plain", "html": "text/html", "json": "application/json", "csv": "text/csv",
}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def _described(files: DataFrame) -> DataFrame:
    kept = files.where(~base_name(F.col("path")).rlike(IGNORED))
    return kept.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"), mime_type(F.col("path")).alias("mime_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder (not below it), without temporary ones: path, SHA-256, MIME type, size, bytes."""
    return _described(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder))


def stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """The same as a stream; each file once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _described(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder))


def unknown(files: DataFrame, resumes: DataFrame) -> DataFrame:
    """Files whose base name no record has."""
    known = resumes.select(base_name(F.col("file_path")).alias("name")).distinct()
    return files.withColumn("name", base_name(F.col("file_path"))).join(known, "name", "left_anti").drop("name")


def decode(content: Column) -> Column:
    """Bytes as UTF-8; malformed bytes are dropped, replacement characters that the text itself has stay."""
    own = F.lit("\ue000\ue001\ue000")  # stands for them meanwhile
    mark = F.lit("\ufffd")
    valid = F.make_valid_utf8(F.replace(content.cast("string"), mark, own))
    return F.replace(F.replace(valid, mark, F.lit("")), own, mark)


def docx_text(data: bytes) -> str:
    """Headers once each, then paragraphs and table rows (cells joined by ' | ') in order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    line = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))

    def body(node) -> Iterator[str]:
        for child in node:
            if child.tag == f"{w}p":
                yield line(child)
            elif child.tag == f"{w}tbl":
                for row in child.iter(f"{w}tr"):
                    yield " | ".join(" ".join(map(line, cell.iter(f"{w}p"))) for cell in row.findall(f"{w}tc"))
            elif child.tag == f"{w}sdt":
                yield from body(child.find(f"{w}sdtContent") if child.find(f"{w}sdtContent") is not None else ())

    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        heads = [x for n in sorted(z.namelist()) if re.match(r"word/header\d*\.xml$", n) for x in [ElementTree.fromstring(z.read(n))]]
        for part in [*heads, ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")]:
            text = "\n".join(x for x in body(part) if x.strip())
            if text and text not in out:
                out.append(text)
    return "\n".join(out)


#: Parsers of bytes by extension; :func:`parse` takes more, or others.
PARSERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pdf": pdf.pdf_text, "doc": pdf.doc_text}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Adds ``parsed_text``: plain text natively, other formats by their parser, '' for the rest and for files that a parser refuses."""
    table = PARSERS | (parsers or {})
    ext = extension(F.col("file_path"))
    plain = files.where(ext.isin("txt", "html", "csv", "json")).withColumn("parsed_text", decode(F.col("content")))
    other = files.where(~ext.isin("txt", "html", "csv", "json"))

    @F.pandas_udf("string")
    def run(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(p: str, c: bytes) -> str:
            parser = table.get(p.rsplit(".", 1)[-1].lower())
            try:
                return parser(c) if parser and c else ""
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                return ""

        return pd.Series([one(p, c) for p, c in zip(path, content, strict=True)])

    return plain.unionByName(other.withColumn("parsed_text", run("file_path", "content")))
