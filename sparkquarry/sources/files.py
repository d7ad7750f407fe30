"""Reading raw documents, and the stored tables of an index."""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes taken in.
SUFFIXES = ("pdf", "epub", "azw3", "cbr", "cbz", "txt")
#: The same as a pattern of file names, so that other files are never read.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in SUFFIXES) + "}"
#: A PDF whose pages hold less text is read by OCR, at most so many pages of it; of a comic archive so many images are.
LEAST_TEXT, OCR_PAGES, OCR_IMAGES = 200, 60, 50
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")
METADATA = "chunk_id long, text string, source string, chapter string, file_type string"
#: Text of one file's bytes; raises where it can't be read.
Extractor = Callable[[bytes], str]


def txt(data: bytes) -> str:
    """UTF-8 text, undecodable bytes dropped."""
    return data.decode("utf-8", "ignore")


def epub(data: bytes) -> str:
    """Text of the HTML items of an EPUB archive in the order of its manifest."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out: list[str] = []
            self.skip = 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, text):
            if not self.skip:
                self.out.append(text)

    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in _epub_items(z):
            parser = Text()
            parser.feed(z.read(name).decode("utf-8", "ignore"))
            parts.append("".join(parser.out))
    return "\n".join(parts)


def _epub_items(z: zipfile.ZipFile) -> list[str]:
    """The HTML items in the order of the package's manifest; by name where it can't be read."""
    pages = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    package = next((n for n in sorted(z.namelist()) if n.lower().endswith(".opf")), None)
    if package is None:
        return pages
    order = {}
    for item in re.findall(r"<(?:\w+:)?item\b[^>]*>", z.read(package).decode("utf-8", "ignore")):
        if href := re.search(r"""\bhref\s*=\s*["']([^"'#]+)""", item):
            order.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(href.group(1)))), len(order))
    return sorted(pages, key=lambda n: (order.get(n, len(order)), n))


def pdf(pages: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], list[str]]) -> Extractor:
    """An extractor of PDF files from plugins: texts of all pages, and OCR of the first pages.

    OCR is used where the pages hold under LEAST_TEXT characters or can't be read, and for
    at most OCR_PAGES pages.
    """

    def extract(data: bytes) -> str:
        try:
            text = "\n".join(pages(data))
        except Exception:  # a damaged text layer is no reason to give the file up
            text = ""
        return text if len(text.strip()) >= LEAST_TEXT else "\n".join(ocr(data, OCR_PAGES)[:OCR_PAGES])

    return extract


def comic(ocr: Callable[[bytes], str]) -> Extractor:
    """An extractor of zipped comic archives from an OCR plugin: the first OCR_IMAGES images by path."""

    def extract(data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            images = sorted(n for n in z.namelist() if n.lower().endswith(IMAGES))[:OCR_IMAGES]
            return "\n".join(ocr(z.read(n)) for n in images)

    return extract


#: Formats read without a plugin; pdf, azw3, cbr and cbz need one that calls a converter or OCR.
EXTRACTORS: dict[str, Extractor] = {"txt": txt, "epub": epub}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, suffix, content) of the supported files of a folder, not of its subfolders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", GLOB).load(folder)
    return with_names(files)


def with_names(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), suffix.alias("suffix"), "content").filter(F.col("suffix").isin(*SUFFIXES))


def extract(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """(file_name, suffix, text, error): one of text and error for each file; a failing file never fails the job."""
    use = {**EXTRACTORS, **(extractors or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for suffix, content in zip(pdf["suffix"], pdf["content"]):
                text = error = None
                try:
                    if suffix not in use:
                        raise ValueError(f"no extractor for .{suffix}")
                    text = use[suffix](bytes(content))
                    if not text.strip():
                        text, error = None, "Empty content."
                except Exception as e:
                    text, error = None, str(e) or type(e).__name__
                texts.append(text), errors.append(error)
            yield pd.DataFrame({"file_name": pdf["file_name"], "suffix": pdf["suffix"], "text": texts, "error": errors})

    return files.mapInPandas(run, "file_name string, suffix string, text string, error string")


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks stored as a JSON array; a row without an id is named by its position in the file."""
    require(spark, path, "metadata")
    rows = spark.read.schema(METADATA).json(path, multiLine=True)
    return rows.withColumn("pos", F.monotonically_increasing_id())


#: Tables of an index.
TABLES = ("chunks", "vectors", "processed", "failures", "manifest")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def index_files(spark: SparkSession, index: str) -> dict[str, bool]:
    """Which tables of an index are there: the first look of a check, before any is read."""
    return {name: exists(spark, f"{index}/{name}") for name in TABLES}


def require(spark: SparkSession, path: str, label: str) -> None:
    """An error that says what to do where a table or file of an index is missing, on any file system."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{label} not found at {path}: build the index or copy it there")
