"""Document sources: files with path fields, governed inventories, page extraction by pluggable extractors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: An extractor turns the bytes of a file into (text, method) of each page.
Extractor = Callable[[bytes], list[tuple[str, str]]]


def plain_pages(content: bytes) -> list[tuple[str, str]]:
    """Pages of a text file, separated by form feeds."""
    return [(p, "text") for p in content.decode("utf-8", "replace").split("\f")]


def html_pages(content: bytes) -> list[tuple[str, str]]:
    """The text of an HTML file as one page."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3"):
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    r = Reader()
    r.feed(content.decode("utf-8", "replace"))
    return [("".join(r.out).strip(), "text")]


@dataclass
class PageConfig:
    """Limits of page quality, and the extractors by suffix; `recognize` reads a page from its bytes where its text is poor."""

    short: int = 80
    garbled: float = 0.25
    extractors: dict[str, Extractor] = field(default_factory=lambda: {".txt": plain_pages, ".html": html_pages, ".htm": html_pages})
    recognize: Callable[[bytes, int], str] | None = None

    def __post_init__(self):
        if self.short < 0 or not 0 <= self.garbled <= 1:
            raise ValueError("short must not be negative and garbled must be a share")


def normal_path(path: Column) -> Column:
    """Canonical composed form with forward slashes. The composed form needs the Unicode database."""

    @F.pandas_udf("string")
    def composed(p):
        import pandas as pd

        return pd.Series([None if x is None else unicodedata.normalize("NFC", x).replace("\\", "/") for x in p], dtype=object)

    return composed(path)


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".txt", ".html", ".htm")) -> DataFrame:
    """(path, company, product, content, sha256) of the files below `root`; the first two folders name company and product."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in base) + "/", "")
    ok = F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(F.lower("path"), s))
    x = f.where(ok).select(normal_path(relative).alias("path"), "content")
    part = F.split("path", "/")
    level = lambda i: F.when(F.size(part) > i + 1, F.get(part, i))
    return x.select("path", level(0).alias("company"), level(1).alias("product"), "content", F.sha2("content", 256).alias("sha256"))


def inventory(found: DataFrame, approval: str, reference: str, approved: tuple[str, ...] = ("approved_public", "approved_project_owned")) -> DataFrame:
    """Sources of approved files: stable ids by path; duplicate paths and files without company and product are an error."""
    if approval not in approved or not reference.strip():
        raise ValueError("the source isn't approved")
    x = found.groupBy("path", "company", "product").agg(F.count("*").alias("n"), F.first("sha256").alias("sha256"))
    checked = F.when((F.col("n") > 1) | F.col("product").isNull(), F.raise_error(F.concat(F.lit("not admissible: "), "path"))).otherwise(F.col("path"))
    return x.select(T.stable_id("corpus/source", checked).alias("source_id"), "path", "company", "product", "sha256", F.lit(approval).alias("approval"), F.lit(reference).alias("approval_reference"))


def extract_pages(found: DataFrame, config: PageConfig | None = None) -> DataFrame:
    """(path, page_number, text, extraction_method, quality_notes) of files (path, content); a page that can't be read is empty and says so.

    Files are read where they lie; each is one row of the source.
    """
    config = config or PageConfig()

    def poor(text):
        return len(text.strip()) < config.short or (text.count("�") / len(text) if text else 0.0) > config.garbled

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                extractor = next((e for s, e in config.extractors.items() if path.lower().endswith(s)), plain_pages)
                for n, (text, method) in enumerate(extractor(content), 1):
                    notes = []
                    if poor(text) and config.recognize is not None:
                        try:
                            text, method = config.recognize(content, n), "ocr"
                        except Exception as e:  # noqa: BLE001 - a failing recognizer must not lose the file
                            notes.append(f"recognition failed: {type(e).__name__}")
                    if text and text.count("�") / len(text) > config.garbled:
                        notes.append("severe_ocr_uncertainty" if method == "ocr" else "unreadable_page")
                    lines = (" ".join(x.split()) for x in text.splitlines())
                    rows.append((path, n, "\n".join(x for x in lines if x), method, notes))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "page_number", "text", "extraction_method", "quality_notes"])

    return found.select("path", "content").mapInArrow(run, "path string, page_number int, text string, extraction_method string, quality_notes array<string>")
