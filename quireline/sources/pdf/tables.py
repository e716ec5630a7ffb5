"""PDF files as tables: summaries, outlines and updates of a column of file contents. A file that cannot be read is a row with a problem."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.sources.formats import Item
from quireline.sources.pdf.document import Document
from quireline.sources.pdf.update import with_outline

INFO = "xref string, revisions int, objects int, pages int, encrypted boolean, has_outline boolean, linearized boolean, size long, problem string"
OUTLINE = "pos int, title string, level int, page_index int, problem string"


def read_files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(make, columns: list[str], blank: tuple):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in make(Document(bytes(content or b"")))]
                except (ValueError, RecursionError) as e:
                    rows = [(path, *blank, str(e))]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return run


def info(files: DataFrame) -> DataFrame:
    """One row for each file of (path, content)."""
    names = [f.split()[0] for f in INFO.split(", ")]
    run = _rows(lambda d: [tuple(d.info().values())], ["path", *names], (None,) * 8)
    return files.select("path", "content").mapInPandas(run, f"path string, {INFO}")


def outlines(files: DataFrame) -> DataFrame:
    """The outline rows of each file; files without an outline have none."""
    names = [f.split()[0] for f in OUTLINE.split(", ")]
    run = _rows(lambda d: [(i, r.title, r.level, r.page_index) for i, r in enumerate(d.outline())], ["path", *names], (None,) * 4)
    return files.select("path", "content").mapInPandas(run, f"path string, {OUTLINE}")


def updated(files: DataFrame) -> DataFrame:
    """path, content, problem of files with new outlines. ``files``: path, content, items (array of title, level, page), offset."""

    @F.pandas_udf("struct<content:binary,problem:string>")
    def run(content: pd.Series, items: pd.Series, offset: pd.Series) -> pd.DataFrame:
        rows = []
        for c, own, shift in zip(content, items, offset, strict=True):
            try:
                entries = [Item(i["title"], int(i["level"]), int(i["page"])) for i in own]
                rows.append((with_outline(bytes(c), entries, offset=int(shift)), None))
            except (ValueError, RecursionError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["content", "problem"])

    return files.select("path", run("content", "items", "offset").alias("r")).select("path", "r.*")
