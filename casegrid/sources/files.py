"""Documents and line lists from files, and results to files."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions.nulls import trim
from casegrid.operators.graph import arranged
from casegrid.operators.prompt import DEFAULT_MODELS, auto_prompt
from casegrid.schema import LINELIST
from casegrid.sources.pdf import page_texts

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RECORD = "\n\f\n"
DOCUMENT = "path string, label string, content string, content_type string"


def docx_text(raw: bytes) -> str:
    """The paragraphs of a DOCX file that are not blank, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in body.iter(f"{_W}p"))
    return "\n\n".join(p for p in paragraphs if p)


def text_of(label: str, raw: bytes, pdf: Callable[[bytes], list[str]] | None = page_texts) -> tuple[str, str]:
    """(content, content_type) of a txt, md, docx or pdf file; any other kind is an error."""
    kind = label.rsplit(".", 1)[-1].lower() if "." in label else ""
    if kind in ("txt", "md"):
        text = raw.decode("utf-8")
    elif kind == "docx":
        text = docx_text(raw)
    elif kind == "pdf" and pdf:
        text = "\n".join(pdf(raw))
    else:
        raise ValueError(f"cannot read {label}: " + ("no PDF reader was given" if kind == "pdf" else "unknown file type"))
    return text, "markdown" if kind in ("md", "docx") else "text"


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = page_texts) -> DataFrame:
    """path, label, content, content_type of the txt, md, docx and pdf files under ``path``, in any store that Spark reads; any other kind is
    an error when it is read.  ``pdf`` gives the texts of a file's pages, which are joined by line ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            labels = [name.rsplit("/", 1)[-1] for name in p["path"]]
            rows = [(name, label, *text_of(label, bytes(raw), pdf)) for name, label, raw in zip(p["path"], labels, p["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "label", "content", "content_type"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, DOCUMENT)


def pasted_document(spark: SparkSession, text: str, label: str = "pasted text") -> DataFrame:
    """A document from text; blank text is an error."""
    if not (text or "").strip():
        raise ValueError("the text is blank")
    return spark.createDataFrame([(None, label, text.strip(), "text")], DOCUMENT)


def read_linelist(spark: SparkSession, path: str) -> DataFrame:
    """A line list from CSV with a header; empty cells are null."""
    return spark.read.csv(path, header=True, schema=LINELIST, multiLine=True, escape='"', enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, without citations, nulls as NA."""
    flat = df.drop("citations")
    lists = [c for c, t in flat.dtypes if t.startswith("array<")]
    for c in lists:
        flat = flat.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ", "))
    flat.write.mode("overwrite").csv(path, header=True, nullValue="NA", escape='"')


def stamped(folder: str, kind: str, now: datetime | None = None) -> str:
    """A path for a result that names its kind and the time."""
    return f"{folder.rstrip('/')}/{kind}_{now or datetime.now():%Y%m%d_%H%M%S}"


def write_relationships(relations: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """The relationship table as CSV, in its order."""
    write_csv(arranged(relations, by), path)


def write_responses(df: DataFrame, path: str, column: str = "response") -> None:
    """A text record for each response; records are parted by a line with a form feed, as responses have lines of their own."""
    df.select(column).write.mode("overwrite").option("lineSep", RECORD).text(path)


def read_responses(spark: SparkSession, path: str, column: str = "response") -> DataFrame:
    return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", column)


def demo_path(name: str) -> str:
    """Path of a bundled demo file; an unknown name is an error."""
    return template_path(name)


def template_path(name: str = "linelist_prompt.txt") -> str:
    """Path of a bundled template; an unknown name is an error."""
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "assets", name)
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return path


def template(name: str = "linelist_prompt.txt") -> str:
    with open(template_path(name), encoding="utf-8") as f:
        return f.read()


def write_prompt(docs: DataFrame, path: str, provider: str, model: str | None = None, words: int = 400, again: bool = False) -> DataFrame:
    """A prompt note for each document (doc_id, prompt) as Parquet; an existing one stays unless ``again``."""
    old = None if again else cached_result(docs.sparkSession, path)
    if old is not None:
        return old
    return cached(docs.select("doc_id", auto_prompt(template(), "content", provider, model or DEFAULT_MODELS[provider], words).alias("prompt")), path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """Write a result where ``cached_result`` finds it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def cached_result(spark: SparkSession, path: str) -> DataFrame | None:
    """The last result, or None if there is none or it is empty."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return None if df.isEmpty() else df


def squeezed(df: DataFrame, column: str = "content") -> DataFrame:
    """Documents whose text is not blank, trimmed."""
    return df.withColumn(column, trim(column)).filter(F.col(column) != "")
