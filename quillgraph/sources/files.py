"""Document files: text, Markdown and PDF, by extension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = {".txt": "text", ".md": "markdown", ".pdf": "pdf"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def format_of(path: Column, strict: bool = True) -> Column:
    """The format of a path by its extension, in any case; others raise an error, or are null if not ``strict``."""
    e = extension(path)
    out = F.raise_error(F.concat(F.lit("unsupported file format: "), e)).cast("string") if strict else F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def _one_line_end(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files as ``(path, text)``; Markdown is read the same way, unrendered."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select("path", _one_line_end(F.col("value")).alias("text"))


def _extract_pdf(content: bytes) -> str:
    from io import BytesIO

    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise ImportError("reading PDF files needs the package pdfminer.six") from e
    return extract_text(BytesIO(content))


@F.pandas_udf(T.StringType())
def _pdf_text(s: pd.Series) -> pd.Series:
    return s.map(lambda b: _extract_pdf(bytes(b)) if b is not None else None)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of all formats under a path as ``(path, format, text)``.  Unknown extensions raise an error."""
    rows = spark.read.format("binaryFile").load(path)
    rows = rows.select("path", format_of(F.col("path")).alias("format"), "content")
    plain = rows.where("format <> 'pdf'").select("path", "format", _one_line_end(F.decode("content", "UTF-8")).alias("text"))
    pdf = rows.where("format = 'pdf'").select("path", "format", _pdf_text("content").alias("text"))
    return plain.unionByName(pdf)
