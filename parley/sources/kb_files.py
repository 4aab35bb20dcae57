"""Knowledge-base text files → sections.

A file is split on blank lines (``\\n\\n`` after normalising line ends);
sections that are blank after stripping are dropped, the others are kept
unstripped and tagged with the file name. A missing directory gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("section_no", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)


def split_sections(files: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., section_no, content) from a table of whole file texts."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\r", "\n")
    parts = files.select(*keep, F.posexplode(F.split(text, "\n\n", -1)).alias("section_no", "content"))
    return parts.filter(F.col("content").rlike(r"(?U)\S")).select(
        *keep, F.col("section_no").cast("bigint").alias("section_no"), "content"
    )


def read_kb_files(spark: SparkSession, directory: str, pattern: str = "*.txt") -> DataFrame:
    """(doc_id, source, section_no, content) of a folder's files; ``doc_id`` is the file's path."""
    path = f"{directory.rstrip('/')}/{pattern}"
    try:
        files = spark.read.text(path, wholetext=True)
        files = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_name").alias("source"), "value")
        files.schema  # resolves the path now
    except Exception as e:  # missing directory or no match → empty result
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], SECTION_SCHEMA)
        raise
    return split_sections(files, "value", ["doc_id", "source"])


def sections_from_table(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                        text_col: str = "text") -> DataFrame:
    """KB sections from a document table, each document being one KB file:
    (doc_id, section_no, source, content)."""
    parts = split_sections(docs, text_col, [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")])
    return parts.select("doc_id", "section_no", "source", "content")
