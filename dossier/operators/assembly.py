"""Document text from its segments, and the choice between native and recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import strip


def assemble(segments: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, part, row, col, kind, text)``.

    Cells of one row are joined by tabs, then rows, paragraphs and pages by newlines, in order of
    part and row. A sheet's part opens with its header line (kind ``sheet``, row before its cells).
    """
    cell = F.when(
        F.col("kind") == "sheet", F.format_string(K.SHEET_HEADER_FORMAT, F.col("text"))
    ).otherwise(F.coalesce("text", F.lit("")))
    lines = (
        segments.select(doc_id, "part", "row", "col", cell.alias("_cell"))
        .groupBy(doc_id, "part", "row")
        .agg(F.expr("listagg(_cell, '\\t') WITHIN GROUP (ORDER BY col)").alias("_line"))
        .select(doc_id, F.struct("part", "row").alias("_at"), "_line")
    )
    text = F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY _at)")
    return lines.groupBy(doc_id).agg(text.alias("text")).select(doc_id, strip("text").alias("text"))


def choose_text(
    docs: DataFrame, native: str = "native_text", recognised: str = "ocr_text",
    minimum: int = K.MIN_NATIVE_TEXT,
) -> DataFrame:
    """Adds ``text`` and ``extract_method``; ``text`` is null where neither source has any."""
    own = F.coalesce(strip(native), F.lit(""))
    seen = F.coalesce(strip(recognised), F.lit(""))
    enough = F.length(own) >= minimum
    text = F.when(enough, own).otherwise(seen)
    method = F.when(enough, "pdf_text").when(seen != "", "ocr_tesseract").otherwise("ocr_failed")
    return docs.withColumn("extract_method", method).withColumn("text", F.nullif(text, F.lit("")))


def split_rejects(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with text and documents without."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    return docs.where(~blank), docs.where(blank)
