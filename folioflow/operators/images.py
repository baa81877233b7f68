"""Tables of pictures that documents hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels that a picture has at least both ways, and characters that a scanned page must give.
LEAST_PIXELS, LEAST_TEXT = 50, 50


def kept(images: DataFrame) -> DataFrame:
    """Pictures large enough to be no icons; pictures of whole pages only if text was recognised on them."""
    large = (F.col("width") >= LEAST_PIXELS) & (F.col("height") >= LEAST_PIXELS)
    scanned = F.coalesce(F.length(F.trim("ocr_text")), F.lit(0)) > LEAST_TEXT
    return images.where(large & (~F.coalesce("full_page", F.lit(False)) | scanned))


def of_documents(images: DataFrame, wanted: DataFrame, page: Column | None = None) -> DataFrame:
    """Pictures of the wanted documents (document_id), of one page if it is given."""
    found = images.join(wanted.select("document_id").distinct(), "document_id", "left_semi")
    return found if page is None else found.where(F.col("page_number") == page)


def counts(images: DataFrame) -> DataFrame:
    return images.groupBy("document_id").agg(F.count("*").alias("image_count"))
