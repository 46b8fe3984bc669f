"""The sentence table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segment import sentences
from ..functions.text import sentence_id


def sentence_table(documents: DataFrame, corpus: str = "corpus_id", path: str = "doc_path", content: str = "content", repaired: bool = True) -> DataFrame:
    """``corpus_id, doc_path, sent_idx, sent_text, sent_id`` of all documents; a narrow operator, no shuffle."""
    rows = documents.select(F.col(corpus).alias("corpus_id"), F.col(path).alias("doc_path"), F.posexplode(sentences(F.col(content), repaired)).alias("sent_idx", "sent_text"))
    return rows.withColumn("sent_id", sentence_id(F.col("corpus_id"), F.col("doc_path"), F.col("sent_idx"), F.col("sent_text")))
