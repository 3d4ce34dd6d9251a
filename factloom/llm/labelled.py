"""The bounded, labelled sample that the quality and toxicity models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def sample(documents: DataFrame, labels: DataFrame, column: str, cap: int) -> DataFrame:
    """(doc_id, label, text) of about cap documents of each label 0 and 1, of those that may be learned from.

    The choice is made on the narrow labels; what is broadcast is two times cap ids and labels at about most.
    """
    may = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (common.remainder("doc_id", 3) != 1)).distinct()
    chosen = common.bounded_sample(may, may, "doc_id", "label", cap)
    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
