"""Exact deduplication of documents by two-pass Bloom filtering.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the most code points stays,
then the smallest doc_id.

Defined cases: a null text counts as empty; null doc_ids sort before all
others; of rows that repeat text and doc_id exactly one stays; an empty table
gives an empty result; further columns, whatever their names, are carried by
``survivors`` and ignored by ``duplicate_groups``.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .common import written

WHITE_SPACE = r"[\x20\x09-\x0D]"
_SHA, _OWN, _FIRST, _RN = "__xd_sha", "__xd_own", "__xd_first", "__xd_rn"


def normalised(text: Column) -> Column:
    """The text without ASCII white space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The digest that equal texts share, and the order among them."""
    text, id_ = docs[f"`{text_col}`"], docs[f"`{id_col}`"]
    return [F.unhex(F.sha2(normalised(text), 256)).alias(_SHA),
            F.struct((-F.length(F.coalesce(text, F.lit("")))).alias("n"), id_.alias("id")).alias(_OWN)]


def marked(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` (with their digest columns) with the group's best row and size,
    and whether the row stays."""
    unique, grouped = repeats.split_repeated(rows, _SHA, _OWN, narrow)
    first = F.col(f"{_OWN}.id").eqNullSafe(F.col(f"{repeats.BEST}.id"))
    # Rows that repeat the staying doc_id are numbered; one row a group gets here.
    w = Window.partitionBy(_SHA, f"{_OWN}.id").orderBy(f"{_OWN}.n")
    firsts = (grouped.filter(first).repartition(F.col(_SHA), F.col(f"{_OWN}.id"))
              .withColumn(_RN, F.row_number().over(w))
              .withColumn(_FIRST, F.col(_RN) == 1).drop(_RN))
    return (unique.withColumn(_FIRST, F.lit(True))
            .unionByName(firsts)
            .unionByName(grouped.filter(~first).withColumn(_FIRST, F.lit(False))))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.
    The texts are read once, for their digests."""
    narrow = written(docs.select(*digests(docs, id_col, text_col)), "digests")
    return marked(narrow, narrow).select(
        F.col(f"{_OWN}.id").alias(id_col),
        F.col(f"{repeats.BEST}.id").alias("keep_id"),
        F.col(repeats.SIZE).alias("group_size"),
        F.col(_FIRST).alias("kept"),
        F.lower(F.hex(_SHA)).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  The digests are
    written once; whole rows shuffle only where their digest may be repeated."""
    columns = digests(docs, id_col, text_col)
    narrow = written(docs.select(*columns), "digests")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__xd_row"), *columns)
    return marked(rows, narrow).filter(_FIRST).select(*(F.col(f"__xd_row.`{c}`") for c in docs.columns))
