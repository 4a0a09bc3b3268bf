"""Token counts of whole texts, lengths only.

Runs of rows balanced by bytes are encoded at once in each task; texts, long
ones too, are split at safe boundaries (see ``word_pieces``), so no string given
to a tokenizer grows with a text.  ``.json`` files go through ``tokenizers`` and
``.model`` files through ``sentencepiece``, with no begin, end or other added
tokens, truncation or padding, and special strings inside texts as the library
treats them by default.

Defined cases: null counts as empty, and an empty text has 0 tokens and 0 bytes;
repeated rows and null ids are counted row by row; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, word_pieces
from .common import python_ready, text_or_empty

#: Texts of more tokens are over the limit.
LIMIT = 2048

_MODELS: dict = {}


def counter(path: str):
    """A function from texts to token counts for a tokenizer file."""
    if path.endswith(".json"):
        return word_pieces.opened(path).count
    if path not in _MODELS:
        import sentencepiece
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    model = _MODELS[path]
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_tokens = counter(tokenizer)
        for part in parts:
            for run, texts in batches.runs(part, "text"):
                yield pa.record_batch(
                    [run.column("id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                     pa.array(count_tokens(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
