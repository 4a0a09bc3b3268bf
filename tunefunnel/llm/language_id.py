"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts the hashed n-grams of each language in Spark and turns the
sums into one log-probability matrix (buckets x languages), which is broadcast.
Its size is bounded by ``MAX_MODEL_BYTES``: with very many languages the number
of buckets is halved until it fits.  Scoring looks up only the buckets that a
text holds and adds their rows with numpy; whole texts are scored.

The model is fitted on a bounded sample: all labelled rows of each language, or
about ``TRAIN_ROWS`` of one that has more, chosen by a hash of id and text and
read whole.  Priors count all labelled rows.  Predictions read the text only.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
so is every text when nothing was learned; ties go to the language that sorts
first; null ids and repeated rows are predicted row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches
from .common import python_ready

#: Labelled rows of a language that are learned from, about (a documented sample).
TRAIN_ROWS = 20_000
#: Hash buckets, n-gram lengths and additive smoothing.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Upper bound of the broadcast matrix.
MAX_MODEL_BYTES = 256 << 20
UNDETERMINED = "und"
#: One odd 64-bit multiplier for each place in an n-gram.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _grams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the buckets of all n-grams of all texts, one after
    another, and the end of each text among them.

    A blank on either side of a text keeps n-grams within it: windows that
    would run into the next text are left out."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    ends = np.cumsum(lengths)
    for n in ORDERS:
        m = len(points) - n + 1
        h = points[:m] * _MULTIPLIERS[0]
        for j in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _MULTIPLIERS[j] + points[j:m + j] * _MULTIPLIERS[0]
        h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[n % 3]
        buckets = (h >> np.uint64(64 - bits)).astype(np.int32)
        if n > 1:
            across = (ends[:-1, None] - np.arange(1, n)).ravel()
            buckets = np.delete(buckets, across)
        yield buckets, np.cumsum(lengths - (n - 1))


class Model:
    """Log probabilities by language (sorted) and bucket, and log priors."""

    def __init__(self, languages: list[str], bits: int, counts: np.ndarray, rows: np.ndarray):
        self.languages, self.bits = languages, bits
        smoothed = counts + SMOOTHING
        self.log_p = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.prior = np.log(rows / rows.sum())

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        if not texts:
            return [], []
        letters = [any(map(str.isalpha, t)) for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        total = np.tile(self.prior[:, None], (1, len(texts)))
        for buckets, ends in _grams(texts, self.bits):
            starts = np.concatenate([[0], ends[:-1]])
            some = ends > starts
            for k in range(len(self.languages)):
                total[k, some] += np.add.reduceat(self.log_p[k][buckets], starts[some])
        best = total.argmax(axis=0)
        top = total[best, np.arange(len(texts))]
        score = 1.0 / np.exp(total - top).sum(axis=0)
        return ([self.languages[b] if x else UNDETERMINED for b, x in zip(best.tolist(), letters)],
                [s if x else 0.0 for s, x in zip(score.tolist(), letters)])


def sample(rows: DataFrame, sizes: list[tuple[str, int]], train_rows: int) -> DataFrame:
    """(text, lang) to learn from of (id, text, lang) rows: every language of at
    most ``train_rows`` rows whole, of the others about ``train_rows`` by a hash of
    id and text.  Rows of a drawn language that repeat both count once, as they
    would all be drawn together."""
    shares = [(lang, int(2**32 * (train_rows / n))) for lang, n in sizes if n > train_rows]
    if not shares:
        return rows.select("text", "lang")
    share = F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, share long"))
    rows = rows.join(share, "lang", "left")
    drawn = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit("train")), F.lit(2**32)) < F.col("share"))
    return rows.filter("share IS NULL").select("text", "lang").unionByName(
        drawn.select("id", "text", "lang").distinct().select("text", "lang"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> Model:
    """Fit on a sample of the rows whose text and language are not null; without
    an id column rows are told apart by their texts.

    Each task adds up its own n-grams and gives at most one row per language
    and bucket, so a language that most rows share needs no shuffle of its rows.
    """
    spark = labelled.sparkSession
    python_ready(spark)
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        (F.col(id_col) if id_col in labelled.columns else F.lit(None).cast("long")).alias("id"),
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    rows = sample(rows, sizes, train_rows)
    languages = [lang for lang, _ in sizes]
    bits = int(math.log2(BUCKETS))
    while bits > 8 and len(languages) * 8 << bits > MAX_MODEL_BYTES:
        bits -= 1
    counts = np.zeros((len(languages), 1 << bits))
    place = {lang: k for k, lang in enumerate(languages)}

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for run, texts in batches.runs(part, "text"):
                langs = run.column("lang").to_pylist()
                for lang in set(langs):
                    held = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    for buckets, _ in _grams([t for t, x in zip(texts, langs) if x == lang], bits):
                        held += np.bincount(buckets, minlength=1 << bits)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()),
                                   pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])

    if languages:
        summed = (rows.mapInArrow(add, "lang string, bucket long, n long")
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
        # At most languages x buckets rows, the size of the model itself.
        table = summed.toPandas()
        counts[table["lang"].map(place).to_numpy(dtype=np.int64), table["bucket"].to_numpy()] = table["n"]
    return Model(languages, bits, counts, np.array([c for _, c in sizes], dtype=float))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``docs`` with the two prediction columns; columns of the same names are
    replaced."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, end, texts in batches.text_runs(part.column("row").field(at)):
                lang, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").slice(start, end - start), pa.array(lang, pa.string()),
                     pa.array(score, pa.float64())], names=["row", "lang", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    out = {lang_out.lower(), score_out.lower()}
    return rows.mapInArrow(run, schema).select(
        *(F.col(f"row.`{c}`") for c in names if c.lower() not in out),
        F.col("lang").alias(lang_out), F.col("score").alias(score_out))


def identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged.  A row is rejected
    when its language is undetermined (no letter in it) or its posterior
    probability is below ``min_score``."""
    lang, score = "__li_lang", "__li_score"
    return (predict(docs, model, text_col, lang, score)
            .filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score))
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
