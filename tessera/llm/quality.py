"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance shrunk toward the pooled one and toward a
multiple of the identity. A score is the logistic function of the difference of the two
log densities (Mahalanobis distances through Cholesky factors that are computed once
and travel with the model) plus the log prior ratio. Only statistics of the text are
inputs; they use all bytes and words of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import list_array, utf8, write_scratch
from tessera.llm.words import SPACE, U, mix, word_blocks

STATISTICS = (
    "log_words", "word_bytes", "word_bytes_spread", "upper", "digits", "symbols", "stops", "non_ascii",
    "symbol_endings", "upper_words", "one_byte_words", "distinct_words", "top_word", "same_as_last", "repeated_trigrams", "lines",
)
#: Shrinkage toward the pooled covariance, and toward the identity times the mean variance.
POOLED, RIDGE = 0.1, 0.02
#: Documents' shares are drawn toward these usual values as if by so many more words.
USUAL, DRAWN = {"upper": 0.02, "digits": 0.001, "symbols": 0.001, "stops": 0.03, "non_ascii": 0.02, "symbol_endings": 0.01, "upper_words": 0.01, "one_byte_words": 0.04, "top_word": 0.05, "same_as_last": 0.01, "repeated_trigrams": 0.01, "lines": 0.05}, 8.0

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1  # upper case
_KIND[48:58] = 2  # digit
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:?'\"-()"]] = 3  # symbol
_KIND[[ord(c) for c in ".,;:?"]] = 4
_KIND[128:] = 5
_KIND[[10]] = 6


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each slice ends[i]:ends[i+1], empty slices too."""
    total = np.append(0, np.cumsum(values, dtype=np.float64))
    return total[ends[1:]] - total[ends[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; a text without words has its shares at the usual values."""
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i, j, hashes, ends, lengths in word_blocks(data, offsets):
        base, texts = offsets[i], j - i
        raw = data[base : offsets[j]]
        kind = _KIND[raw]
        at = offsets[i : j + 1] - base
        size, words = np.diff(at).astype(float), np.diff(ends).astype(float)
        last = np.append(SPACE[raw[1:]], True) if len(raw) else np.zeros(0, bool)
        last[at[1:][at[1:] > 0] - 1] = True
        last &= ~SPACE[raw]
        last_kind, one = kind[last], lengths == 1
        owner = np.repeat(np.arange(texts), np.diff(ends))
        key = np.sort((owner.astype(U) << U(44)) | (hashes >> U(20)))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        runs, of = np.diff(np.append(first, len(key))), (key[first] >> U(44)).astype(np.int64)
        distinct, top = np.bincount(of, minlength=texts), np.zeros(texts)
        np.maximum.at(top, of, runs)
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) if len(hashes) else np.zeros(0, bool)
        three = mix(hashes[:-2] + hashes[1:-1] * U(3) + hashes[2:] * U(7)) if len(hashes) > 2 else np.zeros(0, U)
        inside = owner[: len(three)] == owner[len(hashes) - len(three) :]
        key3 = np.sort((owner[: len(three)][inside].astype(U) << U(44)) | (three[inside] >> U(20)))
        fresh = np.append(True, key3[1:] != key3[:-1]) if len(key3) else np.zeros(0, bool)
        repeated = np.bincount((key3[~fresh] >> U(44)).astype(np.int64), minlength=texts)
        upper_bytes = np.append(0, np.cumsum(kind == 1))
        word_end = np.flatnonzero(last) + 1
        upper_in = upper_bytes[word_end] - upper_bytes[np.maximum(word_end - np.minimum(lengths, word_end), 0)] if len(word_end) == len(lengths) else np.zeros(len(lengths))
        loud = (upper_in >= 2) & (2 * upper_in > lengths)
        mean = np.divide(_sums(lengths, ends), words, out=np.full(texts, 5.0), where=words > 0)
        square = np.divide(_sums(lengths.astype(float) ** 2, ends), words, out=np.full(texts, 34.0), where=words > 0)
        share = lambda name, count, whole, unit: np.sqrt((count + USUAL[name] * DRAWN * unit) / (whole + DRAWN * unit))
        byte = lambda name, k: share(name, _sums(kind == k, at), size, 6.0)
        word = lambda name, count: share(name, count, words, 1.0)
        out[i:j] = np.stack(
            [
                np.log1p(words), np.log((mean * words + 5 * DRAWN) / (words + DRAWN)), np.log1p(np.sqrt(np.maximum(square - mean**2, 0)) * words / (words + DRAWN)),
                byte("upper", 1), byte("digits", 2), byte("symbols", 3), byte("stops", 4), byte("non_ascii", 5),
                word("symbol_endings", _sums(last_kind == 3, ends) if len(word_end) == len(lengths) else np.zeros(texts)), word("upper_words", _sums(loud, ends)), word("one_byte_words", _sums(one, ends)),
                np.log((distinct + DRAWN) / (words + DRAWN)), word("top_word", top), word("same_as_last", _sums(same, ends)), word("repeated_trigrams", repeated), word("lines", _sums(kind == 6, at)),
            ], axis=1,
        )
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(text: pa.Array) -> pa.Array:
    values = statistics(*utf8(text))
    return list_array(values.ravel(), np.full(len(values), len(STATISTICS)))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log prior ratio."""

    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant | None:
        """From each class's count, sum and sum of outer products; None unless both classes have rows."""
        if (counts < 1).any():
            return None
        n = counts[:, None, None]
        mean = sums / counts[:, None]
        spread = products / n - mean[:, :, None] * mean[:, None, :]
        together = (counts[:, None, None] * spread).sum(axis=0) / counts.sum()
        scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0) / counts.sum()) - (sums.sum(axis=0) / counts.sum()) ** 2, 1e-12))
        unit = scale[:, None] * scale
        cov = ((1 - pooled) * spread + pooled * together) / unit
        d = len(scale)
        cov = (1 - ridge) * cov + ridge * (np.trace(cov, axis1=1, axis2=2) / d)[:, None, None] * np.eye(d) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        return cls(scale, mean / scale, np.linalg.inv(lower), 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1), float(np.log(counts[1] / counts[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x / self.scale
        distance = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        margin = 0.5 * (distance[0] - distance[1] + self.log_dets[0] - self.log_dets[1]) + self.log_prior
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def fit_discriminant(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant | None:
    """Fit on all rows of ``stats`` (doc_id, stats) that ``labels`` marks 0 or 1; other labels and nulls do not count.

    Each task returns one row of sums for each class, so the driver gets a few kilobytes a task.
    """
    d = len(STATISTICS)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    fields = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch["stats"].tolist(), float).reshape(-1, d)
            for k in (0, 1):
                part = x[batch["label"].to_numpy() == k]
                total[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        yield pd.DataFrame({"label": [0, 1], "sums": total.tolist()})

    parts = stats.join(known, "doc_id").select("label", "stats").mapInPandas(moments, fields)
    summed = parts.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for row in summed:
        total[row["label"], row["at"]] = row["value"]
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def score_column(model: Discriminant | None, stats: Column | str = "stats") -> Column:
    """Probability of label 1; 0.5 where the labels had only one class or none."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf(T.DoubleType())
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))))

    return score(stats)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from labels of rows that are not held out. A null text counts as empty and is
    scored like any other; repeated rows are scored alike; rows with a null doc_id are
    scored but teach nothing; an empty table gives an empty result; other columns are
    ignored. If the labels lack a class, every score is 0.5.
    """
    stats = write_scratch(docs.select(F.col(id_col).alias("doc_id"), statistics_udf(text_col).alias("stats")), "statistics")
    model = fit_discriminant(stats.where(~held_out()), labels.where(~held_out(id_col)), id_col=id_col)
    scored = stats.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    The scores come from one expression over the text, so rows are kept by their own
    text and not by their id.
    """
    stats = write_scratch(docs.where(~held_out()).select("doc_id", statistics_udf("text").alias("stats")), "statistics")
    model = fit_discriminant(stats, labels.where(~held_out()))
    return docs.where(score_column(model, statistics_udf(docs["text"])) >= 0.5)
