"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; their 1-, 2- and 3-grams of code points are hashed into buckets. Training counts buckets over every labelled
row (each task sums its own rows first, so that a few rows for each language and bucket are shuffled). The matrix of log
probabilities is broadcast: its size is languages x buckets, whatever the number of rows, and languages are bounded. Scoring gathers the rows of the matrix that a
batch of texts touches and sums them by text.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column as _column
from .common import discard, materialize

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the matrix that is broadcast: so many languages, of half a megabyte each.
MOST_LANGUAGES = 512
#: Additive smoothing of bucket counts.
ALPHA = 0.5
#: Code points of texts hashed at once, for four languages.
AT_ONCE = 1 << 20
UNKNOWN = "und"

_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """languages, and the log probabilities: priors by language, and buckets by row and languages by column."""

    languages: tuple[str, ...]
    priors: np.ndarray
    weights: np.ndarray


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, ordered by text, and where each text begins among them (with the end)."""
    codes = np.frombuffer("\0".join(t.lower().replace("\0", " ") for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 0)
    found, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        whole = np.ones(m, bool)
        mixed = np.full(m, n, np.uint64)
        for i in range(n):
            part = codes[i : i + m]
            whole &= part != 0
            mixed = (mixed ^ part) * _K
            mixed ^= mixed >> np.uint64(29)
        found.append((mixed[whole] * _K >> np.uint64(48)).astype(np.int64))
        owners.append(owner[:m][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))


def _blocks(texts: list[str], most: int):
    """Runs of texts of about `most` code points; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def train(df: DataFrame, text: str = "text", lang: str = "lang", *, most_languages: int = MOST_LANGUAGES) -> Model:
    """Counts over every row whose text and language aren't null. No such row, as in an empty table, gives a model without languages.

    Repeated rows count as often as they stand. More than most_languages names are an error, raised before anything is collected: no language is left out.
    """

    def count(batches):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))
        for batch in batches:
            by_lang = defaultdict(list)
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[name].append(t)
            for name, texts in by_lang.items():
                counts[name][BUCKETS] += len(texts)
                for a, b in _blocks(texts, AT_ONCE):
                    counts[name][:BUCKETS] += np.bincount(grams(texts[a:b])[0], minlength=BUCKETS)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    rows = df.select(_column(text).alias("text"), _column(lang).alias("lang")).where("text is not null and lang is not null")
    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "language-counts")
    found = summed.agg(F.count_distinct("lang")).first()[0]
    if found > most_languages:
        raise ValueError(f"{found} languages, of which a model holds at most {most_languages}")
    at_driver = summed.toPandas()
    discard(summed)
    languages = tuple(sorted(at_driver.lang.unique()))
    table = np.zeros((BUCKETS + 1, len(languages)))
    table[at_driver.bucket.to_numpy(), np.searchsorted(np.array(languages, object), at_driver.lang.to_numpy()) if languages else []] = at_driver.n
    counts, docs = table[:BUCKETS] + ALPHA, table[BUCKETS]
    return Model(languages, np.log(docs / max(1, docs.sum())) if languages else docs, np.log(counts / counts.sum(axis=0)))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; `und` and 0 without a letter. Ties go to the first name."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if model.languages else []
    known = [texts[i] for i in at]
    for a, b in _blocks(known, max(1 << 16, AT_ONCE * 4 // max(4, len(model.languages)))):
        buckets, begins = grams(known[a:b])
        sums = np.add.reduceat(model.weights[buckets], begins[:-1], axis=0) + model.priors
        likely = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = sums.argmax(axis=1)
        for i, k, p in zip(at[a:b], best, likely[np.arange(len(best)), best] / likely.sum(axis=1), strict=True):
            names[i], scores[i] = model.languages[k], p
    return names, scores


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """df with a struct column `out` (lang, score).

    Null texts and texts without a letter are `und` with score 0, and so is every text for a model without languages. Of equally likely languages the first
    by name counts. Whole texts are scored, in time and memory that grow with their length. Repeated rows get equal results, an empty table gives an empty
    one; other columns stay as they are (one called like `out` is replaced).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def named(column: pd.Series) -> pd.DataFrame:
        names, scores = predict([None if t is None else t for t in column], shared.value)
        return pd.DataFrame({"lang": names, "score": scores})

    return df.withColumn(out, named(_column(text)))


def held_out(doc_id: str) -> Column:
    """The rows kept from training: the CRC-32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(_column(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
