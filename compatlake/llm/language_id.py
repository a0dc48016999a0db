"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1-, 2- and 3-grams of all labelled rows of the training folds, in Spark; the matrix of
log probabilities (``buckets`` times the number of languages, at most ``most`` of these) is broadcast, and texts are
scored in batches with numpy. Letters are lower-cased; everything else is one boundary symbol.

The fold of a row is ``crc32(id as text) mod folds``; fold 0 is held out and never learned from. Neither label,
source nor id is an input of a prediction. A null text or one without any letter is ``und`` with score 0, and so is
every text if nothing could be learned. Ties go to the alphabetically first language. A row without an id counts as
held out. The score is the posterior probability of the predicted language. Extra columns pass through untouched.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import free_name

BUCKETS = 1 << 15
FOLDS = 5
#: Bound on the number of languages, and so on the broadcast matrix (``BUCKETS * MOST`` numbers of four bytes).
MOST = 512
SMOOTHING = 0.1
UNKNOWN = "und"
#: Characters of text handled at once.
STEP_CHARS = 1 << 18

_FACTORS = tuple(np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@functools.cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams with a letter, the number of the text each is in, and whether each text has a letter."""
    lowered = [text.lower() for text in texts]
    sizes = np.array([len(text) + 2 for text in lowered], dtype=np.int64)
    codes = np.frombuffer("".join(f" {text} " for text in lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first, second, third = (codes * factor for factor in _FACTORS)
    two = first[:-1] + second[1:]
    shift = np.uint64(64 - buckets.bit_length() + 1)
    found, owners = [], []
    for size, hashes in ((1, first), (2, two + _FACTORS[1]), (3, two[:-1] + third[2:])):
        last = len(codes) - size + 1
        good = letter[:last].copy()
        for ahead in range(1, size):
            good |= letter[ahead : last + ahead]
        if size > 1:
            good &= owner[:last] == owner[size - 1 :]
        found.append(((hashes[good] * _FACTORS[0]) >> shift).astype(np.int64))
        owners.append(owner[:last][good])
    has = np.bincount(owners[0], minlength=len(texts)) > 0
    return np.concatenate(found), np.concatenate(owners), has


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Numbers of first rows, and texts of about ``STEP_CHARS`` (nulls are empty)."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        value = text.as_py() or ""
        if held and size + len(value) > STEP_CHARS:
            yield first, held
            first, held, size = at, [], 0
        held.append(value)
        size += len(value)
    if held:
        yield first, held


# --- training -----------------------------------------------------------------------------------


def fold(id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Fold of a row; 0 (held out) where it has no id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


@dataclass
class Model:
    """Languages in alphabetical order, log probabilities (buckets, languages) and log shares of the languages."""

    languages: list[str]
    weights: np.ndarray
    shares: np.ndarray


def _counts(buckets: int):
    """Counts (lang, bucket, n) of one task; bucket -1 counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emptied():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                columns = [pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(counts[at])]
                yield pa.record_batch(columns, ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in _slices(batch.column(0)):
                found, owners, _ = grams(texts, buckets)
                names = langs[first : first + len(texts)]
                known = sorted(set(names))
                number = np.array([known.index(name) for name in names])
                for at, lang in enumerate(known):
                    counts = held.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                    counts[1:] += np.bincount(found[number[owners] == at], minlength=buckets)
                    counts[0] += names.count(lang)
                if len(held) > 64:
                    yield from emptied()
        yield from emptied()

    return run


def train(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    buckets: int = BUCKETS,
    folds: int = FOLDS,
    most: int = MOST,
) -> Model:
    """Learn from every labelled row outside fold 0."""
    rows = docs.where((fold(id, folds) != 0) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    labels = rows.select("lang").distinct()
    if len(labels.take(most + 1)) > most:
        raise ValueError(f"more than {most} languages; the model is bounded")
    counts = rows.mapInArrow(_counts(buckets), "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    matrix = np.zeros((buckets + 1, len(languages)))
    column = np.searchsorted(languages, table["lang"].to_pylist()) if languages else []
    matrix[table["bucket"].to_numpy() + 1, column] = table["n"].to_numpy()
    seen = matrix[1:] + SMOOTHING
    weights = np.log(seen / seen.sum(axis=0, keepdims=True)).astype(np.float32)
    return Model(languages, weights, np.log(np.maximum(matrix[0], 1) / max(1.0, matrix[0].sum())))


# --- prediction ---------------------------------------------------------------------------------


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the likeliest language and its posterior for each text, and whether the text has a letter."""
    found, owners, has = grams(texts, len(model.weights))
    keys, counts = np.unique(owners * len(model.weights) + found, return_counts=True)
    owner, bucket = keys // len(model.weights), keys % len(model.weights)
    sums = np.zeros((len(texts), len(model.languages)))
    if len(keys):
        heads = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        terms = model.weights[bucket] * counts[:, None]
        sums[owner[heads]] = np.add.reduceat(terms.astype(np.float64), heads, axis=0)
    sums += model.shares
    best = sums.argmax(axis=1)
    return best, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), has


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All columns of the documents, the predicted language and score, and if a third name is given, whether there is a letter.

    Where the table has a column of such a name already, the new one gets underscores before it.
    """
    names = tuple(free_name(docs, *names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, values, letters = [], [], []
            for _, texts in _slices(batch.column(place)):
                if model.languages:
                    best, score, has = scores(model, texts)
                    letters += has.tolist()
                    langs += [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                    values.append(np.where(has, score, 0.0))
                else:
                    letters += grams(texts, len(model.weights))[2].tolist()
                    langs += [UNKNOWN] * len(texts)
                    values.append(np.zeros(len(texts)))
            values = np.concatenate(values) if values else np.zeros(0)
            made = [pa.array(langs, pa.string()), pa.array(values, pa.float64()), pa.array(letters, pa.bool_())]
            yield pa.record_batch([*batch.columns, *made[: len(names)]], [*batch.schema.names, *names])

    fields = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a letter, with all their columns, also where no language could be learned."""
    names = free_name(docs, "lang_pred", "score", "letter")
    found = predict(docs, train(docs, id, text, lang), text, tuple(names))
    return found.where(F.col(names[2])).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents; one fold of five is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
