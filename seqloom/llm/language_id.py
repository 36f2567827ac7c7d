"""Operator 5: language identification by a string kernel.

The kernel is the blended-spectrum presence kernel: k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), G the
set of character n-grams of lengths 1 to 3 of the lower-cased text, in which what is no letter counts
as one space. N-grams of any script are hashed to ``_UNIVERSE`` numbers. A Nystroem map over landmark texts turns it into features, and one-versus-rest kernel
ridge regression over them gives a score per language. Scoring is two matrix products per batch: n-gram
presence by landmarks, and landmarks by languages.

The model is fitted on the driver on a bounded sample: about ``PER_LANGUAGE`` labelled rows of each
language and ``MOST_FITTED`` in all, those of smallest id hash, of texts of up to ``LONGEST_FITTED``
characters. Its size is bounded too: ``LANDMARKS`` texts over that universe, taken from the languages in
turn, so of more than 256 languages some have no landmark and are told by those of the others. Labels beyond the
1,000 most frequent ones are not learned. It is applied to every row and whole text.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; where no row can
be learned from, every row is; a null id counts as the empty string in the fold; repeated rows are
judged alike; ties go to the language that is first by code point; very long texts are read whole;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PER_LANGUAGE, MOST_FITTED, LONGEST_FITTED, LANDMARKS, RIDGE = 400, 4_000, 20_000, 256, 1e-3
FOLDS = 5
UNKNOWN = "und"
_GAP = 32
_UNIVERSE = 1 << 18
#: Odd factors of a multiplicative hash, one for each place of an n-gram and one for each length.
_PLACES, _LENGTHS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0x2545F491)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Grams:
    """Texts to the presence of their n-grams."""

    def __init__(self):
        self.is_letter = _letters()
        self.there = np.zeros(_UNIVERSE, bool)

    def presence(self, text: str | None) -> np.ndarray | None:
        """The sorted numbers of the text's n-grams; None if it has no letter."""
        points = _points(text or "")
        letter = self.is_letter[points]
        if not letter.any():
            return None
        # begins and ends with a gap, and gaps are single
        c = np.concatenate([[_GAP], np.where(letter, points, _GAP), [_GAP]]).astype(np.uint32)
        c = c[np.concatenate([[True], (c[1:] != _GAP) | (c[:-1] != _GAP)])]
        self.there[:] = False
        for n in (1, 2, 3):
            h = np.full(max(0, len(c) - n + 1), _LENGTHS[n - 1], np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + len(h)]) * np.uint32(_PLACES[k])
                h ^= h >> np.uint32(15)
            self.there[h % np.uint32(_UNIVERSE)] = True
        return np.flatnonzero(self.there)


@dataclass
class Model:
    grams: np.ndarray  # numbers of the n-grams of the landmarks
    landmarks: np.ndarray  # presence, n-grams by landmarks, scaled by 1 / sqrt(|G(z)|)
    weights: np.ndarray  # landmarks by languages
    languages: list[str]


def _kernel(present: list[np.ndarray], grams: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The kernel of texts, given by the numbers of their n-grams, with the landmarks."""
    place = np.full(_UNIVERSE, -1, np.int32)
    place[grams] = np.arange(len(grams))
    x = np.zeros((len(present), len(grams)), np.float32)
    for i, p in enumerate(present):
        at = place[p]
        x[i, at[at >= 0]] = 1 / np.sqrt(len(p))
    return x @ landmarks


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of bounded size; None if there is nothing to learn from."""
    grams_of = Grams()
    known = [(p, y) for t, y in zip(texts, labels, strict=True) if (p := grams_of.presence(t)) is not None]
    if not known:
        return None
    present, y = [p for p, _ in known], np.array([y for _, y in known])
    languages = sorted(set(y.tolist()))
    # landmarks are taken from the languages in turn
    turns = sorted(range(len(y)), key=lambda i: (int((y[:i] == y[i]).sum()), y[i]))
    marks = [present[i] for i in turns[:landmarks]]
    grams = np.unique(np.concatenate(marks))
    place = np.full(_UNIVERSE, -1, np.int32)
    place[grams] = np.arange(len(grams))
    z = np.zeros((len(grams), len(marks)), np.float32)
    for j, p in enumerate(marks):
        z[place[p], j] = 1 / np.sqrt(len(p))
    k = _kernel(present, grams, z).astype(np.float64)
    values, vectors = np.linalg.eigh(_kernel(marks, grams, z).astype(np.float64))
    root = vectors @ np.diag(np.where(values > 1e-8, 1 / np.sqrt(np.maximum(values, 1e-8)), 0)) @ vectors.T
    phi = k @ root
    target = np.where(y[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(y) * np.eye(len(marks)), phi.T @ target)
    return Model(grams, z, (root @ w).astype(np.float32), languages)


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on the sample described above, without the rows of the held-out fold."""
    text = F.col(text_col).cast("string")
    known = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.length(text).between(1, LONGEST_FITTED))
    known = known.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(1_000).collect()}
    if not counts:
        return None
    # the hash is uniform, so each language keeps about per_language rows
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    kept = known.filter(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30))
    rows = kept.orderBy("h", "lang", "text").limit(MOST_FITTED).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


_BATCH = 256


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        grams_of = Grams()
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                present = [grams_of.presence(t.as_py()) if m else None for t in batch.column(2)]
                rows = [i for i, p in enumerate(present) if p is not None]
                langs, scores = [UNKNOWN] * len(present), [0.0] * len(present)
                if rows:
                    f = _kernel([present[i] for i in rows], m.grams, m.landmarks) @ m.weights
                    for i, best, value in zip(rows, f.argmax(1), f.max(1), strict=True):
                        langs[i], scores[i] = m.languages[best], float(min(1.0, max(0.0, (value + 1) / 2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return given.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in which no language is found; all columns as they came.

    The verdict is computed next to the row it belongs to, so nothing is joined. Where nothing could
    be learned, rows with letters stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col))

    @F.pandas_udf("string")
    def language(texts):
        m = shared.value
        grams_of = Grams()
        out = [UNKNOWN] * len(texts)
        for at in range(0, len(texts), _BATCH):
            present = [grams_of.presence(t) for t in texts.iloc[at : at + _BATCH]]
            rows = [i for i, p in enumerate(present) if p is not None]
            for i in rows:
                out[at + i] = ""
            if rows and m:
                best = (_kernel([present[i] for i in rows], m.grams, m.landmarks) @ m.weights).argmax(1)
                for i, b in zip(rows, best, strict=True):
                    out[at + i] = m.languages[b]
        return texts.__class__(out, index=texts.index)

    return docs.filter(language(F.col(text_col).cast("string")) != UNKNOWN)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).withColumnRenamed("id", "doc_id")
