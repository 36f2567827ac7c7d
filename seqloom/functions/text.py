"""Scalar functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import SecondText

TITLE, COMMODITY, NAME, UNKNOWN = "title", "commodity", "proper_name", "unknown"

# Weights (length, structure, semantics, class) of a segment's class, the suffixes that
# favour a word for a class, and the verb stems and noun endings of the target language.
CLASS_WEIGHTS = {
    TITLE: (0.25, 0.20, 0.25, 0.30),
    COMMODITY: (0.35, 0.30, 0.20, 0.15),
    NAME: (0.25, 0.20, 0.35, 0.20),
    UNKNOWN: (0.30, 0.25, 0.25, 0.20),
}
CLASS_SUFFIXES = {
    TITLE: ["ar", "karar", "nāyakan", "mudaliar", "rājan"],
    NAME: ["vel", "an", "al"],
    COMMODITY: ["am", "vu", "mai"],
}
VERB_STEMS = "(kiṟ|viṭṭ|pōn|varu|iru|seyy)"
NOUN_ENDINGS = "(il|in|ai|ku|kku|am|vu|mai)$"


def safe_log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalize_text(text: Column) -> Column:
    """Lower case; only Tamil script, ASCII letters and digits; single blanks; null is empty."""
    lowered = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    kept = F.regexp_replace(lowered, r"(?U)[^\x{0B80}-\x{0BFF}a-zA-Z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def entropy_similarity(a: Column, b: Column) -> Column:
    """1 less the relative difference of two lengths; where one isn't positive, whether they are equal."""
    apart = F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(F.abs(a - b), F.greatest(a, b)))
    return F.when((a <= 0) | (b <= 0), (a == b).cast("double")).otherwise(apart)


def bucket_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def structure_similarity(sequence: Column, word: Column) -> Column:
    parts = F.size(F.filter(F.split(sequence, ","), lambda p: F.trim(p) != ""))
    return entropy_similarity(parts, bucket_of(normalize_text(word)))


def class_weight(label: Column, part: int) -> Column:
    chosen = F.when(F.lit(False), F.lit(0.0))
    for name, weights in CLASS_WEIGHTS.items():
        if name != UNKNOWN:
            chosen = chosen.when(F.lower(F.coalesce(label, F.lit(""))) == name, F.lit(weights[part]))
    return chosen.otherwise(F.lit(CLASS_WEIGHTS[UNKNOWN][part]))


def linguistic_weight(word: Column, label: Column, fold_diacritics: bool = False) -> Column:
    """1.1 for each suffix of the class that the word has, 0.9 for two characters or fewer, within 0.75 to 1.25.

    Words lose letters with diacritics when they are normalized, so suffixes with some never fit; with
    ``fold_diacritics`` the suffixes lose their marks and do.
    """
    w = normalize_text(word)
    factor = F.lit(1.0)
    for name, suffixes in CLASS_SUFFIXES.items():
        for s in suffixes:
            if fold_diacritics:
                s = without_marks(s)
            factor = factor * F.when((label == name) & w.endswith(s), F.lit(1.1)).otherwise(F.lit(1.0))
    factor = factor * F.when(F.length(w) <= 2, F.lit(0.9)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.75), F.least(F.lit(1.25), factor))


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no function for that."""
    return text.map(without_marks, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("literal", T.DoubleType()), T.StructField("phonetic", T.DoubleType())]))
def text_similarities(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Ratio of matching characters by longest matching blocks, of the texts and of the texts without marks.

    Not symmetric; no Spark function equals it. To be called on distinct pairs. The index of a second text is
    made once for all first texts that meet it, and texts without marks are compared once.
    """
    indexed: dict[str, SecondText] = {}

    def ratio(x: str, y: str) -> float:
        m = indexed.get(y)
        if m is None:
            if len(indexed) >= _INDEXED:
                indexed.clear()
            m = indexed[y] = SecondText(y)
        return m.ratio(x)

    plain = {x: without_marks(x) for x in {*a.dropna(), *b.dropna()}}
    rows = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            rows.append((None, None))
            continue
        literal = ratio(x, y)
        rows.append((literal, literal if plain[x] == x and plain[y] == y else ratio(plain[x], plain[y])))
    return pd.DataFrame(rows, columns=["literal", "phonetic"], dtype="float64")


def sequence_similarity(a: Column | str, b: Column | str) -> Column:
    return text_similarities(a, b)["literal"]


#: Indexes of second texts that a batch keeps.
_INDEXED = 2_000


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation (Abramowitz & Stegun 7.1.26, error
    below 2e-7), since Spark has no error function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    erf = 1 - tail
    return F.when(z == 0, F.lit(0.5)).when(z > 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


#: Roles of the classes in a sentence pattern.
ROLES = {NAME: "S", TITLE: "V", COMMODITY: "O"}


def svo_pattern(labels: Column) -> Column:
    """An array of class labels as a string of S, V, O and ``?``."""

    def role(label: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit("?"))
        for name, r in ROLES.items():
            chosen = chosen.when(label == name, F.lit(r))
        return chosen.otherwise(F.lit("?"))

    return F.array_join(F.transform(labels, role), "")


def numeric_like(tokens: Column) -> Column:
    """One token of 0 to 200, or two of 0 to 50."""
    one = (F.size(tokens) == 1) & F.get(tokens, F.lit(0)).between(0, 200)
    two = (F.size(tokens) == 2) & F.forall(tokens, lambda t: t.between(0, 50))
    return F.coalesce(one | two, F.lit(False))


def sentence(words: Column) -> Column:
    """Words (normalized, empty ones left out) as a sentence: words of two characters or fewer are glued to
    the one before, then nouns, verbs and particles follow each other, equal neighbours fall together and
    the first letter is upper case."""
    given = F.transform(F.filter(words, lambda w: F.coalesce(w, F.lit("")) != ""), normalize_text)
    # glued into one string with a separator, which is cheaper than arrays that grow
    glued = F.aggregate(given, F.lit(""), lambda acc, w: F.when((F.length(w) <= 2) & (acc != ""), F.concat(acc, w)).otherwise(F.concat(acc, F.lit("\n"), w)))
    merged = F.split(F.substring(glued, 2, 1_000_000_000), "\n")
    verb, noun = (lambda w: w.rlike(VERB_STEMS)), (lambda w: ~w.rlike(VERB_STEMS) & w.rlike(NOUN_ENDINGS))
    ordered = F.concat(F.filter(merged, noun), F.filter(merged, verb), F.filter(merged, lambda w: ~verb(w) & ~noun(w)))
    single = F.filter(ordered, lambda w, i: (i == 0) | (w != F.get(ordered, i - 1)))
    joined = F.trim(F.array_join(single, " "))
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1_000_000_000))
