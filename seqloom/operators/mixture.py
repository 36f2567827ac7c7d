"""Three-class mixture over segment features, its labels, and the stability of its assignments.

Fits run as Spark aggregations: each round every partition reduces its rows to sufficient statistics of
all models that are still moving, and the driver updates the few parameters from their sums. The
leave-one-out fits of the jackknife share the passes of the full fit, so a pass reads the rows once for
all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import COMMODITY, NAME, TITLE
from ..storage import clearing, stored
from .lexicon import MIXTURE_FEATURES, robust_scale
from .stats import percentiles
from .variational import matrices, packed, vectors

K, MAX_ROUNDS, TOLERANCE, LEAST_SIGMA = 3, 250, 1e-6, 1e-4
PROTOTYPES = 10
LABELS = [COMMODITY, TITLE, NAME]


@dataclass
class Mixture:
    mu: np.ndarray  # components by features
    sigma: np.ndarray
    pi: np.ndarray
    loglik: float = -1e300
    left_out: int = -1  # the row that this fit leaves out
    moving: bool = True


def scaled_rows(matrix: DataFrame) -> DataFrame:
    """row (from 0, by seg_id), seg_key, seg_id, freq, x: features in the mixture's order, robustly scaled."""
    scaled = robust_scale(matrix.withColumn("freq_", F.col("freq")), MIXTURE_FEATURES, ["seg_key", "seg_id", F.col("freq_").alias("freq_raw")])
    row = F.regexp_extract("seg_id", r"(\d+)", 1).cast("long") - 1
    return scaled.select(row.alias("row"), "seg_key", "seg_id", F.col("freq_raw").alias("freq"), F.array(*MIXTURE_FEATURES).alias("x"))


def _shares(squares: list[np.ndarray], m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components in rows, and their log-likelihoods. squares: those of the rows less each component's mean."""
    joint = np.empty((len(squares[0]), K))
    for k in range(K):
        var = m.sigma[k] ** 2
        joint[:, k] = np.log(m.pi[k] + 1e-300) - 0.5 * np.log(2 * np.pi * var + 1e-300).sum() - 0.5 * (squares[k] @ (1 / (var + 1e-300)))
    top = joint.max(1, keepdims=True)
    norm = np.log(np.exp(joint - top).sum(1, keepdims=True)) + top
    return np.exp(joint - norm), norm[:, 0]


def _responsibilities(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    return _shares([(x - m.mu[k]) ** 2 for k in range(K)], m)


def _statistics(models: dict[int, Mixture]):
    """Partitions to rows (fit, place, value) of sums: log-likelihood, rows, then per component the
    responsibility, and its sums with x and with squares around the component's present mean."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for x, rows in matrices(batches, np.int64):
            for fit, m in models.items():
                out = rows == m.left_out if m.left_out >= 0 else None
                here = x[~out] if out is not None and out.any() else x
                if not len(here):
                    continue
                off = [here - m.mu[k] for k in range(K)]
                squares = [d * d for d in off]
                r, norm = _shares(squares, m)
                parts = [np.array([norm.sum(), len(here)])]
                for k in range(K):
                    parts += [np.array([r[:, k].sum()]), r[:, k] @ off[k], r[:, k] @ squares[k]]
                sums[fit] = sums.get(fit, 0) + np.concatenate(parts)
        fits = sorted(sums)
        values = [sums[f] for f in fits]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f for f, v in zip(fits, values, strict=True) for _ in v], pa.int32()),
                pa.array([i for v in values for i in range(len(v))], pa.int32()),
                pa.array([float(y) for v in values for y in v], pa.float64()),
            ],
            ["fit", "place", "value"],
        )

    return run


def _updated(m: Mixture, sums: np.ndarray, tolerance: float) -> None:
    loglik, n = sums[0], sums[1]
    d = m.mu.shape[1]
    parts = sums[2:].reshape(K, 1 + 2 * d)
    weight = parts[:, 0] + 1e-8
    m.pi = weight / n
    for k in range(K):
        # moments around the old mean; the new mean's own square is taken off
        first, second, total = parts[k, 1 : 1 + d], parts[k, 1 + d :], parts[k, 0]
        old = m.mu[k]
        new = (first + total * old) / weight[k]
        shift = new - old
        m.mu[k] = new
        m.sigma[k] = np.maximum(np.sqrt(np.maximum((second - 2 * shift * first + total * shift**2) / weight[k], 0)), LEAST_SIGMA)
    m.moving = abs(loglik - m.loglik) >= tolerance
    if m.moving:
        m.loglik = loglik


def _prototypes(matrix: DataFrame, scaled: DataFrame, spare: int) -> list[list[tuple[int, np.ndarray]]]:
    """For each component the rows that start it, best first, with ``spare`` more than needed."""
    orders = [
        [F.col("numeric_assoc").desc(), F.col("freq").desc(), "seg_id"],
        [F.col("coll_skew").desc(), F.col("start_prob").desc(), F.col("end_prob").desc(), "seg_id"],
        [F.col("H_total").desc(), F.col("freq"), "seg_id"],
    ]
    found = []
    for order in orders:
        ranked = matrix.orderBy(*order).limit(PROTOTYPES + spare).select("seg_key").collect()
        vectors = {r["seg_key"]: (r["row"], np.array(r["x"])) for r in scaled.filter(F.col("seg_key").isin([r["seg_key"] for r in ranked])).collect()}
        found.append([vectors[r["seg_key"]] for r in ranked])
    return found


def _start(prototypes, left_out: int) -> Mixture:
    mu, sigma = [], []
    for rows in prototypes:
        x = np.array([v for row, v in rows if row != left_out][:PROTOTYPES])
        mu.append(x.mean(0))
        sigma.append(x.std(0) + 1e-6)
    return Mixture(np.array(mu), np.array(sigma), np.full(K, 1 / K), left_out=left_out)


def fit(matrix: DataFrame, scaled: DataFrame, left_out: list[int] = (), rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> list[Mixture]:
    """The fit to all rows, then one for each row left out. The scaling is that of all rows."""
    prototypes = _prototypes(matrix, scaled, spare=1 if left_out else 0)
    models = [_start(prototypes, -1), *[_start(prototypes, r) for r in left_out]]
    with clearing(scaled.sparkSession):
        _moved(models, stored(packed(scaled, "x", "row"), "blocks"), rounds, tolerance)
    return models


def _moved(models: list[Mixture], rows: DataFrame, rounds: int, tolerance: float) -> None:
    """The models after rounds over rows, which are ``packed``."""
    for _ in range(rounds):
        now = {i: m for i, m in enumerate(models) if m.moving}
        if not now:
            break
        sums = rows.mapInArrow(_statistics(now), "fit int, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("value"))
        by_fit: dict[int, dict[int, float]] = {}
        for r in sums.collect():  # 77 numbers a model
            by_fit.setdefault(r["fit"], {})[r["place"]] = r["value"]
        for i, m in now.items():
            if i in by_fit:
                _updated(m, np.array([by_fit[i][p] for p in range(len(by_fit[i]))]), tolerance)
            else:
                m.moving = False


def component_labels(model: Mixture, matrix: DataFrame) -> list[str]:
    """The labels of components 0, 1, 2: each takes its best label of those left, in this order."""
    marks, most = percentiles(matrix, dict.fromkeys(MIXTURE_FEATURES, [0.25, 0.5, 0.75])), matrix.agg(F.max("freq")).first()[0]
    q = np.array([marks[c] for c in MIXTURE_FEATURES])
    spread = np.where(q[:, 2] - q[:, 0] < 1e-9, 1.0, q[:, 2] - q[:, 0])
    mu = model.mu * spread + q[:, 1]
    at = {c: i for i, c in enumerate(MIXTURE_FEATURES)}
    out: list[str] = []
    for k in range(K):
        common = mu[k, at["freq"]] / (most + 1e-9)
        scores = {
            COMMODITY: 0.6 * mu[k, at["numeric_assoc"]] + 0.4 * common,
            TITLE: 0.6 * mu[k, at["start_prob"]] + 0.4 * mu[k, at["coll_skew"]],
            NAME: 0.7 * mu[k, at["H_total"]] + 0.3 * (1 - common),
        }
        out.append(next(x for x, _ in sorted(scores.items(), key=lambda s: (-s[1], s[0])) if x not in out))
    return out


def assignments(scaled: DataFrame, models: list[Mixture]) -> DataFrame:
    """row, fit, component, r (array of responsibilities) for each model; the row a fit leaves out has none."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = vectors(batch.column(1)), batch.column(0).to_numpy()
            for i, m in enumerate(models):
                use = rows != m.left_out
                r = _responsibilities(x[use], m)[0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * K), pa.array(r.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(rows[use]), pa.array(np.full(len(r), i, np.int32)), pa.array(r.argmax(1).astype(np.int32)), lists], ["row", "fit", "component", "r"])

    return scaled.select("row", "x").mapInArrow(run, "row long, fit int, component int, r array<double>")


def labelled(matrix: DataFrame, scaled: DataFrame, model: Mixture) -> DataFrame:
    """seg_key, seg_id, freq, component, label, post_commodity, post_title, post_proper_name."""
    names = component_labels(model, matrix)
    found = scaled.drop("x").join(assignments(scaled, [model]), "row")
    label = F.array(*[F.lit(x) for x in names])[F.col("component")]
    return found.select("seg_key", "seg_id", "freq", "component", label.alias("label"), *[F.col("r")[names.index(x)].alias(f"post_{x}") for x in LABELS])


def left_out_rows(n: int, rounds: int, few: int = 200) -> list[int]:
    """Which rows the jackknife leaves out: all, the first, or evenly spaced ones."""
    if rounds >= n:
        return list(range(n))
    return list(range(rounds)) if n <= few else list(range(0, n, max(1, n // rounds)))[:rounds]


def agreement(scaled: DataFrame, models: list[Mixture]) -> DataFrame:
    """seg_key, stability: the share of fits that agree on a segment's most frequent component. A
    segment that a fit leaves out counts as disagreeing there."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = vectors(batch.column(1)), batch.column(0).to_numpy()
            votes = np.zeros((len(x), K), np.int64)
            for m in models:
                use = np.flatnonzero(rows != m.left_out)
                votes[use, _responsibilities(x[use], m)[0].argmax(1)] += 1
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(votes.max(1) / len(models))], ["seg_key", "stability"])

    return scaled.select("row", "x", "seg_key").mapInArrow(run, "seg_key string, stability double")


def stability(matrix: DataFrame, scaled: DataFrame, rounds: int = 40) -> DataFrame:
    """The agreement of the fit to all rows with those that leave one out."""
    return agreement(scaled, fit(matrix, scaled, left_out_rows(scaled.count(), rounds)))
