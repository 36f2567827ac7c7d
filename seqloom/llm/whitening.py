"""Operator 12: whitening of embeddings by Jacobi-Davidson.

Components of the covariance V of a fit list (each distinct integer vector once) are found without V: the only
thing asked of the rows is the product of V with a block of up to ``components + GUARD`` vectors, for which every
partition centres its rows, multiplies them and sums up. Products are blocks of dimensions by vectors, so what
the driver holds does not grow with the rows.

1. A random orthonormal block starts the search space. Each round diagonalizes V inside the space
   (Rayleigh-Ritz) and takes the residuals of the leading Ritz pairs.
2. Pairs whose residual is down to double precision are locked, the leading one first, and all that follows is
   kept orthogonal to them.
3. For each open pair (theta, u) the correction equation (I - PP')(V - theta I)(I - PP') t = -r, with P the
   locked vectors and u, is solved roughly by MINRES. The equations of a round step together, so a step is
   one distributed product for all. The solutions extend the space, which restarts from its leading Ritz
   vectors when it is full (Sleijpen and van der Vorst, SIAM J. Matrix Anal. Appl. 17, 1996).
4. When all are locked, a last Rayleigh-Ritz among them orders the pairs.

Fit list, sums and deviations are whole numbers and exact: n * x - S is formed before anything is divided.
Rows are held as packed blocks of bounded size, written once; a lost executor's blocks are read again.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry or one of 2^31 or more in
size after scaling take no part, nor do those whose length isn't the most frequent one (of equals the larger).
Repeated rows and ids each have their result, a null id too. Components whose eigenvalue is not
above 1e-12 of all variance can't be told from rounding and are left out, so equal vectors, a single one and an
empty table give no rows. A deviation beyond the range of a long is null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, stored, table

SCALE, COMPONENTS, SEED = 256, 4, 12
#: Residuals count as zero below this part of the largest Ritz value.
TOLERANCE = 64 * np.finfo(float).eps
#: Rounds at most, steps of MINRES at most, pairs beyond those wanted that are corrected too, those that a restarted space keeps, and its largest size.
ROUNDS, STEPS, GUARD, SPARE, SPACE = 200, 4, 8, 8, 64
#: Numbers that a packed block holds.
CELLS = 1 << 18
LEAST_SHARE = 1e-12


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) of the vectors that take part."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda c: F.coalesce((F.abs(c) < float("inf")) & (F.abs(c * scale) < float(2**31)), F.lit(False))
    whole = named.filter((F.size("v") > 0) & F.forall("v", fine)).select("id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
    most = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).limit(1)
    return whole.join(F.broadcast(most.select("d")), F.size("x") == F.col("d"), "left_semi")


def _pack(batches):
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            size = max(1, CELLS // x.shape[1])
            parts = [x[at : at + size] for at in range(0, len(x), size)]
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int32()), pa.array([np.ascontiguousarray(p, "<i4").tobytes() for p in parts], pa.binary())], ["n", "xs"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as int64 where that holds it, else as Python's integers."""
    wide = max(n * 2**31, *map(abs, sums)) >= 2**62
    return x.astype(object if wide else np.int64) * n - np.array(sums, object if wide else np.int64)


def _summed(blocks: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of part(x) over all packed blocks, where x are the rows of one; added up by Spark place by place."""

    def run(batches):
        total = None
        for batch in batches:
            for n, xs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = part(np.frombuffer(xs.as_buffer(), "<i4").reshape(n, -1)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    rows = blocks.mapInArrow(run, f"place int, value {kind}").groupBy("place")
    total = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "long" else F.sum("value")
    out = np.zeros(shape, object if kind == "long" else float)
    for r in rows.agg(total.alias("value")).collect():
        out.flat[r["place"]] = int(r["value"]) if kind == "long" else r["value"]
    return out


@dataclass
class FitList:
    """The distinct vectors: packed blocks, their number and the sums of each dimension."""

    blocks: DataFrame
    n: int
    sums: list[int]

    @classmethod
    def of(cls, rows: DataFrame) -> FitList | None:
        blocks = stored(rows.select("x").distinct().mapInArrow(_pack, "n int, xs binary"), "whitening-fit")
        one = blocks.select(F.sum("n"), F.max(F.length("xs") / F.col("n"))).first()
        if not one[0]:
            return None
        sums = _summed(blocks, (int(one[1]) // 4,), lambda x: x.sum(0, dtype=np.int64), "long")
        return cls(blocks, int(one[0]), [int(s) for s in sums])

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (centred(x, n, sums) / n).astype(float)

    def variances(self) -> np.ndarray:
        to, n = self.centre(), self.n
        return _summed(self.blocks, (len(self.sums),), lambda x: (to(x) ** 2).sum(0), "double") / n

    def product(self, block: np.ndarray) -> np.ndarray:
        """V times a block of vectors."""
        to = self.centre()

        def part(x):
            z = to(x)
            return z.T @ (z @ block)

        return _summed(self.blocks, block.shape, part, "double") / self.n

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Of the rows' coordinates, centred at their own mean."""
        to, k = self.centre(), projection.shape[1]
        mean = _summed(self.blocks, (k,), lambda x: (to(x) @ projection).sum(0), "double") / self.n

        def part(x):
            w = to(x) @ projection - mean
            return w.T @ w

        return _summed(self.blocks, (k, k), part, "double") / self.n


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """A basis of what the block adds to orthonormal vectors; directions that vanish are left out."""
    for _ in range(2):
        for q in against:
            block = block - q @ (q.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-8]
    return block


def _minres(product, theta: np.ndarray, away: list[np.ndarray], right: np.ndarray, tolerance: float, steps: int) -> np.ndarray:
    """Rough solutions of the projected equations, one a column, by minimal residuals; a step is one product."""

    def projected(block):
        return np.stack([c - q @ (q.T @ c) for c, q in zip(block.T, away, strict=True)], 1)

    def applied(block):
        return projected(product(block) - block * theta)

    dot = lambda a, b: (a * b).sum(0)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    r = projected(right)
    goal, x, p = tolerance * np.linalg.norm(r, axis=0), np.zeros_like(r), r.copy()
    s = applied(p)
    before: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step = ratio(dot(r, s), dot(s, s))
        x, r = x + step * p, r - step * s
        if (np.linalg.norm(r, axis=0) <= goal).all():
            break
        before = [(p, s), *before[:1]]
        p, s = s, applied(s)
        for old_p, old_s in before:
            beta = ratio(dot(s, old_s), dot(old_s, old_s))
            p, s = p - beta * old_p, s - beta * old_s
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = SEED, tolerance: float = TOLERANCE, space: int = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) of a symmetric d by d matrix that is known by its products with
    blocks of vectors, and their unit vectors as columns."""
    wanted = min(wanted, d)
    locked, largest = np.zeros((d, 0)), 0.0
    basis = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, wanted + SPARE))))
    image = product(basis)
    for turn in range(ROUNDS):
        inner = basis.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = basis @ y, image @ y
        largest = max(largest, abs(theta[0]))
        residual = image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        done = 0
        while locked.shape[1] + done < wanted and done < len(theta) and norms[done] <= tolerance * largest:
            done += 1
        locked = np.concatenate([locked, ritz[:, :done]], 1)
        if locked.shape[1] == wanted:
            break
        theta, ritz, image, residual, norms = theta[done:], ritz[:, done:], image[:, done:], residual[:, done:], norms[done:]
        if basis.shape[1] >= space:
            keep = wanted - locked.shape[1] + SPARE
            ritz, image, theta, residual, norms = ritz[:, :keep], image[:, :keep], theta[:keep], residual[:, :keep], norms[:keep]
        asked = [j for j in range(min(wanted - locked.shape[1] + GUARD, len(theta))) if norms[j] > tolerance * largest]
        away = [np.concatenate([locked, ritz[:, [j]]], 1) for j in asked]
        new = _minres(product, theta[asked], away, -residual[:, asked], max(0.01, 0.5 ** (turn + 1)), STEPS) if asked else np.zeros((d, 0))
        new = orthonormal(new, locked, ritz)
        if not new.shape[1]:  # nothing new in reach of the corrections: any other direction
            new = orthonormal(np.random.default_rng([seed, turn]).standard_normal((d, 1)), locked, ritz)
        basis, image = ritz, image
        if new.shape[1]:
            basis, image = np.concatenate([basis, new], 1), np.concatenate([image, product(new)], 1)
    else:
        raise ArithmeticError(f"{wanted - locked.shape[1]} of {wanted} components did not converge in {ROUNDS} rounds")
    inner = locked.T @ product(locked)
    theta, y = np.linalg.eigh((inner + inner.T) / 2)
    return theta[::-1], (locked @ y)[:, ::-1]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row per vector that takes part and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    n: vectors of the fit list; deviation: the sum of squares of n * x - S; whitened: x less the mean, on the component,
    over the root of its eigenvalue; explained: the eigenvalue's share of all variance; identity_error: the largest
    difference between the covariance of the whitened fit list and the identity.
    """
    return settled(vectors.sparkSession, "whitened", lambda: _whitened(vectors, id_col, vector_col, components, scale, seed))


def _whitened(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int, seed: int) -> DataFrame:
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(integer_vectors(vectors, id_col, vector_col, scale), "whitening-rows")
    fit = FitList.of(rows)
    trace = float(fit.variances().sum()) if fit else 0.0
    if trace <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    values, directions = jacobi_davidson(fit.product, len(fit.sums), components, seed)
    held = values > LEAST_SHARE * trace
    values, directions = values[held], directions[:, held]
    projection = directions / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(projection) - np.eye(len(values))).max())
    n, sums, explained, k = fit.n, fit.sums, values / trace, len(values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            off = centred(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), n, sums)
            if off.dtype != object and len(sums) * int(np.abs(off).max()) ** 2 < 2**63:
                deviation = (off * off).sum(1)
            else:
                exact = (off.astype(object) ** 2).sum(1)
                deviation = [v if v < 2**63 else None for v in exact]
            w = (off / n).astype(float) @ projection
            repeated = lambda a: pa.array(a).take(pa.array(np.repeat(np.arange(batch.num_rows), k)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    repeated(batch.column(0)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(batch.num_rows * k, n, np.int64)),
                    repeated(pa.array(deviation, pa.int64())), pa.array(w.ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(batch.num_rows * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
