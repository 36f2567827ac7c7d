"""Operator 2: exact top-k search by columnar branch-and-bound.

Vectors are packed into blocks of up to ``BLOCK`` rows, column after column (vertical layout), while
they are read; nothing is grouped. The stated query vectors are packed likewise, copied to each of
G groups of candidate blocks, and joined to the blocks by group, so each pair of a query block and
a candidate block meets once, in a row of bounded size. G is about the square root of the number of
blocks (32 at least, or one a block): what is copied stays a small part of the work.

In a pair, scores accumulate over blocks of dimensions, those where the queries are largest first.
What a candidate can still gain or lose is bounded by Cauchy-Schwarz from the remaining mass of both
vectors; candidates whose upper bound is below the k-th best lower bound are compacted away (de
Vries et al., "Efficient k-NN Search on Vertically Decomposed Data", SIGMOD 2002). The best scores
of earlier pairs in the same task prune later ones.

Components are integers floor(scale * x). Where all products of a pair of vectors sum up below 2^53 its
scores are exact sums of doubles. Wider vectors are searched by the same bounds, widened by the rounding
error of their doubles; the survivors' scores are then taken in whole numbers and cut to the range of a
long. Vectors that are null or hold a null, infinite or undefined component take no part; vectors of
different lengths aren't compared. Every row is a candidate of its own, rows of equal id too; rows of the
query's id take no part in its search, and query rows of equal id are one query with the scores of all.
Ties go to the smaller id. Blocks hold fewer rows of long vectors, so that their bytes are bounded. An
empty table, or one without query ids, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, stored, table

K, SCALE, BLOCK, QUERY_BLOCK, DIMENSIONS = 5, 256, 4_096, 512, 8
#: Components that a block holds.
CELLS = 1 << 22
_BLOCKS = "dim int, wide boolean, n int, ids binary, cols binary"


def _pack(scale: int, block: int):
    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            by_dim: dict[tuple[int, bool], list] = {}
            offsets = np.asarray(lists.offsets) if len(lists) else np.zeros(1, np.int32)
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null -> nan
            valid, known = np.asarray(lists.is_valid()), np.asarray(ids.is_valid())
            for i in range(len(lists)):
                v = values[offsets[i] : offsets[i + 1]]
                if valid[i] and known[i] and np.isfinite(v).all():
                    v = np.floor(scale * v)
                    wide = bool(len(v) and len(v) * np.abs(v).max() ** 2 >= 2.0**53)
                    by_dim.setdefault((len(v), wide), []).append((ids[i].as_py(), v))
            out = []
            for (dim, wide), rows in by_dim.items():
                size = max(1, min(block, CELLS // max(1, dim)))
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    cols = np.array([v for _, v in part]).reshape(len(part), dim).T
                    out.append((dim, wide, len(part), np.array([x for x, _ in part], np.int64).tobytes(), np.ascontiguousarray(cols, np.float64 if wide else np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))], ["dim", "wide", "n", "ids", "cols"])

    return run


def blocks(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.mapInArrow(_pack(scale, block), _BLOCKS)


def search_block(q: np.ndarray, own: int, cols: np.ndarray, ids: np.ndarray, order: np.ndarray, left: np.ndarray, first: np.ndarray, k: int, floor: float, error: float = 0.0, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that can be among the k best of query q, with scores; at least those are kept
    whose score reaches ``floor`` and is among the k best here.

    left[s]: the candidates' remaining mass after s blocks of dimensions; first: scores after one.
    error: what a computed score may be wrong by, as a part of both vectors' lengths. Scores are compared
    as if cut to -most and most.
    """
    alive, score = np.flatnonzero(ids != own), None
    ordered = q[order]
    q_left = np.concatenate([np.cumsum((ordered**2)[::-1])[::-1], [0.0]])
    for s in range(1, len(left)):
        a, b = (s - 1) * DIMENSIONS, min(s * DIMENSIONS, len(q))
        score = first[alive] if s == 1 else score + ordered[a:b] @ cols[a:b, alive]
        slack = np.sqrt(q_left[b] * np.maximum(left[s][alive], 0)) * (1 + 1e-9) + 0.5 if b < len(q) else 0.0
        if error:
            slack = slack + error * np.sqrt(q_left[0] * left[0][alive]) + 1e-280
        if len(alive) > k:
            low = np.clip(score - slack, -most, most)
            least = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        else:
            least = floor
        held = np.clip(score + slack, -most, most) >= least
        if not held.all():
            alive, score = alive[held], score[held]
        if not len(alive):
            break
    return alive, score if score is not None else np.zeros(len(alive))


def _best(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, id)."""
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


_LONG = 2**63


def _scaled(cols: np.ndarray) -> tuple[np.ndarray, int]:
    """Vectors divided by a power of 2, so that squares of their sums are finite; and its exponent."""
    at = int(np.frexp(np.abs(cols).max())[1]) if cols.size else 0
    return np.ldexp(cols, -at), at


def _search(k: int):
    def run(frames):
        best: dict[int, list[tuple[int, int]]] = {}  # of the queries seen last in this task
        for f in frames:
            out_q, out_c, out_s = [], [], []
            for row in f.itertuples(index=False):
                dim = row.dim
                load = lambda data, wide, n: np.frombuffer(data, np.float64 if wide else np.int32).reshape(dim, n).astype(np.float64)  # noqa: B023, E731
                whole, asking = load(row.cols, row.wide, row.n), load(row.q_cols, row.q_wide, row.q_n)
                ids, asked = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                if len(best) > 50_000:
                    best.clear()
                wide = row.wide or row.q_wide
                (cols, up), (queries, q_up) = (_scaled(whole), _scaled(asking)) if wide else ((whole, 0), (asking, 0))
                unit = lambda x: float(np.ldexp(x, -up - q_up))  # a score in the units of this pair of blocks  # noqa: B023, E731
                error, most = ((dim + 8) * 2.0**-51, unit(2.0**63)) if wide else (0.0, np.inf)
                order = np.argsort(-np.abs(queries).mean(1), kind="stable")
                cols = np.ascontiguousarray(cols[order])
                steps = -(-dim // DIMENSIONS)
                mass = np.array([(cols[s * DIMENSIONS : (s + 1) * DIMENSIONS] ** 2).sum(0) for s in range(steps)]).reshape(steps, len(ids))
                left = np.concatenate([np.cumsum(mass[::-1], 0)[::-1], np.zeros((1, len(ids)))])
                first = queries[order[:DIMENSIONS]].T @ cols[:DIMENSIONS]
                for j, own in enumerate(asked.tolist()):
                    known = best.get(own, [])
                    floor = float(known[-1][0]) if len(known) == k else -np.inf
                    if wide and len(known) == k:
                        floor = unit(floor) - abs(unit(floor)) * 1e-12
                    rows, scores = search_block(queries[:, j], own, cols, ids, order, left, first[j], k, floor, error, most)
                    if wide:
                        q = [int(x) for x in asking[:, j]]
                        exact = [sum(x * int(y) for x, y in zip(q, whole[:, r], strict=True)) for r in rows]
                        scores = [min(max(x, -_LONG), _LONG - 1) for x in exact]
                    else:
                        scores = scores.astype(np.int64).tolist()
                    found = _best(list(zip(scores, ids[rows].tolist(), strict=True)), k)
                    best[own] = _best(known + found, k)
                    for s, x in found:
                        out_q.append(own), out_c.append(x), out_s.append(s)
            yield pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_c, np.int64), "score": np.array(out_s, np.int64)})

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest inner products with other rows."""
    return settled(vectors.sparkSession, "topk", lambda: _top_k(vectors, is_query, id_col, vector_col, k, scale, block))


def _top_k(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, scale: int, block: int) -> DataFrame:
    candidates = stored(blocks(vectors, id_col, vector_col, scale, block), "topk-blocks")
    n_blocks = candidates.count()
    groups = max(1, min(n_blocks, max(32, round(n_blocks**0.5))))
    asked = vectors.filter(is_query).select(id_col, vector_col)
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = blocks(asked.repartition(parts, id_col), id_col, vector_col, scale, QUERY_BLOCK)
    queries = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("wide", "n", "ids", "cols")])
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = candidates.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).join(queries, ["dim", "g"])
    found = pairs.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
