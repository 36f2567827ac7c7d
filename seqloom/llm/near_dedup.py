"""Operator 7: near-duplicate documents by SetSketch registers.

A document's set is that of its distinct 5-word shingles; two documents are linked when
``100 * |a & b| >= percent * |a | b|``. Rows of equal sets form a class. Rows are told apart by a number
that follows from file and place, and a class is compared by its row of smallest number:

1. Each class gets 160 SetSketch registers. Bands of 5 registers are hashed to bucket keys; a pair
   at similarity 0.85 shares none of the 32 bands with a chance of 7e-9, one at 0.8 with 3e-6.
2. In each bucket every member meets the bucket's hub, its smallest number. A joint likelihood of the
   registers rules pairs out only where the threshold is implausible; the others are confirmed or refused on
   the full sets. A group of copies is thereby linked with as many pairs as it has members.
3. Buckets that still hold several components go on: members that are not in the bucket's largest
   component meet all members of other components. Buckets of up to ``SMALL_BUCKET`` members do so
   by a self-join; larger ones in blocks of ``CHUNK`` members a side, compared inside the task, of
   which only links and pairs of long documents come out. A pair is compared in its first shared
   band only. Nothing is capped.
4. The links' connected components are found by alternating stars.

Sets of up to ``SHORT_SET`` shingles travel with the registers; larger sets are joined in for the
pairs that the registers leave open.

Cost of step 3: members outside a bucket's largest component times the bucket. It is small where
copies resemble their hub, and grows with the square only for large families whose members lie just
below the threshold, which an exact answer has to compare.

Two readings of the result: ``near_duplicates`` takes rows of equal id for one document, which has the links of
all of them, and names a group by its smallest id; ``dropped_near_duplicates`` takes every row for a document and
keeps the one of smallest id, and of equal ids the one of smallest number, of each group.

Defined cases: a text that is null, empty or white space has an empty set and no links; documents with fewer than five
words count their whole sequence as one shingle; a row of null id links nothing: its component is that of the rows of an
equal set, or none, it is not kept in op7, and it stays in ``dropped_near_duplicates``; an empty table gives an empty result;
rows that come from no file are written first; further columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, of_files, settled, stored, table, with_row_number
from .components import connected_components
from .setsketch import BANDS, REGISTERS, ROWS_PER_BAND, WordHashes, counts_of_pairs, fewest_equal, intersections, likely, linked, registers, shingles

PERCENT = 85
SHORT_SET, SMALL_BUCKET, CHUNK = 256, 32, 512
#: Numbers of candidates (8 bytes each) are broadcast up to this count, beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Blocks that a task compares, and the most tasks they are dealt to.
BLOCKS_PER_TASK, MOST_TASKS = 4, 20_000
LINK, OPEN = 1, 2


def _sketch(batches):
    hashes = WordHashes()
    for batch in batches:
        n, digests, sketches = [], [], []
        for text in batch.column(2):
            s = shingles(text.as_py(), hashes)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["row", "id", "n", "digest", "regs"])


def _sets(batches):
    hashes = WordHashes()
    for batch in batches:
        n, sketches, short, full = [], [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py(), hashes)
            n.append(len(s))
            sketches.append(registers(s).tobytes() if len(s) else None)
            short.append(s.tobytes() if len(s) <= SHORT_SET else None)
            full.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(short, pa.binary()), pa.array(full, pa.binary())], ["id", "n", "regs", "short", "full"])


def _matrix(regs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _decide(percent: int):
    """Pairs with registers and short sets -> links, and pairs left open."""

    def run(frames):
        for f in frames:
            if f.empty:
                continue
            equal, more = counts_of_pairs(_matrix(f["regs_u"]), _matrix(f["regs_v"]))
            f = f[likely(equal, more, f["n_u"].to_numpy(float), f["n_v"].to_numpy(float), percent / 100)]
            state = [OPEN if a is None or b is None else LINK if linked(_set(a), _set(b), percent) else 0 for a, b in zip(f["short_u"], f["short_v"], strict=True)]
            out = pd.DataFrame({"u": f["u"], "v": f["v"], "state": np.array(state, np.int32)})
            yield out[out["state"] > 0]

    return run


def _confirm(percent: int):
    def run(frames):
        for f in frames:
            ok = [linked(_set(a), _set(b), percent) for a, b in zip(f["full_u"], f["full_v"], strict=True)]
            yield f.loc[np.array(ok, bool), ["u", "v"]]

    return run


def _block(percent: int):
    """Compares two chunks of a bucket, or one with itself, across components.

    Pairs that the joint likelihood makes implausible at any sizes have too few equal registers and go; the
    others that are not told apart by an earlier band are confirmed together, by one product of the chunks'
    incidence with their common shingles. Links come out as a forest.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        p, q, band = f["p"].iloc[0], f["q"].iloc[0], f["band"].iloc[0]
        left, right = f[f["c"] == p].reset_index(drop=True), f[f["c"] == q].reset_index(drop=True)
        a, b = _matrix(left["regs"]), _matrix(right["regs"])
        ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
        of_a, of_b = left["component"].to_numpy(), right["component"].to_numpy()
        n_a, n_b = left["n"].to_numpy(float), right["n"].to_numpy(float)
        long_a, long_b = left["short"].isna().to_numpy(), right["short"].isna().to_numpy()
        least = fewest_equal(percent / 100)

        at_a, at_b = [], []
        for i in range(len(left)):
            others = np.flatnonzero((of_b != of_a[i]) & (ids_b > ids_a[i] if p == q else ids_b != ids_a[i]) & (np.minimum(n_b, n_a[i]) * 100 >= percent * np.maximum(n_b, n_a[i])))
            if not len(others):
                continue
            same = a[i] == b[others]
            before = same[:, : band * ROWS_PER_BAND].reshape(len(others), band, ROWS_PER_BAND).all(2).any(1)
            held = others[~before & (same.sum(1) >= least)]
            at_a.append(np.full(len(held), i))
            at_b.append(held)
        none = np.zeros(0, int)
        i, k = np.concatenate([none, *at_a]), np.concatenate([none, *at_b])

        far = long_a[i] | long_b[k]  # whose sets are not here
        equal, more = counts_of_pairs(a[i[far]], b[k[far]])
        likely_far = likely(equal, more, n_a[i[far]], n_b[k[far]], percent / 100)
        found = [(ids_a[x], ids_b[y], OPEN) for x, y in zip(i[far][likely_far], k[far][likely_far], strict=True)]

        i, k = i[~far], k[~far]
        if len(i):
            rows_a, rows_b = np.unique(i), np.unique(k)
            common = intersections([_set(left["short"].iat[x]) for x in rows_a], [_set(right["short"].iat[y]) for y in rows_b])
            both = common[np.searchsorted(rows_a, i), np.searchsorted(rows_b, k)]
            ok = 100 * both >= percent * (n_a[i] + n_b[k] - both)
            root: dict[int, int] = {}

            def find(x):
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            for x, y in zip(i[ok].tolist(), k[ok].tolist(), strict=True):
                one, two = find(int(of_a[x])), find(int(of_b[y]))
                if one != two:
                    found.append((ids_a[x], ids_b[y], LINK))
                    root[max(one, two)] = min(one, two)
        return pd.DataFrame(found, columns=["u", "v", "state"]).astype({"u": "int64", "v": "int64", "state": "int32"})

    return run


def _paired(pairs: DataFrame, payload: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(payload.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _links(states: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """states (u, v, state) -> the confirmed links (u, v)."""
    states = stored(states, "near-states")
    open_pairs = _paired(states.filter(F.col("state") == OPEN).select("u", "v").distinct(), payload, ["full"])
    confirmed = open_pairs.select("u", "v", "full_u", "full_v").mapInPandas(_confirm(percent), "u long, v long")
    return states.filter(F.col("state") == LINK).select("u", "v").unionByName(confirmed)


def _n_chunks() -> tuple:
    """x, y: how many chunks hold a bucket's members apart from its largest component, and that component's."""
    size = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("int")
    return size(F.col("apart")).alias("x"), size(F.col("size") - F.col("apart")).alias("y")


def _chunks(rest: DataFrame) -> DataFrame:
    """Members of large buckets, once for each pair of chunks (p, q) that they take part in.

    Chunks of members outside the largest component come first; they meet each other and the
    chunks of the largest component, which do not meet one another.
    """
    apart = F.col("component") != F.col("main")
    dealt = rest.select("key", "band", "id", "component", *_n_chunks(), apart.alias("out"))
    dealt = dealt.withColumn("c", F.when(F.col("out"), F.pmod(F.xxhash64("id"), F.col("x"))).otherwise(F.col("x") + F.pmod(F.xxhash64("id"), F.col("y"))).cast("int"))
    meets = F.when(F.col("out"), F.expr("sequence(0, x + y - 1)")).otherwise(F.expr("sequence(0, x - 1)"))
    dealt = dealt.withColumn("o", F.explode(meets))
    return dealt.select("key", "band", "id", "component", "c", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, broadcast_ids: int = BROADCAST_IDS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of docs: id, n_shingles, component, the smallest id that links reach."""
    return settled(docs.sparkSession, "near-duplicates", lambda: _documents(_groups(docs, id_col, text_col, percent, broadcast_ids, small_bucket)))


def _documents(rows: DataFrame) -> DataFrame:
    """Rows (row, id, n, component) -> id, n_shingles, component by id: groups that share an id are one."""
    rows = stored(rows, "near-rows")
    per = rows.filter("component IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    per = stored(per, "near-ids")
    several = per.filter("low <> high")
    if several.isEmpty():
        joined = rows.withColumn("united", F.col("component"))
    else:
        edges = rows.join(several, "id").filter("component <> low").select(F.col("component").alias("u"), F.col("low").alias("v")).distinct()
        united = connected_components(edges).withColumnRenamed("component", "united").withColumnRenamed("node", "component")
        joined = rows.join(united, "component", "left").withColumn("united", F.coalesce("united", "component"))
    joined = stored(joined.select("id", "n", "component", "united"), "near-united")
    # written, so that the join deals both sides itself and the rows of a hot group can be split
    least = stored(joined.filter("united IS NOT NULL").groupBy("united").agg(F.min("id").alias("least")), "near-least")
    linked_rows = joined.filter("united IS NOT NULL").join(least, "united").select("id", "n", "least")
    # a row without words has the links of the other rows of its id
    beside = linked_rows.groupBy("id").agg(F.min("least").alias("least"))
    others = joined.filter("united IS NULL").select("id", "n").join(beside, "id", "left")
    return linked_rows.unionByName(others).select("id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component"))


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int, broadcast_ids: int = BROADCAST_IDS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of docs: row (its number), id, n and component, a row number; null for rows without words, and
    for those of null id whose set no row with an id has."""
    docs, _ = of_files(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "near-docs")
    texts = with_row_number(docs, "row").select("row", "id", "text")
    sketches = stored(texts.mapInArrow(_sketch, "row long, id long, n long, digest binary, regs binary"), "near-sketches")
    classes = stored(
        sketches.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("row").alias("id"), F.first("regs").alias("regs")), "near-classes"
    )
    texts = texts.select(F.col("row").alias("id"), "text")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring(F.col("regs"), j * (2 * ROWS_PER_BAND) + 1, F.lit(2 * ROWS_PER_BAND))))
    banded = classes.select("id", F.posexplode(keys).alias("band", "key"))
    hubs = stored(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-hubs")
    members = stored(banded.join(hubs, "key"), "near-members")

    candidates = stored(members.select("id").distinct(), "near-candidates")
    few = candidates.count() <= broadcast_ids
    chosen = texts.join(F.broadcast(candidates) if few else candidates, "id", "left_semi")
    payload = stored(chosen.mapInArrow(_sets, "id long, n long, regs binary, short binary, full binary"), "near-sets").filter("n > 0")

    sketch = ["n", "regs", "short"]
    pair_columns = ["u", "v", *[f"{c}_{s}" for s in "uv" for c in sketch]]

    def decided(pairs: DataFrame) -> DataFrame:
        return _paired(pairs, payload, sketch).select(*pair_columns).mapInPandas(_decide(percent), "u long, v long, state int")

    stars = stored(members.filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct(), "near-stars")
    first = connected_components(_links(decided(stars), payload, percent))

    now = members.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    now = stored(now, "near-now")
    per = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    per = per.agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    mixed = stored(per.filter("components > 1").select("key", "size", F.col("top.component").alias("main"), (F.col("size") - F.col("top.n")).alias("apart")), "near-mixed")
    rest = stored(now.join(mixed, "key"), "near-rest")

    small = rest.filter(F.col("size") <= small_bucket).select("key", "id", "component")
    other = small.select("key", F.col("id").alias("v"), F.col("component").alias("component_v"))
    pairs = small.join(other, "key").filter("id > v AND component <> component_v").select(F.col("id").alias("u"), "v").distinct()
    pairs = pairs.join(stars, ["u", "v"], "left_anti")
    large = rest.filter(F.col("size") > small_bucket)
    # blocks cost CPU, not bytes: they are dealt to a number of tasks that follows their number, which is not merged by size
    shape = mixed.filter(F.col("size") > small_bucket).select(*_n_chunks())
    n_blocks = shape.agg(F.sum(F.expr("cast(x as double) * (x + 1) / 2 + x * y"))).first()[0] or 0.0
    tasks = int(min(MOST_TASKS, max(1, -(-n_blocks // BLOCKS_PER_TASK))))
    chunks = _chunks(large).join(payload.select("id", *sketch), "id").repartition(tasks, "key", "p", "q")
    blocks = chunks.groupBy("key", "p", "q").applyInPandas(_block(percent), "u long, v long, state int")
    second = _links(decided(pairs).unionByName(blocks), payload, percent)
    component = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second))

    of_class = classes.select("digest", "id").join(component.withColumnRenamed("node", "id"), "id", "left")
    of_class = stored(of_class.select("digest", F.coalesce("component", "id").alias("component")), "near-of-class")
    joined = sketches.drop("regs").join(of_class, "digest", "left")
    return joined.select("row", "id", "n", "component")


def dropped_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are linked, over any chain, with one of smaller id, or of equal id and smaller number;
    all columns as they came."""
    placed, hidden = of_files(docs, "near-docs")

    def gone() -> DataFrame:
        rows = stored(_groups(placed, id_col, text_col, percent).filter("component IS NOT NULL AND id IS NOT NULL").select("row", "id", "component"), "near-rows")
        stay = rows.groupBy("component").agg(F.min(F.struct("id", "row"))["row"].alias("stays"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        return rows.join(stay, "component").filter("row <> stays").select(F.col("row").alias(gone_row))

    own_row, gone_row = free_names(placed, "own_row", "gone_row")
    found = settled(docs.sparkSession, "near-gone", gone)
    few = found.count() <= BROADCAST_IDS
    kept = with_row_number(placed, own_row).join(F.broadcast(found) if few else found, F.col(own_row) == F.col(gone_row), "left_anti").select(*placed.columns)
    return kept.withColumnRenamed(hidden, "_metadata") if hidden else kept


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
