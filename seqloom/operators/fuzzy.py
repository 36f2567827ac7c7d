"""The best target phrases of texts, exactly, with few comparisons.

A phrase's score for a text is bounded before the texts are compared: length, structure and class are known, and no
more characters match than both texts have of each kind. Phrases are compared in falling order of that bound,
ties in the order in which equal scores rank, and a text is done when the next phrase could no longer rank among its best.

Phrases lie in blocks by length bucket, texts in blocks by the bucket that they are to be compared with, and the two meet
by an equi-join on the bucket; each text takes ``k`` rows from each block of phrases that it meets, of which the best
are ranked in the end. Blocks of phrases go to all tasks while their bytes are few, else both sides are dealt by
bucket and one of ``SPREAD`` groups, so that a bucket that holds a third of all texts is spread like the others.

A text without phrases in its own and the neighbouring buckets is compared with those of all buckets, the one of
highest bound first, then two, four and so on, until no bucket left can hold one of its best. A bucket is bounded by its
least and largest lengths and by the most that one of its phrases has of each kind of character. The driver holds that
summary of the buckets, whose number is at most about the root of the phrases' characters: a bucket takes phrases of its length.

Characters that no phrase has match nothing, whichever they are. So texts are compared by their shape, in which one
such character stands for all: texts of equal shape, label and probability have the same best phrases, which are
looked for once. Commas and blanks stay, for they part a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import SecondText
from ..functions.text import CLASS_SUFFIXES, UNKNOWN, bucket_of, class_weight, linguistic_weight, normalize_text, without_marks
from ..storage import stored

#: Phrases and texts of a block, pairs of blocks of a task, bytes of phrases that go to all tasks, and groups beyond that.
PHRASES, TEXTS, PAIRS_PER_TASK, MOST_TASKS, SENT_BYTES, SPREAD = 512, 256, 8, 10_000, 32 << 20, 32
#: Shapes whose best phrases go to all tasks.
SENT_LISTS = 50_000
#: Kinds of characters that bounds count: code points by their remainder.
KINDS = 128
#: Second texts whose indexes a task keeps, and ratios that each keeps.
_KEPT, _RATIOS = 4_000, 5_000
DIGITS = 4
_CLASSES = [*CLASS_SUFFIXES, UNKNOWN]
_TEXT = ["text", "label", "probability", "length", "parts", "of_class", "p", "w0", "w1", "w2", "w3"]


def asked_texts(queries: DataFrame) -> DataFrame:
    """Distinct (text, label, probability) with what scores take from them."""
    parts = F.size(F.filter(F.split("text", ","), lambda p: F.trim(p) != ""))
    own = F.lit(len(_CLASSES) - 1)
    for i, c in enumerate(_CLASSES[:-1]):
        own = F.when(F.col("label") == c, F.lit(i)).otherwise(own)
    distinct = queries.select("text", "label", F.col("probability").cast("double").alias("probability")).filter("text IS NOT NULL").distinct()
    return distinct.select(
        "text", "label", "probability", F.length("text").alias("length"), parts.alias("parts"), own.alias("of_class"), F.greatest(F.lit(0.15), "probability").alias("p"),
        *[class_weight(F.col("label"), i).alias(f"w{i}") for i in range(4)], bucket_of(F.col("text")).alias("bucket"),
    )


def target_phrases(candidates: DataFrame) -> DataFrame:
    """cand_id, word, bucket and what scores take from phrases (cand_id, text)."""
    word = candidates.filter("text IS NOT NULL").select("cand_id", F.col("text").alias("word"))
    weights = [linguistic_weight(F.col("word"), F.lit(c)).alias(f"lw{i}") for i, c in enumerate(_CLASSES)]
    return word.select("cand_id", "word", bucket_of(F.col("word")).alias("bucket"), F.length("word").alias("length"), bucket_of(normalize_text(F.col("word"))).alias("parts"), *weights)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``entropy_similarity`` of lengths, for all pairs of a and b."""
    a, b = a[:, None].astype(float), b[None, :].astype(float)
    return np.where((a <= 0) | (b <= 0), (a == b).astype(float), np.maximum(0.0, 1.0 - np.abs(a - b) / np.maximum(np.maximum(a, b), 1.0)))


def counts_of(texts: list[str]) -> np.ndarray:
    """How many characters of each kind texts have."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(of * KINDS + codes, minlength=len(texts) * KINDS).reshape(len(texts), KINDS).astype(np.int32)


def most_matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What all pairs of texts have in common at most, from their counts."""
    out = np.zeros((len(a), len(b)), np.int32)
    for kind in np.flatnonzero(a.any(0) & b.any(0)):
        out += np.minimum(a[:, kind][:, None], b[:, kind][None, :])
    return out


def _shares(matching: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a[:, None] + b[None, :]
    return np.where(total > 0, np.minimum(1.0, 2.0 * matching / np.maximum(total, 1)), 1.0)


class Texts:
    """A block of texts or of phrases: numbers as arrays, counts of characters with and without marks."""

    def __init__(self, rows: pa.StructArray, names: list[str], text: str):
        self.column = {n: rows.field(i) for i, n in enumerate(names)}
        self.text = self.column[text].to_pylist()
        self.plain = [t if t.isascii() else without_marks(t) for t in self.text]
        self.number = {n: c.to_numpy(zero_copy_only=False) for n, c in self.column.items() if not pa.types.is_string(c.type)}
        self.counts, self.length = counts_of(self.text), np.array([len(t) for t in self.text], float)
        same = self.plain == self.text
        self.plain_counts, self.plain_length = (self.counts, self.length) if same else (counts_of(self.plain), np.array([len(t) for t in self.plain], float))


def scores(w0, w1, w2, w3, p, length, structure, literal, phonetic, weight):
    """The formula of ``decode.final_score``, in its order, for numbers or arrays."""
    base = w0 * length + w1 * structure + w2 * (0.6 * phonetic + 0.4 * literal)
    return (base * (1 - w3) + w3 * p) * weight


_OF_TEXT = ("w0", "w1", "w2", "w3", "p")


def rounded(score: float) -> int:
    """A score in units of its last digit; halves go up, by the shortest decimal form."""
    scaled = score * 10**DIGITS
    low = math.floor(scaled)
    if abs(scaled - low - 0.5) > 1e-6:
        return low + (scaled - low > 0.5)
    return int(Decimal(repr(float(score))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP).scaleb(DIGITS))


def _units(most: np.ndarray) -> np.ndarray:
    """Bounds in units of the last digit, never below what a score up to them rounds to."""
    return np.floor(most * 10**DIGITS + 0.5 + 1e-6).astype(np.int64)


def best_of_block(q: Texts, c: Texts, k: int, index: Callable[[str], SecondText]) -> Iterator[tuple[int, int, int, int]]:
    """(text, phrase, score, number of comparisons so far) for the k best phrases of each text in a block of phrases."""
    length, structure = closeness(q.number["length"], c.number["length"]), closeness(q.number["parts"], c.number["parts"])
    literal = _shares(most_matching(q.counts, c.counts), q.length, c.length)
    phonetic = literal if q.plain_counts is q.counts and c.plain_counts is c.counts else _shares(most_matching(q.plain_counts, c.plain_counts), q.plain_length, c.plain_length)
    weights = np.stack([c.number[f"lw{i}"] for i in range(len(_CLASSES))])[q.number["of_class"]]
    bound = _units(scores(*[q.number[n][:, None] for n in _OF_TEXT], length, structure, literal, phonetic, weights))
    ids, compared = c.number["cand_id"].tolist(), 0
    orders = np.lexsort((np.broadcast_to(c.number["cand_id"], bound.shape), -bound), axis=-1)
    own = list(zip(*[q.number[n].tolist() for n in _OF_TEXT], strict=True))
    for i, text in enumerate(q.text):
        found: list[tuple[int, int, int]] = []
        most, near, shape, weight = bound[i], length[i], structure[i], weights[i]
        for j in orders[i].tolist():
            if len(found) == k and (-int(most[j]), ids[j]) > found[-1][:2]:
                break
            compared += 1
            one = index(c.text[j]).ratio(text)
            two = one if q.plain[i] == text and c.plain[j] == c.text[j] else index(c.plain[j]).ratio(q.plain[i])
            found.append((-rounded(scores(*own[i], float(near[j]), float(shape[j]), one, two, float(weight[j]))), ids[j], j))
            found.sort()
            del found[k:]
        for minus, _, j in found:
            yield i, j, -minus, compared


class Remembered(SecondText):
    """A second text that keeps ratios, for first texts that come with many labels and probabilities."""

    def __init__(self, text: str):
        super().__init__(text)
        self._ratios: dict[str, float] = {}

    def ratio(self, first: str) -> float:
        found = self._ratios.get(first)
        if found is None:
            if len(self._ratios) >= _RATIOS:
                self._ratios.clear()
            found = self._ratios[first] = super().ratio(first)
        return found


_FOUND = "text string, label string, probability double, bucket int, cand_id long, word string, score double"


def _compared(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: bucket, texts, phrases (both arrays of structs) -> the k best of each."""
    text_names, phrase_names = pairs.schema["texts"].dataType.elementType.names, pairs.schema["phrases"].dataType.elementType.names

    def run(batches):
        indexes: dict[str, SecondText] = {}
        blocks: dict[bytes, Texts] = {}

        def index(text: str) -> SecondText:
            found = indexes.get(text)
            if found is None:
                if len(indexes) >= _KEPT:
                    indexes.clear()
                found = indexes[text] = Remembered(text)
            return found

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for bucket, texts, phrases, part in zip(*[batch.column(x) for x in ("bucket", "texts", "phrases", "part")], strict=True):
                q, name = Texts(texts.values, text_names, "text"), (bucket.as_py(), part.as_py())
                c = blocks.get(name)
                if c is None:
                    if len(blocks) >= 64:
                        blocks.clear()
                    c = blocks[name] = Texts(phrases.values, phrase_names, "word")
                labels = q.column["label"].to_pylist()
                probabilities = q.column["probability"].to_pylist()
                for i, j, score, _ in best_of_block(q, c, k, index):
                    for column, value in zip(out, (q.text[i], labels[i], probabilities[i], name[0], int(c.number["cand_id"][j]), c.text[j], score / 10**DIGITS), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["text", "label", "probability", "bucket", "cand_id", "word", "score"])

    return pairs.select("bucket", "part", "texts", "phrases").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("text", "label", "probability").orderBy(F.col("score").desc(), "bucket", "cand_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


class Buckets:
    """What is known of the buckets of phrases: their blocks, and a summary that bounds scores."""

    def __init__(self, phrases: DataFrame):
        def run(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                n = [batch.column(i).to_pylist() for i in range(4)]
                bare = [without_marks(t) for t in n[0]]
                counts, plain = counts_of(n[0]), counts_of(bare)
                weights = np.stack([batch.column(4 + i).to_numpy() for i in range(len(_CLASSES))], 1) if batch.num_rows else None
                for at, bucket in enumerate(n[1]):
                    have = sums.setdefault(bucket, [0, n[2][at], n[2][at], n[3][at], n[3][at], 0, np.zeros(KINDS, np.int32), np.zeros(KINDS, np.int32), np.zeros(len(_CLASSES)), np.zeros(128)])
                    have[0] += 1
                    have[1], have[2] = min(have[1], n[2][at]), max(have[2], n[2][at])
                    have[3], have[4] = min(have[3], n[3][at]), max(have[4], n[3][at])
                    have[5] += len(n[0][at].encode()) + 100
                    have[6], have[7], have[8] = np.maximum(have[6], counts[at]), np.maximum(have[7], plain[at]), np.maximum(have[8], weights[at])
                    have[9][[ord(x) for x in {*n[0][at], *bare[at]} if x.isascii()]] = 1
            names = list(sums)
            columns = [pa.array(names, pa.int32()), *[pa.array([sums[b][i] for b in names], pa.int64()) for i in range(6)]]
            most = pa.array([np.concatenate(sums[b][6:]).astype(float).tolist() for b in names], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, most], ["bucket", "n", "low", "high", "parts_low", "parts_high", "size", "most"])

        schema = "bucket int, n long, low long, high long, parts_low long, parts_high long, size long, most array<double>"
        per = stored(phrases.select("word", "bucket", "length", "parts", *[f"lw{i}" for i in range(len(_CLASSES))]).mapInArrow(run, schema), "fuzzy-buckets")
        found = per.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "size")], *[F.min(c).alias(c) for c in ("low", "parts_low")], *[F.max(c).alias(c) for c in ("high", "parts_high")]).orderBy("bucket").collect()
        column = lambda c: np.array([r[c] for r in found], int)
        self.bucket, self.n, self.bytes = column("bucket"), column("n"), int(column("size").sum())
        self.low, self.high, self.parts_low, self.parts_high = (column(c) for c in ("low", "high", "parts_low", "parts_high"))
        most = np.zeros((len(found), 2 * KINDS + len(_CLASSES) + 128))
        at = {b: i for i, b in enumerate(self.bucket.tolist())}
        for r in per.select("bucket", F.posexplode("most").alias("kind", "most")).groupBy("bucket", "kind").agg(F.max("most").alias("most")).filter("most > 0").collect():
            most[at[r["bucket"]], r["kind"]] = r["most"]
        self.counts, self.plain, self.weights = most[:, :KINDS], most[:, KINDS : 2 * KINDS], most[:, 2 * KINDS : -128]
        #: visible ASCII characters that no phrase has, with or without marks
        self.foreign = "".join(x for x in map(chr, range(33, 127)) if x != "," and not most[:, ord(x) - 128].any())
        parts = F.create_map(*[F.lit(int(x)) for b, n in zip(self.bucket, self.n, strict=True) for x in (b, -(-n // PHRASES))]) if len(found) else F.lit(None)
        dealt = phrases.withColumn("part", F.pmod(F.xxhash64("cand_id"), parts[F.col("bucket")]).cast("int")) if len(found) else phrases.withColumn("part", F.lit(0))
        inner = F.struct("cand_id", "word", "length", "parts", *[f"lw{i}" for i in range(len(_CLASSES))])
        self.blocks = dealt.groupBy("bucket", "part").agg(F.collect_list(inner).alias("phrases"))

    def __getstate__(self) -> dict:
        """The summary alone, which is what tasks need."""
        return {k: v for k, v in self.__dict__.items() if k != "blocks"}

    def near(self, bucket: int, reach: int) -> list[int]:
        """Places of the buckets at most ``reach`` from a bucket."""
        low, high = np.searchsorted(self.bucket, [max(1, bucket - reach), bucket + reach + 1])
        return list(range(low, high))

    def bounds(self, q: Texts, i: int) -> np.ndarray:
        """For each bucket what no phrase of it scores more than, in units of the last digit."""
        clamp = lambda x, low, high: np.clip(x, low, high)

        def close(x, low, high):
            near = clamp(x, low, high).astype(float)
            return np.where((x <= 0) | (near <= 0), (x == near).astype(float), 1.0 - np.abs(x - near) / np.maximum(np.maximum(x, near), 1.0))

        def share(counts, own, length):
            most = np.minimum(np.minimum(counts, own[None, :]).sum(1), length)
            return _shares(most[None, :], np.array([0.0]), length + np.maximum(self.low, most))[0]

        length, structure = close(q.number["length"][i], self.low, self.high), close(q.number["parts"][i], self.parts_low, self.parts_high)
        literal = share(self.counts, q.counts[i], q.length[i])
        phonetic = np.maximum(share(self.plain, q.plain_counts[i], q.plain_length[i]), 0.0)
        if (q.plain[i] != q.text[i]) or (self.plain != self.counts).any():
            phonetic = np.ones_like(phonetic)
        return _units(scores(*[q.number[n][i] for n in _OF_TEXT], length, structure, literal, phonetic, self.weights[:, q.number["of_class"][i]]))


def _met(asked: DataFrame, known: Buckets, targets: Callable[[Texts, list[dict]], list[list[int]]], k: int) -> DataFrame:
    """The k best phrases of texts in each of the buckets that ``targets`` names for them (places in known)."""
    names, schema = asked.columns, T.StructType([*asked.schema.fields, T.StructField("target", T.IntegerType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q = Texts(pa.StructArray.from_arrays(batch.columns, batch.schema.names), names, "text")
                lists = targets(q, batch)
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), pa.int64())
                chosen = pa.array([int(known.bucket[t]) for x in lists for t in x], pa.int32())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], chosen], [*batch.schema.names, "target"])

    dealt = stored(asked.mapInArrow(run, schema), "fuzzy-asked")
    sizes = {r["target"]: r["n"] for r in dealt.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return dealt.sparkSession.createDataFrame([], _FOUND)
    of = dict(zip(known.bucket.tolist(), known.n.tolist(), strict=True))
    pairs = sum(-(-n // TEXTS) * -(-of[b] // PHRASES) for b, n in sizes.items())
    tasks = int(min(MOST_TASKS, max(1, -(-pairs // PAIRS_PER_TASK))))
    blocks = F.create_map(*[F.lit(x) for b, n in sizes.items() for x in (int(b), int(-(-n // TEXTS)))])[F.col("target")]
    group = dealt.withColumn("block", F.pmod(F.xxhash64("text", "label", "probability"), blocks).cast("int"))
    texts = group.groupBy(F.col("target").alias("bucket"), "block").agg(F.collect_list(F.struct(*_TEXT)).alias("texts"))
    if known.bytes <= SENT_BYTES:
        met = texts.repartition(tasks).join(F.broadcast(known.blocks), "bucket")
    else:
        spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
        one = texts.withColumn("g", (F.col("block") % SPREAD).cast("int")).repartition(tasks, "bucket", "g")
        met = one.join(known.blocks.withColumn("g", spread).repartition(tasks, "bucket", "g").hint("shuffle_hash"), ["bucket", "g"])
    return _compared(met, k)


def fuzzy_top(queries: DataFrame, candidates: DataFrame, k: int, reach: int) -> DataFrame:
    """text, label, probability, place, word, score: the k best phrases (cand_id, text) of each distinct query.

    Those of the buckets in reach, or of all where there are none in reach. Equal scores rank by bucket, then cand_id.
    """
    known = Buckets(stored(target_phrases(candidates), "fuzzy-phrases"))
    texts = queries.select("text", "label", F.col("probability").cast("double").alias("probability")).filter("text IS NOT NULL").distinct()
    if not len(known.bucket):
        return texts.limit(0).select("text", "label", "probability", F.lit(0).alias("place"), F.lit("").alias("word"), F.lit(0.0).alias("score"))
    named = stored(texts.withColumn("shape", shape(F.col("text"), known.foreign)), "fuzzy-texts")
    best = _best(stored(asked_texts(named.select(F.col("shape").alias("text"), "label", "probability")), "fuzzy-shapes"), known, k, reach)
    lists = best.groupBy(F.col("text").alias("shape"), "label", "probability").agg(F.array_sort(F.collect_list(F.struct("place", "word", "score"))).alias("best"))
    lists = stored(lists, "fuzzy-lists")
    if lists.count() <= SENT_LISTS:
        lists = F.broadcast(lists)
    own = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("shape", "label", "probability")]
    found = named.alias("t").join(lists.alias("b"), own[0] & own[1] & own[2]).select("t.text", "t.label", "t.probability", F.explode("b.best").alias("best"))
    return found.select("text", "label", "probability", "best.place", "best.word", "best.score")


def shape(text: Column, foreign: str) -> Column:
    """text with the first of the foreign characters in place of each of them."""
    return F.translate(text, foreign, foreign[0] * len(foreign)) if foreign else text


def _best(asked: DataFrame, known: Buckets, k: int, reach: int) -> DataFrame:
    """text, label, probability, place, word, score of ``asked_texts``."""
    columns = ["text", "label", "probability", "place", "word", "score"]
    near = lambda q: [known.near(b, reach) for b in q.number["bucket"]]
    found = stored(_met(asked, known, lambda q, _: near(q), k), "fuzzy-near")
    some = F.array(*[F.lit(int(b)) for b in known.bucket])
    alone = F.size(F.filter(some, lambda b: (b >= F.greatest(F.lit(1), F.col("bucket") - reach)) & (b <= F.col("bucket") + reach))) == 0
    left = stored(asked.filter(alone).withColumn("least", F.lit(None).cast("long")), "fuzzy-alone")
    best, start, width = found.limit(0), 0, 1
    while start < len(known.bucket) and not left.isEmpty():

        def next_ones(q: Texts, batch, start=start, width=width) -> list[list[int]]:
            out = []
            for i, least in enumerate(batch.column(batch.schema.get_field_index("least")).to_pylist()):
                bound = known.bounds(q, i)
                order = np.lexsort((known.bucket, -bound))[start : start + width]
                out.append([int(b) for b in order if least is None or bound[b] >= least])
            return out

        more = _met(left, known, next_ones, k)
        best = stored(_ranked(best.unionByName(more), k).drop("place"), "fuzzy-best")
        start, width = start + width, 2 * width
        # open while a bucket that is left may reach the k-th score, or there are fewer than k
        reached = best.groupBy("text", "label", "probability").agg(F.when(F.count(F.lit(1)) >= k, F.round(F.min("score") * 10**DIGITS).cast("long")).alias("now"))
        keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("text", "label", "probability")]
        again = left.alias("l").join(reached.alias("r"), keys[0] & keys[1] & keys[2], "left").select(*[F.col(f"l.{c}") for c in asked.columns], F.col("r.now").alias("least"))

        def still(batches, start=start, names=tuple(asked.columns)):
            for batch in batches:
                if batch.num_rows:
                    q = Texts(pa.StructArray.from_arrays(batch.columns, batch.schema.names), [*names, "least"], "text")
                    keep = []
                    for i, least in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                        bound = known.bounds(q, i)
                        rest = np.lexsort((known.bucket, -bound))[start:]
                        keep.append(len(rest) > 0 and (least is None or bound[rest[0]] >= least))
                    yield batch.filter(pa.array(keep, pa.bool_()))

        left = stored(again.mapInArrow(still, again.schema), "fuzzy-alone")
    return _ranked(found.unionByName(best), k).select(*columns)
