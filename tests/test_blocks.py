"""Long sequences over blocks, counts of one pass, and percentiles by ranges."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_reference_rules import corpus, segment_rows

from seqloom import storage
from seqloom.jobs import registry
from seqloom.operators import boundary, lexicon, stats
from seqloom.sources import corpora, readers


def sequences(seed=1):
    rnd = random.Random(seed)
    lengths = [0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 240, *[rnd.randint(1, 6) for _ in range(40)]]
    return [[rnd.randrange(7) for _ in range(n)] for n in lengths]


def rows(df, *order):
    return [tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def small_blocks(monkeypatch):
    def use(n):
        monkeypatch.setattr(corpora, "BLOCK", n)
        monkeypatch.setattr(boundary, "BLOCK", n)

    return use


def test_blocks_change_nothing(spark, small_blocks):
    """A third of all symbols are in one sequence; features, boundaries and segments are those of whole sequences."""
    c = corpus(spark, sequences()).cache()

    def everything():
        f = boundary.features(c)
        p = boundary.zscore_detector(f)
        found = boundary.segments(boundary.choose(c, p)).cache()
        never = boundary.segments(boundary.choose(c, p, threshold=2.0))
        return (
            rows(f, "seq_id", "pos"), rows(boundary.association(c), "seq_id", "pos"), rows(stats.ngrams(c, 3), "seq_id", "pos"),
            rows(found, "seq_id", "seg_pos"), rows(never, "seq_id", "seg_pos"), rows(lexicon.contexts(found), "seg_key", "side", "nbr"),
        )

    whole = everything()
    assert {r[0] for r in whole[3]} == {i for i, s in enumerate(sequences()) if s}
    for n in (4, 8):
        small_blocks(n)
        assert everything() == whole


def test_a_long_sequence_is_spread(spark, small_blocks):
    small_blocks(64)
    c = corpus(spark, [[i % 5 for i in range(6_400)], [1, 2]])
    sizes = {(r.seq_id, r.block): r.n for r in corpora.with_guests(c, 2).groupBy("seq_id", "block").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(sizes) == 101 and max(sizes.values()) <= 68 and sizes[1, 0] == 2


def test_segment_of_a_long_sequence_by_hand(spark, small_blocks):
    small_blocks(4)
    c = corpus(spark, [list(range(10)), [5, 6]])
    p = spark.createDataFrame([(0, i, 0.9 if i in (3, 4, 9) else 0.1) for i in range(1, 10)] + [(1, 1, 0.2)], "seq_id long, pos int, p double")
    found = boundary.segments(boundary.choose(c, p))
    assert rows(found.select("seq_id", "seg_pos", "n_segs", "seg_key"), "seq_id", "seg_pos") == [(0, 0, 4, "0,1,2"), (0, 1, 4, "3"), (0, 2, 4, "4,5,6,7,8"), (0, 3, 4, "9"), (1, 0, 2, "5"), (1, 1, 2, "6")]


def test_counts_of_one_pass(spark):
    given = sequences(2)
    found = stats.gram_counts(stats.placed(corpus(spark, given))).collect()
    for kind in (1, 2, 3):
        wanted = Counter(tuple(s[i : i + kind]) for s in given for i in range(len(s) - kind + 1))
        assert {tuple(x for x in (r.a, r.b, r.c) if x is not None): r.n for r in found if r.kind == kind} == wanted
    assert {(r.a, r["at"]): r.n for r in found if r.kind == 0} == Counter((x, i) for s in given for i, x in enumerate(s))
    ends = [{r.a: n for r in found if r.kind == 1 and (n := r[side])} for side in ("starts", "ends")]
    assert ends == [Counter(s[i] for s in given if s) for i in (0, -1)]


def test_percentiles_equal_numpy(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([1, 1, 1, 2, 3, 7]), rnd.random() if rnd.random() > 0.1 else None, None, 5.0) for _ in range(331)]
    frame = spark.createDataFrame(data, "few int, real double, none double, same double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.6, 0.75, 1.0]
    found = stats.percentiles(frame, dict.fromkeys(frame.columns, shares))
    for i, c in enumerate(frame.columns):
        values = [r[i] for r in data if r[i] is not None]
        assert found[c] == (pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12) if values else [None] * 6)
    exact = frame.agg(*[F.expr(f"percentile({c}, array(0.25, 0.5, 0.75))").alias(c) for c in frame.columns]).first()
    assert all(found[c][1:3] + [found[c][4]] == list(exact[c]) for c in ("few", "real", "same"))
    assert stats.percentiles(frame.limit(0), {"few": [0.5]}) == {"few": [None]}


def test_places_in_an_order_of_many_equals(spark):
    keys = [(f"k{i:04d}", 1) for i in range(500)] + [("z", 9), ("a", 9)]
    found = lexicon.numbered(spark.createDataFrame(keys, "seg_key string, freq long").repartition(5), ["_exact", "seg_key"]).collect()
    wanted = sorted(keys, key=lambda r: (-r[1], r[0]))
    assert {r.seg_key: r.seg_id for r in found} == {k: f"seg_{i + 1:05d}" for i, (k, _) in enumerate(wanted)}


def test_first_cells_with_quotes(spark, tmp_path):
    (tmp_path / "in.csv").write_text('"1,2",3\n,"4; 5",6\n"7 ""8"""\n\n 9,10\n')
    found = readers.read_sequences(spark, str(tmp_path / "in.csv"), first_cell=True).orderBy("seq_id").collect()
    assert [r.symbols for r in found] == [[1, 2], [4, 5], [7, 8], [9]]


def test_features_of_segments_by_blocks(spark, small_blocks):
    lines = [[[i % 3], [i % 2, 1], [4]] * 5 for i in range(6)] + [[[1]], [[2], [3]]]
    whole = rows(lexicon.contexts(segment_rows(spark, lines)), "seg_key", "side", "nbr")
    small_blocks(4)
    assert rows(lexicon.contexts(segment_rows(spark, lines)), "seg_key", "side", "nbr") == whole


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["distribution_score", "boundary_features", "seed_sets", "fuzzy_topk", "dbscan_detector", "lexicon_summary"])
def test_a_query_leaves_its_result_alone(spark, name):
    place = f"{storage.checkpoint_root(spark).removeprefix('file:')}/seqloom"
    folders = lambda: set(os.listdir(place)) if os.path.isdir(place) else set()
    before = folders()
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    left = folders() - before
    assert len(left) <= 1 and all(x.startswith(name) for x in left)
