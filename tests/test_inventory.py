"""The inventory of segments and the steps below it: results, and what is shuffled and sorted on the way."""

import datetime
import random
import re
from collections import Counter

import pytest
from test_reference_rules import segment_rows

from seqloom.operators import boundary, lexicon
from seqloom.sources import corpora

DAY = datetime.datetime(2024, 1, 1)
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lineitem(spark, folder, rows):
    spark.createDataFrame(rows, LINES).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def order(key, n, seed=0):
    rnd = random.Random(f"{key} {seed}")
    return [(key, rnd.randint(0, 3), rnd.randint(0, 3), rnd.randint(1, 3), float(rnd.randint(1, 9)), DAY + datetime.timedelta(days=rnd.randint(0, 9))) for _ in range(n)]


def test_inventory_of_frequent_and_rare_segments(spark):
    rnd = random.Random(7)
    lines = [[[9]] + [[rnd.randint(0, 30)] for _ in range(3)] + [[rnd.randint(0, 90), 1]] for _ in range(200)]
    rows = segment_rows(spark, lines).repartition(7)
    flat = [(",".join(map(str, s)), s, i, k) for i, line in enumerate(lines) for k, s in enumerate(line)]
    freq = Counter(k for k, *_ in flat)
    wanted = {k: (f"seg_{i + 1:05d}", n) for i, (k, n) in enumerate(sorted(freq.items(), key=lambda r: (-r[1], r[0])))}
    found = lexicon.inventory(rows).collect()
    assert {r.seg_key: (r.seg_id, r.freq) for r in found} == wanted and len(found) == len(wanted) and max(freq.values()) > 100
    for r in found:
        assert r.tokens == next(s for k, s, *_ in flat if k == r.seg_key)
        assert [(e["seq"], e["pos"]) for e in r.examples] == sorted((i, p) for k, _, i, p in flat if k == r.seg_key)[:10]
    bare = lexicon.inventory(rows.drop("tokens"))
    assert bare.columns == ["seg_key", "seg_id", "freq", "examples"] and {(r.seg_key, r.seg_id, r.freq) for r in bare.collect()} == {(r.seg_key, r.seg_id, r.freq) for r in found}


def test_inventory_counts_by_hash_and_deals_ranges_once(spark, monkeypatch):
    seen = []
    stored = lexicon.stored
    monkeypatch.setattr(lexicon, "stored", lambda df, purpose: (seen.append(plan(df)), stored(df, purpose))[1])
    found = lexicon.inventory(segment_rows(spark, [[[1], [2, 3]], [[2, 3]]]))
    assert len(seen) == 1 and "SortAggregate" not in seen[0] and "HashAggregate" in seen[0]
    assert set(re.findall(r"row_number\(\) windowspecdefinition\((\w+)", plan(found))) == {"seg_key"}  # of examples, none of ranges


@pytest.mark.parametrize("size", [1, 40, 5_000])
def test_sequences_are_those_of_lines(spark, tmp_path, size):
    rows = [r for key in (None, 4, 5, 6) for r in order(key, size // 4 + 1)] + [(7, None, 3, 1, 1.0, DAY), (7, 1, None, 1, 1.0, DAY), (7, 1, 2, None, 1.0, DAY)]
    sf = lineitem(spark, tmp_path, rows)
    wanted = {}
    for key, part, supp, number, *_ in sorted(rows, key=lambda r: [(x is not None, x or 0) for x in (r[3], r[1], r[2])]):
        wanted.setdefault(key, []).append(supp)
    assert {r.seq_id: r.symbols for r in corpora.order_sequences(spark, sf).collect()} == wanted
    lines = corpora.order_lines(spark, sf).filter("seq_id IS NOT NULL").collect()
    assert {(r.seq_id, r.pos): r.sym for r in lines} == {(k, i): s for k, v in wanted.items() if k is not None for i, s in enumerate(v)}


def test_rows_are_dealt_before_they_are_listed(spark, tmp_path):
    found = plan(corpora.order_sequences(spark, lineitem(spark, tmp_path, order(1, 5))))
    assert found.count("Exchange") == 1 and found.rindex("ObjectHashAggregate") < found.index("Exchange")
    assert "l_extendedprice" not in found and "l_shipdate" not in found
    cuts = spark.createDataFrame([(1, 1, 0.5)], "seq_id long, pos int, p double")
    found = plan(boundary.sequence_segments(spark.createDataFrame([(1, [1, 2])], "seq_id long, symbols array<long>"), cuts))
    below = found[found.rindex("ObjectHashAggregate") :]
    assert found.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning" in below


@pytest.mark.parametrize("named", [100, 0])
def test_long_orders(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(corpora, "BLOCK", 20)
    monkeypatch.setattr(corpora, "CROWDED", named)
    even = [r for key in range(300) for r in order(key, 3)]
    for name, rows, long in (
        ("even", even, False), ("one", even + order(900, 21), True), ("null", even + order(None, 21), True), ("block", even + order(900, 20), False), ("none", [], False),
        ("crowded", [r for key in range(60) for r in order(key, 19)], False), ("few", order(1, 21), True),
    ):
        (tmp_path / name).mkdir()
        assert corpora.long_orders(spark, lineitem(spark, tmp_path / name, rows)) is long, name
