"""Figures that were published for four corpora, from their class counts."""

import pytest

from seqloom.operators import compare
from seqloom.sources import readers

# Class counts of the four lexicons, of which at most 30 segments a class stand in the comparison.
CLASSES = {
    "first": {"proper_name": 447, "title": 191, "commodity": 107},
    "second": {"commodity": 147, "proper_name": 86, "title": 44},
    "third": {"title": 27, "proper_name": 21},
    "fourth": {"proper_name": 9, "title": 7},
}
SEGMENTS = {"first": 745, "second": 277, "third": 48, "fourth": 16}


@pytest.fixture
def summaries(spark):
    listed = lambda counts: {c: [{"assigned_label": c}] * min(30, n) for c, n in counts.items()}
    given = [(name, counts, {c: [(x["assigned_label"], None) for x in rows] for c, rows in listed(counts).items()}) for name, counts in CLASSES.items()]
    return spark.createDataFrame(given, "corpus string, class_counts map<string,bigint>, representatives map<string,array<struct<assigned_label:string,label_sequence:array<string>>>>")


def test_class_counts_make_up_the_segments():
    assert {k: sum(v.values()) for k, v in CLASSES.items()} == SEGMENTS


def test_published_report(summaries):
    r = compare.summary_report(summaries, "first", "second").first()
    assert (r.entropy_1, r.entropy_2, r.entropy_similarity) == (1.3477, 1.4306, 0.942)
    assert r.order_similarity == r.semantic_similarity == r.structure_similarity == r.svo_similarity == 1.0
    assert (r.overall_similarity_percent, r.n_labels_1, r.n_labels_2) == (98.84, 90, 90)
    assert r.class_counts_1 == CLASSES["first"] and r.svo_patterns_2 == {"S": 30, "V": 30, "O": 30}


@pytest.mark.parametrize(("other", "percent", "labels"), [("third", 67.82, 48), ("fourth", 55.41, 16)])
def test_figures_that_follow(summaries, other, percent, labels):
    r = compare.summary_report(summaries, "first", other).first()
    assert (r.overall_similarity_percent, r.n_labels_2) == (percent, labels)


def test_first_cells_make_sequences_of_one_symbol(spark, tmp_path):
    """Two corpora came out with one symbol a line, since their comma files were taken for tables."""
    (tmp_path / "rows.csv").write_text("1,1,2,2,3,3\r\n4,1,2,2,3,3\r\n1,5,5,5,5,5\r\n")
    found = readers.read_sequences(spark, str(tmp_path / "rows.csv"), first_cell=True)
    assert sorted(r.symbols for r in found.collect()) == [[1], [1], [4]]
