"""The five stages from text files to written output, over folders of several files."""

import json
from difflib import SequenceMatcher
from pathlib import Path

import pytest

from seqloom.jobs import files
from seqloom.operators import decode
from seqloom.sources import readers


def _folder(path: Path, **texts):
    path.mkdir()
    for name, text in texts.items():
        (path / name).write_text(text, newline="")
    return str(path)


def _lines(path):
    """Lines of a written folder, by the order of its files."""
    return [x for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


def _objects(path):
    return [json.loads(x) for x in _lines(path)]


def _table(path):
    rows = []
    for f in sorted(Path(path).glob("part-*.csv")):
        head, *body = f.read_text().splitlines()
        rows += [dict(zip(head.split(","), x.split(","), strict=False)) for x in body]
    return rows


def test_lines_are_numbered_through_all_files(spark, tmp_path):
    path = _folder(tmp_path / "in", a="1 2\r\n\r\n3\r\n", b="", c="4\n 5", d="\n6\n")
    found = readers.lines(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in found] == list(enumerate(["1 2", "", "3", "4", " 5", "", "6"]))
    found = readers.read_phrases(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in found] == list(enumerate(["1 2", "3", "4", "5", "6"]))
    assert readers.read_sequences(spark, path).select("seq_id").distinct().count() == 7


def test_lines_of_a_split_file(spark, tmp_path):
    rows = [f"{i} {'x' * (i % 50)}" for i in range(3_000)]
    path = _folder(tmp_path / "in", a="\r\n".join(rows[:2_500]), b="\n".join(rows[2_500:]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        found = readers.lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert [r.value for r in found.orderBy("line_no").collect()] == rows
        assert sorted(r.line_no for r in found.collect()) == list(range(3_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_categories_as_object_list_or_lines(spark, tmp_path):
    one, two = {"seg_key": "1,2", "assigned_label": "title", "post_title": 0.9}, {"seal_key": "3", "label": "commodity", "post_commodity": 0.8}
    for i, text in enumerate([json.dumps([one, two]), json.dumps([one, 5, two]), json.dumps(one, indent=1), json.dumps(one) + "\n" + json.dumps(two) + "\n"]):
        f = tmp_path / f"c{i}.json"
        f.write_text(text)
        found = sorted((r.seg_key, r.label, r.post_title, r.post_commodity) for r in readers.read_categories(spark, str(f)).collect())
        assert found == [("1,2", "title", 0.9, None), ("3", "commodity", None, 0.8)][: 1 if i == 2 else 2]
    for bad in ("{", "7", "", '"x"', '{"other": 1}'):
        (tmp_path / "bad.json").write_text(bad)
        assert readers.read_categories(spark, str(tmp_path / "bad.json")).count() == 0


def test_statistics_segments_lexicon_and_report(spark, tmp_path):
    first = "\n".join(f"{i % 3}, {i % 3 + 10}, {i % 5}, {i % 5 + 20}, {i % 2}" for i in range(40)) + "\n\n7\n"
    path, out = _folder(tmp_path / "in", a=first, b="1, 11, 2, 22\n(3; 23; 1)\n"), str(tmp_path / "out")
    files.symbol_statistics(spark, path, f"{out}/1")
    scores = dict(x.split("\t") for x in _lines(f"{out}/1/distribution_score"))
    assert list(scores) == sorted(scores) and sum(map(float, scores.values())) == pytest.approx(1, abs=1e-4)

    files.segmentation(spark, path, f"{out}/1/normalized_positional_entropy", f"{out}/1/distribution_score", f"{out}/2")
    lines = _lines(f"{out}/2/segmented")
    assert len(lines) == 44 and lines[40] == "" and lines[41] == "7"
    assert [x.replace(" |", ",") for x in lines[:40]] == first.splitlines()[:40]
    assert all("|" in x for x in lines[:40]) and lines[43].replace(" |", ",") == "3, 23, 1"
    assert len(_table(f"{out}/2/candidates")) == 40 * 4 + 3 + 2
    for name, bins in (("f0", 60), ("mixture", 50), ("density", 50), ("zscore", 50)):
        found = _table(f"{out}/2/histogram_{name}")
        assert len(found) == bins and sum(int(r["n"]) for r in found) == 165

    files.segment_lexicon(spark, f"{out}/2/segmented", f"{out}/3", rounds=5)
    summary = _objects(f"{out}/3/summary")[0]
    keys = {y.strip().replace(", ", ",") for x in lines if x for y in x.split("|")}
    assert summary["n_sequences"] == 44 and summary["n_segments"] == len(keys) == sum(summary["class_counts"].values())
    assert len(_table(f"{out}/3/categories")) == len(_table(f"{out}/3/posteriors")) == len(_table(f"{out}/3/summary_table")) == len(keys)
    parts = _objects(f"{out}/3/components")
    assert {p["label"] for p in parts} == {"commodity", "title", "proper_name"} and sum(p["pi"] for p in parts) == pytest.approx(1, abs=1e-6)
    assert all(len(p["mu"]) == len(p["sigma"]) == 12 for p in parts)
    for c in ("commodity", "title", "proper_name"):
        found = _table(f"{out}/3/histogram_post_{c}")
        assert len(found) == 40 and sum(int(r["n"]) for r in found) == len(keys)

    files.comparison(spark, f"{out}/3/summary", f"{out}/3/summary", f"{out}/4")
    report = _objects(f"{out}/4/report")[0]
    assert report["overall_similarity_percent"] == 100.0 and report["class_counts_1"] == summary["class_counts"]
    assert report["n_labels_1"] == report["n_labels_2"] == sum(map(len, summary["representatives"].values()))


def test_report_of_two_summaries_by_hand(spark, tmp_path):
    r = lambda label, *seq: {"seg_key": "x", "assigned_label": label, **({"label_sequence": list(seq)} if seq else {})}
    one = {"class_counts": {"commodity": 3, "title": 1}, "representatives": {"commodity": [r("commodity"), r("commodity")], "title": [r("title", "title", "commodity")]}}
    two = {"class_counts": {"commodity": 2, "proper_name": 2}, "representatives": {"commodity": [r("commodity")], "proper_name": [r("proper_name")]}}
    for name, x in (("one", one), ("two", two)):
        (tmp_path / name).write_text(json.dumps(x, indent=1))
    files.comparison(spark, str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "out"))
    found = _objects(tmp_path / "out" / "report")[0]
    assert (found["entropy_1"], found["entropy_2"], found["entropy_similarity"]) == (0.8113, 1.0, 0.8113)
    assert found["order_similarity"] == round(3 / (10**0.5 * 2**0.5), 4)  # labels 3 commodity, 1 title against 1 and 1 name
    assert found["semantic_similarity"] == round(1 / 3, 4)
    assert found["structure_similarity"] == found["svo_similarity"] == round((2 * 1 / 3) / 3, 4)
    assert (found["n_labels_1"], found["n_labels_2"]) == (4, 2) and found["svo_patterns_1"] == {"O": 2, "VO": 1}


PHRASES = ["silver ring", "red copper", "tin", "gold", "copperan bowl", "tiny tin"]


def _scores(text, words, label, probability):
    """All candidates of a text by the definition: score, bucket, place."""
    weights = {"title": (0.25, 0.20, 0.25, 0.30), "commodity": (0.35, 0.30, 0.20, 0.15), "proper_name": (0.25, 0.20, 0.35, 0.20)}.get(label, (0.30, 0.25, 0.25, 0.20))
    rate = lambda a, b: (1.0 if a == b else 0.0) if a <= 0 or b <= 0 else max(0, 1 - abs(a - b) / max(a, b))
    bucket = lambda t: max(1, len(t) // 3)
    near = [(i, w) for i, w in enumerate(words) if abs(bucket(w) - bucket(text)) <= 2 or (bucket(text) == 1 and bucket(w) <= 3)]
    out = []
    for i, w in near or list(enumerate(words)):
        s = rate(len([p for p in text.split(",") if p.strip()]), max(1, len(w) // 3))
        base = weights[0] * rate(len(text), len(w)) + weights[1] * s + weights[2] * SequenceMatcher(None, text, w).ratio()
        out.append((round((base * (1 - weights[3]) + weights[3] * max(0.15, probability)) * (0.9 if len(w) <= 2 else 1.0), 4), -bucket(w), -i, w))
    return sorted(out, reverse=True)[:3]


@pytest.mark.parametrize("label, probability", [("unknown", 0.0), ("unknown", 0.5), ("title", 0.9), ("proper_name", 0.2)])
def test_best_candidates_equal_brute_force(spark, label, probability):
    texts = ["12 4", "silver", "copper tin", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "tin", "reds"]
    asked = spark.createDataFrame([(t, label, probability) for t in texts], "text string, label string, probability double")
    candidates = spark.createDataFrame(list(enumerate(PHRASES)), "cand_id long, text string")
    found = {}
    for r in decode.fuzzy_top(asked, candidates).orderBy("place").collect():
        found.setdefault(r.text, []).append((r.score, r.word))
    for t in texts:
        wanted = [(s, w) for s, _, _, w in _scores(t, PHRASES, label, probability)]
        assert [w for _, w in found[t]] == [w for _, w in wanted] and [s for s, _ in found[t]] == pytest.approx([s for s, _ in wanted], abs=2e-4)


def test_decoding_over_files(spark, tmp_path):
    segmented = _folder(tmp_path / "in", a="1 | 2, 3\r\n\r\n9\r\n", b="2, 3 | 1\n")
    lexicon = _folder(tmp_path / "lexicon", a="seal_id,words ,encoding\n1,silver ring,1 2\n1,red copper,3\n")
    phrases = _folder(tmp_path / "phrases", a="\n".join(PHRASES) + "\n")
    (tmp_path / "categories.json").write_text(json.dumps([{"seg_key": "2, 3", "assigned_label": "title", "post_title": 0.95}]))
    out = str(tmp_path / "out")
    files.decoding(spark, segmented, lexicon, phrases, out, str(tmp_path / "categories.json"))
    records = _objects(f"{out}/decoded_lines")
    assert [(r["seq_id"], r["line"]) for r in records] == [(0, "1 | 2, 3"), (1, "9"), (2, "2, 3 | 1")]
    assert _lines(f"{out}/decoded") == [r["decoded"] for r in records] and "opper" in records[0]["decoded"]
    for r in records:
        assert r["confidence_percent"] == pytest.approx(sum(s for s, *_ in _scores(r["line"], PHRASES, "unknown", 0.5)) / 3 * 100, abs=0.02)
    words = {r["text"]: [(c["word"], c["score"]) for c in r["top_candidates"]] for r in _objects(f"{out}/decoded_words")}
    assert set(words) == {"2 3", "9"}
    for text, label, p in (("2 3", "title", 0.95), ("9", "unknown", 0.0)):
        wanted = _scores(text, PHRASES, label, p)
        assert [w for w, _ in words[text]] == [w for *_, w in wanted] and [s for _, s in words[text]] == pytest.approx([s for s, *_ in wanted], abs=2e-4)
