"""Hand-computed cases and traps of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as fx
from seqloom.jobs import registry
from seqloom.operators import boundary, compare, decode, density, detectors, lexicon, mixture, stats
from seqloom.sources import readers, writers
from seqloom.sources.corpora import array_corpus


def corpus(spark, sequences):
    return array_corpus(spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "seq_id long, symbols array<long>"))


def column(spark, expression, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expression(F.col("v"))).collect()]


def segment_rows(spark, lines):
    data = [(i, p, len(segs), ",".join(map(str, s)), s) for i, segs in enumerate(lines) for p, s in enumerate(segs)]
    return spark.createDataFrame(data, "seq_id long, seg_pos int, n_segs long, seg_key string, tokens array<long>")


def test_scores_and_entropy(spark):
    c = array_corpus(spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"])], "seq_id long, symbols array<string>"))
    assert {r.sym: r.score for r in stats.distribution_score(c).collect()} == {"a": 0.5, "b": 0.25, "c": 0.25}
    assert {r.sym: r.entropy for r in stats.positional_entropy(c).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_entropy_over_absolute_positions(spark):
    found = {r.sym: r.entropy for r in stats.positional_entropy(corpus(spark, [[1, 2], [2, 1, 3]])).collect()}
    assert found[1] == pytest.approx(1 / math.log2(3)) and found[3] == 0.0
    assert {r.entropy for r in stats.positional_entropy(corpus(spark, [[1], [2]])).collect()} == {0.0}


def test_npmi_by_hand(spark):
    c = corpus(spark, [[1, 2, 1, 2], [2, 1]])
    found = {(r.a, r.b): r.npmi for r in stats.npmi(stats.ngram_counts(c, 2), stats.symbol_counts(c).select("sym", "n"), 2).collect()}
    own, x = (2 + 1) / (4 + 4), (3 + 1) / (6 + 2)
    assert found[1, 2] == pytest.approx((math.log(own) - 2 * math.log(x)) / -math.log(own))


def test_smoke_run_of_boundaries(spark):
    c = corpus(spark, [[1, 2, 3, 4], [5, 6, 7], [1, 9, 2, 8, 3], [], [10]])
    entropy = spark.createDataFrame([(i, i % 5 + 0.1) for i in range(1, 10)], "sym long, value double")
    diversity = spark.createDataFrame([(i, i % 7 + 0.2) for i in range(1, 10)], "sym long, value double")
    f = boundary.features(c, entropy, diversity)
    assert f.count() == 9
    lines = {r.seq_id: r.line for r in boundary.segmented_lines(boundary.segment_corpus(c, boundary.zscore_detector(f))).collect()}
    assert lines[4] == "10" and 3 not in lines
    for i, s in enumerate([[1, 2, 3, 4], [5, 6, 7], [1, 9, 2, 8, 3]]):
        assert "|" in lines[i] and lines[i].replace(" |", ",").split(", ") == [str(x) for x in s]


def test_forced_boundary_is_the_first_of_equals(spark):
    c = corpus(spark, [[1, 2, 3, 4]])
    p = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.3), (0, 3, 0.3)], "seq_id long, pos int, p double")
    assert boundary.segmented_lines(boundary.segments(boundary.choose(c, p))).first().line == "1, 2 | 3, 4"
    none = boundary.choose(c, p.limit(0))
    assert boundary.segmented_lines(boundary.segments(none)).first().line == "1, 2 | 3, 4"


def test_flat_detector(spark):
    flat = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "seq_id long, pos int, f0 double")
    assert {r.p for r in boundary.zscore_detector(flat).collect()} == {0.5}
    assert boundary.zscore_reliability(flat).first().reliability == 0.2


def test_ensemble_weights(spark):
    p = lambda x: spark.createDataFrame([(0, 1, x)], "seq_id long, pos int, p double")
    w = lambda x: spark.createDataFrame([(x,)], "reliability double")
    assert boundary.ensemble({"a": (p(1.0), w(3.0)), "b": (p(0.0), w(1.0))}).first().p == pytest.approx(0.75)
    assert boundary.ensemble({"a": (p(1.0), w(0.0)), "b": (p(0.0), w(0.0))}).first().p == pytest.approx(0.5)


def test_parsing(spark):
    parse = lambda values: column(spark, readers.parse_sequence, values)
    assert parse(["1 2 3", "1,2,3", "(1, 2, 3)", "[1;2;3]", "1|2|3", "{1 2,3}"]) == [[1, 2, 3]] * 6
    assert parse(["3x4", "a-7b", "(1) (2)", None, "  "]) == [[3], [-7], [1, 2], [], []]
    assert column(spark, readers.parse_segments, ["1,2 | | 3", "", "4"]) == [[[1, 2], [], [3]], [], [[4]]]


def test_readers(spark, tmp_path):
    f = tmp_path / "corpus.csv"
    f.write_bytes(b"1,1,2\r\n\r\n  3, 4\r\n   ")
    assert [(r.seq_id, r.symbols) for r in readers.read_sequences(spark, str(f)).orderBy("seq_id").collect()] == [(0, [1, 1, 2]), (1, []), (2, [3, 4]), (3, [])]
    assert [r.symbols for r in readers.read_sequences(spark, str(f), first_cell=True).orderBy("seq_id").collect()] == [[1], [3]]
    assert [r.symbols for r in readers.read_tokens(spark, str(f)).orderBy("seq_id").collect()] == [["1", "1", "2"], ["3", "4"]]
    m = tmp_path / "map.txt"
    m.write_text("1\t0.5\n2,x0.25y\n1;0.75\nbad\n")
    assert {r.sym: r.value for r in readers.read_scalar_map(spark, str(m)).collect()} == {1: 0.75, 2: 0.25}


def test_numeric_like(spark):
    assert column(spark, fx.numeric_like, [[200], [201], [50, 50], [50, 51], [1, 2, 3], []], "array<long>") == [True, False, True, False, False, False]


def test_normalize(spark):
    assert column(spark, fx.normalize_text, ["nāyakan", "245, 245, 75", " A  b ", None]) == ["nyakan", "245 245 75", "a b", ""]


def test_length_similarity(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 3), (2, 2, 4)], "i int, a int, b int").orderBy("i")
    assert [r[0] for r in df.select(fx.entropy_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_linguistic_weight(spark):
    df = spark.createDataFrame([("velan", "proper_name"), ("al", "proper_name"), ("xkarar", "title"), ("nāyakan", "title")], "w string, c string")
    assert [round(r[0], 4) for r in df.select(fx.linguistic_weight(F.col("w"), F.col("c"))).collect()] == [1.1, 0.99, 1.21, 1.0]
    assert df.filter("w like 'n%'").select(fx.linguistic_weight(F.lit("nayakan"), F.col("c"), fold_diacritics=True)).first()[0] == pytest.approx(1.1)


def test_sentence(spark):
    words = [["malai", "x", "varum", "foo", "foo"], [], [None, ""]]
    assert column(spark, fx.sentence, words, "array<string>") == ["Varum malaix foo", "", ""]


def test_sequence_similarity_is_not_symmetric_nor_edit_distance(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in df.select(fx.sequence_similarity("a", "b")).collect()] == [0.25, 0.5]


def test_lexicon_features_by_hand(spark):
    rows = segment_rows(spark, [[[1], [300], [1]], [[300], [2, 3]]])
    m = {r.seg_key: r for r in lexicon.feature_matrix(rows).collect()}
    assert (m["1"].freq, m["1"].docfreq, m["1"].start_prob, m["1"].end_prob) == (2, 1, 0.5, 0.5)
    assert m["300"].numeric_assoc == 1.0 and m["1"].numeric_assoc == 0.0
    assert m["1"].idf == pytest.approx(math.log(3 / 2)) and m["1"].burstiness == pytest.approx(np.var([2, 0]) / 1)
    assert m["300"].H_right == pytest.approx(math.log(2)) and m["300"].coll_skew == pytest.approx(0.5 * (1 + 0.5))
    assert [m[k].seg_id for k in ("1", "300", "2,3")] == ["seg_00001", "seg_00002", "seg_00003"]


def _to_9(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


def test_neighbours_take_one_count_by_segment(spark):
    """What the counts by segment alone give equals the counts by sequence and the sums over contexts."""
    lines = [["1", "a", "b", "a"], ["a", "b"], ["b"], ["b", "1", "1", "c"]]
    rows = spark.createDataFrame([(i, j, len(t), v, [int(v) if v.isdigit() else ord(v)]) for i, t in enumerate(lines) for j, v in enumerate(t)], "seq_id long, seg_pos int, n_segs long, seg_key string, tokens array<long>")
    counts, light, ctx = lexicon.segment_counts(rows), lexicon.segment_frequencies(rows), lexicon.contexts(rows)
    as_set = lambda df, *columns: {tuple(r) for r in df.select(*columns).collect()}
    assert as_set(light, "seg_key", "freq", "starts", "ends") == as_set(counts, "seg_key", "freq", "starts", "ends")
    assert as_set(lexicon.numeric_neighbours(ctx, light), "*") == as_set(lexicon.numeric_neighbours(ctx, counts), "*")
    assert as_set(_to_9(lexicon.average_pmi(ctx, light)), "*") == as_set(_to_9(lexicon.average_pmi(ctx, counts)), "*")
    assert as_set(_to_9(lexicon.side_entropy(ctx, light)), "*") == as_set(_to_9(lexicon.side_entropy(ctx)), "*")


def test_seed_precision_without_seeds(spark):
    seeds = spark.createDataFrame([("a", False, False, True)], "seg_key string, commodity boolean, title boolean, proper_name boolean")
    labels = spark.createDataFrame([("a", "title")], "seg_key string, label string")
    found = {r.label: r for r in lexicon.seed_precision(labels, seeds).collect()}
    assert found["commodity"].precision_proxy is None and found["proper_name"].precision_proxy == 0.0 and found["title"].pred_count == 1


def test_comparison(spark):
    n = spark.createDataFrame([("x", "a", 3), ("x", "b", 1), ("y", "a", 1)], "corpus string, label string, n long")
    assert compare.jaccard(n, "x", "y").first().similarity == 0.5
    assert compare.cosine(n, "x", "y").first().similarity == pytest.approx(3 / math.sqrt(10))
    assert compare.entropy_similarity(n, "x", "y").first().similarity == 0.0
    assert compare.entropy_similarity(n.limit(0), "x", "y").first().similarity == 1.0
    p = n.withColumnRenamed("label", "pattern")
    assert compare.dice(p, "x", "y").first().similarity == pytest.approx((2 / 4 + 0) / 2)
    assert compare.dice(p, "x", "z").first().similarity == 0.0


def test_band_join_falls_back_to_all(spark):
    q = spark.createDataFrame([("abc",), ("x" * 90,)], "text string")
    c = spark.createDataFrame([(0, "abd"), (1, "a" * 12)], "cand_id long, text string")
    assert sorted((r.text[:1], r.word[:3]) for r in decode.candidate_pairs(q, c).collect()) == [("a", "abd"), ("x", "aaa"), ("x", "abd")]


def test_structure_and_length_of_all_pairs(spark, monkeypatch):
    words = [(i, "ab" * (1 + i % 9) + "c" * (i % 2) + str(i)) for i in range(40)]
    queries = spark.createDataFrame([("12 34",), ("5",), ("7 8 9 10 11",)], "text string")
    phrases = spark.createDataFrame(words, "cand_id long, text string")
    monkeypatch.setattr(registry, "_queries", lambda *a: queries)
    monkeypatch.setattr(registry, "_phrases", lambda *a: phrases)
    found = {(r.text, r.bucket): list(r[2:]) for r in registry.structure_and_length_pairs(spark, "").collect()}
    e, s = fx.entropy_similarity(F.length("text"), F.length("word")), fx.structure_similarity(F.col("text"), F.col("word"))
    each = decode.candidate_pairs(queries, phrases).select("text", "bucket", e.alias("e"), s.alias("s")).collect()
    wanted = {}
    for r in each:
        wanted.setdefault((r.text, r.bucket), []).append((r.e, r.s))
    assert len(each) > len(wanted) and {k: v[0] for k, v in found.items()} == {k: len(v) for k, v in wanted.items()}
    for k, v in wanted.items():
        one, two = zip(*v, strict=True)
        assert found[k][1:] == pytest.approx([sum(one), max(one), sum(two), max(two)], abs=1e-5)


def test_fuzzy_top_ties_keep_order(spark):
    q = spark.createDataFrame([("abc", "unknown", 0.0)], "text string, label string, probability double")
    c = spark.createDataFrame([(5, "xyz"), (2, "uvw"), (9, "abc")], "cand_id long, text string")
    assert [r.word for r in decode.fuzzy_top(q, c, k=2).orderBy("place").collect()] == ["abc", "uvw"]


def _matrix(spark, n=40):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: rng.random(n) for c in mixture.MIXTURE_FEATURES})
    pdf["freq"] = rng.integers(1, 30, n)
    pdf["seg_key"], pdf["seg_id"] = [f"k{i}" for i in range(n)], [f"seg_{i + 1:05d}" for i in range(n)]
    return spark.createDataFrame(pdf)


def _em(x, starts, rounds=250):
    """The fit by its definition, in memory."""
    mu, sigma = np.array([s.mean(0) for s in starts]), np.array([s.std(0) + 1e-6 for s in starts])
    pi, old = np.full(3, 1 / 3), -1e300

    def resp():
        lj = np.array([np.log(pi[k] + 1e-300) - 0.5 * np.log(2 * np.pi * sigma[k] ** 2 + 1e-300).sum() - 0.5 * ((x - mu[k]) ** 2 / sigma[k] ** 2).sum(1) for k in range(3)]).T
        norm = np.logaddexp.reduce(lj, 1)
        return np.exp(lj - norm[:, None]), norm.sum()

    for _ in range(rounds):
        r, ll = resp()
        n = r.sum(0) + 1e-8
        pi = n / len(x)
        mu = (r.T @ x) / n[:, None]
        sigma = np.maximum(np.sqrt(np.array([(r[:, k, None] * (x - mu[k]) ** 2).sum(0) / n[k] for k in range(3)])), 1e-4)
        if abs(ll - old) < 1e-6:
            break
        old = ll
    return resp()[0]


def test_mixture_equals_its_definition(spark):
    matrix = _matrix(spark).cache()
    scaled = mixture.scaled_rows(matrix).cache()
    model = mixture.fit(matrix, scaled)[0]
    found = {r.row: r.r for r in mixture.assignments(scaled, [model]).collect()}
    pdf = matrix.toPandas()
    x = np.array([r.x for r in scaled.orderBy("row").collect()])
    best = lambda keys, up: pdf.sort_values(keys, ascending=up, kind="stable").index[:10]
    starts = [x[best(["numeric_assoc", "freq"], [False, False])], x[best(["coll_skew", "start_prob", "end_prob"], [False] * 3)], x[best(["H_total", "freq"], [False, True])]]
    assert np.allclose(np.array([found[i] for i in range(len(x))]), _em(x, starts), atol=1e-6)
    labels = mixture.labelled(matrix, scaled, model)
    assert labels.select(F.max(F.abs(F.col("post_commodity") + F.col("post_title") + F.col("post_proper_name") - 1))).first()[0] < 1e-9


def test_jackknife_denominator(spark):
    matrix = _matrix(spark, 12).cache()
    scaled = mixture.scaled_rows(matrix).cache()
    found = [r.stability for r in mixture.stability(matrix, scaled, rounds=40).collect()]
    assert len(found) == 12 and max(found) <= 12 / 13 + 1e-12
    assert mixture.left_out_rows(1000, 40) == list(range(0, 1000, 25)) and mixture.left_out_rows(100, 40) == list(range(40))


@pytest.mark.parametrize("name", ["jackknife_stability", "lexicon_categories"])
def test_registered_jackknife_leaves_out_40_rows(spark, monkeypatch, name):
    asked = []

    def fit(matrix, scaled, left_out=()):
        asked.extend(left_out)
        raise InterruptedError

    monkeypatch.setattr(registry, "_segments", lambda *a: None)
    monkeypatch.setattr(registry, "_matrix_of", lambda rows: _matrix(spark, 60))
    monkeypatch.setattr(mixture, "fit", fit)
    with pytest.raises(InterruptedError):
        getattr(registry, name)(spark, "")
    assert asked == list(range(40))


def test_density_clusters():
    x = np.array([[0.0], [0.1], [0.2], [0.3], [5.0], [5.1], [5.2], [5.3], [9.0]])
    assert detectors.density_clusters(x, 0.35, 4).tolist() == [0, 0, 0, 0, 1, 1, 1, 1, -1]


@pytest.mark.parametrize(("eps", "local", "cell"), [(0.5, 40, 10), (0.25, 2_000, 2_000), (0.02, 40, 25), (1.1, 100, 50)])
def test_clusters_of_all_rows_equal_the_definition(spark, eps, local, cell):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (k, 3)) for c, k in ((0, 150), (1.2, 90), (3, 8), (-4, 5))] + [rng.uniform(-5, 5, (60, 3)), np.repeat([[8.0, 8, 8]], 5, 0), [[9.0, 9, 9]]])
    x = np.round(x, 1)[rng.permutation(len(x))]
    rows = spark.createDataFrame([(int(i // 4), int(i % 4), 0.0, v.tolist()) for i, v in enumerate(x)], "seq_id long, pos int, f0 double, x array<double>")
    points = density.points(rows).cache()
    of = dict(density.clusters(points, x[:50], eps, 4, local=local, cell=cell).collect())
    found = {r.id: (tuple(r.x), r.n, of[r.id]) for r in points.collect()}
    first = {v: i for i, v in reversed(list(enumerate(map(tuple, x.tolist()))))}
    assert [found[i][0] for i in sorted(found)] == sorted(first, key=first.get) and sum(n for _, n, _ in found.values()) == len(x)
    number = {c: k for k, c in enumerate(sorted({c for _, _, c in found.values() if c is not None}))}
    own = {v: -1 if c is None else number[c] for v, _, c in found.values()}
    assert [own[v] for v in map(tuple, x.tolist())] == detectors.density_clusters(x, eps, 4).tolist()


def test_clusters_far_from_all_others_meet_no_points(spark, monkeypatch):
    """Two clusters, apart along one axis only and overlapping on the others: none of their points is compared with the other's."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 0.4, (1_200, 6))
    x[:300, 5] = 4 + 0.01 * x[:300, 5]
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, n long").cache()
    met, whole = [], density._reaching

    def watched(*args):
        found = whole(*args)
        met.append(found.filter("label >= 0").count())
        return found

    monkeypatch.setattr(density, "_reaching", watched)
    of = dict(density.clusters(points, x[:50], 1.1, 4, local=200, cell=50).collect())
    number = {c: k for k, c in enumerate(sorted({c for c in of.values() if c is not None}))}
    assert [-1 if of[i] is None else number[of[i]] for i in range(len(x))] == detectors.density_clusters(x, 1.1, 4).tolist()
    assert len(number) == 2 and met and met[-1] == 0


@pytest.mark.parametrize("block", [4, 7, 1_000])
def test_nearest_centers_by_blocks(spark, block):
    rng = np.random.default_rng(8)
    centers = np.round(rng.normal(size=(30, 3)), 1)
    centers[20:25] = centers[3]  # equal distances: the least cluster
    x = np.concatenate([np.round(rng.normal(size=(40, 3)), 1), centers[:5]])
    rows = spark.createDataFrame([(i, v.tolist(), 2) for i, v in enumerate(x)], "id long, x array<double>, n long").repartition(3)
    frame = spark.createDataFrame([(100 + 3 * i, v.tolist(), i / 30) for i, v in enumerate(centers)], "cluster long, center array<double>, w double")
    found = {r.id: r for r in density.nearest(rows, frame, block).collect()}
    far = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(2))
    assert len(found) == len(x) and density.nearest(rows.limit(0), frame, block).count() == 0
    for i, d in enumerate(far):
        best = min(range(30), key=lambda k, d=d: (d[k], k))
        assert (found[i].cluster, found[i].w, found[i].n) == (100 + 3 * best, best / 30, 2) and found[i].d == pytest.approx(d[best])


def test_density_detector_scores_rare_clusters_by_their_own_center(spark):
    rng = np.random.default_rng(6)
    f = np.concatenate([rng.normal(0, 0.1, (3_000, 13)), rng.normal(2, 0.1, (3_000, 13)), rng.normal(7, 0.01, (5, 13))])
    frame = pd.DataFrame(f, columns=boundary.FEATURES)
    frame.insert(0, "pos", 1)
    frame.insert(0, "seq_id", range(len(f)))
    p, rel = detectors.density_detector(spark.createDataFrame(frame).withColumn("pos", F.col("pos").cast("int")))
    found = np.array([r.p for r in p.orderBy("seq_id").collect()])
    x = (f - f.mean(0)) / f.std(0)
    label = np.repeat([0, 1, 2], [3_000, 3_000, 5])
    m = np.array([f[label == k, 0].mean() for k in range(3)])
    conf = 1 / (1 + np.sqrt(((x - np.array([x[label == k].mean(0) for k in range(3)])[label]) ** 2).sum(1)))
    assert np.allclose(found, ((m.max() - m) / (m.max() - m.min()))[label] * conf) and rel.first().reliability == pytest.approx(conf.mean())


def test_learned_detectors_give_probabilities(spark):
    rng = np.random.default_rng(1)
    c = corpus(spark, [rng.integers(0, 6, 7).tolist() for _ in range(60)])
    f = boundary.features(c).cache()
    for p, rel in (detectors.gmm_detector(f, components=3, rounds=30), detectors.density_detector(f)):
        low, high, n = p.agg(F.min("p"), F.max("p"), F.count(F.lit(1))).first()
        assert 0 <= low <= high <= 1 and n == f.count() and 0 <= rel.first().reliability <= 1


def test_histogram_counts_every_value(spark):
    values = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0, 1.0, None]
    found = stats.histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x", 4).orderBy("bin").collect()
    n, edges = np.histogram([v for v in values if v is not None], 4)
    assert [r.n for r in found] == n.tolist() and [r.low for r in found] + [found[-1].high] == pytest.approx(edges.tolist())
    assert [r.n for r in stats.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 2).orderBy("bin").collect()] == [0, 2]
    assert [r.n for r in stats.histogram(spark.createDataFrame([], "x double"), "x", 2).collect()] == [0, 0]


def test_scores_are_rounded_by_their_binary_value(spark):
    values = [n / 3_600_000 for n in range(594, 720, 9)] + [1 / 128, 3 / 128, 0.0000005, 0.9999995, 1.0]
    found = writers.score_lines(spark.createDataFrame(list(enumerate(values)), "sym long, score double"), "score").collect()
    assert {r.value for r in found} == {f"{i}\t{v:.6f}" for i, v in enumerate(values)}


def test_written_lines(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5), (10, 0.25), (2, 0.25)], "sym long, score double")
    writers.write_lines(writers.score_lines(scores, "score"), str(tmp_path / "scores"))
    assert [r.value for r in writers.score_lines(scores, "score").collect()] == ["1\t0.500000", "10\t0.250000", "2\t0.250000"]
    assert readers.read_scalar_map(spark, str(tmp_path / "scores")).count() == 3
    lines = spark.createDataFrame([(0, "1 | 2"), (2, "3")], "seq_id long, line string")
    assert [r.value for r in writers.corpus_lines(lines, spark.range(3).withColumnRenamed("id", "seq_id")).collect()] == ["1 | 2", "", "3"]


def test_categories_and_summary(spark):
    rows = segment_rows(spark, [[[i % 5, 1], [201 + i % 3]] for i in range(30)]).cache()
    matrix = lexicon.feature_matrix(rows).cache()
    scaled = mixture.scaled_rows(matrix).cache()
    models = mixture.fit(matrix, scaled, [0, 1])
    labelled = mixture.labelled(matrix, scaled, models[0]).cache()
    adjacent = lexicon.numeric_neighbours(lexicon.contexts(rows), lexicon.segment_counts(rows))
    table = writers.category_table(lexicon.categories(matrix, labelled, adjacent, mixture.agreement(scaled, models)))
    found = table.collect()
    assert len(found) == matrix.count() and [(r.label, -r.freq) for r in found] == sorted((r.label, -r.freq) for r in found)
    one = lexicon.summary(labelled, rows, lexicon.seed_precision(labelled.select("seg_key", "label"), lexicon.seeds(matrix)), most=2).collect()
    assert len(one) == 1 and one[0].n_sequences == 30 and sum(one[0].class_counts.values()) == one[0].n_segments == len(found)
    assert sum(one[0].avg_posteriors.values()) == pytest.approx(1) and one[0].coverage.pct == 100.0 and all(len(v) <= 2 for v in one[0].representatives.values())


def test_decoded_words_are_best_first(spark):
    best = spark.createDataFrame([("a", 2, "y", 0.1), ("a", 1, "x", 0.2), ("b", 1, "z", 0.3)], "text string, place int, word string, score double")
    found = {r.text: [c.word for c in r.top_candidates] for r in writers.decoded_words(best).collect()}
    assert found == {"a": ["x", "y"], "b": ["z"]}


def test_all_noise_falls_back_to_the_score_itself(spark):
    """No cluster: p is 1 - z, cut to 0 and 1, not the normal tail of z."""
    f0 = [0.4, 0.1, 0.2, 0.9, 0.3, 0.15]
    rows = [(i, 1, v, *[float(k == i) for k in range(12)]) for i, v in enumerate(f0)]
    candidates = spark.createDataFrame(rows, "seq_id long, pos int, " + ", ".join(f"f{k} double" for k in range(13)))
    p, reliability = detectors.density_detector(candidates)
    z = (np.array(f0) - np.mean(f0)) / (np.std(f0) + 1e-12)
    assert [r.p for r in p.orderBy("seq_id").collect()] == pytest.approx(np.clip(1 - z, 0, 1).tolist(), abs=1e-9)
    assert reliability.first().reliability == 0.2
    same, reliability = detectors.density_detector(candidates.limit(1).union(candidates.limit(1)))  # no distance at all
    assert [r.p for r in same.collect()] == [0.5, 0.5] and reliability.first().reliability == 0.1
    none, reliability = detectors.density_detector(candidates.limit(0))
    assert none.count() == 0 and reliability.first().reliability == 0.0
    flat = candidates.withColumn("f0", F.lit(0.5))
    p, reliability = detectors.density_detector(flat)
    assert {r.p for r in p.collect()} == {0.5} and reliability.first().reliability == 0.1
