"""Deduplication, mixing, search, url rules and revisits against brute force and defined cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import exact_dedup, mixing, near_dedup, setsketch, topk, url_filter, warc_revisit
from seqloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, tmp_path, rows):
    """Rows (doc_id, text, source) as a table of files."""
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# exact


def test_exact_groups(spark, tmp_path):
    rows = [(1, "a", "s"), (2, "a", "s"), (3, "A", "s"), (4, None, "s"), (5, "", "s"), (6, "x" * 50_000, "s"), (7, "x" * 50_000, None)] + [(100 + i, "hot", "s") for i in range(60)]
    docs = documents(spark, tmp_path, rows)
    found = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert found[1] == (2, 2, False) and found[2] == (2, 2, True) and found[3] == (3, 1, True)
    assert found[4] == (5, 2, False) and found[6] == (7, 2, False)
    assert found[100] == (159, 60, False) and sum(k for _, _, k in found.values()) == 5
    kept = exact_dedup.dropped_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7, 159]
    assert exact_dedup.exact_dedup(docs, broadcast_digests=0).count() == len(rows)


def test_exact_defined_cases(spark, tmp_path):
    docs = documents(spark, tmp_path, [(1, "a", "s"), (1, "a", "s"), (None, "b", "s"), (2, "b", "s")])
    found = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in found if r.id == 1) == 1 and [r.keep_id for r in found if r.id is None] == [2]
    assert exact_dedup.exact_dedup(docs.filter("doc_id < 0")).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("id"), F.lit(2).alias("digest"), F.lit(3).alias("file"), F.lit(4).alias("_metadata"))
    assert exact_dedup.exact_dedup(clash).count() == 4


def test_later_arrivals_meet_the_state(spark, tmp_path, monkeypatch):
    """Three calls with one state, each in several micro-batches; a digest of earlier rows stands for two texts."""
    monkeypatch.setattr(exact_dedup, "FILES_PER_BATCH", 1)
    located = exact_dedup._located
    same = F.when(F.col("body").isin("x", "y"), F.unhex(F.lit("00"))).otherwise(F.col("digest"))
    monkeypatch.setattr(exact_dedup, "_located", lambda *a: located(*a).withColumn("digest", same))
    calls = [[(1, "a"), (2, "b"), (3, "x"), (4, "a")], [(5, "b"), (9, "y"), (0, "a")], [(7, "x"), (8, "c"), (6, "y")]]
    state, before = str(tmp_path / "state"), None
    for n, rows in enumerate(calls):
        path = str(tmp_path / f"part{n}")
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
        docs = spark.read.parquet(path)
        found = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, state_dir=state, earlier=before).collect()}
        seen = [r for part in calls[: n + 1] for r in part]
        group = {t: [i for i, u in seen if u == t] for _, t in seen}
        assert found == {i: (max(group[t]), len(group[t]), max(group[t]) == i) for i, t in rows}
        before = docs if before is None else before.unionByName(docs)


@pytest.mark.parametrize("breaks_at", ["stream_groups", "stored"])
def test_a_call_that_broke_is_repeated(spark, tmp_path, monkeypatch, breaks_at):
    """The stream has taken the rows, or only their folder is written, when the call fails; it is repeated then."""
    state, before = str(tmp_path / "state"), None
    wanted = [{1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}, {4: (4, 3, True), 0: (3, 2, False)}]
    for n, rows in enumerate([[(1, "a"), (2, "a"), (3, "b")], [(4, "a"), (0, "b")]]):
        path = str(tmp_path / f"part{n}")
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
        docs = spark.read.parquet(path)

        def broken(*a, real=getattr(exact_dedup, breaks_at)):
            if breaks_at == "stored":
                real(*a)
            raise InterruptedError

        with monkeypatch.context() as m:
            m.setattr(exact_dedup, breaks_at, broken)
            with pytest.raises(InterruptedError):
                exact_dedup.exact_dedup(docs, state_dir=state, earlier=before)
        for _ in range(2):
            found = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, state_dir=state, earlier=before).collect()}
            assert found == wanted[n]
        before = docs if before is None else before.unionByName(docs)
    named = spark.createDataFrame([(9, "a")], "doc_id long, text string")
    for _ in range(2):
        found = exact_dedup.exact_dedup(named, state_dir=state, earlier=before, arrival="third").collect()
        assert [(r.id, r.keep_id, r.group_size) for r in found] == [(9, 9, 4)]


def test_dropped_copies_of_any_frame(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, "b", 9)], "doc_id long, text string, x int")
    assert sorted(tuple(r) for r in exact_dedup.dropped_copies(rows).collect()) == [(2, "a", 8), (3, "b", 9)]
    clash = rows.withColumnRenamed("x", "_metadata").withColumn("own_file", F.lit("f"))
    kept = exact_dedup.dropped_copies(clash)
    assert kept.columns == clash.columns and sorted(tuple(r) for r in kept.collect()) == [(2, "a", 8, "f"), (3, "b", 9, "f")]


def test_equal_digests_are_split_by_text(spark, monkeypatch):
    located = exact_dedup._located
    monkeypatch.setattr(exact_dedup, "_located", lambda *a: located(*a).withColumn("digest", F.unhex(F.lit("00"))))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    found = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert found == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


# near


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return set() if not words else {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent=85):
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_ids(rows, percent=85):
    """As ``brute_components``, where rows of equal id are one document with the links of all."""
    sets, root = [(i, shingle_set(t)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        n = len(a & b)
        if n and 100 * n >= percent * (len(a) + len(b) - n):
            root[max(find(i), find(j))] = min(find(i), find(j))
    of_set = {frozenset(s): find(i) for i, s in sets if s}  # a null id has the component of its equals
    return sorted(((i, len(shingle_set(t)), of_set.get(frozenset(shingle_set(t))) if i is None else find(i)) for i, t in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_repeated_and_null_ids(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([i, i, i % 7, None]), t) for i, t in near_rows(seed)[:140]]
    rows += [(3000, "b c d e f g"), (5000, "a unlike the others in every word"), (5000, "b c d e f g"), (5000, ""), (6001, ""), (6001, None), (None, "b c d e f g")]
    docs = documents(spark, tmp_path, [(i, t, "s") for i, t in rows])
    found = near_dedup.near_duplicates(docs)
    assert found.columns == ["id", "n_shingles", "component"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_ids(rows)


def near_rows(seed=4):
    rnd, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for g in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 60, 150, 500]))]
        for _ in range(rnd.choice([2, 5, 60])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows) + 10 * g, " ".join(words)))
    extra = ["", None, "One two", "one  TWO", " ", "one two three four five", " \t\n", "É é"]
    return rows + [(5000 + i, t) for i, t in enumerate(extra)] + [(6000, rows[0][1].upper())]


@pytest.mark.parametrize("small", [32, 2])
def test_near_groups_equal_brute_force(spark, small):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(docs, small_bucket=small).collect()}
    assert found == brute_components(rows)


def test_near_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, "A B c d e f", 0)], "doc_id long, text string, component int")
    found = sorted((str(r.id), r.n_shingles, r.component) for r in near_dedup.near_duplicates(docs, broadcast_ids=0).collect())
    assert found == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, 1)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.dropped_near_duplicates(docs).filter("doc_id = 2").count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**64, 900, dtype=np.uint64), rng.integers(0, 2**64, 900, dtype=np.uint64)
    both = np.unique(np.concatenate([a, b]))
    assert (setsketch.registers(both) == np.maximum(setsketch.registers(a), setsketch.registers(b))).all()
    for shared, likely in ((850, True), (450, False)):
        c = np.concatenate([a[:shared], b[: 900 - shared]])
        equal, more = setsketch.counts_of_pairs(setsketch.registers(a)[None], setsketch.registers(c)[None])
        assert setsketch.likely(equal, more, np.array([900.0]), np.array([900.0]), 0.85)[0] == likely


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)]
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {i: 1 for i in range(2, 41)} | {100: 90, 95: 90}


# mixing


def test_targets_are_capped_and_shared_anew(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 30), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert found == {"a": 30.0, "c": 90.0, None: 0.0, "b": 920.0}


def test_sainte_lague_equals_highest_quotients(spark):
    rnd = random.Random(2)
    for seats in (0, 1, 7, 50, 333):
        votes = [rnd.choice([0, 1, 5, 100, 10_000]) * rnd.random() for _ in range(12)]
        frame = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, p int, votes double, seats long")
        found = [r.quota for r in mixing.sainte_lague(frame, ["g"], "votes", "seats", ["p"]).orderBy("p").collect()]
        wanted = [0] * 12
        for _ in range(seats):
            best = max(range(12), key=lambda i: (votes[i] / (2 * wanted[i] + 1), -i))  # noqa: B023
            wanted[best] += 1
        assert found == wanted


def test_mix_meets_targets_and_agrees(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 200)), rnd.choice(["a"] * 6 + ["b", "c", None])) for i in range(600)] + [(9000, None, "a"), (9001, "w " * 5000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, shard_rows=50).collect()
    taken, target, size = {}, {}, {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.rounds * r.size + r.head + r.run
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert all(abs(taken[s] - target[s]) <= 64 for s in taken)
    again = {r.id: r.taken for r in mixing.mix(docs.repartition(7), shard_rows=50).collect()}
    assert again == {r.id: r.taken for r in found}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("text IS NULL")).collect()} == {0}


# search


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-3, 4, 20) / 256 * (1 if i % 3 else 40)).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 18), (302, [float("inf")] + [0.0] * 19), (303, [0.5, 0.5]), (304, [1e9] * 20), (350, rows[10][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int".replace(", score int", ""))
    found = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, block=64).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for q in (i for i in ok if i % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q and len(ok[c]) == len(ok[q])))[:5]
        assert sorted(found[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_top_k_of_repeated_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    found = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(1, 1, 131072), (2, 1, 65536), (3, 1, 65536), (4, 2, 65536)]


def test_top_k_query_of_repeated_rows_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 12) / 256]) for i in [*range(120), 50, 50, 100, *[7] * 9, *range(60, 90)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted(tuple(r) for r in topk.op2(spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert found == sorted(c.sql(topk.OP2_SQL).fetchall())


@pytest.mark.parametrize("size", [3e6, 1e15, 1e38, 1e200])
def test_top_k_of_wide_vectors(spark, size):
    """Components whose products don't fit into doubles: ties, scores at the ends of a long, many dimensions."""
    rng = np.random.default_rng(11)
    rows = [(i, (rng.integers(-1000, 1000, 70) * (size / 1000)).tolist()) for i in range(150)]
    rows += [(150 + i, rows[3 + i % 5][1]) for i in range(40)] + [(200 + i, (rng.integers(-3, 4, 70) / 256).tolist()) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, block=64).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 50 == 0):
        score = lambda c: min(max(sum(a * b for a, b in zip(whole[q], whole[c])), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        best = sorted((-score(c), c) for c in whole if c != q)[:5]
        assert sorted(found[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]


def test_top_k_bounds_prune_wide_vectors():
    rng = np.random.default_rng(2)
    q, cols = np.floor(rng.normal(0, 1e9, 256) * np.linspace(3, 0.01, 256)), np.floor(rng.normal(0, 1e9, (256, 500)))
    cols[:, 17] = q
    (c, up), order = topk._scaled(cols), np.arange(256)
    mass = np.array([(c[s * 8 : s * 8 + 8] ** 2).sum(0) for s in range(32)])
    left = np.concatenate([np.cumsum(mass[::-1], 0)[::-1], np.zeros((1, 500))])
    qs, _ = topk._scaled(q)
    rows, _ = topk.search_block(qs, -1, c, np.arange(500), order, left, qs[:8] @ c[:8], 1, -np.inf, 1e-12)
    assert rows.tolist() == [17]


# urls


def test_url_rules(spark):
    urls = ["http://A.b.NET/x", "https://example.net/en/1", "http://sub.example.net/enx", "http://example.com/de/?q", "http://example.com/de", "http://x.org/fr/a#b", "http://notnet/", "no url", None, "http://net", "ftp://u@net:80/", "http://example.net/en/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect()}
    assert found[0] == ("a.b.net", "/x", "net/", "block") and found[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert found[2][2:] == ("net/", "block") and found[3][2:] == ("example.com/de/", "block") and found[4][2:] == (None, "allow")
    assert found[5][1:] == ("/fr/a", "org/fr/", "allow") and found[6][2] is None and found[7] == ("", "", None, "allow") == found[8]
    assert found[9] == ("net", "", None, "allow") and found[10][0] == "u@net:80" and found[11] == found[1]
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
    none = url_filter.judge(pages, url_filter.rules_frame(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


# revisits


def test_revisits(spark):
    schema = "id long, url string, t long, etag string, modified string, headers map<string,string>, payload string"
    responses = spark.createDataFrame([
        (1, "http://a.com/x/", 10, "e1", None, {"date": "d1", "type": "t"}, "p1"), (2, "https://www.a.com/x#f", 20, 'W/e2', None, {"date": "d2"}, "p2"),
        (3, "http://b.com/?b=1&a=2&utm_x=3", 5, None, "m", {}, "p3"), (4, "http://c.com", None, "e", None, {}, "p4"), (5, "http://a.com/x", 20, "e5", None, {"date": "d5"}, "p5"),
    ], schema)
    revisits = spark.createDataFrame([
        (11, "http://a.com/x", 20, "e1", None, {"date": "new", "type": "no"}, "", 1), (12, "http://a.com/x", 21, "e2", None, None, "", 1), (13, "http://b.com?a=2&b=1", 6, "z", "m", None, "", 1), (14, "http://c.com", 9, "e", None, None, "", 1),
        (15, "http://b.com?a=2&b=1", 6, "z", None, None, "", 1), (16, "http://a.com/x", None, "e1", None, None, "", 1), (17, "http://a.com/x", 10, "e1", None, None, "", 1), (12, "http://a.com/x", 21, "e2", None, None, "", 1), (18, None, 3, None, None, None, "", 1),
    ], schema + ", extra int")
    for bucket_rows in (20_000, 2):
        found = warc_revisit.resolve(responses, revisits, bucket_rows).collect()
        by = {r.id: (r.response_id, r.status, r.payload) for r in found}
        assert len(found) == 9
        assert by[11] == (1, "resolved", "p1") and by[12] == (5, "mismatch", None) and by[13] == (3, "resolved", "p3")
        assert by[14][1] == by[16][1] == by[17][1] == by[18][1] == "orphan" and by[15] == (3, "unvalidated", None)
        assert next(r.headers for r in found if r.id == 11) == {"date": "new", "type": "t"}
    assert warc_revisit.resolve(responses, revisits.limit(0)).count() == 0
    assert {r.status for r in warc_revisit.resolve(responses.limit(0), revisits).collect()} == {"orphan"}


def test_revisits_of_a_hot_url_equal_brute_force(spark):
    """One url with most records, ties, repeated responses, responses and revisits of one instant."""
    rng = random.Random(4)
    url = lambda: "http://hot.org/a" if rng.random() < 0.8 else f"http://u{rng.randrange(9)}.org"
    told = [(i, url(), rng.randrange(400), rng.choice(["e1", "e2", None]), rng.choice(["d1", "d2", None]), {"date": str(i)}, f"p{i}") for i in range(300)]
    told += rng.sample(told, 20)
    asked = [(1000 + i, url(), rng.randrange(420), rng.choice(["e1", "W/e2", None]), rng.choice(["d1", "d2", None]), {}) for i in range(500)]
    schema = "id long, url string, t long, etag string, modified string, headers map<string,string>"
    found = warc_revisit.resolve(spark.createDataFrame(told, schema + ", payload string"), spark.createDataFrame(asked, schema), bucket_rows=40)
    found = {r.id: (r.response_id, r.status, r.payload) for r in found.collect()}
    assert len(found) == 500
    for i, u, t, tag, date, _ in asked:
        best = max(((x[2], x[0], x) for x in told if x[1] == u and x[2] < t), default=None)
        if best is None:
            assert found[i] == (None, "orphan", None)
            continue
        x = best[2]
        agrees = x[3] == tag.removeprefix("W/") if tag and x[3] else x[4] == date if date and x[4] else None
        assert found[i] == (x[0], "unvalidated" if agrees is None else "resolved" if agrees else "mismatch", x[6] if agrees else None)


def test_revisit_query_takes_other_pages_payloads(spark):
    """The query's as-of join does the work: nearly all answers are another page's, and each status occurs."""
    found = warc_revisit.op8(spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in found} == {"resolved", "mismatch", "orphan", "unvalidated"}
    assert sum(r.page_id == r.response_id for r in found) < 0.1 * len(found)


def test_mixing_equals_sql_totals(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    wanted = duckdb.sql("SELECT sum(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))) FROM (VALUES ('a b'), ('c')) v(t)").fetchall()[0][0]
    assert mixing.mix(docs).agg(F.sum("size")).first()[0] == wanted
