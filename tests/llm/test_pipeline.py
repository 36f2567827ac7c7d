"""The stages of the pipeline, and all five of them against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_set_operators import brute_components, documents, shingle_set

import corpus_pipeline
from seqloom.llm import stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def near_pair(rnd):
    """Two texts at similarity 51 / 61."""
    one = words(rnd, 60)
    return " ".join(one), " ".join([*one[:30], "other", *one[31:]])


def test_near_stage_links_from_80_percent(spark, tmp_path):
    one, two = near_pair(random.Random(1))
    docs = documents(spark, tmp_path, [(1, one, "s"), (2, two, "s"), (None, two + " x", "s"), (3, "a b c", "s")])
    assert sorted(str(r.doc_id) for r in stages.near_dedup(spark, docs, "").collect()) == ["1", "3", "None"]


def near_groups(rows, percent):
    """The rows (id, text, source) that stay: of each group of linked rows with an id the smallest id, of equal ids any."""
    root, sets = list(range(len(rows))), [shingle_set(t) if i is not None else set() for i, t, _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k])
    return list(groups.values())


def test_near_stage_judges_rows_not_ids(spark, tmp_path):
    """Ids that come again with other texts, near copies of other ids or their own, null ids and texts without words."""
    rnd = random.Random(7)
    one, two = near_pair(rnd)
    other, third = near_pair(rnd)
    rows = [(3, one, "s"), (5, " ".join(words(rnd, 30)), "s"), (5, two, "s"), (8, other, "s"), (8, third, "s"), (8, "", "s"), (None, one, "s"), (None, one, "s"), (2, third + " x", "s"), (9, None, "s")]
    rows += [(rnd.choice([20, 21, None, 22 + i]), f"{rnd.choice([one, other])} {i % 3}", "t") for i in range(30)]
    found = [(r.doc_id, r.text) for r in stages.near_dedup(spark, documents(spark, tmp_path, rows), "").collect()]
    groups = near_groups(rows, 80)
    assert len(found) == len(groups) < len(rows) and (5, rows[1][1]) in found
    for group in groups:
        least = min((i for i, _, _ in group if i is not None), default=None)
        assert sum((i, t) in found for i, t in {(i, t) for i, t, _ in group if i == least}) >= 1
        assert all(i is None or least is None or sum(x == (i, t) for x in found) <= sum((i, t) == (a, b) for a, b, _ in group if a == least) for i, t, _ in group)


def mixed(rows):
    """Rows (doc_id, text, source) -> what the mix emits, by a circle of words for each source of one shard."""
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size(t) for _, t, z in rows if z == s) for s in names}
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    target, free = {}, list(names)
    while free:
        level = (sum(held.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if 3 * held[s] <= level * weight[s]]
        target |= {s: 3.0 * held[s] if full else level * weight[s] for s in full or free}
        free = [s for s in free if s not in target]
    seats = dict.fromkeys(names, 0)
    for _ in range(int(sum(held.values()) / 32 + 0.5)):
        seats[max(names, key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))] += 1
    out = []
    for s in names:
        digest = lambda i: hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (digest(r[0]), size(r[1])))
        tokens = min(32 * seats[s], 3 * held[s])
        start = int(hashlib.md5(f"17:{s or ''}:0".encode()).hexdigest()[:8], 16) % max(1, -(-held[s] // 32)) * 32
        rounds, arc = divmod(tokens, held[s]) if held[s] else (0, 0)
        begin = 0
        for i, t, _ in own:
            n, found = size(t), WORD.findall(t or "")
            out += [(i, s, t)] * (rounds if n else 0)
            for low, high in ((0, start + arc - held[s]), (start, start + arc)):
                a, b = max(low, begin) - begin, min(high, begin + n) - begin
                if a < b:
                    out.append((i, s, t if b - a == n else " ".join(found[a:b])))
            begin += n
    return sorted(out, key=str)


def unlike_rows(seed):
    """Null ids, and ids that come again with as many words but another text, in another source."""
    rnd = random.Random(seed)
    rows = [(i, "  ".join(words(rnd, rnd.randint(20, 90))), rnd.choice(["a", "a", "a", "b", None])) for i in range(60)]
    rows += [(i, " ".join(words(rnd, len(t.split()))), "c") for i, t, _ in rows[:20]]
    return rows + [(None, " ".join(words(rnd, 40 + i)), "ab"[i % 2]) for i in range(15)] + [(99, None, "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_stage_equals_a_circle_of_words(spark, tmp_path, seed):
    rows = unlike_rows(seed)
    found = stages.mixing(spark, documents(spark, tmp_path, rows), "").collect()
    assert sorted(((r.doc_id, r.source, r.text) for r in found), key=str) == mixed(rows)
    assert all(r.n_chars == len(r.text) and r.text for r in found)


def test_mixing_stage_of_one_id_in_one_source(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(7, " ".join(words(rnd, 50)), "a") for _ in range(9)] + [(8, " ".join(words(rnd, 300)), "b"), (9, " ".join(words(rnd, 64)), "c")]
    found = stages.mixing(spark, documents(spark, tmp_path, rows), "").collect()
    emitted = lambda s, texts: sum(len(WORD.findall(t)) for z, t in texts if z == s)
    by_source = [(r.source, r.text) for r in found], [(s, t) for _, s, t in mixed(rows)]
    assert [emitted(s, by_source[0]) for s in "abc"] == [emitted(s, by_source[1]) for s in "abc"]
    assert all(r.text for r in found)


def test_stages_of_clashing_columns_and_empty_tables(spark, tmp_path):
    names = ["_file", "row", "size", "piece", "rounds", "head", "digest", "component", "gone", "id", "own_row", "tokens", "bpe_text", "path", "number"]
    docs = documents(spark, tmp_path, unlike_rows(4)).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    docs.write.parquet(str(tmp_path / "clash"))
    docs = spark.read.parquet(str(tmp_path / "clash"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        wanted = docs.columns if name != "bpe" else [*["_tokens" if c == "tokens" else c for c in docs.columns if c != "text"], "tokens"]
        assert found.columns == wanted and found.count() > 0, name
        if name == "bpe":
            assert found.filter("tokens IS NULL").isEmpty()
            found, names = found.drop("tokens").withColumnRenamed("_tokens", "tokens"), names
        found.limit(0).write.parquet(str(tmp_path / name))
        assert stage(spark, spark.read.schema(docs.schema).parquet(str(tmp_path / name)), "").count() == 0, name
        assert all(r[n] == i for r in found.limit(5).collect() for i, n in enumerate(names)), name


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    known = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rnd = random.Random(3)
    one, two = near_pair(rnd)
    rows = unlike_rows(3) + [(200, one, "a"), (201, two, "b"), (202, "12 34 !", "a"), (None, " \t", "b")]
    rows += [(300 + i, t, "b") for i, (_, t, _) in enumerate(rows[:10])] + [(None, rows[12][1], "a"), (12, rows[80][1], "c")]
    documents(spark, tmp_path, rows)

    kept = [r for r in rows if re.search("[a-z]", r[1] or "")]
    best = {}
    for i, t, s in kept:
        if t not in best or (-1 if i is None else i) > (-1 if best[t][0] is None else best[t][0]):
            best[t] = (i, t, s)
    # here no repeated id has links
    linked = brute_components([(i, t) for i, t, _ in best.values() if i is not None and i >= 200], 80)
    wanted = mixed([r for r in best.values() if r[0] is None or r[0] < 200 or linked[r[0]][1] == r[0]])
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "tokens"]
    found = [(r.doc_id, r.source, known.decode(r.tokens), r.n_chars) for r in found.collect()]
    assert sorted(((i, s, t) for i, s, t, _ in found), key=str) == wanted and len(wanted) > 60
    assert all(n == len(t) for _, _, t, n in found) and any(i is None for i, _, _, _ in found) and 201 not in {i for i, *_ in found}
