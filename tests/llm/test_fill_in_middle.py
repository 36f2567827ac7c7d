"""Fill-in-middle: piece tables, and the digests against the definition and DuckDB."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_set_operators import documents

from seqloom.llm import fill_in_middle as fim

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def by_definition(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def texts(seed=1):
    rnd = random.Random(seed)
    pieces = ["a", "é", "ö\r", "\n", "\n\n", "汉字", "𝔘", " ", "<", "<P", ">", " ", "\x0b", "\x00"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))), "s") for i in range(150)]
    special = ["", None, "\n", "\n\n\n", "one line", "x<P>y", "<M>", "a\n<S>\nb", "<P", "line\nlast<", "é" * 70_000 + "\n" + "z" * 9]
    return rows + [(1000 + i, t, None) for i, t in enumerate(special)] + [(None, "a\nb\nc", "s"), (5, "other\ntext\n", "s"), (5, "other\ntext\n", "s"), (-3, "a\nb", "s")]


def test_digests_equal_the_definition(spark, tmp_path):
    rows = texts()
    found = [tuple(r) for r in fim.digests(documents(spark, tmp_path, rows)).collect()]
    assert sorted(found, key=str) == sorted((by_definition(i, t) for i, t, _ in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_digests_equal_sql(spark, tmp_path):
    rows = [r for r in texts(2) if r[1] is None or "\x00" not in r[1]]
    docs = documents(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = [tuple(r) for r in fim.digests(docs).collect()]
    assert sorted(found, key=str) == sorted(con.sql(fim.OP11_SQL).fetchall(), key=str)


@pytest.mark.parametrize("rule", [fim.Rule(), fim.Rule(seed=3, percent=60, spm_percent=10, sentinels=("[1]", "{2}", "(3)"), unit="character")])
def test_outputs_are_restored(spark, tmp_path, rule):
    docs = documents(spark, tmp_path, texts(3)).withColumn("pieces", F.lit(1))
    out = fim.fill_in_middle(docs, rule)
    assert out.columns == [*docs.columns, "form"]
    back = fim.restored(out, rule).drop("form")
    wanted = docs.withColumn("text", F.coalesce("text", F.lit("")))
    assert sorted(map(str, back.collect())) == sorted(map(str, wanted.collect()))
    marks = [m for m in rule.sentinels]
    assert all((r.form == fim.PLAIN) or all(r.text.count(m) == 1 for m in marks) for r in out.collect())


def test_descriptors_stand_for_the_output(spark, tmp_path):
    docs = documents(spark, tmp_path, texts(4)).withColumn("form", F.lit(2.5))
    rule = fim.Rule()
    made = {(r.doc_id, r.text): r for r in fim.descriptors(docs, rule).collect()}
    buffers = lambda r: [(r.text or "").encode(), "".join(rule.sentinels).encode()]
    out = {(r.doc_id, b"".join(buffers(r)[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode()) for r in made.values()}
    assert out == {(r.doc_id, r.text) for r in fim.fill_in_middle(docs, rule).collect()}
    assert all(r.form == 2.5 and r["_form"] in ("plain", "psm", "spm") for r in made.values())


def test_empty_table_and_bad_rules(spark, tmp_path):
    docs = documents(spark, tmp_path, [(1, "a", "s")])
    assert fim.digests(docs.limit(0)).count() == 0 and fim.fill_in_middle(docs.limit(0)).count() == 0
    for marks in (("", "a", "b"), ("<P>", "<P>x", "b"), ("ab", "bc", "d"), ("x", "x", "y"), ("|3|", "a", "b")):
        with pytest.raises(ValueError):
            fim.Rule(sentinels=marks)
    with pytest.raises(ValueError):
        fim.Rule(unit="word")


def test_piece_table_cuts_and_inverse():
    whole = fim.PieceTable.of(b"abcdef").cut(2, 2, 6)
    assert [whole.pieces, bytes(whole)] == [[(0, 0, 2), (0, 2, 0), (0, 2, 4), (0, 6, 0)], b"abcdef"]
    order = (2, 0, 3, 1)
    moved = whole.arranged(order)
    assert bytes(moved) == b"cdefab" and moved.sha256() == hashlib.sha256(b"cdefab").hexdigest()
    assert moved.arranged(fim.inverse(order)).pieces == whole.pieces
    assert bytes(moved.cut(3)) == b"cdefab" and len(moved.cut(3).pieces) == 5
