"""BPE, personal data, language ID and chat against brute force, round trips and defined cases."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import bpe, chat, language_id, pii

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
KNOWN = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, tokenizers.PATTERN)


def ids(text):
    packed = ENCODER.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_bpe_equals_the_library(text):
    assert ids(text) == KNOWN.encode_ordinary(text)
    assert bpe.Decoder(ENCODER.transducer.token).text(ids(text)) == text


@pytest.mark.parametrize("piece", ["a" * 3000, " " * 3000, "ab" * 2000, "-" * 2049, "thth" * 900, "=-" * 1000])
def test_bpe_of_long_pieces(piece):
    assert ids(piece) == KNOWN.encode_ordinary(piece)


def test_agreement_equals_merging():
    rnd, t = random.Random(1), ENCODER.transducer
    for _ in range(5000):
        a, b = rnd.randrange(3000), rnd.randrange(3000)
        assert t._apart(a, b) == (t.merged(t.token[a] + t.token[b]) == [a, b])


def test_states_may_be_forgotten():
    t, text = bpe.Transducer(RANKS, most=10), "antidisestablishmentarianism" * 60
    assert t.encode(text.encode()) == t.merged(text.encode())


def test_streamed_decoding_holds_back_bytes():
    d, data = bpe.Decoder(ENCODER.transducer.token), "é𝄞ü日本"
    parts = [d.feed([RANKS[bytes((x,))]]) for x in data.encode()]
    assert b"".join(parts) + d.flush() == data.encode()
    assert all(p.decode() is not None for p in parts)


def _is_one_character(data):
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=6), st.sampled_from([c.encode() for c in "é𝄞ü日本\ud7ff\ue000"]), st.sampled_from([b"\xed\xa0", b"\xf0\x9f", b"\xf4\x90\x80\x80", b"\xc0\xaf"]))), st.randoms())
def test_decoder_is_an_incremental_utf8_machine(pieces, rng):
    """In portions of any size no character is cut, and what is no character is passed on."""
    data, d = b"".join(pieces), bpe.Decoder([bytes((x,)) for x in range(256)] + pieces)
    ids, at = [], 0
    for i, piece in enumerate(pieces):  # by bytes or as a token
        ids += list(piece) if rng.random() < 0.5 else [256 + i]
    out = []
    while at < len(ids):
        n = rng.randrange(1, 5)
        part = d.feed(ids[at : at + n])
        out.append(part)
        at += n
        # what is held back begins a character, and nothing else is
        assert len(d.held) <= 3 and (not d.held or any(_is_one_character(d.held + bytes((x,)) + more) for x in (0x80, 0x90, 0xA0) for more in (b"", b"\x80", b"\x80\x80")))
    out.append(d.flush())
    assert b"".join(out) == data and d.state == (0, 0)
    assert "".join(p.decode("utf-8", "replace") for p in out) == data.decode("utf-8", "replace")


def test_bpe_query_columns(spark):
    docs = spark.createDataFrame([(1, "Hello there", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, id string")
    found = bpe.token_digests(docs, PATH, tokenizers.PATTERN).orderBy("id").collect()
    assert [r.n_tokens for r in found] == [2, 0, 0, 0]
    assert found[0].decoded_sha256 == hashlib.sha256(b"Hello there").hexdigest()
    assert found[0].ids_sha256 == hashlib.sha256(struct.pack("<2I", *KNOWN.encode_ordinary("Hello there"))).hexdigest()
    assert bpe.token_digests(docs.limit(0), PATH, tokenizers.PATTERN).count() == 0
    tokens = bpe.with_tokens(docs, PATH, tokenizers.PATTERN)
    assert tokens.columns == ["doc_id", "text", "id", "tokens"]
    back = bpe.decoded(tokens.select(F.col("doc_id").alias("id"), "tokens"), PATH).orderBy("id").collect()
    assert [r.decoded for r in back] == ["Hello there", "", "", ""]


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, p in enumerate(BASE.values()):
        for m in re.finditer(p, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = [lambda: True, lambda: all(int(x) <= 255 for x in s.split(".")), lambda: 12 <= len(d) <= 19 and pii.luhn(d), lambda: 9 <= len(d) <= 15]  # noqa: B023
            if ok[k]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ12345 67890.@+-()%_\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_hostile_texts_are_linear():
    for text in ("1" * 100_000, "1." * 50_000, "a" * 100_000 + "@", "@" * 50_000, "+1 " * 30_000, "a@b.c " * 10_000):
        base = pii.base_spans(text)
        pii.candidates(text, base)


CARD = "4111111111111111"


def _fitted():
    texts = [f"call +1 ({i}) 555-{1000 + i} or mail me.{i}@x{i}.com from 10.{i}.0.1 with {CARD} not 41111111111111{i % 90 + 10}" for i in range(200, 255)]
    return pii.fit(texts)


def test_field_finds_what_the_rules_refuse_for_their_neighbours():
    field = _fitted()
    text = "Des +1 (826) 555-4081 190.137.223.204 du"
    base, units = pii._units(text)
    assert [k for _, k, _ in base] == [1]
    assert pii.additional(field, text, units) == [(4, 3, 21)]


def test_field_leaves_clean_texts_alone():
    field = _fitted()
    for text in ("order 8007782375593431 of 2024, 3.", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "see section 12.4 and 1234567"):
        _, units = pii._units(text)
        assert not units or pii.additional(field, text, units) == []


def _marked(field, text):
    _, units = pii._units(text)
    return [(text[a:b], pii.KINDS[k]) for a, k, b in pii.additional(field, text, units)]


UNCLEAR = {"phone": ("+1 (415) 555-7788", "415 555 7788"), "card": (CARD, "4111********1111"), "email": ("ann.lee@site.example.com", "ann.lee (at) site (dot) example (dot) com"), "ip": ("10.231.4.17", "10-231-4-17")}


@pytest.mark.parametrize("kind", list(UNCLEAR))
def test_clear_twin_far_away_decides_an_unclear_mention(kind):
    field, (clear, unclear) = _fitted(), UNCLEAR[kind]
    far = " and so on" * 2_000
    assert _marked(field, f"we had {unclear} there{far}") == []
    assert (unclear, kind) in _marked(field, f"see {clear} first{far} we had {unclear} there")
    # without skip potentials, and beside other content, it stays unclear
    apart = pii.Field(field.unary, field.chain, field.skip * 0)
    assert _marked(apart, f"see {clear} first{far} we had {unclear} there") == []
    assert _marked(field, f"see {clear} first{far} we had {pii._decoy(unclear, random.Random(3))} there") == []


def test_held_out_masked_mentions():
    """Mentions of documents that the field has not seen, blurred, each with a decoy of its shape."""
    field, rng = _fitted(), random.Random(7)
    hits = wrong = n = 0
    for i in range(300, 380):
        text = f"reach +1 ({i}) 555-{2000 + i} or b{i}@y{i}.org, host 172.{i % 200}.3.{i % 90}"
        start, kind, end = rng.choice(pii.base_spans(text))
        unclear = pii.blurred(kind, text[start:end])
        decoy = pii._decoy(unclear, rng)
        found = _marked(field, f"{text} much later {unclear} came up, as did {decoy} too")
        n, hits, wrong = n + 1, hits + ((unclear, pii.KINDS[kind]) in found), wrong + any(w == decoy for w, _ in found)
    assert hits >= 0.9 * n and wrong <= 0.02 * n


def test_pii_links_are_a_chain_per_key():
    same = ["+1 415 555 7788"] * 5
    assert pii.links(same) == [(i, i + 1, 0) for i in range(4)]
    assert pii.links(["a@b.com", "x", "a@c.org"]) == [(0, 2, 2)]
    assert pii.links(["+44 20 7946 0018", "020 7946 0018"]) == [(0, 1, 1)]


def test_pii_query_columns(spark):
    docs = spark.createDataFrame([(1, "x a@b.co 1.2.3.4"), (2, None), (2, None), (3, "")], "doc_id long, text string")
    found = pii.find(docs, pii.learn(docs)).orderBy("id").collect()
    assert (found[0].n_email, found[0].n_ip, found[0].n_card, found[0].n_phone) == (1, 1, 0, 0)
    assert found[0].n_spans == 2 and found[0].spans == "email:2:8,ip:9:16" and found[0].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
    assert [r.spans for r in found[1:]] == ["", "", ""] and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


# language ID


def _texts(n, seed):
    rnd = random.Random(seed)
    words = {"aa": ["thing", "ought", "with"], "bb": ["école", "être", "leçon"], "cc": ["straße", "über", "nicht"]}
    return [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(3, 30))), lang) for i in range(n) for lang in [rnd.choice(list(words))]]


def test_language_of_held_out_rows(spark):
    docs = spark.createDataFrame(_texts(200, 1), "doc_id long, text string, lang string").cache()
    found = language_id.identify(docs, language_id.learn(docs)).join(docs, F.col("id") == F.col("doc_id"))
    n, ok = found.filter("held_out").agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and ok >= 0.95 * n
    low, high = found.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_language_defined_cases(spark):
    rows = [*_texts(60, 2), (1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", None), (None, "thing with", "aa"), (1003, "école " * 30_000, "bb"), (1003, "école " * 30_000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    found = {r.id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert found[1000] == found[1001] == found[1002] == ("und", 0.0)
    assert found[1003][0] == "bb" and found[None][0] == "aa"
    assert language_id.kept_documents(docs).count() == docs.count() - 3
    empty = docs.limit(0)
    assert language_id.learn(empty) is None and language_id.identify(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_languages_of_many_scripts(spark):
    """Far more letters than those of one alphabet, none of which stands for another."""
    rnd = random.Random(8)
    scripts = {"el": 0x3B1, "ru": 0x430, "ru2": 0x440, "he": 0x5D0, "hi": 0x915, "th": 0xE01, "zh": 0x4E00, "zh2": 0x5E00, "ko": 0xAC00, "ko2": 0xB000}
    word = lambda at: "".join(chr(at + rnd.randrange(12)) for _ in range(4))
    rows = [(i, " ".join(word(at) for _ in range(12)), lang) for i in range(400) for lang, at in [rnd.choice(list(scripts.items()))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    found = language_id.identify(docs, language_id.learn(docs)).filter("held_out").join(docs, F.col("id") == F.col("doc_id"))
    n, ok = found.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 50 and ok >= 0.98 * n


def test_kernel_equals_its_definition():
    texts = ["the other", "être là", "die straße"]
    g = language_id.Grams()
    for t in texts:  # presence of each n-gram of lengths 1 to 3, gaps around
        assert len(g.presence(t)) == len({f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)})
    sets = [set(g.presence(t).tolist()) for t in texts]
    grams = np.unique(np.concatenate([g.presence(t) for t in texts]))
    z = np.array([[(x in s) / len(s) ** 0.5 for s in sets] for x in grams.tolist()], np.float32)
    k = language_id._kernel([g.presence(t) for t in texts], grams, z)
    assert np.allclose(k, [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets], atol=1e-6)


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "<|im_end|>"]), st.text(alphabet="<|\\im_end>\nax")), max_size=6))
def test_chat_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [x for r, x in turns if r == "assistant"]


def test_paths_of_a_tree(spark):
    nodes = spark.createDataFrame(
        [(7, 1, None, "user", "q", 0.0), (7, 2, 1, "assistant", "good", 3.0), (7, 3, 1, "assistant", "bad", 1.0), (7, 4, 2, "user", "more", 0.0), (7, 9, 77, "user", "lost", 0.0)],
        "tree long, node long, parent long, role string, text string, score double",
    )
    found = [(r.leaf, r["rank"], [t.text for t in r.turns]) for r in chat.branches(nodes).orderBy("rank").collect()]
    assert found == [(4, 1, ["q", "good", "more"]), (3, 2, ["q", "bad"]), (9, 3, ["lost"])]
    assert chat.branches(nodes, most=1).count() == 1


def test_long_chain_and_defined_cases(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(37)] + [(2, 0, None, None), (2, 0, None, None), (None, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.read_back(chat.formatted(chat.branches(chat.chain(frame, "conv_id", "turn", "role", "text")))).collect()
    by = {r.tree: r for r in done}
    assert by[1].n_turns == 37 and by[2].n_turns == 2 and by[None].n_turns == 1
    assert by[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows[:37]).encode()).hexdigest()
    assert by[1].loss_sha256 == hashlib.sha256("".join(x for _, _, r, x in rows[:37] if r == "assistant").encode()).hexdigest()
    assert chat.branches(chat.chain(frame.limit(0), "conv_id", "turn", "role", "text")).count() == 0
