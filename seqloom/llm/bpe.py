"""Operator 1: byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that is determinised only as far as texts
ask for it. It rests on a property of BPE: a token sequence is the encoding of its bytes exactly if
each adjacent pair of tokens is the encoding of its own bytes (Berglund & van der Merwe,
"Formalizing BPE Tokenization", 2023). So the last token of every prefix of a piece is the one token
that ends there and agrees with the last token of the prefix before it. A state holds the longest
suffix read that begins some token, and the last tokens at the places where the next token may
begin. Agreement of two tokens is decided once, by merging their bytes, and remembered, as are
transitions and the encodings of short pieces; each memory is emptied when it is full.

Tokens are emitted as soon as all places where a later token may begin agree on them, so a piece of
any length is encoded in a small buffer. Decoding streams ids through a state machine for UTF-8
that holds back the bytes of an unfinished character.

Everything is per document and needs no shuffle; the rank file is read once on the driver and
broadcast (a file of fixed size, below 1 MB).

Defined cases: a null text counts as empty and has no tokens; very long texts and very long pieces
are read whole; ids that are null or no tokens raise on decoding; an empty table gives an empty
result; further columns are ignored or, in ``with_tokens``, kept.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, table

#: Places of a piece after which tokens are emitted where they are certain.
EMIT_EVERY = 256
_SHORT_PIECE = 64
#: Pieces that a task remembers (about 0.5 KB each with the states and pairs that go with them).
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The bytes of each id; None where an id is free."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


class Transducer:
    """Encodes one piece of bytes at a time."""

    def __init__(self, ranks: dict[bytes, int], most: int = REMEMBERED):
        self.most_states, self.most_pairs = most // 2, most * 3 // 4
        self.ranks, self.token = ranks, token_table(ranks)
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.states = {(b"", (-1,)): 0}
        self.keys, self.last, self.moves = [(b"", (-1,))], [-1], {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: again and again the pair of lowest rank is merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            options = [x for x in options if x[0] is not None]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.splits:
            data, parts = self.token[token], [bytes((x,)) for x in self.token[token]]
            while len(parts) > 2:
                _, i = min((r, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(a + b)) is not None)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(data) > 1 else None
        return self.splits[token]

    def agree(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, together, are encoded as these two."""
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Undoes the merges of both tokens from the last on. At each point of time the parts that touch
        must not merge before the merge that was undone: else the boundary had been merged away.

        Of two merges of one rank the left one comes first, so the boundary pair loses to a merge in a
        of its own rank and wins over one in b.
        """
        token, ranks = self.token, self.ranks
        until = len(ranks) * 2  # twice the rank that must not be undercut, plus 1 if equality counts
        while True:
            both = ranks.get(token[a] + token[b])
            if both is not None and 2 * both < until:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                until, a = 2 * a, left[1]
            else:
                until, b = 2 * b + 1, right[0]

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte, made when it is first asked for."""
        suffix, back = self.keys[state]
        suffix += bytes((byte,))
        while suffix not in self.begins:
            suffix = suffix[1:]
        for at in range(len(suffix)):
            token = self.ranks.get(suffix[at:])
            # back[k] is the last token k bytes before this byte, -1 at the beginning
            if token is not None and ((before := back[len(suffix) - at - 1]) < 0 or self.agree(before, token)):
                break
        key = (suffix, (token, *back)[: len(suffix) + 1])
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.last.append(token)
        self.moves[state << 8 | byte] = new
        return new

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.keys) > self.most_states:
            self._forget()
        out: list[int] = []
        moves, last, state = self.moves, self.last, 0
        ends: list[int] = []  # the last token at each place since the last emitted one
        for n, byte in enumerate(piece, 1):
            state = moves.get(state << 8 | byte) or self.move(state, byte)
            ends.append(last[state])
            if n % EMIT_EVERY == 0:
                self._emit(ends, len(self.keys[state][0]), out)
                if len(self.keys) > self.most_states:
                    key = self.keys[state]
                    self._forget()
                    moves, last, state = self.moves, self.last, 1
                    self.states[key] = 1
                    self.keys.append(key)
                    last.append(key[1][0])
        out += self._back(ends, len(ends))
        return out

    def _back(self, ends: list[int], at: int) -> list[int]:
        found = []
        while at > 0:
            found.append(ends[at - 1])
            at -= len(self.token[found[-1]])
        return found[::-1]

    def _emit(self, ends: list[int], reach: int, out: list[int]) -> None:
        """Moves to ``out`` the tokens that all places within ``reach`` of the end agree on."""
        common: set[int] | None = None
        for at in range(len(ends) - reach, len(ends) + 1):
            bounds, x = set(), at
            while x > 0:
                bounds.add(x)
                x -= len(self.token[ends[x - 1]])
            common = bounds if common is None else common & bounds
        if common:
            sure = max(common)
            out += self._back(ends, sure)
            del ends[:sure]


class Encoder(dict):
    """Texts to packed ids (unsigned 32-bit, little-endian). Maps short pieces to theirs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = REMEMBERED):
        super().__init__()
        self.most = most
        self.transducer, self.split = Transducer(ranks, most), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.transducer.encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= _SHORT_PIECE:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text or "")))


#: Next state by (state, byte class) of the machine for UTF-8; what is not listed rejects.
_CLASSES = [(0x00, 0x7F), (0x80, 0x8F), (0x90, 0x9F), (0xA0, 0xBF), (0xC2, 0xDF), (0xE0, 0xE0), (0xE1, 0xEC), (0xED, 0xED), (0xEE, 0xEF), (0xF0, 0xF0), (0xF1, 0xF3), (0xF4, 0xF4)]
_CLASS = [next((k for k, (a, b) in enumerate(_CLASSES) if a <= x <= b), 12) for x in range(256)]
_NEXT = {
    0: {0: 0, 4: 2, 5: 4, 6: 3, 7: 5, 8: 3, 9: 6, 10: 7, 11: 8},
    2: {1: 0, 2: 0, 3: 0},  # one more byte
    3: {1: 2, 2: 2, 3: 2},  # two more
    4: {3: 2},  # after E0: A0..BF
    5: {1: 2, 2: 2},  # after ED: 80..9F
    6: {2: 3, 3: 3},  # after F0: 90..BF
    7: {1: 3, 2: 3, 3: 3},  # three more
    8: {1: 3},  # after F4: 80..8F
}


def step(state: int, read: int, data: bytes) -> tuple[int, int]:
    """The machine after data: its state and how many bytes of an unfinished character it has read.

    A byte that doesn't go on ends the character before it, which is none, and begins the next.
    """
    for byte in data:
        after = _NEXT[state].get(_CLASS[byte])
        if after is None and state:
            after, read = _NEXT[0].get(_CLASS[byte]), 0
        state, read = (after, read + 1) if after else (0, 0)
    return state, read


class Decoder:
    """Ids to text, in portions of any size; what is no UTF-8 becomes U+FFFD.

    The state of the machine is carried from token to token. What a token does to a state is worked out
    when it is first met; tokens that lead from the beginning of a character to another are passed over
    together.
    """

    def __init__(self, token: list[bytes | None]):
        self.token, self.moves = token, {}
        self.opens = np.array([t is not None and step(0, 0, t) != (0, 0) for t in token], bool)
        self.state, self.held = (0, 0), b""

    def _move(self, state: tuple[int, int], i: int) -> tuple[int, int]:
        key = (*state, i)
        found = self.moves.get(key)
        if found is None:
            found = self.moves[key] = step(*state, self.token[i])
        return found

    def feed(self, ids) -> bytes:
        """The bytes of all characters that are complete now."""
        data = self.held + b"".join(map(self.token.__getitem__, ids))
        state, at = self.state, 0
        for opened in np.flatnonzero(self.opens[np.asarray(ids, np.int64)]).tolist() if len(ids) else []:
            while state[0] and at < opened:
                state, at = self._move(state, ids[at]), at + 1
            if at <= opened:
                state, at = self._move(state, ids[opened]), opened + 1
        while state[0] and at < len(ids):
            state, at = self._move(state, ids[at]), at + 1
        self.state = state
        keep = len(data) - state[1]
        self.held = data[keep:]
        return data[:keep]

    def flush(self) -> bytes:
        data, self.held, self.state = self.held, b"", (0, 0)
        return data

    def text(self, ids) -> str:
        return (self.feed(ids) + self.flush()).decode("utf-8", "replace")


_PORTION = 65_536
#: Rows whose tokens leave a task at once.
_ROWS = 500


def _digests(vocabulary, pattern: str):
    def run(batches):
        encoder = Encoder(vocabulary.value, pattern)
        decoder = Decoder(encoder.transducer.token)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                numbers, digest = array("I", ids), hashlib.sha256()
                for at in range(0, len(numbers), _PORTION):
                    digest.update(decoder.feed(numbers[at : at + _PORTION]))
                digest.update(decoder.flush())
                of_bytes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_digests(_broadcast(docs.sparkSession, path), pattern), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", tokens_col: str = "tokens", remembered: int = REMEMBERED) -> DataFrame:
    """docs with a column of token ids (array<int>); an own column of that name gets underscores before its name."""
    vocabulary = _broadcast(docs.sparkSession, path)
    own = next((c for c in docs.columns if c.lower() == tokens_col.lower()), None)
    kept = docs if own is None else docs.withColumnRenamed(own, *free_names(docs, own))
    (held,) = free_names(kept, "bpe_text")

    def run(batches):
        encoder = Encoder(vocabulary.value, pattern, remembered)
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            lists = [np.frombuffer(encoder.encode(x.as_py()), "<i4") for x in batch.column(batch.num_columns - 1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], [*batch.schema.names[:-1], tokens_col])

    schema = T.StructType([*kept.schema.fields, T.StructField(tokens_col, T.ArrayType(T.IntegerType()))])
    return kept.withColumn(held, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decoded(frame: DataFrame, path: str, tokens_col: str = "tokens", text_col: str = "decoded") -> DataFrame:
    """frame (id, tokens) -> (id, text)."""
    vocabulary = _broadcast(frame.sparkSession, path)

    def run(batches):
        decoder = Decoder(token_table(vocabulary.value))
        for batch in batches:
            texts = [decoder.text(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", text_col])

    return frame.select("id", tokens_col).mapInArrow(run, f"id long, {text_col} string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")
