"""Operator 11: fill-in-middle transformation over piece tables.

A document is never rewritten: it is a list of descriptors (buffer, start, length) over two immutable
buffers, its own UTF-8 text and the sentinels. Cutting splits a descriptor in two, an arrangement permutes
the descriptors of prefix, middle and suffix and puts one of a sentinel before each, the inverse permutation
restores them, and hashes stream through the descriptors without putting the text together. A task holds
one batch of texts and the numbers of one document's line ends; nothing is shuffled.

A text of n units (lines or code points) is cut at two of the n + 1 places before, between and after them.
Places, and which form a document takes, follow from the SHA-256 of seed and id, so reruns and lost
executors change nothing. Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and
``plain``, which is the text as it is.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null id is
hashed as an empty string; rows of equal id are cut by the same numbers, each in its own text; parts may be
empty; an empty table gives an empty result; further columns are kept or ignored, whatever their names, and
an output column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, table

SEED, PERCENT, SPM_PERCENT = 7, 100, 50
#: Before prefix, middle and suffix.
SENTINELS = ("<P>", "<M>", "<S>")
#: The order of prefix (0), middle (1) and suffix (2) in a form.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN = "plain"
TEXT, SENTINEL = 0, 1
UNITS = ("line", "character")


@dataclass(frozen=True)
class Rule:
    """How documents are cut and arranged. percent: of documents that aren't plain; spm_percent: of those, in form spm."""

    seed: int = SEED
    percent: int = PERCENT
    spm_percent: int = SPM_PERCENT
    sentinels: tuple[str, str, str] = SENTINELS
    unit: str = "line"

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {UNITS}")
        marks = [s.encode() for s in self.sentinels]
        if len(marks) != 3 or not all(marks):
            raise ValueError("there are three sentinels, none of them empty")
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError("sentinels may not hold or overlap one another or themselves: they could not be told apart in an output")

    def numbers(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


class PieceTable:
    """Descriptors (buffer, start, length) over immutable buffers of bytes."""

    def __init__(self, buffers: list, pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = [memoryview(b) for b in buffers], list(pieces)

    @classmethod
    def of(cls, text, sentinels: bytes = b"") -> PieceTable:
        return cls([text, sentinels], [(TEXT, 0, len(memoryview(text)))])

    def cut(self, *places: int) -> PieceTable:
        """Split at places of the present order (not falling); a cut at an end leaves an empty piece there."""
        pieces, at, ahead = [], 0, list(places)
        for i, (buffer, start, length) in enumerate(self.pieces):
            last = i + 1 == len(self.pieces)
            while ahead and (ahead[0] < at + length or last):
                here = ahead.pop(0) - at
                pieces.append((buffer, start, here))
                start, length, at = start + here, length - here, at + here
            pieces.append((buffer, start, length))
            at += length
        return PieceTable(self.buffers, pieces)

    def arranged(self, order: tuple[int, ...], before: list[tuple[int, int, int]] | None = None) -> PieceTable:
        """The pieces in another order, each after its piece of ``before``."""
        return PieceTable(self.buffers, [p for i in order for p in ([before[i]] if before else []) + [self.pieces[i]]])

    def chunks(self) -> Iterator[memoryview]:
        return (self.buffers[b][start : start + length] for b, start, length in self.pieces if length)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.chunks())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(i) for i in np.argsort(order))


def n_characters(part) -> int:
    """Code points of valid UTF-8: bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def unit_ends(text, unit: str) -> np.ndarray:
    """Where each unit ends, in bytes."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    found = np.flatnonzero(data == 10) + 1 if unit == "line" else np.flatnonzero((data & 0xC0) != 0x80)[1:]
    return found if len(found) and found[-1] == len(data) else np.append(found, len(data))


def arrange(text, doc_id: int | None, rule: Rule) -> tuple[str, int, PieceTable, PieceTable]:
    """form, number of units, the three parts and the output of a text (bytes)."""
    marks = [s.encode() for s in rule.sentinels]
    ends = unit_ends(text, rule.unit)
    n, (h1, h2, h3, h4) = len(ends), rule.numbers(doc_id)
    whole = PieceTable.of(text, b"".join(marks))
    held = bytes(text)
    if not n or h3 % 100 >= rule.percent or any(m in held for m in marks):
        return PLAIN, n, whole, whole
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = whole.cut(*[int(ends[k - 1]) if k else 0 for k in (a, b)])
    starts = [0, len(marks[0]), len(marks[0]) + len(marks[1])]
    form = "spm" if h4 % 100 < rule.spm_percent else "psm"
    return form, n, parts, parts.arranged(FORMS[form], [(SENTINEL, s, len(m)) for s, m in zip(starts, marks, strict=True)])


def restore(output, form: str, rule: Rule) -> PieceTable:
    """The text of an output (bytes): cut at its sentinels, their pieces left out, the others in first order."""
    whole = PieceTable.of(output)
    if form == PLAIN:
        return whole
    held, places, at = bytes(output), [], 0
    for part in FORMS[form]:
        mark = rule.sentinels[part].encode()
        at = held.index(mark, at)
        places += [at, at + len(mark)]
        at += len(mark)
    pieces = whole.cut(*places).pieces[2::2]  # what lies after each sentinel
    return PieceTable(whole.buffers, pieces).arranged(inverse(FORMS[form]))


def _bytes(value) -> memoryview | bytes:
    return memoryview(value.as_buffer()) if value.is_valid else b""


def _mapped(docs: DataFrame, make, fields: list[tuple[str, T.DataType]], text_col: str, replaced: bool) -> DataFrame:
    """docs, its text made a string or replaced by what make gives first, with further columns from make(batch, texts)."""
    kept = docs.withColumn(text_col, F.col(text_col).cast("string"))
    names = free_names(docs, *[n for n, _ in fields])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, (_, t) in zip(names, fields, strict=True)]])
    at = kept.columns.index(text_col)

    def run(batches):
        for batch in batches:
            first, *more = make(batch)
            columns = [pa.array(first, pa.string()) if replaced and i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def _ids(docs: DataFrame, id_col: str) -> int:
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError(f"{id_col} is no integer")
    return docs.columns.index(id_col)


_PIECES = T.ArrayType(T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_ARROW_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def descriptors(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """docs with form and pieces: the output as descriptors over the text (buffer 0) and the sentinels put
    together (buffer 1), in bytes of UTF-8. The text stays as it is."""
    i, t = _ids(docs, id_col), docs.columns.index(text_col)

    def make(batch):
        found = [arrange(_bytes(x), d.as_py(), rule) for d, x in zip(batch.column(i), batch.column(t), strict=True)]
        pieces = [[dict(zip(("buffer", "start", "length"), p, strict=True)) for p in out.pieces] for _, _, _, out in found]
        return None, pa.array([form for form, *_ in found], pa.string()), pa.array(pieces, _ARROW_PIECES)

    return _mapped(docs, make, [("form", T.StringType()), ("pieces", _PIECES)], text_col, False)


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """docs with the output in place of the text, and form."""
    i, t = _ids(docs, id_col), docs.columns.index(text_col)

    def make(batch):
        found = [arrange(_bytes(x), d.as_py(), rule) for d, x in zip(batch.column(i), batch.column(t), strict=True)]
        return [bytes(out).decode() for *_, out in found], pa.array([form for form, *_ in found], pa.string())

    return _mapped(docs, make, [("form", T.StringType())], text_col, True)


def restored(outputs: DataFrame, rule: Rule = Rule(), form_col: str = "form", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The texts again, of outputs and their forms; all other columns as they came."""
    f, t = outputs.columns.index(form_col), outputs.columns.index(text_col)

    def make(batch):
        return ([bytes(restore(_bytes(x), form.as_py(), rule)).decode() for form, x in zip(batch.column(f), batch.column(t), strict=True)],)

    return _mapped(outputs, make, [], text_col, True)


def digests(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per row of docs: id, n, form, prefix_chars, middle_chars (null if plain), output_sha256, restored_sha256.

    The output's hash streams its descriptors; the restored text is read back from the output's bytes.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for d, x in zip(batch.column(0), batch.column(1), strict=True):
                form, n, parts, out = arrange(_bytes(x), d.as_py(), rule)
                sizes = [None, None] if form == PLAIN else [n_characters(parts.buffers[b][s : s + m]) for b, s, m in parts.pieces[:2]]
                rows.append((n, form, *sizes, out.sha256(), restore(bytes(out), form, rule).sha256()))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, body, CASE WHEN body LIKE '%' || chr(10) THEN string_split(body, chr(10))[:-2] ELSE string_split(body, chr(10)) END AS parts,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, CASE WHEN body = '' THEN 0 ELSE len(parts) END AS n, ends_with(body, chr(10)) AS closed FROM u),
k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
l AS (
  SELECT *, CASE WHEN a = 0 THEN 0 ELSE length(array_to_string(parts[:a], chr(10))) + (a < n OR closed)::INT END AS x,
         CASE WHEN b = 0 THEN 0 ELSE length(array_to_string(parts[:b], chr(10))) + (b < n OR closed)::INT END AS y FROM k),
p AS (
  SELECT *, left(body, x) AS prefix, substr(body, x + 1, y - x) AS middle, substr(body, y + 1) AS suffix FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(x AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(y - x AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
