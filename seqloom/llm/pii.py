"""Operator 3: personal data by rules and a skip-chain conditional random field.

Rules find the base spans (email, ip, card, phone). The field then labels what the rules leave: the
units of a document are its base spans, whose labels are held, and candidates (words with seven digits
or ``@``, numbers in groups, addresses that are spelled ``name (at) host (dot) top``). A unit has unary
potentials over its shape and the words beside it; neighbouring units share a transition potential; and
units of equal or similar content (``LINKS``), however far apart, share a skip potential. Loopy
sum-product message passing gives each unit's marginals; a candidate with a marginal of ``SURE`` or more
for a kind becomes an additional span. So a number that could be anything is a phone number where a
clear mention of it stands elsewhere in the document.

Similar content is linked in a chain (each mention with the next of the same key), so links grow with
the mentions and not with their square.

Unary, transition and skip weights are trained together, by pseudo-likelihood, on the driver on a bounded
sample: at most ``FITTED_DOCUMENTS`` documents with a mark of personal data, of smallest text hash, with
texts of up to ``LONGEST_FITTED`` characters. The rules label their units. To learn what an unclear
mention is worth, mentions are also shown blurred (a national number, a masked card, a spelled address),
some beside their clear twin and some alone, and each blurred one has a decoy: other content of the same
shape, which is none of the kinds, once or repeated. The weights apply to every row and whole text.

Defined cases: a null text is empty and has no spans; repeated rows are judged alike; spans of one kind
never overlap, and an additional span overlaps no other; an empty table gives an empty result; where no
document can be learned from only the rules apply; very long texts are read whole, in time proportional
to their length; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone"]
OTHER, N_LABELS = len(KINDS), len(KINDS) + 1
SURE, ROUNDS, DAMPING = 0.9, 20, 0.3
FITTED_DOCUMENTS, LONGEST_FITTED = 3_000, 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and not from the middle of a number: finds the same and stays linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str):
    """Leftmost matches of the address pattern: grown to both sides from each @."""
    after, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        begin = at
        if m:
            while begin > after and text[begin - 1] in _LOCAL:
                begin -= 1
        if m and begin < at:
            yield begin, m.end()
            after = m.end()
        at = text.find("@", max(after, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# candidates: a number with a country code in groups of 2 to 4 digits, one without, a spelled address,
# or a word with a digit or @
_NUMBER = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9.])")
_GROUPS = re.compile(r"(?<![0-9+(.])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9.])")
_AT = re.compile(r"\x20?[\[(]at[\])]\x20?", re.IGNORECASE)
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_DOT = re.compile(r"\x20?[\[(]dot[\])]\x20?", re.IGNORECASE)
_MARKED = re.compile(r"[0-9@]|[\[(]at[\])]", re.IGNORECASE)
_WORDLY = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_EDGE = "\"'`.,;:!?*#$%&|<>[]{}()="
FEWEST_DIGITS, MOST_DIGITS = 7, 19


def _spelled(text: str):
    """Addresses written ``name (at) host (dot) top``, grown to both sides from each (at)."""
    after = 0
    for at in _AT.finditer(text):
        begin = at.start()
        while begin > after and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _SPELLED.match(text, at.end())
        if m and after <= begin < at.start():
            yield begin, m.end()
            after = m.end()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that the field may label, none of which overlaps a base span or another candidate."""
    taken = sorted((a, b) for a, _, b in base)
    found: list[tuple[int, int]] = []

    def offer(spans) -> None:
        held = sorted(taken + found)
        starts = [a for a, _ in held]
        reach = list(accumulate((b for _, b in held), max))  # the furthest end among the spans so far
        for a, b in spans:
            before = bisect_left(starts, b)  # spans that begin before this one ends
            if not before or reach[before - 1] <= a:
                found.append((a, b))

    if "+" in text:
        offer([m.span() for m in _NUMBER.finditer(text)])
    offer(_spelled(text))
    offer([m.span() for m in _GROUPS.finditer(text) if FEWEST_DIGITS <= len(_digits(m.group())) <= MOST_DIGITS])
    blocked = sorted(taken + found)
    out, i, at, n = list(found), 0, 0, len(text)
    while m := _WORDLY.search(text, at):
        p = m.start()
        while i < len(blocked) and blocked[i][1] <= p:
            i += 1
        if i < len(blocked) and blocked[i][0] <= p:
            at = blocked[i][1]
            continue
        begin = max(text.rfind(c, at, p) for c in " \n\t\r") + 1
        begin = max(begin, at)
        end_at = _SPACE.search(text, p)
        end = end_at.start() if end_at else n
        if i < len(blocked) and blocked[i][0] < end:
            end = blocked[i][0]
        word = text[begin:end]
        core = word.strip(_EDGE)
        if "@" in core or len(_digits(core)) >= FEWEST_DIGITS:
            a = begin + word.index(core)
            out.append((a, a + len(core)))
        at = max(end, p + 1)
    return sorted(out)


#: Buckets of the words beside a unit.
_CONTEXT = 24
N_FEATURES = 18 + len(KINDS) + 2 * _CONTEXT


@dataclass(frozen=True)
class Unit:
    text: str
    before: str = ""
    after: str = ""


def _quad(s: str) -> list[str]:
    parts = re.split(r"[.-]", s)
    return parts if len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts) else []


def _alone(s: str) -> int:
    """The kind that the rules see in s by itself, OTHER for none: a candidate that has one was refused for its neighbourhood."""
    return next((k for a, k, b in base_spans(s) if a == 0 and b == len(s)), OTHER)


def features(u: Unit) -> np.ndarray:
    s, d = u.text, _digits(u.text)
    f = [
        1, "@" in s, "@" in s and "." in s.rpartition("@")[2].strip("."), s.startswith("+"), len(d) >= 7, 9 <= len(d) <= 15, 12 <= len(d) <= 19,
        12 <= len(d) <= 19 and luhn(d), bool(_quad(s)), bool(_quad(s)) and "-" not in s, any(c.isalpha() for c in s), "(" in s, "-" in s, len(d) == len(s),
        len(d) > 19, len(d) < 4, "*" in s, bool(_AT.search(s)),
    ]
    f += [_alone(s) == k for k in range(len(KINDS))]
    beside = np.zeros(2 * _CONTEXT)
    for k, w in enumerate((u.before, u.after)):
        if w:
            beside[k * _CONTEXT + zlib.crc32(w.encode("utf-8", "surrogatepass")) % _CONTEXT] = 1
    return np.concatenate([np.array(f, float), beside])


#: What units are linked by: the same content; the last seven digits; the local part of an address;
#: the first and last four digits, as of a masked number.
LINKS = ["same", "tail", "local", "ends"]


def keys(s: str) -> list[tuple[int, str]]:
    """(kind of link, key) of a unit's content."""
    address = _DOT.sub(".", _AT.sub("@", s)).lower()
    if "@" in address:
        return [(0, address), (2, address.partition("@")[0])]
    if quad := _quad(s):
        return [(0, ".".join(quad))]
    d = _digits(s)
    if any(c.isalpha() for c in s) or len(d) < FEWEST_DIGITS:
        return []
    return ([(0, d), (1, d[-7:])] if "*" not in s else []) + ([(3, d[:4] + "*" + d[-4:])] if len(d) >= 12 or "*" in s else [])


@dataclass
class Field:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # log potentials of neighbouring labels
    skip: np.ndarray  # log potentials of linked labels, one symmetric matrix for each kind of link


def links(units: list[str]) -> list[tuple[int, int, int]]:
    """(i, j, kind): units with a common key, each mention with the next one; one link a pair, its strongest kind."""
    seen: dict[tuple[int, str], int] = {}
    found: dict[tuple[int, int], int] = {}
    for i, s in enumerate(units):
        for key in keys(s):
            if key in seen:
                pair = (seen[key], i)
                found[pair] = min(found.get(pair, len(LINKS)), key[0])
            seen[key] = i
    return [(i, j, kind) for (i, j), kind in sorted(found.items())]


def _beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The words next to a span, their letters in lower case; looked for within 40 characters."""
    left, right = text[max(0, a - 40) : a].split(), text[b : b + 40].split()
    only = lambda w: "".join(filter(str.isalpha, w)).lower()
    return only(left[-1]) if left else "", only(right[0]) if right else ""


def _units(text: str):
    base = base_spans(text)
    free = candidates(text, base)
    spans = sorted([(a, b, k) for a, k, b in base] + [(a, b, OTHER) for a, b in free])
    return base, spans


def blurred(kind: int, s: str) -> str:
    """A mention as the rules don't know it."""
    if KINDS[kind] == "email":
        local, _, host = s.partition("@")
        return f"{local} (at) {host.replace('.', ' (dot) ')}"
    if KINDS[kind] == "ip":
        return s.replace(".", "-")
    d = _digits(s)
    if KINDS[kind] == "card":
        return f"{d[:4]}********{d[-4:]}"
    return f"{d[-10:-7]} {d[-7:-4]} {d[-4:]}".strip()


def _decoy(s: str, rng: random.Random) -> str:
    """Other content of the same shape; spelled and dotted marks stay."""
    keep = {i for m in re.finditer(r"[\[(](?:at|dot)[\])]", s) for i in range(*m.span())}
    swap = lambda c: str(rng.randrange(1, 10)) if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c
    return "".join(c if i in keep else swap(c) for i, c in enumerate(s))


def _shown(text: str, rng: random.Random) -> tuple[list[Unit], list[int]]:
    """The units of a text to learn from and their labels, blurred mentions and decoys among them."""
    _, spans = _units(text)
    units = [Unit(text[a:b], *_beside(text, a, b)) for a, b, _ in spans]
    rows = [(u, k if k != OTHER else _alone(u.text)) for u, (_, _, k) in zip(units, spans, strict=True)]
    for u, k in list(rows):
        if k == OTHER:
            continue
        # blurred forms take over the words beside the mention, decoys any others of the text
        hidden, where = Unit(blurred(k, u.text), u.before, u.after), rng.randrange(max(1, len(text) - 80))
        decoy = Unit(_decoy(hidden.text, rng), *_beside(text, where + 40, where + 40))
        turn = rng.randrange(4)
        if turn < 2:  # beside its clear twin
            rows.insert(rng.randrange(len(rows) + 1), (hidden, k))
        elif turn == 2:  # alone
            rows[next(i for i, r in enumerate(rows) if r[0] is u)] = (hidden, k)
        for _ in range(1 + rng.randrange(2)):
            rows.insert(rng.randrange(len(rows) + 1), (decoy, OTHER))
    return [u for u, _ in rows], [k for _, k in rows]


def fit(texts: list[str], rounds: int = 800, rate: float = 0.05, ridge: float = 2e-5, shy: float = 5e-3) -> Field | None:
    """All weights together, by the pseudo-likelihood of each unit's label given those of its neighbours and links.

    Words beside a unit and neighbours are weak evidence of many kinds: their weights are kept smaller, by ``shy``.
    """
    x, y, before, after, linked = [], [], [], [], []
    rng = random.Random(20010618)
    for text in texts:
        units, labels = _shown(text, rng)
        at, n = len(x), len(units)
        x += [features(u) for u in units]
        y += labels
        before += [at + i - 1 if i else -1 for i in range(n)]
        after += [at + i + 1 if i + 1 < n else -1 for i in range(n)]
        linked += [(at + i, at + j, kind) for i, j, kind in links([u.text for u in units])]
    if not x:
        return None
    one = np.vstack([np.eye(N_LABELS)[y], np.zeros(N_LABELS)])  # the last row stands for no neighbour
    given = [np.array(x), one[before], one[after]]
    for kind in range(len(LINKS)):
        among = np.zeros((len(x), N_LABELS))
        for i, j, of in linked:
            if of == kind:
                among[i] += one[j]
                among[j] += one[i]
        given.append(among)
    truth = one[:-1]
    w = [np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), *[np.zeros((N_LABELS, N_LABELS)) for _ in LINKS]]
    kept = [np.full((N_FEATURES, 1), ridge), shy, *[ridge for _ in LINKS]]
    kept[0][-2 * _CONTEXT :] = shy
    first, second = [np.zeros_like(m) for m in w], [np.zeros_like(m) for m in w]
    for step in range(1, rounds + 1):
        z = given[0] @ w[0] + given[1] @ w[1] + given[2] @ w[1].T + sum(g @ s for g, s in zip(given[3:], w[2:], strict=True))
        p = np.exp(z - z.max(1, keepdims=True))
        miss = (truth - p / p.sum(1, keepdims=True)) / len(x)
        slopes = [given[0].T @ miss, given[1].T @ miss + miss.T @ given[2]]
        slopes += [(m + m.T) / 2 for m in (g.T @ miss for g in given[3:])]
        for k, slope in enumerate(slopes):  # ascent with moments (Kingma & Ba, 2015)
            slope = slope - kept[k] * w[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            w[k] = w[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(w[0], w[1], np.array(w[2:]))


def marginals(field: Field, units: list[Unit], held: list[int]) -> np.ndarray:
    """Of each unit, by damped loopy sum-product over the chain and the skip links. held: the
    label of a unit that is given, or OTHER for one that is to be found."""
    n = len(units)
    unary = np.array([features(u) for u in units]) @ field.unary
    for i, k in enumerate(held):
        if k != OTHER:
            unary[i] = -50.0
            unary[i, k] = 0.0
    unary -= unary.max(1, keepdims=True)
    pairs = [(i, i + 1, field.chain) for i in range(n - 1)] + [(i, j, field.skip[kind]) for i, j, kind in links([u.text for u in units])]
    src = np.array([p[0] for p in pairs] + [p[1] for p in pairs], int)
    dst = np.array([p[1] for p in pairs] + [p[0] for p in pairs], int)
    belief = unary.copy()
    if len(pairs):
        potential = np.exp(np.array([p[2] for p in pairs] + [p[2].T for p in pairs]))
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((2 * len(pairs), N_LABELS))
        for _ in range(ROUNDS):
            cavity = belief[src] - message[back]
            cavity -= cavity.max(1, keepdims=True)
            new = np.log(np.maximum(np.einsum("ea,eab->eb", np.exp(cavity), potential), 1e-300))
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, dst, message)
            if change < 1e-4:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def additional(field: Field, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field finds beside the base spans."""
    p = marginals(field, [Unit(text[a:b], *_beside(text, a, b)) for a, b, _ in spans], [k for _, _, k in spans])
    best = p.argmax(1)
    return [(a, int(x), b) for (a, b, k), x, row in zip(spans, best, p, strict=True) if k == OTHER and x != OTHER and row[x] >= SURE]


#: Of the rows whose hash is among the smallest, so many times the sample are looked at: most have no mark.
LOOKED_AT = 30


def learn(docs: DataFrame, text_col: str = "text", most: int = FITTED_DOCUMENTS) -> Field | None:
    text = F.col(text_col).cast("string")
    # rows are counted from file footers; the hash is uniform, so a share of it bounds what each task looks at and sends
    share = min(1.0, LOOKED_AT * most / max(1, docs.count()))
    few = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).filter(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30))
    marked = few.filter(F.length("text").between(1, LONGEST_FITTED) & F.col("text").rlike(r"[0-9]{3}|@"))
    return fit([r["text"] for r in marked.orderBy("h", "text").limit(most).collect()])


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (of spans)."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in batches:
            counts, digests, all_spans, n_spans = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                if not _MARKED.search(text):
                    base, more = [], []
                else:
                    base, units = _units(text)
                    more = additional(model, text, units) if model is not None and len(units) > len(base) else []
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(sorted(base + more)))
                n_spans.append(len(base) + len(more))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(n_spans, pa.int64())], ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    return given.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs)).withColumnRenamed("id", "doc_id")
