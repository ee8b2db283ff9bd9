"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans consistent with them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import distinct_texts, texts

KINDS = ("email", "ip", "card", "phone")
#: Distinct texts that the field is fitted on, at most, and the candidate tokens that one gives: a longer one gives a stretch of them.
FIT_ROWS, FIT_TOKENS = 2048, 512
#: Marginal probability from which a token with similar tokens elsewhere joins the base spans.
SURE = 0.6
#: Log potential that linked similar tokens agree on a kind, where the sample has nothing to say.
AGREE = 4.0
#: Last digits by which two long numbers are similar.
TAIL = 8

# A match must start where its first run does: the run is taken whole or not at all, so searching inside it is futile.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"""[^\s,;:()<>\[\]{}"'|#$&*!?=]+""")
_DIGITS = re.compile(r"[0-9]+")
_MARKS = re.compile(r"[._%+-]+")
_SHORT = re.compile(r"(@[^.]*)\..*")
_UNLIKE = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyz", "3456789012cdefghijklmnopqrstuvwxyzab")
# Words that announce each kind.
CUES = {"email": ("mail", "correo", "courriel"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "carte", "karte", "tarjeta"), "phone": ("phone", "tel", "call", "fax", "mobil")}

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part reaches back from each ``@`` as far as it can."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; matches that fail their test are dropped."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


FEATURES = 28


def _features(text: str, start: int, token: str, digits: str, near: bool) -> list[int]:
    """Indices of the features that hold: sizes and marks of a token, and cue words just before it."""
    n, on = len(digits), [0]
    on.append(1 + (0 if n < 4 else 1 if n < 7 else 2 if n < 10 else 3 if n < 14 else 4 if n < 20 else 5))
    if "@" in token:
        on.append(7)
        on.append(8 if "." in token.rpartition("@")[2] else 9)
    if token.startswith("+"):
        on.append(10)
    on.append(11 + min(4, token.count(".")))
    if "-" in token:
        on.append(16)
    if any(c.isalpha() for c in token):
        on.append(17)
    if 14 <= n <= 19:
        on.append(18 if luhn(digits) else 19)
    if near:
        on.append(20)
    before = text[max(0, start - 24) : start].lower()
    on += [21 + i for i, k in enumerate(KINDS) if any(c in before for c in CUES[k])]
    if len(token) > 24:
        on.append(25)
    if 4 <= n and all(len(p) <= 3 for p in _DIGITS.findall(token)):
        on.append(26)
    if token.isdigit():
        on.append(27)
    return on


@dataclass
class Graph:
    """Candidate tokens (with a digit or ``@``) of one or more texts, and the pairs that share potentials."""

    doc: list[int]
    start: list[int]
    end: list[int]
    x: list[list[int]]
    fixed: list[int]  # kind of the base span a token is in, or -1
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        at, last, seen = 0, None, {}
        for m in _TOKEN.finditer(text):
            token = m[0].rstrip(".-+%_/\\")
            if not _HINT.search(token):
                continue
            start, end, me = m.start(), m.start() + len(token), len(self.doc)
            while at < len(base) and base[at][2] <= start:
                at += 1
            held = next(((s, k, e) for s, k, e in base[at : at + 4] if s < end and e > start), None)
            inside = held[1] if held else -1
            near = last is not None and start - last <= 3
            digits = "".join(_DIGITS.findall(token))
            self.doc.append(doc)
            self.start.append(start)
            self.end.append(end)
            self.x.append(_features(text, start, token, digits[:40], near))
            self.fixed.append(inside)
            if near:
                self.chain.append((me - 1, me))
            last = end
            # The same token, the same long number in other dress, the same name before the @.
            keys, number = [token.lower()], ""
            if held and inside >= 2:
                number = "".join(_DIGITS.findall(text, held[0], held[2]))
                keys.append("#" + number)
            elif len(digits) >= 9:
                number = digits
                keys.append("#" + number)
            if "@" in token and len(name := token.lower().partition("@")[0]) >= 4:
                keys.append("@" + name)
                keys.append("." + _MARKS.sub("", name))
            # Similar, not equal: a number that ends alike but starts otherwise, as with a country's code or without it, and a
            # name without its dots. They only tie tokens that nothing closer ties already.
            if len(number) >= 9:
                keys.append("~" + number[-TAIL:])
            tied = set()
            for k in keys:
                other = seen.get(k, me)
                if other != me and not (k[0] in "~." and other in tied):
                    self.skip.append((other, me))  # a chain of repeats, never all pairs
                    tied.add(other)
                seen[k] = me


def empty_graph() -> Graph:
    return Graph([], [], [], [], [], [], [])


def _dense(x: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(x), FEATURES))
    for i, on in enumerate(x):
        out[i, on] = 1
    return out


@dataclass
class Field:
    """Log potentials: of features and labels (0 is none), and of the labels of two linked tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = 12) -> np.ndarray:
        """Loopy sum-product messages over all links at once; tokens in base spans are held to their kind.

        The messages of a document stop once they are stable, whatever the others in the graph do.
        """
        own = _dense(g.x) @ self.unary
        fixed = np.array(g.fixed)
        own[fixed >= 0] = -30.0
        own[np.flatnonzero(fixed >= 0), fixed[fixed >= 0] + 1] = 30.0
        pairs = np.array(g.chain + g.skip, int).reshape(-1, 2)
        if len(pairs):
            pot = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            pot = np.exp(np.concatenate([pot, pot.transpose(0, 2, 1)]))
            back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            msg = np.zeros((len(src), len(KINDS) + 1))
            of = np.unique(np.array(g.doc), return_inverse=True)[1][src]  # the document of each message
            moving = np.ones(of.max() + 1, bool)
            for _ in range(rounds):
                belief = own.copy()
                np.add.at(belief, dst, msg)
                out = belief[src] - msg[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.log(np.einsum("ea,eab->eb", out, pot) + 1e-300)
                new -= new.max(axis=1, keepdims=True)
                change = np.zeros(len(moving))
                np.maximum.at(change, of, np.abs(new - msg).max(axis=1))
                stable = change < 1e-4
                msg = np.where((moving & stable)[of, None], new, np.where((moving & ~stable)[of, None], 0.5 * msg + 0.5 * new, msg))
                moving &= ~stable
                if not moving.any():
                    break
            np.add.at(own, dst, msg)
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 150, rate: float = 0.1) -> Field:
    """Maximum pseudo-likelihood by Adam: each token's label given its features and its neighbours' labels."""
    k = len(KINDS) + 1
    hot = np.eye(k)[y]

    def around(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.zeros((len(y), k)), np.zeros((len(y), k))
        np.add.at(before, pairs[:, 1], hot[pairs[:, 0]])
        np.add.at(after, pairs[:, 0], hot[pairs[:, 1]])
        return before, after

    cb, ca = around(chain)
    sb, sa = around(skip)
    prior = np.diag([0.0, *[AGREE] * len(KINDS)])
    field = Field(np.zeros((x.shape[1], k)), np.zeros((k, k)), prior.copy())
    params = [field.unary, field.chain, field.skip]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        z = x @ field.unary + cb @ field.chain + ca @ field.chain.T + sb @ field.skip + sa @ field.skip.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - hot) / len(y)
        grads = (x.T @ p, cb.T @ p + (ca.T @ p).T, sb.T @ p + (sa.T @ p).T)
        for q, g, (m, v), mean in zip(params, grads, moments, (0, 0, prior), strict=True):
            g = g + 1e-4 * (q - mean)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return field


def with_mentions(text: str, base: list[Span], most: int = 8) -> tuple[str, dict[int, int]]:
    """The text with other mentions of up to ``most`` of its e-mail addresses and phone numbers, and the kind of the token at each start.

    Each is repeated as the patterns can't see it: the digits alone, or the address with the first part of its domain. Beside it stand
    tokens of the same form with other digits and names, once or twice, which are no personal data. So the form alone
    tells nothing, and the links must.
    """
    out, at, kinds = [text, "\n"], len(text) + 1, {}
    for s, k, e in [b for b in base if b[1] in (0, 3)][:most]:
        told = text[s:e]
        other = "".join(_DIGITS.findall(told)) if k == 3 else _SHORT.sub(r"\1", told)
        unlike = other.translate(_UNLIKE)
        for token, kind in ((unlike, -1), (other, k), (unlike[::-1] if k == 3 else "x" + unlike, -1), (unlike, -1)):
            kinds[at] = kind
            out += [token, " and then "]
            at += len(token) + 10
    return "".join(out), kinds


def stretch(g: Graph, h: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and links of a graph, or of one of its stretches of ``most`` tokens, chosen by ``h``."""
    n = len(g.doc)
    at = h % -(-n // most) * most if n > most else 0
    inside = lambda pairs: np.array([(a - at, b - at) for a, b in pairs if at <= a < at + most and at <= b < at + most], np.int32).reshape(-1, 2)
    return _dense(g.x[at : at + most]).astype(np.int8), np.array(g.fixed[at : at + most], np.int8) + 1, inside(g.chain), inside(g.skip)


def fit(docs: DataFrame) -> Field:
    """Fit on at most FIT_ROWS distinct texts that have a candidate token; the labels are the base spans, and those of :func:`with_mentions`."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column(1).to_pylist(), texts(batch.column(0)), strict=True):
                g, (told, kinds) = empty_graph(), with_mentions(t, base_spans(t))
                g.add(0, told, base_spans(told))
                g.fixed = [kinds.get(s, f) if f < 0 else f for s, f in zip(g.start, g.fixed, strict=True)]
                if g.doc:
                    parts = stretch(g, h, FIT_TOKENS)
                    yield pa.RecordBatch.from_arrays([pa.array([h]), *(pa.array([np.ascontiguousarray(p).tobytes()]) for p in parts)], ["h", "x", "y", "chain", "skip"])

    found = sorted(distinct_texts(rows, FIT_ROWS).mapInArrow(graphs, "h long, x binary, y binary, chain binary, skip binary").collect())
    k = len(KINDS) + 1
    if not found:
        return Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))
    y = [np.frombuffer(r.y, np.int8) for r in found]
    offset = np.cumsum([0, *map(len, y)])
    x = np.concatenate([np.frombuffer(r.x, np.int8).reshape(-1, FEATURES) for r in found]).astype(float)
    links = [np.concatenate([np.frombuffer(r[c], np.int32).reshape(-1, 2) + o for r, o in zip(found, offset, strict=False)]).astype(int) for c in ("chain", "skip")]
    return train(x, np.concatenate(y).astype(int), *links)


def spans(rows: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans of each text, and all spans: the field adds tokens that no base span touches."""
    base, g = [base_spans(t) if _HINT.search(t) else [] for t in rows], empty_graph()
    for i, t in enumerate(rows):
        if _HINT.search(t):
            g.add(i, t, base[i])
    full = [list(b) for b in base]
    if g.doc:
        p = field.marginals(g)
        kind, last = p.argmax(axis=1) - 1, None
        alike = np.zeros(len(g.doc), bool)
        alike[np.array(g.skip, int).reshape(-1)] = True
        for n in np.flatnonzero(alike & (np.array(g.fixed) < 0) & (kind >= 0) & (p.max(axis=1) >= SURE)).tolist():
            doc, s, e = g.doc[n], g.start[n], g.end[n]
            if last and last[0] == doc and full[doc][-1] == last[1] and last[1][1] == kind[n] and rows[doc][last[1][2] : s] in (" ", "-"):
                s = full[doc].pop()[0]
            full[doc].append((s, int(kind[n]), e))
            last = (doc, full[doc][-1])
    return base, [sorted(f) for f in full]


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans``.

    Counts and digest are of the base spans, but ``n_added`` counts the others and ``n_spans`` all; ``spans`` lists base spans and those of the field as
    ``kind:start:end`` in code points, by start, then kind. Added spans are tokens with a digit or ``@``
    outside all base spans that resemble another token and that the field is sure of: their features and the labels of neighbours and of
    repeated or similar tokens anywhere in the text decide together. Null texts count as empty and have no
    spans. Repeated rows each come back; an empty table gives an empty result; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = spans(list(texts(batch.column(1))), sent.value)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            added = pa.array([len(f) - len(b) for f, b in zip(full, base, strict=True)], pa.int64())
            every = pa.array(map(len, full), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array(map(joined, full), pa.string()), added, every], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(text: str, found: list[Span]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by the kind of its first in brackets."""
    out, at, end = [], 0, -1
    for s, k, e in found:
        if s >= end:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with the spans replaced in ``text`` and ``n_chars``, if it is there in whole numbers, set to the new length where text changed.

    Null and empty texts stay as they are, and long texts are read whole. Repeated rows each stay, an empty table stays empty,
    and all other columns are kept, whatever their names and types.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("tinyint", "smallint", "int", "bigint") else None

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(at).to_pylist()
            _, full = spans([t or "" for t in rows], sent.value)
            new = [redact(t, f) if f else t for t, f in zip(rows, full, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if size is not None:
                columns[size] = pa.array([len(t) if f else n for t, f, n in zip(new, full, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(changed, docs.schema)
