"""Personal data with a skip-chain conditional random field.

Base spans of four kinds (e-mail, IP address, card, phone) come from exact rules and always stay. The field runs over the *mentions* of a document: its base spans,
whose labels are fixed, and further candidates that no rule accepts: numbers with separators (one too long for any kind is taken apart at its spaces), and words with an at sign or what
stands for one. Neighbouring mentions share a chain potential; mentions that are repeated or similar (the same last seven digits, the same address but for case and spelling of
the sign) share a skip potential with the one before and with the first that a rule accepts, at any distance. Loopy sum-product message passing, until the messages hold still, gives each
free mention a label; one that isn't "none" with a probability of at least `SURE` adds a span. So a phone number that is given once in full and once without its prefix is found twice, and a card
that stands next to another number is found though the rule takes both for one.

Weights are fitted on the driver by pseudo-likelihood on a bounded sample: at most `SAMPLE` texts that hold a mention, of the about `ROWS` rows with the smallest hash of their identifier,
of each text the first `SAMPLE_CHARS` characters around its mentions. Labels are what the rules say. Each mention is learned from with its links, without them, and with its own features
hidden, so that the links must tell its label; else the rules' own features would explain everything and the links nothing.
Everything else covers all rows and whole texts, in time linear in the text but for the number of rounds. Defined cases: null and empty texts have no spans; repeated rows and ties get equal results; an
empty table gives no rows; without a text to learn from, the field adds nothing; columns other than identifier and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.compression import HASHES, _scores

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE, ROWS, SURE = 2000, 12_000, 0.9
#: Of a text in the sample, so many characters on either side of its first mention; bounds what the driver gathers.
SAMPLE_CHARS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, so nothing is scanned twice.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMERIC = re.compile(r"(?<![A-Za-z0-9_])\(?[0-9][0-9().\x20-]*[0-9](?![A-Za-z0-9_])")
_AT = re.compile(r"(?<!\S)[A-Za-z0-9._%+-]+\x20?(?:@|\(at\)|\[at\])\x20?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9@])", re.IGNORECASE)
_HAS = re.compile(r"[0-9@]|\(at\)|\[at\]", re.IGNORECASE)
#: The same for the readers of the sample.
HAS = "(?i)[0-9@]|\\(at\\)|\\[at\\]"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> list[Span]:
    """Found from the at signs: the local part is the run of its characters before, down to the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out = _emails(text) if "@" in text else []
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label) in order: base spans (the first of overlapping ones) and free candidates (label -1)."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in base:
        if not out or start >= out[-1][1]:
            out.append((start, end, kind + 1))
    fixed = list(out)
    free = [(m.start(), m.end(), -1) for p in (_AT, _NUMERIC) for m in p.finditer(text)]
    free = [x for f in free for x in (_pieces(text, *f) if text[f[0] : f[1]].count(" ") and len(_digits(text[f[0] : f[1]])) > 19 else [f])]
    k = 0
    last = 0
    for start, end, label in sorted(free):
        while k < len(fixed) and fixed[k][1] <= start:
            k += 1
        if start >= last and not (k < len(fixed) and fixed[k][0] < end):
            out.append((start, end, label))
            last = end
    return sorted(out)


def _pieces(text: str, start: int, end: int, label: int) -> list[tuple[int, int, int]]:
    """A number with more digits than any kind has, as the numbers between its spaces."""
    return [(start + m.start(), start + m.end(), label) for m in re.finditer(r"\(?[0-9](?:[0-9().-]*[0-9])?", text[start:end])]


def _with_sign(piece: str) -> str:
    return piece.lower().replace("(at)", "@").replace("[at]", "@")


def _key(piece: str) -> str:
    """What similar mentions have in common; empty if nothing."""
    digits = _digits(piece)
    low = _with_sign(piece)
    if "@" in low:
        return low.replace(" ", "").rstrip(".-")
    return digits[-7:] if len(digits) >= 7 else ""


def unary(text: str, start: int, end: int) -> list[float]:
    """Features of a mention by itself; whether a rule accepts it is not among them."""
    piece = text[start:end]
    digits = _digits(piece)
    n = len(digits)
    parts = piece.split(".")
    quad = len(parts) == 4 and all(p.isdigit() for p in parts)
    before = text[start - 1 : start]
    signed = _with_sign(piece)
    plain = signed.replace(" ", "") if "@" in signed else piece  # brackets and spaces of a spelled sign mean nothing
    return [
        1.0, "@" in signed, "@" in signed and "." in signed.rpartition("@")[2], n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        quad, quad and all(len(p) <= 3 and int(p) <= 255 for p in parts), piece[0] == "+", "(" in plain, " " in plain or "-" in plain, n >= 12 and luhn(digits), before.isalnum(), before in "\"'=:/",
    ]


def links(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(mention, later mention, 0 chain or 1 skip)"""
    out = [(i, i + 1, 0) for i in range(len(found) - 1)]
    keys = [_key(text[start:end]) for start, end, _ in found]
    known: dict[str, int] = {}
    for i, (key, (_, _, label)) in enumerate(zip(keys, found, strict=True)):
        if key and label > 0:
            known.setdefault(key, i)
    seen: dict[str, int] = {}
    for i, key in enumerate(keys):
        if not key:
            continue
        out += [(min(i, j), max(i, j), 1) for j in {seen.get(key, i), known.get(key, i)} - {i}]
        seen[key] = i
    return sorted(set(out))


class SkipChainField:
    """weights: features x labels; pair: for chain and skip links, labels x labels."""

    def __init__(self, texts: list[str], steps: int = 400, rate: float = 0.1, penalty: float = 1e-5):
        k = len(LABELS)
        self.weights, self.pair = None, np.zeros((2, k, k))
        x, y, sides = [], [], []
        for text in texts:
            found = mentions(text, base_spans(text))
            labels = [max(0, label) for _, _, label in found]
            own = np.zeros((len(found), 2, k))
            for a, b, kind in links(text, found):
                own[a, kind, labels[b]] += 1
                own[b, kind, labels[a]] += 1
            x += [unary(text, s, e) for s, e, _ in found]
            y += labels
            sides += list(own)
        if not x:
            return
        features, labels, sides = np.array(x, float), np.eye(k)[y], np.array(sides)
        hidden = np.zeros_like(features)
        hidden[:, 0] = 1.0
        # a mention without a skip link says nothing about what such links mean
        linked = sides[:, 1].sum(1) > 0
        n, m = len(x), int(linked.sum())
        features, labels, sides = np.concatenate([features, features, hidden[linked]]), np.concatenate([labels, labels, labels[linked]]), np.concatenate([sides, 0 * sides, sides[linked]])
        share = np.concatenate([np.full(2 * n, 1 / n), np.full(m, 1 / max(1, m))])[:, None]
        w = np.zeros((features.shape[1], k))
        moments: list = [0.0, 0.0, 0.0, 0.0]
        for step in range(1, steps + 1):
            z = features @ w + np.einsum("nsk,skl->nl", sides, self.pair)
            p = np.exp(z - z.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - labels) * share
            g_pair = np.einsum("nsk,nl->skl", sides, error)
            grads = [features.T @ error + penalty * w, (g_pair + g_pair.transpose(0, 2, 1)) / 2 + penalty * self.pair]
            for i, (value, g) in enumerate(zip((w, self.pair), grads, strict=True)):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                moments[i + 2] = 0.999 * moments[i + 2] + 0.001 * g * g
                value -= rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 2] / (1 - 0.999**step)) + 1e-9)
        self.weights = w

    def beliefs(self, text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
        """Label probabilities of each mention, by damped loopy sum-product over all links at once, until no message moves; exact where the links form no loop."""
        k, n = len(LABELS), len(found)
        node = np.array([unary(text, s, e) for s, e, _ in found], float) @ self.weights
        fixed = np.array([label for _, _, label in found])
        held = np.flatnonzero(fixed >= 0)
        node[held] = -50.0
        node[held, fixed[held]] = 0.0
        node -= node.max(1, keepdims=True)
        edges = np.array(links(text, found), np.int64).reshape(-1, 3)
        if not len(edges):
            p = np.exp(node)
            return p / p.sum(1, keepdims=True)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        potential = np.exp(self.pair - self.pair.max())[np.concatenate([edges[:, 2], edges[:, 2]])]
        message = np.zeros((len(source), k))
        for _ in range(max(50, n)):
            total = node.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", out, potential) + 1e-300)
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if moved < 1e-4:
                break
        total = node.copy()
        np.add.at(total, target, message)
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start, then kind."""
        text = text or ""
        if not _HAS.search(text):
            return [], []
        base = base_spans(text)
        if self.weights is None:
            return base, base
        found = mentions(text, base)
        if all(label >= 0 for _, _, label in found):
            return base, base
        p = self.beliefs(text, found)
        best = p.argmax(1)
        more = [(s, int(best[i]) - 1, e) for i, (s, e, label) in enumerate(found) if label < 0 and best[i] > 0 and p[i, best[i]] >= SURE]
        return base, sorted({*base, *more})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SkipChainField:
    """Fitted on at most SAMPLE texts with a digit, an at sign or its spelling, out of about ROWS rows that a hash of the identifier picks; only their texts are read."""
    rows = docs.where(F.col(id_col).isNotNull())
    order = F.pmod(F.xxhash64(id_col), F.lit(HASHES))
    cut = int(min(1.0, ROWS / max(1, docs.count())) * HASHES)
    text = F.col(text_col)
    begin = F.greatest(F.lit(1), F.regexp_instr(text, F.lit(HAS)) - SAMPLE_CHARS)
    held = rows.where((order < cut) & text.rlike(HAS)).select(order.alias("h"), F.col(id_col).alias("id"), F.substring(text, begin, F.lit(2 * SAMPLE_CHARS)).alias("text"))
    chosen = held.orderBy("h", "id", "text").limit(SAMPLE).collect()
    return SkipChainField([r["text"] for r in chosen])


def personal_data(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added; `docs` has the two columns identifier and text."""

    def row(text: str | None) -> tuple:
        base, all_spans = field.spans(text)
        counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
        return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans), len(all_spans) - len(set(base))

    schema = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long"])
    return _scores(docs, row, schema, (*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64()))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal_data(docs, fit_field(docs))
