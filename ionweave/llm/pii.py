"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans of four kinds. The field's nodes are these and the document's other candidates: runs of
digits, handles that an address in the document has before its ``@``, and addresses written with ``[at]``. Neighbouring
candidates are joined by chain edges; candidates with the same or a similar key (equal digits, digits that end alike, a
handle and its address), however far apart, by skip edges to one hub, the first base span with that key or else
the first candidate, so that what a base span says reaches every repeat. Base spans have their kind for certain. Loopy belief propagation over
both, until messages settle, makes the labels of a document agree; a candidate whose most likely label is a kind becomes an
added span. Neighbours are candidates within ``REACH`` characters; handles of any length are candidates, and short ones of
letters alone, which may be plain words, have a feature that says so.

Weights are trained by pseudo-likelihood on labelled texts that ``examples`` makes from a seed, on the driver. Messages of
all documents of a run are passed at once with numpy; edges number at most three a node, so a run's cost and memory follow its candidates.

Defined cases: a null or empty text has no span; base spans of different kinds may overlap and all stay, an added span
overlaps none; repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order and the patterns of the contract, written so that no scan goes back further than its match.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"(?<![A-Za-z0-9_])[0-9][0-9().\x20-]*+")
BRACKET = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]+")
HANDLE = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._%+-]*+")
LABELS = ("none", *KINDS)
HINTS = (("phone", "tel", "call", "mobile", "fax"), ("card", "visa", "payment", "credit"), ("ip", "host", "server", "address"), ("mail", "contact", "write", "user"), ("order", "ref", "invoice", "version", "date", "page", "total", "id"))
REACH, SHORT_HANDLE, SUFFIX = 80, 5, 7
#: Messages are passed until none changes by more; ROUNDS only ends fields that never settle.
TOLERANCE, ROUNDS, CERTAIN = 1e-7, 1000, 1e7


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@``: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        # What stands before this @ can't begin a later address: an @ is between.
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's spans, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, kind of a base span or -1, key) of the document's nodes in text order."""
    if not base and not DIGIT.search(text) and "at]" not in text and "at)" not in text:
        return []
    starts, high, ends = [a for a, _, _ in base], 0, []
    for _, _, b in base:
        high = max(high, b)
        ends.append(high)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    nodes = []
    handles = set()
    for a, kind, b in base:
        t = text[a:b]
        if kind == 0:
            handles.add(t.partition("@")[0].lower())
            key = "h" + t.partition("@")[0].lower()
        else:
            key = "d" + only_digits(t)
        nodes.append((a, b, kind, key))
    taken = []
    for m in NUMBER.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip("().- "))
        if a and text[a - 1] == "+":
            a -= 1
        if 5 <= sum(map(str.isdigit, text[a:b])) and not text[b : b + 1].isalnum() and free(a, b):
            taken.append((a, b, "d" + only_digits(text[a:b])))
    if "at]" in text or "at)" in text:
        taken += [(m.start(), m.start() + len(m[0].rstrip(".-")), "h" + re.split(r"\x20?[\[(]at", m[0])[0].lower()) for m in BRACKET.finditer(text) if free(*m.span())]
    if handles:
        for m in HANDLE.finditer(text):
            t = m[0].rstrip(".-%+")
            if t.lower() in handles and free(m.start(), m.start() + len(t)):
                taken.append((m.start(), m.start() + len(t), "h" + t.lower()))
    end = -1
    for a, b, key in sorted(taken):
        if a >= end:
            nodes.append((a, b, -1, key))
            end = b
    nodes.sort()
    return nodes


def features(text: str, a: int, b: int, kind: int, key: str) -> list[int]:
    """Indices of the node's binary features."""
    out = [0]
    if kind >= 0:
        out.append(1 + kind)
    t, n = text[a:b], len(key) - 1
    if key[0] == "h":
        out.append(5 if "at" in t and ("[" in t or "(" in t) else 6)
        if n < SHORT_HANDLE and key[1:].isalpha():
            out.append(18)
    else:
        out.append(7 + sum(n > x for x in (6, 9, 11, 13, 15, 19)))
        if n >= 14 and n <= 19 and luhn(key[1:]):
            out.append(14)
        if t[0] == "+":
            out.append(15)
        if t.count(".") == 3:
            out.append(16)
        if any(c in t for c in " ()-"):
            out.append(17)
    before = re.findall(r"[a-z]+", text[max(0, a - 24) : a].lower())[-3:]
    out += [19 + k for k, words in enumerate(HINTS) if any(w in words for w in before)]
    return out


N_FEATURES = 19 + len(HINTS)


def graph(nodes: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges between nodes of one document: each node has at most one of the first to its left, two of the second, and hubs one a repeat."""
    chain = [(k, k + 1) for k in range(len(nodes) - 1) if nodes[k + 1][0] - nodes[k][1] <= REACH]
    # Digits that end alike are similar: a number with and without its prefix.
    names = [(key, "s" + key[-SUFFIX:]) if key[0] == "d" and len(key) > SUFFIX else (key,) for *_, key in nodes]
    base: dict[str, int] = {}
    first: dict[str, int] = {}
    for k, own in enumerate(names):
        for name in own:
            first.setdefault(name, k)
            if nodes[k][2] >= 0:
                base.setdefault(name, k)
    skip = set()
    for k, own in enumerate(names):
        # A base span is evidence enough: weaker repeats beside it would only be counted again.
        sure = next((base[name] for name in own if name in base), None)
        for hub in {first[name] for name in own} if sure is None else {sure}:
            if hub != k:
                skip.add((min(hub, k), max(hub, k)))
    return chain, sorted(skip)


class SkipChain:
    """Weights: features to labels, and symmetric agreement of labels along chain and skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.edges = unary, (chain, skip)

    def marginals(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities of all nodes by damped sum-product; ``chain`` and ``skip`` are rows (node, node)."""
        pairs = np.concatenate([chain, skip])
        if not len(pairs):
            return _soft(unary)
        weight = np.repeat([0, 1], [len(chain), len(skip)])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        table = np.stack(self.edges)[np.concatenate([weight, weight])]
        m = len(pairs)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, len(LABELS)))
        for _ in range(ROUNDS):
            belief = unary + np.stack([np.bincount(target, message[:, k], len(unary)) for k in range(len(LABELS))], axis=1)
            z = (belief[source] - message[back])[:, :, None] + table
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < TOLERANCE:
                break
        return _soft(unary + np.stack([np.bincount(target, message[:, k], len(unary)) for k in range(len(LABELS))], axis=1))

    def label(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """(base spans, added spans) of each text, as (start, kind, end)."""
        base = [base_spans(t) for t in texts]
        nodes, rows, at, chain, skip = [], [], [], [], []
        for k, (t, b) in enumerate(zip(texts, base)):
            own = candidates(t, b)
            if all(kind >= 0 for _, _, kind, _ in own):
                continue  # nothing to decide
            c, s = graph(own)
            chain += [(len(nodes) + i, len(nodes) + j) for i, j in c]
            skip += [(len(nodes) + i, len(nodes) + j) for i, j in s]
            rows += [features(t, *x) for x in own]
            at += [k] * len(own)
            nodes += own
        added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if nodes:
            sizes = [len(r) for r in rows]
            flat = np.fromiter((f for r in rows for f in r), np.int64)
            unary = np.add.reduceat(self.unary[flat], np.cumsum([0, *sizes[:-1]]))
            for k, (_, _, kind, _) in enumerate(nodes):
                if kind >= 0:
                    unary[k, kind + 1] += CERTAIN
            best = self.marginals(unary, *(np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip))).argmax(axis=1)
            for (a, b, kind, _), k, label in zip(nodes, at, best.tolist()):
                if kind < 0 and label:
                    added[k].append((a, label - 1, b))
        return list(zip(base, added))


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def examples(n: int, seed: int) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """Labelled texts made by rule: entities in base form and again in other forms, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    out = []
    for _ in range(n):
        parts: list[tuple[str, int | None]] = []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["email", "ip", "card", "phone", "number", "number"])
            if kind == "phone":
                local = digits(9)
                forms = [f"+44 {local[:3]} {local[3:]}", f"0{local}", f"0{local[:3]}-{local[3:6]}-{local[6:]}", f"({local[:3]}) {local[3:]}", local, f"{local[:3]} {local[3:6]} {local[6:]}"]
                said = [forms[0], *(r.choice(["", "", "", "ref ", "id "]) + r.choice(forms) for _ in range(r.randrange(4)))] if r.random() < 0.8 else [r.choice(["tel ", "call ", "phone "]) + forms[1]]
            elif kind == "card":
                c = card()
                forms = [c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4)), f"({c[:8]}) {c[8:]}"]
                said = [forms[0], *(r.choice(forms) for _ in range(r.randrange(3)))]
            elif kind == "ip":
                p = [str(r.randrange(10, 256)) for _ in range(4)]
                said = [".".join(p), *(r.choice([".".join(p), "-".join(p)]) for _ in range(r.randrange(3)))]
            elif kind == "email":
                name = "".join(r.choice("abcdefghij") for _ in range(6)) + digits(2)
                if r.random() < 0.3:  # a short name that the text has as a word too
                    word = "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 5)))
                    parts += [(f"{word}@site.example", 1), *((word, 0) for _ in range(r.randrange(1, 4)))]
                said = [f"{name}@site.example", *(r.choice([name, f"{name} [at] site.example", f"{name}@other.example"]) for _ in range(r.randrange(3)))]
            else:
                x = r.choice([digits(r.randrange(5, 9)), digits(r.randrange(9, 14)), f"{digits(5)} {digits(5)}", f"{digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(6)}", f"{digits(4)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", digits(r.randrange(16, 24)), f"20{digits(2)}-0{digits(1)[0]}-1{digits(1)}", f"{digits(2)}.{digits(3)}", f"{digits(3)} {digits(3)}"])
                said = [r.choice(["", "order ", "ref ", "page ", "id "]) + x] * r.choice([1, 1, 2, 3])
            label = KINDS.index(kind) + 1 if kind in KINDS else 0
            parts += [(s, label) for s in said]
        r.shuffle(parts)
        text, spans = "", {}
        for s, label in parts:
            text += " " + "".join(r.choice("abcdefgh ") for _ in range(r.choice([5, 20, 100]))) + " x "
            spans[len(text), len(text) + len(s)] = label
            text += s
        out.append((text + " end", spans))
    return out


@functools.lru_cache(maxsize=2)
def train(n: int = 400, seed: int = 7, steps: int = 300) -> SkipChain:
    """Pseudo-likelihood: each label given its features and its neighbours' labels, by gradient ascent with a small prior."""
    rows, labels, chain, skip = [], [], [], []
    for text, spans in examples(n, seed):
        nodes = candidates(text, base_spans(text))
        c, s = graph(nodes)
        chain += [(len(labels) + i, len(labels) + j) for i, j in c]
        skip += [(len(labels) + i, len(labels) + j) for i, j in s]
        for a, b, kind, key in nodes:
            rows.append(features(text, a, b, kind, key))
            labels.append(kind + 1 if kind >= 0 else next((y for (x, z), y in spans.items() if x <= a and b <= z), 0))
    size, y = len(labels), np.array(labels)
    x = np.zeros((size, N_FEATURES + 2 * len(LABELS)))
    for k, r in enumerate(rows):
        x[k, r] = 1
    for offset, edges in ((N_FEATURES, chain), (N_FEATURES + len(LABELS), skip)):
        for i, j in edges:
            x[i, offset + y[j]] += 1
            x[j, offset + y[i]] += 1
    w, want = np.zeros((x.shape[1], len(LABELS))), np.eye(len(LABELS))[y]
    moment = np.zeros_like(w)
    for _ in range(steps):
        moment = 0.9 * moment + x.T @ (want - _soft(x @ w)) / size - 1e-4 * w
        w += 0.3 * moment
    even = lambda m: (m + m.T) / 2
    return SkipChain(w[:N_FEATURES], even(w[N_FEATURES : N_FEATURES + len(LABELS)]), even(w[N_FEATURES + len(LABELS) :]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: SkipChain | None = None) -> DataFrame:
    """doc_id, base counts and digest, and all spans of each row of ``docs`` (doc_id, text)."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(i, 256).to_pylist()]
                found = model.label(texts)
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b, _ in found], pa.int64()) for kind in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 256), *counts, digest, pa.array([joined(b + x) for b, x in found]), pa.array([len(x) for _, x in found], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
