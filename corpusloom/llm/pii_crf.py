"""PII: patterns, and a skip-chain conditional random field that carries their finds through each document.

Tokens with a digit or an @ are the field's variables (the others are outside every entity by definition).
Neighbouring tokens are linked in a chain, and all tokens that repeat each other or have the same digits are linked
with one of them, an observed one if there is any, however far away. Tokens that a pattern covers are observed; damped loopy message passing over
chain and skip potentials labels the rest, so a number told once as a phone number is one wherever it returns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Bound of the training sample, in documents; passes of gradient ascent; damping of message passing.
SAMPLE_DOCS, STEPS, RATE, DAMPING = 2000, 200, 2.0, 0.3
#: A document's messages pass until none moves by more than this; should they swing for ever, until PATIENCE rounds and
#: two for each variable of the document are over, the later half of them damped by CALMED.
SETTLED, PATIENCE, CALMED = 1e-4, 400, 0.9
#: A token is labelled when its belief in a kind is at least this.
BELIEF = 0.5

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a run of digits: had one begun at the run's start, it would be the leftmost.
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_mark, _space, _no_digit = re.compile(r"[0-9@]"), re.compile(r"[ \t-\r]"), re.compile(r"[^0-9]+")
_white = frozenset(" \t\n\v\f\r")
_edge = "\"'`.,;:!?()[]{}<>|*#$%&=_/\\"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' finds, in order: leftmost and not overlapping in each kind, failing ones dropped."""
    out, last = [], 0
    for m in _domain.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _local:
            at -= 1
        if at < m.start():
            out.append((at, 0, m.end()))
            last = m.end()
    for m in _ip.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _no_digit.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_no_digit.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def variables(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an @, less the punctuation around them."""
    out, at = [], 0
    while m := _mark.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in _white:
            start -= 1
        end = e.start() if (e := _space.search(text, m.end())) else len(text)
        token = text[start:end]
        left = len(token) - len(token.lstrip(_edge))
        out.append((start + left, start + len(token.rstrip(_edge))))
        at = end
    return out


def _bucket(n: int) -> int:
    return sum(n >= b for b in (1, 3, 4, 7, 10, 14, 16, 20))


#: Values that each feature of a token takes.
SLOTS = (9, 4, 6, 5, 5, 2, 3)


def features(token: str, gap: int) -> tuple[int, ...]:
    """gap: characters since the last variable; the token's shape, not its text, is what is learned."""
    digits = _no_digit.sub("", token)
    parts = token.split(".")
    at = token.count("@")
    first = token[0]
    rest = set(token) - set("0123456789")
    return (
        _bucket(len(digits)),
        0 if not at else 3 if at > 1 else 1 if "." in token[token.index("@") :] else 2,
        min(5, len(parts)) if all(p.isascii() and p.isdigit() for p in parts) else 0,
        0 if first == "+" else 1 if first == "(" else 2 if "0" <= first <= "9" else 3 if first.isalpha() else 4,
        0 if not rest else 1 if rest <= set(" ()+-") else 2 if rest <= set(".-+()") else 3 if token.isalnum() else 4,
        int(14 <= len(digits) <= 19 and luhn(digits)),
        0 if gap < 0 or gap > 3 else 1 if gap <= 1 else 2,
    )


def skip_key(token: str) -> str:
    digits = _no_digit.sub("", token)
    return digits if len(digits) >= 7 and "@" not in token else token.lower()


@dataclass
class Graph:
    """All variables of some documents: where, features, the observed label or -1, and links of (first, second, type)."""

    spans: list[list[tuple[int, int]]]
    shapes: np.ndarray
    seen: np.ndarray
    links: np.ndarray
    base: list[list[tuple[int, int, int]]]


def graph_of(texts: list[str], anchored: bool = True) -> Graph:
    """Repeats are linked with their anchor, the first observed one or else the first; if not anchored, each with the one before it. A number
    of several tokens that a pattern found repeats what has its digits."""
    spans, shapes, seen, links, base = [], [], [], [], []
    for text in texts:
        found = base_spans(text)
        base.append(found)
        tokens = variables(text)
        tokens = [t for t in tokens if t[0] < t[1]]
        spans.append(tokens)
        places: dict[str, list[int]] = {}
        chained: set[int] = set()
        before, k, told = None, 0, None
        by_start = sorted(found)
        for start, end in tokens:
            token, me = text[start:end], len(shapes)
            gap = -1 if before is None else start - before
            shapes.append(features(token, gap))
            while k < len(by_start) and by_start[k][2] <= start:
                k += 1
            cover, j = [], k
            while j < len(by_start) and by_start[j][0] < end:
                if by_start[j][2] > start:
                    cover.append((by_start[j][1], by_start[j]))
                j += 1
            seen.append(1 + min(cover)[0] if cover else -1)
            # The first token of a number that a pattern found stands for all of it.
            key = skip_key(token)
            if cover and (now := min(cover)[1]) != told:
                told = now
                key = skip_key(text[now[0] : now[2]]) if now[1] >= 2 else key
            if before is not None and gap <= 3:
                links.append((me - 1, me, 0))
                chained.add(me)
            places.setdefault(key, []).append(me)
            before = end
        for same in places.values():
            anchor = next((i for i in same if seen[i] >= 0), same[0])
            ends = [(min(anchor, i), max(anchor, i)) for i in same if i != anchor] if anchored else zip(same, same[1:])
            links.extend((i, j, 1) for i, j in ends if not (i == j - 1 and j in chained))
    n = len(shapes)
    return Graph(spans, np.array(shapes, np.int64).reshape(n, len(SLOTS)), np.array(seen, np.int64), np.array(links, np.int64).reshape(-1, 3), base)


@dataclass
class Field:
    """Weights of each feature's values, and of the labels' pairs on chain and skip links."""

    shape: list[np.ndarray]
    pair: np.ndarray


LABELS = 1 + len(KINDS)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def train(shapes: np.ndarray, labels: np.ndarray, links: np.ndarray, steps: int = STEPS, rate: float = RATE) -> Field:
    """Maximises the pseudo-likelihood of the labels by gradient ascent, with a little decay."""
    field = Field([np.zeros((n, LABELS)) for n in SLOTS], np.zeros((2, LABELS, LABELS)))
    n = max(1, len(labels))
    truth = np.zeros((len(labels), LABELS))
    truth[np.arange(len(labels)), labels] = 1
    near = [np.zeros((len(labels), LABELS)) for _ in range(2)]
    for kind in range(2):
        a, b = links[links[:, 2] == kind, 0], links[links[:, 2] == kind, 1]
        np.add.at(near[kind], a, truth[b])
        np.add.at(near[kind], b, truth[a])
    for _ in range(steps):
        z = sum(w[shapes[:, k]] for k, w in enumerate(field.shape)) + near[0] @ field.pair[0] + near[1] @ field.pair[1]
        off = truth - np.exp(_log_softmax(z))
        for k, w in enumerate(field.shape):
            grad = np.zeros_like(w)
            np.add.at(grad, shapes[:, k], off)
            w += rate * (grad / n - 1e-4 * w)
        for kind in range(2):
            grad = near[kind].T @ off / n
            field.pair[kind] += rate * ((grad + grad.T) / 2 - 1e-4 * field.pair[kind])
    return field


def beliefs(graph: Graph, field: Field, rounds: int | None = None) -> np.ndarray:
    """Label probabilities of all variables, by damped sum-product messages along chain and skip links.

    Each document's messages pass until they settle, whatever other documents there are; rounds sets another bound."""
    n = len(graph.seen)
    node = sum((w[graph.shapes[:, k]] for k, w in enumerate(field.shape)), np.zeros((n, LABELS)))
    fixed = graph.seen >= 0
    node[fixed] = -60.0
    node[fixed, graph.seen[fixed]] = 0.0
    doc = np.repeat(np.arange(len(graph.spans)), [len(x) for x in graph.spans]) if graph.spans else np.zeros(n, np.int64)
    most = PATIENCE + 2 * np.bincount(doc) if rounds is None else np.full(doc.max(initial=0) + 1, rounds)
    a, b, kind = graph.links.T if len(graph.links) else np.zeros((3, 0), np.int64)
    message, total, passed = np.zeros((2 * len(a), LABELS)), node.copy(), 0
    while len(a):  # once for each set of documents that still move
        m = len(a)
        here, source = np.unique(np.concatenate([a, b]), return_inverse=True)
        target = np.concatenate([source[m:], source[:m]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        pair, owner = field.pair[np.concatenate([kind, kind])], doc[np.concatenate([a, a])]
        sums, moving = total[here], np.ones(2 * m, bool)
        while moving.all():
            passed += 1
            out = (sums[source] - message[back])[:, :, None] + pair
            top = out.max(axis=1)
            new = _log_softmax(top + np.log(np.exp(out - top[:, None, :]).sum(axis=1)))
            moved = np.zeros(len(most))
            np.maximum.at(moved, owner, np.abs(np.exp(new) - np.exp(message)).max(axis=1))
            damping = np.where(2 * passed > most[owner], CALMED, DAMPING)[:, None]
            message = _log_softmax(damping * message + (1 - damping) * new)
            sums = node[here]
            for label in range(LABELS):
                sums[:, label] += np.where(fixed[here], 0.0, np.bincount(target, message[:, label], len(here)))  # however many repeats, an observed one stays so
            moving = (moved[owner] > SETTLED) & (passed < most[owner])
        total[here] = sums
        a, b, kind, message = a[moving[:m]], b[moving[:m]], kind[moving[:m]], message[moving]
    return np.exp(_log_softmax(total))


def whole(kind: int, token: str) -> bool:
    """Whether it has all digits of a card or a telephone number."""
    digits = _no_digit.sub("", token)
    return 14 <= len(digits) <= 19 and luhn(digits) if KINDS[kind] == "card" else 10 <= len(digits) <= 15


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, as (start, kind, end)."""
    graph = graph_of(texts)
    p = beliefs(graph, field)
    label = np.where(p.max(axis=1) >= BELIEF, p.argmax(axis=1), 0) if len(p) else np.zeros(0, np.int64)
    out, at = [], 0
    for text, tokens, base in zip(texts, graph.spans, graph.base, strict=True):
        more: list[tuple[int, int, int]] = []
        for k, (s, e) in enumerate(tokens):
            if label[at + k] and graph.seen[at + k] < 0:
                kind = int(label[at + k]) - 1
                # Parts of one number, with a blank and a bracket between them at most, are one span; whole numbers are apart.
                if more and kind >= 2 and more[-1][1] == kind and s - more[-1][2] <= 3 and label[at + k - 1] == label[at + k]:
                    if not whole(kind, text[s:e]) and not whole(kind, text[more[-1][0] : more[-1][2]]):
                        s = more.pop()[0]
                more.append((s, kind, e))
        at += len(tokens)
        out.append((base, sorted(base + more)))
    return out


def with_repeats(text: str) -> str:
    """The text, and at its end each telephone and card number of the patterns' finds once more, in two spellings that the patterns don't
    know, each other number of seven digits or more, and each address without its domain's end, which is none: what a repeat is
    worth, and what an address needs, is learned from these."""
    base = base_spans(text)
    said = []
    for start, kind, end in base:
        digits = _no_digit.sub("", text[start:end])
        if kind == 3:
            said += [digits, "-".join((digits[:1], digits[1:4], digits[4:]))]
        elif kind == 2:
            said += [".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), "/".join((digits[:8], digits[8:]))]
        elif kind == 0:
            said.append(text[start:end].partition(".")[0] if "@" in text[start:end].partition(".")[0] else "x@" + text[start:end].partition("@")[2].partition(".")[0])
    for start, end in variables(text):
        known = any(s < end and start < e for s, _, e in base)
        if not known and "@" not in text[start:end] and len(_no_digit.sub("", text[start:end])) >= 7:
            said.append(text[start:end])
    return text + "".join(f"\nand again {x} as said" for x in said)


def repeated_labels(graph: Graph) -> np.ndarray:
    """The observed labels, and on tokens that have none those of the tokens that they repeat; links are of each repeat with
    the one before it."""
    labels = graph.seen.copy()
    repeats = [(a, b) for a, b, kind in graph.links.tolist() if kind == 1]
    for a, b in repeats:
        if labels[b] < 0:
            labels[b] = labels[a]
    for a, b in reversed(repeats):
        if labels[a] < 0:
            labels[a] = labels[b]
    return labels


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """Learns the field from the patterns' finds in at most sample documents, those whose ids hash lowest, one row of each.

    What the patterns found is hidden from the field there, which learns it from shapes and neighbours; tokens that repeat a
    find, and that the patterns missed, are of its kind too. Numbers are repeated at the end of each text, so that there are
    repeats to learn from. Of repeats it learns from each and the one before it, as an
    anchor's many links would outweigh all else."""
    ids = docs.select(F.col("doc_id").alias("id")).filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    ids = materialize(ids.distinct(), "pii_sample")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))

    def graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = graph_of([with_repeats(t) for t in pdf["text"]], anchored=False)
            yield pd.DataFrame({"n": [len(g.seen)], "shapes": [g.shapes.astype(np.int8).tobytes()], "seen": [repeated_labels(g).astype(np.int8).tobytes()], "links": [g.links.astype(np.int32).tobytes()]})

    texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    rows = texts.select("text").mapInPandas(graphs, "n long, shapes binary, seen binary, links binary").toPandas().sort_values(["n", "shapes", "seen"])
    first = np.concatenate([[0], np.cumsum(rows["n"])]).astype(np.int64)
    shapes = np.concatenate([np.frombuffer(x, np.int8).reshape(-1, len(SLOTS)) for x in rows["shapes"]] or [np.zeros((0, len(SLOTS)), np.int8)]).astype(np.int64)
    seen = np.concatenate([np.frombuffer(x, np.int8) for x in rows["seen"]] or [np.zeros(0, np.int8)]).astype(np.int64)
    links = [np.frombuffer(x, np.int32).reshape(-1, 3) + np.array([k, k, 0]) for x, k in zip(rows["links"], first, strict=False)]
    return train(shapes, np.maximum(seen, 0), np.concatenate(links or [np.zeros((0, 3), np.int64)]).astype(np.int64))


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, text) -> a row each: doc_id, base and spans, arrays of (kind, start, end) in code points, end exclusive.

    base are the patterns' finds, spans these and the field's, by start and then kind. Null texts are empty and have
    none; rows that repeat are documents each; other columns are ignored. Neither depends on other documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                found = find(list(part["text"]), shared.value)
                yield pd.DataFrame({"doc_id": part["doc_id"], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]})

    span = "array<struct<kind: string, start: long, end: long>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, f"doc_id {kind}, base {span}, spans {span}")
