"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers, leftmost
and without overlap within each kind. The field adds spans that no base pattern tells: other
writings of the same data (a phone number without its country code, an address with "(at)",
the name part of one alone), mistyped numbers, and numbers that their words and their company
give away.

The nodes of a document are its base spans, whose labels are known, and all other candidates,
whether or not a base span stands in the document: number-like runs of seven or more digits,
dotted quads in other writings, spelt-out addresses, and words that equal the name part of an
address. Potentials depend on a node's shape and on the words before it, join neighbours in
reading order, and join distant nodes that are equal or similar (in all digits, in their last
digits, in one half, by name part). Equal and similar nodes are chained in order of appearance,
so a document has at most a few edges a node however often something recurs. Labels follow from
loopy belief propagation, which ends when messages settle or after ``ROUNDS``.

Weights are fitted by pseudo-likelihood on labelled documents made from a seed: personal data
in several writings, with and without telling words, among numbers of other kinds. There,
numbers of other kinds mostly follow a word that tells so, and a number of a card's length
without one is a mistyped card more often than not.

Defined cases: a null text is empty and has no spans; repeated rows are read alike; a text of
any length is read whole, in time that grows with its length; an empty table gives no rows;
extra columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import map_batches, row_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

ROUNDS = 60
SETTLED = 1e-6
DAMPING = 0.3
NEAR = 120
MIN_DIGITS = 7
MOST_DIGITS = 19
SIMILAR_DIGITS = 8
BEFORE = 24
TRAIN_DOCUMENTS = 900
SEED = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits is tried once, from its start: later starts within it fail or match the same
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().\-/_]{0,2}[0-9])+(?![0-9A-Za-z])")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# Words that tell, before a candidate, what it is.
_TELLING = tuple(
    re.compile(rf"(?:{words})\W*(?:is|no|nr|number|at|:|=)?\W*$")
    for words in (
        "card|account|visa|iban|paid with|payment",
        "phone|tel|call|mobile|fax|dial|ring",
        "ip|host|server|from|address",
        "mail|contact|write|user|login|ask",
        "order|invoice|ref|id|tracking|version|isbn|serial|batch|ticket|part|item|sku|build|page|population|total",
    )
)
_QUAD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?[\[({]?(?:\.|dot)[\])}]?\s?[0-9]{1,3}){3}(?![0-9A-Za-z])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)[A-Za-z0-9-]{1,63}){1,8}")
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]+")


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Number-like runs; one of more digits than any number has is cut at its white space."""
    for m in _NUMBER.finditer(text):
        parts = [m.span()]
        if len(_digits(m[0])) > MOST_DIGITS:
            parts = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m[0])]
        for s, e in parts:
            if MIN_DIGITS <= len(_digits(text[s:e])) and e - s <= 3 * MOST_DIGITS:
                yield s, e


class Graph:
    """The candidates of one document: spans, known labels (0 if unknown), shapes and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        taken = sorted((s, e) for _, s, e in base)
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
        starts = [s for s, _ in taken]

        def free(s: int, e: int) -> bool:
            k = int(np.searchsorted(starts, e))
            return not k or ends[k - 1] <= s

        spans: list[tuple[int, int]] = []
        if _DIGIT.search(text):
            spans += _numbers(text)
            spans += (m.span() for m in _QUAD.finditer(text))
        if "at" in text:
            spans += (m.span() for m in _SPELT.finditer(text))
        names = {text[s:e].partition("@")[0].lower() for kind, s, e in base if kind == 0}
        if names:
            for m in _TOKEN.finditer(text):
                word = m[0].rstrip(".-")
                if word.lower() in names:
                    spans.append((m.start(), m.start() + len(word)))
        nodes = [(s, e, kind + 1) for kind, s, e in base]
        end = 0
        # of candidates that overlap, the first and longest
        for s, e in sorted(set(spans), key=lambda x: (x[0], -x[1])):
            if s >= end and free(s, e):
                nodes.append((s, e, 0))
                end = e
        self.nodes = sorted(nodes)
        words = [text[s:e] for s, e, _ in self.nodes]
        often = Counter(w.lower() for w in words)
        self.features = np.array([_shape(w, text[max(0, s - BEFORE) : s].lower(), often[w.lower()]) for w, (s, _, _) in zip(words, self.nodes)], np.float64).reshape(len(self.nodes), N_SHAPES)
        self.known = np.array([k for _, _, k in self.nodes], np.int64)
        self.edges = self._edges(words)

    def _edges(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(node, node, type): 0 next in reading order and near, 1 equal, 2 the same ending or name, 3 the same half."""
        out = [(i, i + 1, 0) for i in range(len(self.nodes) - 1) if self.nodes[i + 1][0] - self.nodes[i][1] <= NEAR]
        last: dict[tuple, int] = {}
        for i, word in enumerate(words):
            digits = _digits(word)
            n = len(digits)
            if any(c.isalpha() for c in word) or "@" in word:
                keys = [(1, "word", word.lower()), (2, "name", _SEPARATOR.split(word.lower(), maxsplit=1)[0])]
            else:
                keys = [(1, "number", digits)]
                if n >= SIMILAR_DIGITS:
                    keys.append((2, "tail", digits[-SIMILAR_DIGITS:]))
                if n > SIMILAR_DIGITS:
                    keys += [(3, "front", n, digits[: n // 2]), (3, "back", n, digits[n // 2 :])]
            met = set()
            for key in keys:
                j = last.get(key)
                # equal nodes are joined once, by the strongest of their edges
                if j is not None and j not in met:
                    out.append((j, i, key[0]))
                    met.add(j)
                last[key] = i
        return out


_SEPARATOR = re.compile(r"@|\s?[\[({]\s?at")
N_SHAPES = 24
N_EDGES = 4


def _shape(word: str, before: str, often: int) -> list[float]:
    digits = _digits(word)
    n = len(digits)
    parts = re.split(r"\s?[\[({]?(?:\.|dot)[\])}]?\s?", word)
    letters = any(c.isalpha() for c in word.replace("dot", ""))
    name = letters and "@" not in word and not _SEPARATOR.search(word)
    quad = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)
    return [
        1.0,
        float(name),
        float(name and (n > 0 or "." in word or "_" in word)),
        float(name and len(word) <= 4),
        float(name and len(word) <= 4) * float(np.log(often)),
        float(bool(_SEPARATOR.search(word))),
        float(not letters and n < MIN_DIGITS),
        float(not letters and MIN_DIGITS <= n <= 9),
        float(not letters and 10 <= n <= 15),
        float(not letters and n == 16),
        float(not letters and 17 <= n <= MOST_DIGITS),
        float(n > MOST_DIGITS),
        float(quad and all(int(p) <= 255 for p in parts)),
        float(quad),
        float(word[:1] in "+("),
        float(16 <= n <= MOST_DIGITS and luhn(digits)),
        float(" " in word or "-" in word),
        float("/" in word or "_" in word),
        float(n == 8 and digits[:2] in ("19", "20")),
        *(float(bool(t.search(before))) for t in _TELLING),
    ]


def _labelled_documents(seed: int = SEED, n: int = TRAIN_DOCUMENTS) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """Texts with the labels of all spans that are data, however written."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    of = lambda *options: options[rng.integers(len(options))]
    chance = lambda p: rng.random() < p

    def card() -> str:
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def split(number: str, sep: str, size: int) -> str:
        return sep.join(number[k : k + size] for k in range(0, len(number), size))

    def mistyped(number: str) -> str:
        k = int(rng.integers(len(number)))
        return number[:k] + str((int(number[k]) + int(rng.integers(1, 10))) % 10) + number[k + 1 :]

    def personal(kind: int) -> list[tuple[str, int, str]]:
        """One datum in its writings: (text, label, telling words)."""
        if kind == 1:
            letters = "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.integers(0, 26, rng.integers(3, 9)))
            name, host = of(f"{letters}.{digits(2)}", f"{letters}{digits(1)}", letters), f"mail{digits(1)}.example.com"
            more = [name] * int(rng.integers(0, 3)) + [of(f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}")] * chance(0.3)
            return [(f"{name}@{host}", 1, "")] + [(w, 1, of("", "", "user", "ask")) for w in more]
        if kind == 2:
            quad = [str(x) for x in rng.integers(0, 256, 4)]
            return [(".".join(quad), 2, of("", "from"))] + [(of("[.]", "(.)", " . ").join(quad), 2, of("", "host"))] * chance(0.3)
        if kind == 3:
            number = card()
            first = [(split(number, of(" ", "-"), 4), 3, of("", "card"))] if chance(0.6) else []
            more = [split(number, of(".", "/", "_"), 4)] * int(rng.integers(0, 2)) + [mistyped(number)] * int(rng.integers(0 if first else 1, 2))
            return first + [(w, 3, of("", "", "account")) for w in more]
        code, number = str(rng.integers(1, 99)), digits(int(rng.integers(9, 11)))
        first = [(f"+{code} {split(number, ' ', 3)}", 4, of("", "phone"))] if chance(0.7) else []
        more = [split(number, of(" ", "-", "."), 3) if chance(0.6) else f"({number[:3]}) {number[3:6]}-{number[6:]}"]
        return first + [(w, 4, of("", "call") if first else "call") for w in more * int(rng.integers(0 if first else 1, 3))]

    def other() -> tuple[str, int, str]:
        word = of(digits(int(rng.integers(7, 20))), digits(16), f"20{digits(6)}", split(digits(8), "-", 4), f"{digits(4)}/{digits(4)}", split(digits(12), "_", 4), f"{rng.integers(256, 999)}.{digits(2)}.{digits(3)}.{digits(1)}")
        return word, 0, of("order", "invoice", "ref", "tracking", "serial", "batch", "ticket", "total", "version", "")

    out = []
    for k in range(n):
        pieces: list[tuple[str, int, str]] = []
        if k % 3:
            for kind in rng.choice(4, size=rng.integers(1, 4)) + 1:
                pieces += personal(int(kind))
            pieces += [other() for _ in range(int(rng.integers(0, 3)))]
        else:
            pieces += [other() for _ in range(int(rng.integers(1, 6)))]
            # a shorter word for a user name, which prose uses as a word
            if chance(0.3):
                word = of("the", "info", "and", "sale")
                pieces += [(f"{word}@mail{digits(1)}.example.com", 1, "")] + [(word, 0, "")] * int(rng.integers(2, 9))
        text, labels = "", {}
        for at in rng.permutation(len(pieces)):
            word, label, telling = pieces[at]
            text += of("an entry", "then some more words about it", "so it went on") + " , " + (telling + " " if telling else "")
            labels[(len(text), len(text) + len(word))] = label
            text += word + " , "
        out.append((text, labels))
    return out


@cache
def fitted() -> tuple[np.ndarray, np.ndarray]:
    """Weights (shapes x labels) and edge potentials (types x labels x labels)."""
    n_labels = len(LABELS)
    x_rows, y_rows = [], []
    for text, labels in _labelled_documents():
        graph = Graph(text, base_spans(text))
        gold = [k or labels.get((s, e), 0) for s, e, k in graph.nodes]
        around = np.zeros((len(gold), N_EDGES, n_labels))
        for i, j, kind in graph.edges:
            around[i, kind, gold[j]] += 1
            around[j, kind, gold[i]] += 1
        for i, label in enumerate(gold):
            if not graph.known[i]:
                x_rows.append(np.concatenate([graph.features[i], around[i].ravel()]))
                y_rows.append(label)
    x, y = np.array(x_rows), np.eye(n_labels)[y_rows]
    w = np.zeros((x.shape[1], n_labels))
    for _ in range(1500):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 2.0 * (x.T @ (y - p) / len(x) - 1e-4 * w)
    pairs = w[N_SHAPES:].reshape(N_EDGES, n_labels, n_labels)
    return w[:N_SHAPES], (pairs + pairs.transpose(0, 2, 1)) / 2


def infer(graph: Graph, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Beliefs (nodes x labels) after loopy message passing."""
    unary, pairs = weights
    score = graph.features @ unary
    held = graph.known > 0
    score[held] = -30.0
    score[held, graph.known[held]] = 30.0
    if graph.edges:
        edge = np.array(graph.edges)
        source = np.concatenate([edge[:, 0], edge[:, 1]])
        target = np.concatenate([edge[:, 1], edge[:, 0]])
        back = np.concatenate([np.arange(len(edge)) + len(edge), np.arange(len(edge))])
        potential = pairs[np.concatenate([edge[:, 2], edge[:, 2]])]
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            total = score.copy()
            np.add.at(total, target, sent)
            out = total[source] - sent[back]
            out = out[:, :, None] + potential
            top = out.max(axis=1, keepdims=True)
            out = top[:, 0] + np.log(np.exp(out - top).sum(axis=1))
            out -= out.max(axis=1, keepdims=True)
            new = DAMPING * sent + (1 - DAMPING) * out
            moved, sent = np.abs(new - sent).max(), new
            if moved < SETTLED:
                break
        np.add.at(score, target, sent)
    belief = np.exp(score - score.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def find_spans(text: str, weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, is base), by kind and start."""
    base = base_spans(text)
    out = [(k, s, e, True) for k, s, e in base]
    graph = Graph(text, base)
    if not graph.known.all():
        best = infer(graph, weights).argmax(axis=1)
        out += [(int(label) - 1, s, e, False) for (s, e, known), label in zip(graph.nodes, best) if label and not known]
    return sorted(out)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans have kind, start, end and whether the base rules found them."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in find_spans(t or "", shared.value)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, FOUND)

