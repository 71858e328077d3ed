"""Document quality rules: counts, and divergence from the references of languages.

Counts per document: words, code points in words, symbol characters, lines equal to an earlier
one, and words inside five-word windows that occur more than once. ``base_failed`` follows from
them alone.

The verdict beyond that compares two histograms of a document, one of character classes and
one of common words, to those of its language by Jensen-Shannon divergence (in bits). The
references are sums over all documents of each language, made in a first reading. A document
of another language, or of none, is compared to every reference and the nearest counts. Texts
under ``MIN_CHARS`` bytes or ``MIN_WORDS`` words are too short for the histogram in question and
aren't judged by it.

Words are split at ASCII white space only.

Defined cases: a null text has no words and fails the base rule, as empty ones do; repeated
rows are judged alike; a text of any length is judged whole; an empty table gives no rows and
no references, and without any reference nothing is judged by divergence; extra columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import map_batches, row_slices, utf8

WINDOW = 5
MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CHARS = 200
MIN_WORDS = 40
MAX_CLASS_DIVERGENCE = 0.10
MAX_WORD_DIVERGENCE = 0.16

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for was with by as on at from be this it are a".split(),
    "de": "der die das und in den von zu mit dem des ein eine ist nicht auf im als sich auch".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur au aux avec pas".split(),
    "es": "el la los las de y en que un una por con para del se no es al lo como".split(),
}
# Classes of bytes; bytes that continue a character count for nothing.
_SYMBOLS = b"#*$%&|<>"
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?!'\"()-", _SYMBOLS, bytes(range(0xC0, 0x100))]

_LIST = sorted({w for words in COMMON_WORDS.values() for w in words})
_NUMBER = {w.encode(): k for k, w in enumerate(_LIST)}
_OTHER = len(_LIST)
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes)] = _k
_CLASS_OF[0x80:0xC0] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 1

RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_divergence double, word_divergence double"


def class_histogram(text: bytes) -> np.ndarray:
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(_CLASS_OF, weights=bytes_, minlength=N_CLASSES + 1)[:N_CLASSES]


def word_histogram(words: list[bytes]) -> np.ndarray:
    """Counts of the common words among lower-cased words, and last of all others."""
    get = _NUMBER.get
    found = np.fromiter((get(w, _OTHER) for w in words), np.int64, len(words))
    return np.bincount(found, minlength=_OTHER + 1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[:n].copy()
        for k in range(1, window):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # equal hashes are candidates; the words themselves decide
    places = defaultdict(list)
    for at in np.flatnonzero(np.isin(mixed, twice)).tolist():
        places[tuple(words[at : at + window])].append(at)
    change = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(change, found, 1)
            np.add.at(change, np.array(found) + window, -1)
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(lines) - len(set(lines))


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence of two histograms, 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(max(0.0, (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of every language with a word list, summed over all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {k: np.zeros(N_CLASSES + _OTHER + 1, np.int64) for k in COMMON_WORDS}
        for part in row_slices(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang in sums:
                    raw = utf8(text)
                    sums[lang][:N_CLASSES] += class_histogram(raw).astype(np.int64)
                    sums[lang][N_CLASSES:] += word_histogram(raw.lower().split())
        for lang, x in sums.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(x[some])], names=["lang", "bin", "n"])

    out: dict = defaultdict(lambda: np.zeros(N_CLASSES + _OTHER + 1))
    counted = map_batches(docs.select(text_col, lang_col), run, "lang string, bin long, n long")
    for r in counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.lang][r.bin] = r.n
    return {lang: (x[:N_CLASSES], x[N_CLASSES:]) for lang, x in out.items() if x[:N_CLASSES].sum() and x[N_CLASSES:].sum()}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and divergences of each document, ``base_failed`` and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in row_slices(batches):
            rows = []
            for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = utf8(text)
                words = raw.split()
                classes = class_histogram(raw)
                space = raw.count(b" ") + sum(raw.count(bytes([c])) for c in range(9, 14))
                of = [known[lang]] if lang in known else list(known.values())
                by_class = min((divergence(classes, c) for c, _ in of), default=0.0) if len(raw) >= MIN_CHARS else None
                by_word = None
                if len(words) >= MIN_WORDS:
                    own = word_histogram(raw.lower().split())
                    by_word = min((divergence(own, w) for _, w in of), default=0.0)
                rows.append((len(words), len(text or "") - space, sum(raw.count(bytes([c])) for c in _SYMBOLS), duplicate_lines(raw), repeated_words(words), by_class, by_word))
            types = [pa.int64()] * 5 + [pa.float64()] * 2
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[f.split()[0] for f in RULES.split(", ")])

    judged = map_batches(docs.select(F.col(id_col).cast("long"), text_col, lang_col), run, RULES)
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    odd = (F.coalesce("class_divergence", F.lit(0.0)) > MAX_CLASS_DIVERGENCE) | (F.coalesce("word_divergence", F.lit(0.0)) > MAX_WORD_DIVERGENCE)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)
