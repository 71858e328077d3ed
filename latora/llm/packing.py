"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: the feed-forward work plus
attention within the piece. Documents are cut where they exceed a sequence; the pieces of a
window go, by descending cost, each to the cheapest sequence that still has room for it. What
fits nowhere whole is cut and fills the remaining room.

The work is local to a partition: texts are tokenised and packed where they are read, nothing
is shuffled, and a retried task gives the same rows again. A task holds the tokens of one
window (``WINDOW_TOKENS``). What is left of a window, less than one sequence, is packed with the
next one. What is left of a partition is dealt into sequences whose lengths are powers of two,
which need no padding; all others are full.

Defined cases: a null text is an empty one and gives one piece, the end token alone; repeated
rows are packed as separate documents; a text of any length is cut; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import map_batches, row_slices

SEQUENCE = 2048
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1.0 / SEQUENCE
WINDOW_TOKENS = 4_000_000
CACHE_WORDS = 500_000
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, piece_cost double"

#: Chunks, one a line, of unaccented or Latin-1 letters and then ASCII signs: such a chunk is
#: one pre-token of letters and at most one of signs, whatever stands around it.
_PLAIN = re.compile(rb"^((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)$", re.M)
#: Texts with this may name a special token, which is told by its case.
_SPECIAL = b"<|"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordEncoder:
    """Token ids of whole texts, as little-endian uint32, by way of their white-space chunks.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    chunks' ids in a row. Chunks seen before come from a bounded cache; new plain words are
    encoded many at a time and told apart by their word-end tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lists of lower-cased words of Latin-1 letters: nothing to normalise
        self.by_space = Tokenizer(self.tokenizer.model)
        self.by_space.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.by_space.encode_batch_fast([b" ".join(part).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, begin = ids.tobytes(), 0
                for word, end in zip(part, (ends * 4).tolist()):
                    self.words[word] = raw[begin:end]
                    begin = end
            else:
                for word, own in zip(part, self._ids([w.decode() for w in part])):
                    self.words[word] = np.array(own, "<u4").tobytes()

    def _learn(self, chunks: set[bytes]) -> None:
        plain = _PLAIN.findall(b"\n".join(chunks))
        self._learn_words([w for w in {w for w, _ in plain} if w not in self.words])
        signs = [s for s in {s for _, s in plain} if s not in self.words]
        for sign, ids in zip(signs, self._ids([s.decode() for s in signs])):
            self.words[sign] = np.array(ids, "<u4").tobytes()
        words, known = self.words, self.chunks
        for word, sign in plain:
            known[word + sign] = words[word] + words[sign]
        if len(plain) < len(chunks):
            other = [c for c in chunks if c not in known]
            for chunk, ids in zip(other, self._ids([c.decode("utf-8", "replace") for c in other])):
                known[chunk] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if _SPECIAL in t else t.lower()).split() for t in texts]
        new: set[bytes] = set()
        for chunks in split:
            new.update(chunks)
        new -= self.chunks.keys()
        if len(self.chunks) + len(new) > CACHE_WORDS:
            self.chunks.clear()
            self.words.clear()
            new = set().union(*split)
        if new:
            self._learn(new)
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One for each worker process, which serves many tasks."""
    return WordEncoder(path)


def piece_cost(length: float) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack_window(lengths: list[int], room: list[int], costs: list[float], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Place documents of the given lengths in sequences of which ``room`` tokens are free.

    Returns (document, start, length, sequence); ``room`` and ``costs`` are brought up to
    date. The room in all must be at least the length in all.
    """
    units = []
    for doc, n in enumerate(lengths):
        full = n - n % capacity
        units += [(capacity, doc, at) for at in range(0, full, capacity)]
        if n > full:
            units.append((n - full, doc, full))
    units.sort(key=lambda u: (-u[0], u[1], u[2]))
    # pieces descend, so what has room for one has room for all after it until it is filled further:
    # ``heap`` holds those sequences by cost, ``waiting`` the others by their room
    waiting: list[list[int]] = [[] for _ in range(max(room, default=0) + 1)]
    for s, free in enumerate(room):
        waiting[free].append(s)
    heap: list[tuple[float, int]] = []
    level = len(waiting)
    placed, cut = [], []
    for n, doc, at in units:
        while level > n:
            level -= 1
            for s in waiting[level]:
                heapq.heappush(heap, (costs[s], s))
        if not heap:
            cut.append((n, doc, at))
            continue
        s = heap[0][1]
        placed.append((doc, at, n, s))
        room[s] -= n
        costs[s] += piece_cost(n)
        if room[s] >= n:
            heapq.heapreplace(heap, (costs[s], s))
        else:
            heapq.heappop(heap)
            waiting[room[s]].append(s)
    # fewer pieces are cut than there are sequences; a remainder stays whole where it can
    free, cost = np.array(room, np.int64), np.array(costs, np.float64)
    for n, doc, at in cut:
        while n:
            having = np.flatnonzero(free >= n)
            if not len(having):
                having = np.flatnonzero(free)
            s = int(having[cost[having].argmin()])
            take = min(n, int(free[s]))
            placed.append((doc, at, take, s))
            free[s] -= take
            cost[s] += piece_cost(take)
            n, at = n - take, at + take
    room[:], costs[:] = free.tolist(), cost.tolist()
    return placed


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        columns = list(zip(*rows[at : at + 4096]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("piece_cost", pa.float64())])


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class _Packer:
    """Windows of one partition. What fills no whole sequence passes from each window to the next."""

    def __init__(self, partition: int):
        self.next_id = partition << 40
        self.docs: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes, start: int = 0, total: int | None = None) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, ids, start, n if total is None else total))
        self.tokens += n

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        docs, full, rest = self.docs, *divmod(self.tokens, SEQUENCE)
        room = [SEQUENCE] * full + (powers_of_two(rest) if last else [rest][:rest])
        fill = [0] * len(room)
        placed = pack_window([len(d[1]) // 4 for d in docs], room, [0.0] * len(room))
        placed.sort(key=lambda p: (p[3], p[0], p[1]))
        self.docs, self.tokens = [], 0
        rows = []
        for doc, at, n, s in placed:
            doc_id, raw, start, total = docs[doc]
            ids = raw[4 * at : 4 * (at + n)]
            if s < full or last:
                rows.append((doc_id, start + at, n, ids, total, self.next_id + s, fill[s], piece_cost(n)))
                fill[s] += n
            else:
                self.add(doc_id, ids, start + at, total)
        self.next_id += len(room) if last else full
        yield from _batches(rows, _ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pieces of every document with their token ids (little-endian uint32), sequence and place.

    ``path`` names the tokenizer file; each executor reads its own copy.
    """
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(path)
        packer = _Packer(TaskContext.get().partitionId())
        for part in row_slices(batches):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                packer.add(doc_id, ids + end)
                if packer.tokens >= WINDOW_TOKENS:
                    yield from packer.flush()
        yield from packer.flush(last=True)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")), run, PIECES)
