"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after another into words of 64 bits, a bit for each state. All
rules advance together over a canonical URL by shift and mask (Shift-And); ``*`` stands for
characters other than ``/``, ``**`` for any. Batches of URLs step through their characters side
by side, long URLs on after the others have ended.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; its path is what follows up to ``?``, ``#`` or the end. The canonical URL is
host and path. A host rule (host, path) fits the host and all its subdomains where the path
starts with the rule's; of the host rules that fit, the longest decides. URLs that no host
rule fits are judged by the general globs: block if any fits, else allow.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no host
rule and is judged by the globs (allow); an empty URL likewise; of equal rules the first
decides; repeated rows are judged alike; a URL of any length is read whole; an empty table
gives no rows; extra columns are ignored. Rules are compared by UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latora.llm.common import map_batches, row_slices

#: (verdict, host, path)
HOST_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: General globs over the canonical URL, for what no host rule fits.
BLOCK_GLOBS = ("*casino*/**", "*porn*/**", "**/wp-login.php", "**/cgi-bin/**", "**.exe", "doubleclick.net/**", "*.doubleclick.net/**")
JUDGED = "page_id long, host string, path string, rule_number int, glob_number int"
_ANY, _HOST = b"\x00", b"\x01"  # wildcards as they stand in a pattern: any characters, and none of them "/"


def host_globs(rules: Sequence[tuple[str, str, str]]) -> list[str]:
    """Two globs for each host rule: the host itself and its subdomains."""
    return [glob for _, host, path in rules for glob in (f"{host}{path}**", f"*.{host}{path}**")]


class Automaton:
    """All globs in one state vector.

    State k of a glob is a bit: its first k characters have been read. A wildcard has no
    state of its own; it lets the state before it stay, for the characters it stands for.
    """

    def __init__(self, globs: Sequence[str]):
        states, self.first, self.final = 0, [], []
        steps: list[tuple[int, int]] = []
        stays: list[tuple[int, bool]] = []
        for glob in globs:
            state = states
            self.first.append(state)
            raw = glob.encode().replace(b"**", _ANY).replace(b"*", _HOST)
            for byte in raw:
                if byte in _ANY + _HOST:
                    stays.append((state, byte == _ANY[0]))
                else:
                    state += 1
                    steps.append((state, byte))
            self.final.append(state)
            states = state + 1
        self.words = max(1, -(-states // 64))
        bit = lambda k: (k // 64, np.uint64(1) << np.uint64(k % 64))
        self.advance = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for state, byte in steps:
            w, mask = bit(state)
            self.advance[byte, w] |= mask
        within = np.arange(256) != ord("/")
        for state, whatever in stays:
            w, mask = bit(state)
            self.stay[whatever | within, w] |= mask
        for state in self.first:
            w, mask = bit(state)
            self.start[w] |= mask
        self.accept = [bit(k) for k in self.final]

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """texts x globs: which globs fit which whole texts."""
        n = len(texts)
        state = np.repeat(self.start[None, :], n, axis=0)
        length = np.fromiter(map(len, texts), np.int64, n)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        alive, at = order, 0
        down = np.uint64(1)
        while True:
            alive = alive[: np.searchsorted(-length[alive], -at, side="left")]
            if not len(alive):
                break
            byte = data[begin[alive] + at]
            own = state[alive]
            moved = own << down
            if self.words > 1:
                moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            state[alive] = (moved & self.advance[byte]) | (own & self.stay[byte])
            at += 1
        out = np.zeros((n, len(self.accept)), bool)
        for k, (w, mask) in enumerate(self.accept):
            out[:, k] = (state[:, w] & mask) != 0
        return out


def split_url(url: str | None) -> tuple[bytes, bytes]:
    """Host and path of a URL as UTF-8."""
    if url is None:
        return b"", b""
    _, mark, rest = url.encode("utf-8", "surrogatepass").partition(b"://")
    if not mark:
        return b"", b""
    for stop in (b"?", b"#"):
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    rules = list(dict.fromkeys(rules))
    size = [len((host + path).encode()) for _, host, path in rules]
    longest = sorted(range(len(rules)), key=lambda k: -size[k])
    automaton = Automaton(host_globs(rules) + list(block_globs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 4096):
            split = [split_url(u) for u in part.column(1).to_pylist()]
            fits = automaton.match([h + p for h, p in split])
            rule, glob = np.full(len(split), -1, np.int32), np.full(len(split), -1, np.int32)
            for k in reversed(longest):
                rule[fits[:, 2 * k] | fits[:, 2 * k + 1]] = k
            for g in reversed(range(len(block_globs))):
                glob[fits[:, 2 * len(rules) + g]] = g
            text = lambda x: pa.array([b.decode("utf-8", "surrogatepass") for b in x], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), text(h for h, _ in split), text(p for _, p in split), pa.array(rule), pa.array(glob)], names=["page_id", "host", "path", "rule_number", "glob_number"])

    judged = map_batches(pages.select(F.col(id_col).cast("long"), url_col), run, JUDGED)
    name, verdict = F.lit(None).cast("string"), F.when(F.col("glob_number") >= 0, "block").otherwise("allow")
    for k, (says, host, path) in enumerate(rules):
        name = F.when(F.col("rule_number") == k, host + path).otherwise(name)
        verdict = F.when(F.col("rule_number") == k, says).otherwise(verdict)
    glob = F.when(F.col("glob_number") >= 0, F.get(F.array(*map(F.lit, block_globs)), F.col("glob_number"))) if block_globs else F.lit(None).cast("string")
    return judged.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), glob.alias("glob_rule"))
