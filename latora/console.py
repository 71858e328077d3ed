"""Plain-text output that any terminal can show."""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence
from typing import TextIO

# Own values: signs and what stands for them where the encoding lacks them.
SIGNS = {"rule": ("─", "-"), "bar": ("█", "#"), "ok": ("✓", "+"), "warn": ("⚠", "!"), "bullet": ("•", "*")}


def supports_unicode(stream: TextIO | None = None) -> bool:
    """Whether all signs can be encoded; LATORA_ASCII set to anything but 0 says no."""
    if os.environ.get("LATORA_ASCII", "0") != "0":
        return False
    encoding = getattr(stream or sys.stdout, "encoding", None) or "ascii"
    try:
        "".join(s for s, _ in SIGNS.values()).encode(encoding)
    except (UnicodeEncodeError, LookupError):
        return False
    return True


def sign(name: str, stream: TextIO | None = None) -> str:
    fine, plain = SIGNS[name]
    return fine if supports_unicode(stream) else plain


class Console:
    """Prints what the stream's encoding allows, and nothing when quiet."""

    def __init__(self, quiet: bool = False, stream: TextIO | None = None):
        self.quiet, self.stream = quiet, stream or sys.stdout

    def print(self, text: str = "") -> None:
        if not self.quiet:
            encoding = getattr(self.stream, "encoding", None) or "ascii"
            self.stream.write(text.encode(encoding, "replace").decode(encoding) + "\n")

    def header(self, text: str) -> None:
        self.print(text)
        self.print(sign("rule", self.stream) * len(text))

    def ok(self, text: str) -> None:
        self.print(f"{sign('ok', self.stream)} {text}")

    def warn(self, text: str) -> None:
        self.print(f"{sign('warn', self.stream)} {text}")

    def bar(self, share: float, width: int = 40) -> str:
        return sign("bar", self.stream) * round(width * share)


def metrics_table(rows: Sequence[dict], columns: Sequence[str], k: int, at_k: Sequence[str] = ("hit_rate", "precision", "recall", "ndcg")) -> str:
    """A fixed-width table of systems; names of cut-off metrics carry the cut-off."""
    names = [f"{c}@{k}" if c in at_k else c for c in columns]
    widths = [max(9, len(n)) + 2 for n in names]
    lines = [f"{'system':18s}" + "".join(f"{n:>{w}s}" for n, w in zip(names, widths))]
    lines += [f"{r['system']:18s}" + "".join(f"{r[c]:{w}.4f}" for c, w in zip(columns, widths)) for r in rows]
    return "\n".join(lines)
