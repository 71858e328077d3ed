"""Installing and checking a dataset file on the driver."""

from __future__ import annotations

import csv
import hashlib
import os
import urllib.request
from collections.abc import Sequence

from latora.sources.catalog import COLUMN_NAMES, DEFAULT_FEATURES

GUIDANCE = """A dataset is a CSV file with a header: a title column, and the numeric features
danceability, energy, speechiness, acousticness, instrumentalness, liveness, valence, loudness
and tempo. An artist column, genre, popularity or streams are used where present. Give its
address with --url, or its path with --data; --synthetic works without one."""


def describe_sources() -> str:
    return GUIDANCE


def sha256_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def validate_csv(path: str, feature_names: Sequence[str] = DEFAULT_FEATURES) -> tuple[bool, str]:
    """Whether the header has a title and all features, under the names that ``ingest`` takes."""
    with open(path, newline="", encoding="utf-8", errors="replace") as file:
        header = next(csv.reader(file), [])
    usual = {other: name for name, others in COLUMN_NAMES.items() for other in others}
    names = {usual.get(n, n) for n in (c.strip().lower().replace(" ", "_") for c in header)}
    if "track_name" not in names:
        return False, "no title column"
    missing = [c for c in feature_names if c not in names]
    return (False, f"missing features: {', '.join(missing)}") if missing else (True, "ok")


def fetch(destination: str, url: str | None = None, force: bool = False) -> int:
    """0 when a valid file is in place at the end, else 1."""
    if os.path.exists(destination) and not force:
        good, why = validate_csv(destination)
        if good:
            print(f"kept {destination}: {os.path.getsize(destination)} bytes, sha256 {sha256_of(destination)}")
            return 0
        print(f"{destination} can't be used: {why}")
    if not url:
        print(describe_sources())
        return 1
    os.makedirs(os.path.dirname(os.path.abspath(destination)), exist_ok=True)
    partial = f"{destination}.partial"
    try:
        with urllib.request.urlopen(url, timeout=60) as source, open(partial, "wb") as target:
            while block := source.read(1 << 20):
                target.write(block)
        good, why = validate_csv(partial)
        if not good:
            print(f"{url} can't be used: {why}")
            return 1
        os.replace(partial, destination)
    except OSError as problem:
        print(f"{url} can't be read: {problem}")
        return 1
    finally:
        if os.path.exists(partial):
            os.remove(partial)
    print(f"wrote {destination}: {os.path.getsize(destination)} bytes, sha256 {sha256_of(destination)}")
    return 0
