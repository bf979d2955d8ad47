"""Secret scans: known forms by pattern, others by sliding-window entropy of candidate strings."""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame

from phasegrid.llm.common import id_and_text, map_texts

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy in bits of a window, by the characters of the candidate.
LEAST_BITS = {"hex": 2.9, "alnum": 3.6, "base64": 3.8}
#: Candidates that look random and are none: counting alphabets, placeholders, repeated marks.
ALLOWED = (r"(?i)example|sample|placeholder|dummy|xxxx|changeme", r"(?i)0123456789|abcdefghij|qwertyuiop", r"(.)\1{7,}", r"[-_=+/]{6,}")
#: Characters at the end of an allowed match where the next one may begin; a longer search would be quadratic in long runs.
OVERLAP = 32
GAIN = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def character_class(value: str) -> str | None:
    """The class that decides the entropy limit; plain words and numbers have none."""
    body = value.rstrip("=")
    if not (re.search("[0-9]", body) and re.search("[A-Za-z]", body)):
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    return "alnum" if re.fullmatch("[A-Za-z0-9]+", body) else "base64"


def dense_ranges(value: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined ranges of the windows whose Shannon entropy reaches ``least``.

    Counts change by one character at either end, and with them the sum of n log n: constant work for each step.
    """
    counts: dict[str, int] = {}
    total, base, ranges = 0.0, log2(window), []
    for i, c in enumerate(value):
        if i >= window:
            n = counts[old := value[i - window]]
            counts[old] = n - 1
            total += GAIN[n - 1] - GAIN[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += GAIN[n + 1] - GAIN[n]
        if i >= window - 1 and base - total / window >= least:
            start = i - window + 1
            if ranges and start <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], i + 1)
            else:
                ranges.append((start, i + 1))
    return ranges


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost and not overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def open_ranges(value: str, allowed: list[re.Pattern]) -> list[tuple[int, int]]:
    """The ranges between allowed matches, overlapping ones included; a window over such a match lies in none of them."""
    matches = []
    for a in allowed:
        at = 0
        while at <= len(value) and (m := a.search(value, at)):
            matches.append(m.span())
            at = max(m.start() + 1, m.end() - OVERLAP)
    at, ranges = 0, []
    for start, end in sorted(matches):
        ranges.append((at, start))
        at = max(at, end)
    return [(a, b) for a, b in [*ranges, (at, len(value))] if b - a >= WINDOW]


def entropy_spans(text: str, allowed: list[re.Pattern]) -> list[tuple[int, int, int]]:
    spans = []
    for m in CANDIDATE.finditer(text):
        kind = character_class(m[0])
        if kind:
            for low, high in open_ranges(m[0], allowed):
                at = m.start() + low
                spans += [(at + a, 3, at + b) for a, b in dense_ranges(m[0][low:high], LEAST_BITS[kind])]
    return spans


def spans_of(text: str, allowed: list[re.Pattern]) -> list[tuple[int, int, int]]:
    """All spans of a text: (start, kind, end) in their order."""
    return sorted(base_spans(text) + entropy_spans(text, allowed))


def compiled(allowed: tuple[str, ...] = ALLOWED) -> list[re.Pattern]:
    return [re.compile(p) for p in allowed]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts by kind, digest of the known forms, and all spans as ``kind:start:end``.

    Offsets are code points, ends exclusive. Null and empty texts hold nothing (empty strings, counts 0); repeated rows
    are scanned alike; a null id stays null. One narrow stage over whole texts.
    """
    skip = compiled(allowed)

    def run(ids, texts):
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")} | {"doc_id": ids}
        for value in texts:
            base = base_spans(value or "")
            every = sorted(base + entropy_spans(value or "", skip))
            kinds = [k for _, k, _ in base]
            for k in range(3):
                out[f"n_{KINDS[k]}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(id_and_text(docs, key, text), run, schema)


def masked(text: str | None, spans: str, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    if text is None or not spans:
        return text
    ranges: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if ranges and a < ranges[-1][1]:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    out, at = [], 0
    for a, b in ranges:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
