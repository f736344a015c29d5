"""Secret scan: base patterns, and weak candidates that count only beside their counterparts.

Base kinds stand alone. A credential often comes in parts, though: an access
identifier, a secret and an endpoint. Each part alone is weak (a random string, a
host name). Parts are linked within a scope (a paragraph: no blank line between),
however far apart; a weak secret is reported only if an identifier and an endpoint,
or an identifier that is a base one, are in its scope, and the weak parts it is
linked to are reported with it. A ``reach`` narrows that to parts whose intervals,
widened by it, meet.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from matchbook.llm.texts import documents, map_rows

# The base patterns, with the group that holds the secret and its least size.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

# Weak parts: an identifier, a secret, an endpoint.
WEAK = {
    "weak_id": re.compile(
        r"""(?:client|account|user|access|key)_?-?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.-]{4,})"""
        r"""|\b((?:AROA|AIDA|ASIA)[A-Z0-9]{12,})""",
        re.IGNORECASE | re.ASCII,
    ),
    "weak_secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"),
    "weak_endpoint": re.compile(
        r"\b(?:https?|s3|postgres|postgresql|mysql|amqp|redis)://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*"
        r"|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws\.com|azure\.com|googleapis\.com)\b",
        re.ASCII,
    ),
}
_MIXED = [re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]")]
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` by start, then kind as listed.

    The patterns with a least length find the same as the open ones do with short
    matches dropped: their matches are whole runs. An assignment's isn't, so its
    value is measured afterwards.
    """
    found = []
    if ":" in text or "=" in text:
        found += [
            ("assign", m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _near(span: Span, others: list[Span], starts: list[int], longest: int, reach: int) -> list[Span]:
    """Of ``others``, sorted by start, those whose interval is within ``reach`` of the span."""
    _, start, end = span
    a = bisect_left(starts, start - reach - longest)
    b = bisect_right(starts, end + reach)
    return [o for o in others[a:b] if o[2] >= start - reach]


def linked_spans(text: str, base: list[Span], reach: int | None = 200) -> list[Span]:
    """Weak parts that complete a credential, sorted as spans are.

    A weak secret needs a near identifier (weak, or a base access key) and a near
    endpoint, or a near base access key alone. Parts never reach over a blank line;
    without a ``reach`` all parts up to the next one are near. A weak part that a base
    span covers in part is no candidate, and a part is not near to what it holds itself.
    """
    ids = [("weak_id", *m.span()) for m in WEAK["weak_id"].finditer(text)]
    keys = [s for s in base if s[0] == "access"]
    if not ids and not keys:
        return []
    secrets = [
        ("weak_secret", *m.span())
        for m in WEAK["weak_secret"].finditer(text)
        if all(c.search(m[0]) for c in _MIXED)
    ]
    ends = [("weak_endpoint", *m.span()) for m in WEAK["weak_endpoint"].finditer(text)]
    borders = [m.start() for m in _BLANK_LINE.finditer(text)]
    taken = sorted(base, key=lambda s: s[1])
    taken_starts = [s[1] for s in taken]
    widest = max((s[2] - s[1] for s in taken), default=0)

    def free(span: Span) -> bool:
        return not any(
            o[1] < span[2] and o[2] > span[1] for o in _near(span, taken, taken_starts, widest, 0)
        )

    def scope(span: Span) -> int:
        return bisect_right(borders, span[1])

    parts = {"id": ids, "key": keys, "end": ends}
    order = ["weak_id", "weak_secret", "weak_endpoint"]
    if reach is None:
        found = _linked_in_scopes([s for s in secrets if free(s)], parts, scope)
        found = {s for s in found if s[0] == "weak_secret" or free(s)}
        return sorted(found, key=lambda s: (s[1], order.index(s[0]), s[2]))
    starts = {k: [s[1] for s in v] for k, v in parts.items()}
    wide = {k: max((s[2] - s[1] for s in v), default=0) for k, v in parts.items()}
    found = set()
    for secret in filter(free, secrets):
        near = {
            k: [
                o
                for o in _near(secret, parts[k], starts[k], wide[k], reach)
                if scope(o) == scope(secret) and not (o[1] <= secret[1] and secret[2] <= o[2])
            ]
            for k in parts
        }
        if near["key"] or near["id"] and near["end"]:
            found.add(secret)
            found.update(o for k in ("id", "end") for o in near[k] if free(o))
    return sorted(found, key=lambda s: (s[1], order.index(s[0]), s[2]))


def _linked_in_scopes(
    secrets: list[Span], parts: dict[str, list[Span]], scope: Callable[[Span], int]
) -> set[Span]:
    """Secrets with their counterparts in the same scope, and those counterparts.

    One sweep: parts of a kind are in order and apart, so at most one of them holds a secret.
    """
    present = {k: Counter(map(scope, spans)) for k, spans in parts.items()}
    starts = {k: [s[1] for s in spans] for k, spans in parts.items()}
    found: set[Span] = set()
    linked: Counter = Counter()
    inside: Counter = Counter()
    for secret in secrets:
        where, holders = scope(secret), {}
        for k, spans in parts.items():
            at = bisect_right(starts[k], secret[1]) - 1
            if at >= 0 and spans[at][2] >= secret[2]:
                holders[k] = spans[at]
        near = {k: present[k][where] - (k in holders) for k in parts}
        if near["key"] or near["id"] and near["end"]:
            found.add(secret)
            linked[where] += 1
            inside.update(holders.values())
    # A part that holds all linked secrets of its scope is the counterpart of none.
    found.update(o for k in ("id", "end") for o in parts[k] if linked[scope(o)] > inside[o])
    return found


def _text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(
    docs: DataFrame, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans, base_sha256`` of every row.

    ``base`` and ``spans`` (base and linked ones, by start, then kind) list
    ``kind:start:end`` in code points, end exclusive. Null and empty texts have
    none. Each row is looked at by itself: repeated rows and null ids change nothing.
    """
    kinds = [*KINDS, "weak_id", "weak_secret", "weak_endpoint"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            bases, spans = [], []
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                extra = linked_spans(text, base, reach)
                bases.append(base)
                spans.append(
                    sorted(base + extra, key=lambda s: (s[1], kinds.index(s[0]))) if extra else base
                )
            listed = [_text(b) for b in bases]
            yield {
                "doc_id": batch["doc_id"],
                **{f"n_{k}": [sum(s[0] == k for s in b) for b in bases] for k in KINDS},
                "base": listed,
                "spans": [_text(s) for s in spans],
                "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in listed],
            }

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, base_sha256 string"
    )
    return map_rows(documents(docs, id_col, text_col), run, schema)
