"""Secret scans with multipart credential linking.

Base kinds (always reported): assign, access, hex. Weak kinds are reported only when complementary parts co-occur in
one scope: `keyid` (a mixed-class token that may be a secret key) next to an access identifier or an endpoint, and
`endpoint` (a URL with a host) next to an access identifier or a keyid that itself is linked to one.

Linking is an interval join: each part spans its scope (a run of lines without a blank line), which Limits.reach cuts
to [start - reach, end + reach) unless it is None; a part links to what meets this interval, which isn't widened itself.
Both sides are sorted by start and searched, so a text with n parts costs n log n, and no pairs are emitted. The op9
query and the pipeline link across whole scopes (WHOLE).

Defined results: null or empty texts have no spans; overlapping weak and base spans leave only the base one; all
offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

Span = tuple[int, int, str]  # start, end, kind

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more: what `[0-9a-f]+` matches and is long enough
KEYWORDS = ("passw", "secret", "token", "api")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
BLANK = re.compile(r"\n[^\S\n]*\n")
#: The order in which spans that start together are listed.
KINDS = {"assign": 0, "access": 1, "hex": 2, "keyid": 3, "endpoint": 4}


@dataclass(frozen=True)
class Limits:
    assign: int = 8
    access: int = 16
    reach: int | None = 200


WHOLE = Limits(reach=None)


def base_spans(text: str, limits: Limits = Limits()) -> list[Span]:
    """assign, access and hex matches, leftmost and non-overlapping within a kind, in the order (start, kind)."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= limits.assign]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= limits.access]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class _Scopes:
    """Scope number of an offset, and the scope's limits."""

    def __init__(self, text: str):
        self.cuts = [m.start() for m in BLANK.finditer(text)]
        self.size = len(text)

    def around(self, span: Span, reach: int | None) -> tuple[int, int]:
        i = bisect_right(self.cuts, span[0])
        low = self.cuts[i - 1] if i else 0
        high = self.cuts[i] if i < len(self.cuts) else self.size
        high = max(high, span[1])
        return (low, high) if reach is None else (max(low, span[0] - reach), min(high, span[1] + reach))


def _furthest(spans: list[Span]) -> list[int]:
    """The largest end of each span and those before it."""
    return list(accumulate((s[1] for s in spans), max))


def _meets(span: Span, starts: list[int], furthest: list[int]) -> bool:
    """Whether a span overlaps one of those with these starts, in order, and these largest ends so far."""
    i = bisect_left(starts, span[1])
    return i > 0 and furthest[i - 1] > span[0]


def _linked(parts: list[Span], others: list[Span], scopes: _Scopes, reach: int | None) -> list[Span]:
    """The parts whose scope, as far as the reach, meets one of the others; others are sorted by start."""
    starts, furthest = [o[0] for o in others], _furthest(others)
    out = []
    for p in parts:
        low, high = scopes.around(p, reach)
        if _meets((low, high, ""), starts, furthest):
            out.append(p)
    return out


def linked_spans(text: str, base: list[Span], limits: Limits = Limits()) -> list[Span]:
    """Weak candidates with a complementary part in their scope and reach."""
    access = [s for s in base if s[2] == "access"]
    endpoints = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not access and not endpoints:
        return []
    taken = sorted(base + endpoints)
    starts, furthest = [s[0] for s in taken], _furthest(taken)
    base_starts, base_furthest = [s[0] for s in base], _furthest(base)
    tokens = [(m.start(), m.end(), "keyid") for m in TOKEN.finditer(text) if _mixed(m.group())]
    weak = [t for t in tokens if not _meets(t, starts, furthest)]
    scopes = _Scopes(text)
    keys = _linked(weak, sorted(access + endpoints), scopes, limits.reach)
    secrets = [s for s in base if s[2] != "hex"] + _linked(keys, access, scopes, limits.reach)
    hosts = _linked(endpoints, sorted(secrets), scopes, limits.reach)
    return keys + [e for e in hosts if not _meets(e, base_starts, base_furthest)]


def scan(text: str, limits: Limits = Limits()) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones with the linked weak ones, by (start, kind)."""
    base = base_spans(text, limits)
    return base, sorted(base + linked_spans(text, base, limits), key=lambda s: (s[0], KINDS[s[2]]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each maximal covered run replaced by the kind of its first span, as [KIND]."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
