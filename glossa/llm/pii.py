"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs (also written out), schemes, plus signs, digits and identifier cues. Each
anchor hands its place to a local parser that expands it to both sides, character class by character class and without
second tries, and validates what it has found. A parser never looks at characters that an earlier match of its kind
took, and each character is looked at a bounded number of times by each, so a text costs its length.

Base kinds are exactly the leftmost non-overlapping matches of these patterns, without those that fail validation:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)             parts of at most 255
    card   [0-9]([ -]?[0-9])+                               12 to 19 digits with a right check digit
    phone  \\+[0-9][ ().0-9-]+[0-9]                           9 to 15 digits

Kinds that are added, where they don't lie within a base span:

    written  an address whose at-sign or dots are written out: name (at) host (dot) org
    intl     an address with letters beyond ASCII
    address  a URI that leads to a person: mailto:, tel:, sip:, xmpp:, or any scheme with user information
    account  an identifier after a cue: IBAN (checked), social security, account, passport and tax numbers

Defined results: null or empty texts have no spans; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick

Span = tuple[int, int, str]  # start, end, kind

#: The order in which spans that start together are listed.
KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "written": 4, "intl": 5, "address": 6, "account": 7}
BASE = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WIDE = re.compile(r"[^\W_](?:[\w-]*+)(?:\.[\w-]++)++")
WRITTEN = re.compile(r"[\x20]?[A-Za-z0-9-]{1,63}+(?:(?:\.|[\x20]?[(\[](?:dot|DOT|Dot)[)\]][\x20]?)[A-Za-z0-9-]{1,63}+)++")
TELEPHONE = re.compile(r"\+?[0-9][().0-9-]{5,24}")
AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]{1,128}+@[A-Za-z0-9.-]{1,253}+(?::[0-9]{1,5}+)?(?:/[^\s\"'<>]{0,2048})?")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}$")
#: What may stand between a cue and its identifier.
BETWEEN = re.compile(r"[\x20\t]{0,2}(?:(?:no|nr|num|number|id|code)\b\.?)?[\x20\t]{0,2}(?:is\b)?[\x20\t]{0,2}[:#=]{0,2}[\x20\t]{0,2}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SOCIAL = re.compile(r"([0-9]{3})([\x20-]?)([0-9]{2})\2([0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"[A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,19}(?![A-Za-z0-9])")

SCHEMES = ("mailto:", "tel:", "sip:", "xmpp:")
CUES = {"iban": "iban", "ssn": "social", "social security": "social", "account": "account", "acct": "account", "passport": "account", "tax id": "account", "taxpayer": "account"}


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors: what each is, and its length. Words are found in lower case, capitalised and in capitals."""
    found: dict[str, str] = {"@": "at", "://": "scheme", "+": "plus", "(at)": "spelt", "[at]": "spelt", "(AT)": "spelt", "[AT]": "spelt"}
    found |= {str(d): "digit" for d in range(10)}
    for word, kind in [*((s, "direct") for s in SCHEMES), *CUES.items()]:
        found |= dict.fromkeys((word, word.capitalize(), word.title(), word.upper()), kind)
    out = ahocorasick.Automaton()
    for word, kind in found.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits leave 1 modulo 97."""
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _byte(part: str) -> bool:
    """Whether a decimal number, however long, is at most 255."""
    short = part.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def _left(text: str, at: int, least: int, good) -> int:
    """The start of the run of good characters that ends before `at`, from `least` on."""
    while at > least and good(text[at - 1]):
        at -= 1
    return at


def _word(c: str) -> bool:
    return c.isalnum() or c in "_.%+-"


class _Parsers:
    """The local parsers over one text. Each of them remembers the end of what it has taken."""

    def __init__(self, text: str):
        self.text = text
        self.base: list[Span] = []
        self.more: list[Span] = []
        self.email_end = self.phone_end = self.chain_end = self.number_end = self.wide_end = 0

    def email(self, at: int) -> None:
        text = self.text
        start = _left(text, at, self.email_end, LOCAL.__contains__)
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            self.email_end = found.end()
            self.base.append((start, found.end(), "email"))
        if not text.isascii():
            self.wide(at)

    def wide(self, at: int) -> None:
        """An address in letters of any script, if some are beyond ASCII."""
        start = _left(self.text, at, self.wide_end, _word)
        found = WIDE.match(self.text, at + 1) if start < at else None
        if found:
            self.wide_end = end = found.end()
            if not self.text[start:end].isascii():
                self.more.append((start, end, "intl"))

    def phone(self, at: int) -> None:
        found = PHONE.match(self.text, at)
        if found and 9 <= sum(map(str.isdigit, found.group())) <= 15:
            self.base.append((at, found.end(), "phone"))

    def number(self, at: int) -> None:
        """A digit begins a chain of digits with single blanks or hyphens between, and one of numbers with single dots between."""
        text = self.text
        if at >= self.chain_end:
            self.chain_end = end = DIGITS.match(text, at).end()
            if 12 <= end - at <= 2 * 19:  # no more characters hold so few digits
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self.base.append((at, end, "card"))
        if at >= self.number_end:
            self.number_end = end = NUMBERS.match(text, at).end()
            if end - at >= 7:
                parts, start = text[at:end].split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = start + sum(map(len, four)) + 3
                    if all(map(_byte, four)):
                        self.base.append((start, stop, "ip"))
                    start = stop + 1

    def spelt(self, at: int, end: int) -> None:
        """A name before a written at-sign, and labels after it."""
        text = self.text
        before = at - 1 if at and text[at - 1] == " " else at
        start = _left(text, before, max(0, before - 64), LOCAL.__contains__)
        found = WRITTEN.match(text, end)
        if start < before and found:
            self.more.append((start, found.end(), "written"))

    def direct(self, at: int, end: int) -> None:
        """What follows a scheme that leads to a person."""
        if at and self.text[at - 1].isalnum():
            return
        found = TELEPHONE.match(self.text, end) if self.text[at] in "tT" else AUTHORITY.match(self.text, end)
        if found:
            self.more.append((at, found.end(), "address"))

    def scheme(self, at: int, end: int) -> None:
        """A URI with user information."""
        found = AUTHORITY.match(self.text, end)
        name = SCHEME.search(self.text[max(0, at - 16) : at]) if found else None
        if name:
            self.more.append((at - len(name.group()), found.end(), "address"))

    def account(self, kind: str, at: int, end: int) -> None:
        """The identifier after a cue that is a word."""
        text = self.text
        if at and text[at - 1].isalnum() or text[end : end + 1].isalpha():
            return
        start = BETWEEN.match(text, end).end()
        if start == end:
            return
        if kind == "iban":
            found = IBAN.match(text, start)
            good = found and iban(found.group())
        elif kind == "social":
            found = SOCIAL.match(text, start)
            good = found and found[1] not in ("000", "666") and found[1][0] != "9" and found[3] != "00" and found[4] != "0000"
        else:
            found = ACCOUNT.match(text, start)
            good = found is not None
        if good:
            self.more.append((start, found.end(), "account"))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and those that the method adds, by (start, kind)."""
    p = _Parsers(text)
    for last, (kind, size) in anchors().iter(text):
        at, end = last + 1 - size, last + 1
        if kind == "digit":
            p.number(at)
        elif kind == "at":
            p.email(at)
        elif kind == "plus":
            p.phone(at)
        elif kind == "spelt":
            p.spelt(at, end)
        elif kind == "direct":
            p.direct(at, end)
        elif kind == "scheme":
            p.scheme(at, end)
        else:
            p.account(kind, at, end)
    if not p.base and not p.more:
        return [], []
    place = lambda s: (s[0], KINDS[s[2]], s[1])
    base = sorted(p.base, key=place)
    return base, sorted(base + _outside(base, p.more), key=place)


def _outside(base: list[Span], more: list[Span]) -> list[Span]:
    """Different spans of `more` that don't lie within a base one. Of base spans that start at or before a span, the furthest end decides."""
    out, i, far = [], 0, 0
    for s in sorted(set(more)):
        while i < len(base) and base[i][0] <= s[0]:
            far = max(far, base[i][1])
            i += 1
        if s[1] > far:
            out.append(s)
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each maximal covered run replaced by the kind of its first span, as [KIND]."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS[s[2]])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
