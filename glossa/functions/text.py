"""Text functions as columns: built-in expressions only, so they stay in the JVM."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.splitter import rule_sentences
from glossa.plans.profile import Profile

#: Ends of lines as Python's splitlines has them.
LINE_END = "\\R|[\\u001c-\\u001e]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space as Unicode has it, what (?U)\\s matches.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: str | Column) -> Column:
    """Without white space at both ends, Unicode blanks included. Looks at the ends alone."""
    return F.btrim(col(c), F.lit(SPACE))


def plain_lower(c: str | Column) -> Column:
    """Lower case with ё as е, the form in which lemmas and themes are looked up. (A translation looks each character up; a replacement costs next to nothing where there is none.)"""
    return F.replace(F.lower(col(c)), F.lit("ё"), F.lit("е"))


def matches(c: str | Column, pattern: str, ignore_case: bool = True, first: str | None = None) -> Column:
    """Whether the pattern is found. `.` stops at line feeds only. first: the opening() of what the pattern begins with, where its own text doesn't show it."""
    return col(c).rlike((opening(pattern) if first is None else first) + "(?iud)" + pattern if ignore_case else "(?d)" + pattern)


def alternatives(pattern: str) -> list[str]:
    """The pattern's branches outside of groups and classes."""
    out, depth, kind, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        step = pattern[i : i + 2] if c == "\\" else c
        i += len(step)
        if c == "|" and not depth and not kind:
            out.append("")
            continue
        if kind:
            kind = c != "]"
        else:
            kind, depth = c == "[", depth + (c == "(") - (c == ")")
        out[-1] += step
    return out


def _fold(x: str) -> str:
    """A character's form where case is ignored: the small letter of its capital, one for one."""
    up = x.upper()
    return (up if len(up) == 1 else x).lower()[0]


@cache
def _alike(letter: str) -> str:
    """All characters that count as this one where case is ignored."""
    return "".join(x for x in map(chr, (*range(0xD800), *range(0xE000, 0x10000))) if _fold(x) == _fold(letter))


def opening(pattern: str) -> str:
    """A look at the first letter, to stand before (?iu) and the pattern: most places of a text are passed over by it, where the pattern would be tried by all its branches. Empty where a branch begins with anything but a letter that has to be there. What is matched stays the same."""
    found = ""
    for x in alternatives(pattern):
        if not x[:1].isalpha() or x[0] > "\uffff" or x[1:].startswith(("?", "*", "{")):
            return ""
        found += _alike(x[0])
    return f"(?=[{''.join(sorted(set(found)))}])"


def word(pattern: str, letters: str) -> str:
    """The pattern as whole words. The pattern is looked at before what stands left of it, which is dearer to test and nearly always there."""
    return f"(?=(?:{pattern})(?![{letters}]))(?<![{letters}])"


def ends_word(pattern: str, letters: str) -> str:
    return f"(?:{pattern})(?:$|[^{letters}])"


def sentences(text: str | Column, p: Profile) -> Column:
    """Array of trimmed sentences; empty ones are dropped."""
    if p.sentence_splitter is not None:
        return p.sentence_splitter(col(text))
    if p.split_by_rules:
        return rule_sentences(p)(col(text))
    found = F.transform(F.regexp_extract_all(col(text), F.lit(p.sentence), F.lit(0)), strip)
    return F.filter(found, lambda s: s != "")


def tokens(text: str | Column, p: Profile) -> Column:
    if p.tokenizer is not None:
        return p.tokenizer(col(text))
    return F.regexp_extract_all(col(text), F.lit(p.token), F.lit(0))


def lemma(token: Column, p: Profile) -> Column:
    """The plugged-in analyser's answer; without one a table lookup of the plain lower-case form, else that form."""
    if p.lemmatizer is not None:
        return p.lemmatizer(token)
    form = plain_lower(token)
    if not p.lemmas:
        return form
    return F.coalesce(F.try_element_at(_table(p), form), form)


def _table(p: Profile) -> Column:
    return F.create_map(*[F.lit(x) for k, v in p.lemmas.items() for x in (k, v)])


def lemmas(words: str | Column, p: Profile) -> Column:
    """lemma() of each word, whose plain form is made once."""
    if p.lemmatizer is not None:
        return F.transform(col(words), lambda t: lemma(t, p))
    forms = F.transform(col(words), plain_lower)
    return F.transform(forms, lambda f: F.coalesce(F.try_element_at(_table(p), f), f)) if p.lemmas else forms


def is_heading(line: str | Column, p: Profile) -> Column:
    return matches(strip(line), rf"^(?:{p.heading})\s*[.!?…—-]*\s*$")


def heading_kind(line: str | Column, p: Profile) -> Column:
    low = F.lower(strip(line))
    return reduce(lambda out, x: F.when(low.startswith(x[0]), F.lit(x[1])).otherwise(out), reversed(p.heading_kinds), F.lit("heading"))


def looks_like_direct_speech(sentence: str | Column, p: Profile) -> Column:
    """Both quotation marks, or a leading dash."""
    s = col(sentence)
    return (s.contains(p.quotes[0]) & s.contains(p.quotes[1])) | s.rlike(r"(?U)^\s*[—-]\s+\S")


def contains_any(text: str | Column, variants: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(text).contains(v) for v in variants], F.lit(False))


def proper_names(sentence: str | Column, p: Profile) -> Column:
    """Capitalised words; the first only with a surname's ending or letter."""
    found = F.regexp_extract_all(col(sentence), F.lit(p.capitalised), F.lit(0))
    first = lambda w: w.rlike(f"{p.surname_end}$") | (w.contains(p.surname_letter) if p.surname_letter else F.lit(False))
    return F.filter(found, lambda w, i: (i > 0) | first(w))


def find_name(text: str | Column, p: Profile) -> Column:
    """The first variant, in the order of the list, that stands in the text as a whole word; else the empty string."""
    return F.coalesce(*[F.when(matches(text, word(escape(v), p.name_letters), first=opening(escape(v))), F.lit(v)) for v in p.names], F.lit(""))


def escape(text: str) -> str:
    """Literal text in a pattern of any of the dialects."""
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$-" else c for c in text)


def unique_stems(words: list[str]) -> list[str]:
    """The words that no other one is the beginning of."""
    out: list[str] = []
    for w in sorted(set(words), key=len):
        if not any(w.startswith(x) for x in out):
            out.append(w)
    return out


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage; 0 where there is no whole."""
    return F.coalesce(half_even(part / F.nullif(whole, F.lit(0)) * 100, digits), F.lit(0.0))
