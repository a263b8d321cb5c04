"""Sentences by rules: each run of end marks is a place where a sentence may end, judged by what stands left and right of it.

A text is cut into pieces behind end marks (with closing quotes and brackets, and the blanks after them). The place
behind a piece is no end, by the first rule that holds:

    glued         no blank follows (3.14, www.host.org)
    paragraph     an empty line follows: it is an end
    small         what follows begins with a small letter, quotes, brackets and dashes aside
    mark          what follows begins with a comma, semicolon, colon or closing mark
    bullet        the piece is nothing but a number, a Roman number or a letter and its stop
    abbreviation  the piece ends with an abbreviation and its stop
    initial       the piece ends with a capital letter and its stop, and a capital letter follows

Every rule looks at two neighbouring pieces alone, so a text costs its length however long it is. All steps are built-in
expressions. Pieces put together are the text, so places of sentences are running lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.plans.profile import Profile

BLANKS = " \t\r\n\f\x0b "
END, CLOSING, OPENING = ".!?…", "»\"”’)\\]", "«\"“„‘(\\[—–\\-"
PIECE = f"[^{END}]*[{END}]+[{CLOSING}]*[{BLANKS}]*|[^{END}]+$"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _trim_right(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def patterns(p: Profile) -> dict[str, str]:
    """The rules' patterns: left ones for a piece without the blanks at its end, right ones for the next piece."""
    capital, before = p.upper, f"(?:^|[^{p.letters}])"
    return {
        "small": f"^[{OPENING}{BLANKS}]*[{p.lower}]",
        "mark": "^[,;:»”’)\\]]",
        "bullet": f"^[{BLANKS}]*(?:[0-9]{{1,3}}|[IVXLCDM]{{1,6}}|[{p.lower}{capital}])[.]\\z",
        "abbreviation": f"{before}(?:{'|'.join(p.abbreviations)})[.]\\z" if p.abbreviations else "",
        "initial": f"{before}[{capital}][.]\\z",
        "capital": f"^[{capital}]",
    }


def _tail(body: Column, longest: int) -> Column:
    """The end of a piece that a word of at most so many letters, its stop and what stands before it fill: cut off, it is longer than a word and its stop, so `^` finds none in it that the whole piece doesn't have."""
    return F.substring(body, -(longest + 2), longest + 2)


def ends_after(piece: Column, following: Column, p: Profile) -> Column:
    """Whether a sentence ends behind `piece`; following: the next one, null behind the last."""
    rules = patterns(p)
    longest = max(map(len, p.abbreviations), default=0)

    def judged(body: Column) -> Column:
        stop = body.endswith(".")
        gap = F.substring(piece, F.length(body) + 1, F.length(piece))
        return (
            F.when(following.isNull(), True).when(gap == "", False).when(gap.rlike(f"\n[{BLANKS}]*\n"), True).when(following.rlike(rules["small"]), False).when(following.rlike(rules["mark"]), False)
            .when(~stop, True).when(body.rlike(rules["bullet"]), False).when(_tail(body, longest).rlike("(?iu)" + rules["abbreviation"]) if rules["abbreviation"] else F.lit(False), False)
            .when(_tail(body, 1).rlike(rules["initial"]) & following.rlike(rules["capital"]), False)
            .otherwise(True)
        )

    return _let(_trim_right(piece), judged)


def raw_sentences(text: Column, p: Profile) -> Column:
    """The sentences of a text with all blanks: put together they are the text. Null has none."""

    def whole(pieces: Column) -> Column:
        places = F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces))).otherwise(F.array().cast("array<int>"))
        ends = F.filter(places, lambda i: ends_after(F.element_at(pieces, i), F.try_element_at(pieces, i + 1), p))

        def cut(ends: Column) -> Column:
            before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(ends, k))
            return F.transform(ends, lambda e, k: F.array_join(F.slice(pieces, before(k) + 1, e - before(k)), ""))

        return _let(ends, cut)

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), whole)


def trimmed(sentence: Column) -> Column:
    return F.btrim(sentence, F.lit(BLANKS))


def rule_sentences(p: Profile) -> Callable[[Column], Column]:
    """A splitter for Profile.sentence_splitter: trimmed sentences, blank ones dropped."""
    return lambda text: F.filter(F.transform(raw_sentences(text, p), trimmed), lambda s: s != "")
