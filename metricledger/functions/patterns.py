"""Whether a matcher's regular expression is valid, and whether it matches the empty text, as Catalyst expressions.

``empty_match(pattern)`` is ``e`` for a pattern that matches the empty text, ``a`` for one that does not, ``!`` for one that
is none. The pattern is cut into tokens, each token becomes a letter (``a`` takes a character, ``e`` takes none, ``*`` and ``+``
repeat from none or from one, brackets and ``|`` stand for themselves), and all innermost groups are folded into one letter at once,
level by level.

The syntax is RE2's. Names of Unicode classes are not looked up, and names of groups may repeat. A null pattern gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import bind

# ---- fixed values: RE2 syntax -----------------------------------------------------------
MOST_REPEATS = 1_000
DEEPEST = 1_000
_POSIX = "alnum|alpha|ascii|blank|cntrl|digit|graph|lower|print|punct|space|upper|word|xdigit"
_CODES = r"x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]++\}|0[0-7]{0,2}|[1-7][0-7]{1,2}"
_CLASS_ESCAPE = rf"\\(?:{_CODES}|[pP](?:\{{\^?[A-Za-z_]++\}}|[A-Z])|[dDsSwWafnrtv]|[^A-Za-z0-9\x80-\x{{10FFFF}}])"
_FLAGS = r"(?:[imsU]++(?:-[imsU]++)?|-[imsU]++)"
# ---------------------------------------------------------------------------------------

_CLASS = rf"\[\^?+\]?+(?:{_CLASS_ESCAPE}|\[:\^?(?:{_POSIX}):\]|(?!\[:\^?\w*+:\])[^\]\\])*+\]"
_REPEAT = r"\{\d++(?:,\d*+)?\}"
_TOKEN = rf"(?s)\\Q.*?(?:\\E|$)|{_CLASS}|\\[AzBb]|{_CLASS_ESCAPE}|\\.?|\(\?{_FLAGS}\)|\(\?{_FLAGS}?:|\(\?P?<\w++>|\(\??|(?:[*+?]|{_REPEAT})\??|."
_SPECIAL = r"[\\.+*?()|\[\]{}^$]"


def empty_match(pattern: Column) -> Column:
    plain = F.when(pattern == "", F.lit("e")).otherwise(F.lit("a"))
    return F.when(pattern.rlike(_SPECIAL), bind(_letters(pattern), _folded)).when(pattern.isNotNull(), plain)


def _letters(pattern: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(0)), _letter), "")


def _letter(t: Column) -> Column:
    quoted = F.regexp_extract(t, r"(?s)^\\Q(.*?)(?:\\E)?$", 1)
    return (
        F.when(t.startswith("\\Q"), F.when(F.length(quoted) > 1, F.lit("aa")).when(F.length(quoted) == 1, F.lit("a")).otherwise(F.lit("")))
        .when(t.isin("^", "$", r"\A", r"\z", r"\B"), F.lit("e"))  # these hold in an empty text, a word boundary does not
        .when(t.rlike(rf"^(?:\\[b]|{_CLASS_ESCAPE})$"), F.lit("a"))
        .when((t == "[") | t.startswith("\\"), F.lit("!"))
        .when(t.startswith("["), F.when(_ranges_fall(t), F.lit("!")).otherwise(F.lit("a")))
        .when(t.rlike(rf"^\(\?{_FLAGS}\)$"), F.lit(""))
        .when(t == "(?", F.lit("!"))
        .when(t.startswith("("), F.lit("("))
        .when(t.isin(")", "|"), t)
        .when(t.rlike(r"^[*?]\??$"), F.lit("*"))
        .when(t.rlike(r"^\+\??$"), F.lit("+"))
        .when(t.rlike(rf"^{_REPEAT}\??$"), _repeat(t))
        .otherwise(F.lit("a"))
    )


def _ranges_fall(group: Column) -> Column:
    """A range in brackets runs from a later character to an earlier one. Only ranges between plain characters are looked at."""
    inside = F.regexp_replace(group, rf"^\[\^?|{_CLASS_ESCAPE}|\[:\^?\w*+:\]", "")
    ranges = F.regexp_extract_all(inside, F.lit(r"(?s)[^\]]-[^\]]"), F.lit(0))
    return F.exists(ranges, lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)))


def _repeat(t: Column) -> Column:
    least = F.regexp_extract(t, r"^\{(\d+)", 1).try_cast("int")
    most = F.regexp_extract(t, r"^\{\d+,(\d+)", 1)
    most = F.when(most == "", least).otherwise(most.try_cast("int"))
    fits = F.coalesce((least <= MOST_REPEATS) & (most <= MOST_REPEATS) & (least <= most), F.lit(False))
    return F.when(~fits, F.lit("!")).when(least == 0, F.lit("*")).otherwise(F.lit("+"))


def _folded(letters: Column) -> Column:
    broken = letters.contains("!") | letters.rlike(r"(?:^|[(|])[*+]|[*+][*+]")  # nothing to repeat, or repeated twice
    depth = F.length(letters) - F.length(F.replace(letters, F.lit("("), F.lit("")))
    whole = F.concat(F.lit("("), letters, F.lit(")"))
    levels = F.sequence(F.lit(0), F.least(depth, F.lit(DEEPEST)))
    result = F.aggregate(levels, whole, lambda s, _: F.when(s.contains("("), _one_level(s)).otherwise(s))
    return F.when(broken, F.lit("!")).otherwise(bind(result, lambda r: F.when(r.isin("a", "e"), r).otherwise(F.lit("!"))))


def _one_level(s: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(s, r"[ae]\*", "e"), r"([ae])\+", "$1")
    s = F.regexp_replace(s, r"\((?:[ae|]*\|)?e*+(?:\|[ae|]*+)?\)", "E")  # one of the branches takes nothing
    return F.replace(F.regexp_replace(s, r"\([ae|]++\)", "a"), F.lit("E"), F.lit("e"))  # E: the group around it waits for the next level
