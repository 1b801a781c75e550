"""PromQL expression identity as Catalyst expressions.

``describe(col)`` turns an expression text into one struct
``(canonical, canonical_any_range, matchers)``; the public functions pick from it. Nothing
here is a UDF: the text is cut into tokens with ``regexp_extract_all`` and folded with
array functions, innermost parenthesis first. The work is per distinct text, so callers run
it on a dictionary of distinct texts (:mod:`metricledger.operators.enrich`) and join back.

Intermediate form: tokens separated by single spaces, where a selector, list, string or
folded group is a mark ``⟨kind index:types⟩`` (``v`` selector, ``g`` by/without, ``o``
on/ignoring, ``j`` group_left/right, ``s`` string, ``p`` folded group). Marks hold no PromQL
characters, so a quoted ``}`` or ``,`` can never split anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import bind, split_at, split_keep
from metricledger.functions.patterns import empty_match

# ---- fixed values: PromQL vocabulary -------------------------------------------------
GROUPING_WORDS = ("by", "without")
MATCHING_WORDS = ("on", "ignoring")
JOIN_WORDS = ("group_left", "group_right")
SET_OPERATORS = ("and", "or", "unless")
OTHER_WORDS = ("atan2", "bool", "offset", "inf", "nan")
AGGREGATORS = {
    "V": ("sum", "avg", "count", "min", "max", "group", "stddev", "stdvar"),
    "NV": ("topk", "bottomk", "quantile"),
    "SV": ("count_values",),
}
# Argument types of every function: V instant vector, M range vector, N scalar, S string.
VECTOR_FUNCTIONS = {
    "V": (
        "abs absent ceil exp floor ln log10 log2 sgn sqrt sort sort_desc timestamp "
        "acos acosh asin asinh atan atanh cos cosh sin sinh tan tanh deg rad "
        "histogram_avg histogram_count histogram_sum histogram_stddev histogram_stdvar"
    ),
    "M": (
        "rate irate increase delta idelta deriv changes resets absent_over_time avg_over_time "
        "count_over_time last_over_time max_over_time min_over_time present_over_time "
        "stddev_over_time stdvar_over_time sum_over_time"
    ),
    "V?": "day_of_month day_of_week day_of_year days_in_month hour minute month year",
    "N": "vector",
    "VN": "clamp_max clamp_min",
    "VNN": "clamp",
    "VN?": "round",
    "NV": "histogram_quantile",
    "NNV": "histogram_fraction",
    "NM": "quantile_over_time",
    "MN": "predict_linear",
    "VSSS*": "label_join",
    "VSSSS": "label_replace",
}
SCALAR_FUNCTIONS = {"V": "scalar", "": "time pi"}
MASK = "MASKED"
# ---------------------------------------------------------------------------------------

# Repeated groups are possessive throughout: a plain one recurses once per repetition, and a long
# label value would overflow the stack of the task.
_STRING = r'"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\'|`[^`]*+`'
_DURATION = r"(?:\d++(?:ms|[smhdwy]))++"
_DIGITS = r"\d(?:_?\d)*+"
_NUMBER = rf"0[xX](?:_?[0-9a-fA-F])++|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?\d+)?"
_NAME = r"(?:[A-Za-z_]|:(?=[A-Za-z_:]))[A-Za-z0-9_:]*"
_LABEL = r"[A-Za-z_][A-Za-z0-9_]*"
_MATCH_OP = r"(?:=~|!~|!=|=)"
_TOKEN = (
    rf"#[^\n]*|{_STRING}|{_DURATION}(?![A-Za-z0-9_])|(?:{_NUMBER})(?![A-Za-z0-9_])|{_NAME}"
    r"|=~|!~|!=|==|<=|>=|[-+*/%^(){}\[\],@:<>=]|\S"
)
_STRAY = r"(?<![^ ])[^A-Za-z0-9_:\-+*/%^(){}\[\],@<>= ](?![^ ])"
_LIST_WORDS = "|".join(GROUPING_WORDS + MATCHING_WORDS + JOIN_WORDS)
_ALL_AGGREGATORS = "|".join(name for names in AGGREGATORS.values() for name in names)
_KEYWORDS = "|".join(SET_OPERATORS + OTHER_WORDS) + "|" + _LIST_WORDS
_NUMBER_WORD = r"(?:[iI][nN][fF]|[nN][aA][nN])"

# One left-to-right pass finds lists and selectors. A bare name is a selector unless it is a
# keyword or is called.
_LIST = rf"(?:{'|'.join(GROUPING_WORDS + MATCHING_WORDS)}) \( [^()]*\)|(?:{'|'.join(JOIN_WORDS)})(?![A-Za-z0-9_:])(?: \( [^()]*\))?"
_BRACES = r"\{ [^{}]*\}"
_SELECTOR = (
    rf"(?!(?:{_KEYWORDS}|{_NUMBER_WORD})(?![A-Za-z0-9_:])){_NAME}(?![A-Za-z0-9_:])(?! \(| ⟨)(?: {_BRACES})?|{_BRACES}"
)
_LIST_OR_SELECTOR = rf"(?<![^ ])(?:{_LIST})|(?<![^ ])(?!(?:{_ALL_AGGREGATORS})(?: \(| (?:by|without) \())(?:{_SELECTOR})"

_UNIT_MS = {
    "y": 31_536_000_000,
    "w": 604_800_000,
    "d": 86_400_000,
    "h": 3_600_000,
    "m": 60_000,
    "s": 1_000,
    "ms": 1,
}


def _matches(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def _is_string(token: Column) -> Column:
    return F.substring(token, 1, 1).isin('"', "'", "`") & (F.length(token) > 1)


# Escapes of one letter.
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_PIECE = r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{3}|.)|[^\\]+"


def _unquote(token: Column) -> Column:
    """The text a quoted token stands for: one-letter, hexadecimal, octal and code point escapes."""

    def piece(x: Column) -> Column:
        digits = F.substring(x, F.lit(3), F.length(x))
        out = F.when(~x.startswith("\\"), x)
        for letter, char in _ESCAPES.items():
            out = out.when(x == f"\\{letter}", F.lit(char))
        out = out.when(x.rlike(r"^\\[xuU].+"), _character(F.conv(digits, 16, 10)))
        out = out.when(x.rlike(r"^\\[0-7]{3}"), _character(F.conv(F.substring(x, F.lit(2), F.length(x)), 8, 10)))
        return out.otherwise(F.substring(x, F.lit(2), F.length(x)))

    def text(t: Column) -> Column:
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        pieces = F.transform(F.regexp_extract_all(inner, F.lit(f"(?s){_PIECE}"), F.lit(0)), piece)
        return F.when(t.contains("\\") & ~t.startswith("`"), F.array_join(pieces, "")).otherwise(inner)

    return bind(token, text)


def _character(code: Column) -> Column:
    """The character of a code point given as decimal text."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 8, "0")), "UTF-32")


def _quote(text: Column) -> Column:
    for char, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _print_duration(token: Column) -> Column:
    """One spelling per length: ``90m`` and ``1h30m`` print alike.

    Whole years, else whole weeks, print as one unit; the rest is split into days and below.
    """
    size = F.create_map(*[F.lit(x) for item in _UNIT_MS.items() for x in item])
    total = F.aggregate(
        F.regexp_extract_all(token, F.lit(r"\d+(?:ms|[smhdwy])"), F.lit(0)),
        F.lit(0).cast("long"),
        lambda acc, part: acc
        + F.regexp_extract(part, r"^\d+", 0).cast("long") * size[F.regexp_extract(part, r"\D+$", 0)].cast("long"),
    )

    def spell(ms: Column) -> Column:
        def piece(unit: str, within: str | None) -> Column:
            rest = ms % _UNIT_MS[within] if within else ms
            count = F.floor(rest / _UNIT_MS[unit])
            return F.when(count > 0, F.concat(count.cast("string"), F.lit(unit))).otherwise(F.lit(""))

        return (
            F.when(ms == 0, F.lit("0s"))
            .when(ms % _UNIT_MS["y"] == 0, piece("y", None))
            .when(ms % _UNIT_MS["w"] == 0, piece("w", None))
            .otherwise(
                F.concat(piece("d", None), piece("h", "d"), piece("m", "h"), piece("s", "m"), piece("ms", "s"))
            )
        )

    return bind(total, spell)


def _print_number(token: Column) -> Column:
    digits = F.replace(token, F.lit("_"), F.lit(""))
    hexa = F.conv(F.regexp_replace(digits, "^0[xX]", ""), 16, 10)
    value = F.when(_matches(token, "^0[xX]"), hexa).otherwise(digits)
    return F.regexp_replace(value.try_cast("double").cast("string"), r"\.0$", "")


def _tokens(text: Column) -> Column:
    raw = F.filter(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("#")
    )

    def tidy(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            after = F.get(tokens, i + 1)
            in_range = before.isin("[", "offset") | ((before == ":") & after.isin("]"))
            seconds = F.when(_matches(t, r"^\d+$"), F.concat(t, F.lit("s"))).otherwise(t)
            lowered = F.lower(t)
            word = lowered.isin(*f"{_KEYWORDS}|{_ALL_AGGREGATORS}".split("|")) & ~F.coalesce(
                after.isin("=", "!=", "=~", "!~", "{"), F.lit(False)
            )
            figure = (
                F.when(_matches(t, rf"^{_DURATION}$") | (in_range & _matches(t, r"^\d+$")), _print_duration(seconds))
                .when(_matches(t, rf"^(?:{_NUMBER})$"), _print_number(t))
                .otherwise(t)
            )
            return F.when(F.substring(t, 1, 1).between(".", "9"), figure).when(word, lowered).otherwise(t)

        return F.transform(tokens, one)

    def without_plus_signs(tokens: Column) -> Column:
        """``+1`` is the number 1; a sign follows nothing, an opening or an operator."""

        def keep(t: Column, i: Column) -> Column:
            before = F.coalesce(F.get(tokens, i - 1), F.lit("("))
            sign = _matches(before, rf"^(?:[-+*/%^(,<>]|==|!=|<=|>=|{'|'.join(SET_OPERATORS)}|bool|atan2)$")
            number = _matches(F.coalesce(F.get(tokens, i + 1), F.lit("")), rf"^(?:\d.*|{_NUMBER_WORD})$")
            return ~((t == "+") & sign & number)

        return F.filter(tokens, keep)

    return bind(bind(raw, tidy), without_plus_signs)


def _join_tokens(tokens: Column) -> Column:
    """One text with single spaces; strings become marks that point back at their token."""

    def mark(t: Column, i: Column) -> Column:
        return F.when(_is_string(t), F.concat(F.lit("⟨s"), i.cast("string"), F.lit("⟩"))).otherwise(t)

    return F.array_join(F.transform(tokens, mark), " ")


def _list_items(inside: Column) -> Column:
    items = F.transform(F.split(inside, ","), lambda x: F.trim(x))
    return F.array_sort(F.filter(items, lambda x: x != ""))


def _string_at(mark: Column, tokens: Column) -> Column:
    return F.get(tokens, F.when(mark.startswith("⟨s"), F.substring(mark, F.lit(3), F.length(mark) - 3)).try_cast("int"))


def _name_of(segment: Column) -> Column:
    return F.when(segment.startswith("{"), F.lit("")).otherwise(F.substring_index(segment, " ", 1))


def _inside_of(segment: Column) -> Column:
    return F.when(segment.contains("{ "), F.substring_index(F.substring_index(segment, "{ ", -1), "}", 1)).otherwise(F.lit(""))


def _selector_parts(segment: Column, tokens: Column) -> Column:
    """Matchers of one selector, in text order: array<struct<label, op, value, bare, empty>>.

    ``empty`` tells whether the value or pattern matches the empty text (``e``), does not (``a``), or is no pattern (``!``).
    """

    def matcher(words: Column) -> Column:
        """``label op value``, or the value alone. What has another shape is refused by :func:`_selector_ok`."""
        label, bare = F.get(words, F.lit(0)), F.size(words) == 1
        quoted = F.when(label.startswith("⟨s"), _unquote(_string_at(label, tokens))).otherwise(label)
        text = F.coalesce(_unquote(_string_at(F.element_at(words, -1), tokens)), F.lit(""))

        def with_value(value: Column, op: Column) -> Column:
            return F.struct(
                F.when(bare, F.lit("__name__")).otherwise(quoted).alias("label"),
                F.when(bare, F.lit("=")).otherwise(op).alias("op"),
                value.alias("value"),
                bare.alias("bare"),
                F.when(op.isin("=~", "!~"), empty_match(value)).when(value == "", F.lit("e")).otherwise(F.lit("a")).alias("empty"),
            )

        return bind(text, lambda value: with_value(value, F.coalesce(F.get(words, F.lit(1)), F.lit(""))))

    def matchers(name: Column) -> Column:
        named = F.when(
            name != "",
            F.array(
                F.struct(
                    F.lit("__name__").alias("label"), F.lit("=").alias("op"), name.alias("value"), F.lit(True).alias("bare"), F.lit("a").alias("empty")
                )
            ),
        ).otherwise(F.array().cast("array<struct<label:string,op:string,value:string,bare:boolean,empty:string>>"))
        return F.when(segment.contains("{ "), F.concat(F.transform(F.transform(items, lambda x: F.split(x, " ")), matcher), named)).otherwise(named)

    items = F.filter(F.transform(F.split(_inside_of(segment), ","), lambda x: F.trim(x)), lambda x: x != "")
    return bind(_name_of(segment), matchers)


def _selector_ok(segment: Column, matchers: Column) -> Column:
    item = rf"(?:(?:{_LABEL}|⟨s\d+⟩) {_MATCH_OP} ⟨s\d+⟩|⟨s\d+⟩)"
    shaped = ~segment.contains("{ ") | _matches(F.trim(_inside_of(segment)), rf"^(?:{item}(?: , {item})*+(?: ,)?)?$")
    twice = bind(
        F.size(F.filter(matchers, lambda m: m.bare)),
        lambda names: (names > 1) | ((names == 1) & F.exists(matchers, lambda m: (m.label == "__name__") & (m.op == "=") & ~m.bare)),
    )
    # At least one matcher has to exclude the empty string.
    selective = F.exists(matchers, lambda m: (m.empty == "a") == m.op.isin("=", "=~"))
    patterns = F.forall(matchers, lambda m: m.empty != "!")
    return shaped & ~twice & selective & patterns


def _selector_text(segment: Column, matchers: Column) -> Column:
    def show(m: Column) -> Column:
        value = F.when(m.label == "__name__", _quote(m.value)).otherwise(F.lit(f'"{MASK}"'))
        label = F.when(_matches(m.label, rf"^{_LABEL}$"), m.label).otherwise(_quote(m.label))
        return F.when(m.bare, _quote(m.value)).otherwise(F.concat(label, m.op, value))

    def with_name(name: Column) -> Column:
        shown = F.filter(matchers, lambda m: ~(m.bare & (m.value == name)))
        inside = F.array_join(F.array_sort(F.transform(shown, show)), ",")
        return bind(inside, lambda x: F.concat(name, F.when(x != "", F.concat(F.lit("{"), x, F.lit("}"))).otherwise(F.lit(""))))

    return F.when(segment.contains("{ "), bind(_name_of(segment), with_name)).otherwise(segment)


def _selector_map(matchers: Column) -> Column:
    """label -> value; a repeated label keeps its last value."""
    last = F.filter(
        matchers,
        lambda m, i: ~F.exists(
            F.slice(matchers, i + 2, F.greatest(F.size(matchers), F.lit(1))), lambda later: later.label == m.label
        ),
    )
    return F.map_from_entries(F.transform(last, lambda m: F.struct(m.label.alias("key"), m.value.alias("value"))))


def _list_text(segment: Column, tokens: Column) -> Column:
    word = F.regexp_extract(segment, rf"^({_LIST_WORDS})", 1)
    items = F.transform(
        _list_items(F.regexp_extract(segment, r"\( ([^()]*)\)", 1)),
        lambda x: F.when(x.startswith("⟨s"), _quote(_unquote(_string_at(x, tokens)))).otherwise(x),
    )
    text = F.concat(word, F.lit(" ("), F.array_join(items, ", "), F.lit(")"))
    return F.when((F.size(items) == 0) & word.isin("by", "ignoring"), F.lit("")).otherwise(text)


def _list_ok(segment: Column) -> Column:
    item = rf"(?:{_LABEL}|⟨s\d+⟩)"
    inside = F.trim(F.regexp_extract(segment, r"\( ([^()]*)\)", 1))
    return _matches(inside, rf"^(?:{item}(?: , {item})*+(?: ,)?)?$")


def _is_list(segment: Column) -> Column:
    return _matches(segment, rf"^(?:{_LIST_WORDS})(?: \(|$)")


def _segment_kind(segment: Column) -> Column:
    word = F.substring_index(segment, " ", 1)
    return (
        F.when(~word.isin(*GROUPING_WORDS, *MATCHING_WORDS, *JOIN_WORDS) | ~_is_list(segment), F.lit("v"))
        .when(word.isin(*GROUPING_WORDS), F.lit("g"))
        .when(word.isin(*MATCHING_WORDS), F.lit("o"))
        .otherwise(F.lit("j"))
    )


# ---- types of a flat (parenthesis-free) piece -------------------------------------------
def _call(names: str, signature: str) -> str:
    return rf"(?:{'|'.join(names.split())}) ⟨p\d+:{signature}⟩"


_OFFSET = rf" offset (?:[-+] )?(?:{_DURATION})"
_AT = r" @ (?:[-+] )?(?:\d[\w.]*|(?:start|end) ⟨p\d+:⟩)"
_MODIFIERS = rf"(?:{_OFFSET}(?:{_AT})?|{_AT}(?:{_OFFSET})?)"  # each at most once
_VECTOR_CALL = r"(?<![^ ])(?:" + "|".join(_call(n, s) for s, n in VECTOR_FUNCTIONS.items()) + ")"
_SCALAR_CALL = r"(?<![^ ])(?:" + "|".join(_call(n, s) for s, n in SCALAR_FUNCTIONS.items()) + ")"
_AGGREGATE_CALL = (
    r"(?<![^ ])(?:"
    + "|".join(
        rf"(?:{'|'.join(names)})(?: ⟨g\d+:⟩ ⟨p\d+:{sig}⟩| ⟨p\d+:{sig}⟩ ⟨g\d+:⟩| ⟨p\d+:{sig}⟩)"
        for sig, names in AGGREGATORS.items()
    )
    + ")"
)
_BINARY_OP = (
    r"(?:(?:(?:==|!=|<=|>=|<|>)(?: bool)?|atan2|[-+*/%^])(?: ⟨o\d+:⟩(?: ⟨j\d+:⟩)?)?|(?:and|or|unless)(?: ⟨o\d+:⟩)?)"
)
_CHAIN = rf"^(?:[-+] )*+[VN](?: {_BINARY_OP} (?:[-+] )*+[VN])*+$"


_MATCHING = r"(?: ⟨o\d+:⟩(?: ⟨j\d+:⟩)?)?"
_ARITHMETIC = (r"\^", r"(?:[*/%]|atan2)", r"[-+]")  # tightest first
_COMPARISON = r"(?:==|!=|<=|>=|<|>)"


def _by_precedence(chain: Column) -> Column:
    """Type of a chain that mixes scalars with comparisons or set operators.

    Levels collapse from the tightest on. Two scalars compare only with ``bool``, and set
    operators take vectors only, so what breaks a rule is left standing.
    """
    t = F.regexp_replace(chain, r"(?:^|(?<=[^VN] ))(?:[-+] )++", "")  # signs

    def collapse(t: Column, scalars: str, op: str, from_right: bool = False) -> Column:
        """A matching clause stands between two vectors only."""
        t = F.regexp_replace(t, rf"(?<![^ ])N(?: {scalars} N)*+", "N")
        if from_right:
            t = F.regexp_replace(t, rf"(?<![^ ])N {op} V", "V")
        t = F.regexp_replace(t, rf"(?<![^ ])V(?: {op}(?:{_MATCHING} V| N))*+", "V")
        return F.regexp_replace(t, rf"(?<![^ ])N {op} V", "V")

    for op in _ARITHMETIC:
        t = collapse(t, op, op, op == _ARITHMETIC[0])
    t = collapse(t, _COMPARISON + " bool", _COMPARISON + "(?: bool)?")
    for op in ("(?:and|unless)", "or"):
        t = F.regexp_replace(t, rf"(?<![^ ])V(?: {op}{_MATCHING} V)*+", "V")
    return F.when(t.isin("V", "N"), t).otherwise(F.lit("!"))


def _where(text: Column, has: str | tuple[str, ...], *changes: tuple[str, str]) -> Column:
    """The changes, pattern by pattern, where the text has what each of them needs."""

    def changed(t: Column) -> Column:
        out, there = t, F.lit(False)
        for pattern, new in changes:
            out = F.regexp_replace(out, pattern, new)
        for part in (has,) if isinstance(has, str) else has:
            there = there | t.contains(part)
        return F.when(there, out).otherwise(t)

    return bind(text, changed)


def _flat_types(flat: Column) -> Column:
    """Type letters of the comma-separated arguments in ``flat``; ``!`` marks a broken one."""
    return bind(flat, _types_of)


def _types_of(flat: Column) -> Column:
    t = _where(flat, "[", (rf"⟨v\d+:⟩ \[ (?:{_DURATION}) \]", "M"))
    t = _where(t, "⟨v", (r"⟨v\d+:⟩", "V"))
    t = _where(t, ("offset", "@"), (rf"(?<=[VM]){_MODIFIERS}", ""))
    t = _where(
        t,
        "⟨p",
        (_VECTOR_CALL, "W"),
        (_SCALAR_CALL, "N"),
        (_AGGREGATE_CALL, "W"),
        (r"(?<![^ ])(?<![a-z0-9_] )⟨p\d+:V⟩", "W"),
        (r"(?<=bool |and |or |unless |atan2 )⟨p\d+:V⟩", "W"),
        (r"(?<=bool |and |or |unless |atan2 )⟨p\d+:N⟩", "N"),
        (r"(?<![^ ])(?<![a-z0-9_] )⟨p\d+:([NMS])⟩", "$1"),
    )
    t = _where(t, "[", (rf"[VW] \[ (?:{_DURATION}) : (?:(?:{_DURATION}) )?\]{_MODIFIERS}?", "M"))
    t = _where(t, "⟨s", (r"⟨s\d+⟩", "S"))
    t = F.regexp_replace(t, rf"(?<![^ ])(?:(?:{_NUMBER})|{_NUMBER_WORD}|{_DURATION}|\d+\.?\d*E-?\d+)(?![^ ])", "N")
    t = F.replace(t, F.lit("W"), F.lit("V"))

    def arg(a: Column) -> Column:
        vector = F.when(a.contains("V"), F.lit("V")).otherwise(F.lit("N"))
        delicate = a.contains("N") & _matches(a, "[=<>⟨]|and|or|unless")
        return (
            F.when(_matches(a, "^[MS]$"), a)
            .when(~_matches(a, _CHAIN), F.lit("!"))
            .when(delicate, _by_precedence(a))
            .otherwise(vector)
        )

    types = F.array_join(F.transform(split_at(F.trim(t), " , "), arg), "")
    return F.when(F.trim(flat) == "", F.lit("")).when(_matches(flat, r"^⟨v\d+:⟩$"), F.lit("V")).otherwise(types)


def _modifiers_first(flat: Column) -> Column:
    """``sum (x) by (a)`` -> ``sum by (a) (x)``."""
    return F.regexp_replace(flat, rf"(?<![^ ])({_ALL_AGGREGATORS}) (⟨p\d+:\w*⟩) (⟨g\d+:⟩)", "$1 $3 $2")


def _fold_parentheses(text: Column) -> Column:
    """struct(s, parts, ok): every group, innermost first, replaced by a typed mark."""
    closing = F.length(text) - F.length(F.replace(text, F.lit(")"), F.lit("")))
    opening = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    start = F.struct(
        text.alias("s"),
        F.array().cast("array<struct<mark:string,body:string>>").alias("parts"),
        (closing == opening).alias("ok"),
    )

    def step(acc: Column, k: Column) -> Column:
        def fold(head: Column, body: Column, types: Column) -> Column:
            pre = F.substring(acc.s, F.lit(1), F.length(head) - F.length(body) - 1)
            post = F.substring(acc.s, F.length(head) + 2, F.length(acc.s))
            mark = F.concat(F.lit("⟨p"), k.cast("string"), F.lit(":"), types, F.lit("⟩"))
            return F.struct(
                F.concat(pre, mark, post).alias("s"),
                F.concat(
                    acc.parts,
                    F.array(F.struct(mark.alias("mark"), _modifiers_first(F.trim(body)).alias("body"))),
                ).alias("parts"),
                (acc.ok & head.contains("(") & ~types.contains("!")).alias("ok"),
            )

        def within(head: Column) -> Column:
            return bind(F.substring_index(head, "(", -1), lambda body: bind(_flat_types(F.trim(body)), lambda types: fold(head, body, types)))

        return bind(F.substring_index(acc.s, ")", 1), within)

    def while_ok(acc: Column, k: Column) -> Column:
        return F.when(acc.ok, step(acc, k)).otherwise(acc)

    return F.when(
        (closing == opening) & (closing > 0), F.aggregate(F.sequence(F.lit(1), F.greatest(closing, F.lit(1))), start, while_ok)
    ).otherwise(start)


def _unfold(folded: Column) -> Column:
    return F.aggregate(
        F.reverse(folded.parts),
        _modifiers_first(folded.s),
        lambda s, p: F.replace(s, p.mark, F.concat(F.lit("("), p.body, F.lit(")"))),
    )


def _spacing(text: Column) -> Column:
    t = F.replace(text, F.lit(" ,"), F.lit(","))
    t = _where(t, "[", (r" \[ ", "["), (r" \]", "]"))
    t = _where(t, " :", (r" : ?", ":"))
    t = _where(t, " (", (rf"(?<![A-Za-z0-9_])(?!(?:{_KEYWORDS})(?![A-Za-z0-9_]))([a-z][a-z0-9_]*) \(", "$1("))
    return t


def _restore(text: Column, tokens: Column, texts: Column) -> Column:
    """Put selectors, lists and strings back in place of their marks."""

    def one(mark: Column, _i: Column) -> Column:
        index = F.regexp_extract(mark, r"(\d+)", 1).cast("int")
        return F.when(mark.startswith("⟨s"), _quote(_unquote(F.get(tokens, index)))).otherwise(F.get(texts, index))

    return F.trim(split_keep(text, r"⟨[a-z]\d+:?⟩", one))


def _without_empty_lists(text: Column, texts: Column) -> Column:
    """``sum by () (x)`` is ``sum (x)``."""

    def one(mark: Column, _i: Column) -> Column:
        index = F.regexp_extract(mark, r"(\d+)", 1).cast("int")
        return F.when(F.get(texts, index) == "", F.lit("")).otherwise(mark)

    return split_keep(text, r"⟨[go]\d+:⟩ ", one)


def describe(query: Column) -> Column:
    """struct(canonical, canonical_any_range, matchers); '' / '' / NULL for an invalid text."""

    def with_tokens(tokens: Column) -> Column:
        return bind(_join_tokens(tokens), lambda joined: with_joined(tokens, joined))

    def with_joined(tokens: Column, joined: Column) -> Column:
        found = F.regexp_extract_all(joined, F.lit(_LIST_OR_SELECTOR), F.lit(0))
        return bind(F.transform(found, lambda s: F.struct(s.alias("text"), _segment_kind(s).alias("kind"))), lambda found: with_segments(tokens, joined, found))

    def segment(s: Column, tokens: Column) -> Column:
        def selector(m: Column) -> Column:
            return F.struct(_selector_text(s, m).alias("text"), _selector_ok(s, m).alias("ok"), _selector_map(m).alias("labels"))

        return bind(_selector_parts(s, tokens), selector)

    def matching_list(s: Column, tokens: Column) -> Column:
        return F.struct(_list_text(s, tokens).alias("text"), _list_ok(s).alias("ok"), F.lit(None).cast("map<string,string>").alias("labels"))

    def with_segments(tokens: Column, joined: Column, found: Column) -> Column:
        segments = F.transform(found, lambda f: F.when(f.kind == "v", segment(f.text, tokens)).otherwise(matching_list(f.text, tokens)))
        marks = F.transform(found, lambda f, i: F.concat(F.lit("⟨"), f.kind, i.cast("string"), F.lit(":⟩")))
        marked = F.array_join(F.zip_with(split_at(joined, _LIST_OR_SELECTOR), marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        return bind(
            F.struct(segments.alias("segments"), bind(marked, _fold_parentheses).alias("folded")),
            lambda st: bind(
                F.struct(
                    (
                        st.folded.ok
                        & ~_matches(joined, _STRAY)
                        & ~_matches(joined, r"[\[:] 0s (?:\]|:)")  # a range is longer than nothing
                        & F.forall(st.segments, lambda s: s.ok)
                        & _matches(_flat_types(st.folded.s), "^[VNMS]$")
                    ).alias("valid"),
                    F.transform(st.segments, lambda s: s.text).alias("texts"),
                    F.transform(F.filter(st.segments, lambda s: s.labels.isNotNull()), lambda s: s.labels).alias("maps"),
                ),
                lambda known: F.when(
                    known.valid,
                    bind(
                        _without_empty_lists(_unfold(st.folded), known.texts),
                        lambda plain: finish(tokens, known, plain),
                    ),
                ).otherwise(nothing),
            ),
        )

    nothing = F.struct(
        F.lit("").alias("canonical"),
        F.lit("").alias("canonical_any_range"),
        F.lit(None).cast("array<map<string,string>>").alias("matchers"),
    )

    def finish(tokens: Column, known: Column, plain: Column) -> Column:
        any_range = F.regexp_replace(plain, rf"(⟨v\d+:⟩) \[ (?:{_DURATION}) \]", "$1 [ 0s ]")

        def texts(canonical: Column) -> Column:
            shown = F.when(plain.contains("["), _restore(_spacing(any_range), tokens, known.texts)).otherwise(canonical)
            return F.struct(canonical.alias("canonical"), shown.alias("canonical_any_range"), known.maps.alias("matchers"))

        return bind(_restore(_spacing(plain), tokens, known.texts), texts)

    return bind(_tokens(F.coalesce(query, F.lit(""))), with_tokens)


# ---- shapes: texts that differ in metric names and label values only ---------------------
#: Marks that stand for names and values in a shape begin with it. A text that holds it itself is its own shape.
_HELD = "zqx"
_WORD = r"[A-Za-z_][A-Za-z0-9_:]*+"
_STEP = rf"{_DURATION}(?::(?:{_DURATION})?)?|\d++(?:\.\d++)?"
_OPERATOR = r"(?:=~|!~|!=|=)"
_MATCHERS = rf'\{{\s*+(?:{_LABEL}\s*+{_OPERATOR}\s*+"[^"\\\n]*+"\s*+(?:,\s*+|(?=\}})))*+\}}'
#: Texts whose names and values may be held: strings in double quotes without escapes, braces with plain matchers, no comments, and
#: no word that begins with a digit but for numbers and durations. Their words are then tokens as they stand.
_PLAIN = rf'^(?:{_MATCHERS}|"[^"\\\n]*+"|{_WORD}(?!\.)|(?:{_STEP})(?![A-Za-z0-9_:.])|[-+*/%^()\[\],@<>=!~\s])*+$'
#: A list of labels with its word; a word with what follows it if it is called, a label or followed by a string; a string; the rest.
_SHAPE_PIECE = (
    rf'(?i:{_LIST_WORDS})\s*+\((?:[^()"]|"[^"]*+")*+\)|{_WORD}(?:\s*+(?:{_OPERATOR}\s*+)?+(?:"[^"]*+"|(?<![=~])\())?+'
    rf'|"[^"]*+"|[0-9.][A-Za-z0-9_:.]*+|[^A-Za-z0-9_".]++'
)
#: The value of a matcher, where it is not empty and, as a pattern, plain.
_VALUE = rf'^(?!__name__(?![A-Za-z0-9_])){_LABEL}\s*+(?:!?=\s*+"|[=!]~\s*+"(?=[^"\\.+*?()|\[\]{{}}^$]*+"$))([^"]++)"$'


def shape(query: Column) -> Column:
    """struct(shape, held): the text with marks for its metric names and label values, and what the marks stand for.

    What a text means hangs on neither: names stay where they are, values are masked, and both come back in the matchers. So texts
    of one shape have one description but for the marks (:func:`filled`). Names and values on which anything may hang
    (keywords, labels, what is sorted, patterns with operators) stay in the shape; a text that is not plain is its own.
    """

    def mark(i: Column) -> Column:
        return F.concat(F.lit(_HELD), i.cast("string"), F.lit("_"))

    def held(p: Column) -> Column:
        """What of a piece is held; empty if nothing is."""
        name = p.rlike(rf"^{_WORD}$") & ~F.lower(p).isin(*f"{_KEYWORDS}|{_ALL_AGGREGATORS}".split("|"))
        return F.when(p.endswith('"'), F.regexp_extract(p, _VALUE, 1)).when(name, p).otherwise(F.lit(""))

    def marked(pieces: Column, parts: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            part = F.get(parts, i)
            return F.when(part == "", p).when(p.endswith('"'), F.replace(p, F.concat(F.lit('"'), part), F.concat(F.lit('"'), mark(i)))).otherwise(mark(i))

        every = F.transform(parts, lambda part, i: F.struct(mark(i).alias("mark"), part.alias("text")))
        return F.struct(F.array_join(F.transform(pieces, piece), "").alias("shape"), F.filter(every, lambda h: h.text != "").alias("held"))

    nothing = F.struct(query.alias("shape"), F.array().cast("array<struct<mark:string,text:string>>").alias("held"))
    plain = query.rlike(_PLAIN) & ~query.contains(_HELD)
    pieces = F.regexp_extract_all(query, F.lit(_SHAPE_PIECE), F.lit(0))
    return F.when(plain, bind(pieces, lambda x: bind(F.transform(x, held), lambda parts: marked(x, parts)))).otherwise(nothing)


def filled(described: Column, held: Column) -> Column:
    """The description of a text from that of its shape and what its marks stand for."""

    def text(t: Column) -> Column:
        return F.aggregate(held, t, lambda s, h: F.replace(s, h.mark, h.text))

    def value(v: Column) -> Column:
        return F.when(v.startswith(_HELD), F.coalesce(F.get(F.filter(held, lambda h: h.mark == v), F.lit(0))["text"], v)).otherwise(v)

    return F.struct(
        text(described["canonical"]).alias("canonical"),
        text(described["canonical_any_range"]).alias("canonical_any_range"),
        F.transform(described["matchers"], lambda m: F.transform_values(m, lambda _, v: value(v))).alias("matchers"),
    )


def hash_identity(canonical: Column) -> Column:
    """64-bit hex identity of a canonical text; '' stays ''."""
    return F.when(canonical == "", F.lit("")).otherwise(F.substring(F.md5(canonical), 1, 16))


def canonical_expr(query: Column, ignore_ranges: bool = False) -> Column:
    return describe(query)["canonical_any_range" if ignore_ranges else "canonical"]


def fingerprint(query: Column, ignore_ranges: bool = False) -> Column:
    return hash_identity(canonical_expr(query, ignore_ranges))


def label_matchers(query: Column) -> Column:
    return describe(query)["matchers"]
