"""Patterns of matchers: generated ones against Python's own engine, and fixed ones where the two syntaxes part."""

import random
import re

from pyspark.sql import functions as F

from metricledger.functions.patterns import empty_match


def pattern(rnd: random.Random, depth: int) -> str:
    """A valid pattern in the syntax that both engines share."""
    kind = rnd.randint(0, 9 if depth else 5)
    if kind <= 5:
        return rnd.choice(["a", "bc", ".", r"\d", r"\.", "[a-z]", "[^]x]", r"[\]a]", r"[\[]", "^", "$", "", "é"])
    if kind <= 7:
        return "".join(pattern(rnd, depth - 1) for _ in range(rnd.randint(1, 3)))
    group = rnd.choice(["(", "(?:", "(?i:"]) + rnd.choice(["", "|"]).join(pattern(rnd, depth - 1) for _ in range(rnd.randint(1, 3))) + ")"
    return group + rnd.choice(["", "*", "+", "?", "*?", "+?", "??", "{2}", "{0}", "{0,3}", "{2,}", "{1,2}?"])


FIXED = {
    "a": ["a{", "a{,5}", r"\x{1F600}", r"\pL", r"\p{Greek}+", r"\P{^Lu}", r"[[:alpha:]]", r"[[:^digit:]x]", r"\Qa*\E", r"\Qab\E*", r"\b", "(?s)a", "(?P<n>a)", "(?<n>a|b)", r"\07", r"\12", "a{1000}", "a-z", "]", "[a-]", "[-z]", "}", "x" * 5_000 + ".", "(" * 900 + "a" + ")" * 900, "a|" * 5_000 + "a"],
    "e": ["", ".*", "()", "a|", "|a", "a||b", "(a*)+", "(a|b*)(c?)", r"\Q\E", r"\Qa\E*", "(?i)", "^$", r"\A\z", r"\B", "((a?))", "a{0}", "(?-s:.*)", "(a|(b|(c|)))"],
    "!": ["[", "(", ")", "a)", "(a", "[]", "[^]", "[z-a]", "*", "+a", "a|*", "(*)", "a**", "a+*", "a{2}{3}", "a{1001}", "a{3,2}", "\\", r"\8", r"\1", r"\Z", r"\y", r"\é", "(?=a)", "(?!a)", "(?<=a)", "(?x)a", "[[:foo:]]", "(?P<>a)", r"[\Z]", "(" * 1_500 + "a" + ")" * 1_500, "[" * 20_000, "(" * 20_000],
}


def judged(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "p string")
    return {r.p: r.k for r in rows.select("p", empty_match(F.col("p")).alias("k")).collect()}


def test_generated_patterns(spark):
    rnd = random.Random(11)
    texts = {pattern(rnd, i % 4) for i in range(1_500)}
    want = {t: "e" if re.fullmatch(t, "") else "a" for t in texts}
    assert set(want.values()) == {"a", "e"}
    assert judged(spark, texts) == want


def test_fixed_patterns(spark):
    want = {t: kind for kind, texts in FIXED.items() for t in texts}
    got = judged(spark, want)
    assert {t[:40]: got[t] for t in want if got[t] != want[t]} == {}


def test_null_pattern(spark):
    assert spark.sql("SELECT cast(null AS string) AS p").select(empty_match(F.col("p")).alias("k")).first().k is None
