import random

import pytest
from pyspark.sql import functions as F

from metricledger.functions import promql
from metricledger.operators import enrich
from tests.expressions import broken, changes, spelled, tree

def generated():
    """Pairs of spellings of one expression, pairs of different expressions, and texts that are none."""
    same, different, invalid = [], [], []
    for seed in range(60):
        rnd = random.Random(seed)
        node = tree(rnd, seed % 4)
        text = spelled(node, rnd)
        same.append((text, spelled(node, rnd)))
        different += [(text, spelled(other, rnd)) for other in rnd.sample(changes(node), 3)]
        invalid += broken(text)
    return same, different, invalid


GENERATED = generated()
# Rules that the generator does not reach: numbers, signs, empty groupings, quoted names, subqueries, string arguments.
SAME = GENERATED[0] + [
    ("max by () (queue_depth)", "max(queue_depth)"),
    ("used / ignoring(rack) group_left free", "used / ignoring(rack) group_left() free"),
    ("queue_depth * 2.0", "queue_depth * 0x2"),
    ("queue_depth * 2_500", "queue_depth * 2500"),
    ("queue_depth < +Inf", "queue_depth < Inf"),
    ("+1 * (+2)", "1 * (2)"),
    ("max_over_time(rate(x[5m])[60m:30s])", "max_over_time(rate(x[300])[1h:30s])"),
]
DIFFERENT = GENERATED[1] + [
    ("a + 1", "+a * 1"),
    ('label_replace(up, "a", "$1", "b", "(.*)")', 'label_replace(up, "a", "$1", "b", "(.+)")'),
    ('{__name__="up"}', '{__name__="down"}'),
]
VALID = [
    "up",
    "1 + 2",
    "time()",
    "-x",
    "a and (b or c)",
    "x @ 1609746000",
    "x @ end() offset 5m",
    "rate(x[5m] offset 1h @ 1609746000.5)",
    "sum_over_time(rate(x[5m])[1h:5m] offset 1d)",
    "x[5m] offset -1h",
    "topk(5, sum without(a) (x))",
    'count_values("v", x)',
    "a == bool 1",
    "1 == bool 1",
    "1 > bool 2 + 3",
    "2 * x > 1 + 1",
    "x > 5 and y < 3",
    "x and 1 + y",
    "1 - -x >= 2 ^ 3",
    "x == on (a) y or vector(1)",
    "5 < x",
    "-1 * x unless y == 2",
    'absent(up{job="a"}) or vector(0)',
    "clamp(x, 0, 1)",
    "day_of_week()",
    "scalar(x) * 2",
    "histogram_quantile(0.9, sum by(le) (rate(x_bucket[5m])))",
    "rate(:node:mem[5m])",
    '{"my.metric", a="b"}',
    "x[5m:]",
    "((a))",
    "NaN",
    "x{a=\"1\",}",
    "quantile_over_time(0.5, x[5m])",
    'label_join(x, "d", ",", "a", "b")',
    "2 * a * on(x) b",
    "a * on(x) b * 2 > bool 1",
    "a ^ on(x) 2 ^ b",
    "1 + a / on(x) group_left(y) b - 3",
    "a and on(x) b > 1",
    '{job=~".+"}',
    '{job!~".*"}',
    '{job!~"a?"}',
    'up{job=~"[a-z]*|x{2,3}?"}',
]
INVALID = GENERATED[2] + [
    "",
    "made_up(used)",
    "increase(free)",
    "count(free[90s])",
    "free{tier=}",
    "x$y",
    "{}",
    '{job=~".*"}',
    'up == "a"',
    "rate(m[",
    "1 +",
    "sum by (a)",
    "foo{a=\"x\" b=\"y\"}",
    'up{__name__="x"}',
    "clamp(x)",
    "x offset",
    "x[0s]",
    "x[5m:0s]",
    "1 == 1",
    "1 + 2 > 3",
    "1 and x",
    "x or 1",
    "x unless 2 * 3",
    "x > 1 == bool 1 and 1",
    "x offset 5m offset 5m",
    "x @ 1 @ 2",
    '"unclosed',
    "foo[5m",
    "sum(a,b)",
    "a + on(x) 1",
    "1 + on(x) a",
    "1 + ignoring(x) 2",
    "a * on(x) 2 * b",
    "a > bool on(x) 1",
    "a + on(x) group_left(y) 2",
    "a and on(x) group_left b",
    "a > 1 or on(x) 2",
    '{job=~"a*"}',
    '{job=~"(a|b?)"}',
    '{job!~"a"}',
    '{job=~"x|"}',
    'up{job=~"["}',
    'up{job=~"("}',
    'up{job!~"a)"}',
    'up{job=~"*a"}',
    'up{job=~"a**"}',
]


@pytest.fixture(scope="module")
def described(spark):
    texts = sorted({t for pair in SAME + DIFFERENT for t in pair} | set(VALID) | set(INVALID))
    df = spark.createDataFrame([(t,) for t in texts], "query_param string")
    return {r.query_param: r for r in enrich.expression_dictionary(df).collect()}


@pytest.mark.parametrize("one, other", SAME)
def test_same_identity(described, one, other):
    assert described[one].canonical == described[other].canonical != ""
    assert described[one].fingerprint == described[other].fingerprint


@pytest.mark.parametrize("one, other", DIFFERENT)
def test_different_identity(described, one, other):
    assert "" not in (described[one].fingerprint, described[other].fingerprint)
    assert described[one].fingerprint != described[other].fingerprint


@pytest.mark.parametrize("text", VALID)
def test_valid(described, text):
    assert len(described[text].fingerprint) == 16


@pytest.mark.parametrize("text", INVALID)
def test_invalid(described, text):
    row = described[text]
    assert (row.canonical, row.fingerprint, row.label_matchers) == ("", "", None)


def test_values_are_masked(spark):
    rows = spark.createDataFrame([('free{tier="gold",cell=~"1|2"}',)], "query_param string")
    assert enrich.expression_dictionary(rows).first().canonical == 'free{cell=~"MASKED",tier="MASKED"}'


def test_ranges_can_be_ignored(spark):
    rows = spark.createDataFrame([(f"increase(used[{d}])",) for d in ("90s", "4h")], "query_param string")
    a, b = enrich.expression_dictionary(rows).collect()
    assert a.canonical_any_range == b.canonical_any_range == "increase(used[0s])"
    assert a.fingerprint_any_range == b.fingerprint_any_range and a.fingerprint != b.fingerprint


def test_matchers(spark):
    texts = ['{__name__="up",job="prometheus"}', 'x{a="1",a="2"}', 'a{k="\\"q\\\\"} / b{k!~"v"}', "1 + 1"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    got = {r.q: r.m for r in df.select("q", promql.label_matchers(F.col("q")).alias("m")).collect()}
    assert got[texts[0]] == [{"__name__": "up", "job": "prometheus"}]
    assert got[texts[1]] == [{"__name__": "x", "a": "2"}]
    assert got[texts[2]] == [{"__name__": "a", "k": '"q\\'}, {"__name__": "b", "k": "v"}]
    assert got[texts[3]] == []


def test_inline_enrichment_equals_dictionary(spark):
    df = spark.createDataFrame([('foo{a="1"}',), ("rate(",), ('foo{a="2"}',)], "query_param string")
    by_join = enrich.enrich(df, enrich.expression_dictionary(df))
    inline = enrich.enrich_inline(df)
    key = lambda r: (r.query_param, r.fingerprint, str(r.label_matchers), str(r.metric_names))
    assert sorted(map(key, by_join.collect())) == sorted(map(key, inline.collect()))


def test_known_texts_are_not_worked_out_again(spark):
    first = spark.createDataFrame([("a",), ("b",)], "query_param string")
    second = spark.createDataFrame([("b",), ("c",), ("c",)], "query_param string")
    known = enrich.expression_dictionary(first)
    fresh = enrich.expression_dictionary(second, known)
    assert [r.query_param for r in fresh.collect()] == ["c"]


LONG = {
    'up{a=~"' + "x|" * 50_000 + '"}': True,
    'up{a=~"' + "\\\\." * 20_000 + '"}': True,
    " or ".join(f"m{i}" for i in range(2_000)): True,
    "up{" + ",".join(f'l{i}="v"' for i in range(2_000)) + "}": True,
    "(" * 200 + "up" + ")" * 200: True,
    " + ".join(f"rate(m{i}[5m])" for i in range(200)): True,
    "-" * 2_000 + "x": True,
    " + ".join(f"{i} * x{i}" for i in range(2_000)) + " > 1": True,
    "up #" + "x" * 50_000: True,
    "$" * 20_000: False,
    "(" * 20_000: False,
    ")" * 10_000 + "(" * 10_000: False,
    'up{a="' + "\\" * 20_000: False,
}


def test_long_texts_are_read_whole(spark):
    """No text is cut, and none brings a task down."""
    df = spark.createDataFrame([(t,) for t in LONG], "query_param string")
    got = {r.query_param: r.fingerprint != "" for r in enrich.expression_dictionary(df).collect()}
    assert got == LONG


@pytest.mark.parametrize(
    "text, value",
    [
        (r'"\x41\x2d"', "A-"),
        (r'"\u00e9\U0001F600"', "é😀"),
        (r'"\101\n\t\r"', "A\n\t\r"),
        (r'"a\\nb\"\'"', "a\\nb\"'"),
        (r"`\x41`", r"\x41"),
    ],
)
def test_escapes_in_matchers(spark, text, value):
    rows = spark.createDataFrame([("used{rack=" + text + "}",)], "query_param string")
    assert enrich.enrich_inline(rows).first().label_matchers[0]["rack"] == value
