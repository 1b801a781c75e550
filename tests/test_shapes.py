"""Texts that differ in metric names and label values only are described once."""

import pytest
from pyspark.sql import functions as F

from metricledger.functions import promql
from metricledger.operators import enrich
from tests import expressions

#: Texts in which names, values, keywords and labels stand in places where they are easily taken for each other.
DELICATE = [
    'm_1{job="a"}', "m_1", "sum", "SUM(m_1)", "sum by (m_1, a) (m_2)", "sum(m_2) BY (zz, b1)", "by", 'm_1{by="x"}', 'by{a="x"}', "bool", "a == bool b", "inf", "iNf + m_1",
    "rate(m_1[5m])", "rate (m_1[5m:1m])", "rate(m_1[5m:])", "foo(m_1)", "m_1 offset 5m", "m_1 @ start()", "m_1 @ end ()", "m_1 # m_2", "5m", "5m_1", ".5m", "m_1.a", "1e5", "0x1F", "1_000",
    'm_1{a="x",a="y"}', 'm_1{b="x",a="y"}', 'm_1{__name__="m_2"}', '{__name__="m_1"}', '{__name__=~"m_.+"}', '{__name__=~"m_1"}', 'm_1{__name__x="m"}', '{"m_1"}', '{"m 1","a"="b"}', 'm_1{"a"="b"}',
    'm_1{a=""}', '{a=""}', '{a!="x"}', '{a="x"}', '{a=~"x"}', '{a=~"x.*"}', '{a=~".*"}', '{a=~""}', '{a!~"x"}', '{a=~"("}', 'm_1{a=~"("}', 'm_1{a="("}', 'm_1{a="}",b="{"}', 'm_1{a=","}',
    'm_1{a = "x"}', 'm_1{ a="x" , }', 'm_1{a=="x"}', 'm_1 == "x"', 'm_1 != "x"', 'm_1 = "x"', 'm_1 "x"', 'm_1{a="x" "y"}', "m_1{a='x'}", 'm_1{a="\\""}', "m_1{a=`x`}", 'm_1{a="x"', 'm_1{{a="x"}}', "by({x}, m_1)",
    'label_replace(m_1, "a", "$1", "b", "(.*)")', 'count_values("m_1", m_2)', 'sum by ("a)", m_1) (m_2)', "m_1 / on(b, a) group_left m_2", "m_1 / on(b, a) group_left(d, c) m_2", "group_left (m_1)", "on(m_1)",
    "m_1 and m_1", "m_1 unless on() m_2", "a:b:c", ":a", "zqx0_", 'm_1{a="zqx0_"}', "zqx1_ + m_1", "m_1 + zqx", "E", "N + 1", "V", "W[5m]", "M", "S", "-m_1", "+ m_1", "m_1 +", "m_1 m_2", "m_1 ^ +1", "", " ", "(m_1", "m_1[", "m_1 ,",
    'm_1{a="x"}[5m]', "topk(3, m_1)", "quantile_over_time(0.5, m_1[1h30m])", "m_1{a!=\"x\",b!~\"y\"} > bool 3", 'm_1{a="é",b="日本"}', "é + m_1", "m_1 ", "m_1\n+\tm_2", 'm_1{a="x\ny"}', "absent(m_1{a=\"x\"} offset -5m)",
]


def _rows(df):
    shown = ["canonical", "canonical_any_range", "fingerprint", "fingerprint_any_range"]
    return {r[0]: r[1:] for r in df.select("query_param", *shown, F.to_json("label_matchers"), F.to_json(F.struct("metric_names"))).collect()}


def test_a_description_through_the_shape_is_that_of_the_text(spark):
    listed = [x for v in vars(expressions).values() if isinstance(v, (list, tuple, dict)) for x in (v.items() if isinstance(v, dict) else v)]
    known = {t for x in listed for t in ([x] if isinstance(x, str) else x if isinstance(x, (list, tuple)) else []) if isinstance(t, str)}
    log = spark.createDataFrame([(t,) for t in sorted(known | set(DELICATE))], "query_param string")
    direct = enrich.enrich_inline(log).select("query_param", "fingerprint", F.to_json("label_matchers"), F.to_json(F.struct("metric_names")))
    both = log.select("query_param", promql.describe(F.col("query_param")).alias("d"))
    texts = {r[0]: r[1:] for r in both.select("query_param", "d.canonical", "d.canonical_any_range").collect()}
    found = _rows(enrich.expression_dictionary(log))
    assert {t: f[:2] for t, f in found.items()} == texts
    assert {t: (f[2], f[4], f[5]) for t, f in found.items()} == {r[0]: (r[1], r[2], r[3]) for r in direct.collect()}


@pytest.mark.parametrize("template", ["m_{i}", 'rate(m_{i}{{job="j{i}",env=~"e{i}"}}[5m])', 'a_{i} / on(job) group_left(team) b_{i}{{job=~"j.*",x!="{i}"}}'])
def test_names_and_values_share_a_shape(spark, template):
    texts = spark.createDataFrame([(template.format(i=i),) for i in range(300)], "query_param string")
    assert texts.select(promql.shape(F.col("query_param"))["shape"]).distinct().count() == 1
    rows = enrich.expression_dictionary(texts).select("canonical", F.to_json("label_matchers")).distinct()
    assert rows.count() == 300
    # what is costly sees one row, whatever the texts
    plan = enrich.described_shapes(texts.select(F.coalesce(promql.shape(F.col("query_param"))["shape"], F.lit("")).alias("shape")))
    assert plan.count() == 1
