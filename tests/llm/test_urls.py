import re
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from metricledger.llm import urls


def as_regex(glob):
    parts = re.findall(r"\*\*+|\*|[^*]", glob)
    return re.compile("".join(".*" if len(p) > 1 else "[^/]*" if p == "*" else re.escape(p) for p in parts), re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*", max_size=8), min_size=1, max_size=40), st.lists(st.text("ab/", max_size=10), min_size=1, max_size=12))
def test_automaton_equals_regular_expressions(globs, texts):
    automaton = urls.Automaton([urls.Rule(None, g, "block", 0) for g in globs])
    fits = automaton.match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert fits[i].tolist() == [bool(as_regex(g).fullmatch(t)) for g in globs]


def judged(spark, *links):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(links)], "page_id long, url string, host string")
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(urls.judge(pages).collect(), key=lambda r: r.page_id)]


def test_rules(spark):
    assert judged(
        spark,
        "http://Blog.Example.NET/en/x?q=1",
        "http://example.net/EN/x",
        "http://a.net",
        "http://net/",
        "http://x.com/a.net/",
        "http://badexample.com/de/",
        "http://www.example.com/de/7#top",
        "https://m.x.org/fr/",
        "http://spam-farm.example.org/en/",
        "http://www.cheap-red-pills.org/",
        "no scheme",
        None,
        "",
        "a://b://c/d",
        "x://ÄB.net/ü?",
    ) == [
        ("blog.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/EN/x", "net/", "block"),
        ("a.net", "", None, "allow"),
        ("net", "/", "net/", "block"),
        ("x.com", "/a.net/", None, "allow"),
        ("badexample.com", "/de/", None, "allow"),
        ("www.example.com", "/de/7", "example.com/de/", "block"),
        ("m.x.org", "/fr/", "org/fr/", "allow"),
        ("spam-farm.example.org", "/en/", None, "block"),
        ("www.cheap-red-pills.org", "/", None, "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
        ("Äb.net", "/ü", "net/", "block"),
    ]


def test_long_urls_and_other_rules(spark):
    link = "http://h.de/" + "a" * 20_000 + "/end"
    pages = spark.createDataFrame([(1, link), (1, link), (2, "http://h.de/b")], "page_id long, url string")
    rules = [urls.Rule("long", "*.de//**/end", "block", 5)]
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, rules, default="allow").collect())
    assert got[:2] == [(1, "long", "block")] * 2 and got[2] == (2, None, "allow")
    assert {r.verdict for r in urls.judge(pages, [], default="block").collect()} == {"block"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_one_long_url_takes_bounded_memory():
    """Among many short ones, a URL of 200 KB is stepped by itself: peak below 32 MB, result as for the short ones alone."""
    short = [f".h{i}.example.net//en/{i}".encode() for i in range(2_047)]
    automaton = urls.Automaton(urls.RULES)
    want = automaton.match(short)
    tracemalloc.start()
    got = automaton.match([*short, b".a.org//fr/" + b"x" * 200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[:-1] == want).all() and got[-1].tolist() == [r.name == "org/fr/" for r in urls.RULES]
    assert peak < 32 << 20


def test_blocks_hold_every_url_once():
    lengths = [0, 5_000_000, 3, 3, 1_000_000, 2_000_000, 2_000_000, *range(5_000)]
    got = list(urls.blocks(lengths))
    assert sorted(i for block in got for i in block) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) <= urls.BLOCK and len(b) * max(lengths[i] for i in b) <= urls.BLOCK_BYTES for b in got)
    assert list(urls.blocks([])) == []
