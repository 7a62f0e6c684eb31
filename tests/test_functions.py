from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.functions import patterns, provenance, text, urls
from pagelens.operators import visibility
from pagelens.operators.planning import split_ids


def value(spark, column, *given, names=("x",)):
    kinds = {str: "string", bytes: "binary", bytearray: "binary"}
    schema = ", ".join(f"{n} {kinds.get(type(g), 'string')}" for n, g in zip(names, given, strict=True))
    return spark.createDataFrame([given], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "html, shown",
    [
        ("<p>a&nbsp;&amp;<script>x</script>b<!-- c --></p>", "a & b"),
        ("<SCRIPT type='a'>1</SCRIPT><style>s</style><noscript>n</noscript><svg>v</svg><template>t</template>z", "z"),
        ("&amp;lt; &quot;", "< &quot;"),
        ("　a \n b ", "a b"),
        ("", ""),
    ],
)
def test_visible_text(spark, html, shown):
    assert value(spark, text.visible_text(F.col("x")), html) == shown


def test_structured_data(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":" Acme ","founder":{"@type":["Person"],"name":"Li"}},{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q1 \\"@type\\": \\"Fake\\""}]}]}</script><script type="application/ld+json">{broken</script>'
    blocks = text.ld_of(text.all_of(F.col("x"), patterns.LD_JSON, 1))
    assert value(spark, F.size(blocks), html) == 2
    assert sorted(value(spark, text.ld_types(blocks), html)) == ["FAQPage", "Organization", "Person", "Question"]
    assert value(spark, text.entity_names(blocks), html) == ["Acme", "Li"]


@pytest.mark.parametrize("raw, kind, shown", [("中文".encode(), "", "中文"), ("中文".encode("gbk"), "text/html; charset=gbk", "中文"), ("中文".encode("gb18030"), "", "中文"), (b"\xff\xff", "", "��"), (b"plain", "text/html; charset=GB2312", "plain")])
def test_decoding(spark, raw, kind, shown):
    assert value(spark, text.decoded(F.col("x"), F.col("y")), raw, kind, names=("x", "y")) == shown


@pytest.mark.parametrize("url, cjk", [("https://a.example/%E4%B8%AD", True), ("https://a.example/a+b", False), ("https://a.example/%zz", False), ("https://a.example/中", True)])
def test_slugs(spark, url, cjk):
    assert value(spark, urls.has_cjk(F.col("x")), url) is cjk


def test_urls(spark):
    assert value(spark, urls.host(F.col("x")), "https://WWW.A.com:80/x") == "a.com:80"
    assert [value(spark, urls.page_type(F.col("x")), u) for u in ("https://a.b/blog/1", "https://a.b/pricing", "https://a.b/", "https://a.b", "https://a.b/x?p=1")] == ["article", "product", "home", "home", "other"]
    link = lambda x: value(spark, urls.resolved(F.lit("https://a.b/c/d?e"), F.col("x")), x)
    assert [link(x) for x in ("https://x.y/z", "//x.y/z", "/z", "z")] == ["https://x.y/z", "https://x.y/z", "https://a.b/z", "https://a.b/c/z"]
    ok = lambda u, a: value(spark, urls.fetchable(F.col("x"), F.col("y")), u, a, names=("x", "y"))
    assert ok("https://a.b/", "93.184.216.34") and not ok("ftp://a.b/", "93.184.216.34") and not ok("http://local/", "93.184.216.34")
    assert not any(ok("http://a.b/", a) for a in ("10.1.2.3", "127.0.0.1", "169.254.1.1", "172.20.0.1", "192.168.1.1", "224.0.0.1", "::1", "fd00::1", "fe80::1", "0.0.0.0"))


def test_claims_and_ids(spark):
    answer = "我们服务了超过 300 家企业，提升 25%。x"
    rows = visibility.claims(spark.createDataFrame([(1, answer)], "pos int, answer string")).orderBy("place").collect()
    assert [r["claim"] for r in rows] == ["我们服务了超过 300 家", "企业，提升 25%"]
    assert value(spark, split_ids(F.col("x")), "L1-3，L2-4 L3-4,") == ["L1-3", "L2-4", "L3-4"]


marked = st.text(st.characters(exclude_characters="⁠", exclude_categories=("Cs",)), max_size=30)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(marked, st.integers(0, 2**32 - 1)), min_size=1, max_size=20))
def test_marks_round_trip(spark, rows):
    df = spark.createDataFrame([(t, f"{c:08x}") for t, c in rows], "t string, code string").withColumn("m", provenance.embedded(F.col("t"), F.col("code")))
    bad = df.where(~((provenance.extracted(F.col("m")) == F.col("code")) & (provenance.stripped(F.col("m")) == F.col("t")) & (provenance.embedded(F.col("m"), F.lit("ffffffff")) == F.col("m")) & (F.length("m") == F.length("t") + 34)))
    assert bad.isEmpty()


def test_foreign_marks(spark):
    edge = provenance.EDGE
    assert value(spark, provenance.stripped(F.col("x")), f"a{edge}b{edge}c{edge}d") == f"ac{edge}d"
    assert value(spark, provenance.extracted(F.col("x")), f"a{edge}b{edge}c") is None
    assert value(spark, provenance.extracted(F.col("x")), f"a{edge}b") is None
    assert value(spark, provenance.embedded(F.col("x"), F.lit("0000abcd")), "one\ntwo").startswith("one" + edge)


def test_stamps(spark):
    brand = provenance.Brand("acme", version="2")
    df = provenance.stamped(spark.createDataFrame([("hello", "x")], "answer string, other string"), "tool", brand, F.col("other"), add_footer=True, issued_at=F.lit("t"))
    row = df.first()
    assert row["attribution"]["brand"] == "acme" and provenance.EDGE in row["answer"] and "| by | acme, " in row["answer"] and row["other"] == "x"
    assert provenance.sealed(df, "again", brand).columns == df.columns
    assert spark.range(1).select(provenance.identity_line(brand)).first()[0].startswith("[page audit] acme")


def test_entity_names_of_any_tree(spark):
    """Random trees, with brackets, quotes and keys inside strings, against a walk in plain Python."""
    import random

    from pagelens.functions import patterns as P

    rng = random.Random(5)
    words = ["Organization", "Person", "Thing", "Acme", " Li ", 'q"x', "{", "}", '{"@type":"Organization","name":"no"}', "[", "]", "\\", 'a\\"name":"b', "é😀", "", "name", "@type"]

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([*words, 7, None, True, 1.5])
        if kind < 0.4:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        node = {rng.choice(["a", "b", "c", "{", "founder"]): tree(depth - 1) for _ in range(rng.randrange(4))}
        if rng.random() < 0.8:
            node["@type"] = rng.choice(["Organization", "Person", "Thing", 7, None, ["Thing", "Organization"], [["Organization"], 7], ["Brand", {"@type": "Organization", "name": "deep"}], []])
        if rng.random() < 0.8:
            node["name"] = rng.choice([*words, 7, None, ["Acme"], {"@type": "Person", "name": "inner"}])
        return dict(sorted(node.items(), key=lambda _: rng.random()))

    def walk(node):
        if isinstance(node, dict):
            kinds = node.get("@type")
            if isinstance(node.get("name"), str) and any(k in P.ENTITY_TYPES for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)):
                yield node["name"].strip()
            node = list(node.values())
        if isinstance(node, list):
            for x in node:
                yield from walk(x)

    deep = {"@type": "Organization", "name": "bottom"}
    for k in range(40):
        deep = {"x": [deep], "name": f"n{k}"}
    trees = [[tree(5) for _ in range(rng.randrange(1, 3))] for _ in range(300)] + [[deep]]
    rows = spark.createDataFrame([(n, [json.dumps(t, ensure_ascii=False) for t in ts] + [None]) for n, ts in enumerate(trees)], "n int, raw array<string>")
    got = {r["n"]: r["names"] for r in rows.select("n", text.entity_names(text.ld_of(F.col("raw"))).alias("names")).collect()}
    assert got == {n: sorted({x for t in ts for x in walk(t)}) for n, ts in enumerate(trees)} and sum(map(bool, got.values())) > 100


def test_page_signals_are_native(spark, small):
    from pagelens.operators import signals

    assert "Python" not in signals.page_signals(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
