"""Small inputs that drive the cases which the large tables lack, for Spark and as SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEXT = "本条是结论：需要先核对来源。2026-03-01 更新，成立于 2019年。" + "数字 12.5% 与 37 项，第三条 规定 45 天，2024年 88% 与 1,234。" * 3
_LD = '{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":" Acme ","sameAs":["https://weibo.com/acme","https://zhihu.com/acme"],"founder":{"@type":["Person"],"name":"Li"}},{"@type":"FAQPage","dateModified":"2026-01-01","mainEntity":[{"@type":"Question","name":"Q1 { \\"@type\\": \\"Fake\\" }"}]}],"url":"https://github.com/acme"}'

PAGES = (
    (1, "https://acme.example/blog/one", f'<html lang="zh"><head><title> A title </title><meta name="description" content="{"d" * 50}"><link rel="canonical" href="https://acme.example/blog/one"><script type="application/ld+json">{_LD}</script></head><body><h1>H</h1><h2>什么是 x</h2><h2>如何做</h2><h3>c</h3><p>{_TEXT}作者 A，来源：B，下载 /data/x.csv 关于我们</p><ul><li>1</li></ul><table></table><ol></ol><dl><dt>t</dt></dl><img src="a" alt="x"><img src="b"><a href="https://www.gov.cn/x">g</a> 「一段引用的文字在此」「另一段引用的文字」</body></html>'),
    (2, "https://acme.example/pricing", '<html><head><meta name="robots" content="noindex,follow"><title></title></head><body><h1>a</h1><h1>b</h1>如上所述&nbsp;&amp;&lt;b&gt;&quot;<script>var x = 1;</script><svg>no</svg><!-- hidden --> ' + "word " * 700 + "</body></html>"),
    (3, "https://other.example/", '<script type="application/ld+json">{broken "https://juejin.cn/x"</script><script type="application/ld+json">{"@type":"Organization","name":"Acme"}</script><script type="application/ld+json">[{"@type":"WebSite","name":"Acme Inc"},{"@type":"Brand","name":7}]</script><p>About us</p><img alt=""><img alt="y">'),
    (4, "https://other.example/x?y=/product", None),
    (5, "", "plain　text with wide spaces　"),
)

ROBOTS = (
    ("a.example", "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nUser-agent: Bytespider\nAllow: /\n"),
    ("b.example", "User-agent: Bytespider\nAllow: /\nUser-agent: *\nDisallow: / # all\n"),
    ("c.example", "user-agent: *\nDisallow: /\nAllow: /\n"),
    ("d.example", "Disallow: /early\nUser-agent: *\nDisallow: /private\nDisallow:\n"),
    ("e.example", ""),
    ("f.example", "User-agent: claude\nDisallow: /*\nUser-agent: Baiduspider-render-x\nAllow: /\nUser-agent: claude\nAllow: /a\n"),
    ("g.example", "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nDisallow:\n"),
    ("h.example", "User-agent: *\nDisallow: /\nUser-agent: Googlebot\nUser-agent: PetalBot\nDisallow: /private\n"),
    ("i.example", "User-agent: *\nDisallow: /\nAllow: /$\n"),
    ("j.example", "User-agent: *\nDisallow: /*?x\nDisallow: *.pdf$\nDisallow: /_%\n"),
    ("k.example", "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n"),
    ("l.example", "USER-AGENT: googlebot\nDISALLOW: /\nUser-agent: GoogleBot\nAllow: /\n"),
    ("m.example", "User-agent: Google\nDisallow: /\nUser-agent: Googlebot\nAllow: /\nUser-agent: *\nDisallow: /\n"),
    ("n.example", "User-agent:\nDisallow: /\n"),
    ("o.example", "Sitemap: https://o.example/sitemap.xml\nUser-agent: *\nCrawl-delay: 5\nDisallow: /*\n"),
    ("p.example", "User-agent: *\nDisallow: /$\nAllow: /\n"),
    ("q.example", "User-agent: ClaudeBot\nCrawl-delay: 1\nUser-agent: PerplexityBot\nAllow: /\nDisallow: /\n"),
)

SITEMAPS = (
    ("a.example", "<urlset><url><loc> https://a.example/one</loc><lastmod>2025-11-02</lastmod></url><url><loc>https://a.example/%E4%B8%AD</loc><lastmod> 2026-01-05T00:00:00Z</lastmod></url><url><loc>https://a.example/a+b</loc></url></urlset>"),
    ("b.example", "<urlset><url><loc>https://b.example/中文</loc></url><url><loc>https://b.example/%zz</loc></url></urlset>"),
    ("c.example", ""),
)

# url, ua, status, content type, body, final_url, hops, error
FETCHES = (
    ("https://a.example/", "default", 200, "text/html", "<html></html>", "https://a.example/", 0, None),
    ("https://a.example/", "bot", 403, "text/html", "", "https://a.example/", 0, None),
    ("https://b.example/", "default", 200, "text/html", '<meta property="og:image" content="//cdn.example/b.png">' + PAGES[0][2], "https://b.example/", 1, None),
    ("https://b.example/", "bot", 0, None, "", "https://b.example/", 0, "timeout"),
    ("http://a.example", "default", 200, "text/html", "", "https://a.example/", 1, None),
    ("https://a.example", "default", 200, "text/html", "", "https://a.example/", 0, None),
    ("http://www.a.example", "default", 200, "text/html", "", "https://a.example/", 2, None),
    ("https://www.a.example", "default", 200, "text/html", "", "https://a.example/", 1, None),
    ("https://b.example", "default", 200, "text/html", "", "https://b.example/", 0, None),
    ("http://b.example", "default", 200, "text/html", "", "http://b.example/", 0, None),
    ("https://www.b.example", "default", 200, "text/html", "", "https://www.b.example/", 0, None),
    ("http://www.b.example", "default", 200, "text/html", "", "https://www.b.example/", 1, None),
    ("https://a.example/", "default", 500, "text/html", "worse", "https://a.example/", 3, "again"),
    ("https://a.example/robots.txt", "default", 200, "text/plain", "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nDisallow:\n", "https://a.example/robots.txt", 0, None),
    ("https://b.example/robots.txt", "default", 200, "text/plain", "User-agent: Bytespider\nUser-agent: Googlebot\nAllow: /\nUser-agent: *\nDisallow: /admin\n", "https://b.example/robots.txt", 0, None),
    ("https://d.example/robots.txt", "default", 503, "text/plain", "", "https://d.example/robots.txt", 0, None),
    ("https://a.example/sitemap.xml", "default", 200, "text/xml", SITEMAPS[0][1], "https://a.example/sitemap.xml", 0, None),
    ("https://b.example/sitemap.xml", "default", 200, "text/xml", "<urlset><url><loc>https://b.example/x</loc><lastmod>2024-12-31</lastmod></url></urlset>", "https://b.example/sitemap.xml", 0, None),
    ("https://b.example/x", "sitemap", 200, "text/html", "", "https://b.example/x", 0, None),
    ("https://a.example/llms.txt", "default", 200, "text/plain", "x", "https://a.example/llms.txt", 0, None),
    ("https://b.example/rss.xml", "default", 200, "text/xml", "x", "https://b.example/rss.xml", 0, None),
    ("https://d.example/shop/page?q=1", "default", 404, "text/html", '<html lang="en"><title>Shop</title><meta property="og:image" content="pic.png"><h1>Shop</h1></html>', "https://d.example/shop/page?q=1", 4, None),
    ("https://d.example/shop/pic.png", "default", 200, None, "p" * 1200, "https://d.example/shop/pic.png", 0, None),
    ("https://cdn.example/b.png", "default", 200, "image/png", "", "https://cdn.example/b.png", 0, None),
    ("https://a.example/one", "sitemap", 200, "text/html", "", "https://a.example/one", 0, None),
    ("https://a.example/a+b", "sitemap", 404, "text/html", "", "https://a.example/a+b", 0, None),
)
SITES = ((1, "https://a.example/"), (2, "https://b.example/"), (3, "https://WWW.c.example/x"), (4, "https://d.example/shop/page?q=1"))

RESULTS = (
    ("q1", 0, "Acme review", "https://www.zhihu.com/q/1"), ("q1", 1, "Other", "https://zhihu.com/q/2"), ("q1", 2, "Shop", "https://shop.acme.example:80/x"), ("q1", 3, "none", ""),
    ("q2", 0, "About Acme", "https://blog.example/acme"), ("q2", 1, None, "https://BLOG.example/2"), ("q3", 0, "x", "https://x.example/"),
)
WANTED = (("q1", "Acme", "www.acme.example:80", "ok"), ("q2", "Acme", "acme.example", "ok"), ("q3", "Acme", "acme.example", "ok"), ("q4", "", "", "ok"), ("q5", "Acme", "", "timeout"))

REQUESTS = (("r1", "robots，title faq"), ("r2", "page_type, nothing ,canonical,indexable\tsources unknown_too"), ("r3", " , "))

OBSERVED = (
    ("2026-01-01", "acme", "mention", "", 0.25, 20, "cli"), ("2026-02-01", "acme", "mention", None, 0.30, 25, ""), ("2026-01-01", "", "mention", "s", 0.1, 20, "cli"),
    (None, "acme", "rank", "s", 3.0, None, None), ("2026-01-02", "acme", None, "s", 1.0, 5, "x"), ("2026-01-03", "acme", "rank", "s", None, 5, "x"),
)
LINES = ('{"identity":"acme","kind":"mention","value":0.25,"n":20}', "", "not json", '{"identity":"acme","kind":"rank","value":"0.5","n":"7"}', "[1,2]", '{"identity":"b","value":null,"extra":1}', "  ", '"text"')
CHANGES = (
    ("0.0", "0.25", "20"), ("0.25", "0.0", "20"), ("0.20", "0.22", "20"), ("0.0", "0.25", "5"), ("0.10", "0.10", "20"), ("0.25", "0.30", "20"), ("0.1", "0.13", "20"),
    ("0.0", "0.04", "20"), ("x", "1", "20"), ("0", "0", "5"), ("0.2", "0.2", None), ("-0.5", "-0.2", "30"), ("0.5", "0.4", "19"), ("0.5", "0.4", "20"),
)
ANSWERS = (
    (1, "Q1", "P1", "joint", "positive", "accurate", ["f1"], "我们服务了超过 300 家企业，提升 25%。见 https://a.example/x，和 https://b.example/y)"),
    (2, "Q2", "P2", "citation_only", "neutral", "unverifiable", [], "x" * 100 + "Acme" + "y" * 200),
    (3, "Q2", "", "", None, None, ["f1", "f9"], "约 3.5 亿，或 12%；\n再 7 天"),
    (4, None, "P1", "sponsor", "negative", "wrong", None, None),
)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values_sql(rows, names: str) -> str:
    """A DuckDB relation of the rows."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({names}))"


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)
