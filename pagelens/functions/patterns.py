"""Fixed values that decide results: expressions, word lists and thresholds, in the syntax that Java and RE2 share."""

from __future__ import annotations

# White space and digits as Unicode has them, not as ASCII has them.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
ND = r"\p{Nd}"
# Runs of the same white space, in Java's own words, which are three times as fast there.
WIDE = r"(?U)[\s\x1c-\x1f]+"
EDGES = rf"^{WS}+|{WS}+\z"

# Markup that holds no visible text; the alternatives stand for one expression with a back reference.
HIDDEN = "(?is)<(?:" + "|".join(rf"{tag}[^>]*>.*?</{tag}>" for tag in ("script", "style", "noscript", "svg", "template")) + ")"
COMMENT, TAG = r"(?is)<!--.*?-->", r"(?s)<[^>]+>"
# Entities that are decoded, in this order, and no others.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))

LD_JSON = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
LD_TYPE = r'"@type":("(?:[^"\\]|\\.)*"|\[[^\]]*\])'
LD_NAME = r'"name":"([^"]+)"'
SAME_AS = r'"sameAs":(\[[^\]]*\]|"[^"]*")'
SAME_AS_URL = r'https?://[^"\s\]]+'
BLOB_URL = r'https?://[^"\s]+'
ENTITY_TYPES = ("Organization", "Person", "LocalBusiness", "Brand", "WebSite")

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r"""(?is)<meta[^>]+name=["']description["'][^>]*content=["'](.*?)["']"""
LANG = r"""(?is)<html[^>]+lang=["']([^"']+)"""
CANONICAL = r"""(?is)<link[^>]+rel=["']canonical["'][^>]*href=["']([^"']+)"""
META_ROBOTS = r"""(?is)<meta[^>]+name=["']robots["'][^>]*content=["']([^"']+)"""
NO_INDEX = r"(?i)noindex|none|nosnippet|noarchive"
OG_IMAGE = r"""(?is)<meta[^>]+property=["']og:image["'][^>]*content=["']([^"']+)"""
H1, H2, H3 = (rf"(?is)<h{n}[^>]*>(.*?)</h{n}>" for n in (1, 2, 3))
LISTS, TABLES, DEFINITIONS = r"(?is)<(?:ul|ol)[^>]*>", r"(?is)<table[^>]*>", r"(?is)<(?:dl|dt)[^>]*>"
IMG, ALT = r"(?is)<img\b[^>]*>", rf"""alt{WS}*={WS}*["'][^"']+["']"""
LINK_HOST = r"""href=["']https?://([^/"']+)"""

QUESTION = r"[？?]\z|吗|如何|怎么|为什么|哪些|是否|什么"
CONCLUSION = r"是|为|指|表|需要|应当|可以|不|无需"
FACT = rf"{ND}+(?:\.{ND}+)?%|{ND}{{4}}年|{ND}+\.{ND}+|{ND}{{2,}}"
DATE = rf"{ND}{{4}}-{ND}{{2}}-{ND}{{2}}|{ND}{{4}}年{ND}{{1,2}}月"
WORD = r"[一-鿿]|[a-zA-Z]+"
DEPENDENT = r"如上所述|如前所述|接着上文|见上一节|详见下文|上文提到"
QUOTE = r'[「『"][^「『"]{6,60}[」』"]'
STATISTIC = rf"{ND}+(?:\.{ND}+)?%|{ND}{{4}}年|第[一二三四五六七八九十百]+条"
ABOUT = r"我们是谁|关于我们|成立于|团队|About"
AUTHOR = rf"作者|签{WS}*名"
SOURCE = r"引用|出处|来源：|参考文献|条款号|第[一二三四五六七八九十]+条"
OPEN_DATA = r"/data/|\.json|\.csv|开放数据|下载"
CJK = r"[一-鿿]"

PLATFORMS = ("weibo.com", "zhihu.com", "juejin.cn", "csdn.net", "gitee.com", "bilibili.com", "xiaohongshu.com", "douban.com", "github.com", "baike.baidu.com")
AUTHORITIES = ("gov.cn", "samr.gov.cn", "openstd.samr.gov.cn", "miit.gov.cn", "cac.gov.cn", "std.samr.gov.cn", "edu.cn", "ac.cn", "cssn.cn", "cnki.net", "arxiv.org", "w3.org", "schema.org")
CITATION_BOTS = ("OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "ClaudeBot", "Claude-User", "Bytespider", "Baiduspider", "Baiduspider-render", "Sogou web spider", "360Spider", "YisouSpider", "PetalBot", "Googlebot")
TRAINING_BOTS = ("GPTBot", "CCBot", "anthropic-ai", "Google-Extended", "Applebot-Extended")
ACCESS_FILES = ("/robots.txt", "/sitemap.xml", "/llms.txt", "/ai.txt", "/indexnow.json", "/rss.xml", "/feed.xml")

LOC, LASTMOD = rf"<loc>{WS}*([^<\s]+)", rf"<lastmod>{WS}*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"
BARE_DISALLOW = rf"(?m)^{WS}*Disallow:{WS}*/{WS}*$"
AUTHORITY_PART = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH_PART = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
ARTICLE, PRODUCT = r"/(?:blog|articles?|posts?|answers?|knowledge)", r"/(?:product|service|pricing|tools?)"

CITED_URL = rf"""https?://[^\s\x{{a0}}\x{{3000}}，。）)】\]"']+"""
CLAIMED_NUMBER = rf"(?:{ND}+(?:\.{ND}+)?%|{ND}+(?:\.{ND}+)?{WS}*(?:万|亿|个|家|天|倍))"
CLAIM = rf"[^。；\n]{{0,30}}?{CLAIMED_NUMBER}"
ROLE_WEIGHTS = {"independent": 1.0, "joint": 0.6, "citation_only": 0.25, "none": 0.0}
GRADES = ((85, "A"), (70, "B"), (55, "C"), (40, "D"))
POINTS = {"ok": 1.0, "warn": 0.5, "fail": 0.0}
MIN_N, RELATIVE, ABSOLUTE = 20, 0.20, 0.05
