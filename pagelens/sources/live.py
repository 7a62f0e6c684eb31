"""Optional live sources as Spark data sources: fetches, a partition for each host, and search results, one for each
question. Off unless registered.

spark.dataSource.register(LiveFetch), then spark.read.format("live_fetch").option("urls", "...").load(); its bodies are
bytes, which ``operators.site.from_live`` makes text for the audit. Redirects are followed here, one by one, and each
target is checked before it is fetched, from the very address that was checked.

spark.dataSource.register(LiveSearch), then spark.read.format("live_search").option("endpoint", "https://...").option(
"questions", "one\ntwo").load(), for an endpoint that answers ?q=...&format=json with {"results": [{"title", "url"}]}.
"""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import time
import urllib.parse
import zlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Seconds for a fetch, bytes of a body, hops; what bots and browsers call themselves.
TIMEOUT, MOST_BYTES, MOST_HOPS = 12, 3 << 20, 6
AGENTS = {"default": "Mozilla/5.0 (compatible; pagelens)", "bot": "Mozilla/5.0 (compatible; GPTBot/1.2)", "sitemap": "Mozilla/5.0 (compatible; Baiduspider-test)"}


def checked(url: str) -> tuple[str | None, str | None]:
    """(why a URL may not be fetched, None) or (None, the address to connect to): every address of its host is public."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https"):
        return "scheme", None
    if "." not in (parts.hostname or ""):
        return "host", None
    try:
        addresses = sorted({a[4][0] for a in socket.getaddrinfo(parts.hostname, None)})
    except OSError:
        return "unknown host", None
    return (None, addresses[0]) if addresses and all(ipaddress.ip_address(a).is_global for a in addresses) else ("address", None)


def guard(url: str) -> str | None:
    """Why a URL may not be fetched, or None."""
    return checked(url)[0]


def request(url: str, headers: dict[str, str], timeout: float, most: int, address: str | None = None) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, at most ``most`` bytes of the body) of one GET, redirects not followed and no proxy asked.

    With ``address`` that is where the connection goes, whatever the host's name resolves to by now; certificate and Host
    header are still those of the name.
    """
    parts = urllib.parse.urlsplit(url)
    link = (http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection)(parts.hostname, parts.port, timeout=timeout)
    if address is not None:
        link._create_connection = lambda at, *args, **kwargs: socket.create_connection((address, at[1]), *args, **kwargs)
    place = urllib.parse.quote(parts.path or "/", safe="/%:@!$&'()*+,;=~") + (f"?{urllib.parse.quote(parts.query, safe='/%:@!$&()*+,;=~?')}" if parts.query else "")
    try:
        link.request("GET", place, headers=headers)
        answer = link.getresponse()
        return answer.status, dict(answer.getheaders()), answer.read(most)
    finally:
        link.close()


def decompressed(body: bytes, encoding: str, most: int = MOST_BYTES) -> bytes:
    """At most ``most`` bytes; of a body that is cut off, what its beginning holds."""
    if encoding == "gzip":
        return zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(body, most)
    if encoding == "deflate":
        try:
            return zlib.decompressobj().decompress(body, most)
        except zlib.error:  # without a header, as some servers send it
            return zlib.decompressobj(-zlib.MAX_WBITS).decompress(body, most)
    return body[:most]


def _header(headers: dict[str, str], name: str) -> str:
    return next((v for k, v in headers.items() if k.lower() == name), "")


def fetch(url: str, ua: str = "default") -> tuple:
    """A row of fetches; failures are rows with status 0 and an error. Each hop goes to the address that was checked."""
    at, asked = url, {"User-Agent": AGENTS.get(ua, ua), "Accept-Encoding": "gzip"}
    for hops in range(MOST_HOPS + 1):
        why, address = checked(at)
        if why:
            return url, ua, 0, {}, b"", at, hops, why
        try:
            status, headers, body = request(at, asked, TIMEOUT, MOST_BYTES, address)
            target = _header(headers, "location") if status in (301, 302, 303, 307, 308) else ""
            if not target:
                return url, ua, status, headers, decompressed(body, _header(headers, "content-encoding").lower()), at, hops, None
            at = urllib.parse.urljoin(at, target)
        except Exception as e:
            return url, ua, 0, {}, b"", at, hops, str(e)[:160]
    return url, ua, 0, {}, b"", at, MOST_HOPS, "too many redirects"


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls, self.agents = options.get("urls", "").split(), options.get("agents", "default").split()

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = defaultdict(list)
        for url in self.urls:
            hosts[urllib.parse.urlsplit(url).netloc].append(url)
        return [_Host(u) for u in hosts.values()]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for url in partition.urls:
            for ua in self.agents:
                yield fetch(url, ua)


class LiveFetch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_fetch"

    def schema(self) -> str:
        return "url string, ua string, status int, headers map<string,string>, body binary, final_url string, hops int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


# Seconds an endpoint gets for an answer, tries, the least pause between two, results that count.
SEARCH_TIMEOUT, ATTEMPTS, PAUSE, MOST_RESULTS = 25, 3, 1.5, 20
RESULT = "question string, pos int, title string, url string, source_status string"


def _answered(body: bytes) -> list[dict]:
    """The results in an endpoint's JSON; anything that isn't an object with a list of them is an error."""
    results = json.loads(body.decode("utf-8", "replace")).get("results")
    return [r for r in results or [] if isinstance(r, dict)]


def _paced(tries: int, pause: float) -> Iterator[int]:
    """Numbers of tries, each but the first after a longer pause than the one before."""
    yield 0
    for n in range(1, tries):
        time.sleep(n * pause)
        yield n


def search(question: str, endpoint: str, engines: str = "", pause: float = PAUSE, ask=None) -> list[tuple]:
    """Rows RESULT of one question. Failures and empty answers are tried again, with longer and longer pauses; what
    stays without an answer is one row without a URL, whose source_status says why, so that it counts as an unreachable
    source and not as an empty pool."""
    get = ask or (lambda u: request(u, {"Accept": "application/json"}, SEARCH_TIMEOUT, MOST_BYTES)[2])
    wanted = {"q": question, "format": "json", "engines": engines}
    url = f"{endpoint.rstrip('/')}/search?{urllib.parse.urlencode({k: v for k, v in wanted.items() if v})}"
    why = "ok"
    for _ in _paced(ATTEMPTS, pause):
        try:
            found, why = _answered(get(url)), "ok"
        except Exception as e:
            found, why = [], f"failed: {str(e)[:120]}"
        if found:
            return [(question, place, r.get("title"), r.get("url"), why) for place, r in enumerate(found[:MOST_RESULTS])]
    return [(question, 0, None, None, why)]


class _Question(InputPartition):
    def __init__(self, question: str):
        self.question = question


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.questions, self.endpoint, self.engines = options.get("questions", "").split("\n"), options.get("endpoint", ""), options.get("engines", "")

    def partitions(self) -> list[InputPartition]:
        return [_Question(q.strip()) for q in self.questions if q.strip()]

    def read(self, partition: _Question) -> Iterator[tuple]:
        yield from search(partition.question, self.endpoint, self.engines)


class LiveSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_search"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)
