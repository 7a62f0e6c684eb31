"""Column functions over URLs. Only the generic syntax is read, so odd URLs give parts instead of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions import patterns as P


def authority(url: Column) -> Column:
    return F.regexp_extract(url, P.AUTHORITY_PART, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, P.PATH_PART, 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower case, without any "www.", port kept."""
    return F.replace(F.lower(authority(url)), F.lit("www."), F.lit(""))


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def resolved(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute, protocol-relative, from the root, or from the page's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    folder = F.concat(origin(base), F.coalesce(F.nullif(F.regexp_extract(path(base), r"^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin(base), link))
        .otherwise(F.concat(folder, link))
    )


def without_dots(path: Column) -> Column:
    """A path without "." and ".." segments; ".." at the root stays there."""
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s)))
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page, as RFC 3986 has it: every kind of relative reference, no dot segments, no fragment."""
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    full = F.when(link.startswith("?"), F.concat(no_query, link)).otherwise(resolved(base, link))
    full = F.regexp_extract(full, r"^([^#]*)", 1)
    rest = F.substring(full, F.length(origin(full)) + 1, F.length(full))
    place, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*(.*)$", 1)
    return F.when(origin(full) == "", full).otherwise(F.concat(origin(full), without_dots(place), query))


def has_cjk(url: Column) -> Column:
    """Percent-decoded, with + left alone; where decoding fails the URL itself is tested."""
    plain = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    return F.coalesce(plain, url).rlike(P.CJK)


def page_type(url: Column) -> Column:
    return F.when(url.rlike(P.ARTICLE), "article").when(url.rlike(P.PRODUCT), "product").when(path(url).isin("", "/"), "home").otherwise("other")


def fetchable(url: Column, address: Column) -> Column:
    """May this URL be fetched? http or https, a host with a dot, and an address that is public."""
    v4 = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.(?:0|2)\.|198\.(?:1[89]|51\.100)\.|203\.0\.113\.|2(?:2[4-9]|[3-5][0-9])\.)"
    v6 = r"(?i)^(?:::1?$|f[cd]|fe[89ab]|ff|2001:db8:|::ffff:)"
    return url.rlike(r"(?i)^https?://") & authority(url).contains(".") & address.isNotNull() & ~address.rlike(v4) & ~address.rlike(v6)
