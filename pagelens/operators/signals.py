"""One wide row of evidence for each page: everything the page checks look at, from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import patterns as P
from pagelens.functions import urls
from pagelens.functions.text import all_of, count_of, entity_names, first_of, ld_of, ld_types, same_as, strip, visible_text


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def spread(pages: DataFrame) -> DataFrame:
    """The pages over all cores where they come in fewer files than that: reading them apart costs more than moving them."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if len(pages.inputFiles()) < cores else pages


def page_signals(pages: DataFrame, key: str = "page_id", robots_header: Column | None = None) -> DataFrame:
    """Signals of pages (key, url, html); ``robots_header`` is a column with X-Robots-Tag, if there is one.

    A null page is an empty one. The text is made in a projection of its own, so that it is made once. JSON-LD that repeats a
    key counts with its last value, as JSON readers have it; that is a setting of the session, which is made here.
    """
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    header = robots_header if robots_header is not None else F.lit(None).cast("string")
    base = spread(pages).select(key, F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), header.alias("robots_header"))
    html = F.col("html")
    base = base.select("*", visible_text(html).alias("text"), all_of(html, P.LD_JSON, 1).alias("raw"), all_of(html, P.H2, 1).alias("h2"), all_of(html, P.H3, 1).alias("h3"), all_of(html, P.IMG).alias("img"), all_of(html, P.LINK_HOST, 1).alias("hosts"))
    base = base.select("*", ld_of(F.col("raw")).alias("ld")).select("*", entity_names(F.col("ld")).alias("names"), ld_types(F.col("ld")).alias("types"), F.filter("ld", lambda b: b.isNotNull()).alias("good"), F.left("text", F.lit(300)).alias("opening"))
    # What a block that doesn't parse holds of URLs in its first 120 characters counts too.
    broken = F.filter(F.zip_with("raw", "ld", lambda r, b: F.when(b.isNull(), F.left(r, F.lit(120)))), lambda r: r.isNotNull())
    base = base.select("*", all_of(F.array_join(F.concat("good", broken), " "), P.BLOB_URL).alias("links"))
    text, ld, names, good, links, opening = (F.col(c) for c in ("text", "ld", "names", "good", "links", "opening"))
    plain = lambda h: F.regexp_replace(h, r"<[^>]+>", "")
    trusted = F.filter(F.array_distinct("hosts"), lambda h: F.exists(F.array(*map(F.lit, P.AUTHORITIES)), lambda a: h.endswith(a) | F.contains(h, F.concat(F.lit("."), a))))
    no_index = F.filter(F.concat(all_of(html, P.META_ROBOTS, 1), F.array(F.coalesce("robots_header", F.lit("")))), lambda v: v.rlike(P.NO_INDEX))
    return base.select(
        key, "url", F.length(html).cast("long").alias("n_html"), F.length(text).cast("long").alias("n_text"),
        F.length(strip(first_of(html, P.TITLE))).cast("long").alias("title_len"), F.length(strip(first_of(html, P.DESCRIPTION))).cast("long").alias("description_len"),
        count_of(html, P.H1).alias("n_h1"), _size(F.col("h2")).alias("n_h2"), _size(F.col("h3")).alias("n_h3"),
        _size(ld).alias("n_ld"), F.array_contains("types", "Organization").alias("has_organization"), F.array_contains("types", "FAQPage").alias("has_faq"),
        (first_of(html, P.LANG) != "").alias("has_lang"), (first_of(html, P.CANONICAL) != "").alias("has_canonical"),
        _size(F.filter(F.concat("h2", "h3"), lambda h: plain(h).rlike(P.QUESTION))).alias("n_questions"),
        (opening.rlike(P.CONCLUSION) & (F.length(opening) > 80)).alias("has_conclusion"), count_of(text, P.FACT).alias("n_facts"),
        (text.rlike(P.DATE) | F.exists(good, lambda b: b.startswith("{") & b.rlike("dateModified|datePublished"))).alias("has_date"),
        (F.exists(good, lambda b: b.rlike('"(?:Person|author)"')) | text.rlike(P.AUTHOR)).alias("has_author"), text.rlike(P.SOURCE).alias("has_source"), text.rlike(P.OPEN_DATA).alias("has_open_data"),
        _size(F.flatten(F.transform(good, lambda b: all_of(b, P.LD_NAME, 1)))).alias("n_ld_names"), _size(same_as(ld)).alias("n_same_as"), text.rlike(P.ABOUT).alias("has_about"),
        _size(no_index).alias("n_no_index"), count_of(html, P.LISTS).alias("n_lists"), count_of(html, P.TABLES).alias("n_tables"), count_of(html, P.DEFINITIONS).alias("n_definitions"),
        (F.length(text) / F.greatest(F.length(html), F.lit(1))).alias("text_ratio"), count_of(text, P.WORD).alias("n_words"), count_of(text, P.DEPENDENT).alias("n_dependent"),
        _size(F.col("img")).alias("n_img"), _size(F.filter("img", lambda i: ~i.rlike(P.ALT))).alias("n_img_bare"),
        _size(names).alias("n_entity_names"), ((F.size(names) == 2) & (F.contains(F.get(names, 0), F.get(names, 1)) | F.contains(F.get(names, 1), F.get(names, 0)))).alias("names_nested"),
        _size(F.filter(F.array(*map(F.lit, P.PLATFORMS)), lambda p: F.exists(links, lambda u: F.contains(u, p)))).alias("n_platforms"),
        _size(trusted).alias("n_authorities"), count_of(text, P.QUOTE).alias("n_quotes"), count_of(text, P.STATISTIC).alias("n_statistics"), urls.page_type(F.col("url")).alias("page_type"),
    ).withColumn("names_nested", F.coalesce("names_nested", F.lit(False)))


def signals_sql(relation: str = "pages", key: str = "page_id") -> str:
    """DuckDB SQL for the signals that tables of plain pages can show; written apart from the Spark expressions."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    count = lambda t, p: f"len(regexp_extract_all({t}, {q(p)}))"
    has = lambda t, p: f"regexp_matches({t}, {q(p)})"
    strip_ = lambda t: f"regexp_replace({t}, {q(P.EDGES)}, '', 'g')"
    text = f"regexp_replace(html, {q(P.HIDDEN)}, ' ', 'g')"
    for p in (P.COMMENT, P.TAG):
        text = f"regexp_replace({text}, {q(p)}, ' ', 'g')"
    for entity, char in P.ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(char)})"
    text = f"trim(regexp_replace({text}, {q(P.WS + '+')}, ' ', 'g'))"
    platforms = "[" + ", ".join(q(p) for p in P.PLATFORMS) + "]"
    authorities = "[" + ", ".join(q(a) for a in P.AUTHORITIES) + "]"
    return f"""
SELECT p.{key}, url, length(html) AS n_html, length(text) AS n_text,
 length({strip_(f"regexp_extract(html, {q(P.TITLE)}, 1)")}) AS title_len, length({strip_(f"regexp_extract(html, {q(P.DESCRIPTION)}, 1)")}) AS description_len,
 {count("html", P.H1)} AS n_h1, len(h2) AS n_h2, len(h3) AS n_h3, len(raw) AS n_ld,
 coalesce(list_contains(types, 'Organization'), false) AS has_organization, coalesce(list_contains(types, 'FAQPage'), false) AS has_faq,
 regexp_extract(html, {q(P.LANG)}, 1) <> '' AS has_lang, regexp_extract(html, {q(P.CANONICAL)}, 1) <> '' AS has_canonical,
 len(list_filter(list_concat(h2, h3), lambda h: regexp_matches(regexp_replace(h, '<[^>]+>', '', 'g'), {q(P.QUESTION)}))) AS n_questions,
 {has("text[1:300]", P.CONCLUSION)} AND length(text[1:300]) > 80 AS has_conclusion, {count("text", P.FACT)} AS n_facts,
 {has("text", P.DATE)} OR len(list_filter(ld, lambda b: json_type(b) = 'OBJECT' AND regexp_matches(b, 'dateModified|datePublished'))) > 0 AS has_date,
 len(list_filter(ld, lambda b: regexp_matches(b, '"(?:Person|author)"'))) > 0 OR {has("text", P.AUTHOR)} AS has_author, {has("text", P.SOURCE)} AS has_source, {has("text", P.OPEN_DATA)} AS has_open_data,
 len(flatten(list_transform(ld, lambda b: regexp_extract_all(b, {q(P.LD_NAME)})))) AS n_ld_names,
 len(flatten(list_transform(flatten(list_transform(ld, lambda b: regexp_extract_all(b, {q(P.SAME_AS)}))), lambda s: regexp_extract_all(s, {q(P.SAME_AS_URL)})))) AS n_same_as,
 {has("text", P.ABOUT)} AS has_about,
 len(list_filter(regexp_extract_all(html, {q(P.META_ROBOTS)}, 1), lambda v: regexp_matches(v, {q(P.NO_INDEX)}))) AS n_no_index,
 {count("html", P.LISTS)} AS n_lists, {count("html", P.TABLES)} AS n_tables, {count("html", P.DEFINITIONS)} AS n_definitions,
 length(text) / greatest(length(html), 1) AS text_ratio, {count("text", P.WORD)} AS n_words, {count("text", P.DEPENDENT)} AS n_dependent,
 len(img) AS n_img, len(list_filter(img, lambda i: NOT regexp_matches(i, {q(P.ALT)}))) AS n_img_bare,
 coalesce(len(names), 0) AS n_entity_names, coalesce(len(names) = 2 AND (contains(names[1], names[2]) OR contains(names[2], names[1])), false) AS names_nested,
 len(list_filter({platforms}, lambda x: len(list_filter(links, lambda u: contains(u, x))) > 0)) AS n_platforms,
 len(list_filter(list_distinct(regexp_extract_all(html, {q(P.LINK_HOST)}, 1)), lambda h: len(list_filter({authorities}, lambda a: ends_with(h, a) OR contains(h, '.' || a))) > 0)) AS n_authorities,
 {count("text", P.QUOTE)} AS n_quotes, {count("text", P.STATISTIC)} AS n_statistics,
 CASE WHEN {has("url", P.ARTICLE)} THEN 'article' WHEN {has("url", P.PRODUCT)} THEN 'product' WHEN regexp_extract(url, {q(P.PATH_PART)}, 1) IN ('', '/') THEN 'home' ELSE 'other' END AS page_type
FROM (SELECT *, regexp_extract_all(array_to_string(list_concat(ld, list_transform(list_filter(raw, lambda b: NOT json_valid(b)), lambda b: b[1:120])), ' '), {q(P.BLOB_URL)}) AS links
 FROM (SELECT *, list_transform(list_filter(raw, lambda b: json_valid(b)), lambda b: cast(json(b) AS varchar)) AS ld,
  {text} AS text, regexp_extract_all(html, {q(P.H2)}, 1) AS h2, regexp_extract_all(html, {q(P.H3)}, 1) AS h3, regexp_extract_all(html, {q(P.IMG)}) AS img
  FROM (SELECT {key}, coalesce(url, '') AS url, coalesce(html, '') AS html, regexp_extract_all(coalesce(html, ''), {q(P.LD_JSON)}, 1) AS raw FROM {relation}))) p
LEFT JOIN (SELECT {key}, coalesce(list(DISTINCT t) FILTER (t IS NOT NULL), []) AS types, coalesce(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), []) AS names FROM (
  SELECT {key}, unnest(CASE WHEN kind = 'VARCHAR' THEN [typed ->> '$'] WHEN kind = 'ARRAY' THEN cast(typed AS varchar[]) ELSE cast([NULL] AS varchar[]) END) AS t,
   CASE WHEN json_type(value, '$.name') = 'VARCHAR' AND len(list_intersect(CASE WHEN kind = 'VARCHAR' THEN [typed ->> '$'] WHEN kind = 'ARRAY' THEN cast(typed AS varchar[]) ELSE cast([] AS varchar[]) END, {list(P.ENTITY_TYPES)})) > 0 THEN trim(value ->> '$.name') END AS name
  FROM (SELECT n.{key}, n.value, n.value -> '$."@type"' AS typed, json_type(n.value, '$."@type"') AS kind FROM (
    SELECT b.{key}, t.value, t.type FROM (SELECT {key}, unnest(list_filter(regexp_extract_all(coalesce(html, ''), {q(P.LD_JSON)}, 1), lambda b: json_valid(b))) AS j FROM {relation}) b, json_tree(b.j) t) n WHERE n.type = 'OBJECT')) GROUP BY {key}) n USING ({key})"""
