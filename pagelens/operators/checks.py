"""The checks: one row of data each, read by both the page audit and the site audit.

``fail`` and ``warn`` are SQL conditions over the columns of signals, tried in this order; what meets neither is
ok, or "info" for a check that only informs. ``when`` says for which pages a check exists at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    key: str
    layer: str
    weight: int
    fail: str = "false"
    warn: str = "false"
    title: str = ""
    advice: str = ""
    info: bool = False
    when: str = "true"
    site: bool = False


# Conditions, thresholds and weights of all checks, in the order in which they are reported. The order
# counts: among checks of one weight and status it decides which are named first.
CHECKS = (
    Check("status", "crawl", 3, "home_error IS NOT NULL OR home_status = 0 OR home_status >= 400", "false", "The page can be fetched", "Answer with 200", site=True),
    Check("redirects", "crawl", 2, "hops > 2", "hops > 0", "Few redirects", "Link the final address", site=True),
    Check("robots", "crawl", 3, "robots_status = 200 AND n_denied > 0", "robots_status <> 200 OR n_declared = 0", "robots.txt lets citation bots in", "Allow them by name", site=True),
    Check("bot_access", "crawl", 3, "bot_status <> 0 AND bot_status <> home_status", "false", "Bots get what browsers get", "Let bots through at the edge", site=True),
    Check("text_present", "crawl", 3, "n_text < 200", "n_text < 600", "Text is in the HTML", "Render the main content on the server"),
    Check("ascii_slugs", "crawl", 2, "n_cjk_slugs > 0", "false", "Plain addresses", "Use ASCII slugs", site=True),
    Check("title", "parse", 3, "title_len = 0", "title_len > 90", "A title of fitting length", "Give the page its own title of 30 to 60 characters"),
    Check("description", "parse", 3, "description_len = 0", "description_len < 40", "A full meta description", "Describe the page in 60 to 120 characters"),
    Check("headings", "parse", 2, "n_h1 = 0", "n_h1 <> 1 OR n_h2 + n_h3 < 3", "Headings in layers", "Use one h1, and h2 and h3 for the parts"),
    Check("structured_data", "parse", 3, "n_ld = 0", "NOT has_organization", "Structured data with an organization", "Add JSON-LD, Organization first"),
    Check("language", "parse", 2, "false", "NOT has_lang", "Declared language", "Set lang on the html element"),
    Check("canonical", "parse", 2, "false", "NOT has_canonical", "Canonical link", "Link the canonical address"),
    Check("questions", "cite", 3, "false", "n_questions < 2", "Headings that ask what users ask", "Word subheadings as questions"),
    Check("conclusion_first", "cite", 3, "false", "NOT has_conclusion", "The first lines conclude", "Start with the answer"),
    Check("facts", "cite", 2, "false", "n_facts < 5", "Numbers that can be checked", "Add figures, dates and clause numbers"),
    Check("faq", "cite", 2, "false", "NOT has_faq", "FAQ markup", "Mark up real questions as FAQPage"),
    Check("dated", "cite", 2, "false", "NOT has_date", "A visible or structured date", "Show when the page was last changed"),
    Check("entity", "entity", 2, "false", "NOT has_organization OR n_ld_names = 0", "A declared entity", "Declare the organization and its name"),
    Check("same_as", "entity", 2, "false", "n_same_as < 2", "Links to the entity's profiles", "List profiles in sameAs"),
    Check("about", "entity", 2, "false", "NOT has_about", "A passage on who is behind the page", "Say in a few lines who you are"),
    Check("sitemap", "reach", 3, "NOT (sitemap_status = 200 AND n_locs > 0)", "false", "A sitemap with entries", "Publish sitemap.xml", site=True),
    Check("sitemap_sample", "reach", 3, "n_bad_locs > 0", "false", "Sitemap entries load", "Remove dead entries", site=True),
    Check("llms_txt", "reach", 0, title="llms.txt, for information", info=True, site=True),
    Check("feed", "reach", 2, "false", "rss_status <> 200", "A feed", "Publish rss.xml", site=True),
    Check("author", "trust", 2, "false", "NOT has_author", "A named author", "Name the author"),
    Check("sources", "trust", 3, "false", "NOT has_source", "Traceable sources", "Say where each main claim comes from"),
    Check("open_data", "trust", 2, "false", "NOT has_open_data", "Open data", "Offer tables or models for download"),
    Check("indexable", "crawl", 3, "n_no_index > 0", "false", "Not excluded from indexes", "Remove noindex and nosnippet"),
    Check("robots_health", "crawl", 3, "robots_status >= 500 OR (robots_status = 200 AND robots_closed)", "false", "robots.txt is sound", "Mend it, or drop the ban on everything", site=True),
    Check("host_variants", "parse", 2, "false", "NOT variants_agree", "One canonical host", "Redirect all variants to one", site=True),
    Check("og_image", "parse", 1, "false", "NOT og_image_loads", "The preview image loads", "Set og:image to a public image", site=True),
    Check("structures", "cite", 2, "false", "n_lists + n_tables + n_definitions < 3", "Lists and tables", "Turn key points into lists or tables"),
    Check("substance", "cite", 2, "text_ratio < 0.03 OR n_words < 200", "text_ratio < 0.06 OR n_words < 600", "Enough text for its markup", "Write more, or move boilerplate out of the page"),
    Check("self_contained", "cite", 2, "false", "n_dependent > 0", "Passages stand alone", "Drop phrases that point elsewhere in the text"),
    Check("image_alt", "cite", 1, "false", "1 - n_img_bare / n_img < 0.8", "Images have text", "Add alt texts", when="n_img > 0"),
    Check("entity_name", "entity", 2, "false", "n_entity_names = 0 OR n_entity_names > 2 OR (n_entity_names = 2 AND NOT names_nested)", "One name for the entity", "Use one name, or a short and a full form of it"),
    Check("platforms", "entity", 2, "false", "n_platforms < 3", "Profiles on known platforms", "Link profiles on the platforms that answers draw on"),
    Check("citation_strength", "cite", 2, "false", "2 * cast(n_authorities > 0 AS int) + cast(n_quotes >= 2 AS int) + cast(n_statistics >= 5 AS int) < 3", "Authorities, quotes and statistics", "Cite authorities, quote people, give statistics"),
    Check("access_files", "reach", 0, title="Which access files exist, for information", info=True, site=True),
    Check("freshness", "reach", 2, "false", "last_year IS NULL OR last_year < fresh_year", "Recent changes", "Keep lastmod up to date", site=True),
    Check("page_type", "trust", 0, title="Type of the page", info=True),
    Check("manual_review", "trust", 0, title="Left to people: experience and authority, depth, differences between platforms", info=True),
)
#: Those that need the page alone, and those that need other fetches of the site.
PAGE, SITE = tuple(c for c in CHECKS if not c.site), tuple(c for c in CHECKS if c.site)

LAYERS = ("crawl", "parse", "cite", "entity", "reach", "trust")


def status_sql(check: Check) -> str:
    if check.info:
        return "CASE WHEN llms_status = 200 THEN 'ok' ELSE 'info' END" if check.key == "llms_txt" else "'info'"
    return f"CASE WHEN {check.fail} THEN 'fail' WHEN {check.warn} THEN 'warn' ELSE 'ok' END"


def results(signals: DataFrame, checks: tuple[Check, ...], key: str = "page_id") -> DataFrame:
    """(key, check_pos, check_id, layer, weight, status): one scan of the signals, one generator for all checks.
    check_pos is a check's place among all of them."""
    rows = ", ".join(f"CASE WHEN {c.when} THEN struct({CHECKS.index(c)} AS check_pos, '{c.key}' AS check_id, '{c.layer}' AS layer, {c.weight} AS weight, {status_sql(c)} AS status) END" for c in checks)
    made = signals.select(key, F.explode(F.expr(f"array({rows})")).alias("c"))
    return made.where("c IS NOT NULL").select(key, "c.*")


def results_sql(signals: str, checks: tuple[Check, ...], key: str = "page_id") -> str:
    """The same as DuckDB SQL over a relation of signals."""
    return " UNION ALL ".join(f"SELECT {key}, {CHECKS.index(c)} AS check_pos, '{c.key}' AS check_id, '{c.layer}' AS layer, {c.weight} AS weight, {status_sql(c)} AS status FROM {signals} WHERE {c.when}" for c in checks)
