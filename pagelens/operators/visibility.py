"""How visible a brand is in sampled answers: five indicators, role-weighted scores, excerpts and claims.

Samples have question, platform, run, answer, role, sentiment, facts, facts_found, as_of and ``pos``, their place in
the study; missing roles count as none, missing sentiments as neutral. An unknown role is a mention of weight 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import patterns as P
from pagelens.functions.text import all_of, strip
from pagelens.operators import site


def _given(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def role_weight() -> Column:
    out = F.lit(0.0)
    for role, weight in P.ROLE_WEIGHTS.items():
        out = F.when(_given("role", "none") == role, weight).otherwise(out)
    return out


MENTION = "coalesce(nullif(role, ''), 'none') <> 'none'"


def _share(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part.cast("double"), whole) * 100, 1)


def indicators(samples: DataFrame, n_fact_points: int, baseline_negative: int | None) -> DataFrame:
    """One row: coverage, mention_share, accuracy, positive_share, negative_reduction, role_score, n.

    Facts found are counted over all samples; null where the denominator is 0, but for a positive share without
    mentions, which is 0.
    """
    mention, tone = F.expr(MENTION), _given("sentiment", "neutral")
    facts = samples.select(F.explode("facts_found").alias("fact")).agg(F.count_distinct("fact").alias("n_found"))
    sums = samples.agg(
        F.count("*").alias("n"), F.count_if(mention).alias("mentions"), F.count_if(mention & (tone == "positive")).alias("positive"), F.count_if(mention & (tone == "negative")).alias("negative"),
        F.count_if(mention & (F.col("facts") == "accurate")).alias("accurate"), F.count_if(mention & F.col("facts").isin("accurate", "partial", "wrong")).alias("judged"), F.sum(role_weight()).alias("role_sum"),
    )
    base = F.lit(baseline_negative).cast("long")
    return sums.crossJoin(facts).select(  # one row by one row
        "n", _share(F.col("n_found"), F.lit(n_fact_points)).alias("coverage"), _share(F.col("mentions"), F.col("n")).alias("mention_share"), _share(F.col("accurate"), F.col("judged")).alias("accuracy"),
        F.coalesce(_share(F.col("positive"), F.col("mentions")), F.lit(0.0)).alias("positive_share"), _share(base - F.col("negative"), base).alias("negative_reduction"), _share(F.col("role_sum"), F.col("n")).alias("role_score"),
    )


def by_platform(samples: DataFrame) -> DataFrame:
    grouped = samples.groupBy(_given("platform", "unlabelled").alias("platform")).agg(F.count("*").alias("n"), F.count_if(F.expr(MENTION)).alias("mentions"), F.sum(role_weight()).alias("role_sum"))
    return grouped.select("platform", "n", "mentions", _share(F.col("mentions"), F.col("n")).alias("mention_share"), _share(F.col("role_sum"), F.col("n")).alias("role_score"))


def runs_per_question(samples: DataFrame) -> DataFrame:
    runs = samples.groupBy(_given("question", "-").alias("question")).count()
    return runs.agg(F.coalesce(F.min("count"), F.lit(0)).alias("min_runs"), F.coalesce(F.max("count"), F.lit(0)).alias("max_runs"), F.count("*").alias("questions"))


def excerpts(samples: DataFrame, brand: str, most: int = 8) -> DataFrame:
    """The first mentions with what stands around the brand, or the answer's beginning."""
    answer = F.coalesce("answer", F.lit(""))
    at = F.instr(answer, brand) if brand else F.lit(0)
    around = F.when(at > 0, F.substring(answer, F.greatest(at - 60, F.lit(1)), at + 140 - F.greatest(at - 60, F.lit(1)))).otherwise(F.left(answer, F.lit(160)))
    return samples.where(MENTION).orderBy("pos").limit(most).select("pos", "question", "platform", "role", strip(around).alias("excerpt"))


def cited_urls(samples: DataFrame, most: int = 5) -> DataFrame:
    """(pos, place, url): the first URLs of each answer."""
    return samples.select("pos", F.posexplode(F.slice(all_of(F.col("answer"), P.CITED_URL), 1, most)).alias("place", "url"))


def citation_checks(samples: DataFrame, fetches: DataFrame) -> DataFrame:
    """Which cited URLs can be reached: of a URL's fetches the outcome that browsers got counts, the best if there are several."""
    known = site.outcomes(fetches).where("ua = 'default'").select("url", "status")
    status = F.coalesce("status", F.lit(0))
    return cited_urls(samples).join(known, "url", "left").select("pos", "place", "url", status.alias("status"), F.when(status == 200, "verified").when(status > 0, "unreachable").otherwise("error").alias("verdict"))


def claims(samples: DataFrame) -> DataFrame:
    """(pos, place, claim): numbers with what stands before them, none of them verified.

    Only answers with such a number are searched for what stands before it, which takes a try for each character.
    """
    some = samples.where(F.col("answer").rlike(P.CLAIMED_NUMBER))
    found = some.select("pos", F.posexplode(all_of(F.col("answer"), P.CLAIM)).alias("place", "claim"))
    return found.select("pos", "place", strip(F.col("claim")).alias("claim")).where("length(claim) BETWEEN 1 AND 59")
