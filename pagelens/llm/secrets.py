"""Secret scan: known patterns, and a battery of randomness tests over every long token.

A token (a run of 16 or more characters of the base-64 alphabets) gets the smallest encoding that fits it. Three
tests ask whether its symbols look drawn at random from that encoding's alphabet, each with a null hypothesis of its
own: chi-squared (null: symbols coincide ``spread`` times as often as uniform ones, as in text), runs above and below
the alphabet's middle, and correlation of neighbours (nulls: an effect of DEPENDENCE or more either way, as in ordered
or alternating symbols). A token is a discovery only if all three nulls fall, so its p-value is the largest of the three
(the intersection-union test, which needs no independence). Discoveries are chosen by the Benjamini-Hochberg procedure
at level Q, by strata of encoding and length, since short tokens prove little and are many. The p-values are ranked in
bins, so the choice needs one count for each stratum and bin.

Everything is DataFrame expressions, and every text is read once: its base spans and its tokens' strata and bins go to a
narrow checkpoint, from which the counts and the spans are made. All work is linear in a text's length and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import checkpoint, table

# The base kinds with their patterns, in the order in which ties of start are listed.
# The look-ahead and look-behinds only spare starts at which nothing can match.
ASSIGN = r"""(?=[pstaPSTA])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of lower hex digits that are long enough; shorter runs match nothing either way.
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

# Encodings from the smallest alphabet on, with a test and how much more often symbols of text-like
# tokens coincide than uniform ones do (collision probability times alphabet size). For letters that is the index of
# coincidence of English as Friedman gave it, 1.73; the others are that of words, dates and identifiers spelled in
# the alphabet, set a little under what they come to, so that the null hypothesis is the harder one to reject.
DIGITS, LETTERS, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", DIGITS, "^[0-9]+$", 2.0),
    ("hex", DIGITS + "abcdef", "^[0-9a-f]+$", 2.5),
    ("upper_hex", DIGITS + "ABCDEF", "^[0-9A-F]+$", 2.5),
    ("letters", LETTERS, "^[a-z]+$", 1.74),
    ("upper_letters", UPPER, "^[A-Z]+$", 1.74),
    ("base32", UPPER + "234567", "^[A-Z2-7]+$", 2.2),
    ("base36", DIGITS + LETTERS, "^[0-9a-z]+$", 2.4),
    ("base64", UPPER + LETTERS + DIGITS + "+/-_", "", 4.2),
)
#: Lower ends of the length strata; the false-discovery rate; the least effect (a correlation) of symbols in some order.
LENGTHS, Q, DEPENDENCE = (16, 20, 24, 32, 40, 48, 64, 96), 0.05, 0.8
#: Bins of a p-value: BINS_PER_DECADE for each power of ten, down to 10 ** -DECADES.
BINS_PER_DECADE, DECADES = 8, 20


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(lens: str, levels: int = 3) -> str:
    """SQL: for each number of the array (a lambda variable) the sum of those before it.

    Sums of blocks of 32 are added up first, by the same means, so the cost stays in proportion to the length.
    """
    if not levels:
        return f"transform({lens}, (x, i) -> aggregate(slice({lens}, 1, i), 0, (s, v) -> s + v))"
    sums, upto = f"sums{levels}", f"upto{levels}"
    inside = f"transform({lens}, (x, i) -> element_at({upto}, shiftright(i, 5) + 1) + aggregate(slice({lens}, i - i % 32 + 1, i % 32), 0, (s, v) -> s + v))"
    blocks = f"transform(sequence(0, shiftright(size({lens}), 5)), b -> aggregate(slice({lens}, b * 32 + 1, 32), 0, (s, v) -> s + v))"
    return _let(blocks, sums, _let(_before(sums, levels - 1), upto, inside))


EMPTY = "cast(array() AS array<struct<start: int, value: string>>)"


def _placed(text: str, pattern: str) -> str:
    """SQL: array of (start, value) of the leftmost matches of a pattern, in code points.

    The pieces between the matches come from split; starts are running sums of both lengths.
    """
    p = _sql(pattern)
    starts = "transform(hits, (h, i) -> struct(element_at(before, i + 1) + length(element_at(gaps, i + 1)) AS start, h AS value))"
    lens = "zip_with(gaps, hits, (g, h) -> length(g) + coalesce(length(h), 0))"
    found = _let(f"split({text}, {p}, -1)", "gaps", _let(f"regexp_extract_all({text}, {p}, 0)", "hits", _let(lens, "lens", _let(_before("lens"), "before", starts))))
    return f"(CASE WHEN {text} RLIKE {p} THEN {found} ELSE {EMPTY} END)"


def _case(value, body: str = "t.body") -> str:
    """SQL: a value by the encoding of a body."""
    arms = "".join(f" WHEN {body} RLIKE {_sql(rule)} THEN {value(k)}" for k, (_, _, rule, _) in enumerate(ENCODINGS) if rule)
    return f"CASE{arms} ELSE {value(len(ENCODINGS) - 1)} END"


def _of(value) -> str:
    """SQL: a value by the encoding number t.enc, literals in each arm."""
    return "CASE t.enc " + " ".join(f"WHEN {k} THEN {value(e)}" for k, e in enumerate(ENCODINGS)) + " END"


def _halves(encoding: tuple) -> str:
    """SQL: L for each symbol of the lower half of the alphabet, H for the others."""
    alphabet = encoding[1]
    low = len(alphabet) // 2
    return f"translate(t.body, {_sql(alphabet)}, '{'L' * low + 'H' * (len(alphabet) - low)}')"


def _lower_tail(z: str) -> str:
    """SQL: the normal distribution function, by Boerjesson and Sundberg's bound, which is within 0.3 % of it far out too."""
    tail = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) / (0.661D * abs({z}) + 0.339D * sqrt({z} * {z} + 5.51D))"
    return f"CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END"


def tested(text: str = "text") -> Column:
    """array of (start, stop, stratum, p, p_chi, p_runs, p_serial) of every token of a text."""
    tokens = f"transform({_placed(text, TOKEN)}, x -> struct(x.start AS start, x.start + length(x.value) AS stop, rtrim('=', x.value) AS body))"
    inferred = f"transform({tokens}, t -> struct(t.start, t.stop, t.body, cast(length(t.body) AS double) AS n, {_case(str)} AS enc))"
    # Counts of symbols come from what is left without them, in string functions; only neighbours go symbol by symbol.
    count = lambda e: "array(" + ", ".join(f"t.n - length(replace(t.body, {_sql(c)}, ''))" for c in e[1]) + ")"
    counted = f"transform({inferred}, t -> struct(t.start, t.stop, t.body, t.n, t.enc, {_of(lambda e: f'{len(e[1])}D')} AS a, {_of(lambda e: f'{e[3]}D')} AS spread, {_of(count)} AS counts, {_of(_halves)} AS halves))"
    place = _of(lambda e: f"instr({_sql(e[1])}, c)")
    products = f"aggregate(filter(split(t.body, ''), c -> c <> ''), struct(0D AS last, 0D AS sum), (s, c) -> " + _let(f"cast({place} AS double)", "v", "struct(v AS last, s.sum + s.last * v AS sum)") + ", s -> s)"
    sums = f"""transform({counted}, t -> struct(t.start, t.stop, t.n, t.enc, t.a, t.spread,
        aggregate(t.counts, 0D, (s, v) -> s + v * v) AS squares,
        aggregate(transform(t.counts, (v, i) -> (i + 1) * v), 0D, (s, v) -> s + v) / t.n AS mean,
        aggregate(transform(t.counts, (v, i) -> (i + 1) * (i + 1) * v), 0D, (s, v) -> s + v) AS total,
        {products}.sum AS neighbours, cast(instr({_of(lambda e: _sql(e[1]))}, left(t.body, 1)) + instr({_of(lambda e: _sql(e[1]))}, right(t.body, 1)) AS double) AS ends,
        t.n - length(replace(t.halves, 'H', '')) AS high, cast(regexp_count(t.halves, 'H+|L+') AS double) AS runs))"""
    # Neighbours' covariance from sums: every symbol but the last stands first in a pair, every one but the first second.
    moments = f"""transform({sums}, t -> struct(t.start, t.stop, t.n, t.enc, t.a, t.spread, t.a / t.n * t.squares - t.n AS chi,
        t.runs, 2 * t.high * (t.n - t.high) / t.n AS even, t.total - t.n * t.mean * t.mean AS var,
        t.neighbours - t.mean * (2 * t.n * t.mean - t.ends) + (t.n - 1) * t.mean * t.mean AS cov))"""
    # Under the text-like hypothesis chi-squared is non-central, with shift (n - 1) * (spread - 1).
    scores = f"""transform({moments}, t -> struct(t.start, t.stop, t.n, t.enc,
        (t.chi - (t.a - 1) - (t.n - 1) * (t.spread - 1)) / sqrt(2 * (t.a - 1) + 4 * (t.n - 1) * (t.spread - 1)) AS z,
        abs(coalesce(try_divide(t.runs - 1 - t.even, sqrt(greatest(t.even * (t.even - 1) / (t.n - 1), 0))), 99)) - {DEPENDENCE}D * sqrt(t.n) AS z_runs,
        abs(coalesce(try_divide(t.cov, t.var), 1) * sqrt(t.n) + 1 / sqrt(t.n)) - {DEPENDENCE}D * sqrt(t.n) AS z_serial))"""
    band = " + ".join(f"int(t.n >= {n})" for n in LENGTHS[1:])
    tails = f"transform({scores}, t -> struct(t.start, t.stop, t.enc * 10 + {band} AS stratum, {_lower_tail('t.z')} AS p_chi, {_lower_tail('t.z_runs')} AS p_runs, {_lower_tail('t.z_serial')} AS p_serial))"
    return F.expr(f"transform({tails}, t -> struct(t.start, t.stop, t.stratum, greatest(t.p_chi, t.p_runs, t.p_serial, 1e-{DECADES}D) AS p, t.p_chi, t.p_runs, t.p_serial))")


def _bin(p: Column) -> Column:
    """Larger for smaller p; every p of a bin is at most 10 ** (-bin / BINS_PER_DECADE)."""
    return F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")


def chosen_bins(tokens: DataFrame) -> dict[int, int]:
    """stratum -> least bin that Benjamini and Hochberg choose, from counts over all rows (stratum, bin).

    There are at most 8 encodings * 8 lengths * 161 bins of counts.
    """
    rows = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        own = sorted(((r["bin"], r["n"]) for r in rows if r["stratum"] == stratum), reverse=True)
        total, upto = sum(n for _, n in own), 0
        for at, n in own:
            upto += n
            if 10 ** (-at / BINS_PER_DECADE) <= Q * upto / total:
                out[stratum] = at
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (start, rank, stop) in order, rank being the kind's place in KINDS.

    Base matches that fail their length are dropped and not tried again. Null and empty texts have no spans; every
    row gives a row, whatever its doc_id; repeated rows are repeated. Texts of any length are searched whole, in time
    linear in their length. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Hexadecimal and access keys are tokens, at least in part, so most texts are searched for two patterns only.
    tests = "length(regexp_extract(x.value, " + _sql(ASSIGN) + ", 2)) >= 12", "length(x.value) >= 18", "true"
    base = [F.expr(f"transform(filter({_placed('text', p)}, x -> {test}), x -> struct(x.start AS start, {rank} AS rank, x.start + length(x.value) AS stop))") for rank, (p, test) in enumerate(zip((ASSIGN, ACCESS, HEX), tests, strict=True))]
    tokens = F.transform(tested(), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["stratum"].alias("stratum"), _bin(t["p"]).alias("bin")))
    long = F.when(F.col("text").rlike(TOKEN), F.struct(F.concat(*base[1:]).alias("base"), tokens.alias("tokens")))
    found = checkpoint(docs.select("doc_id", base[0].alias("assign"), long.alias("long")))
    found = found.select("doc_id", F.when(F.col("long").isNull(), F.col("assign")).otherwise(F.concat("assign", "long.base")).alias("base"), F.coalesce("long.tokens", F.array().cast("array<struct<start: int, stop: int, stratum: int, bin: int>>")).alias("tokens"))
    bins = chosen_bins(found.select(F.explode("tokens").alias("t")).select("t.stratum", "t.bin"))
    limit = F.create_map(*[F.lit(v) for pair in (bins or {-1: 0}).items() for v in pair])
    random = F.filter("tokens", lambda t: t["bin"] >= F.coalesce(F.element_at(limit, t["stratum"]), F.lit(1 << 30)))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("rank"), t["stop"].alias("stop")))
    return found.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans as text; a row for every row.

    Null and empty texts have no spans and the hash of an empty list; otherwise as ``secret_spans``.
    """
    kinds = F.array(*map(F.lit, KINDS))
    shown = lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    rows = secret_spans(docs)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {k})) AS long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["rank"] < 3), shown), ",")
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op1_sql() -> str:
    """The same spans in DuckDB, whose patterns need no look-around: every token's tests symbol by symbol."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    assign, token = ASSIGN.replace("(?=[pstaPSTA])", ""), TOKEN.replace("(?<![A-Za-z0-9+/_-])", "").replace("}+", "}")
    placed = lambda p: f"(SELECT doc, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))) AS start FROM (SELECT doc, string_split_regex(text, {q(p)}) AS gaps, regexp_extract_all(text, {q(p)}) AS hits FROM d))"
    by_body = lambda value: "CASE" + "".join(f" WHEN regexp_matches(body, {q(rule)}) THEN {value(k, e)}" for k, e in enumerate(ENCODINGS) if (rule := e[2])) + f" ELSE {value(len(ENCODINGS) - 1, ENCODINGS[-1])} END"
    tail = lambda z: f"CASE WHEN {z} < 0 THEN exp(-{z} * {z} / 2) / sqrt(2 * pi()) / (0.661::double * abs({z}) + 0.339::double * sqrt({z} * {z} + 5.51::double)) ELSE 1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) / (0.661::double * abs({z}) + 0.339::double * sqrt({z} * {z} + 5.51::double)) END"
    band = " + ".join(f"cast(n >= {n} AS int)" for n in LENGTHS[1:])
    kinds = "[" + ", ".join(map(q, KINDS)) + "]"
    shown = f"{kinds}[rank + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc, cast(start AS bigint) AS start, 0 AS rank, cast(start + length(hit) AS bigint) AS stop FROM {placed(assign)} WHERE length(regexp_extract(hit, {q(assign)}, 2)) >= 12
 UNION ALL SELECT doc, start, 1, start + length(hit) FROM {placed(ACCESS)} WHERE length(hit) >= 18 UNION ALL SELECT doc, start, 2, start + length(hit) FROM {placed(HEX.replace("}+", "}"))}),
token AS (SELECT doc, start, start + length(hit) AS stop, rtrim(hit, '=') AS body FROM {placed(token)}),
kind AS (SELECT *, cast(length(body) AS double) AS n, {by_body(lambda k, e: k)} AS enc, {by_body(lambda k, e: q(e[1]))} AS alphabet, {by_body(lambda k, e: f"{e[3]}::double")} AS spread FROM token),
symbol AS (SELECT *, cast(length(alphabet) AS double) AS a, list_transform(string_split(body, ''), lambda c: cast(instr(alphabet, c) AS double)) AS x FROM kind),
sums AS (SELECT *, list_sum(list_transform(range(1, cast(a AS bigint) + 1), lambda v: power(len(list_filter(x, lambda w: w = v)), 2))) AS squares, list_sum(x) / n AS mean, list_sum(list_transform(x, lambda v: v * v)) AS total,
 list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])) AS neighbours, x[1] + x[len(x)] AS ends, cast(len(list_filter(x, lambda v: v > a // 2)) AS double) AS high,
 cast(1 + len(list_filter(range(1, len(x)), lambda i: (x[i] > a // 2) <> (x[i + 1] > a // 2))) AS double) AS runs FROM symbol),
moment AS (SELECT *, a / n * squares - n AS chi, 2 * high * (n - high) / n AS even, total - n * mean * mean AS var, neighbours - mean * (2 * n * mean - ends) + (n - 1) * mean * mean AS cov FROM sums),
score AS (SELECT *, (chi - (a - 1) - (n - 1) * (spread - 1)) / sqrt(2 * (a - 1) + 4 * (n - 1) * (spread - 1)) AS z, abs(coalesce((runs - 1 - even) / nullif(sqrt(greatest(even * (even - 1) / (n - 1), 0)), 0), 99)) - {DEPENDENCE}::double * sqrt(n) AS z_runs,
 abs(coalesce(cov / nullif(var, 0), 1) * sqrt(n) + 1 / sqrt(n)) - {DEPENDENCE}::double * sqrt(n) AS z_serial FROM moment),
ranked AS (SELECT doc, start, stop, enc * 10 + {band} AS stratum, cast(floor(-log10(greatest({tail("z")}, {tail("z_runs")}, {tail("z_serial")}, 1e-{DECADES}::double)) * {BINS_PER_DECADE}) AS int) AS bin FROM score),
counted AS (SELECT stratum, bin, sum(count(*)) OVER (PARTITION BY stratum ORDER BY bin DESC) AS upto, sum(count(*)) OVER (PARTITION BY stratum) AS total FROM ranked GROUP BY stratum, bin),
chosen AS (SELECT stratum, min(bin) AS least FROM counted WHERE power(10::double, -bin / {BINS_PER_DECADE}::double) <= {Q}::double * upto / total GROUP BY stratum),
span AS (SELECT * FROM base UNION ALL SELECT doc, start, {len(KINDS) - 1}, stop FROM ranked JOIN chosen USING (stratum) WHERE bin >= least),
text AS (SELECT doc, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))}, string_agg({shown}, ',' ORDER BY start, rank, stop) FILTER (rank < {len(KINDS) - 1}) AS base, string_agg({shown}, ',' ORDER BY start, rank, stop) AS spans FROM span GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN text USING (doc)"""
