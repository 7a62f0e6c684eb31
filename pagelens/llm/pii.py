"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelens.llm.common import map_batches, table, texts

# The kinds, in the order in which ties of start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The lookbehind only spares starts inside a run of digits: where the run's start fails, they fail too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score before context, and the words that raise it when they stand within REACH characters.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|correo)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
}
REACH, BONUS = 48, 0.3
#: Kinds outside the base count from this score on.
THRESHOLD = 0.5


@dataclass(frozen=True, order=True)
class Span:
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 over an IBAN without spaces: four characters to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches found from each @: the local part is the run before it, cut at the last match's end."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        low = at
        while low > done:  # in blocks, so that a long run costs its length once
            block = max(done, low - 256)
            low = block + len(text[block:low].rstrip(LOCAL))
            if low > block:
                break
        domain = DOMAIN.match(text, at) if low < at else None
        if domain:
            yield low, domain.end()
            done = at = domain.end()
        else:
            at += 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """All spans of one whole text, by start and kind; offsets are code points, ends exclusive.

    Proposals that fail their check are dropped and not tried again from a later character.
    """
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", *m) for m in _emails(text))
    if re.search("[0-9]", text):
        found += (("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
        found += (("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d))
        if "+" in text:
            found += (("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
        found += (("iban", *m.span()) for m in IBAN.finditer(text) if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code))
        found += (("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000")
    spans = []
    for kind, start, end in found:
        near = text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]
        score = min(1.0, PRIOR[kind] + BONUS * bool(CONTEXT[kind].search(near)))
        if kind in BASE or score >= THRESHOLD:
            spans.append(Span(start, KINDS.index(kind), end, round(score, 2)))
    return sorted(spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per found span: doc_id, kind, start, end, score, value.

    Null and empty texts have none; repeated rows are searched once each, whatever their doc_id; texts are read whole, however
    long; an empty table gives no rows; other columns are ignored.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, s, t) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True) for s in find(t)]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1].kind for r in rows], pa.string()), "start": pa.array([r[1].start for r in rows], pa.int64()), "end": pa.array([r[1].end for r in rows], pa.int64()), "score": pa.array([r[1].score for r in rows], pa.float64()), "value": pa.array([r[2][r[1].start : r[1].end] for r in rows], pa.string())})

    return map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, kind string, start long, end long, score double, value string")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, their scores.

    Every row gives a row, null and empty texts with zeros and empty lists; a null doc_id stays null. Texts are searched
    whole, however long; an empty table gives no rows; columns other than doc_id and text are not looked at.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t) for t in texts(batch)]
        base = [[s for s in spans if s.kind in BASE] for spans in found]
        out = {"doc_id": batch.column("doc_id").cast(pa.int64())}
        for kind in BASE:
            out[f"n_{kind}"] = pa.array([sum(s.kind == kind for s in spans) for spans in base], pa.int64())
        out["base_sha256"] = pa.array([hashlib.sha256(",".join(map(str, spans)).encode()).hexdigest() for spans in base])
        out["spans"] = pa.array([",".join(map(str, spans)) for spans in found], pa.string())
        out["scores"] = pa.array([",".join(f"{s.score:.2f}" for s in spans) for spans in found], pa.string())
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return map_batches(docs.select("doc_id", "text"), kernel, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    """The same spans and scores in DuckDB. Its patterns have no look-around, so characters beside a match are matched and
    left out again, which only tells apart two account numbers with a single character between them."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    beside = r"[^\p{L}\p{N}_]"
    placed = lambda p, group: f"(SELECT doc, text, regexp_extract(hit, {q(p)}, {group}) AS hit, start + CASE WHEN {group} = 2 THEN length(regexp_extract(hit, {q(p)}, 1)) ELSE 0 END AS start FROM (SELECT doc, text, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))) AS start FROM (SELECT doc, text, string_split_regex(text, {q(p)}) AS gaps, regexp_extract_all(text, {q(p)}) AS hits FROM d)))"
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    value = f"cast({digits}[length({digits}) - i + 1] AS int) * (2 - i % 2)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN {value} > 9 THEN {value} - 9 ELSE {value} END)) % 10 = 0"
    code = "replace(hit, ' ', '')"
    number = f"list_reduce(list_transform(string_split(substring({code}, 5) || {code}[1:4], ''), lambda c: cast(CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS int)), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
    finds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, "true"),
        (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0, "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR cast('0' || left(ltrim(p, '0'), 3) AS int) > 255)) = 0"),
        (r"[0-9](?:[\x20-]?[0-9])+", 0, f"length({digits}) BETWEEN 12 AND 19 AND {luhn}"),
        (PHONE.pattern, 0, f"length({digits}) BETWEEN 9 AND 15"),
        (r"(^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?:$|[^A-Za-z0-9])", 2, f"length({code}) BETWEEN 15 AND 34 AND {number} = 1"),
        (r"(^|[^0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?:$|[^0-9-])", 2, "NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$')"),
    )
    found = " UNION ALL ".join(f"SELECT doc, text, {k} AS rank, cast(start AS bigint) AS start, cast(start + length(hit) AS bigint) AS stop FROM {placed(p, group)} WHERE {test}" for k, (p, group, test) in enumerate(finds))
    near = "text[greatest(start - " + str(REACH) + ", 0) + 1:start] || chr(10) || text[stop + 1:stop + " + str(REACH) + "]"
    context = "CASE rank " + " ".join(f"WHEN {k} THEN regexp_matches(near, {q('(?i)(?:^|' + beside + ')' + CONTEXT[kind].pattern[6:-2] + '(?:$|' + beside + ')')})" for k, kind in enumerate(KINDS)) + " END"
    prior = "[" + ", ".join(str(PRIOR[kind]) for kind in KINDS) + "][rank + 1]"
    kinds = "[" + ", ".join(map(q, KINDS)) + "]"
    shown = f"{kinds}[rank + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
scored AS (SELECT doc, rank, start, stop, least(1.0, {prior} + CASE WHEN {context} THEN {BONUS} ELSE 0 END) AS score FROM (SELECT *, {near} AS near FROM found)),
kept AS (SELECT * FROM scored WHERE rank < {len(BASE)} OR score >= {THRESHOLD}),
text AS (SELECT doc, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, kind in enumerate(BASE))}, string_agg({shown}, ',' ORDER BY start, rank, stop) FILTER (rank < {len(BASE)}) AS base, string_agg({shown}, ',' ORDER BY start, rank, stop) AS spans, string_agg(printf('%.2f', cast(score AS double)), ',' ORDER BY start, rank, stop) AS scores FROM kept GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN text USING (doc)"""
