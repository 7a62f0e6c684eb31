"""License scan: notices found through a positional index of their rarest words.

Every template (the words of a notice) is known by the few of its words that the fewest documents hold, those of the
highest inverse document frequency over the whole corpus. A file looks up the index words it has; each posting (template,
place in it) says where the template would begin in the file, and a place on which enough postings agree is a candidate.
A candidate counts if the template's mandatory key phrases stand where they should, give or take SLACK words, so
that a word put in or left out does no harm. The contract's phrases are templates that are one key phrase
without slack: each of their places has all of their words at one beginning, so none is lost.

Everything is DataFrame expressions within a row. Texts are read twice, for the document counts of the templates' some
hundred words and for the search; nothing but those counts is shuffled. Work is linear in a text's length and hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The contract's phrases and labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Words of usual notices, each with its label and the key phrases without which it is another one.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "software and associated documentation files")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)
#: Words of a template that are looked up; words by which a key phrase may be off its place.
LOOKUPS, SLACK = 3, 2


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # (place, words)
    slack: int

    @staticmethod
    def of(label: str, text: str, keys: tuple[str, ...] = (), slack: int = 0) -> Template:
        words = text.split()
        places = [(k.split(), next(p for p in range(len(words)) if words[p : p + len(k.split())] == k.split())) for k in keys or (text,)]
        return Template(label, tuple(words), tuple((p, tuple(k)) for k, p in places), slack)


#: The base phrases come first.
TEMPLATES = tuple(Template.of(*p) for p in PHRASES) + tuple(Template.of(*n, SLACK) for n in NOTICES)
VOCABULARY = tuple(sorted({w for t in TEMPLATES for w in t.words}))


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# Only A to Z are to be lowered. Of all other characters two have ASCII letters in their lower case, the Kelvin sign and
# the dotted capital I; others stand in for them, of which only the number of words is asked.
_LOWERED = "lower(replace(replace(coalesce(text, ''), 'K', 'ĸ'), 'İ', 'ı'))"
_WORDS = f"array_remove(split({_LOWERED}, '[^0-9a-z\\\\x{{80}}-\\\\x{{10FFFF}}]+', -1), '')"  # the matches of WORD, at half the price


def document_counts(docs: DataFrame) -> dict[str, int]:
    """Word of the templates -> number of rows whose text holds it, over all rows."""
    held = docs.select(F.explode(F.expr(f"array_distinct(filter({_WORDS}, w -> w IN {_in(VOCABULARY)}))")).alias("word"))
    return {w: 0 for w in VOCABULARY} | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def index_of(counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Word -> postings (template, place), of the LOOKUPS rarest words of each template (ties: by word)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        rarest = sorted(set(t.words), key=lambda w: (counts[w], w))[:LOOKUPS]
        for place, word in enumerate(t.words):
            if word in rarest:
                out.setdefault(word, []).append((k, place))
    return out


def license_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, matches) of every row; ``matches`` is an array of (template, start, votes, total), in order of template
    and start, ``start`` being the word at which the template would begin (under 0 where its beginning is missing) and
    ``votes`` of ``total`` the share of its looked-up words that stand in place.

    Null and empty texts have no words and no matches; repeated rows are repeated; texts are read whole whatever their
    length. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    docs = docs.select("doc_id", "text")
    index = index_of(document_counts(docs))
    totals = [sum(k == t for post in index.values() for k, _ in post) for t in range(len(TEMPLATES))]
    postings = "CASE element_at(words, i + 1) " + " ".join(f"WHEN '{w}' THEN array({', '.join(f'{k << 32}L - {place}' for k, place in post)})" for w, post in sorted(index.items())) + " END"
    # A key is a template and where it would begin, in one number; a template's length is added to keep that positive.
    longest = max(len(t.words) for t in TEMPLATES)
    hits = f"filter(transform(words, (w, i) -> CASE WHEN w IN {_in(sorted(index))} THEN i END), i -> i IS NOT NULL)"
    keys = f"array_sort(flatten(transform({hits}, i -> transform({postings}, p -> p + i + {longest}L))))"
    starts = "filter(sequence(1, size(keys)), i -> i = 1 OR element_at(keys, i) <> element_at(keys, greatest(i - 1, 1)))"
    runs = f"CASE WHEN size(keys) > 0 THEN {_let(starts, 'starts', 'transform(starts, (s, j) -> struct(cast(shiftright(element_at(keys, s), 32) AS int) AS template, cast(element_at(keys, s) & 4294967295L AS int) - ' + str(longest) + ' AS start, coalesce(get(starts, j + 1), size(keys) + 1) - s AS votes))')} ELSE array() END"
    at = lambda place, words, d: f"(c.start + {place} + {d} >= 0 AND slice(words, greatest(c.start + {place} + {d}, 0) + 1, {len(words)}) = array({_in(words)[1:-1]}))"
    stands = lambda place, words, slack: f"exists(sequence(-{slack}, {slack}), d -> {at(place, words, 'd')})" if slack else at(place, words, "0")
    proven = "CASE c.template " + " ".join(f"WHEN {k} THEN c.votes * 2 >= {totals[k]} AND " + " AND ".join(stands(p, w, t.slack) for p, w in t.keys) for k, t in enumerate(TEMPLATES)) + " END"
    total = "element_at(array(" + ", ".join(map(str, totals)) + "), c.template + 1)"
    found = _let(keys, "keys", f"transform(filter({runs}, c -> {proven}), c -> struct(c.template, c.start, c.votes, {total} AS total))")
    return docs.select("doc_id", F.expr(_let(_WORDS, "words", f"struct(cast(size(words) AS long) AS n_words, {found} AS matches)")).alias("r")).select("doc_id", "r.n_words", "r.matches")


def license_digest(docs: DataFrame) -> DataFrame:
    """A row for every row: n_words, the number and the ends of the base phrases' places, the labels of those and of all
    matches, and ``score``, the largest share of a matched template's looked-up words that stand in place (0: no match). Odd
    rows as in ``license_matches``."""
    rows = license_matches(docs)
    labels = "array(" + ", ".join(f"'{t.label}'" for t in TEMPLATES) + ")"
    named = lambda of: F.expr(f"array_join(array_sort(array_distinct(transform({of}, m -> element_at({labels}, m.template + 1)))), ',')")
    base = f"filter(matches, m -> m.template < {len(PHRASES)})"
    place = lambda f: F.expr(f"cast({f}(transform({base}, m -> m.start)) AS long)")
    score = F.expr("coalesce(array_max(transform(matches, m -> cast(m.votes AS double) / m.total)), 0D)")
    return rows.select("doc_id", "n_words", F.expr(f"cast(size({base}) AS long)").alias("n_base"), place("array_min").alias("first_word"), place("array_max").alias("last_word"), named(base).alias("base_labels"), named("matches").alias("labels"), score.alias("score"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op11_sql() -> str:
    """The same matches in DuckDB, by joins of words and postings."""
    rows = lambda of, names: f"(VALUES {', '.join(of)}) v({names})"
    words = rows([f"({k}, {p}, '{w}')" for k, t in enumerate(TEMPLATES) for p, w in enumerate(t.words)], "template, place, word")
    keys = rows([f"({k}, {p}, [{', '.join(map(repr, w))}], {t.slack})" for k, t in enumerate(TEMPLATES) for p, w in t.keys], "template, place, phrase, slack")
    labels = rows([f"({k}, '{t.label}')" for k, t in enumerate(TEMPLATES)], "template, label")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS words FROM documents),
tw AS (SELECT * FROM {words}),
w AS MATERIALIZED (SELECT doc, word, place FROM (SELECT doc, unnest(words) AS word, unnest(range(len(words))) AS place FROM d) WHERE word IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT doc) AS n FROM w GROUP BY word),
rare AS (SELECT template, word FROM (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), word) AS r FROM (SELECT DISTINCT template, word FROM tw) LEFT JOIN df USING (word)) WHERE r <= {LOOKUPS}),
look AS (SELECT template, place, word FROM tw JOIN rare USING (template, word)),
total AS (SELECT template, count(*) AS total FROM look GROUP BY template),
votes AS (SELECT doc, l.template, w.place - l.place AS start, count(*) AS votes FROM w JOIN look l USING (word) GROUP BY ALL),
cand AS (SELECT v.*, total FROM votes v JOIN total USING (template) WHERE votes * 2 >= total),
key AS (SELECT * FROM {keys}),
proof AS (SELECT c.doc, c.template, c.start, c.votes, c.total, k.place, bool_or(c.start + k.place + s >= 0 AND d.words[c.start + k.place + s + 1:c.start + k.place + s + len(k.phrase)] = k.phrase) AS stands
 FROM cand c JOIN key k USING (template) JOIN d USING (doc), range(-{SLACK}, {SLACK} + 1) r(s) WHERE abs(s) <= k.slack GROUP BY ALL),
hit AS (SELECT doc, template, start, votes, total, label FROM (SELECT doc, template, start, votes, total FROM proof GROUP BY ALL HAVING bool_and(stands)) JOIN {labels} USING (template)),
agg AS (SELECT doc, count(*) FILTER (template < {len(PHRASES)}) AS n_base, min(start) FILTER (template < {len(PHRASES)}) AS first_word, max(start) FILTER (template < {len(PHRASES)}) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {len(PHRASES)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cast(votes AS double) / total) AS score FROM hit GROUP BY doc)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN agg USING (doc)"""
