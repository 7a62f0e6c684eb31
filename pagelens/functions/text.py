"""Column functions over page text: extraction, counting and cleaning."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions import patterns as P


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_of(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; empty where there is none."""
    return F.regexp_extract(text, pattern, group)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, P.EDGES, "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, P.WIDE, " "))


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(html, P.HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, P.COMMENT, " "), P.TAG, " ")
    for entity, char in P.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def ld_of(raw: Column) -> Column:
    """Each of the JSON-LD blocks of a page as compact JSON; null where it doesn't parse, so that it still counts."""
    return F.transform(raw, lambda b: F.to_json(F.try_parse_json(strip(b))))


def ld_types(blocks: Column) -> Column:
    """All @type strings of all nodes."""
    found = F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), lambda b: all_of(b, P.LD_TYPE, 1)))
    return F.flatten(F.transform(found, lambda t: F.transform(all_of(t, r'"((?:[^"\\]|\\.)*)"', 1), lambda s: s)))


def same_as(blocks: Column) -> Column:
    """URLs of sameAs, repeated ones kept."""
    found = F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), lambda b: all_of(b, P.SAME_AS, 1)))
    return F.flatten(F.transform(found, lambda s: all_of(s, P.SAME_AS_URL)))


# Stand-ins for brackets inside strings: characters that Unicode leaves unused.
_BRACKETS, _PLAIN = "{}[]", "\ufdd0\ufdd1\ufdd2\ufdd3"


def _own_name(node: Column) -> Column:
    """[name] of an object without objects inside, if it is an entity and its name a string; else nothing."""
    value = F.try_parse_json(F.translate(node, _PLAIN, _BRACKETS))
    listed = F.filter(F.coalesce(F.try_variant_get(value, "$['@type']", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    kinds = F.when(node.contains('"@type":"'), F.array(F.try_variant_get(value, "$['@type']", "string"))).otherwise(F.transform(listed, lambda v: v.cast("string")))
    wanted = node.contains('"@type":') & node.contains('"name":"')
    entity = wanted & F.exists(kinds, lambda k: k.isin(*P.ENTITY_TYPES))
    return F.when(entity, F.array(strip(F.try_variant_get(value, "$.name", "string")))).otherwise(F.array().cast("array<string>"))


def _names_of(block: Column) -> Column:
    """Names in a JSON tree of any depth: objects without objects inside are read and replaced by a number, again and again."""
    pieces = all_of(block, r'"(?:[^"\\]|\\.)*"|[^"]+')
    flat = F.array_join(F.transform(pieces, lambda t: F.when(t.startswith('"'), F.translate(t, _BRACKETS, _PLAIN)).otherwise(t)), "")
    rounds = F.sequence(F.lit(0), F.length(flat) - F.length(F.replace(flat, F.lit("{"), F.lit(""))))
    inner = r"\{[^{}]*\}"
    read = lambda s: F.struct(F.regexp_replace(s["json"], inner, "0").alias("json"), F.concat(s["names"], F.flatten(F.transform(all_of(s["json"], inner), _own_name))).alias("names"))
    none = F.struct(flat.alias("json"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(rounds, none, lambda s, _: F.when(s["json"].contains("{"), read(s)).otherwise(s), lambda s: s["names"])


def entity_names(blocks: Column) -> Column:
    """Distinct names of all nodes that are entities, at any depth, sorted; the type and the name must share a node."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), _names_of))))


def _python_columns():
    """The Arrow function. It is made in here so that workers get it whole and need not find this package."""

    def decode_bytes(raw: bytes, content_type: str) -> str:
        order = (("gb18030", "gbk") if "gb" in content_type.lower() else ()) + ("utf-8", "gb18030")
        for codec in order:
            try:
                return raw.decode(codec)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "replace")

    @F.arrow_udf(T.StringType())
    def by_codec(body: pa.Array, content_type: pa.Array) -> pa.Array:
        import pyarrow

        return pyarrow.array([None if b is None else decode_bytes(b, c or "") for b, c in zip(body.to_pylist(), content_type.to_pylist(), strict=True)], pyarrow.string())

    return by_codec, decode_bytes


_by_codec, decode_bytes = _python_columns()


def decoded(body: Column, content_type: Column) -> Column:
    """Bytes as text: UTF-8 natively where it is valid and nothing says GB, else by Python's GB codecs.

    A Python function is run for every row wherever it stands in an expression, so the rows that don't need it hand it
    a null instead of their body.
    """
    says_gb = F.coalesce(F.lower(content_type), F.lit("")).contains("gb")
    utf8 = F.when(~says_gb, F.try_validate_utf8(body.cast("string")))
    return F.coalesce(utf8, _by_codec(F.when(utf8.isNull(), body), content_type))
