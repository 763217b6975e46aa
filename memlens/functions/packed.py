"""Several values packed in one text: JSON, bracketed, quoted or bare lists.

Quoted spans are replaced by indexed placeholders, the rest is split at its
delimiters, and the placeholders are looked up again, all in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks a placeholder. Where it stands in the text outside quotes it is a delimiter, so none can collide.
MARK = "\ue000"

_SPAN = r"""(?s)"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
_WHOLE = r"""(?s)^\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*$"""
_EDGE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_WORD = rf"\p{{L}}\p{{M}}\p{{N}}{MARK}+#./\-_:"
#: What separates values outside quotes. A tag may hold single blanks, an id none.
SEPARATORS = {"tag": rf"->|[^{_WORD} ]|  +", "id": rf"->|[^{_WORD}]"}


def _json_string(text: Column) -> Column:
    """The string a JSON string literal stands for, else null."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"allowUnquotedControlChars": "true"})[0]


def _repeat(start: Column, step) -> Column:
    """``step`` until it changes nothing more: each layer of encoding doubles the escapes, so there are no more layers than the logarithm of the length."""
    layers = F.when(start.rlike(_WHOLE), F.floor(F.log2(F.length(start).cast("double"))) + 2).otherwise(0).cast("int")
    return F.aggregate(F.array_repeat(F.lit(0), layers), start, lambda acc, _: step(acc))


def _unwrap_field(text: Column) -> Column:
    """Undo JSON encodings of the whole field: a literal that holds a list or another literal."""

    def step(t: Column) -> Column:
        inner = _json_string(t)
        return F.when(t.rlike(_WHOLE) & inner.rlike(r"""^\s*[\[{"]"""), inner).otherwise(t)

    return _repeat(text, step)


def _decode_span(span: Column) -> Column:
    body = F.substring(span, F.lit(2), F.greatest(F.length(span) - 2, F.lit(0)))
    double = F.regexp_replace(body, '""', r'\\"')
    single = F.regexp_replace(F.regexp_replace(body, r"\\'", "'"), r'(?<!\\)"', r'\\"')
    literal = F.when(span.startswith("'"), single).otherwise(double)
    plain = F.coalesce(_json_string(F.concat(F.lit('"'), literal, F.lit('"'))), body)

    def step(t: Column) -> Column:
        inner = _json_string(t)
        return F.when(t.rlike(_WHOLE) & inner.isNotNull(), inner).otherwise(t)

    return _repeat(plain, step)


def split_packed(text: Column, kind: str = "tag") -> Column:
    """The values of a packed field, in order, as ``array<string>``.

    ``kind`` is ``tag`` (single blanks belong to a value) or ``id`` (they
    separate). Blank values and an unquoted ``null`` take no position; repeated
    values stay. A null, empty or blank text gives an empty array, an unclosed
    quote or bracket counts as a delimiter, and texts may have any length.
    """
    field = _unwrap_field(F.coalesce(text, F.lit("")))
    parts = F.struct(
        F.split(field, _SPAN, -1).alias("gaps"),
        F.regexp_extract_all(field, F.lit(_SPAN), F.lit(0)).alias("spans"),
    )

    def restore(p: Column) -> Column:
        masked = F.array_join(
            F.transform(
                p["gaps"],
                lambda g, i: F.concat(
                    F.translate(g, MARK, ","),
                    F.when(i < F.size(p["spans"]), F.concat(F.lit("," + MARK), i.cast("string"), F.lit(","))).otherwise(""),
                ),
            ),
            "",
        )

        def value(token: Column) -> Column:
            at = F.get(p["spans"], F.substring(token, F.lit(2), F.length(token)).try_cast("int"))
            bare = F.when(F.lower(token) != "null", token)
            return F.regexp_replace(F.when(token.startswith(MARK), _decode_span(at)).otherwise(bare), _EDGE, "")

        tokens = F.transform(F.split(masked, SEPARATORS[kind], -1), lambda t: F.regexp_replace(t, _EDGE, ""))
        return F.filter(F.transform(F.filter(tokens, lambda t: t != ""), value), lambda v: v.isNotNull() & (v != ""))

    return F.transform(F.array(parts), restore)[0]


def explode_packed(df: DataFrame, fields: dict[str, tuple[str, str]], record: str = "id") -> DataFrame:
    """One row per packed value: field_name, record_id, pos (from 1), item.

    ``fields`` maps an output name to (column, kind). Other columns of ``df``,
    whatever their names, are not touched; an empty table gives an empty result.
    """
    long = df.select(
        F.col(record).alias("record_id"),
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("field_name"), split_packed(F.col(c), k).alias("items")) for n, (c, k) in fields.items()])
        ).alias("f"),
    )
    return long.select("f.field_name", "record_id", F.posexplode("f.items").alias("pos", "item")).select(
        "field_name", "record_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "item"
    )
