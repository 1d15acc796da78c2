"""Interchange form of properties: a JSON map ``{property IRI: {tag: value}}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import lexical
from ..model import ENVELOPE, Property, Schema
from ..session import settled

# The tag each datatype is written under.
TAGS = {
    "string": "text",
    "anyURI": "text",
    "time": "text",
    "duration": "text",
    "integer": "integer",
    "long": "integer",
    "decimal": "decimal",
    "double": "decimal",
    "boolean": "bool",
    "date": "date",
    "dateTime": "dateTime",
}
ALL_TAGS = ("text", "integer", "decimal", "bool", "dateTime", "date", "ref", "list")

_SCALARS = ", ".join(f"{t}: string" for t in ALL_TAGS if t != "list")
_TYPED = f"map<string, struct<{_SCALARS}, list: array<struct<{_SCALARS}>>>>"
_RAW = "map<string, map<string, string>>"


def tag_of(p: Property) -> str:
    return "ref" if p.is_ref else TAGS[p.datatype]


# Spark hands a second argument of such a lambda the element's index, so names are bound here.
def _field_of_each(items: Column, tag: str) -> Column:
    return F.transform(items, lambda item: item[tag])


def fits(text: Column, kind: T.DataType) -> Column:
    """Whether a number's text keeps its value when it is read as ``kind``: no digit may be rounded away."""
    if not isinstance(kind, T.DecimalType):
        return F.lit(True)
    plain = text.rlike(rf"^\s*[+-]?[0-9]*(\.[0-9]{{0,{kind.scale}}}0*)?\s*$")
    same = text.try_cast("decimal(38,18)") == text.try_cast(kind)
    return F.coalesce(F.when(text.rlike("[eE]"), same).otherwise(plain), F.lit(False))


def _exact(text: Column, kind: T.DataType) -> Column:
    return F.when(fits(text, kind), text.try_cast(kind))


def _cast_each(items: Column, kind: T.DataType) -> Column:
    return F.transform(items, lambda item: _exact(item, kind))


def _tag_each(p: Property, items: Column) -> Column:
    return F.transform(items, lambda item: _tagged_scalar(p, item))


def load_tagged(dump: DataFrame, schema: Schema, type_name: str) -> tuple[DataFrame, DataFrame]:
    """Split a dump (envelope columns + ``props`` JSON) into typed rows and rejects.

    Rejected with a reason: JSON that does not parse, a tag that does not exist, a value under the
    wrong tag, a list in a list, and text that does not read as the declared type.
    """
    props = schema.properties(type_name)
    envelope = [c for c in ENVELOPE if c in dump.columns]
    typed = F.from_json("props", _TYPED)
    raw = F.from_json("props", _RAW)
    df = dump.select(*envelope, "props", typed.alias("_m"), raw.alias("_raw"))
    cells = [F.try_element_at(F.col("_m"), F.lit(p.iri)).alias(f"_c_{p.name}") for p in props]
    df = df.select(*envelope, "props", F.col("_m").isNotNull().alias("_parsed"), "_raw", *cells)

    known = F.array(*[F.lit(t) for t in ALL_TAGS])
    tags = F.flatten(F.transform(F.map_values("_raw"), lambda m: F.map_keys(m)))
    list_items = F.flatten(
        F.filter(
            F.transform(F.map_values("_raw"), lambda m: F.from_json(F.try_element_at(m, F.lit("list")), "array<map<string,string>>")),
            lambda a: a.isNotNull(),
        )
    )
    item_tags = F.flatten(F.transform(list_items, lambda m: F.map_keys(m)))
    all_tags = F.concat(tags, item_tags)
    unknown = F.array_except(all_tags, known)
    nested = F.array_contains(item_tags, "list")

    values: list[Column] = []
    bad = []
    for p in props:
        cell = F.col(f"_c_{p.name}")
        tag = tag_of(p)
        if p.is_list:
            single = F.when(cell[tag].isNotNull(), F.array(cell[tag]))
            texts = F.coalesce(_field_of_each(cell["list"], tag), single)
            col = _cast_each(texts, p.scalar_type)
        else:
            col = _exact(cell[tag], p.scalar_type)
        values.append(col.alias(p.name))
        bad.append((p.name, cell.isNotNull(), p.is_list))
    df = df.select("*", *values)
    bad = [
        F.when(
            present & (F.coalesce(F.exists(F.col(n), lambda v: v.isNull()), F.lit(True)) if is_list else F.col(n).isNull()),
            F.lit(n),
        )
        for n, present, is_list in bad
    ]
    known_props = F.array(*[F.lit(p.iri) for p in props])
    wrong = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    reason = (
        F.when(~F.col("_parsed") | F.col("_raw").isNull(), F.lit("not a property map"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown tag: "), F.array_join(F.array_sort(F.array_distinct(unknown)), ",")))
        .when(nested, F.lit("a list inside a list"))
        .when(
            F.size(F.array_except(F.map_keys("_raw"), known_props)) > 0,
            F.concat(F.lit("unknown property: "), F.array_join(F.array_sort(F.array_except(F.map_keys("_raw"), known_props)), ",")),
        )
        .when(F.size(wrong) > 0, F.concat(F.lit("value does not fit: "), F.array_join(wrong, ",")))
    )
    judged = settled(df.select(*envelope, "props", *[p.name for p in props], reason.alias("_reason")))
    good = judged.where(F.col("_reason").isNull()).select(*envelope, *[p.name for p in props])
    rejects = judged.where(F.col("_reason").isNotNull()).select(*envelope, "props", F.col("_reason").alias("reason"))
    return good, rejects


def _tagged_scalar(p: Property, v: Column) -> Column:
    text = v.cast("string") if isinstance(p.scalar_type, T.DecimalType) else lexical(v, p.scalar_type)
    return F.concat(F.lit(f'{{"{tag_of(p)}":'), _json_value(p, text), F.lit("}"))


def _json_value(p: Property, text: Column) -> Column:
    if tag_of(p) in ("integer", "bool"):
        return text
    # to_json of a one-field struct escapes the text; strip the wrapper around it.
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def tagged_json(schema: Schema, type_name: str, without: tuple[str, ...] = ()) -> Column:
    """All properties of a row as JSON; an absent property is an absent key.

    Decimals are written as text, so their scale is kept.
    """
    entries: list[Column] = []
    for p in schema.properties(type_name):
        if p.name in without:
            continue
        col = F.col(p.name)
        if p.is_list:
            body = F.concat(F.lit('{"list":['), F.concat_ws(",", _tag_each(p, col)), F.lit("]}"))
        else:
            body = _tagged_scalar(p, col)
        entries.append(F.when(col.isNotNull(), F.concat(F.lit(f'"{p.iri}":'), body)))
    return F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))


def export_tagged(df: DataFrame, schema: Schema, type_name: str) -> DataFrame:
    """Envelope columns + ``props`` JSON."""
    envelope = [c for c in ENVELOPE if c in df.columns]
    absent = tuple(p.name for p in schema.properties(type_name) if p.name not in df.columns)
    return df.select(*envelope, tagged_json(schema, type_name, absent).alias("props"))


def write_tagged(df: DataFrame, schema: Schema, type_name: str, path: str) -> None:
    export_tagged(df, schema, type_name).write.mode("overwrite").json(path)
