"""Raw JSON records to typed rows; a record with any violation is rejected as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Property
from ..session import settled
from ..sources.store import ObjectStore
from ..sources.tagged import fits

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _numeric(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _scalar(p: Property, cell: Column, kind: Column) -> tuple[Column, Column]:
    """(typed value, reason it is wrong or null) of one JSON value."""
    text = F.try_variant_get(cell, "$", "string")
    is_text = kind == "STRING"
    target = p.scalar_type.simpleString()
    if p.is_ref:
        ok, value, reason = is_text & text.rlike(_UUID), F.lower(text), F.lit("not a UUID")
    else:
        match p.datatype:
            case "integer" | "long":
                number = F.try_variant_get(cell, "$", "decimal(38,10)")
                # Digits decide, not a rounded number; only numbers with an exponent are read as double.
                real = F.try_variant_get(cell, "$", "double")
                whole = text.rlike(r"^[+-]?[0-9]+(\.0*)?$") | ((kind == "DOUBLE") & text.rlike("[eE]") & (real == F.floor(real)))
                ok, reason = _numeric(kind) & whole, F.lit("not a whole number")
                value = number.try_cast("bigint")
            case "decimal" | "double":
                ok = _numeric(kind) | (is_text & text.rlike(_NUMBER))
                fit = fits(text, p.scalar_type)
                value, reason = F.when(fit, text.try_cast(target)), F.when(ok & ~fit, F.lit("value does not fit")).otherwise(F.lit("not a number"))
            case "boolean":
                ok, value, reason = kind == "BOOLEAN", F.try_variant_get(cell, "$", "boolean"), F.lit("neither true nor false")
            case "date":
                value = text.try_cast("date")
                ok = is_text & text.rlike(_DATE)
                reason = F.when(is_text, F.lit("not a date like 2024-02-29")).otherwise(F.lit("a date is written as text"))
            case "dateTime":
                value = text.try_cast("timestamp")
                ok = is_text & text.rlike(_INSTANT)
                reason = F.when(is_text, F.lit("not an instant with an offset")).otherwise(
                    F.lit("an instant is written as text")
                )
            case _:
                ok, value, reason = is_text, text, F.lit("not text")
    good = F.coalesce(ok & value.isNotNull(), F.lit(False))
    return F.when(good, value), F.when(~good, reason)


def _cell(p: Property) -> Column:
    """The property's raw value, under its IRI or its short name."""
    return F.coalesce(
        F.try_variant_get("_v", f'$["{p.name}"]', "variant"), F.try_variant_get("_v", f'$["{p.iri}"]', "variant")
    )


def _list(p: Property, cell: Column) -> Column:
    """Array of (typed element, reason), or null where the value is no list."""

    def judge(item: Column, i: Column) -> Column:
        kind = F.schema_of_variant(item)
        value, why = _scalar(p, item, kind)
        why = F.when(kind.startswith("ARRAY"), F.lit("a list inside a list")).otherwise(why)
        reason = F.when(why.isNotNull(), F.concat(F.lit("element "), i.cast("string"), F.lit(": "), why))
        return F.struct(value.alias("value"), reason.alias("reason"))

    return F.transform(F.try_variant_get(cell, "$", "array<variant>"), judge)


def _found(name: Column | str, message: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(name.alias("property"), message.alias("message"))


def _named(name: str, reasons: Column) -> Column:
    return F.transform(reasons, lambda m: _found(name, m))


def coerce(store: ObjectStore, raw: DataFrame, type_name: str) -> tuple[DataFrame, DataFrame]:
    """Split ``raw`` (columns id, raw: JSON object text) into typed rows and violation rows.

    Each record is parsed once; every step is a projection of built-in expressions, and the steps
    are kept apart so that no value is worked out twice. A JSON null counts as absent.
    """
    props = store.schema.properties(type_name)
    derived = store.schema.derived(type_name)
    own_keys = [k for p in props for k in (p.iri, p.name)]
    parsed = raw.select("id", F.try_parse_json("raw").alias("_v"), F.json_object_keys("raw").alias("_keys"))
    other = F.filter("_keys", lambda k: ~k.isin(*own_keys))
    cells = parsed.select(
        "id",
        F.col("_keys").isNotNull().alias("_object"),
        other.alias("_other"),
        F.when(F.size(other) > 0, F.from_json(F.to_json("_v"), "map<string,string>")).alias("_texts"),
        *[_cell(p).alias(f"_c_{p.name}") for p in props],
    )
    kinds = cells.select("*", *[F.schema_of_variant(f"_c_{p.name}").alias(f"_k_{p.name}") for p in props])

    values, reasons = [], []
    for p in props:
        cell, kind = F.col(f"_c_{p.name}"), F.col(f"_k_{p.name}")
        present = kind.isNotNull() & (kind != "VOID")
        if p.read_only:
            why = "is worked out and cannot be given" if p.name in derived else "cannot be given"
            reasons.append(F.when(present, F.array(F.lit(f"{p.name} {why}"))).alias(f"_r_{p.name}"))
        elif p.is_list:
            values.append(F.when(present, _list(p, cell)).alias(f"_l_{p.name}"))
        else:
            value, reason = _scalar(p, cell, kind)
            one = F.when(kind.startswith("ARRAY"), F.lit("one value is due, not a list")).otherwise(reason)
            values.append(F.when(present, value).alias(p.name))
            reasons.append(F.when(present & one.isNotNull(), F.array(one)).alias(f"_r_{p.name}"))
    typed = kinds.select("*", *values, *reasons)

    none = F.array().cast("array<struct<property:string,message:string>>")
    unknown = F.filter(F.col("_other"), lambda k: F.try_element_at(F.col("_texts"), k).isNotNull())
    everything = [
        F.when(~F.col("_object"), F.array(_found("", "not an object"))),
        F.transform(unknown, lambda k: _found(k, F.concat(F.lit("no property is called "), k))),
    ]
    columns = []
    for p in props:
        if p.read_only:
            everything.append(_named(p.name, F.col(f"_r_{p.name}")))
        elif p.is_list:
            items, kind = F.col(f"_l_{p.name}"), F.col(f"_k_{p.name}")
            no_list = kind.isNotNull() & (kind != "VOID") & ~kind.startswith("ARRAY")
            wrong = F.when(no_list, F.array(F.lit("a list is due, not one value"))).otherwise(F.array_compact(items["reason"]))
            everything.append(_named(p.name, wrong))
            columns.append(items["value"].alias(p.name))
        else:
            everything.append(_named(p.name, F.col(f"_r_{p.name}")))
            columns.append(F.col(p.name))
    judged = settled(typed.select("id", *columns, F.concat(*[F.coalesce(x, none) for x in everything]).alias("_violations")))
    good = judged.where(F.size("_violations") == 0).drop("_violations")
    bad = judged.select("id", F.explode("_violations").alias("v")).select("id", "v.property", "v.message")
    return good, bad
