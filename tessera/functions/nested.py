"""Labels and coordinates in JSON objects of many shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.clean import to_number

#: Under which keys labels, scores and lists of predictions are looked for, in this order.
LABEL_KEYS = ("label", "class", "name", "common_name", "scientific_name", "taxon", "prediction", "category")
SCORE_KEYS = ("confidence", "score", "probability", "prob", "p")
LIST_KEYS = ("predictions", "classes", "labels", "top", "top_k", "candidates")
FALSY = ("", "{}", "[]", "0", "0.0", "false")


def _kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _first(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys))


def _entry(v: Column) -> Column:
    """Label and score of one prediction: an object's by their keys, anything else is its own label."""
    object_ = _kind(v, "OBJECT")
    label = F.when(object_, _first(v, LABEL_KEYS)).otherwise(F.try_variant_get(v, "$", "string"))
    score = F.when(object_, to_number(_first(v, SCORE_KEYS), infinite=True))
    return F.struct(F.coalesce(F.trim(label), F.lit("")).alias("label"), score.alias("score"))


def _best(v: Column) -> Column:
    """Of a list (or one object): the labelled entry with the highest score, the first of equals; entries before the first score give way."""
    items = F.when(_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(_kind(v, "OBJECT"), F.array(v))
    start = F.struct(F.lit("").alias("label"), F.lit(None).cast("double").alias("score"))
    better = lambda best, x: F.when((x["label"] != "") & (best["score"].isNull() | F.coalesce(x["score"] > best["score"], F.lit(False))), x).otherwise(best)
    return F.aggregate(F.transform(items, _entry), start, better)


def nested_label(record: Column, parents: tuple[str, ...]) -> Column:
    """Label and score (struct) in JSON text under the first parent key that holds a label: in an object itself, in a list
    inside of it, in a list, or as a plain value. Blank and null if there is none, or the text is no JSON.
    """
    whole, tries = F.try_parse_json(record), []
    for parent in parents:
        v = F.try_variant_get(whole, f"$.{parent}", "variant")
        object_, own = _kind(v, "OBJECT"), _entry(v)
        tries.append(F.when(~_kind(v, "ARRAY") & (own["label"] != ""), own))
        for inner in (F.when(object_, F.try_variant_get(v, f"$.{k}", "variant")) for k in LIST_KEYS):
            tries.append(F.when(_best(inner)["label"] != "", _best(inner)))
        tries.append(F.when(_kind(v, "ARRAY") & (_best(v)["label"] != ""), _best(v)))
    return F.coalesce(*tries, F.struct(F.lit("").alias("label"), F.lit(None).cast("double").alias("score")))


def flexible_coordinate(record: Column, names: tuple[str, ...], parents: tuple[str, ...], axis: str) -> Column:
    """The first number from 0 on under some names of JSON text, else the axis of the first filled parent if that is an object; -1 if missing."""
    flat = [to_number(F.get_json_object(record, f"$.{n}"), infinite=True) for n in names]
    filled = F.coalesce(*(F.when(~t.isin(*FALSY), t) for t in (F.get_json_object(record, f"$.{p}") for p in parents)))
    inner = F.when(filled.startswith("{"), to_number(F.get_json_object(filled, f"$.{axis}"), infinite=True))
    return F.coalesce(*(F.when(x >= 0, x) for x in flat), inner, F.lit(-1.0))
