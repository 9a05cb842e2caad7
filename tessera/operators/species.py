"""Species labels: an id, six ;-separated names from the class down, the last one common; the best of several, and what may be proposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common names that are no taxon, and what a rank is worth against the others.
NO_TAXON = ("blank", "human", "animal", "no cv result", "unknown")
PRIORITY = {"species": 80.0, "genus": 70.0, "family": 60.0, "order": 50.0, "class": 40.0, "broad": 20.0}
BROAD_ANIMAL = ("animal", "1", "1;;;;;;animal")
PLACES = {"class": 1, "order": 2, "family": 3, "genus": 4, "species": 5, "common": 6}


def label_part(label: Column, place: int) -> Column:
    return F.coalesce(F.trim(F.get(F.split(label, ";"), F.lit(place))), F.lit(""))


def common_name(label: Column) -> Column:
    """The seventh part, or the whole label if that is blank or missing."""
    name = label_part(label, PLACES["common"])
    return F.when(name != "", name).otherwise(F.coalesce(F.trim(label), F.lit("")))


def rank_of(label: Column) -> Column:
    """The finest rank filled (a species needs its genus), the common name if that is no taxon, broad without ranks."""
    common = F.lower(label_part(label, PLACES["common"]))
    part = {rank: label_part(label, place) != "" for rank, place in PLACES.items()}
    return (
        F.when(F.coalesce(F.trim(label), F.lit("")) == "", "unavailable")
        .when(common.isin(*NO_TAXON), common)
        .when(part["genus"] & part["species"], "species")
        .when(part["genus"], "genus")
        .when(part["family"], "family")
        .when(part["order"], "order")
        .when(part["class"], "class")
        .otherwise("broad")
    )


def priority(label: Column) -> Column:
    rank, out = rank_of(label), F.lit(0.0)
    for name, points in PRIORITY.items():
        out = F.when(rank == name, points).otherwise(out)
    return out


def only_broad_animal(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return low.isin(*BROAD_ANIMAL) | low.endswith(";;;;;;animal")


def mentions(label: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    out = F.lit(False)
    for word in words:
        out = out | low.contains(word)
    return out


def rejectable(label: Column) -> Column:
    refused = ("blank", "human", "animal", "no cv result")
    return rank_of(label).isin(*refused, "unavailable") | only_broad_animal(label) | F.lower(common_name(label)).isin(*refused)


def best_label(labels: Column, scores: Column) -> Column:
    """Struct (label, score) of the largest priority plus score among labels that may be proposed, the first of equals.

    Without any, the first label that says bird and no more. Missing scores weigh nothing.
    """
    both = F.transform(labels, lambda x, i: F.struct(F.trim(x).alias("label"), F.get(scores, i).alias("score")))
    usable = F.filter(both, lambda x: x["label"].isNotNull() & ~rejectable(x["label"]))
    weigh = lambda x: priority(x["label"]) + F.coalesce(x["score"], F.lit(0.0))
    none = F.lit(None).cast("struct<label:string,score:double>")
    best = F.aggregate(usable, none, lambda best, x: F.when(best.isNull() | (weigh(x) > weigh(best)), x).otherwise(best))
    birds = F.filter(both, lambda x: (F.lower(common_name(x["label"])) == "bird") | x["label"].endswith(";;;;;bird"))
    return F.coalesce(best, F.get(birds, F.lit(0)))


def review_status(label: Column) -> Column:
    unknown = rank_of(label).isin("blank", "human", "animal", "no cv result", "unavailable") | only_broad_animal(label)
    return F.when(unknown, "unknown").when(F.lower(common_name(label)) == "bird", "unknown_bird").otherwise("proposed")


def confidence_band(score: Column, status: Column, high: float = 0.70, medium: float = 0.30) -> Column:
    asked = F.when(score.isNull(), "confidence_unknown").when(score >= high, "proposed_high").when(score >= medium, "proposed_low").otherwise("weak_guess")
    return F.when(status.isin("unknown", "unknown_bird"), status).otherwise(asked)


def proposal(status: Column, band: Column, wanted: Column) -> Column:
    """What may be shown: a weak guess that doesn't mention the wanted group is not taken at its word."""
    return (
        F.when((band == "weak_guess") & ~wanted, "weak_outside_group")
        .when(status.isin("unknown", "unknown_bird"), status)
        .when(band == "proposed_high", "proposed_candidate_high")
        .when(band == "proposed_low", "proposed_candidate_low")
        .when(band == "weak_guess", "weak_guess")
        .otherwise("proposed_candidate_unscored")
    )


def candidates(df: DataFrame, labels: str, scores: str, most: int = 12) -> DataFrame:
    """One row for each of the first `most` labels of a list, in its place, with what is known of it."""
    each = df.select("*", F.posexplode(F.slice(labels, 1, most)).alias("place", "label"))
    label = F.col("label")
    return each.withColumns({"score": F.get(scores, F.col("place")), "common_name": common_name(label), "rank": rank_of(label), "rejectable": rejectable(label)})


def top_names(df: DataFrame, labels: str, scores: str, first: int = 5, most: int = 25) -> DataFrame:
    """The common names met most often among the first labels of every row; ties by name."""
    named = candidates(df, labels, scores, first).select(F.coalesce(F.nullif("common_name", F.lit("")), F.lit("unknown")).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(most)
