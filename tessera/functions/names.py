"""What file names of crops tell: source, frame, time, animal, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends that say which part of an animal a crop shows, and from where on a name is no source any more.
PARTS = ["-head", "-throat", "-body", "-tail", "_head", "_throat", "_body", "_tail"]
TAILS = [r"(?i)-frame-\d{6,10}-t\d+(?:\.\d+)?-animal-\d+.*$", r"(?i)-frame-\d{6,10}.*$", r"(?i)_frame_\d{6,10}.*$", r"(?i)-animal-\d+.*$"]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def crop_name(path: Column) -> dict[str, Column]:
    """Source, frame, time, animal and confidence (0 to 1) in a crop's name; -1 where a number is missing, confidence 0."""
    name = stem(path)
    source = F.regexp_replace(F.regexp_extract(name, r"(?i)^(.*?)(?:^|-)frame-\d+", 1), "-+$", "")
    whole = F.when(name.rlike(r"(?i)(?:^|-)frame-\d+"), source).otherwise(name)
    number = lambda pattern, kind, other: F.coalesce(_found(name, pattern).try_cast(kind), F.lit(other))
    return {
        "source": F.coalesce(F.nullif(whole, F.lit("")), F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)),
        "frame": number(r"(?i)(?:^|-)frame-(\d+)", "long", -1), "seconds": number(r"(?i)(?:^|-)t(\d+(?:\.\d+)?)", "double", -1.0),
        "animal": number(r"-animal-(\d+)", "int", -1), "confidence": number(r"-conf(\d+)", "int", 0) / 100,
    }


def source_key(path: Column) -> Column:
    """The name without part, frame and animal: crops of one video share it. The first pattern that fits is cut off, no other."""
    name = reduce(lambda out, part: F.regexp_replace(out, f"(?i){part}$", ""), PARTS, stem(path))
    cut = reduce(lambda out, tail: F.when(name.rlike(tail), F.regexp_replace(name, tail, "")).otherwise(out), reversed(TAILS), name)
    return F.coalesce(F.nullif(cut, F.lit("")), F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*$", 1))


def frame_number(path: Column) -> Column:
    return _found(stem(path), r"(?i)[-_]frame[-_](\d{6,10})").try_cast("long")


def suppressed(a: Column, b: Column, same_source: bool, near_frames: int | None) -> Column:
    """Why a pair of crops is not worth comparing, else null: one source, or near frames of one source."""
    same, gap = source_key(a) == source_key(b), F.abs(frame_number(a) - frame_number(b))
    out = F.lit(None).cast("string")
    if near_frames is not None:
        out = F.when(same & (gap <= near_frames), "near_frame")
    return F.when(same, "same_source").otherwise(out) if same_source else out


def vector_text(text: Column) -> Column:
    """A vector written as a JSON list, or under embedding, vector or values of an object; null if an element is no number."""
    inner = F.coalesce(*(F.when(F.get_json_object(text, f"$.{k}").startswith("["), F.get_json_object(text, f"$.{k}")) for k in ("embedding", "vector", "values")), text)
    parts = F.when(inner.startswith("["), F.from_json(inner, "array<string>"))
    values = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull()), values)
