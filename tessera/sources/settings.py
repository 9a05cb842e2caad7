"""Settings in INI files and calibration profiles in JSON: single small files, read through Spark so that they may lie in any store."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.plane import millimetres

#: Names under which settings give the scale, and what states are called.
SCALE_KEYS = ("bill_length_px_per_mm", "feeder1_px_per_mm", "front_px_per_mm", "px_per_mm", "pixels_per_mm")
STATE_KEYS = ("metric_scale_state", "scale_state", "calibration_state")
CONFIDENCE_KEYS = ("scale_confidence", "calibration_confidence")
SOURCE_KEYS = ("scale_source", "calibration_source")
VALIDATED, CANDIDATE = "same_plane_feeder1_validated", "same_plane_feeder1_candidate"


def whole_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0].lstrip("﻿") if rows else ""


def read_settings(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Values by section and key, both lower-cased, quotes taken off; of repeated keys the last counts. Lines that are neither are passed over."""
    parser = configparser.RawConfigParser(strict=False, allow_no_value=True, interpolation=None, delimiters=("=",))
    lines = [line.strip() for line in whole_text(spark, path).splitlines()]
    headed = next((i for i, line in enumerate(lines) if line.startswith("[")), len(lines))
    parser.read_string("\n".join(line for line in lines[headed:] if "=" in line or line.startswith(("[", ";", "#"))))
    return {name.lower(): {k: (v or "").strip().strip("\"'") for k, v in parser.items(name)} for name in parser.sections()}


def positive(value: object) -> float | None:
    try:
        number = float(str(value).strip())
    except ValueError:
        return None
    return number if 0 < number < float("inf") else None


@dataclass
class Calibration:
    px_per_mm: float | None
    state: str
    source: str
    confidence: str
    warnings: list[str] = field(default_factory=list)


def _nulls(part: object) -> int:
    values = part.values() if isinstance(part, dict) else []
    return sum(v is None or v == [] or (isinstance(v, str) and not v.strip()) for v in values)


#: What counts of missing values are called, per part of a profile.
NULL_COUNTS = {"physical_dimensions_mm": "physical_dimensions_mm_null_count", "landmarks_front_image_px": "landmarks_front_image_px_empty_or_null_count", "landmarks_top_image_px": "landmarks_top_image_px_empty_or_null_count"}


def profile_warnings(profile: dict) -> list[str]:
    missing = {label: _nulls(profile.get(name)) for name, label in NULL_COUNTS.items()}
    out = [f"{label}={n}" for label, n in missing.items() if n]
    if profile.get("units", "mm") not in ("", "mm"):
        out.append("profile_units_not_mm")
    estimates = profile.get("scale_estimates") or {}
    if not (positive(estimates.get("front_px_per_mm")) or positive(estimates.get("px_per_mm"))):
        out.append("scale_estimates.front_px_per_mm_missing")
    if profile.get("status") != "validated_calibration_profile":
        out.append(f"profile_status_not_validated status={profile.get('status', '')}")
    return out


def calibrate(settings: dict[str, str], profile_text: str | None = None, px_per_mm: float | None = None) -> Calibration:
    """The scale given, else the one in the settings (a [metrics] section), else the profile's (JSON); state and confidence have defaults by whether there is one."""
    profile = json.loads(profile_text) if profile_text else None
    named = lambda keys: next((settings[k] for k in keys if settings.get(k, "").strip()), "")
    estimates = (profile or {}).get("scale_estimates") or {}
    from_settings = next(((k, positive(settings.get(k))) for k in SCALE_KEYS if positive(settings.get(k))), ("", None))
    from_profile = positive(estimates.get("front_px_per_mm")) or positive(estimates.get("px_per_mm"))
    ways = [(positive(px_per_mm), "given"), (from_settings[1], named(SOURCE_KEYS) or f"settings:{from_settings[0]}"), (from_profile, (profile or {}).get("profile_name") or "profile")]
    scale, source = next(((s, w) for s, w in ways if s), (None, (profile.get("profile_name") or "profile") if profile else "none"))
    warnings = profile_warnings(profile) if profile else []
    if scale is None:
        return Calibration(None, "calibration_assets_found_but_no_px_per_mm" if profile else "uncalibrated_px_only", source, "none", warnings)
    state = named(STATE_KEYS) or CANDIDATE
    confidence = named(CONFIDENCE_KEYS) or ("validated" if state == VALIDATED else "provisional")
    warnings += [f"scale_not_validated state={state}"] if state != VALIDATED else []
    warnings += [f"scale_confidence_not_validated confidence={confidence}"] if confidence != "validated" else []
    return Calibration(scale, state, source, confidence, list(dict.fromkeys(warnings)))


def in_millimetres(df: DataFrame, columns: list[str], scale: Calibration) -> DataFrame:
    """For every column x_px an x_mm, null without a scale."""
    return df.withColumns({c.removesuffix("_px") + "_mm": millimetres(F.col(c), F.lit(scale.px_per_mm).cast("double")) for c in columns})
