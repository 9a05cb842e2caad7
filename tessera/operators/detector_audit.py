"""The detector's output audited over its tables: boxes, links, roles, crop files and what manifest and ledger claim, run by run.

Every table has a column run, so one job audits any number of runs. Inputs, results, detections and crops are manifest text;
files is the inventory (path, length); claims holds manifest and ledger as rows (run, source: manifest or ledger, field, value as text).
Columns that a table lacks count as aliases that no row fills. Tables may be empty; rows of a null run are a run of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.clean import blank_to_null, first_filled, to_flag, to_number, to_whole
from tessera.operators.numbering import cut
from tessera.operators.paths import tidy
from tessera.operators.spread import HEAVY_SHARE, join_counted, join_spread

# Under which names fields are looked for, in this order.
BOX_ALIASES = {
    "x1": ["bbox_x1", "x1", "xmin", "left"], "y1": ["bbox_y1", "y1", "ymin", "top"], "x2": ["bbox_x2", "x2", "xmax", "right"], "y2": ["bbox_y2", "y2", "ymax", "bottom"],
    "width": ["bbox_width", "width", "w"], "height": ["bbox_height", "height", "h"], "center_x": ["bbox_center_x", "center_x", "cx"], "center_y": ["bbox_center_y", "center_y", "cy"],
    "area": ["bbox_area_px", "bbox_area", "area_px", "area"],
}
ID_ALIASES = ["detection_id", "detector_detection_id", "crop_id", "frame_id", "detector_input_id", "sampled_frame_id"]
INPUT_KEYS = ["detector_input_id", "frame_id", "sampled_frame_id", "input_frame_id"]
DETECTION_KEYS = ["detection_id", "detector_detection_id"]
CLASS_NAMES = ["class_name", "detector_class_name", "name", "label"]
DETECTION_ROLES = ["detection_role", "role", "downstream_role", "class_role"]
CROP_ROLES = ["detection_role", "role", "downstream_role"]
CROP_PATHS = ["crop_path", "output_crop_path", "path"]
CROP_BYTES = ["crop_bytes", "bytes_written", "file_size_bytes", "size_bytes"]
ROLE_WORDS = {"animal": ("animal", "bird"), "person": ("person", "human"), "vehicle": ("vehicle", "car", "truck")}
ROLES = ("animal", "person", "vehicle", "other", "unknown")
CLAIM_ALIASES = {
    "inputs": ["detector_input_frames", "detector_input_rows"], "detections": ["detections_written", "detection_rows"], "crops": ["crop_exports_written", "crop_export_rows"],
    "animal": ["animal_detections"], "person": ["person_detections"], "vehicle": ["vehicle_detections"], "other": ["other_detections"],
    "crop_bytes": ["crop_export_bytes_written", "crop_bytes_written"], "max_crops": ["max_crop_exports_total"], "max_mb": ["max_bytes_total_mb"],
    "mutation": ["database_mutation"], "durable": ["durable_evidence_written"], "video": ["source_video"], "video_available": ["source_video_available"], "mode": ["crop_export_mode"],
}
#: Only the ledger's bytes go by this name too.
LEDGER_BYTES = [*CLAIM_ALIASES["crop_bytes"], "bytes_written"]
SOURCES = ("manifest", "ledger")
#: Box sides may differ by so many pixels, areas by these pixels or this share of what is recorded.
SIDE_TOLERANCE, AREA_PIXELS, AREA_SHARE = 1.01, 2.0, 0.02
#: Tables of so many rows (runs, unknown keys) are broadcast, larger ones shuffled.
FEW_ROWS = 100_000


def present(df: DataFrame, aliases: list[str]) -> Column:
    """The first alias that df has as a column, filled or not; null if it has none."""
    return next((F.col(a).cast("string") for a in aliases if a in df.columns), F.lit(None).cast("string"))


def box(df: DataFrame) -> Column:
    """A row's box as a struct of doubles by the names of BOX_ALIASES; what is no number is null."""
    return F.struct(*(to_number(present(df, aliases), infinite=True).alias(name) for name, aliases in BOX_ALIASES.items()))


def role(df: DataFrame) -> Column:
    """A detection's role: what it says itself (anything but ROLES is other), else by words in its class; unknown without either."""
    return _role_of(*_role_words(df))


def _role_words(df: DataFrame) -> tuple[Column, Column]:
    return F.lower(first_filled(df, DETECTION_ROLES)[0]), F.lower(first_filled(df, CLASS_NAMES)[0])


def _role_of(said: Column, named: Column) -> Column:
    by_class = reduce(lambda out, r: F.when(_has(named, ROLE_WORDS[r]), r).otherwise(out), reversed(ROLE_WORDS), F.lit("other"))
    return F.when(said.isNotNull(), F.when(said.isin(*ROLES), said).otherwise("other")).when(named.isNotNull(), by_class).otherwise("unknown")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.contains(w) for w in words))


def claimed(claims: DataFrame) -> DataFrame:
    """One row per run: of each source (struct) whether it is there, and its fields by the names of CLAIM_ALIASES, as text."""
    fields = []
    for source in SOURCES:
        own = F.col("source") == source
        names = CLAIM_ALIASES | ({"crop_bytes": LEDGER_BYTES} if source == "ledger" else {})
        place = {n: F.when(own, reduce(lambda out, k: F.when(F.col("field") == names[n][k], k).otherwise(out), reversed(range(len(names[n]))), F.lit(None))) for n in names}  # noqa: B023
        fields.append(F.struct(F.count_if(own).alias("rows"), *(blank_to_null(F.min_by("value", p)).alias(n) for n, p in place.items())).alias(source))
    return claims.groupBy("run").agg(*fields)


def crops_with_files(crops: DataFrame, files: DataFrame) -> DataFrame:
    """Crops as (run, id, path, bytes of the file if it is there, bytes recorded, role, class); paths that many crops share are met where they are."""
    inventory = files.select(tidy(F.col("path")).alias("__file"), F.col("length").cast("long").alias("file_bytes")).where("__file is not null").groupBy("__file").agg(F.max("file_bytes").alias("file_bytes"))
    path = first_filled(crops, CROP_PATHS)[0]
    rows = crops.select("run", first_filled(crops, ID_ALIASES)[0].alias("id"), path.alias("path"), tidy(path).alias("__file"), to_whole(present(crops, CROP_BYTES)).alias("recorded"), F.lower(first_filled(crops, CROP_ROLES)[0]).alias("role"), F.lower(first_filled(crops, CLASS_NAMES)[0]).alias("class"))
    return join_counted(rows, inventory, ["__file"], ["run", "id", "path"]).drop("__file")


def totals(inputs: DataFrame, results: DataFrame, detections: DataFrame, crops: DataFrame) -> DataFrame:
    """Counters per run over all tables (crops from crops_with_files): one aggregate over their union, summed up in every task first."""
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    said, named = _role_words(detections)
    # Step by step: an expression that counters share would stand in each of them, in more code than Java compiles
    found = detections.select("run", first_filled(detections, DETECTION_KEYS)[0].isNotNull().alias("detection_ids"), said.alias("said"), named.alias("named")).withColumn("role", _role_of(F.col("said"), F.col("named")))
    parts = [
        inputs.select("run", F.lit(1).alias("inputs"), one(first_filled(inputs, INPUT_KEYS)[0].isNotNull()).alias("input_ids")),
        results.select("run", F.lit(1).alias("results")),
        found.select("run", F.lit(1).alias("detections"), one(F.col("detection_ids")).alias("detection_ids"), *(one(F.col("role") == r).alias(r) for r in ROLES)),
        crops.select("run", F.lit(1).alias("crops"), F.coalesce("file_bytes", F.lit(0).cast("long")).alias("crop_bytes")),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.groupBy("run").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in together.columns if c != "run"))


def _found(df: DataFrame, id_: Column, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(run, level, code, id) for each rule that a row breaks."""
    broken = F.array(*(F.when(c, F.lit(code)) for code, (_, c) in rules.items()))  # array_compact would be a lambda: Spark interprets it with all rules inside
    level = F.when(F.col("code").isin(*(code for code, (level, _) in rules.items() if level == "warning")), "warning").otherwise("error")
    return df.select("run", id_.cast("string").alias("id"), F.explode(broken).alias("code")).where("code is not null").select("run", level.alias("level"), "code", "id")


def _few(table: DataFrame, most: int) -> bool:
    return table.limit(most + 1).count() <= most


def _with_runs(rows: DataFrame, table: DataFrame, on: str, spread: list[str]) -> DataFrame:
    """rows left-joined to a staged table with one row per run."""
    return rows.join(F.broadcast(table), on, "left") if _few(table, FEW_ROWS) else join_counted(rows, table, [on], spread)


def _run_key() -> Column:
    """A run as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("run").cast("string")), F.lit(""))


def _unknown_links(rows: DataFrame, link: Column, targets: DataFrame, counts: DataFrame, n: str, of: str, code: str) -> DataFrame:
    """Rows whose filled link is no key of their run. Runs whose targets have no key at all are told as unverified, not here.

    counts is staged; its column n tells how many keys a run's targets have, and of how many rows it has. Keys of both sides are
    counted together first; then rows meet only the unknown keys, and known ones that very many rows have.
    """
    asked = rows.select(_run_key().alias("__run"), blank_to_null(link.cast("string")).alias("key"), "run", "id").where("key is not null")
    known = targets.where("key is not null").select(_run_key().alias("__run"), "key", F.lit(0).alias("__n"), F.lit(1).alias("__known"))
    keys = asked.select("__run", "key", F.lit(1).alias("__n"), F.lit(0).alias("__known")).union(known).groupBy("__run", "key").agg(F.sum("__n").alias("__n"), (F.max("__known") == 0).alias("__lost"))
    many = (counts.agg(F.sum(of)).first()[0] or 0) // HEAVY_SHARE
    keyed = counts.where(F.col(n) > 0).select(_run_key().alias("__run"), F.lit(True).alias("__keyed"))
    lost = cut(_with_runs(keys.where((F.col("__n") > 0) & (F.col("__lost") | (F.col("__n") > many))), keyed, "__run", ["key"]).select("__run", "key", "__n", (F.col("__lost") & F.coalesce("__keyed", F.lit(False))).alias("__lost")))
    on = ["__run", "key"]
    met = asked.join(F.broadcast(lost.where("__lost").drop("__n")), on) if _few(lost, FEW_ROWS) else join_spread(asked, lost, on, "__n", ["id"]).where("__lost")
    return met.select("run", F.lit("error").alias("level"), F.lit(code).alias("code"), F.coalesce("id", "key").alias("id"))


def _of_boxes(detections: DataFrame) -> DataFrame:
    rows = detections.select("run", first_filled(detections, ID_ALIASES)[0].alias("id"), box(detections).alias("b")).select("run", "id", "b.*")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = F.col("area")
    return _found(rows, F.col("id"), {
        "box_missing": ("error", w.isNull() | h.isNull()),
        "box_order": ("error", (w <= 0) | (h <= 0)),
        "box_width": ("warning", F.abs(w - F.col("width")) > SIDE_TOLERANCE),
        "box_height": ("warning", F.abs(h - F.col("height")) > SIDE_TOLERANCE),
        "box_area": ("warning", F.abs(w * h - area) > F.greatest(F.lit(AREA_PIXELS), AREA_SHARE * F.greatest(F.lit(1.0), area))),
    })


def _of_crops(crops: DataFrame, told: DataFrame) -> DataFrame:
    mode = F.lower(F.coalesce("manifest.mode", "ledger.mode"))
    modes = told.where(F.col("run").isNotNull()).select("run", (mode == "animal_preview").alias("__preview"))
    rows = _with_runs(crops, modes, "run", ["id", "path"])
    there, preview = F.col("path").isNotNull() & F.col("file_bytes").isNotNull(), F.coalesce("__preview", F.lit(False))
    return _found(rows, F.coalesce("id", "path"), {
        "crop_path_missing": ("warning", F.col("path").isNull()),
        "crop_file_missing": ("error", F.col("path").isNotNull() & F.col("file_bytes").isNull()),
        "crop_bytes_differ": ("warning", there & (F.col("recorded") != F.col("file_bytes"))),
        "crop_role_refused": ("error", there & preview & (F.col("role") != "animal")),
        "crop_class_refused": ("warning", there & preview & F.col("role").isNull() & ~_has(F.col("class"), ROLE_WORDS["animal"])),
    })


def _of_runs(runs: DataFrame, has_link: bool, has_crop_link: bool) -> DataFrame:
    """What concerns a run as a whole; runs: totals and claims, outer-joined."""
    whole = lambda source, name: to_whole(F.col(f"{source}.{name}"))
    rules: dict[str, tuple[str, Column]] = {}
    for source in SOURCES:
        rules[f"{source}_missing"] = ("error", F.coalesce(f"{source}.rows", F.lit(0)) == 0)
        for name in ("mutation", "durable"):
            flag = to_flag(F.col(f"{source}.{name}"))
            rules[f"{source}_{name}"] = ("error", flag)
            rules[f"{source}_{name}_unknown"] = ("warning", flag.isNull())
        for name in ("inputs", "detections", "crops", "crop_bytes"):
            rules[f"{source}_{name}_differ"] = ("error", whole(source, name) != F.col(name))
    for name in ("animal", "person", "vehicle", "other"):
        rules[f"manifest_{name}_differ"] = ("warning", whole("manifest", name) != F.col(name))
    rules["results_differ_from_inputs"] = ("warning", F.col("results") != F.col("inputs"))
    rules["source_video_missing"] = ("error", F.col("video").isNotNull() & F.col("video_bytes").isNull())
    rules["source_video_unrecorded"] = ("warning", F.col("video").isNull())
    rules["detection_links_unverified"] = ("warning", (F.col("detections") > 0) & ((F.col("input_ids") == 0) | F.lit(not has_link)))
    rules["crop_links_unverified"] = ("warning", (F.col("crops") > 0) & ((F.col("detection_ids") == 0) | F.lit(not has_crop_link)))
    limit = lambda name: F.coalesce(F.nullif(to_number(F.col(f"ledger.{name}")), F.lit(0.0)), to_number(F.col(f"manifest.{name}")))
    rules["crops_over_budget"] = ("error", F.col("crops") > F.floor(limit("max_crops")))
    rules["bytes_over_budget"] = ("error", F.col("crop_bytes") > limit("max_mb") * 1048576)
    return _found(runs, F.lit(""), rules)


def audited_runs(counts: DataFrame, told: DataFrame, files: DataFrame) -> DataFrame:
    """Totals and claims of every run that has either, with the source video named (manifest before ledger) and its file's bytes."""
    told = told.withColumnRenamed("run", "__run")
    both = counts.join(told, F.col("run").eqNullSafe(F.col("__run")), "full").select(F.coalesce("run", "__run").alias("run"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts.columns if c != "run"), *SOURCES)
    both = both.withColumn("video", F.coalesce("manifest.video", "ledger.video")).withColumn("__file", tidy(F.col("video")))
    inventory = files.select(tidy(F.col("path")).alias("__file"), F.col("length").alias("video_bytes")).groupBy("__file").agg(F.max("video_bytes").alias("video_bytes"))
    return both.join(inventory, "__file", "left").drop("__file")


def audited(inputs: DataFrame, results: DataFrame, detections: DataFrame, crops: DataFrame, files: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """detector_issues and totals of the same tables; what has a row per run is staged and worked out once."""
    stored, told = crops_with_files(crops, files), cut(claimed(claims))
    counts = cut(totals(inputs, results, detections, stored))
    parts = [_of_boxes(detections), _of_crops(stored, told)]
    link = next((c for c in INPUT_KEYS if c in detections.columns), None)
    if link:
        rows = detections.withColumn("id", first_filled(detections, ID_ALIASES)[0])
        parts.append(_unknown_links(rows, F.col(link), inputs.select("run", first_filled(inputs, INPUT_KEYS)[0].alias("key")), counts, "input_ids", "detections", "detection_input_unknown"))
    crop_link = next((c for c in DETECTION_KEYS if c in crops.columns), None)
    if crop_link:
        rows = crops.withColumn("id", first_filled(crops, ID_ALIASES)[0])
        parts.append(_unknown_links(rows, F.col(crop_link), detections.select("run", first_filled(detections, DETECTION_KEYS)[0].alias("key")), counts, "detection_ids", "crops", "crop_detection_unknown"))
    parts.append(_of_runs(audited_runs(counts, told, files), link is not None, crop_link is not None))
    return reduce(DataFrame.unionByName, parts), counts


def detector_issues(inputs: DataFrame, results: DataFrame, detections: DataFrame, crops: DataFrame, files: DataFrame, claims: DataFrame) -> DataFrame:
    """Issues (run, level, code, id): a row for each fault of each row; issues of a run as a whole have a blank id, rows without an id a null one.

    Links are checked by the first key column that detections or crops have. A coordinate that is no number is missing.
    """
    return audited(inputs, results, detections, crops, files, claims)[0]


def detector_report(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """Per run: its totals, how many errors and warnings, and PASS if no error is among them. Runs known from issues alone have null totals."""
    levels = issues.groupBy(F.col("run").alias("__run")).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    both = counts.join(levels, F.col("run").eqNullSafe(F.col("__run")), "full")
    n = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("errors", "warnings")}
    status = F.when(F.coalesce("errors", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("status")
    return both.select(F.coalesce("run", "__run").alias("run"), *(c for c in counts.columns if c != "run"), *n.values(), status)
