"""Manifest text to typed values. Every manifest column is text, and blank means missing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(df: DataFrame, aliases: list[str]) -> tuple[Column, Column]:
    """The first alias of the row that is not blank, and which one it was. Aliases that df lacks are passed over."""
    there = [a for a in aliases if a in df.columns]
    filled = [blank_to_null(F.col(a).cast("string")) for a in there]
    if not there:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return F.coalesce(*filled), F.coalesce(*(F.when(c.isNotNull(), F.lit(a)) for a, c in zip(there, filled, strict=True)))


def to_number(c: Column, infinite: bool = False, default: float | None = None) -> Column:
    """Text as double; unreadable text and NaN are missing, infinities too unless kept. Digits only as Python reads them: no 2.5d."""
    text = F.trim(c)  # each step names the one before as seldom as it can: Spark may work it out anew each time
    digits = F.when(text.contains("_"), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")).otherwise(text)
    value = F.when(~text.rlike(r"[dD]$|(?<![iI][nN])[fF]$"), digits.try_cast("double"))
    value = F.nanvl(value, F.lit(None).cast("double")) if infinite else F.when(F.abs(value) < float("inf"), value)
    return F.coalesce(value, F.lit(default)) if default is not None else value


def to_whole(c: Column, half_even: bool = False) -> Column:
    value = to_number(c, infinite=True)  # infinities are no whole numbers either; left to the cast, the value is named once
    return (F.bround(value) if half_even else value).try_cast("long")


def to_flag(c: Column, on_off: bool = False, default: bool | None = None) -> Column:
    word = F.lower(F.trim(c))
    yes, no = TRUE_WORDS + (("on",) if on_off else ()), FALSE_WORDS + (("off",) if on_off else ())
    value = F.when(word.isin(*yes), True).when(word.isin(*no), False)
    return F.coalesce(value, F.lit(default)) if default is not None else value


#: What becomes of a header's characters, in this order, once it is in lower case.
HEADER_STEPS = [(r"^\s+|\s+$", ""), (r"[\s-]+", "_"), (r"[^a-z0-9_]+", ""), (r"_+", "_"), (r"^_|_$", "")]


def header_name(c: Column) -> Column:
    return reduce(lambda name, step: F.regexp_replace(name, *step), HEADER_STEPS, F.lower(c))


def header_names(df: DataFrame) -> list[str]:
    """header_name of the column names themselves."""
    return [reduce(lambda name, step: re.sub(*step, name), HEADER_STEPS, c.lower()) for c in df.columns]


def path_key(c: Column) -> Column:
    """Paths that differ in slashes, doubled separators or case are one key."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "/", r"\\"), r"\\+", r"\\"))


def base_name(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, r"[/\\]"), -1))


def parent_folder(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)[/\\][^/\\]*$", 1)


def safe_name(c: Column, fallback: str = "unnamed", filler: str = "_") -> Column:
    name = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", filler), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix, dash, and 12 hexadecimal digits of the SHA-1 of the parts joined by bars; a null part reads None."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(joined), 1, 12))


def row_id(alias: Column, number: Column) -> Column:
    return F.coalesce(alias, F.format_string("row-%06d", number))


def frame_key(path: Column, source: Column, index: Column, seconds: Column) -> Column:
    """The frame's path, else source and index, else source and time, else blank."""
    path, source, index, seconds = (blank_to_null(c.cast("string")) for c in (path, source, index, seconds))
    return F.coalesce(
        path_key(path),
        F.when(source.isNotNull() & index.isNotNull(), F.concat_ws("::", source, F.lit("frame"), index)),
        F.when(source.isNotNull() & seconds.isNotNull(), F.concat_ws("::", source, F.lit("time"), seconds)),
        F.lit(""),
    )


#: How capture times are written in file names, tried in this order. The last two have no time of day.
NAME_TIMES = [
    r"(20\d{2})(\d{2})(\d{2})[_\- ]?(\d{2})(\d{2})(\d{2})",
    r"(20\d{2})[_\-](\d{2})[_\-](\d{2})[_\- ](\d{2})[_\-](\d{2})[_\-](\d{2})",
    r"(20\d{2})[_\-](\d{2})[_\-](\d{2})",
    r"(20\d{2})(\d{2})(\d{2})",
]
#: Date, time and offset of ISO text; any one character stands between date and time.
ISO_TIME = r"^(\d{4}-\d{2}-\d{2})(?:.(\d{2}:\d{2})(:\d{2})?(?:[.,]\d+)?(Z|[+-]\d{2}:\d{2})?)?$"


def name_time(c: Column) -> Column:
    """Capture time in a file name; a pattern whose digits make no date gives way to the next."""
    base = F.element_at(F.split(F.regexp_replace(c, r"[/\\]+$", ""), r"[/\\]"), -1)
    tries = []
    for pattern in NAME_TIMES:
        groups = pattern.count("(")
        part = [F.regexp_extract(base, pattern, k) if k <= groups else F.lit("00") for k in range(1, 7)]
        text = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "), part[3], F.lit(":"), part[4], F.lit(":"), part[5])
        tries.append(F.when(base.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))))
    return F.coalesce(*tries)


def any_time(*values: Column) -> Column:
    """The first of some texts that tells a time, as ISO text to the second: it is ISO text itself (an offset stays), or a file name."""
    tries = []
    for value in values:
        date, clock, second, offset = (F.regexp_extract(value, ISO_TIME, k) for k in range(1, 5))
        whole = F.concat(date, F.lit(" "), F.coalesce(F.nullif(clock, F.lit("")), F.lit("00:00")), F.coalesce(F.nullif(second, F.lit("")), F.lit(":00")))
        iso = F.try_to_timestamp(F.when(value.rlike(ISO_TIME), whole), F.lit("yyyy-MM-dd HH:mm:ss"))
        shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
        tries += [F.concat(shown(iso), F.when(offset == "Z", "+00:00").otherwise(offset)), shown(name_time(value))]
    return F.coalesce(*tries)


def fixed_digits(c: Column, digits: int) -> Column:
    """A number with so many digits behind the point; blank if missing or not finite."""
    fine = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(fine, F.format_string(f"%.{digits}f", c)).otherwise("")


def number_list(c: Column, default: list[float]) -> Column:
    """Numbers apart by commas or semicolons, blank ones left out; the default if none is there."""
    pieces = F.filter(F.transform(F.split(c, "[;,]"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    values = F.transform(pieces, lambda p: p.try_cast("double"))
    return F.when(F.size(values) > 0, values).otherwise(F.array(*map(F.lit, default)))


def under_folder(path: Column, root: Column) -> Column:
    """Whether a path is a folder or lies in it, by path_key."""
    inner, outer = path_key(path), F.regexp_replace(path_key(root), r"\\+$", "")
    return (inner == outer) | inner.startswith(F.concat(outer, F.lit("\\")))


def auto_number(c: Column, prefix: str = "Bird", digits: int = 5) -> Column:
    """Number of a canonical name such as Bird00042, else null."""
    return F.when(c.rlike(f"^{prefix}[0-9]{{{digits}}}$"), F.substring(c, len(prefix) + 1, digits).try_cast("int"))


def auto_name(number: Column, prefix: str = "Bird", digits: int = 5) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", number)
