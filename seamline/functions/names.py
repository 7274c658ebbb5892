"""Folder names: product spec, canonical key, production date, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matrices import let

#: The pattern of a spec, and beam sizes in mm by inches.
SPEC = r"[\s_]((H|W\d+x|HP\d+x)?(\d+)x(\d+))"
INCH_TO_MM = {"10": 254, "12": 305, "14": 356, "16": 406, "18": 457, "21": 533, "24": 610, "27": 686, "30": 762}
#: Camera groups, the second camera of each mirrored.
CAMERA_GROUPS = {1: (1, 10), 2: (2, 9), 3: (3, 8), 4: (4, 7), 5: (5, 6)}


def parse_spec(name: Column) -> Column:
    """struct(raw_spec, width_mm, height_mm); null where the name has no spec or an unknown W size."""
    found = let(F.regexp_extract(name, SPEC, 1), lambda raw: F.when(raw != "", F.struct(raw.alias("raw"), F.regexp_extract(raw, r"^(?:W|HP)(\d+)x", 1).alias("inches"), F.split(F.regexp_extract(raw, r"(\d+x\d+)$", 1), "x").alias("d"))))
    known = F.create_map(*[F.lit(x) for kv in INCH_TO_MM.items() for x in kv])

    def sized(x: Column) -> Column:
        raw, inches, d1, d2 = x["raw"], x["inches"], x["d"][0].cast("int"), x["d"][1].cast("int")
        size = F.try_element_at(known, inches)
        width = F.when(raw.startswith("W"), size).when(raw.startswith("HP"), F.coalesce(size, d1)).otherwise(d1)
        height = F.when(inches != "", width).otherwise(d2)
        return F.when(width.isNotNull(), F.struct(raw.alias("raw_spec"), width.alias("width_mm"), height.alias("height_mm")))

    return let(found, sized)


def spec_key(raw: Column) -> Column:
    """The spec without a leading H before digits."""
    return F.regexp_replace(raw, r"^H(\d+x\d+)", "$1")


def prod_date(name: Column) -> Column:
    """Date of the leading eight digits, null without."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"^(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def natural_key(name: Column) -> Column:
    """array<string> that sorts digit runs by their number."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))


def mirrored(cam: Column) -> Column:
    """True for the second camera of a group."""
    return cam.isin([b for _, b in CAMERA_GROUPS.values()])


def camera_group(cam: Column) -> Column:
    return F.least(cam, 11 - cam)


def plain(line: Column) -> Column:
    """A log line without terminal colours."""
    return F.regexp_replace(line, r"\x1b\[[0-9;]*m", "")


def log_fields(line: Column) -> Column:
    """map of the key=value pairs of a log line."""
    pairs = F.regexp_extract_all(plain(line), F.lit(r"(\w+=[^\s,]+)"), F.lit(1))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split(p, "=", 2)[0].alias("key"), F.split(p, "=", 2)[1].alias("value"))))


def wide_first(size: Column) -> Column:
    """A size like 200x50 or 50X200 with the wider side first; null where it isn't one."""
    side = lambda i: F.regexp_extract(size, r"^(\d+)[xX](\d+)$", i).try_cast("int")
    return F.concat(F.greatest(side(1), side(2)).cast("string"), F.lit("x"), F.least(side(1), side(2)).cast("string"))


def at_first_underscore(name: Column) -> Column:
    """What stands before and after the first underscore."""
    return F.split(name, "_", 2)
