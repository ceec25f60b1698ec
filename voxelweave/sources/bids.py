"""Metadata of recordings under BIDS names: a table of fields, and sidecars checked against it as a DataFrame.

Sidecars are rows of JSON text. Parsing, checks of every field and rules between fields are column expressions over one
pass of the rows, so a corpus of sidecars is checked without a shuffle, and what is wrong comes out as rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The fields of a sidecar as (name, item, shape, bound). An item is text, a number, a count (a whole
#: number) or a direction; shapes are one item, a list, a pair, lists (a list of items or a list of lists of them), or
#: one item or another shape. A bound holds for one item: above zero, or not below it.
FIELDS = [
    ("Manufacturer", "text", "one", None),
    ("ManufacturersModelName", "text", "one", None),
    ("DeviceSerialNumber", "text", "one or list", None),
    ("StationName", "text", "one", None),
    ("SoftwareVersion", "text", "one", None),
    ("ProbeManufacturer", "text", "one", None),
    ("ProbeType", "text", "one", None),
    ("ProbeModel", "text", "one", None),
    ("ProbeSerialNumber", "text", "one or list", None),
    ("ProbeCentralFrequency", "number", "one", "> 0"),
    ("ProbeNumberOfElements", "count", "one or pair", None),
    ("ProbePitch", "number", "one or pair", None),
    ("ProbeRadiusOfCurvature", "number", "one", None),
    ("ProbeFocalWidth", "number", "one", "> 0"),
    ("ProbeFocalDepth", "number", "one", "> 0"),
    ("ProbeAperture", "number", "one", "> 0"),
    ("Depth", "number", "pair", None),
    ("UltrasoundTransmitFrequency", "number", "one", "> 0"),
    ("UltrasoundPulseRepetitionFrequency", "number", "one", "> 0"),
    ("PlaneWaveAngles", "number", "lists", None),
    ("VirtualSources", "count", "one", "> 0"),
    ("CompoundSamplingFrequency", "number", "one", "> 0"),
    ("ProbeVoltage", "number", "one", ">= 0"),
    ("SequenceName", "text", "one", None),
    ("TransmitAperture", "count", "lists", None),
    ("ReceiveAperture", "count", "lists", None),
    ("BeamformingMethod", "text", "one", None),
    ("BeamformingSoundVelocity", "number", "one", "> 0"),
    ("ClutterFilterWindowDuration", "number", "one", "> 0"),
    ("ClutterFilterWindowStride", "number", "one", "> 0"),
    ("ClutterFilters", "text", "one or list", None),
    ("PowerDopplerIntegrationDuration", "number", "one", "> 0"),
    ("PowerDopplerIntegrationStride", "number", "one", "> 0"),
    ("VolumeTiming", "number", "list", None),
    ("RepetitionTime", "number", "one", "> 0"),
    ("SliceTiming", "number", "list", None),
    ("SliceEncodingDirection", "direction", "one", None),
    ("DelayTime", "number", "one", ">= 0"),
    ("FrameAcquisitionDuration", "number", "one", "> 0"),
    ("DelayAfterTrigger", "number", "one", ">= 0"),
    ("TaskName", "text", "one", None),
    ("TaskDescription", "text", "one", None),
    ("CogAtlasID", "text", "one", None),
    ("CogPOID", "text", "one", None),
    ("InstitutionName", "text", "one", None),
    ("InstitutionAddress", "text", "one", None),
    ("InstitutionalDepartmentName", "text", "one", None),
]
NAMES = {name for name, *_ in FIELDS}

#: Names whose BIDS form isn't the plain one, fields that BIDS doesn't know, directions.
SPECIAL = {"transmit_frequency": "UltrasoundTransmitFrequency", "pulse_repetition_frequency": "UltrasoundPulseRepetitionFrequency", "volume_acquisition_duration": "FrameAcquisitionDuration"}
OWN = {"sform_code", "qform_code", "affines", "units", "voxdim", "long_name", "cmap", "bmode_integration_duration", "bmode_integration_stride", "axial_velocity_integration_duration", "axial_velocity_integration_stride", "axial_velocity_lag", "axial_velocity_spatial_kernel", *(f"dim{k}_{part}" for k in (4, 5, 6) for part in ("name", "coordinates", "attrs"))}
DIRECTIONS = ["i", "j", "k", "i-", "j-", "k-"]

#: What a message says of an item.
SAYS = {"text": "must be text", "number": "must be a number", "count": "must be a whole number", "direction": f"must be one of {', '.join(DIRECTIONS)}"}
TIMING = ["RepetitionTime", "VolumeTiming", "SliceTiming", "SliceEncodingDirection", "DelayTime", "FrameAcquisitionDuration", "DelayAfterTrigger"]


def pascal(name: str) -> str:
    return "".join(part.capitalize() for part in name.split("_"))


#: BIDS names back to plain ones; a run of capitals is one word.
PLAIN = {n: re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", n).lower() for n in NAMES} | {v: k for k, v in SPECIAL.items()}
BIDS = {v: k for k, v in PLAIN.items()}


def to_bids(attrs: dict, prefix: str = "Voxelweave") -> dict:
    """Names of metadata as BIDS has them; fields that only recordings have take the prefix, unknown ones stay."""
    known = BIDS | {pascal_key: pascal_key for pascal_key in NAMES}
    name = lambda k: prefix + pascal(k) if k in OWN else known.get(k) or (pascal(k) if pascal(k) in NAMES else k)
    return {name(k): v for k, v in attrs.items()}


def from_bids(attrs: dict, prefix: str = "Voxelweave") -> dict:
    """The way back: known names become plain, prefixed ones lose the prefix, others stay."""
    own = {prefix + pascal(k): k for k in OWN}
    return {own.get(k) or PLAIN.get(k, k): v for k, v in attrs.items()}


def load_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row for each sidecar."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _fits(x: Column, item: Column) -> Column:
    """Whether a JSON value is such an item. Numbers may be written as text or as true and false."""
    number = F.try_variant_get(x, "$", "double")
    text = F.schema_of_variant(x) == "STRING"
    fits = F.when(item == "text", text).when(item == "direction", text & F.try_variant_get(x, "$", "string").isin(DIRECTIONS))
    return F.coalesce(fits.when(item == "count", number == F.floor(number)).otherwise(number.isNotNull()), F.lit(False))


def _problem(at: Column, message: Column) -> Column:
    return F.struct(at.alias("location"), F.lit("error").alias("level"), message.alias("message"))


def _field_problems(key: Column, x: Column, field: Column) -> Column:
    """Array of what is wrong with one value."""
    none = F.array().cast("array<struct<location:string,level:string,message:string>>")
    item, shape, bound = field["item"], field["shape"], field["bound"]
    says = F.element_at(F.create_map(*[F.lit(s) for pair in SAYS.items() for s in pair]), item)
    members = F.try_variant_get(x, "$", "array<variant>")
    number = F.try_variant_get(x, "$", "double")
    place = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])

    def bad(values: Column, *at: Column) -> Column:
        told = F.transform(values, lambda v, i: F.struct(_fits(v, item).alias("fits"), _problem(place(*at, i), says).alias("problem")))
        return F.transform(F.filter(told, lambda t: ~t["fits"]), lambda t: t["problem"])

    inner = F.transform(members, lambda v, i: F.coalesce(bad(F.try_variant_get(v, "$", "array<variant>"), key, i), F.array(_problem(place(key, i), F.lit("must be a list")))))
    nested = F.exists(members, lambda v: F.try_variant_get(v, "$", "array<variant>").isNotNull())
    listed = F.when(shape.endswith("pair") & (F.size(members) != 2), F.array(_problem(key, F.lit("must be two numbers")))).when((shape == "lists") & nested, F.flatten(inner)).otherwise(bad(members, key))
    low = (bound == "> 0") & ~(number > 0) | (bound == ">= 0") & ~(number >= 0)
    one = F.when(~_fits(x, item), F.array(_problem(key, says))).when(F.coalesce(low, F.lit(False)), F.array(_problem(key, F.concat(F.lit("must be "), bound)))).otherwise(none)
    wants = F.when(shape == "pair", F.lit("must be two numbers")).otherwise(F.lit("must be a list"))
    found = F.when(members.isNotNull() & (shape != "one"), listed).when(shape.startswith("one"), one).otherwise(F.array(_problem(key, wants)))
    return F.when(field.isNull() | F.is_variant_null(x), none).otherwise(found)


def _rules(has) -> list[tuple[str, str, str, Column]]:
    """location, level, message and when it applies: rules between fields."""
    rt, vt, st, frame = has("RepetitionTime"), has("VolumeTiming"), has("SliceTiming"), has("FrameAcquisitionDuration")
    some = has(TIMING[0])
    for name in TIMING[1:]:
        some = some | has(name)
    return [
        ("RepetitionTime", "error", "excludes VolumeTiming", rt & vt),
        ("FrameAcquisitionDuration", "error", "is needed with VolumeTiming when there is no SliceTiming", vt & ~st & ~frame),
        ("FrameAcquisitionDuration", "error", "excludes RepetitionTime", rt & frame),
        ("RepetitionTime", "warning", "or VolumeTiming should be given with other fields of timing", some & ~rt & ~vt),
        ("SliceEncodingDirection", "warning", "is needed to read SliceTiming", st & ~has("SliceEncodingDirection")),
    ]


def metadata_problems(sidecars: DataFrame, text: str = "text") -> DataFrame:
    """A row for each thing wrong with a sidecar: its other columns, location, level, message.

    The location is the field's name and the place in a list, with dots. Errors break the schema, warnings don't. Fields
    that the schema doesn't know may hold anything, and null is an absent field. Text that isn't one JSON object (null,
    a repeated key, a list) is one error without a location; an empty object has no problems.
    """
    rest = [c for c in sidecars.columns if c != text]
    parsed = F.try_parse_json(F.col(text))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    table = F.create_map(*[c for n, item, shape, bound in FIELDS for c in (F.lit(n), F.struct(F.lit(item).alias("item"), F.lit(shape).alias("shape"), F.lit(bound).cast("string").alias("bound")))])
    members = F.map_entries(F.try_variant_get(F.col("__json"), "$", "map<string,variant>"))
    each = F.transform(members, lambda e: _field_problems(e["key"], e["value"], F.try_element_at(table, e["key"])))

    def has(name: str) -> Column:
        value = F.try_variant_get(F.col("__json"), f"$.{name}", "variant")
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))

    rules = [F.when(when, F.struct(F.lit(at).alias("location"), F.lit(level).alias("level"), F.lit(message).alias("message"))) for at, level, message, when in _rules(has)]
    broken = F.array(_problem(F.lit(""), F.lit("must be one JSON object")))
    rows = sidecars.withColumn("__json", F.when(is_object, parsed))
    found = F.when(F.col("__json").isNull(), broken).otherwise(F.concat(F.flatten(each), F.filter(F.array(*rules), lambda p: p.isNotNull())))
    return rows.select(*rest, F.inline(found))


def validate_metadata(spark: SparkSession, attrs: dict) -> list[str]:
    """Warnings about one recording's metadata under BIDS names; errors raise, one line for each."""
    rows = metadata_problems(spark.createDataFrame([(json.dumps(attrs),)], "text string")).collect()
    if errors := [r for r in rows if r.level == "error"]:
        raise ValueError(problem_lines(errors))
    return [f"{r.location} {r.message}" for r in rows]


def problem_lines(rows) -> str:
    """Problems as lines to read: location and message."""
    return "\n".join(f"  - {r.location}: {r.message}" if r.location else f"  - {r.message}" for r in rows)
