"""Sidecars against the schema, names in both directions, physiological tables of several files."""

import gzip
import json

import pytest

from voxelweave.sources import bids, tables


def problems(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return sorted((r.id, r.location, r.level) for r in bids.metadata_problems(rows).collect())


def test_fields(spark):
    docs = [
        {"RepetitionTime": -1.0},
        {"RepetitionTime": "1.5", "TaskName": "rest", "Other": [1, None], "Manufacturer": None},
        {"VolumeTiming": [0, "a", None, 2.5], "SliceTiming": [0], "SliceEncodingDirection": "k"},
        {"PlaneWaveAngles": [[1, 2], [3, "x"], 4], "Depth": [1], "ProbePitch": [0.1, 0.2], "ProbeNumberOfElements": [1, 2.5], "VirtualSources": 3.0, "ProbeVoltage": 0},
        {"Depth": 3, "TaskName": 5, "DeviceSerialNumber": ["a", 1], "ClutterFilters": "x", "TransmitAperture": [[1, 2], [3, 4]], "ReceiveAperture": []},
        {"ProbeVoltage": -0.1, "VirtualSources": 0, "ProbeFocalWidth": 0},
    ]
    assert problems(spark, *map(json.dumps, docs)) == [
        (0, "RepetitionTime", "error"),
        (2, "VolumeTiming.1", "error"), (2, "VolumeTiming.2", "error"),
        (3, "Depth", "error"), (3, "PlaneWaveAngles.1.1", "error"), (3, "PlaneWaveAngles.2", "error"), (3, "ProbeNumberOfElements.1", "error"),
        (4, "Depth", "error"), (4, "DeviceSerialNumber.1", "error"), (4, "TaskName", "error"),
        (5, "ProbeFocalWidth", "error"), (5, "ProbeVoltage", "error"), (5, "VirtualSources", "error"),
    ]


def test_rules_between_fields(spark):
    docs = [
        {},
        {"RepetitionTime": 1.0, "VolumeTiming": [0.0, 1.0], "FrameAcquisitionDuration": 0.5},
        {"VolumeTiming": [0.0, 1.0]},
        {"VolumeTiming": [0.0, 1.0], "RepetitionTime": None, "FrameAcquisitionDuration": 0.5},
        {"SliceTiming": [0.0, 0.1]},
        {"TaskName": "rest"},
    ]
    assert problems(spark, *map(json.dumps, docs)) == [
        (1, "FrameAcquisitionDuration", "error"), (1, "RepetitionTime", "error"),
        (2, "FrameAcquisitionDuration", "error"),
        (4, "RepetitionTime", "warning"), (4, "SliceEncodingDirection", "warning"),
    ]


def test_text_that_is_no_object(spark):
    assert problems(spark, "[1]", None, "{", '{"a": 1, "a": 2}', "5", "", "{}") == [(i, "", "error") for i in range(6)]
    assert bids.metadata_problems(spark.createDataFrame([], "location2 string, text string")).count() == 0


def test_one_recording(spark):
    assert bids.validate_metadata(spark, {"RepetitionTime": 1.5, "TaskName": "rest"}) == []
    assert len(bids.validate_metadata(spark, {"SliceTiming": [0.0, 0.1], "SliceEncodingDirection": "k"})) == 1
    with pytest.raises(ValueError, match="  - RepetitionTime: must be > 0"):
        bids.validate_metadata(spark, {"RepetitionTime": -1.0})


def test_names():
    plain = {"repetition_time": 1.0, "transmit_frequency": 2.0, "volume_acquisition_duration": 3.0, "cog_atlas_id": "a", "cog_poid": "b", "probe_type": "c", "cmap": "d", "dim4_name": "e", "custom_field": 4}
    told = {"RepetitionTime": 1.0, "UltrasoundTransmitFrequency": 2.0, "FrameAcquisitionDuration": 3.0, "CogAtlasID": "a", "CogPOID": "b", "ProbeType": "c", "VoxelweaveCmap": "d", "VoxelweaveDim4Name": "e", "custom_field": 4}
    assert bids.to_bids(plain) == told and bids.from_bids(told) == plain
    assert bids.from_bids({"CustomField": 1, "XCmap": 2}, prefix="X") == {"CustomField": 1, "cmap": 2}
    assert set(bids.PLAIN) == bids.NAMES and len(set(bids.PLAIN.values())) == len(bids.NAMES)


def test_physio_of_several_files(spark, tmp_path):
    for name, start, rate, n in (("a", -0.5, 2.0, 40_000), ("b", 0.0, 4.0, 3)):
        text = "".join(f"{k}\tn/a\n" for k in range(n))
        (tmp_path / f"{name}_physio.tsv").write_text(text)
        (tmp_path / f"{name}_physio.json").write_text(json.dumps({"Columns": ["pulse", "resp"], "StartTime": start, "SamplingFrequency": rate}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # a is several blocks
    try:
        got = tables.load_physio(spark, f"{tmp_path}/*_physio.tsv").toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, start, rate, n in (("a", -0.5, 2.0, 40_000), ("b", 0.0, 4.0, 3)):
        one = got[got.path.str.contains(f"/{name}_physio")].sort_values("i")
        assert list(one.i) == list(range(n)) and list(one.pulse) == list(range(n)) and one.resp.isna().all()
        assert list(one.time) == [start + k / rate for k in range(n)]


def test_physio_faults(spark, tmp_path):
    with gzip.open(tmp_path / "c_physio.tsv.gz", "wt") as f:
        f.write("1\t2\n")
    path = str(tmp_path / "c_physio.tsv.gz")
    side = lambda **fields: (tmp_path / "c_physio.json").write_text(json.dumps(fields))
    side(Columns=["time", "x"])
    assert [tuple(r)[1:] for r in tables.load_physio(spark, path).collect()] == [(0, 1.0, 2.0)]
    for fields in ({"Columns": []}, {"Columns": ["x", "y"]}, {"Columns": ["x", "y"], "SamplingFrequency": 0}):
        side(**fields)
        with pytest.raises(ValueError):
            tables.load_physio(spark, path)
    side(Columns=["time"])
    with pytest.raises(Exception, match="MALFORMED|width|schema"):
        tables.load_physio(spark, path).collect()
