"""Model folders: round trips in both forms."""

from __future__ import annotations

import struct

import pytest

from strataflow.sources import model

CAMERAS = [{"camera_id": 1, "model": 1, "width": 2000, "height": 1500, "params": [1000.0, 1001.5, 1000.0, 750.0]}, {"camera_id": 2, "model": 4, "width": 10, "height": 20, "params": [1 / 3] * 8}]
IMAGES = [
    {"image_id": 3, "q": [1.0, 0.0, 0.0, 0.0], "t": [0.1, 1 / 7, -2.0], "camera_id": 1, "name": "camF/camF_0003.jpg", "points": [{"x": 1.5, "y": 2.5, "point3d_id": None}, {"x": 3.0, "y": 4.0, "point3d_id": 9}]},
    {"image_id": 4, "q": [1.0, 0.0, 0.0, 0.0], "t": [0.0, 0.0, 0.0], "camera_id": 2, "name": "b c.jpg", "points": []},
]
POINTS = [{"point3d_id": 9, "x": 1.0, "y": 2.0, "z": 1e-17, "r": 255, "g": 0, "b": 7, "error": -1.0, "track": [{"image_id": 3, "point2d_idx": 1}, {"image_id": 4, "point2d_idx": 0}]}, {"point3d_id": 11, "x": 0.0, "y": 0.0, "z": 0.0, "r": 0, "g": 0, "b": 0, "error": 0.5, "track": []}]
MODEL = {"cameras": CAMERAS, "images": IMAGES, "points3D": POINTS}


@pytest.mark.parametrize("kind", MODEL)
def test_formats(kind):
    assert list(model.parse_binary(kind, model.format_binary(kind, MODEL[kind]))) == MODEL[kind]
    assert list(model.parse_text(kind, b"# a comment\n" + model.format_text(kind, MODEL[kind]))) == MODEL[kind]
    assert list(model.parse_binary(kind, model.format_binary(kind, []))) == list(model.parse_text(kind, b"")) == []
    with pytest.raises(struct.error):
        list(model.parse_binary(kind, model.format_binary(kind, MODEL[kind])[:-1]))


@pytest.mark.parametrize("form", ["binary", "text"])
def test_folders(spark, tmp_path, form):
    folders = [f"file://{tmp_path}/{n}" for n in ("a", "b")]
    tables = {k: spark.createDataFrame([{"folder": f} | r for f in folders for r in reversed(rows)], model.SCHEMAS[k]) for k, rows in MODEL.items()}
    unposed = spark.createDataFrame([{"folder": folders[0]} | IMAGES[0] | {"image_id": 5, "q": None}], model.SCHEMAS["images"])
    model.write_models(tables | {"images": tables["images"].unionByName(unposed)}, form)
    got = model.read_model(spark, f"file://{tmp_path}/*")
    for kind, rows in MODEL.items():
        found = sorted((r.asDict(recursive=True) for r in got[kind].collect()), key=lambda r: (r["folder"], *list(r.values())[1:2]))
        assert [r.pop("folder").rsplit("/", 1)[1] for r in found] == ["a"] * len(rows) + ["b"] * len(rows)
        assert found == rows * 2


def test_binary_is_preferred(spark, tmp_path):
    for kind, rows in MODEL.items():
        (tmp_path / f"{kind}.bin").write_bytes(model.format_binary(kind, rows))
        (tmp_path / f"{kind}.txt").write_bytes(model.format_text(kind, []))
    got = model.read_model(spark, f"file://{tmp_path}")
    assert {k: got[k].count() for k in MODEL} == {k: 2 for k in MODEL}
    assert model.read_model(spark, f"file://{tmp_path}", "text")["cameras"].count() == 0
