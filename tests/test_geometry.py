"""Cells: goldens, invariants, every error."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from strataforge.operators import geometry as g
from strataforge.sources import read_json_array

CELL = "lattice array<array<double>>, atom_count bigint"
CUBE = [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]]


def run(spark, *cells):
    return g.cell_geometry(spark.createDataFrame(list(cells), CELL)).collect()


def test_goldens(spark, tmp_path):
    cells = [{"id": "cubic", "lattice": CUBE, "atom_count": 4}, {"id": "orthorhombic", "lattice": [[3, 0, 0], [0, 4, 0], [0, 0, 5]], "atom_count": 8}, {"id": "skew", "lattice": [[3, 0, 0], [1, 2, 0], [0.5, 0.25, 4]], "atom_count": 4}]
    (tmp_path / "cells.json").write_text(json.dumps(cells))
    rows = g.cell_geometry(read_json_array(spark, str(tmp_path / "cells.json"), f"struct<id:string,{'lattice:array<array<double>>,atom_count:bigint'}>"), strict=True).orderBy("ordinal").collect()
    assert [(r.volume_angstrom3, r.volume_per_atom_angstrom3) for r in rows] == [(8.0, 2.0), (60.0, 7.5), (24.0, 6.0)]


def test_root_must_be_an_array(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": 1}')
    with pytest.raises(Exception, match="input must be a JSON array"):
        read_json_array(spark, str(tmp_path / "one.json"), "struct<id:string>").collect()


@pytest.mark.parametrize(
    ("lattice", "atoms", "error"),
    [
        ([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], 1, g.VOLUME),
        ([[float("inf"), 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 1, g.ENTRIES),
        ([[1.0, 0.0], [0.0, 1.0]], 1, g.LATTICE),
        (None, 1, g.LATTICE),
        ([None, [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 1, g.LATTICE),
        ([[None, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 1, g.ENTRIES),
        (CUBE, 0, g.ATOMS),
        (CUBE, -1, g.ATOMS),
        (CUBE, None, g.ATOMS),
    ],
)
def test_errors(spark, lattice, atoms, error):
    row = run(spark, (lattice, atoms))[0]
    assert row.error == error and row.volume_angstrom3 is None
    with pytest.raises(Exception, match=error[:20]):
        g.cell_geometry(spark.createDataFrame([(lattice, atoms)], CELL), strict=True).collect()


def test_lexical_kinds(spark):
    from pyspark.sql import functions as F

    texts = [json.dumps({"id": str(n), "lattice": CUBE, "atom_count": 1}).replace('"atom_count": 1', f'"atom_count": {n}') for n in ("2", "2.0", "true", "2.5", '"2"')]
    rows = g.cell_geometry(g.typed_cells(spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("value")))).collect()
    assert [r.error for r in rows] == [None] + [g.ATOMS] * 4


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=9, max_size=9), st.integers(1, 9))
def test_invariants(spark, x, atoms):
    rows = [[float(v) for v in x[k : k + 3]] for k in (0, 3, 6)]
    sheared = [rows[0], [a + 2 * b for a, b in zip(rows[1], rows[0])], rows[2]]
    doubled = [[2 * v for v in rows[0]], rows[1], rows[2]]
    flat, flipped, shear, double, scaled = run(spark, (rows, atoms), ([rows[1], rows[0], rows[2]], atoms), (sheared, atoms), (doubled, 2 * atoms), ([[2 * v for v in r] for r in rows], atoms))
    assert flat.volume_angstrom3 == flipped.volume_angstrom3 == shear.volume_angstrom3
    assert flat.volume_per_atom_angstrom3 == double.volume_per_atom_angstrom3
    assert scaled.volume_angstrom3 == (8 * flat.volume_angstrom3 if flat.volume_angstrom3 else None)
