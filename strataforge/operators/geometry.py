"""Unit-cell geometry as columns: no Python touches a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import INFINITY, field, finite, json_kind

LATTICE = "lattice must contain three 3D vectors"
ENTRIES = "lattice entries must be finite real numbers"
VOLUME = "cell must have a finite positive volume"
ATOMS = "atom_count must be a positive integer"


def determinant(lattice: Column) -> Column:
    """The 3x3 determinant along the first row, always in this order of operations."""
    at = lambda i, j: F.get(F.get(lattice, F.lit(i)), F.lit(j))
    minor = lambda i, j: at(1, i) * at(2, j) - at(1, j) * at(2, i)
    return at(0, 0) * minor(1, 2) - at(0, 1) * minor(0, 2) + at(0, 2) * minor(0, 1)


def cell_error(lattice: Column, atom_count: Column) -> Column:
    """The first rule that a cell breaks, or null."""
    shape = F.coalesce((F.size(lattice) == 3) & F.forall(lattice, lambda row: F.size(row) == 3), F.lit(False))
    entries = F.forall(lattice, lambda row: F.forall(row, finite))
    volume = F.abs(determinant(lattice))
    return F.when(~shape, LATTICE).when(~entries, ENTRIES).when(~(finite(volume) & (volume > 0)), VOLUME).when(~F.coalesce(atom_count >= 1, F.lit(False)), ATOMS)


def cell_geometry(cells: DataFrame, *, strict: bool = False) -> DataFrame:
    """``cells`` (lattice, atom_count and others) with volume_angstrom3, volume_per_atom_angstrom3, error.

    ``strict`` raises on a bad cell instead of reporting it; then there is no column error.
    """
    error = cell_error(F.col("lattice"), F.col("atom_count"))
    volume = F.when(error.isNull(), F.abs(determinant(F.col("lattice"))))
    out = cells.withColumns({"error": error, "volume_angstrom3": volume}).withColumn("volume_per_atom_angstrom3", F.col("volume_angstrom3") / F.when(F.col("error").isNull(), F.col("atom_count")))
    if not strict:
        return out
    checked = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.raise_error(F.col("error")).cast("double")).alias(c)
    return out.select(*cells.columns, checked("volume_angstrom3"), checked("volume_per_atom_angstrom3"))


def typed_cells(rows: DataFrame, value: str = "value") -> DataFrame:
    """Cells from a variant column, by lexical kind: ``true`` and ``2.0`` are no atom counts.

    A value of a wrong kind becomes null and so breaks its rule in ``cell_geometry``; integers
    beyond 64 bits count as reals.
    """
    v = F.col(value)
    vectors = F.try_variant_get(v, "$.lattice", "array<array<variant>>")
    number = lambda x: F.when(json_kind(x).isin("int", "real"), F.try_variant_get(x, "$", "double"))
    lattice = F.transform(vectors, lambda row: F.transform(row, lambda x: F.coalesce(number(x), F.lit(INFINITY))))
    atoms = field(v, "atom_count")
    return rows.withColumns({"id": F.try_variant_get(v, "$.id", "string"), "lattice": lattice, "atom_count": F.when(json_kind(atoms) == "int", F.try_variant_get(atoms, "$", "bigint"))})
