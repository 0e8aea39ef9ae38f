"""Operators on cells, structures, results, progress logs, contracts and snapshots."""
