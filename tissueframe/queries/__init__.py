"""One registered query for each operator, in the modules of this package."""

from .registry import ORACLE_SQL, QUERIES
from . import atlas, calibration, cohort, labels, mesh, scoring, sources, voxels  # noqa: F401  they register their queries

__all__ = ["ORACLE_SQL", "QUERIES"]
