"""All registered queries and, where one exists, the equivalent SQL."""

from cartlens.registry import evaluation, events, profiles  # noqa: F401
from cartlens.registry import modelling  # noqa: F401  reads the SQL of the three above
from cartlens.registry import checked  # noqa: F401  reads the SQL and results of all
from cartlens.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
