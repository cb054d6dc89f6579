"""All registered queries."""

from linescope.plans import attention, code_text, evaluation, features, files, models, preparation  # noqa: F401
from linescope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
