"""Size-weighted linkage rules, as columns and as Python functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ("arithmetic", "geometric", "harmonic", "minimum", "maximum")


def linkage(rule: str, n1: Column, v1: Column, n2: Column, v2: Column) -> Column:
    """The distance to a merged cluster, from its two parts' sizes and distances."""
    n = n1 + n2
    found = {
        "arithmetic": lambda: (n1 * v1 + n2 * v2) / n,
        "geometric": lambda: F.pow(v1, n1 / n) * F.pow(v2, n2 / n),
        "harmonic": lambda: n / (n1 / v1 + n2 / v2),
        "minimum": lambda: F.least(v1, v2),
        "maximum": lambda: F.greatest(v1, v2),
    }
    if rule not in found:
        raise ValueError(f"rule must be one of {RULES}")
    return found[rule]()


def averager(rule: str) -> Callable[[float, float, float, float], float]:
    """The same on numbers; a distance of zero is the limit of the rule."""
    found = {
        "arithmetic": lambda n1, v1, n2, v2: (n1 * v1 + n2 * v2) / (n1 + n2),
        "geometric": lambda n1, v1, n2, v2: math.exp((n1 * math.log(v1) + n2 * math.log(v2)) / (n1 + n2)) if v1 > 0 and v2 > 0 else 0.0,
        "harmonic": lambda n1, v1, n2, v2: (n1 + n2) / (n1 / v1 + n2 / v2) if v1 > 0 and v2 > 0 else 0.0,
        "minimum": lambda n1, v1, n2, v2: min(v1, v2),
        "maximum": lambda n1, v1, n2, v2: max(v1, v2),
    }
    if rule not in found:
        raise ValueError(f"rule must be one of {RULES}")
    return found[rule]
