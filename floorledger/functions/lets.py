"""One small helper for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside ``body``: the expression tree holds it once however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
