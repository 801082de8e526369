"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row.

    An expression used twice is evaluated twice, and inside a lambda anew for each element;
    bound as a lambda variable it is evaluated once, also after a filter has been pushed
    below the projection that it stands in.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
