"""Matching a traced file query against stored paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PathQuery:
    """A normalised trace query.

    Backslashes in the *query* become ``/`` (stored paths are left alone).
    A query containing ``/`` must equal the stored path; a bare file name
    matches a stored path equal to it or ending in ``/name``.
    """

    raw: str
    normalized: str
    exact: bool

    @classmethod
    def of(cls, raw: str) -> "PathQuery":
        norm = raw.replace("\\", "/")
        return cls(raw, norm, "/" in norm)

    def matches(self, path: Column) -> Column:
        q = F.lit(self.normalized)
        if self.exact:
            return path == q
        return (path == q) | path.endswith(F.lit("/" + self.normalized))


def last_component(path: Column) -> Column:
    """Text after the last ``/`` (the whole path when it has none).

    For a bare name ``q`` (no ``/``), ``path == q or path.endswith('/'+q)``
    holds exactly when ``last_component(path) == q``, which makes the
    basename rule an equi-join key.
    """
    return F.element_at(F.split(path, "/", -1), -1)


def normalize_query_col(q: Column) -> Column:
    return F.translate(q, "\\", "/")
