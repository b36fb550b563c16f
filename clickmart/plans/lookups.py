"""Lookups of parents along many-to-one relations, and whether the parents are what the relations say.

A parent whose key is there twice multiplies the totals of its children without a sign. ``LookupChecks`` counts, while a
result is made, the rows that ask for a parent, the rows beyond one that come of them, and those that find no parent. The
counts are observed on both sides of the join, so no scan, shuffle or job is added; only filters on parents act after the
join then instead of before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def look_up(rows: DataFrame, lookup: DataFrame, key: str, child: str, parent: str, its_key: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``lookup``, which should have each key once; ``its_key`` is another name for it there."""
    return rows.join(lookup, F.col(key) == F.col(its_key) if its_key else key, "left")


def _counts(observation: Observation) -> dict[str, int]:
    """What was observed; nothing where Spark left the part out, as it does once it has found a table without rows."""
    try:
        return observation.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):  # how an observation without a row answers
            raise
        return {"rows": 0, "unmatched": 0}


@dataclass(frozen=True)
class _Watched:
    fact: str
    child: str
    parent: str
    before: Observation
    after: Observation


class LookupChecks:
    """Checks of the lookups of one result, which must be written or collected before ``found`` or ``require_unique``.

    Both wait for that. Rows that ask are those of the fold: facts are added up per foreign key before they meet a parent,
    so a key counts once for each group and not for each of its rows. A NULL key asks, too, and finds nothing. Equal keys
    that nothing asks for multiply nothing and are not reported; ``pk_uniqueness`` finds them. Where an executor is lost
    and a stage runs again, Spark may count it again, so a report from such a run should be made anew.
    """

    def __init__(self) -> None:
        self._watched: list[_Watched] = []

    def watching(self, fact: str) -> Callable[..., DataFrame]:
        """``look_up`` for the totals of a fact, observed."""

        def join(
            rows: DataFrame, lookup: DataFrame, key: str, child: str, parent: str, its_key: str | None = None
        ) -> DataFrame:
            watched = _Watched(fact, child, parent, Observation(uuid4().hex), Observation(uuid4().hex))
            self._watched.append(watched)
            asking = rows.observe(watched.before, F.count("*").alias("rows"))
            joined = look_up(asking, lookup.withColumn("_found", F.lit(True)), key, child, parent, its_key)
            unmatched = F.count_if(F.col("_found").isNull())
            return joined.observe(watched.after, F.count("*").alias("rows"), unmatched.alias("unmatched")).drop("_found")

        return join

    def _rows(self) -> list[tuple[str, str, str, int, int, int]]:
        found = []
        for watched in self._watched:
            before, after = _counts(watched.before), _counts(watched.after)
            extra = after["rows"] - before["rows"]
            found.append((watched.fact, watched.child, watched.parent, before["rows"], extra, after["unmatched"]))
        return found

    def found(self, spark: SparkSession) -> DataFrame:
        """fact, child and parent of each lookup, the rows that asked, those beyond one for each, and those without a parent."""
        columns = "fact string, child string, parent string, rows bigint, extra bigint, unmatched bigint"
        return spark.createDataFrame(self._rows(), columns)

    def require_unique(self) -> None:
        """An error if a parent's repeated key has multiplied rows."""
        repeated = sorted({(parent, child, extra) for _, child, parent, _, extra, _ in self._rows() if extra})
        if repeated:
            told = ", ".join(f"{parent} (looked up by {child}: {extra} rows too many)" for parent, child, extra in repeated)
            raise ValueError(f"keys that should be unique are there twice: {told}")
