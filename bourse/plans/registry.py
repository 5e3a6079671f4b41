"""Named queries over the driver tables, each with its independent SQL twin."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bourse.functions.frames import rounded
from bourse.plans.oracle_views import with_views
from bourse.sources.tables import Tables


# The SQL form of frames.comparable.
COMPARABLE = """CASE WHEN abs(CAST({c} AS DOUBLE)) >= 1e5 THEN round(CAST({c} AS DOUBLE) + 1e-5, 2) ELSE round(CAST({c} AS DOUBLE) + 3e-10, 6) END + 0.0 AS {c}"""


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(Tables(spark, sf_dir)))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: str = "", doubles: str = ""):
    """Register a query; `uses` lists the views the SQL reads, `doubles` the columns to round."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            text = with_views(uses, sql)
            if doubles:
                fixes = ", ".join(COMPARABLE.format(c=c) for c in doubles.split())
                text = f"SELECT * REPLACE ({fixes}) FROM ({text}) answer"
        REGISTRY[name] = Query(name, build, text)
        return build

    return add
