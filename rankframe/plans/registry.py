"""The queries by name, each with the SQL its answer is checked against."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.plans.views import HISTORY_SQL, Tables
from rankframe.session import tuned

Plan = Callable[[Tables], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, history: bool = False, ctes: str = "") -> Callable[[Plan], Plan]:
    """Register a plan over the tables; ``history`` puts the history view before its SQL."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            views = ",\n".join(v for v in (HISTORY_SQL.strip() if history else "", ctes.strip()) if v)
            ORACLE[name] = (f"WITH {views}\n" if views else "") + sql.strip()
        return plan

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(tuned(spark), folder))


def stamp(c: Column | str) -> Column:
    """A moment as text, so both engines show it alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def load() -> None:
    """Import every module that registers queries."""
    from rankframe.plans import addresses, exports, files, flows, logs, pages, recorded, sites, suggestions  # noqa: F401
