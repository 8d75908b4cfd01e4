"""A relation: a DataFrame with what its schema cannot carry - the row key and the declared order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import AnalysisError


def order_by(keys: list[tuple[str, bool]], rest: list[str] = ()) -> list[Column]:
    """Nulls last in either direction, then every other column: a total order up to equal rows."""
    seen = {k.lower() for k, _ in keys}
    first = [F.col(f"`{k}`").desc_nulls_last() if desc else F.col(f"`{k}`").asc_nulls_last() for k, desc in keys]
    return first + [F.col(f"`{c}`").asc_nulls_last() for c in rest if c.lower() not in seen]


@dataclass(frozen=True)
class Relation:
    """``identity``: columns that tell rows apart; ``sort``: (column, descending) of the declared order; ``lineage``: column -> inputs."""

    df: DataFrame
    name: str = "pipeline"
    identity: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    lineage: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def has(self, name: str) -> bool:
        return name.lower() in {c.lower() for c in self.columns}

    def spelled(self, name: str) -> str:
        """The declared spelling of a name in any case."""
        for c in self.columns:
            if c.lower() == name.lower():
                return c
        raise AnalysisError("L002", f"{self.name} has no column {name}")

    def type_of(self, name: str):
        return self.df.schema[self.spelled(name)].dataType

    def with_(self, df: DataFrame, **changes) -> Relation:
        return replace(self, df=df, **changes)

    def ordered(self) -> DataFrame:
        """Rows in export order: the declared order, then every column."""
        return self.df.orderBy(*order_by(list(self.sort), self.columns))

    def show(self, n: int = 20, width: int = 40) -> list[list[str]]:
        """The first rows in export order as text, cut to ``width``."""
        cut = lambda v: "" if v is None else (s if len(s := str(v)) <= width else s[: width - 1] + "…")
        return [[cut(v) for v in row] for row in self.ordered().limit(n).collect()]
