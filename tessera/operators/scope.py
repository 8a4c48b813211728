"""Row scopes: tenant, agent, workspace, validity and facets as one conjunction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What a caller may see; a facet that is None isn't tested."""

    agent_id: str | None = None
    key_id: str | None = None
    group_keys: tuple[str, ...] = ()
    workspace: str | None = None
    as_of_h: int | None = None
    include_expired: bool = False
    from_h: int | None = None
    to_h: int | None = None
    min_importance: float | None = None
    affects: tuple[str, ...] = ()
    equal: dict = field(default_factory=dict)

    def condition(self) -> Column:
        """A boolean column over fragments, built only from the facets that are set, so that it can be pushed down."""
        c = F.lit(True)
        if self.agent_id is not None:
            c &= F.col("agent_id").isin(self.agent_id, "default")
        if self.key_id is not None or self.group_keys:
            c &= F.col("key_id").eqNullSafe(F.lit(self.key_id)) | F.col("key_id").isin(*self.group_keys)
        if self.workspace is not None:
            c &= (F.col("workspace") == self.workspace) | F.col("workspace").isNull()
        if self.as_of_h is not None:
            c &= (F.col("valid_from_h") <= self.as_of_h) & (F.col("valid_to_h").isNull() | (F.col("valid_to_h") > self.as_of_h))
        elif not self.include_expired:
            c &= F.col("valid_to_h").isNull()
        if self.from_h is not None:
            c &= F.col("created_h") >= self.from_h
        if self.to_h is not None:
            c &= F.col("created_h") < self.to_h
        if self.min_importance is not None:
            c &= F.col("importance") >= self.min_importance
        if self.affects:
            c &= F.col("affect").isin(*self.affects)
        for name, value in self.equal.items():
            c &= F.col(name) == value
        return c

    def apply(self, fragments: DataFrame) -> DataFrame:
        return fragments.where(self.condition())
