"""Columns of a caller under names of their own, so that none clashes with an operator's."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Held:
    """A frame whose columns are in_0, in_1 and so on by their place, whatever they were called."""

    def __init__(self, df: DataFrame, replaced: tuple[str, ...] = ()):
        """Columns named in ``replaced`` go: the operator's own results take their names."""
        self.names = [c for c in df.columns if c not in replaced]
        kept = [k for k, c in enumerate(df.columns) if c not in replaced]
        every = df.toDF(*[f"in_{k}" for k in range(len(df.columns))])
        self.df = every.select(*[f"in_{k}" for k in kept]).toDF(*[f"in_{k}" for k in range(len(kept))])

    def at(self, name: str) -> str:
        """The held name of the caller's column; of several of one name the first."""
        return f"in_{self.names.index(name)}"

    def columns(self, carry: list[str] | None = None) -> list[str]:
        return [self.at(c) for c in carry] if carry is not None else [f"in_{k}" for k in range(len(self.names))]

    def back(self, df: DataFrame, added: dict[str, str] | None = None, carry: list[str] | None = None) -> DataFrame:
        """The caller's columns by their own names, then ``added``: result name -> column of ``df``."""
        added = added or {}
        names = self.names if carry is None else carry
        return df.select(*self.columns(carry), *added.values()).toDF(*names, *added)
