"""Columns of any type to numeric predictors: ordered categories to ranks, others to indicators, booleans and numbers as they are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Encoder:
    """``categories``: the levels of each categorical column, in order; ``ordered``: those that become ranks.

    String columns must be declared; with ``levels="observed"`` they are found in the data, sorted, at fit.
    """

    categories: dict[str, list[str]] = field(default_factory=dict)
    ordered: set[str] = field(default_factory=set)
    levels: str = "declared"
    columns: list[str] | None = None
    _schema: list[tuple[str, str]] | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> "Encoder":
        self.columns = columns or df.columns
        for f in df.select(*self.columns).schema.fields:
            if f.name in self.categories:
                continue
            if isinstance(f.dataType, T.StringType) and self.levels == "observed":
                self.categories[f.name] = sorted(r[0] for r in df.select(f.name).where(F.col(f.name).isNotNull()).distinct().collect())
            elif not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                raise TypeError(f"column {f.name!r} is {f.dataType.simpleString()}; declare its categories or derive a number")
        self._schema = df.select(*self.columns).dtypes
        return self

    def width(self, column: str) -> int:
        return len(self.categories[column]) if column in self.categories and column not in self.ordered else 1

    @property
    def names(self) -> list[str]:
        self._fitted()
        return [n for c in self.columns for n in ([f"{c}={v}" for v in self.categories[c]] if c in self.categories and c not in self.ordered else [c])]

    @property
    def original(self) -> list[int]:
        """The input column of each output column."""
        self._fitted()
        return [i for i, c in enumerate(self.columns) for _ in range(self.width(c))]

    def weights(self, variable: list[float] | None) -> list[float] | None:
        """Weights of the columns, each split evenly over its expansions."""
        if variable is None:
            return None
        if len(variable) != len(self.columns):
            raise ValueError(f"{len(variable)} weights for {len(self.columns)} columns")
        return [w / self.width(c) for c, w in zip(self.columns, variable, strict=True) for _ in range(self.width(c))]

    def encoded(self) -> list[Column]:
        self._fitted()
        out = []
        for c in self.columns:
            x = F.col(c)
            if c not in self.categories:
                out.append(x.cast("double"))
                continue
            values = self.categories[c]
            rank = F.array_position(F.array(*[F.lit(v) for v in values]), x)
            known = F.when(F.coalesce(rank, F.lit(0)) == 0, F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.coalesce(x.cast("string"), F.lit("null"))))).otherwise(rank)
            out += [(known - 1).cast("double")] if c in self.ordered else [F.when(known == i + 1, 1.0).otherwise(0.0) for i in range(len(values))]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with one column for each name; a category that was not declared raises."""
        self._fitted()
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        if df.select(*self.columns).dtypes != self._schema:
            raise ValueError("columns differ in type from those that were fitted")
        return df.withColumns(dict(zip(self.names, self.encoded(), strict=True)))

    def _fitted(self) -> None:
        if self._schema is None:
            raise RuntimeError("fit the encoder first")
