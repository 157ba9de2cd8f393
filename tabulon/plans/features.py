"""Which columns make up the feature matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.literals import quoted


@dataclass(frozen=True)
class Features:
    """``names`` of numeric columns, or one array column with ``width`` elements."""

    names: tuple[str, ...]
    array: str | None = None

    @classmethod
    def of(cls, df: DataFrame, features: str | list[str] | tuple[str, ...]) -> Features:
        """A string names an array column if it is one, else a single numeric column."""
        if not isinstance(features, str):
            return cls(tuple(features))
        if not dict(df.dtypes)[features].startswith("array<"):
            return cls((features,))
        first = df.select(F.size(F.col(quoted(features))).alias("n")).filter("n >= 0").first()
        if first is None:
            raise ValueError("X must be non-empty")
        return cls(tuple(f"{features}[{j}]" for j in range(first["n"])), features)

    @property
    def width(self) -> int:
        return len(self.names)

    def sql(self) -> list[str]:
        """One double expression a feature."""
        if self.array is not None:
            return [f"CAST({quoted(self.array)}[{j}] AS DOUBLE)" for j in range(self.width)]
        return [f"CAST({quoted(n)} AS DOUBLE)" for n in self.names]

    def vector(self) -> Column:
        """All features as one array<double>."""
        if self.array is not None:
            return F.col(quoted(self.array)).cast("array<double>")
        return F.array(*(F.expr(e) for e in self.sql()))

    def bad_sql(self) -> str:
        """True where a row holds a null or NaN, or an array of another length."""
        if self.array is not None:
            a = quoted(self.array)
            return f"coalesce(size({a}) <> {self.width} OR exists({a}, v -> v IS NULL OR isnan(v)), true)"
        return " OR ".join(f"{e} IS NULL OR isnan({e})" for e in self.sql()) or "false"

    def checked(self, df: DataFrame) -> Features:
        """Self, if ``df`` has the columns; array widths are a matter of the rows."""
        missing = [n for n in ([self.array] if self.array else self.names) if n not in df.columns]
        if missing:
            raise ValueError(f"X has incompatible number of features: {', '.join(missing)} missing")
        return self


def same_width(found: Features, fitted: int) -> None:
    if found.width != fitted:
        raise ValueError("X has incompatible number of features")


def check_rows(n: int, bad: int) -> None:
    """What every fit refuses: no rows, nulls, NaN."""
    if n == 0:
        raise ValueError("X must be non-empty")
    if bad:
        raise ValueError(f"X holds null or NaN values in {bad} rows")
