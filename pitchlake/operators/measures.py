"""Features as mergeable parts.

A feature is a name, the partial aggregates that it needs (sums, counts, maxima,
moments), and an expression over them. The same definition serves

* one aggregate over pitches (:func:`aggregated`), and
* stored partial states that are merged later (:mod:`.season_state`).

Interquartile ranges have no small state; they name the column whose values decide
(:class:`Iqr`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import iqr
from ..functions.clean import col_


#: conditions in a long
BITS = 60


class Narrow:
    """What features read of a row in few columns: conditions as bits, values as they are.

    Features ask for their conditions and values (:meth:`Feature.over`) and read them from these columns from then on."""

    def __init__(self):
        self._flags: list[Column] = []
        self._values: dict[str, Column] = {}

    def flag(self, condition: Column | None) -> Column | None:
        """The condition (false where it is unknown), read from its bit; conditions that are one object share it."""
        if condition is None:
            return None
        at = next((i for i, c in enumerate(self._flags) if c is condition), len(self._flags))
        if at == len(self._flags):
            self._flags.append(condition)
        return F.col(f"_flags_{at // BITS}").bitwiseAND(F.lit(1 << at % BITS)) != 0

    def value(self, source: str | Column) -> str:
        """The name of a column with the value: its own, where it has one."""
        if isinstance(source, str):
            self._values[source] = F.col(source)
            return source
        at = next((n for n, c in self._values.items() if c is source), f"_value_{len(self._values)}")
        self._values[at] = source
        return at

    def columns(self) -> dict[str, Column]:
        """All that was asked for, over the rows as they were."""
        out = dict(self._values)
        for at in range(0, len(self._flags), BITS):
            bits = F.lit(0).cast("long")
            for i, c in enumerate(self._flags[at:at + BITS]):
                bits = bits + F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            out[f"_flags_{at // BITS}"] = bits
        return out


@dataclass(frozen=True)
class Part:
    """A partial aggregate: ``sum`` and ``count`` merge by sum, ``max`` by maximum."""

    kind: str
    value: Column

    def column(self) -> Column:
        return {"sum": F.sum, "count": F.count, "max": F.max}[self.kind](self.value)


@dataclass(frozen=True)
class Feature:
    name: str
    parts: tuple[Part, ...]
    final: Callable[..., Column]
    again: Callable[[Narrow], Feature] | None = None

    def column(self) -> Column:
        """The feature as one aggregate expression."""
        return self.final(*[p.column() for p in self.parts]).alias(self.name)

    def over(self, rows: Narrow) -> Feature:
        """The same feature over narrow rows."""
        return self.again(rows) if self.again else self


@dataclass(frozen=True)
class Spread(Feature):
    """Population standard deviation: its state is count, mean and sum of squares about the mean."""

    value: Column | None = None

    def column(self) -> Column:
        return F.stddev_pop(self.value).alias(self.name)


@dataclass(frozen=True)
class Iqr:
    name: str
    source: str

    def column(self) -> Column:
        return iqr(self.source).alias(self.name)

    def over(self, rows: Narrow) -> Iqr:
        return Iqr(self.name, rows.value(self.source))

    def beside(self, keys: Sequence[str]) -> Column:
        """The range of a key's rows, beside each of them."""
        w = Window.partitionBy(*keys)
        q = F.percentile(F.col(self.source), F.array(F.lit(0.25), F.lit(0.75))).over(w)
        return F.when(F.count(F.col(self.source)).over(w) >= 2, q[1] - q[0])


def rate(name: str, flag: Column, where: Column | None = None) -> Feature:
    """Share of rows (of those ``where`` holds) for which ``flag`` holds; NULL without rows."""
    hit = F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))
    hit = hit if where is None else F.when(where, hit)
    return Feature(name, (Part("sum", hit), Part("count", hit)), _share, lambda rows: rate(name, rows.flag(flag), rows.flag(where)))


def _share(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n)


def mean(name: str, value: str | Column, where: Column | None = None) -> Feature:
    """Mean of ``value`` (of the rows ``where`` holds)."""
    x = col_(value).cast("double")
    x = x if where is None else F.when(where, x)
    return Feature(name, (Part("sum", x), Part("count", x)), _share, lambda rows: mean(name, rows.value(value), rows.flag(where)))


def number(name: str, where: Column) -> Feature:
    """Number of rows ``where`` holds."""
    return Feature(name, (Part("count", F.when(where, 1)),), lambda n: n, lambda rows: number(name, rows.flag(where)))


def maximum(name: str, value: str | Column) -> Feature:
    return Feature(name, (Part("max", col_(value)),), lambda m: m, lambda rows: maximum(name, rows.value(value)))


def spread(name: str, value: str | Column) -> Spread:
    return Spread(name, (), lambda: F.lit(None), lambda rows: spread(name, rows.value(value)), col_(value).cast("double"))


def nothing(name: str) -> Feature:
    """A feature whose columns are missing."""
    return Feature(name, (), lambda: F.lit(None).cast("double"))


def difference(name: str, a: Feature, b: Feature) -> Feature:
    cut = len(a.parts)
    return Feature(name, a.parts + b.parts, lambda *p: a.final(*p[:cut]) - b.final(*p[cut:]), lambda rows: difference(name, a.over(rows), b.over(rows)))


def given(feature: Feature, *needed: Feature) -> Feature:
    """``feature`` where every one of ``needed`` is there, else NULL."""
    cuts = [len(feature.parts)]
    for f in needed:
        cuts.append(cuts[-1] + len(f.parts))

    def final(*p: Column) -> Column:
        there = F.lit(True)
        for f, lo, hi in zip(needed, cuts, cuts[1:]):
            there = there & f.final(*p[lo:hi]).isNotNull()
        return F.when(there, feature.final(*p[: cuts[0]]))

    parts = feature.parts + tuple(q for f in needed for q in f.parts)
    return Feature(feature.name, parts, final, lambda rows: given(feature.over(rows), *[f.over(rows) for f in needed]))


#: a buffer of values holds at most so many rows of a key
MOST = 1 << 20


def aggregated(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[Feature | Iqr | Column],
    *extra: Column,
    rows_from: DataFrame | None = None,
    most: int = MOST,
) -> DataFrame:
    """One row per key with every feature, in order, behind ``extra``.

    A buffer of values for interquartile ranges holds at most ``most`` rows. Keys with more take theirs from value
    counts (:mod:`.quantiles`) and everything else from plain sums, so no key's values have to fit in one task. Which
    keys those are is counted first, in ``rows_from`` where ``df`` is costly to count (it may hold more rows)."""
    from .quantiles import match

    columns = [f if isinstance(f, Column) else f.column() for f in features]
    if not any(isinstance(f, Iqr) for f in features):
        return df.groupBy(*keys).agg(*extra, *columns)
    large = (df if rows_from is None else rows_from).groupBy(*keys).count().where(F.col("count") > most).select(*keys)
    if large.isEmpty():
        return df.groupBy(*keys).agg(*extra, *columns)
    out = match(df, large, keys, "left_anti").groupBy(*keys).agg(*extra, *columns)
    return out.unionByName(by_value_counts(match(df, large, keys, "left_semi"), keys, features, *extra))


def aggregated_in_order(df: DataFrame, keys: Sequence[str], features: Sequence[Feature | Iqr | Column], *extra: Column) -> DataFrame:
    """The same table for rows that are dealt and sorted by ``keys`` already, none of them too many for a buffer.

    Interquartile ranges come from a window, a key at a time. As an aggregate they would have all rows sorted once more, since
    only so many buffers of values are held at once."""
    ranges = {f.name: f"_iqr_{i}" for i, f in enumerate(features) if isinstance(f, Iqr)}
    rows = df.withColumns({ranges[f.name]: f.beside(keys) for f in features if isinstance(f, Iqr)}) if ranges else df
    columns = [F.max(ranges[f.name]).alias(f.name) if isinstance(f, Iqr) else f if isinstance(f, Column) else f.column() for f in features]
    return rows.groupBy(*keys).agg(*extra, *columns)


def by_value_counts(hot: DataFrame, keys: Sequence[str], features: Sequence[Feature | Iqr | Column], *extra: Column) -> DataFrame:
    """The same table for keys with too many rows for a buffer."""
    from ..session import cut_lineage
    from .quantiles import iqrs, match

    hot = cut_lineage(hot)
    ranges = {f.name: f.source for f in features if isinstance(f, Iqr)}
    plain = hot.groupBy(*keys).agg(*extra, *[f if isinstance(f, Column) else f.column() for f in features if not isinstance(f, Iqr)])
    rest = iter(plain.columns[len(keys) + len(extra):])
    order = [f.name if isinstance(f, Iqr) else next(rest) for f in features]
    ranged = match(plain, iqrs(hot, keys, ranges), keys, "left")
    return ranged.select(*plain.columns[: len(keys) + len(extra)], *order)
