"""Exact percentiles by narrowing, so that no task ever holds more than a bounded number of values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that may come together in the last step, and the fineness of the sketches before it.
MOST = 4096
FINENESS = 2000


@dataclass
class _Search:
    """A rank (from 0) that is looked for: its value lies strictly between `above` and `under` (None: no bound); `below` rows are at
    most `above`, and `inside` rows lie between."""

    rank: int
    below: int
    inside: int
    above: object = None
    under: object = None

    def between(self, v: Column) -> Column:
        out = F.lit(True) if self.above is None else v > F.lit(self.above)
        return out if self.under is None else out & (v < F.lit(self.under))


def values_at(df: DataFrame, value: str, ranks: list[int], n: int, most: int = MOST) -> dict[int, object]:
    """The values at ranks (from 0) of the `n` values in ascending order; none is null.

    Each pass sketches the rows around each rank and cuts them at three values that lie about there; the next one counts what is less
    than, and equal to, these.  Either one of them is the value, or the rank lies between two of them.  Where at most `most` rows lie
    between, they are read.  A cut is a value that occurs, so that every pass narrows, however often values repeat.
    """
    v = F.col(value)
    open_, found = [_Search(r, 0, n) for r in sorted(set(ranks))], {}
    while open_:
        for s in [s for s in open_ if s.inside <= most]:
            rest = sorted(r["v"] for r in df.where(s.between(v)).select(v.alias("v")).collect())  # `most` rows
            found[s.rank] = rest[s.rank - s.below]
        open_ = [s for s in open_ if s.rank not in found]
        if not open_:
            break
        shares = [(s.rank - s.below + 0.5) / s.inside for s in open_]
        near = [[max(0.0, x - 2 / FINENESS), x, min(1.0, x + 2 / FINENESS)] for x in shares]
        cuts = df.agg(*[F.percentile_approx(F.when(s.between(v), v), x, FINENESS).alias(f"c{i}") for i, (s, x) in enumerate(zip(open_, near, strict=True))]).first()
        every = sorted({c for row in cuts for c in row})
        counts = df.agg(*[x for i, c in enumerate(every) for x in (F.count_if(v < F.lit(c)).alias(f"less{i}"), F.count_if(v == F.lit(c)).alias(f"same{i}"))]).first()
        for s in open_:
            for i, c in enumerate(every):
                less, same = counts[f"less{i}"], counts[f"same{i}"]
                if less <= s.rank < less + same:
                    found[s.rank] = c
                elif s.rank >= less + same and (s.above is None or c > s.above):
                    s.inside -= less + same - s.below
                    s.above, s.below = c, less + same
                elif s.rank < less and (s.under is None or c < s.under):
                    s.inside = less - s.below
                    s.under = c
        open_ = [s for s in open_ if s.rank not in found]
    return found


def percentiles(df: DataFrame, value: str, fractions: list[float], most: int = MOST) -> list[float | None]:
    """Exact percentiles, by linear interpolation between neighbours in the order; nulls do not count, and without values all are null.

    A few passes over one column, in each of which a task sends sketches and counts.
    """
    rows = df.select(value).where(F.col(value).isNotNull())
    n = rows.count()
    if not n:
        return [None] * len(fractions)
    at = [f * (n - 1) for f in fractions]
    found = values_at(rows, value, [r for x in at for r in (math.floor(x), math.ceil(x))], n, most)
    out = []
    for x in at:
        low, high = float(found[math.floor(x)]), float(found[math.ceil(x)])
        out.append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
    return out
