"""The number of probes of an any-match binary search over ranks, as a column expression.

Whether a probed rank lies before, in or after the wanted interval [left, right) is all that a
search for it depends on, so the probes of a search inside [lo, hi) are a function of four
integers. Three phases: halve [lo, hi) until a rank of the interval is hit; halve what is left
of the hit down to the first rank; halve what is right of it up to the last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halvings of a phase; enough for intervals below 2**47.
ROUNDS = 48


def search_steps(lo: Column, hi: Column, left: Column, right: Column) -> Column:
    """Probes of the search for [left, right) inside [lo, hi), which must contain it. An absent
    query has left = right = its insertion rank. Null if any argument is null."""
    n = lambda c: c.cast("bigint")
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    state = lambda lo, hi, mid, hit, steps: F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), hit.alias("hit"), steps.alias("steps"))

    def hunt(s: Column, _: Column) -> Column:
        mid = F.shiftright(s.lo + s.hi - 1, 1)
        before, after = mid < n(left), mid >= n(right)
        done = s.hit | (s.lo >= s.hi)
        return F.when(done, s).otherwise(
            state(F.when(before, mid + 1).otherwise(s.lo), F.when(~before & after, mid).otherwise(s.hi), mid, ~before & ~after, s.steps + 1)
        )

    def narrow(is_left) -> callable:
        def step(s: Column, _: Column) -> Column:
            mid = F.shiftright(s.lo + s.hi, 1)
            go = is_left(mid)
            return F.when(s.hi - s.lo <= 1, s).otherwise(F.struct(F.when(go, mid).otherwise(s.lo).alias("lo"), F.when(go, s.hi).otherwise(mid).alias("hi"), (s.steps + 1).alias("steps")))

        return step

    start = state(n(lo), n(hi), n(lo), F.lit(False), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    span = lambda a, b, s: F.struct(a.alias("lo"), b.alias("hi"), s.alias("steps"))
    found = F.aggregate(
        rounds, start, hunt,
        lambda s: F.when(~s.hit, s.steps).otherwise(
            s.steps
            + F.aggregate(rounds, span(s.lo - 1, s.mid, zero), narrow(lambda m: m < n(left)), lambda x: x.steps)
            + F.aggregate(rounds, span(s.mid, s.hi, zero), narrow(lambda m: m < n(right)), lambda x: x.steps)
        ),
    )
    return F.when(lo.isNotNull() & hi.isNotNull() & left.isNotNull() & right.isNotNull(), found)
