"""The aggregates that fitting needs, each over any number of columns in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

GATHERED = 20_000


def medians(df: DataFrame, values: dict[str, Column], gathered: int = GATHERED) -> dict[str, float | None]:
    """Exact medians (the midpoint of the middle two) without a sort: approximate percentiles cut the values around each
    middle rank into those below, between and above two values that occur, and copies of these two; counts say where the
    rank lies. A rank among the copies is settled; else the bracket narrows, without the two values, so ties end it too.
    All columns go in one pass, until at most `gathered` values lie in a bracket, which are then ordered. None for a
    column without values."""
    if not values:
        return {}
    name = {k: f"c{i}" for i, k in enumerate(values)}
    df = df.select(*(v.cast("double").alias(name[k]) for k, v in values.items()))
    n = df.agg(*(F.count(c).alias(c) for c in name.values())).first()
    sizes = {k: n[name[k]] for k in values}
    middle = {k: ((m + 1) // 2, m // 2 + 1) for k, m in sizes.items() if m}
    found: dict[tuple[str, int], float] = {}
    brackets = {(k, r): (None, None, 0, sizes[k]) for k, ranks in middle.items() for r in ranks}  # low, high, values up to low, values between

    def within(spot: tuple[str, int]) -> Column:
        c, (low, high, _, _) = F.col(name[spot[0]]), brackets[spot]
        inside = c.isNotNull() if low is None else c > low
        return F.when(inside if high is None else inside & (c < high), c)

    while wide := [s for s in brackets if s not in found and brackets[s][3] > gathered]:
        aim = lambda s, by: min(1.0, max(0.0, (s[1] - brackets[s][2]) / brackets[s][3] + by))
        cuts = df.agg(*(F.percentile_approx(within(s), [aim(s, -0.005), aim(s, 0.005)], 1000).alias(f"p{i}") for i, s in enumerate(wide))).first()
        count = lambda s, test: F.count(F.when(test(within(s)), 1))
        got = df.agg(*(
            count(s, test).alias(f"{part}{i}") for i, s in enumerate(wide) for a, b in [cuts[f"p{i}"]]
            for part, test in (("under", lambda x, a=a: x < a), ("first", lambda x, a=a: x == a), ("between", lambda x, a=a, b=b: (x > a) & (x < b)), ("second", lambda x, a=a, b=b: (x == b) & (x > a)))
        )).first()
        for i, s in enumerate(wide):
            (a, b), (low, high, below, inside) = cuts[f"p{i}"], brackets[s]
            under, first, between, second = (got[f"{part}{i}"] for part in ("under", "first", "between", "second"))
            place = s[1] - below
            if place <= under:
                brackets[s] = low, a, below, under
            elif place <= under + first:
                found[s] = a
            elif place <= under + first + between:
                brackets[s] = a, b, below + under + first, between
            elif place <= under + first + between + second:
                found[s] = b
            else:
                before = under + first + between + second
                brackets[s] = b, high, below + before, inside - before
    few = [s for s in brackets if s not in found]
    if few:
        pick = lambda s: F.element_at(F.sort_array(F.collect_list(within(s))), s[1] - brackets[s][2])
        got = df.agg(*(pick(s).alias(f"v{i}") for i, s in enumerate(few))).first()
        found |= {s: got[f"v{i}"] for i, s in enumerate(few)}
    return {k: (found[k, middle[k][0]] + found[k, middle[k][1]]) / 2 if k in middle else None for k in values}


def moments(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column."""
    if not values:
        return {}
    got = df.agg(*(f(v).alias(f"{p}{i}") for i, v in enumerate(values.values()) for p, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {k: (got[f"m{i}"], got[f"s{i}"]) for i, k in enumerate(values)}


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all values of all columns, as strings: one shuffle, combined in each task first."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(counts: DataFrame) -> dict[str, tuple[int, str]]:
    """(number of distinct values, the most frequent one) of each column; of several, the smallest."""
    got = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
    return {r["column"]: (r["distinct"], r["mode"]) for r in got.collect()}
