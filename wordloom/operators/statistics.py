"""Statistics for comparing languages: normalising, grouping, ranks, correlation, regression, break points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def described(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of a column."""
    quart = lambda p: F.percentile(value, F.lit(p))
    columns = [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min")]
    columns += [quart(0.25).alias("q1"), quart(0.5).alias("median"), quart(0.75).alias("q3"), F.max(value).alias("max")]
    return rows.groupBy(*by).agg(*columns)


def whiskers(rows: DataFrame, value: str, by: str, factor: float = 1.5) -> DataFrame:
    """(by, q1, q3, mean, low, high, outside): box plot of a column; whiskers end at the last values within the fences."""
    box = rows.groupBy(by).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.avg(value).alias("mean"))
    reach = F.lit(factor) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    kept = F.when(inside, F.col(value))
    return rows.join(box, by).groupBy(by, "q1", "q3", "mean").agg(F.min(kept).alias("low"), F.max(kept).alias("high"), F.count_if(~inside).alias("outside"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, low, n) of equal bins; the last bin is closed on the right, values outside are left out."""
    width = (high - low) / bins
    inside = rows.filter(F.col(value).between(low, high))
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.col("bin") * F.lit(width) + F.lit(low))


def normalised(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``z`` (population z-score) and ``unit`` (0 to 1) of a column; null where it is constant."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    spread = F.max(value).over(whole) - F.min(value).over(whole)
    return rows.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(whole), F.stddev_pop(value).over(whole))).withColumn(
        "unit", F.try_divide(F.col(value) - F.min(value).over(whole), spread)
    )


def pair_distance() -> Column:
    """Mean squared distance of all pairs of ``unit`` in a group, from its sums: 2 (n S2 - S1^2) / (n (n - 1))."""
    n, s1, s2 = F.count("unit").cast("double"), F.sum("unit"), F.sum(F.col("unit") * F.col("unit"))
    return F.when(n > 1, 2 * (n * s2 - s1 * s1) / (n * (n - 1)))


def clustering(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(score, groups, pairs): 1 minus the mean pair distance of groups of two or more, of the normalised value."""
    units = normalised(rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()), value)
    per = units.groupBy(group).agg(pair_distance().alias("distance"), F.count("unit").alias("n")).filter("n > 1")
    return per.agg(
        (1 - F.avg("distance")).alias("score"), F.count(F.lit(1)).alias("groups"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")
    )


#: Rows of a table of which all pairs may be compared.
MOST_COMPARED = 20_000


def average_rank(value: str, *by: str) -> Column:
    """Rank from the smallest; equal values share the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null where one is constant (corr fails there under ANSI)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlations(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(a, b, pearson) of every two of the columns, from one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    doubles = rows.select(*(F.col(n).cast("double").alias(n) for n in names))
    one = doubles.agg(*(pearson(a, b).alias(f"{a}/{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}/{b}`").alias("pearson")) for a, b in pairs))).alias("p")).select("p.*")


def stretched(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """``rows`` with ``stretched``: the values moved and scaled to lie from low to high."""
    ends = rows.agg(F.min(value).alias("least"), F.max(value).alias("most"))
    share = F.try_divide(F.col(value) - F.col("least"), F.col("most") - F.col("least"))
    # one row
    return rows.join(F.broadcast(ends)).withColumn("stretched", low + share * (high - low)).drop("least", "most")


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, n, spearman): Pearson correlation of average ranks; null below three rows or for a constant."""
    whole = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not by:
        whole, by = whole.withColumn("all", F.lit(0)), ("all",)
    places = whole.withColumn("rx", average_rank(x, *by)).withColumn("ry", average_rank(y, *by))
    n = F.count(F.lit(1))
    constant = (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
    out = places.groupBy(*by).agg(n.alias("n"), F.when((n >= 3) & ~constant, pearson("rx", "ry")).alias("spearman"))
    return out.drop("all")


def kendall(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(n, tau): tau-b of a table of one row per language; all pairs are compared, so longer tables are an error."""
    if rows.count() > MOST_COMPARED:
        raise ValueError(f"more than {MOST_COMPARED} rows to be compared in pairs")
    a = rows.select(F.col(key).alias("ka"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = rows.select(F.col(key).alias("kb"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    pairs = a.join(b, F.col("ka") < F.col("kb"))
    sx, sy = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.try_divide(F.sum(sx * sy), F.sqrt(F.sum(F.abs(sx)) * F.sum(F.abs(sy)))).alias("tau"),
    )


def _sums(order: Window) -> dict[str, Column]:
    over = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    return {k: F.sum(c).over(order) for k, c in over.items()}


def _slope(s: dict[str, Column]) -> Column:
    return F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"])


def _rss(s: dict[str, Column]) -> Column:
    sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / s["n"], s["xy"] - s["x"] * s["y"] / s["n"], s["yy"] - s["y"] * s["y"] / s["n"]
    return syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0))


def suffix_slopes(points: DataFrame, *by: str) -> DataFrame:
    """Per point the slope of y on x over all points with a larger x, from running sums; equal x leave together."""
    order = Window.partitionBy(*by).orderBy(F.col("x")).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    same = Window.partitionBy(*by, "x")
    whole, own = _sums(order), _sums(same)
    rest = {k: whole[k] - own[k] for k in whole}
    # what is left of equal x after subtracting is noise, not a spread
    spread = rest["n"] * rest["xx"] - rest["x"] * rest["x"]
    return points.withColumn("slope_after", F.when((rest["n"] >= 2) & (spread > 1e-12 * whole["n"] * whole["xx"]), _slope(rest)))


def elbow(points: DataFrame, *by: str) -> DataFrame:
    """(by, x, sse): the point that splits the points into two fitted lines with the least error; it belongs to both."""
    order = Window.partitionBy(*by).orderBy("x")
    left = _sums(order.rowsBetween(Window.unboundedPreceding, 0))
    right = _sums(order.rowsBetween(0, Window.unboundedFollowing))
    fitted = points.withColumn("sse", _rss(left) + _rss(right)).withColumn("nl", left["n"]).withColumn("nr", right["n"])
    best = fitted.filter("nl >= 2 and nr >= 2").groupBy(*by).agg(F.min(F.struct(F.round("sse", 6).alias("sse"), "x")).alias("b"))
    return best.select(*by, "b.x", "b.sse")


def break_test(points: DataFrame, by: str) -> DataFrame:
    """(by, x, n, rss, sse, f, p): whether two fitted lines, parted at the elbow, fit better than one.

    Two more parameters are fitted, and with two of them the upper tail of the F distribution is
    (1 + 2 f / d) ** (-d / 2). Null for fewer than five points or a perfect fit.
    """
    one = points.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), (F.regr_syy("y", "x") - F.coalesce(F.try_divide(F.pow(F.regr_sxy("y", "x"), F.lit(2.0)), F.regr_sxx("y", "x")), F.lit(0.0))).alias("rss")
    )
    left = (F.col("n") - 4).cast("double")
    f = F.try_divide((F.col("rss") - F.col("sse")) / 2 * left, F.col("sse"))
    tested = elbow(points, by).join(one, by).withColumn("f", F.when((F.col("n") > 4) & (F.col("sse") > 0), f))
    return tested.withColumn("p", F.pow(1 + F.try_divide(2 * F.col("f"), left), -left / 2))


def sign_changes(points: DataFrame, value: str, *by: str) -> DataFrame:
    """Points at which a value has another sign than at the point before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy("x"))
    return points.withColumn("before", before).filter(F.col("before") * F.col(value) < 0)


def crossing(points: DataFrame, value: str, target: float, *by: str) -> DataFrame:
    """(by, at): the first x at which a falling value reaches a target, interpolated between points."""
    order = Window.partitionBy(*by).orderBy("x")
    nxt = points.withColumn("x2", F.lead("x").over(order)).withColumn("v2", F.lead(value).over(order))
    at = F.col("x") + (F.col(value) - target) / (F.col(value) - F.col("v2")) * (F.col("x2") - F.col("x"))
    return nxt.filter((F.col(value) > target) & (F.col("v2") <= target)).groupBy(*by).agg(F.min(at).alias("at"))


def deviating(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows whose value is not the most usual one of their group (equal ones: the first by name)."""
    counts = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("usual"))).alias("m")).select(group, "m.usual")
    return rows.join(usual, group).filter(F.col(value) != F.col("usual"))
