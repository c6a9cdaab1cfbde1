"""Quality control and exploration of tables. Reports have a row per finding."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import chi2_sf, normal_two_sided
from ..functions.ranking import across_pieces, average_ranks, sum_below, with_piece
from ..functions.storage import settle
from .aggregates import frequent_values, kneedle, union_reports
from .hierarchy import label_components
from .neighbours import elbow, nearest, principal_axes

# The date layouts that count as dates.
DATE_LAYOUTS = ["yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd MMM yyyy", "MMM dd yyyy"]
NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value string): all columns below each other in one scan."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def value_type(v: Column) -> Column:
    """int, float, bool, date or str; null for missing values."""
    date = reduce(lambda a, b: a | b, [F.try_to_timestamp(v, F.lit(x)).isNotNull() for x in DATE_LAYOUTS])
    shaped = v.rlike(r"^\d{1,4}[-/. ]|^\d{8}$|^[A-Z][a-z]{2} ")
    return (
        F.when(v.isNull() | (F.trim(v) == ""), None).when(v.rlike(r"^[-+]?\d+$"), "int").when(v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), "float")
        .when(F.lower(v).isin("true", "false"), "bool").when(shaped & date, "date").otherwise("str")
    )


def infer_value_types(df: DataFrame, columns: list[str], dominant: float = 0.8) -> DataFrame:
    """Per column: the type that ``dominant`` of its values have (int folds into float), else MIXED, and how many differ."""
    t = long_form(df, columns).select("column", value_type(F.col("value")).alias("type")).where("type is not null").groupBy("column", "type").agg(F.count(F.lit(1)).alias("n"))
    s = t.groupBy("column").pivot("type", ["int", "float", "bool", "date", "str"]).agg(F.sum("n")).fillna(0)
    total = F.col("int") + F.col("float") + F.col("bool") + F.col("date") + F.col("str")
    number = F.when(F.col("float") > 0, F.col("int") + F.col("float")).otherwise(0)
    best = F.greatest(F.struct(F.col("int").alias("n"), F.lit("int").alias("t")), F.struct(number.alias("n"), F.lit("float").alias("t")), *[F.struct(F.col(k).alias("n"), F.lit(k).alias("t")) for k in ("bool", "date", "str")])
    s = s.withColumns({"best": best, "total": total})
    kind = F.when(F.col("best.n") >= dominant * F.col("total"), F.col("best.t")).otherwise("MIXED")
    return s.select("column", kind.alias("type"), (F.col("total") - F.col("best.n")).alias("wrong"), "total")


def wrong_values(df: DataFrame, key: str, columns: list[str], dominant: float = 0.8) -> DataFrame:
    """(column, key, value, type, wanted): the rows whose value is not of the type that its column has by ``infer_value_types``.

    Whole numbers are right in a column of decimal ones. Columns of mixed types have no wrong rows.
    """
    kinds = infer_value_types(df, columns, dominant).where("type <> 'MIXED' and wrong > 0").select("column", F.col("type").alias("wanted"))
    cells = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("key", "x.*")
    rows = cells.withColumn("type", value_type(F.col("value"))).where("type is not null").join(F.broadcast(kinds), "column")
    right = (F.col("type") == F.col("wanted")) | ((F.col("wanted") == "float") & (F.col("type") == "int"))
    return rows.where(~right).select("column", "key", "value", "type", "wanted")


def missing_header(names: list[str]) -> list[str]:
    return [n for n in names if not n.strip() or n.startswith("Unnamed:")]


def missing_headers(headers: DataFrame) -> DataFrame:
    """The rows of (file, position, name), as ``readers.file_headers`` makes them, whose column has no name."""
    return headers.where(F.col("name").isNull() | (F.trim("name") == "") | F.col("name").startswith("Unnamed:"))


def missing_values(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    share = F.avg((F.col("value").isNull() | (F.col("value") == "")).cast("double"))
    return long_form(df, columns).groupBy("column").agg(share.alias("missing")).where(F.col("missing") >= least)


def rare_categories(df: DataFrame, column: str, least: int = 3, cover: float = 0.75, alike: float = 0.5) -> DataFrame:
    """Categories below the knee of the counts, with the common value that they may be a typo of.

    Likeness is the share of equal places over the shorter length. A column with over a tenth of its rows as
    distinct values, or whose frequent values cover too little, has no categories.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    fit = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum(F.when(F.col("n") > least, F.col("n"))).alias("some")).where((F.col("some") >= cover * F.col("all")) & (F.col("k") <= 0.1 * F.col("all")))
    counts = counts.join(F.broadcast(fit.select("k")), F.lit(True)).drop("k")
    knee = kneedle(counts.withColumn("_one", F.lit(1)), "n", ["_one"]).select(F.col("value").alias("cut"))
    marked = counts.join(F.broadcast(knee), F.lit(True))
    rare, common = marked.where("n < cut").select("category", "n"), marked.where("n >= cut").select(F.col("category").alias("common"))
    short = F.least(F.length("category"), F.length("common"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda a, i: a + (F.substring("category", i, F.lit(1)) == F.substring("common", i, F.lit(1))).cast("int"))
    pairs = rare.join(common, F.lit(True), "left").withColumn("like", same / F.greatest(short, F.lit(1)))
    best = pairs.groupBy("category", "n").agg(F.max(F.struct("like", "common")).alias("b"))
    return best.select("category", "n", F.when(F.col("b.like") >= alike, F.col("b.common")).alias("typo_of"))


def missingness_tests(df: DataFrame, columns: list[str], missing: list[str], tests: int = 25) -> DataFrame:
    """(column, tested, pvalue): whether the rows where a ``missing`` column is present differ from all rows in another column.

    Each is tested on the first ``tests`` others of ``columns`` in name order, by rank test for numbers and chi-square for the rest.
    One scan counts the values of all tested columns, with a count beside for each missing column; one ranking of those serves all.
    """
    order = sorted(columns)
    kinds = dict(df.dtypes)
    wanted = [(c, t) for c in missing for t in [x for x in order if x != c][:tests]]
    tested = sorted({t for _, t in wanted})
    p = [f"_p{i}" for i in range(len(missing))]
    flags = [F.col(c).isNotNull().cast("long").alias(n) for c, n in zip(missing, p, strict=True)]

    def counts(names: list[str], kind: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tested"), F.col(t).cast(kind).alias("value")) for t in names]))
        rows = df.select(cells.alias("x"), *flags).select("x.*", *p).where("value is not null")
        return rows.groupBy("tested", "value").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in p])

    def told(rows: DataFrame, value: Callable[[str], Column]) -> DataFrame:
        """A row of each pair of the missing and tested columns."""
        each = F.array(*[F.struct(F.lit(c).alias("column"), value(n).alias("pvalue")) for c, n in zip(missing, p, strict=True)])
        return rows.select("tested", F.explode(each).alias("x")).select("x.column", "tested", "x.pvalue")

    found = []
    if names := [t for t in tested if kinds[t] in NUMERIC]:
        rows = with_piece(counts(names, "double"), "value")
        inner = Window.partitionBy("tested", "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        rows = across_pieces(rows, ["tested"], {f"_b{c}": ("sum", F.sum(c)) for c in ("_n", *p)})
        below = lambda c: F.coalesce(F.col(f"_b{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(inner), F.lit(0))
        rows = rows.withColumns({f"_u{c}": below(c) for c in ("_n", *p)})
        rank = lambda c: F.col("_u_n") + F.col(f"_u{c}") + (F.col("_n") + F.col(c) + 1) / 2
        both = lambda c: (F.col("_n") + F.col(c)).cast("double")
        sums = rows.groupBy("tested").agg(F.sum("_n").cast("double").alias("n1"), *[x for c in p for x in (F.sum(c).cast("double").alias(f"n{c}"), F.sum(F.col("_n") * rank(c)).alias(f"r{c}"), F.sum(both(c) ** 3 - both(c)).alias(f"t{c}"))])

        def rank_p(c: str) -> Column:
            n1, n2 = F.col("n1"), F.col(f"n{c}")
            n, u = n1 + n2, F.col(f"r{c}") - n1 * (n1 + 1) / 2
            sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col(f"t{c}"), n * (n - 1))))
            return normal_two_sided(F.when((n2 > 0) & (sd > 0), F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd))

        found.append(told(sums, rank_p))
    if names := [t for t in tested if kinds[t] not in NUMERIC]:
        rows = counts(names, "string")
        sums = rows.groupBy("tested").agg((F.count(F.lit(1)) - 1).cast("double").alias("df"), F.sum("_n").alias("n1"), *[x for c in p for x in (F.sum(c).alias(f"n{c}"), F.sum(F.col(c) * F.col(c) / F.col("_n")).alias(f"q{c}"))])

        def square_p(c: str) -> Column:
            """By the cube root of chi-square over its degrees of freedom, which is close to normal for however many of them."""
            x = F.try_divide(F.col("n1") * F.col(f"q{c}"), F.col(f"n{c}")) - F.col(f"n{c}")
            z = (F.pow(x / F.col("df"), 1 / 3) - 1 + 2 / (9 * F.col("df"))) / F.sqrt(2 / (9 * F.col("df")))
            return F.when(F.col("df") > 0, normal_two_sided(F.when(x > 1e-9, z).otherwise(0.0)))

        found.append(told(sums, square_p))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in wanted])
    return reduce(DataFrame.unionByName, found).where(F.array_contains(pairs, F.struct(F.col("column").alias("c"), F.col("tested").alias("t"))))


def missingness_report(df: DataFrame, columns: list[str], most: float = 0.8, tests: int = 25, p_limit: float = 0.05) -> DataFrame:
    """Per column with missing values: share, and MNAR if under 5 % of its ``missingness_tests`` see no difference. Over ``most`` missing: ``drop``."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first().asDict()
    shares = {c: s for c, s in shares.items() if s}
    spark = df.sparkSession
    known = spark.createDataFrame(list(shares.items()), "column string, missing double")
    out = known.where(F.col("missing") >= most).withColumn("verdict", F.lit("drop"))
    some = [c for c, s in shares.items() if s < most]
    if not some or len(columns) < 2:
        return out
    quiet = missingness_tests(df, columns, some, tests).groupBy("column").agg(F.avg((F.col("pvalue") >= p_limit).cast("double")).alias("quiet"))
    return out.unionByName(known.join(quiet, "column").select("column", "missing", F.when(F.col("quiet") < 0.05, "MNAR").otherwise("not MNAR").alias("verdict")))


def continuous_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Numeric columns that are not categories in disguise."""
    kinds = dict(df.dtypes)
    return [c for c in columns if kinds[c] in NUMERIC and frequent_values(df, c) is None]


def iqr_outliers(df: DataFrame, key: str, column: str, width: float = 1.5) -> DataFrame:
    """Beyond ``width`` spreads of the hinges, the medians of values strictly below and above the median."""
    m = df.agg(F.median(column).alias("_m"))
    rows = df.join(F.broadcast(m), F.lit(True))
    h = rows.agg(F.median(F.when(F.col(column) < F.col("_m"), F.col(column))).alias("_a"), F.median(F.when(F.col(column) > F.col("_m"), F.col(column))).alias("_b"))
    spread = width * (F.col("_b") - F.col("_a"))
    return df.join(F.broadcast(h), F.lit(True)).where((F.col(column) < F.col("_a") - spread) | (F.col(column) > F.col("_b") + spread)).select(key)


def z_outliers(df: DataFrame, key: str, column: str, limit: float = 3.0) -> DataFrame:
    s = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(F.broadcast(s), F.lit(True)).where(F.abs(F.col(column) - F.col("_m")) > limit * F.col("_s")).select(key)


def mad_outliers(df: DataFrame, key: str, column: str, limit: float = 3.0) -> DataFrame:
    rows = df.join(F.broadcast(df.agg(F.median(column).alias("_m"))), F.lit(True)).withColumn("_d", F.abs(F.col(column) - F.col("_m")))
    mad = rows.agg(F.median("_d").alias("_mad"))
    return rows.join(F.broadcast(mad), F.lit(True)).where((F.col("_mad") > 0) & (0.6745 * F.col("_d") / F.col("_mad") > limit)).select(key)


def mahalanobis_distance(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, d2): squared distance from the means. The covariance matrix (columns squared) is inverted on the driver."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    cov = np.array([[s[f"c_{a}_{b}"] if (a, b) in pairs else s[f"c_{b}_{a}"] for b in columns] for a in columns], dtype=float)
    inverse = np.linalg.pinv(cov)
    d = [F.col(c) - float(s[f"m_{c}"]) for c in columns]
    total = reduce(lambda a, b: a + b, [d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))])
    return df.select(key, total.alias("d2"))


def mahalanobis_outliers(df: DataFrame, key: str, columns: list[str], level: float = 0.95) -> DataFrame:
    return mahalanobis_distance(df, key, columns).where(chi2_sf(F.col("d2"), F.lit(len(columns))) < 1 - level).select(key)


def remove_outliers(df: DataFrame, key: str, columns: list[str], multihit: bool = True, mahalanobis: bool = True) -> DataFrame:
    """Drop rows hit by the single-column rules (more than once if ``multihit``) and, if asked, by Mahalanobis as well."""
    hits = reduce(DataFrame.union, [f(df, key, c) for c in columns for f in (iqr_outliers, z_outliers, mad_outliers)])
    bad = hits.groupBy(key).count().where(F.col("count") > (1 if multihit else 0)).select(key)
    if mahalanobis:
        bad = bad.join(mahalanobis_outliers(df, key, columns), key, "left_semi")
    return df.join(bad, key, "left_anti")


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Pairs of weighted points with rising ``x`` and falling ``y``; ties in either are none. By halves, as in merge sort."""
    order = np.lexsort((y, x))  # of equal x the smaller y first, so that they do not count
    y, n = y[order], n[order].astype(np.int64)

    def count(lo: int, hi: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(inversions, y in order, their weights) of a stretch."""
        if hi - lo <= 64:
            a, w = y[lo:hi], n[lo:hi]
            found = int(w @ (np.triu(a[:, None] > a[None, :]) @ w))
            k = np.argsort(a, kind="stable")
            return found, a[k], w[k]
        mid = (lo + hi) // 2
        one, a, v = count(lo, mid)
        two, b, w = count(mid, hi)
        behind = v.sum() - np.concatenate(([0], np.cumsum(v)))[np.searchsorted(a, b, side="right")]
        both = np.concatenate((a, b))
        k = np.argsort(both, kind="stable")
        return one + two + int(behind @ w), both[k], np.concatenate((v, w))[k]

    return count(0, len(y))[0] if len(y) else 0


def kendall_tau(df: DataFrame, x: str, y: str, pieces: int = 256) -> float | None:
    """Exact tau-b of two columns; rows that miss either go. None without spread.

    Equal points are one weighted point. Both columns are cut into ``pieces`` of about equal numbers of rows; a value that
    is a piece by itself holds no pair that counts. Pairs in different pieces of both columns come from the counts of pieces by pieces
    (a matrix on the driver), pairs in one piece of a column from the points of that piece, a task each.
    """
    points = settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy((F.col(x) + F.lit(0.0)).alias("x"), (F.col(y) + F.lit(0.0)).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    total = points.agg(F.sum("n")).first()[0] or 0
    size = max(1, total // pieces)
    ties = {"xy": points.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1))).first()[0] or 0.0}
    for c in ("x", "y"):
        values = settle(points.groupBy(c).agg(F.sum("n").alias("n")))
        ties[c] = values.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1))).first()[0] or 0.0
        # A value of more rows than a piece is the last of the piece that it begins in, and gets the next number to itself.
        piece = 2 * F.floor(F.col("below") / size) + (F.col("n") > size).cast("int")
        points = points.join(sum_below(values, [], c, "n", "below").select(c, piece.alias(f"p{c}")), c)
    points = settle(points.select("x", "y", "n", "px", "py"))

    def within(first: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda rows: pd.DataFrame({"d": [float(inversions(rows[first].to_numpy(), rows["y"].to_numpy(), rows["n"].to_numpy()))]})

    same_x = points.where("px % 2 = 0").groupBy("px").applyInPandas(within("x"), "d double")
    same_y = points.where("py % 2 = 0").groupBy("py").applyInPandas(within("px"), "d double")
    against = same_x.union(same_y).agg(F.sum("d")).first()[0] or 0.0
    cells = points.groupBy("px", "py").agg(F.sum("n").alias("n")).toPandas()
    table = cells.pivot_table(index="px", columns="py", values="n", fill_value=0).to_numpy(dtype=float)
    if len(cells):
        later = np.cumsum(np.cumsum(table[::-1], axis=0)[::-1], axis=1)  # rows from here on, columns up to here
        against += float((table[:-1, 1:] * later[1:, :-1]).sum())
    pairs = total * (total - 1) / 2
    tied_x, tied_y, tied = ties["x"] / 2, ties["y"] / 2, ties["xy"] / 2
    root = math.sqrt((pairs - tied_x) * (pairs - tied_y))
    return (pairs - tied_x - tied_y + tied - 2 * against) / root if root else None


def correlated_columns(df: DataFrame, columns: list[str], limit: float = 0.75) -> DataFrame:
    """(a, b, pearson, spearman, kendall, group) of column pairs whose squared correlations all reach ``limit``; groups are connected."""
    found = []
    for k, a in enumerate(columns):
        for b in columns[k + 1 :]:
            rows = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x is not null and y is not null")
            p = rows.agg(F.corr("x", "y")).first()[0]
            if p is None or math.isnan(p) or p * p < limit:
                continue
            s = average_ranks(average_ranks(rows, [], "x", "rx"), [], "y", "ry").agg(F.corr("rx", "ry")).first()[0]
            t = kendall_tau(rows, "x", "y")
            if s is not None and t is not None and s * s >= limit and t * t >= limit:
                found.append((a, b, p, s, t))
    spark = df.sparkSession
    pairs = spark.createDataFrame(found, "a string, b string, pearson double, spearman double, kendall double")
    if not found:
        return pairs.withColumn("group", F.lit(""))
    groups = label_components(pairs.select("a", "b"))
    return pairs.join(groups.withColumnsRenamed({"node": "a", "component": "group"}), "a")


def _box_cox(v: Column, power: float) -> Column:
    return F.log(v) if power == 0 else (F.pow(v, power) - 1) / power


TRANSFORMS: dict[str, Callable[[Column], Column]] = {"none": lambda v: v, "log1p": lambda v: F.when(v > -1, F.log1p(v)), "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)), "cbrt": lambda v: F.cbrt(v)} | {
    f"boxcox_{p:g}": (lambda v, p=p: F.when(v > 0, _box_cox(v, p))) for p in (-1.0, -0.5, 0.0, 0.25, 0.5, 2.0)
}


def distribution_check(df: DataFrame, column: str, skew_limit: float = 0.5, kurtosis_limit: float = 1.0, p_limit: float = 0.05) -> DataFrame:
    """Bias-corrected skew and excess kurtosis, D'Agostino's K2 p, and whether a transform passes; one scan."""
    made = F.array(*[F.struct(F.lit(n).alias("transform"), f(F.col(column).cast("double")).alias("v")) for n, f in TRANSFORMS.items()])
    s = df.select(F.explode(made).alias("x")).select("x.*").where("v is not null").groupBy("transform").agg(F.count("v").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    n, g1, g2 = F.col("n").cast("double"), F.col("g1"), F.col("g2")
    s = s.where("n > 20").withColumns({"skew": g1 * F.sqrt(n * (n - 1)) / (n - 2), "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)})
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    s = s.withColumns({"_y": y, "_w2": w2})
    a = F.sqrt(2 / (F.col("_w2") - 1))
    s = s.withColumn("_z1", F.asinh(F.col("_y") / a) / F.sqrt(0.5 * F.log("_w2")))
    e, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / F.sqrt(var)
    b1 = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    s = s.withColumns({"_x": x, "_b": b1})
    s = s.withColumn("_A", 6 + 8 / F.col("_b") * (2 / F.col("_b") + F.sqrt(1 + 4 / F.col("_b") ** 2)))
    d = 1 + F.col("_x") * F.sqrt(2 / (F.col("_A") - 4))
    s = s.withColumn("_z2", (1 - 2 / (9 * F.col("_A")) - F.signum(d) * F.cbrt((1 - 2 / F.col("_A")) / F.abs(d))) / F.sqrt(2 / (9 * F.col("_A"))))
    s = s.withColumn("pvalue", F.exp(-(F.col("_z1") ** 2 + F.col("_z2") ** 2) / 2))
    good = (F.abs("skew") <= skew_limit) & (F.abs("kurtosis") <= kurtosis_limit) & (F.col("pvalue") >= p_limit)
    return s.select("transform", "n", "skew", "kurtosis", "pvalue", good.alias("passes"))


def apply_best_transform(df: DataFrame, column: str) -> DataFrame:
    """Apply the passing transform of the highest p, if the raw values do not pass."""
    found = {r["transform"]: r for r in distribution_check(df, column).where("passes").collect()}
    if not found or "none" in found:
        return df
    return df.withColumn(column, TRANSFORMS[max(found.values(), key=lambda r: r["pvalue"])["transform"]](F.col(column).cast("double")))


def knn_impute(df: DataFrame, key: str, columns: list[str], target: str | list[str], k: int = 10, use: int = 3) -> DataFrame:
    """Fill missing cells of ``target`` columns by the median of the first ``use`` values among the ``k`` nearest rows, else the column's median.

    Rows are placed by z-scores of those ``columns`` that miss nothing, turned to their principal axes up to the elbow. The search
    is exact (``neighbours.nearest``); a row is the first of its own ``k``, as in a search of the table for its own rows, and
    equally near rows follow by key. Keys must be distinct.
    """
    targets = [target] if isinstance(target, str) else list(target)
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))], *[F.median(t).alias(f"mid_{t}") for t in targets], F.count(F.lit(1)).alias("_all")).first()
    whole = [c for c in columns if s[f"n_{c}"] == s["_all"]]
    gaps = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in targets])
    fills = {t: F.coalesce(t, F.lit(s[f"mid_{t}"])) for t in targets}
    if not whole or not s["_all"]:
        return df.withColumns(fills)
    z = df.select(F.col(key).alias("_key"), *[((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + 1e-6)).alias(f"_z{i}") for i, c in enumerate(whole)], gaps.alias("_gaps"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(targets)])
    z = settle(z)
    zs = [f"_z{i}" for i in range(len(whole))]
    variances, axes = principal_axes(z, zs)
    kept = elbow(variances)
    scores = [reduce(lambda a, b: a + b, [F.col(c) * float(axes[i, j]) for i, c in enumerate(zs)]).alias(f"_c{j}") for j in range(kept)]
    carried = [f"_t{i}" for i in range(len(targets))]
    near = nearest(z.select("_key", "_gaps", *carried, *scores), "_key", [f"_c{j}" for j in range(kept)], k - 1, F.col("_gaps"), carried)
    found = []
    for c in carried:
        values = F.array_sort(F.slice(F.filter(F.col(f"near.{c}"), lambda x: x.isNotNull()), 1, use))
        n = F.size(values)
        found.append(F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2).alias(f"_f{c}"))
    out = df.join(near.select("_key", *found), F.col(key) == F.col("_key"), "left")
    out = out.withColumns({t: F.coalesce(t, f"_f{c}", F.lit(s[f"mid_{t}"])) for c, t in zip(carried, targets, strict=True)})
    return out.select(*df.columns)


class RuleRegistry:
    """Named checks ``DataFrame -> report``; ``inspect`` runs them in order and stacks the reports."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def add(self, name: str, check: Callable[[DataFrame], DataFrame]) -> RuleRegistry:
        self.rules.append((name, check))
        return self

    def inspect(self, df: DataFrame) -> DataFrame:
        return union_reports([check(df).withColumn("rule", F.lit(name)) for name, check in self.rules])


class PipelineRegistry(RuleRegistry):
    """Named steps ``DataFrame -> (DataFrame, report)``; ``explore`` returns the last table and all reports."""

    def explore(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        reports = []
        for name, step in self.rules:
            df, report = step(df)
            reports.append(report.withColumn("step", F.lit(name)))
        return df, union_reports(reports)


def sample_correlation(m: DataFrame, spearman: bool = True) -> DataFrame:
    """(a, b, r) of all sample pairs over the features that both have."""
    rows = average_ranks(m, ["sample"], "value", "_rank").select("feature", "sample", F.col("_rank").alias("value")) if spearman else m
    left, right = rows.select("feature", F.col("sample").alias("a"), F.col("value").alias("x")), rows.select("feature", F.col("sample").alias("b"), F.col("value").alias("y"))
    return left.join(right, "feature").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def sample_distance(m: DataFrame) -> DataFrame:
    """(a, b, distance): Euclidean, from inner products, so absent cells count as 0."""
    norms = m.groupBy("sample").agg(F.sum(F.col("value") ** 2).alias("n2"))
    left, right = m.select("feature", F.col("sample").alias("a"), F.col("value").alias("x")), m.select("feature", F.col("sample").alias("b"), F.col("value").alias("y"))
    dots = left.join(right, "feature").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    pairs = norms.select(F.col("sample").alias("a"), F.col("n2").alias("na")).join(norms.select(F.col("sample").alias("b"), F.col("n2").alias("nb")), F.col("a") < F.col("b"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(F.col("na") + F.col("nb") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))).alias("distance"))


def mean_variance(m: DataFrame) -> DataFrame:
    s = m.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return s.select("feature", F.when(F.col("mean") > 0, F.log10("mean")).alias("log_mean"), F.when(F.col("variance") > 0, F.log10("variance")).alias("log_variance"))
