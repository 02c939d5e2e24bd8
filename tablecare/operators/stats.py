"""Two-group tests, tables, effect sizes and models, one row per segment."""

from __future__ import annotations

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions.text import quoted
from .aggregate import value_counts
from .cells import blank_of, join_on, key_of, number_of, row_order, shared
from .conditions import Condition
from .profile import infer_types

# The smallest expected count and the fewest events per predictor.
MIN_EXPECTED = 5
MIN_EVENTS_PER_PREDICTOR = 10
METHODS = {"yesno": "logistic", "measurement": "linear", "time": "survival"}


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join per segment; without segments both sides are one row."""
    if by:
        return join_on(left, right, by)
    one = right.agg(F.first(F.struct(*[quoted(c) for c in right.columns]))).scalar()
    return left.withColumn("__one", one).select(*left.columns, "__one.*")


# --- contingency tables ------------------------------------------------------------------


def _product(a: str, b: str) -> Column:
    """Two counts multiplied as doubles: their product may not fit a long."""
    return F.col(a).cast("double") * F.col(b).cast("double")


def _spelled(df: DataFrame, a: str, b: str, order_by, by: list[str]) -> DataFrame:
    """The rows counted per segment and pair of spellings; everything else reads this."""
    rows = df.filter(~blank_of(df, a) & ~blank_of(df, b))
    return shared(rows.groupBy(
        *[quoted(c) for c in by], key_of(df, a).alias("a_key"), quoted(a).alias("a_label"),
        key_of(df, b).alias("b_key"), quoted(b).alias("b_label"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min(row_order(order_by)).alias("first")))


def _margin(spelled: DataFrame, side: str, by: list[str]) -> DataFrame:
    """One row per level: its total, its first spelling and when it was first seen."""
    return spelled.groupBy(*by, f"{side}_key").agg(
        F.sum("n").alias(f"{side}_total"), F.min_by(f"{side}_label", "first").alias(f"{side}_label"),
        F.min("first").alias(f"{side}_first"),
    )


def _with_margins(spelled: DataFrame, by: list[str]) -> DataFrame:
    cells = spelled.groupBy(*by, "a_key", "b_key").agg(F.sum("n").alias("n"))
    with_a = join_on(cells, _margin(spelled, "a", by), [*by, "a_key"])
    return join_on(with_a, _margin(spelled, "b", by), [*by, "b_key"])


def contingency_cells(df: DataFrame, a: str, b: str, order_by, by: list[str] = ()) -> DataFrame:
    """Observed cells with margins and expected counts.

    ``a_key, b_key, a_label, b_label, n, a_total, b_total, total, expected`` per
    segment; one grouping of the rows, margins from the grouped table.
    """
    by = list(by)
    spelled = _spelled(df, a, b, order_by, by)
    out, total = _with_margins(spelled, by), spelled.groupBy(*by).agg(F.sum("n").alias("total"))
    out = join_on(out, total, by) if by else out.withColumn("total", total.select("total").scalar())
    return out.withColumn("expected", _product("a_total", "b_total") / F.col("total"))


def _side(spelled: DataFrame, side: str, by: list[str]) -> DataFrame:
    """Per segment: how many levels a side has, its rarest, its first and its last seen."""
    key, label, first = f"{side}_key", f"{side}_label", f"{side}_first"
    return _margin(spelled, side, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias(f"{side}_levels"), F.min(f"{side}_total").alias(f"{side}_least"),
        F.sum(f"{side}_total").alias(f"{side}_sum"), F.min_by(key, first).alias(f"{side}_one"),
        F.min_by(label, first).alias(f"{side}_1"), F.max_by(label, first).alias(f"{side}_2"),
    )


def contingency(df: DataFrame, a: str, b: str, order_by, by: list[str] = ()) -> DataFrame:
    """Chi-square, degrees of freedom, smallest expected count and the 2 by 2 cells.

    Unobserved cells need no rows: over all cells the statistic is the sum of
    o*o/e minus the total.  ``a`` of the 2 by 2 counts the levels seen first.
    """
    by = list(by)
    spelled = _spelled(df, a, b, order_by, by)
    sides = _joined(_side(spelled, "a", by), _side(spelled, "b", by), by)
    marked = _joined(_with_margins(spelled, by), sides, by)
    in_a, in_b = F.col("a_key") == F.col("a_one"), F.col("b_key") == F.col("b_one")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    expected = _product("a_total", "b_total") / F.col("a_sum")
    summed = marked.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(_product("n", "n") / expected) - F.sum("n")).alias("chi_square"),
        count(in_a & in_b).alias("c11"), count(in_a & ~in_b).alias("c12"),
        count(~in_a & in_b).alias("c21"), count(~in_a & ~in_b).alias("c22"),
    )
    out = _joined(summed, sides, by).filter((F.col("a_levels") >= 2) & (F.col("b_levels") >= 2))
    two = (F.col("a_levels") == 2) & (F.col("b_levels") == 2)
    return out.select(
        *by, "n", "a_levels", "b_levels", F.greatest(F.col("chi_square"), F.lit(0.0)).alias("chi_square"),
        ((F.col("a_levels") - 1) * (F.col("b_levels") - 1)).alias("df"),
        (_product("a_least", "b_least") / F.col("n")).alias("min_expected"),
        *[F.when(two, F.col(c)).alias(c) for c in ("c11", "c12", "c21", "c22")],
        "a_1", "a_2", "b_1", "b_2",
    )


def table_test(df: DataFrame, a: str, b: str, order_by, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Chi-square, or Fisher for a 2 by 2 table with an expected count under 5.

    A larger table with so small a count keeps chi-square and is marked not
    reliable.  2 by 2 tables also get odds and risk ratios.
    """
    base = contingency(df, a, b, order_by, by)
    two, sparse = F.col("c11").isNotNull(), F.col("min_expected") < MIN_EXPECTED
    exact = two & sparse
    # Null counts keep the exact test away from tables it is not for.
    asked = [F.when(exact, F.col(c)) for c in ("c11", "c12", "c21", "c22")]
    tested = base.withColumn("fisher", dist.fisher_p(*asked)).withColumn(
        "chi_p", dist.chi_square_p("chi_square", F.col("df").cast("double"))
    )
    return tested.select(
        *base.columns,
        F.when(exact, F.lit("fisher")).otherwise(F.lit("chi-square")).alias("test"),
        F.when(exact, F.col("fisher.p")).otherwise(F.col("chi_p")).alias("p"),
        (~sparse).alias("reliable"),
        *odds_ratio(F.col("c11"), F.col("c12"), F.col("c21"), F.col("c22"), level),
        *risk_ratio(F.col("c11"), F.col("c12"), F.col("c21"), F.col("c22"), level),
    )


def _corrected(*cells: Column) -> list[Column]:
    """Half a count added to every cell when any cell is empty."""
    empty = F.least(*cells) == 0
    return [c + F.when(empty, F.lit(0.5)).otherwise(F.lit(0.0)) for c in cells]


def _log_interval(value: Column, se: Column, level: float, name: str) -> list[Column]:
    z = F.lit(dist.z_for(level))
    return [
        value.alias(name), F.exp(F.ln(value) - z * se).alias(f"{name}_lo"), F.exp(F.ln(value) + z * se).alias(f"{name}_hi"),
    ]


def odds_ratio(a: Column, b: Column, c: Column, d: Column, level: float = 0.95) -> list[Column]:
    """Odds ratio with its log interval."""
    a, b, c, d = _corrected(a, b, c, d)
    return _log_interval(a * d / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d), level, "odds_ratio")


def risk_ratio(a: Column, b: Column, c: Column, d: Column, level: float = 0.95) -> list[Column]:
    """Risk ratio with its log interval."""
    a, b, c, d = _corrected(a, b, c, d)
    se = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    return _log_interval((a / (a + b)) / (c / (c + d)), se, level, "risk_ratio")


def wilson(x: Column, n: Column, level: float = 0.95) -> list[Column]:
    """A proportion with its Wilson interval."""
    z = F.lit(dist.z_for(level))
    x, n = x.cast("double"), F.when(n > 0, n).cast("double")
    p, shrink = x / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / shrink
    margin = z / shrink * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return [
        p.alias("proportion"), F.greatest(F.lit(0.0), middle - margin).alias("lo"),
        F.least(F.lit(1.0), middle + margin).alias("hi"),
    ]


def proportion(df: DataFrame, condition: Condition, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Share of rows a condition holds for, with its Wilson interval, per segment."""
    counts = df.groupBy(*[quoted(c) for c in by]).agg(
        F.count_if(condition.test(df)).alias("x"), F.count(F.lit(1)).alias("n")
    )
    return counts.select(*by, "x", "n", *wilson(F.col("x"), F.col("n"), level))


# --- two means -----------------------------------------------------------------------------


def welch(df: DataFrame, value: str, group: str, order_by, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Welch's t-test of a number between two groups.

    ``status`` says why a segment has no test: not two groups, fewer than two
    numbers in a group, or no spread in both.  Unreadable numbers are left out.
    """
    by = list(by)
    rows = df.filter(~blank_of(df, group)).select(
        *[quoted(c) for c in by], key_of(df, group).alias("key"), quoted(group).alias("label"),
        row_order(order_by).alias("first"), number_of(df, value).alias("x"),
    )
    stats = rows.groupBy(*by, "key").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.min("first").alias("first"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )
    labels = value_counts(df, group, order_by, by).select(*by, "key", "label")
    each = F.struct("label", "n", "mean", "var", (F.col("lo") == F.col("hi")).alias("constant"))
    pair = join_on(stats, labels, [*by, "key"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.min_by(each, "first").alias("a"), F.max_by(each, "first").alias("b"),
    )
    few = (F.col("a.n") < 2) | (F.col("b.n") < 2)
    status = (
        F.when(F.col("groups") != 2, F.lit("needs exactly two groups"))
        .when(few, F.lit("needs two numbers in each group"))
        .when(F.col("a.constant") & F.col("b.constant"), F.lit("no variation to test"))
        .otherwise(F.lit("ok"))
    )
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    ok = F.col("status") == "ok"
    tested = pair.withColumn("status", status).select(
        *by, F.col("a.label").alias("group_a"), F.col("b.label").alias("group_b"),
        F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"),
        F.col("a.mean").alias("mean_a"), F.col("b.mean").alias("mean_b"),
        F.sqrt("a.var").alias("sd_a"), F.sqrt("b.var").alias("sd_b"),
        F.when(ok, F.col("a.mean") - F.col("b.mean")).alias("diff"), F.when(ok, F.sqrt(va + vb)).alias("se"),
        F.when(ok, (F.col("a.mean") - F.col("b.mean")) / F.sqrt(va + vb)).alias("t"),
        F.when(ok, (va + vb) * (va + vb) / (va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1))).alias("df"),
        "status",
    )
    half = dist.t_multiplier_at(level)("df") * F.col("se")
    return tested.withColumn("p", dist.t_p("t", "df")).withColumn("__h", half).select(
        *tested.columns, "p", (F.col("diff") - F.col("__h")).alias("lo"), (F.col("diff") + F.col("__h")).alias("hi")
    )


def choose_test(df: DataFrame, a: str, b: str, order_by, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Pick the test two columns call for and run it.

    A number and a group compare means, two groups make a table, two numbers are
    refused.
    """
    numeric = {r["column"] for r in infer_types(df, [a, b]).filter("is_numeric").collect()}
    if numeric == {a, b}:
        raise ValueError("both columns are numbers: pick one grouping and one outcome column")
    if numeric:
        value = numeric.pop()
        return welch(df, value, b if value == a else a, order_by, by, level)
    return table_test(df, a, b, order_by, by, level)


# --- models ----------------------------------------------------------------------------------


def epv_gate(
    df: DataFrame, outcome_type: str, predictors: int, event: Condition | None = None, repeated: bool = False
) -> DataFrame:
    """Whether the data carries a regression with so many predictors."""
    method = METHODS.get(outcome_type)
    events = F.count(F.lit(1)) if outcome_type == "measurement" or event is None else F.count_if(event.test(df))
    counted = df.agg(events.alias("events"))
    per = F.col("events") / F.lit(predictors if predictors > 0 else None)
    refused = F.lit(repeated or method is None or predictors < 1) | (per < MIN_EVENTS_PER_PREDICTOR)
    reason = (
        F.when(F.lit(repeated), F.lit("repeated measures"))
        .when(F.lit(method is None), F.lit("unknown outcome"))
        .when(F.lit(predictors < 1), F.lit("no predictor"))
        .when(per < MIN_EVENTS_PER_PREDICTOR, F.lit("too few events"))
    )
    suggested = F.greatest(F.lit(1), F.floor(F.col("events") / MIN_EVENTS_PER_PREDICTOR))
    return counted.select(
        "events", F.lit(predictors).alias("predictors"), per.cast("double").alias("epv"), F.lit(method).alias("method"),
        F.when(F.coalesce(refused, F.lit(True)), F.lit("refuse")).otherwise(F.lit("proceed")).alias("decision"),
        reason.alias("reason"), F.when(reason == "too few events", suggested).cast("long").alias("suggested"),
    )


def regress(df: DataFrame, outcome: str, predictors: list[str], method: str, level: float = 0.95) -> DataFrame:
    """Logistic or linear regression with Wald intervals; odds ratios for logistic.

    Rows with a missing value are left out, as a complete-case fit does.
    """
    family = {"logistic": "binomial", "linear": "gaussian"}.get(method)
    if family is None:
        raise ValueError(f"no {method!r} model")
    safe = {c: f"x{i}" for i, c in enumerate([outcome, *predictors])}
    rows = df.select(*[quoted(c).alias(n) for c, n in safe.items()]).dropna()
    formula = RFormula(formula="x0 ~ " + " + ".join(safe[p] for p in predictors))
    ready = formula.fit(rows).transform(rows)
    fit = GeneralizedLinearRegression(family=family, maxIter=50, tol=1e-10).fit(ready)
    summary = fit.summary
    back = {n: c for c, n in safe.items()}
    features = _feature_names(ready)
    terms = ["(intercept)", *[_term(f, back) for f in features]]
    estimates = [fit.intercept, *fit.coefficients.toArray()]
    errors = _intercept_first(summary.coefficientStandardErrors)
    p_values = _intercept_first(summary.pValues)
    if method == "linear":
        freedom = summary.degreesOfFreedom
        multiplier = float(dist.t_multiplier([freedom], level)[0])
    else:
        multiplier = dist.z_for(level)
    table = [
        (t, float(e), float(s), float(p), float(e - multiplier * s), float(e + multiplier * s))
        for t, e, s, p in zip(terms, estimates, errors, p_values)
    ]
    out = df.sparkSession.createDataFrame(table, "term string, estimate double, se double, p double, lo double, hi double")
    if method == "linear":
        return out
    return out.withColumns({"odds_ratio": F.exp("estimate"), "or_lo": F.exp("lo"), "or_hi": F.exp("hi")})


def _intercept_first(values) -> list[float]:
    """Spark lists the intercept last in these summaries."""
    return [values[-1], *values[:-1]]


def _feature_names(ready: DataFrame) -> list[str]:
    attributes = ready.schema["features"].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((x for group in attributes.values() for x in group), key=lambda x: x["idx"])]


def _term(feature: str, back: dict[str, str]) -> str:
    name, _, level = feature.partition("_")
    return back.get(name, name) + (f" = {level}" if level else "")
