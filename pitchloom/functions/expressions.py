"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitchloom import schema as S


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _one_of(column, names) -> Column:
    """Membership as one SQL text where possible (a single call into the JVM)."""
    if not isinstance(column, str):
        return column.isin(*names)
    listed = ", ".join(f"'{n}'" for n in names)
    return F.expr(f"{column} IN ({listed})")


_OFFSETS = " ".join(f"WHEN {p} THEN {m}D" for p, m in S.PERIOD_OFFSETS.items())


def action_minute(period: str = "period_id", seconds: str = "time_seconds") -> Column:
    """Match minute: period offset (0 for an unknown period) plus the period clock."""
    return F.expr(f"CASE {period} {_OFFSETS} ELSE 0D END + {seconds} / 60D")


def is_pass_like(type_name="type_name") -> Column:
    return _one_of(type_name, S.PASS_LIKE_TYPES)


def is_comparable(type_name="type_name") -> Column:
    return _one_of(type_name, S.PROVIDER_COMPARABLE_TYPES)


def is_set_piece(type_name="type_name") -> Column:
    return _one_of(type_name, S.POSSESSION_SET_PIECES)


def is_contest(type_name="type_name") -> Column:
    return _one_of(type_name, S.CONTEST_TYPES)


def is_shot(type_name="type_name") -> Column:
    """Prefix test: penalties and direct free kicks are shots too."""
    return _c(type_name).startswith("shot")


def is_success(result="result_name") -> Column:
    return _c(result) == "success"


def is_completed_pass() -> Column:
    return is_pass_like() & F.expr("result_name = 'success'")


def dx() -> Column:
    return F.col("end_x") - F.col("start_x")


def dy() -> Column:
    return F.col("end_y") - F.col("start_y")


def step_length() -> Column:
    return F.expr("hypot(end_x - start_x, end_y - start_y)")


def is_progressive() -> Column:
    return is_completed_pass() & (dx() > S.PROGRESSIVE_DX)


def zone_of(x) -> Column:
    """Pitch third; an unknown x stays unknown."""
    return (
        F.when(_c(x) < S.ZONE_EDGES[0], "defensive")
        .when(_c(x) < S.ZONE_EDGES[1], "middle")
        .when(_c(x).isNotNull(), "final")
    )


def safe_ratio(numerator, denominator) -> Column:
    """a / b, and 0 when b is 0 or anything is unknown."""
    return F.coalesce(
        _c(numerator).cast("double") / F.nullif(_c(denominator).cast("double"), F.lit(0.0)),
        F.lit(0.0),
    )


def directness(net, path) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(net, path)))


def share(condition: Column) -> Column:
    """Mean of a flag as an aggregate."""
    return F.avg(condition.cast("double"))


def tally(condition: Column) -> Column:
    """Count of rows where the flag holds (null counts as false)."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def rounded(column, digits: int = 6) -> Column:
    """Report rounding; adding zero removes negative zero."""
    return F.round(_c(column), digits) + F.lit(0.0)


def round_report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column of a report."""
    return df.select(
        *[
            rounded(name, digits).alias(name) if kind in ("double", "float") else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def match_outcome(home="home_score", away="away_score") -> Column:
    gap = F.signum(_c(home).cast("double") - _c(away).cast("double"))
    return F.when(gap > 0, S.OUTCOMES[0]).when(gap < 0, S.OUTCOMES[2]).when(gap == 0, S.OUTCOMES[1])


def index_in(column, labels) -> Column:
    """Position of a label in a fixed list, null when absent."""
    out = F.lit(None).cast("long")
    for number, label in enumerate(labels):
        out = F.when(_c(column) == label, F.lit(number).cast("long")).otherwise(out)
    return out


def first_window(minute) -> Column:
    """Lowest index of the half-open sliding windows holding a minute."""
    return F.greatest(
        F.lit(0),
        (F.floor((_c(minute) - S.WINDOW_MINUTES) / S.STRIDE_MINUTES) + 1).cast("int"),
    )


def last_window(minute) -> Column:
    return F.least(
        F.lit(S.WINDOW_COUNT - 1), F.floor(_c(minute) / S.STRIDE_MINUTES).cast("int")
    )


def first_checkpoint(minute) -> Column:
    """Index of the first checkpoint at or after a minute (inclusive bound)."""
    return F.greatest(
        F.lit(0),
        F.ceil((_c(minute) - S.WINDOW_MINUTES) / S.STRIDE_MINUTES).cast("int"),
    )
