"""Column expressions over flow tables: cleaning, downcasting, derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import (DERIVED_FEATURES, EPS, FLAG_NUMBER_COLUMNS, HIGH_FREQUENCY_RATE,
                        PROTOCOL_MIX_COLUMNS)


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def nonfinite(col: Column) -> Column:
    """Null, NaN, +Inf or -Inf."""
    return col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))


def finite_or_zero(col: Column) -> Column:
    return F.when(nonfinite(col), F.lit(0.0)).otherwise(col.cast("double"))


def clean_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace null, NaN and +-Inf by 0 in ``columns``; other columns pass through."""
    wanted = set(columns)
    return df.select(*[finite_or_zero(c(n)).alias(n) if n in wanted else c(n) for n in df.columns])


def downcast_numeric(df: DataFrame) -> DataFrame:
    """double -> float; bigint -> int via ``try_cast`` (out of range becomes null, not a wrap)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(c(f.name).cast("float").alias(f.name))
        elif isinstance(f.dataType, T.LongType):
            out.append(c(f.name).try_cast("int").alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


def _get(present: set[str], name: str) -> Column:
    """A raw feature; a missing one reads as 0."""
    return c(name).cast("double") if name in present else F.lit(0.0)


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den + F.lit(EPS))


def derived_feature_map(present: set[str]) -> dict[str, Column]:
    """The 12 derived features (before cleaning) from the raw columns present."""
    g = lambda n: _get(present, n)
    one, zero = F.lit(1.0), F.lit(0.0)
    flag_sum = zero
    for n in FLAG_NUMBER_COLUMNS:
        flag_sum = flag_sum + g(n)
    mix = zero
    for n in PROTOCOL_MIX_COLUMNS:
        mix = mix + g(n)
    return {
        "syn_to_fin_ratio": _ratio(g("syn_count"), g("fin_count")),
        "ack_to_syn_ratio": _ratio(g("ack_count"), g("syn_count")),
        "rst_ratio": _ratio(g("rst_count"), g("Number")),
        "size_variance_ratio": _ratio(g("Variance"), g("AVG")),
        "size_range": g("Max") - g("Min"),
        "pkts_per_second": g("Rate"),
        "bytes_per_packet": _ratio(g("Tot size"), g("Number")),
        "flag_diversity": flag_sum,
        "has_web_traffic": F.when((g("HTTP") > 0) | (g("HTTPS") > 0), one).otherwise(zero),
        "has_system_traffic": F.when((g("SSH") > 0) | (g("Telnet") > 0) | (g("DNS") > 0), one).otherwise(zero),
        "protocol_mix": mix,
        "high_frequency_flag": F.when(g("Rate") > HIGH_FREQUENCY_RATE, one).otherwise(zero),
    }


def derived_features(present: list[str] | set[str]) -> list[Column]:
    """Derived feature columns in canonical order, non-finite values set to 0."""
    exprs = derived_feature_map(set(present))
    return [finite_or_zero(exprs[n]).alias(n) for n in DERIVED_FEATURES]


def add_derived_features(df: DataFrame) -> DataFrame:
    """Append the 12 derived features; raw columns missing from ``df`` read as 0."""
    return df.select("*", *derived_features(df.columns))


def feature_vector(names: list[str]) -> Column:
    """``array<double>`` of ``names`` in the given order (assembled by name, never by position)."""
    return F.array(*[c(n).cast("double") for n in names])
