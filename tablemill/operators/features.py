"""Feature engineering, column choice, splitting and scaling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.scalar import indicator, key_bucket, log1p, ratio

# Columns that never are model inputs, and the type names that are.
NON_FEATURES = ("id", "feature_updated_timestamp", "event_timestamp", "processed_timestamp")
NUMERIC_TYPES = ("int", "bigint", "double", "float")


def engineer_features(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The feature projection: key, ratio, log, indicator and update stamp. Works on streams too."""
    return df.select(
        "id",
        ratio("value_1", "value_2").alias("feature_1"),
        log1p("value_3").alias("feature_2"),
        indicator("category", "A").alias("feature_3"),
        (F.current_timestamp() if now is None else now).alias("feature_updated_timestamp"),
    )


def numeric_features(
    df: DataFrame, exclude: Iterable[str] = NON_FEATURES, types: Sequence[str] = NUMERIC_TYPES
) -> list[str]:
    """Names of the numeric columns, in order; the same list serves training and scoring."""
    left_out = set(exclude)
    return [name for name, kind in df.dtypes if name not in left_out and kind in types]


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All columns but ``columns``; an unknown name is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"cannot exclude unknown columns {missing}")
    return df.drop(*columns)


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN become 0 in ``columns``."""
    kinds = dict(df.dtypes)
    zero = {c: 0.0 if kinds[c] in ("double", "float") else 0 for c in columns}
    return df.fillna(zero)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def split_train_test(
    df: DataFrame, key: str, test_fraction: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """A split that depends on the key alone: repeatable under any partitioning."""
    marked = with_split(df, key, test_fraction)
    return (
        marked.filter("NOT is_test").drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def with_split(df: DataFrame, key: str, test_fraction: float = 0.2) -> DataFrame:
    """Add ``is_test``."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    bucket = key_bucket(key, "integer" if whole else "other")
    return df.withColumn("is_test", bucket < F.lit(int(test_fraction * 2**32)))


@dataclass(frozen=True)
class Scaler:
    """Column means and population standard deviations, kept with the model."""

    mean: Mapping[str, float]
    sd: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        """One pass over ``columns``; the single row of statistics is all the driver sees."""
        row = df.agg(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns],
        ).first()
        return cls(
            {c: _number(row[f"mean_{c}"]) for c in columns},
            {c: _number(row[f"sd_{c}"]) for c in columns},
        )

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """(x - mean) / sd, a projection; a column without variance becomes 0."""
        scaled = {}
        for c, sd in self.sd.items():
            centred = F.col(c).cast("double") - F.lit(self.mean[c])
            flat = F.when(F.col(c).isNotNull(), F.lit(0.0))
            scaled[c + suffix] = centred / F.lit(sd) if sd > 0 else flat
        return df.withColumns(scaled)

    def as_dict(self) -> dict:
        return asdict(self)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fit and apply a :class:`Scaler` on the same rows."""
    return Scaler.fit(df, columns).transform(df)


def signature(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    """Ordered names and types of the model inputs."""
    kinds = dict(df.dtypes)
    return [(c, kinds[c]) for c in columns]


def check_signature(df: DataFrame, expected: Sequence[tuple[str, str]]) -> None:
    """Raise when ``df`` lacks an input or has it under another type."""
    kinds = dict(df.dtypes)
    wrong = [(c, kind, kinds.get(c)) for c, kind in expected if kinds.get(c) != kind]
    if wrong:
        raise ValueError(f"model inputs differ (name, expected, found): {wrong}")


def _number(value) -> float:
    return 0.0 if value is None else float(value)
