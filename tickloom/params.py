"""Run configurations: defaults, validity and labels.

A configuration is a plain dict of the tunables below. A sweep turns a list of
them into a small DataFrame, one row per configuration.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default tunables of the tracker and the sampler.
DEFAULTS: dict[str, object] = {
    "alpha_base": 0.05,
    "beta": 0.5,
    "outlier_threshold": 1.0,
    "drift_tolerance": 3,
    "initial_variance_floor": 0.0,
    "min_interval": 1,
    "max_interval": 20,
    "variance_sensitivity": 1.0,
    "interval_mapping": "linear_rate",
    "power": 2.0,
    "logistic_midpoint": 0.5,
    "logistic_steepness": 8.0,
    "exponential_steepness": 4.0,
    "sigma_ref": 0.0,
    "warmup": 5,
    "sigma_ref_adapt": 0.01,
    "warmup_positive_std_only": False,
    "instability_window": 20,
    "instability_weight": 1.0,
    "drift_boost": 1.0,
    "drift_decay": 0.90,
    "cooldown_rate": 0.10,
    "cooldown_threshold": 0.20,
    "urgency_smoothing": 0.60,
    "outlier_decay": 0.85,
    "sigma_band": 3.0,
}

# The I/O monitoring profile differs from the defaults in these.
IO_PROFILE: dict[str, object] = {
    "initial_variance_floor": 1.0,
    "warmup_positive_std_only": True,
    "max_interval": 10,
}

# Defaults of the literature policies.
POLICY_DEFAULTS: dict[str, dict[str, object]] = {
    "wavelet_rate": {
        "window": 64, "retained_energy": 0.995, "measurements_per_coefficient": 5.0,
        "min_samples": 4, "initial_sparsity_fraction": 0.10,
        "process_variance": 0.0025, "measurement_variance": 0.01,
        "envelope_min": None, "envelope_max": None,
    },
    "predictive_frequency": {
        "intervals": [1, 2, 4, 8, 16, 20], "ewma_alpha": 0.2,
        "error_fraction": 0.1, "hysteresis": 0.2,
    },
    "robust_exponential": {
        "min_interval": 1, "max_interval": 20, "reference_window": 20,
        "deviation_threshold": 3.0, "recovery_samples": 3,
    },
    "time_or_variation": {
        "max_interval": 20, "variation_threshold": None, "threshold_scale": 1.0,
        "threshold_quantile": 0.90, "calibration": 64,
    },
}

# Parameters shown in a label for each interval mapping.
MAPPING_PARAMS: dict[str, tuple[str, ...]] = {
    "power_rate": ("power",),
    "logistic_rate": ("logistic_midpoint", "logistic_steepness"),
    "exponential_ease_out_rate": ("exponential_steepness",),
}

# The eight mapping configurations of the ablation.
MAPPING_ABLATION: list[dict[str, object]] = [
    {"interval_mapping": "original_interval"},
    {"interval_mapping": "smoothstep_interval"},
    {"interval_mapping": "geometric_rate"},
    {"interval_mapping": "exponential_ease_out_rate", "exponential_steepness": 4.0},
    {"interval_mapping": "power_rate", "power": 0.5},
    {"interval_mapping": "power_rate", "power": 2.0},
    {"interval_mapping": "logistic_rate", "logistic_midpoint": 0.4, "logistic_steepness": 12.0},
    {"interval_mapping": "logistic_rate", "logistic_midpoint": 0.6, "logistic_steepness": 12.0},
]


def make_config(**overrides: object) -> dict[str, object]:
    unknown = set(overrides) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return {**DEFAULTS, **overrides}


def grid(params: Mapping[str, Iterable[object]]) -> list[dict[str, object]]:
    """Cartesian product of parameter lists over the defaults, in input order."""
    names = list(params)
    return [make_config(**dict(zip(names, combo))) for combo in itertools.product(*params.values())]


_TYPES = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}


def config_frame(spark: SparkSession, configs: list[dict[str, object]]) -> DataFrame:
    """One row per configuration, ``config_id`` in list order."""
    schema = T.StructType([T.StructField("config_id", T.IntegerType(), False)] + [
        T.StructField(n, _TYPES[type(v)]) for n, v in DEFAULTS.items()])
    kind = {n: type(v) for n, v in DEFAULTS.items()}
    rows = [(i, *[kind[n](c[n]) for n in DEFAULTS]) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, schema)


def with_configs(df: DataFrame, configs: list[dict[str, object]]) -> DataFrame:
    """Every row once per configuration, with the configuration's columns.

    The list is a literal inside the plan, so nothing is joined or broadcast.
    """
    kind = {n: type(v) for n, v in DEFAULTS.items()}
    literal = F.array(*[
        F.struct(F.lit(i).alias("config_id"), *[F.lit(kind[n](c[n])).alias(n) for n in DEFAULTS])
        for i, c in enumerate(configs)
    ])
    return df.withColumn("__c", F.explode(literal)).select(*df.columns, "__c.*")


def is_valid(n_ticks: Column) -> Column:
    """Configurations a grid search accepts for a trace of ``n_ticks``."""
    return (
        (F.col("alpha_base") > 0) & (F.col("alpha_base") < 1)
        & (F.col("beta") > 0)
        & (F.col("outlier_threshold") > 0)
        & (F.col("drift_tolerance") >= 0)
        & (F.col("max_interval") > 0)
        & (F.col("max_interval") <= n_ticks)
        & (F.col("max_interval") >= F.col("min_interval"))
    )


def config_label(params: Iterable[str]) -> Column:
    """``name=value`` pairs, leaving out parameters the row's mapping does not use."""
    owner = {p: m for m, ps in MAPPING_PARAMS.items() for p in ps}
    parts = []
    for p in params:
        shown = F.regexp_replace(F.col(p).cast("string"), r"\.0$", "")
        text = F.concat(F.lit(f"{p}="), shown)
        parts.append(F.when(F.col("interval_mapping") == owner[p], text) if p in owner else text)
    label = F.concat_ws(", ", *parts)
    return F.when(label == "", F.lit("default")).otherwise(label)


def encode(config: Mapping[str, object]) -> str:
    return json.dumps(config, sort_keys=True)
