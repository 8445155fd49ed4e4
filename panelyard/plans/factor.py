"""Factors: a declaration and its formulas, computed as one lazy plan and audited against prefixes of history."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions import frames
from panelyard.plans.dsl import ALIASES, Compiler, ContractError, lookback, parsed

KEYS = ("trade_date", "ts_code")


@dataclass(frozen=True)
class Factor:
    name: str
    formula: str
    required_fields: tuple[str, ...]
    lookback_days: int
    features: dict[str, str] = field(default_factory=dict)
    parameters: dict[str, float] = field(default_factory=dict)
    direction: str = "positive"
    universe: str = "default"
    cross_section: str = "market"
    group_field: str = "industry_l1_code"
    min_group_size: int = 10
    winsorize: str = "none"
    mad_scale: float = 5.0
    standardize: str = "none"


#: Keys that a declaration may have, section by section; any other key is an error.
SECTIONS = {
    "factor": {"name", "label", "description", "hypothesis", "direction", "expected_shape"},
    "data": {"frequency", "required_fields", "lookback_days"},
    "scope": {"universe", "cross_section", "group_field", "industry_standard", "industry_level", "point_in_time_required", "min_group_size"},
    "calculation": {"parameters", "features", "formula", "missing_policy", "winsorize", "mad_scale", "standardize"},
    "output": {"value_field"},
}


def load_factor(text: str) -> Factor:
    """A factor from its YAML declaration (JSON where no YAML parser is installed)."""
    try:
        import yaml

        spec = yaml.safe_load(text)
    except ImportError:
        import json

        spec = json.loads(text)
    unknown = [k for k in spec if k not in SECTIONS and k not in ("version", "kind")] + [f"{s}.{k}" for s, known in SECTIONS.items() for k in spec.get(s, {}) if k not in known]
    if unknown:
        raise ContractError(f"unknown keys: {', '.join(unknown)}")
    factor, data, scope, calc = (spec.get(s, {}) for s in ("factor", "data", "scope", "calculation"))
    parameters = {k: v["value"] if isinstance(v, dict) else v for k, v in (calc.get("parameters") or {}).items()}
    picked = {k: scope[k] for k in ("universe", "cross_section", "group_field", "min_group_size") if k in scope} | {k: calc[k] for k in ("winsorize", "mad_scale", "standardize") if k in calc}
    return Factor(factor["name"], calc["formula"], tuple(data["required_fields"]), data["lookback_days"], dict(calc.get("features") or {}), parameters, factor.get("direction", "positive"), **picked)


def inferred_lookback(spec: Factor) -> int:
    features: dict[str, int] = {}
    for name, formula in spec.features.items():
        features[name] = lookback(formula, spec.parameters, features)
    return lookback(spec.formula, spec.parameters, features)


def compute(panel: DataFrame, spec: Factor) -> DataFrame:
    """trade_date, ts_code, factor_value, factor_valid, invalid_reason[, group_code] for each row of the panel."""
    if (needed := inferred_lookback(spec)) > spec.lookback_days:
        raise ContractError(f"{spec.name} declares {spec.lookback_days} rows of history and reads {needed}")
    allowed = {ALIASES.get(f, f) for f in spec.required_fields}
    if missing := sorted(allowed - set(panel.columns)):
        raise ContractError(f"{spec.name} needs fields that the panel lacks: {', '.join(missing)}")
    grouped = spec.cross_section == "industry"
    if grouped:
        allowed.add(spec.group_field)
    extra = {"is_factor_eligible"} if spec.universe == "factor_eligible" else {f"is_{spec.universe}"} if spec.universe != "default" else set()
    panel = frames.nan_to_null(panel.select(*KEYS, *sorted((allowed | extra) - set(KEYS))))
    mask = None
    if spec.universe == "factor_eligible":
        panel, mask = panel.withColumn("_mask", F.coalesce("is_factor_eligible", F.lit(False))), "_mask"
    compiler = Compiler(panel.columns, spec.parameters, allowed, spec.min_group_size, mask)
    for name, formula in spec.features.items():
        compiler.feature(name, formula)
    value = compiler._clean(compiler.compile(parsed(spec.formula)))
    out = compiler.apply(panel).withColumn("factor_value", -value.column if spec.direction == "negative" else value.column)
    if mask:
        out = out.withColumn("factor_value", F.when(F.col(mask), F.col("factor_value")))
    if spec.winsorize == "mad":
        out = frames.winsorize_mad(out, "factor_value", spec.mad_scale)
    if spec.standardize == "zscore":
        out = out.withColumn("factor_value", frames.zscore(F.col("factor_value")))
    if spec.universe != "default":
        out = out.withColumn("factor_value", F.when(F.coalesce(f"is_{spec.universe}", F.lit(False)), F.col("factor_value")))
    valid = F.col("factor_value").isNotNull()
    return out.select(*KEYS, "factor_value", valid.alias("factor_valid"), F.when(~valid, "MISSING_INPUT_OR_LOOKBACK").alias("invalid_reason"), *([F.col(spec.group_field).alias("group_code")] if grouped else []))


def prefix_differences(panel: DataFrame, spec: Factor, cutoffs: list, tolerance: float = 1e-10) -> DataFrame:
    """Rows where the factor, computed on history up to a cutoff alone, differs from the full one: none, if it never reads the future."""
    full = compute(panel, spec).select(*KEYS, F.col("factor_value").alias("full_value"))
    out = None
    for cutoff in cutoffs:
        short = compute(panel.filter(F.col("trade_date") <= cutoff), spec).select(*KEYS, "factor_value").join(full, list(KEYS)).withColumn("cutoff", F.lit(cutoff))
        out = short if out is None else out.unionByName(short)
    both = F.col("factor_value").isNotNull() & F.col("full_value").isNotNull()
    return out.filter((F.col("factor_value").isNull() != F.col("full_value").isNull()) | (both & (F.abs(F.col("factor_value") - F.col("full_value")) > tolerance)))
