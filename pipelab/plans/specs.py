"""Declarative pipeline specs: what to prepare, what to train."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame

from pipelab.operators import features as fe
from pipelab.operators.columns import column_kinds

# Candidates a search may draw from.
CANDIDATE_MODELS = ["logistic", "random_forest", "gbt"]
CANDIDATE_NUMERIC_FILLS = ["median", "mean"]
CANDIDATE_CATEGORICAL_FILLS = ["constant", "mode"]
CANDIDATE_ENCODERS = ["one_hot", "label"]


@dataclass(frozen=True)
class PipelineSpec:
    """One pipeline, as data. Extra features are built before missing values are filled."""

    name: str
    model: str = "random_forest"
    params: dict[str, Any] = field(default_factory=dict)
    numeric_fill: str = "median"
    categorical_fill: str = "constant"
    encode: str = "one_hot"
    scale: bool = True
    interactions: tuple[tuple[str, str], ...] = ()
    logs: tuple[str, ...] = ()
    polynomial_degree: int = 1
    titles: tuple[str, ...] = ()
    summed: tuple[str, ...] = ()
    use: tuple[str, ...] = ()
    tune_trials: int = 0
    max_levels: int = fe.MAX_LEVELS

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass
class Prepared:
    """Fitted preparation: applies to any frame with the raw columns."""

    spec: PipelineSpec
    target: str
    id_cols: list[str]
    steps: list[fe.Step]
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return fe.transform(add_features(df, self.spec, self.target, self.id_cols), self.steps)


def add_features(df: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str]) -> DataFrame:
    """Stateless features of a spec, and the choice of columns."""
    kinds = column_kinds(df.drop(*id_cols), target)
    if spec.use:
        fixed = [c for c in df.columns if c == target or c in id_cols]
        df = df.select(*fixed, *[f"`{c}`" for c in spec.use if c in kinds])
        kinds = {c: k for c, k in kinds.items() if c in spec.use}
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    for c in spec.titles:
        df = fe.extract_title(df, c, out=f"{c}_title")
    if spec.summed:
        df = fe.sum_columns(df, list(spec.summed))
    for a, b in spec.interactions:
        df = fe.interaction(df, a, b)
    if spec.logs:
        df = fe.log_transform(df, list(spec.logs))
    if spec.polynomial_degree > 1:
        df = fe.polynomial(df, numeric, spec.polynomial_degree)
    return df


def prepare(df: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str]) -> Prepared:
    """Fit the preparation of a spec on ``df``."""
    rows = add_features(df, spec, target, id_cols)
    kinds = column_kinds(rows.drop(*id_cols), target)
    steps = fe.fit_preprocess(
        rows,
        [c for c, k in kinds.items() if k == "numeric"],
        [c for c, k in kinds.items() if k == "categorical"],
        spec.numeric_fill, spec.categorical_fill, spec.encode, spec.scale, spec.max_levels,
    )
    done = fe.transform(rows, steps)
    names = [f.name for f in done.drop(*id_cols).schema.fields
             if f.name != target and (isinstance(f.dataType, VectorUDT) or f.name in column_kinds(done, target))]
    return Prepared(spec, target, id_cols, steps, names)


def mutate(spec: PipelineSpec, rng: random.Random, name: str, numeric: list[str]) -> PipelineSpec:
    """A child of a spec: one of its choices drawn anew."""
    choices = ["model", "numeric_fill", "categorical_fill", "encode", "scale"]
    if len(numeric) > 1:
        choices.append("interactions")
    what = rng.choice(choices)
    if what == "model":
        other = [m for m in CANDIDATE_MODELS if m != spec.model]
        return replace(spec, name=name, model=rng.choice(other), params={})
    if what == "scale":
        return replace(spec, name=name, scale=not spec.scale)
    if what == "interactions":
        pair = tuple(sorted(rng.sample(numeric, 2)))
        return replace(spec, name=name, interactions=tuple(sorted(set(spec.interactions) | {pair})))
    pool = {
        "numeric_fill": CANDIDATE_NUMERIC_FILLS, "categorical_fill": CANDIDATE_CATEGORICAL_FILLS, "encode": CANDIDATE_ENCODERS,
    }[what]
    return replace(spec, name=name, **{what: rng.choice([v for v in pool if v != getattr(spec, what)])})
