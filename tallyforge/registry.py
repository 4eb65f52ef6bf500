"""Named operators with their argument schemas, for callers that address operators by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from .operators import (
    codestats, compaction, complexity, config, coverage, debt, decisions, deps, experience, gitstats, i18n, imports, knowledge,
    logs, match, memory, mutate, profile, prompts, quality, scan, secrets, sessions, specdiff,
)

MODULES: tuple[ModuleType, ...] = (
    codestats, compaction, complexity, config, coverage, debt, decisions, deps, experience, gitstats, i18n, imports, knowledge,
    logs, match, memory, mutate, profile, prompts, quality, scan, secrets, sessions, specdiff,
)


@dataclass(frozen=True)
class Op:
    name: str
    fn: Callable[..., DataFrame]
    description: str
    arguments: dict[str, str]
    required: tuple[str, ...]

    def __call__(self, **args) -> DataFrame:
        unknown = set(args) - set(self.arguments)
        missing = [a for a in self.required if a not in args]
        if unknown or missing:
            raise TypeError(f"{self.name}: unknown {sorted(unknown)}, missing {missing}")
        return self.fn(**args)


def _op(fn: Callable[..., DataFrame]) -> Op:
    params = inspect.signature(fn).parameters.values()
    return Op(
        fn.__name__, fn, inspect.getdoc(fn) or "", {p.name: str(p.annotation) for p in params},
        tuple(p.name for p in params if p.default is inspect.Parameter.empty))


def _collect() -> dict[str, Op]:
    found: dict[str, Op] = {}
    for module in MODULES:
        for name, fn in inspect.getmembers(module, inspect.isfunction):
            first = next(iter(inspect.signature(fn).parameters.values()), None)
            public = fn.__module__ == module.__name__ and not name.startswith("_")
            if public and first is not None and first.annotation == "DataFrame":
                found[name] = _op(fn)
    return found


OPS: dict[str, Op] = _collect()


def run(name: str, **args) -> DataFrame:
    """Call an operator by name with checked arguments."""
    return OPS[name](**args)


def as_view(name: str, view: str, **args) -> DataFrame:
    """Run an operator and expose its result to SQL under ``view``."""
    df = run(name, **args)
    df.createOrReplaceTempView(view)
    return df


def register_sql(spark: SparkSession) -> None:
    """Expose function discovery to SQL: ``SELECT * FROM functions_of('<code>')``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="name string, line int, complexity int, params int, n_lines int")
    class FunctionsOf:
        def eval(self, code: str):
            yield from complexity.functions_of(code or "")

    spark.udtf.register("functions_of", FunctionsOf)
