"""Operators by name, and pipelines of them: a list of steps becomes one lazy lineage.

A step names an operator, its input tables, its output tables and parameters. The graph and the
declared contracts are checked before Spark is asked for anything; then every step is applied to
DataFrames, so Catalyst sees the whole pipeline at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .contracts import Table, compatible


@dataclass(frozen=True)
class Operator:
    name: str
    apply: Callable[..., dict[str, DataFrame] | DataFrame]
    inputs: dict[str, Table]
    outputs: dict[str, Table]
    description: str = ""
    tags: tuple[str, ...] = ()
    version: str = "1"


@dataclass(frozen=True)
class Step:
    """``inputs`` and ``outputs`` map an operator's slots to names of tables."""

    operator: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    params: dict = field(default_factory=dict)


class ContractError(ValueError):
    pass


class Registry:
    def __init__(self):
        self.operators: dict[str, Operator] = {}

    def operator(self, name: str, inputs: dict[str, Table], outputs: dict[str, Table], description: str = "", tags: tuple[str, ...] = (), version: str = "1"):
        """Register a function f(inputs by slot, **params) under a qualified name."""

        def add(f):
            if name in self.operators:
                raise ValueError(f"operator {name} is registered already")
            self.operators[name] = Operator(name, f, inputs, outputs, description or (f.__doc__ or "").strip(), tags, version)
            return f

        return add

    def get(self, name: str) -> Operator:
        if name not in self.operators:
            raise KeyError(f"no operator {name!r}")
        return self.operators[name]

    def find(self, tag: str | None = None, takes: str | None = None, gives: str | None = None) -> list[Operator]:
        """Operators by tag, or by a column that they take or give."""
        has = lambda slots, c: c is None or any(c in t.columns for t in slots.values())
        return [o for _, o in sorted(self.operators.items()) if (tag is None or tag in o.tags) and has(o.inputs, takes) and has(o.outputs, gives)]

    def describe(self, name: str) -> dict:
        o = self.get(name)
        slots = lambda s: {n: {c: k.kind for c, k in t.columns.items()} for n, t in s.items()}
        return {"name": o.name, "description": o.description, "version": o.version, "tags": list(o.tags), "inputs": slots(o.inputs), "outputs": slots(o.outputs)}


class Built(dict):
    """Tables by name. Those that several steps share are kept until ``release``, which the end of a ``with`` block calls, too."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)
        self.shared: list[DataFrame] = []

    def kept(self, df: DataFrame) -> DataFrame:
        self.shared.append(df.persist())
        return self.shared[-1]

    def release(self) -> None:
        while self.shared:
            self.shared.pop().unpersist()

    def __enter__(self) -> Built:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Pipeline:
    def __init__(self, registry: Registry, steps: list[Step]):
        self.registry, self.steps = registry, steps

    @classmethod
    def of(cls, registry: Registry, spec: list[dict]) -> Pipeline:
        """From plain data, as in a JSON file."""
        return cls(registry, [Step(s["operator"], s.get("inputs", {}), s.get("outputs", {}), s.get("params", {})) for s in spec])

    def external(self) -> set[str]:
        made = {t for s in self.steps for t in s.outputs.values()}
        return {t for s in self.steps for t in s.inputs.values()} - made

    def levels(self) -> list[list[int]]:
        """Steps by depth: those of one level don't depend on each other."""
        maker = {t: i for i, s in enumerate(self.steps) for t in s.outputs.values()}
        left, done, out = set(range(len(self.steps))), set(), []
        while left:
            ready = sorted(i for i in left if all(maker[t] in done for t in self.steps[i].inputs.values() if t in maker))
            if not ready:
                raise ContractError(f"steps {sorted(left)} depend on each other in a circle")
            out.append(ready)
            done |= set(ready)
            left -= set(ready)
        return out

    def check(self) -> list[str]:
        """Everything that is wrong with the graph and the declarations; nothing runs."""
        out, given = [], {}
        for t, n in Counter(t for s in self.steps for t in s.outputs.values()).items():
            if n > 1:
                out.append(f"table {t} is made by {n} steps")
        for i, s in enumerate(self.steps):
            if s.operator not in self.registry.operators:
                out.append(f"step {i}: no operator {s.operator!r}")
                continue
            o = self.registry.get(s.operator)
            out += [f"step {i}: input {n} is missing" for n in o.inputs if n not in s.inputs]
            out += [f"step {i}: output {n} is missing" for n in o.outputs if n not in s.outputs]
            out += [f"step {i}: {o.name} has no slot {n}" for n in [*(set(s.inputs) - set(o.inputs)), *(set(s.outputs) - set(o.outputs))]]
            given |= {t: o.outputs[n] for n, t in s.outputs.items() if n in o.outputs}
        for i, s in enumerate(self.steps):
            if s.operator in self.registry.operators:
                o = self.registry.get(s.operator)
                out += [f"step {i}: {t}: {why}" for n, t in s.inputs.items() if n in o.inputs and t in given for why in compatible(given[t], o.inputs[n])]
        try:
            self.levels()
        except ContractError as e:
            out.append(str(e))
        return out

    def build(self, tables: dict[str, DataFrame], check_values: bool = False) -> Built:
        """All tables of the pipeline, lazily. Schemas are checked at each step; values only if asked for, since that runs jobs.

        Tables that several steps take are kept in memory until the result is released.
        """
        if wrong := self.check() + [f"table {t} is not given" for t in sorted(self.external() - set(tables))]:
            raise ContractError("; ".join(wrong))
        tables = Built(tables)
        uses = Counter(t for s in self.steps for t in s.inputs.values())
        for level in self.levels():
            for i in level:
                s, o = self.steps[i], self.registry.get(self.steps[i].operator)
                inputs = {n: tables[t] for n, t in s.inputs.items()}
                for n, df in inputs.items():
                    self._require(f"step {i}, input {n}", o.inputs[n], df, check_values)
                made = o.apply(inputs, **s.params)
                made = made if isinstance(made, dict) else {next(iter(o.outputs)): made}
                for n, t in s.outputs.items():
                    self._require(f"step {i}, output {n}", o.outputs[n], made[n], check_values)
                    tables[t] = tables.kept(made[n]) if uses[t] > 1 else made[n]
        return tables

    @staticmethod
    def _require(where: str, table: Table, df: DataFrame, values: bool) -> None:
        wrong = table.check_schema(df.schema) or (table.check_rows(df) if values else [])
        if wrong:
            raise ContractError(f"{where}: {'; '.join(wrong)}")
