"""Contracts of tables: what an operator needs and gives, checked against schemas before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Which Spark types satisfy a declared kind.
KINDS = {
    "int": {"tinyint", "smallint", "int", "bigint"},
    "float": {"float", "double"},
    "numeric": {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"},
    "string": {"string"},
    "bool": {"boolean"},
    "datetime": {"date", "timestamp", "timestamp_ntz"},
    "array": {"array"},
    "any": None,
}


@dataclass(frozen=True)
class Column:
    kind: str = "any"
    nullable: bool = True
    unique: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple | None = None


@dataclass(frozen=True)
class Table:
    """Required columns by name; other columns are allowed unless ``closed``. ``needs`` lists kinds of which one column at least must be there."""

    columns: dict[str, Column] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    closed: bool = False
    min_rows: int = 0

    def check_schema(self, schema: StructType) -> list[str]:
        have = {f.name: f.dataType.simpleString().split("(")[0].split("<")[0] for f in schema}
        out = [f"column {n} is missing" for n in self.columns if n not in have]
        out += [f"column {n} is {have[n]}, not {c.kind}" for n, c in self.columns.items() if n in have and KINDS[c.kind] is not None and have[n] not in KINDS[c.kind]]
        out += [f"no {k} column" for k in self.needs if not any(KINDS[k] is None or t in KINDS[k] for t in have.values())]
        return out + ([f"column {n} is not declared" for n in have if n not in self.columns] if self.closed else [])

    def check_rows(self, df: DataFrame) -> list[str]:
        """Value constraints, all in one aggregate over the table."""
        tests = {}
        for n, c in self.columns.items():
            if n not in df.columns:
                continue
            v = F.col(n)
            if not c.nullable:
                tests[f"column {n} has nulls"] = F.count(F.when(v.isNull(), 1)) > 0
            if c.unique:
                tests[f"column {n} has repeated values"] = F.count_distinct(v) < F.count(v)
            if c.low is not None:
                tests[f"column {n} has values under {c.low}"] = F.coalesce(F.min(v) < c.low, F.lit(False))
            if c.high is not None:
                tests[f"column {n} has values over {c.high}"] = F.coalesce(F.max(v) > c.high, F.lit(False))
            if c.values is not None:
                tests[f"column {n} has other values"] = F.count(F.when(~v.isin(*c.values), 1)) > 0
        if self.min_rows:
            tests[f"fewer than {self.min_rows} rows"] = F.count("*") < self.min_rows
        if not tests:
            return []
        row = df.agg(*(t.alias(f"t{i}") for i, t in enumerate(tests.values()))).first()
        return [what for i, what in enumerate(tests) if row[i]]


def compatible(gives: Table, takes: Table) -> list[str]:
    """Why a table that meets ``gives`` might not meet ``takes``, from the declarations alone."""
    out = []
    for n, c in takes.columns.items():
        if n not in gives.columns:
            if gives.closed:
                out.append(f"column {n} is not given")
            continue
        have, want = KINDS[gives.columns[n].kind], KINDS[c.kind]
        if want is not None and have is not None and not have <= want:
            out.append(f"column {n} is given as {gives.columns[n].kind}, not {c.kind}")
    return out
