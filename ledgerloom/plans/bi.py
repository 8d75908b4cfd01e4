"""BI models: a program's model statement as a semantic-model folder with tables, relationships and DAX measures."""

from __future__ import annotations

import os
import re
import shutil

from pyspark.sql import types as T

from ledgerloom.errors import AnalysisError

_AGGREGATES = {"sum": "SUM", "mean": "AVERAGE", "avg": "AVERAGE", "min": "MIN", "max": "MAX", "count": "COUNTA", "count_distinct": "DISTINCTCOUNTNOBLANK"}
_FORMATS = {"currency": "#,0.00", "percent": "0.00%", "integer": "#,0", "decimal": "#,0.00"}


def column_type(t: T.DataType) -> str:
    """The model's type; decimals that its fixed decimal cannot hold are doubles."""
    if isinstance(t, T.DecimalType):
        return "decimal" if t.scale <= 4 and t.precision - t.scale <= 14 else "double"
    names = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "double", T.FloatType: "double", T.DateType: "dateTime", T.TimestampNTZType: "dateTime", T.TimestampType: "dateTime"}
    if isinstance(t, T.IntegralType):
        return "int64"
    if type(t) not in names:
        raise AnalysisError("L606", f"a model has no {t.simpleString()} columns")
    return names[type(t)]


def quoted(name: str) -> str:
    return name if re.fullmatch(r"\w+", name) else "'" + name.replace("'", "''") + "'"


def active(relationships: list[tuple[str, str]]) -> list[bool]:
    """Whether each relationship, in order, is active: at most one filter path joins two tables."""
    reach: dict[str, set[str]] = {}
    out = []
    for a, b in relationships:
        x, y = (r.split(".")[0].lower() for r in (a, b))
        gx, gy = reach.setdefault(x, {x}), reach.setdefault(y, {y})
        out.append(gx is not gy)
        if gx is not gy:
            gx |= gy
            for t in gy:
                reach[t] = gx
    return out


class Model:
    def __init__(self, program, statement):
        self.p, self.s, self.d = program, statement, statement.data
        self.tables = {t: program.relation(t) for t, _ in self.d["tables"]}
        self.labels = {ref.lower(): label for label, ref, _ in self.d["dimensions"]}
        names = [n.lower() for n, _ in self.d["metrics"]] + [c.lower() for r in self.tables.values() for c in r.columns]
        for n, _ in self.d["metrics"]:
            if names.count(n.lower()) > 1:
                raise AnalysisError("L603", f"metric {n} has the name of a column or metric")

    def column(self, ref: str) -> str:
        table, _, name = ref.rpartition(".")
        t = next((t for t in self.tables if t.lower() == table.lower()), None)
        if t is None:
            raise AnalysisError("L602", f"{table} is no table of the model")
        return f"'{t}'[{self.labels.get(ref.lower(), self.tables[t].spelled(name))}]"

    def dax(self, e: tuple) -> str:
        """A metric that means the same in both engines; anything else is refused."""
        if e[0] == "lit" and not isinstance(e[1], (str, bool, type(None))):
            return str(e[1])
        if e[0] == "arith" and e[1] in "+-*":
            return f"({self.dax(e[2])} {e[1]} {self.dax(e[3])})"
        if e[0] == "arith" and e[1] == "/":
            return f"DIVIDE({self.dax(e[2])}, {self.dax(e[3])})"
        if e[0] == "neg":
            return f"(-{self.dax(e[1])})"
        if e[0] == "call" and e[1].lower() == "count" and not e[2]:
            return f"COUNTROWS('{self.d['tables'][0][0]}')"
        if e[0] == "call" and e[1].lower() in _AGGREGATES and len(e[2]) == 1 and e[2][0][0] == "col":
            ref, fn = e[2][0][1], e[1].lower()
            table, _, name = ref.rpartition(".")
            if fn in ("min", "max") and any(t.lower() == table.lower() and isinstance(r.type_of(name), T.BooleanType) for t, r in self.tables.items()):
                raise AnalysisError("L604", f"{fn} of a boolean is no measure")
            return f"{_AGGREGATES[fn]}({self.column(ref)})"
        raise AnalysisError("L604", "this expression is no measure")

    def files(self, data_folder: str) -> dict[str, str]:
        exported = {s.data["relation"].lower(): s.name for s in self.p.statements if s.kind == "export" and s.data["relation"] and s.name.endswith(".parquet")}
        out = {"database.tmdl": "database\n\tcompatibilityLevel: 1567\n", "model.tmdl": "model Model\n\tculture: en-US\n" + "".join(f"\nref table {quoted(t)}" for t in self.tables) + "\n"}
        out["expressions.tmdl"] = f'expression DataFolder = "{data_folder}" meta [IsParameterQuery=true, Type="Text"]\n'
        on = active(self.d["relationships"])
        hidden = {a.lower() for a, _ in self.d["relationships"]}
        out["relationships.tmdl"] = "\n".join(
            f"relationship '{a} to {b}'\n" + ("" if live else "\tisActive: false\n") + f"\tfromColumn: {self._ref(a)}\n\ttoColumn: {self._ref(b)}\n" for (a, b), live in zip(self.d["relationships"], on)
        )
        described = {ref.lower(): o.get("description") for _, ref, o in self.d["dimensions"]}
        for i, (t, options) in enumerate(self.d["tables"]):
            if t.lower() not in exported:
                raise AnalysisError("L601", f"{t} is not exported to Parquet")
            lines = [*([f"/// {options['description']}"] if options.get("description") else []), f"table {quoted(t)}", ""]
            if i == 0:
                for name, m in self.d["metrics"]:
                    lines += [*([f"\t/// {m['description']}"] if m.get("description") else []), f"\tmeasure {quoted(name)} = {self.dax(m['value'])}"]
                    lines += [f"\t\tformatString: {_FORMATS.get(m['format'], m['format'])}"] if m.get("format") else []
                    lines.append("")
            r = self.tables[t]
            for f in r.df.schema:
                ref = f"{t}.{f.name}".lower()
                lines += [*([f"\t/// {described[ref]}"] if described.get(ref) else []), f"\tcolumn {quoted(self.labels.get(ref, f.name))}", f"\t\tdataType: {column_type(f.dataType)}", *(["\t\tisHidden"] if ref in hidden else []), f"\t\tsourceColumn: {f.name}", ""]
            file = os.path.basename(exported[t.lower()])
            lines += [f"\tpartition {quoted(t)} = m", "\t\tmode: import", f'\t\tsource = Parquet.Document(File.Contents(DataFolder & "/{file}"))', ""]
            out[f"tables/{t}.tmdl"] = "\n".join(lines)
        return out

    def _ref(self, ref: str) -> str:
        table, _, name = ref.rpartition(".")
        return f"{quoted(table)}.{quoted(self.labels.get(ref.lower(), self.tables[next(t for t in self.tables if t.lower() == table.lower())].spelled(name)))}"

    def write(self, folder: str, data_folder: str | None = None) -> str:
        """``<folder>/<model>.SemanticModel``; its definition is replaced as a whole, other files stay."""
        top = os.path.join(folder, f"{self.s.name}.SemanticModel")
        files = self.files(data_folder or os.path.abspath(folder))
        shutil.rmtree(f"{top}/definition", ignore_errors=True)
        for name, body in files.items():
            path = f"{top}/definition/{name}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(body)
        return top


def compile_models(program, folder: str, data_folder: str | None = None) -> list[str]:
    return [Model(program, s).write(folder, data_folder) for s in program.statements if s.kind == "model"]
