"""Programs: statements are resolved when they are needed, so they may stand in any order; every relation is a lazy plan."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.lang import syntax
from ledgerloom.lang.expressions import Compiler, columns_of, has_aggregate
from ledgerloom.operators import reconcile as Rec
from ledgerloom.operators import steps as P
from ledgerloom.operators import validate as V
from ledgerloom.plans import compare
from ledgerloom.plans.scratch import Scratch
from ledgerloom.relation import Relation
from ledgerloom.sources import contract as K
from ledgerloom.sources import exports as X
from ledgerloom.sources import readers as R


def load(path: str, seen: tuple[str, ...] = (), done: dict | None = None) -> list[syntax.Statement]:
    """The statements of a file and of its imports, each file once; paths are those of the file that names them."""
    path, done = os.path.realpath(path), {} if done is None else done
    if path in seen:
        raise AnalysisError("L004", "imports form a cycle")
    if path in done:
        return []
    done[path] = True
    with open(path, encoding="utf-8") as f:
        statements = syntax.parse(f.read())
    out = []
    for s in statements:
        s.data["dir"] = os.path.dirname(path)
        if s.kind == "import":
            out += load(os.path.join(s.data["dir"], s.data["path"]), (*seen, path), done)
        else:
            out.append(s)
    return out


class Program:
    def __init__(self, spark: SparkSession, statements: list[syntax.Statement], today: datetime.date | None = None):
        self.spark, self.statements, self.today = spark, statements, today
        self.by_name: dict[str, syntax.Statement] = {}
        for s in statements:
            if s.kind in ("source", "dataset", "reconcile", "mapping", "chart", "connection"):
                if s.name.lower() in self.by_name:
                    raise AnalysisError("L003", f"{s.name} is declared twice")
                if "." in s.name:
                    raise AnalysisError("L014", "a declared name has no dot")
                self.by_name[s.name.lower()] = s
        self.mappings = {s.name.lower(): (s.data["arms"], s.data["otherwise"]) for s in statements if s.kind == "mapping"}
        self.relations: dict[str, Relation] = {}
        self.sources: dict[str, tuple[K.Source, list[K.Declared]]] = {}
        self.runs: dict[str, Rec.Run] = {}
        self.notes: list[str] = []
        self._open: list[str] = []
        for s in statements:
            if s.kind == "runtime":
                self._runtime(s.data["options"])

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, today: datetime.date | None = None) -> Program:
        return cls(spark, load(path), today)

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, directory: str = ".", today: datetime.date | None = None) -> Program:
        statements = syntax.parse(text)
        for s in statements:
            s.data["dir"] = directory
        return cls(spark, statements, today)

    def note(self, code: str, text: str) -> None:
        """A warning: the program runs on."""
        if f"{code}: {text}" not in self.notes:
            self.notes.append(f"{code}: {text}")

    def _runtime(self, options: dict) -> None:
        """``threads`` is the width of shuffles; memory and spill folders are the cluster's, fixed before a session starts."""
        unknown = set(options) - {"threads", "memory_limit", "temp_storage"}
        if unknown:
            raise AnalysisError("L001", f"no runtime option {', '.join(sorted(unknown))}")
        if "threads" in options:
            if not isinstance(options["threads"], int) or options["threads"] < 1:
                raise AnalysisError("L001", "threads is a number from 1")
            self.spark.conf.set("spark.sql.shuffle.partitions", options["threads"])
        for name in ("memory_limit", "temp_storage"):
            if name in options:
                self.note("L901", f"{name} is a setting of the cluster and stays as it is")

    # relations

    def relation(self, name: str) -> Relation:
        """A relation or a part of one: ``x``, ``x.rejects``, ``r.matches``, ``v.checks``."""
        key = name.lower()
        if key in self.relations:
            return self.relations[key]
        if key in self._open:
            raise AnalysisError("L006", f"{name} depends on itself")
        self._open.append(key)
        try:
            self.relations[key] = self._build(key, name)
        finally:
            self._open.pop()
        return self.relations[key]

    def _build(self, key: str, name: str) -> Relation:
        s = self.by_name.get(key)
        if s is not None and s.kind == "source":
            return self._source(s).relation
        if s is not None and s.kind == "dataset":
            return self._dataset(s)
        base, _, part = key.rpartition(".")
        if part in ("checks", "failures") and any(v.kind == "validate" and v.name.lower() == base for v in self.statements):
            r, checks = self.checks(base)
            rows = self.sources[base][0].rows if base in self.sources else None
            return Relation(V.results(r, checks) if part == "checks" else V.failures(r, checks, rows), name=name)
        owner = self.by_name.get(base)
        if owner is not None and owner.kind == "source" and part == "rejects":
            return Relation(self._source(owner).rejects, name=name)
        if owner is not None and owner.kind == "reconcile" and part in ("matches", "ambiguous", "unmatched_a", "unmatched_b", "candidates", "summary"):
            return Relation(getattr(self._reconcile(owner), part), name=name)
        raise AnalysisError("L002", f"no relation {name}")

    def names(self) -> list[str]:
        return [s.name for s in self.statements if s.kind in ("source", "dataset")]

    def compiler(self, r: Relation, resolve=None) -> Compiler:
        return Compiler(r.df, resolve or (lambda n: self._column(r, n)), self.mappings, self.today)

    @staticmethod
    def _column(r: Relation, name: str) -> Column:
        if "." in name:
            q, c = name.rsplit(".", 1)
            for candidate in (f"{q}_{c}", c):
                if r.has(candidate):
                    return F.col(f"`{r.spelled(candidate)}`")
        return F.col(f"`{r.spelled(name)}`")

    # sources

    def _path(self, s: syntax.Statement, path: str) -> str:
        return path if "://" in path or os.path.isabs(path) else os.path.join(s.data["dir"], path)

    def _source(self, s: syntax.Statement) -> K.Source:
        key = s.name.lower()
        if key in self.sources:
            return self.sources[key][0]
        o, kind = dict(s.data["options"]), s.data["type"]
        path = self._path(s, s.data["arg"]) if kind != "sql" else s.data["arg"]
        fill = o.get("fill_down", [])
        row = o.get("row_number")
        if (fill or row) and kind not in ("csv", "excel", "fixed_width"):
            raise AnalysisError("L214", f"{kind} sources have no row order")
        at = row or ("_row" if fill or kind in ("excel", "fixed_width") else None)
        types = None
        if kind == "csv":
            at = at or "_row"
            raw = R.csv(self.spark, path, o.get("delimiter"), o.get("header", True), o.get("section"), o.get("ragged", False), at)
        elif kind == "excel":
            raw = R.excel(self.spark, path, o.get("sheet"), o.get("range"), o.get("header_row"), o.get("section"), o.get("header", True), at)
        elif kind == "fixed_width":
            table = R.csv(self.spark, self._path(s, o["layout"]), row_number="_n").orderBy("_n").collect()
            layout = [(x[1], int(x[2]), int(x[3]), x[4]) for x in table]
            raw = R.fixed_width(self.spark, path, layout, o.get("encoding", "utf-8"), o.get("record"), o.get("record_length"), at)
            types = [K.Declared(n, R.LAYOUT_TYPES[c], True) for n, _, _, c in layout]
        elif kind == "parquet":
            raw = R.parquet(self.spark, path)
        elif kind == "duckdb":
            raw = R.database_file(self.spark, path, o.get("query") or f'SELECT * FROM "{o["table"]}"')
        elif kind == "sql":
            c = self.by_name[s.data["arg"].lower()].data["options"]
            raw = R.sql(self.spark, c.get("connection_string") or c.get("dsn"), o["query"], c.get("user"), c.get("password"))
            raw = Scratch(self.spark, "sql").keep(raw)  # a run sees one state of the tables
        else:
            raise AnalysisError("L001", f"no source of kind {kind}")
        if fill:
            missing = [c for c in ([fill] if isinstance(fill, str) else fill) if c.lower() not in {x.lower() for x in raw.columns}]
            if missing:
                raise AnalysisError("L215", f"fill_down names unknown columns: {', '.join(missing)}")
            raw = K.fill_down(raw, [fill] if isinstance(fill, str) else fill, at)
        text = [f.name for f in raw.schema if f.name != at]
        declared = [K.Declared(n, t, null, formats) for n, t, null, formats in o.get("schema", [])]
        if types:
            known = {d.name.lower() for d in declared}
            declared += [d for d in types if d.name.lower() not in known]
        elif kind in ("csv", "excel"):
            known = {d.name.lower() for d in declared}
            rest = raw.select(*[c for c in raw.columns if c != at and c.lower() not in known])
            if rest.columns:
                declared += [K.Declared(c, "string", True) for c in rest.columns] if o.get("all_text") else K.infer(rest)
        else:
            known = {d.name.lower(): d for d in declared}
            declared = [known.get(f.name.lower()) or K.Declared(f.name, _name_of(f.dataType), True) for f in raw.schema]
        order = {c.lower(): i for i, c in enumerate(text)}
        declared.sort(key=lambda d: order.get(d.name.lower(), len(order)))
        got = K.typed(raw, declared, at, tuple(o.get("identity", ())), s.name, keep_row=bool(row))
        self.sources[key] = (got, declared)
        K.enforce(got, declared)
        return got

    # datasets

    def _dataset(self, s: syntax.Statement) -> Relation:
        head, value = s.data["head"]
        if head == "native":
            inputs = {n: self.relation(n) for n in value.get("inputs", [])}
            query = value["query"]
            views = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
            hidden = {n: self.spark.table(n) for n in inputs if n.lower() in views}
            try:
                for n in inputs:
                    inputs[n].df.createOrReplaceTempView(n)
                r = Relation(self.spark.sql(query), name=s.name)  # resolved here, so the names can go
            finally:
                for n in inputs:
                    self.spark.catalog.dropTempView(n)
                for n, df in hidden.items():
                    df.createOrReplaceTempView(n)
        else:
            r = self.relation(value)
        lineage = {c.lower(): (f"{value}.{c}",) if head == "from" else () for c in r.columns}
        group: list[str] = []
        for step in s.data["steps"]:
            if group and step[0] != "aggregate":
                raise AnalysisError("L104", "group by needs an aggregate behind it")
            if step[0] == "group":
                group = step[1]
                continue
            before, r = r, self._step(r, step, group)
            lineage = self._lineage(step, before, r, lineage)
            group = [] if step[0] == "aggregate" else group
        return r.with_(r.df, name=s.name, lineage=lineage)

    def _lineage(self, step: tuple, r: Relation, after: Relation, known: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
        """Of each column after a step (in lower case) the columns of other relations that it is made of; ``known`` is that before it."""
        found, kind = dict(known), step[0]

        def of(e) -> tuple[str, ...]:
            names = [n.lower() for n in columns_of(e)]
            at = [next((n for n in (x, x.replace(".", "_"), x.rsplit(".", 1)[-1]) if n in found), None) for x in names]
            return tuple(dict.fromkeys(i for n in at if n for i in found[n]))

        if kind == "select":
            found = {(n or e[1].rsplit(".", 1)[-1]).lower(): of(e) for n, e in step[1]}
        elif kind == "derive":
            for n, e in step[1]:
                found[n.lower()] = of(e)
        elif kind == "rename":
            new = {a.lower(): b.lower() for a, b in dict(step[1]).items()}
            found = {new.get(c, c): i for c, i in known.items()}
        elif kind in ("aggregate", "window"):
            found |= {n.lower(): of(e) for n, e in step[1 if kind == "aggregate" else 3]}
        elif kind == "union":
            o = self.relation(step[1])
            found = {c: tuple(dict.fromkeys([*i, f"{step[1]}.{o.spelled(c)}"])) if o.has(c) else i for c, i in known.items()}
        elif kind in ("join", "asof"):
            how, other, alias = step[1], step[2], step[3] or self.relation(step[2]).name
            theirs = {c.lower(): (f"{other}.{c}",) for c in self.relation(other).columns}
            for c in theirs:
                if c not in known:
                    found[c] = theirs[c]
                elif after.has(c):  # a merged key
                    found[c] = {"right": theirs[c], "full": (*known[c], *theirs[c])}.get(how, known[c])
                else:
                    found |= {f"{side}_{c}{k}".lower(): i for side, i in ((r.name, known[c]), (alias, theirs[c])) for k in ("", "_2", "_3")}
        return {c.lower(): found.get(c.lower(), ()) for c in after.columns}

    def _step(self, r: Relation, step: tuple, group: list[str]) -> Relation:
        kind = step[0]
        c = self.compiler(r)
        if kind == "select":
            if any(has_aggregate(e) for _, e in step[1]):
                raise AnalysisError("L104", "select has no aggregates")
            names = [(n or e[1].rsplit(".", 1)[-1], e) for n, e in step[1]]
            P._distinct_names([n for n, _ in names])
            df = r.df.select(*[c(e).alias(r.spelled(n) if e[0] == "col" and r.has(n) and n.lower() == e[1].lower() else n) for n, e in names])
            kept = {e[1].lower() for n, e in names if e[0] == "col" and n.lower() == e[1].lower()}
            return r.with_(df, sort=(), identity=r.identity if {i.lower() for i in r.identity} <= kept else ())
        if kind == "drop":
            return P.drop(r, *step[1])
        if kind == "rename":
            return P.rename(r, **dict(step[1]))
        if kind == "derive":
            for name, e in step[1]:
                r = P.derive(r, **{name: self.compiler(r)(e)})
            return r
        if kind == "filter":
            condition = c(step[1])
            if not isinstance(c.type(condition), (T.BooleanType, T.NullType)):
                raise AnalysisError("L102", "a filter is true or false")
            return P.filter_(r, condition)
        if kind == "distinct":
            return P.distinct(r)
        if kind == "sort":
            return P.sort(r, *[f"-{n}" if desc else n for n, desc in step[1]])
        if kind == "limit":
            return P.limit(r, step[1])
        if kind == "union":
            return P.union(r, self.relation(step[1]))
        if kind == "aggregate":
            self._float_sums(c, [e for _, e in step[1]])
            return P.aggregate(r, tuple(group), **{n: c(e) for n, e in step[1]})
        if kind == "window":
            self._float_sums(c, [e for _, e in step[3]])
            made = {}
            for name, e in step[3]:
                if e[0] != "call":
                    raise AnalysisError("L126", "a window column is one function")
                made[name] = (e[1].lower(), *[x[1] if x[0] == "lit" else c(x) for x in e[2]])
            return P.window(r, tuple(step[1]), tuple(f"-{n}" if d else n for n, d in step[2]), **made)
        if kind == "normalize":
            arms, rest = self.mappings[step[2].lower()] if isinstance(step[2], str) else step[2]
            name = r.spelled(step[1])
            return r.with_(r.df.withColumn(name, c.apply_mapping(F.col(f"`{name}`"), arms, rest)), sort=())
        if kind == "join":
            _, how, other, alias, on = step
            o = self.relation(other)
            if isinstance(on, list):
                return P.join(r, o, tuple(on), how, alias or o.name)
            if on == ("lit", True):
                return P.join(r, o, True, how, alias or o.name)
            a = alias or o.name
            if not any(n.rsplit(".", 1)[0].lower() == a.lower() if "." in n else o.has(n) and not r.has(n) for n in columns_of(on)):
                self.note("L121", f"the condition of the join with {a} does not mention it")
            both = r.df.alias(r.name).join(o.df.alias(a), F.lit(True), "cross")
            return P.join(r, o, Compiler(both, lambda n: self._side_column(r, o, a, n), self.mappings, self.today)(on), how, a)
        if kind == "asof":
            _, left, other, alias, on = step
            o = self.relation(other)
            equal, probe = [], None
            for e in _conjuncts(on):
                if e[0] != "cmp" or e[2][0] != "col" or e[3][0] != "col":
                    raise AnalysisError("L127", "an as-of condition compares columns")
                op, x, y = e[1], e[2][1], e[3][1]
                if x.lower().startswith(f"{(alias or o.name).lower()}."):
                    x, y, op = y, x, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
                x, y = x.rsplit(".", 1)[-1], y.rsplit(".", 1)[-1]
                if op == "==":
                    equal.append((x, y))
                elif probe is None and op in (">=", ">", "<=", "<"):
                    probe = (x, op, y)
                else:
                    raise AnalysisError("L127", "an as-of join has exactly one inequality")
            if probe is None:
                raise AnalysisError("L127", "an as-of join has exactly one inequality")
            return P.asof(r, o, tuple(equal), probe, left, alias or o.name)
        raise AnalysisError("L001", f"no step {kind}")

    def _float_sums(self, c: Compiler, expressions: list) -> None:
        """Sums of floats depend on the order of addition, which differs from run to run."""

        def walk(e) -> None:
            if isinstance(e, tuple) and e[:1] == ("call",) and e[1].lower() in ("sum", "mean", "avg", "running_sum") and len(e[2]) == 1:
                if isinstance(c.type(c(e[2][0])), (T.DoubleType, T.FloatType)):
                    self.note("L122", f"{e[1].lower()} adds floats, so its last digits can differ; use decimals")
            for x in e if isinstance(e, (tuple, list)) else ():
                walk(x)

        walk(list(expressions))

    @staticmethod
    def _side_column(r: Relation, o: Relation, alias: str, name: str) -> Column:
        if "." in name:
            q, c = name.rsplit(".", 1)
            side = (o, alias) if q.lower() == alias.lower() else (r, r.name)
            if side[0].has(c):
                return F.col(f"`{side[1]}`.`{side[0].spelled(c)}`")
            return F.col(f"`{r.name}`.`{r.spelled(f'{q}_{c}')}`")
        if r.has(name) and o.has(name):
            raise AnalysisError("L005", f"{name} is on both sides")
        return F.col(f"`{r.name}`.`{r.spelled(name)}`") if r.has(name) else F.col(f"`{alias}`.`{o.spelled(name)}`")

    # validation

    def checks(self, name: str) -> tuple[Relation, list[V.Check]]:
        r, out = self.relation(name), []
        c = self.compiler(r)
        for s in (s for s in self.statements if s.kind == "validate" and s.name.lower() == name.lower()):
            for i, (severity, value, label) in enumerate(s.data["checks"], 1):
                label = label or f"{severity} {i}"
                if value[0] == "not_null":
                    if not r.df.schema[r.spelled(value[1])].nullable:
                        self.note("L401", f"{label} of {name} can't fail: {value[1]} is never null")
                    out.append(V.Check(label, severity, "not_null", (r.spelled(value[1]),)))
                elif value[0] == "unique":
                    out.append(V.Check(label, severity, "unique", tuple(map(r.spelled, value[1]))))
                elif has_aggregate(value[1]):
                    e = value[1]
                    if self._bare(e):
                        raise AnalysisError("L103", f"{label} mixes aggregates with columns of single rows")
                    measured = e[2] if e[0] == "cmp" and has_aggregate(e[2]) else e[3] if e[0] == "cmp" else e
                    out.append(V.Check(label, severity, "whole", F.col("m"), c(measured)) if e[0] != "cmp" else self._whole(label, severity, e, measured, c))
                else:
                    out.append(V.Check(label, severity, "row", c(value[1])))
        return r, out

    @classmethod
    def _bare(cls, e) -> bool:
        """Whether a column is read outside of aggregates."""
        if isinstance(e, tuple):
            if e[:1] == ("col",):
                return True
            if e[:1] == ("call",) and has_aggregate((*e[:2], [])):
                return False
        return any(cls._bare(x) for x in e) if isinstance(e, (tuple, list)) else False

    @staticmethod
    def _whole(label, severity, e, measured, c) -> V.Check:
        other = e[3] if measured is e[2] else e[2]
        if has_aggregate(other):
            return V.Check(label, severity, "whole", F.col("m"), c(e))
        x, y = (F.col("m"), c(other)) if measured is e[2] else (c(other), F.col("m"))
        cond = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e[1]]
        return V.Check(label, severity, "whole", cond, c(measured))

    # reconciliation

    def _reconcile(self, s: syntax.Statement) -> Rec.Run:
        key = s.name.lower()
        if key not in self.runs:
            self.runs[key] = _Lowering(self, s).run()
        return self.runs[key]

    # running

    def validated(self) -> list[str]:
        return list(dict.fromkeys(s.name.lower() for s in self.statements if s.kind == "validate"))

    def run(self, keep_going: bool = False, write: bool = True) -> dict:
        """Check every validation, then write all exports or none. Returns failed checks by severity."""
        failed: dict[str, list[str]] = {"require": [], "expect": [], "warn": []}
        for name in self.validated():
            r, checks = self.checks(name)
            for row in V.enforce(r, checks, keep_going):
                if row["status"] == "fail" and row["severity"] == "warn":
                    self.note("L404", f"{name}: {row['check']} failed")
                if row["status"] == "fail":
                    failed[row["severity"]].append(f"{name}: {row['check']}")
        for name, (source, _) in self.sources.items():
            for row in source.rounded.collect():  # a row for each decimal column
                self.note("L209", f"{name}.{row['column']}: {row['rows']} values were rounded to the declared scale")
        if write:
            charts, targets = {}, {}
            for s in (s for s in self.statements if s.kind == "export"):
                path = self._path(s, s.name)
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                rel = s.data["relation"]
                chart = self.by_name.get((rel or "").lower())
                if path in targets:
                    raise AnalysisError("L504", "two exports write the same file")
                if chart is not None and chart.kind == "chart":
                    o = chart.data["options"]
                    unknown = set(o) - {"kind", "x", "y", "series", "title", "width", "height", "total"}
                    if unknown or not {"kind", "x", "y"} <= set(o):
                        raise AnalysisError("L508", f"chart {chart.name} needs kind, x and y" + (f" and has no {', '.join(sorted(unknown))}" if unknown else ""))
                    charts[path] = dict(o)
                    targets[path] = self.relation(chart.data["relation"])
                elif s.data["parts"]:
                    targets[path] = {label: self.relation(n) for label, n in s.data["parts"]}
                else:
                    targets[path] = self.relation(rel)
            for text in X.export(targets, charts):
                self.note("L509", text)
        return failed

    def explain(self, name: str) -> str:
        """Spark's plan of a relation."""
        return self.relation(name).df._jdf.queryExecution().toString()

    def trace(self, name: str, column: str) -> list[str]:
        """The lineage of a column, inputs indented below it."""
        out: list[str] = []

        def walk(rel: str, col: str, depth: int) -> None:
            out.append("  " * depth + f"{rel}.{col}")
            s = self.by_name.get(rel.lower())
            if s is None or s.kind != "dataset" or depth > 50:
                return
            for source in self.relation(rel).lineage.get(col.lower(), ()):
                walk(*source.rsplit(".", 1), depth + 1)

        walk(name, column, 0)
        return out

    def test(self, name: str) -> list[str]:
        """Run a test statement; returns what differs."""
        t = next(s for s in self.statements if s.kind == "test" and s.name == name)
        statements = []
        for s in self.statements:
            if s.kind in ("export", "model", "test"):
                continue
            g = next((v for k, v in t.data["given"].items() if k.lower() == s.name.lower() and s.kind == "source"), None)
            if g is not None:
                data = {**s.data, "dir": t.data["dir"]} | ({"arg": g} if isinstance(g, str) else g)
                s = syntax.Statement("source", s.name, s.line, data)
            statements.append(s)
        day = datetime.date.fromisoformat(t.data["today"]) if t.data["today"] else self.today
        p = Program(self.spark, statements, day)
        out = []
        expected = {rel.lower() for rel, _ in t.data["expect"]}
        for rel, path in t.data["expect"]:
            r = p.relation(rel)
            if path is None:
                out += [] if r.df.isEmpty() else [f"{rel} is not empty"]
                continue
            want = R.csv(self.spark, self._path(t, path), row_number="_n").drop("_n")
            want = want.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(r.spelled(c)) for c in want.columns])
            diff = compare.diff(Relation(want, name=rel), Relation(r.df.select(*want.columns), name=rel)).groupBy("change").agg(F.sum("rows").alias("n")).collect()
            out += [f"{rel}: {x['n']} {'unexpected' if x['change'] == 'added' else 'missing'} rows" for x in diff]
        for v in p.validated():
            if not expected & {f"{v}.checks", f"{v}.failures"}:
                r, checks = p.checks(v)
                out += [f"check {x['check']} on {v} failed" for x in V.enforce(r, checks, True) if x["status"] == "fail" and x["severity"] != "warn"]
        return out


def _conjuncts(e: tuple) -> list[tuple]:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _name_of(t) -> str:
    names = {T.BooleanType: "bool", T.DoubleType: "float", T.FloatType: "float", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp_tz", T.BinaryType: "binary"}
    if isinstance(t, T.IntegralType):
        return "int"
    return f"decimal({t.precision},{t.scale})" if isinstance(t, T.DecimalType) else names.get(type(t), "string")


class _Lowering:
    """A reconcile statement as a policy over ``a.`` and ``b.`` columns."""

    def __init__(self, p: Program, s: syntax.Statement):
        self.p, self.d = p, s.data
        (ra, self.na), (rb, self.nb) = s.data["sides"]
        self.rel = {}
        for side, rel, alias in (("a", ra, self.na), ("b", rb, self.nb)):
            r = p.relation(rel)
            own = next((v for k, v in self.d["identity"].items() if k.lower() == alias.lower()), None)
            self.rel[side] = r.with_(r.df, identity=tuple(own) if own else r.identity)
            if not self.rel[side].identity:
                p.note("L306", f"{alias} has no identity; its rows are numbered by their content")
        self.evidence = {n.lower(): e for n, e in self.d["evidence"]}

    def side(self, qualifier: str) -> str:
        for s, n in (("a", self.na), ("b", self.nb)):
            if qualifier.lower() == n.lower():
                return s
        raise AnalysisError("L002", f"{qualifier} is neither side")

    def frame(self, lifted: dict[str, list[str]]) -> DataFrame:
        a, b = (self.rel[s].df for s in "ab")
        for s, names in lifted.items():
            for n, c in names:
                if s == "a":
                    a = a.withColumn(n, c)
                else:
                    b = b.withColumn(n, c)
        return a.alias("a").crossJoin(b.alias("b"))

    def expand(self, e, names: dict):
        """Names of evidence replaced by their expressions."""
        if isinstance(e, tuple):
            if e[:1] == ("col",) and "." not in e[1] and e[1].lower() in names:
                return self.expand(names[e[1].lower()], {k: v for k, v in names.items() if k != e[1].lower()})
            return tuple(self.expand(x, names) for x in e)
        return [self.expand(x, names) for x in e] if isinstance(e, list) else e

    def resolve(self, name: str) -> Column:
        q, _, c = name.rpartition(".")
        if not q:
            raise AnalysisError("L002", f"{name} needs the name of a side")
        s = self.side(q)
        return F.col(f"{s}.`{self.rel[s].spelled(c)}`") if not c.startswith("__agg") else F.col(f"{s}.{c}")

    def block(self, keys) -> tuple[tuple[str, str], ...]:
        out = []
        for e in keys or []:
            if e[0] == "col":
                out.append((self.rel["a"].spelled(e[1]), self.rel["b"].spelled(e[1])))
            else:
                x, y = (v[1].rsplit(".", 1) for v in e[2:4])
                if self.side(x[0]) == "b":
                    x, y = y, x
                out.append((self.rel["a"].spelled(x[1]), self.rel["b"].spelled(y[1])))
        return tuple(out)

    def lift(self, e, lifted: dict[str, dict]):
        """Aggregates replaced by columns of the groups."""
        if isinstance(e, tuple):
            if e[:1] == ("call",) and has_aggregate((e,)) and e[1].lower() in ("sum", "mean", "avg", "min", "max", "count", "count_distinct", "missing", "any", "all"):
                sides = {self.side(c.rsplit(".", 1)[0]) for c in columns_of(e)}
                if len(sides) != 1:
                    raise AnalysisError("L308", "an aggregate reads one side")
                s = sides.pop()
                key = repr(e)
                lifted[s].setdefault(key, (f"__agg{len(lifted[s])}", e))
                return ("col", f"{self.na if s == 'a' else self.nb}.{lifted[s][key][0]}")
            return tuple(self.lift(x, lifted) for x in e)
        return [self.lift(x, lifted) for x in e] if isinstance(e, list) else e

    def bare(self, e, side: str) -> bool:
        """Whether an expression reads a column of the side outside of aggregates."""
        if isinstance(e, tuple):
            if e[:1] == ("col",):
                return "." in e[1] and self.side(e[1].rsplit(".", 1)[0]) == side
            if e[:1] == ("call",) and has_aggregate((*e[:2], [])):
                return False
        return any(self.bare(x, side) for x in e) if isinstance(e, (tuple, list)) else False

    def check_shape(self, t: dict, groups: dict) -> None:
        """A shape line says what the groups, or the subset, already do."""
        if "shape" not in t:
            return
        n1, x, n2, y = t["shape"]
        said = {self.side(x): n1, self.side(y): n2}
        if len(said) != 2:
            raise AnalysisError("L313" if t["subset"] else "L308", "a shape names both sides")
        several = {*groups, *([self.side(t["subset"]["side"])] if t["subset"] else [])}
        if said != {s: "many" if s in several else "one" for s in "ab"}:
            raise AnalysisError("L313" if t["subset"] else "L308", f"the shape of tier {t['name']} and its groups differ")

    def tier(self, t: dict) -> Rec.Tier:
        own = {n.lower(): e for n, e in t["evidence"]}
        names = self.evidence | own
        groups = {self.side(k): tuple(self.rel[self.side(k)].spelled(x) for x in v) for k, v in t["group"].items()}
        require = [self.expand(e, names) for e in t["require"]]
        rank = [(self.expand(e, names), desc) for e, desc in t["rank"]]
        self.check_shape(t, groups)
        subset = None
        if t["subset"]:
            s = self.side(t["subset"]["side"])
            if s in groups:
                raise AnalysisError("L313", "the subset side isn't grouped")
            parts = [c for e in require for c in _conjuncts(e)]
            sums = [c for c in parts if has_aggregate(c) and c[0] == "cmp" and c[1] == "=="]
            total, target = next(((x, y) for c in sums for x, y in ((c[2], c[3]), (c[3], c[2])) if x[0] == "call" and x[1].lower() == "sum" and self.side(x[2][0][1].rsplit(".", 1)[0]) == s and y[0] == "col"), (None, None))
            if total is None:
                raise AnalysisError("L314", "a subset tier has a condition sum(x) == a column of the unit")
            amount = next(c for c in sums if total in c[2:4] and target in c[2:4])
            of_subset = [c for c in parts if has_aggregate(c) and c is not amount]
            require = [c for c in parts if not has_aggregate(c)]
            mine = lambda e: not self.bare(e, s)
            if not all(map(mine, [*of_subset, *[e for e, _ in rank]])):
                raise AnalysisError("L314", f"a combination's columns of {t['subset']['side']} are read in aggregates")
            fewest = bool(rank) and rank[0][0][0] == "call" and rank[0][0][1].lower() == "count" and not rank[0][1]
            subset_rank, rank = rank[1:] if fewest else rank, []
            subset_evidence = {k: self.expand(e, {n: v for n, v in names.items() if n != k}) for k, e in own.items() if has_aggregate(e)}
            own = {k: e for k, e in own.items() if not has_aggregate(e)}
        lifted: dict[str, dict] = {"a": {}, "b": {}}
        require = [self.lift(e, lifted) for e in require]
        rank = [(self.lift(e, lifted), desc) for e, desc in rank]
        shown = {k: self.lift(self.expand(e, names), lifted) for k, e in ({} if groups else self.evidence).items()} | {k: self.lift(self.expand(e, {n: v for n, v in names.items() if n != k}), lifted) for k, e in own.items()}
        flags = {n: self.lift(self.expand(e, names), lifted) for n, e in [*self.d["flags"], *t["flags"]]} if not groups else {n: self.lift(self.expand(e, names), lifted) for n, e in t["flags"]}
        aggs = {}
        if t["subset"]:
            side = self.side(t["subset"]["side"])
            of_subset, subset_rank = [self.lift(e, lifted) for e in of_subset], [(self.lift(e, lifted), d) for e, d in subset_rank]
            subset_evidence = {k: self.lift(e, lifted) for k, e in subset_evidence.items()}
        for s in "ab":
            c = Compiler(self.rel[s].df, lambda n, s=s: F.col(self.rel[s].spelled(n.rsplit(".", 1)[-1])), self.p.mappings, self.p.today)
            aggs[s] = {name: c(e) for name, e in lifted[s].values()}
        types = {s: [(n, F.lit(None).cast(self.rel[s].df.agg(c.alias("x")).schema[0].dataType)) for n, c in aggs[s].items()] for s in "ab"}
        compile_ = Compiler(self.frame(types), self.resolve, self.p.mappings, self.p.today)
        if t["subset"]:
            m = t["subset"]
            subset = Rec.Subset(
                side, total[2][0][1].rsplit(".", 1)[1], target[1].rsplit(".", 1)[1], m.get("max_items", 8), m.get("max_subsets", 2_000_000), fewest,
                aggs[side], tuple(map(compile_, of_subset)), tuple((compile_(e), d) for e, d in subset_rank), {k: compile_(e) for k, e in subset_evidence.items()},
            )
            aggs[side] = {}
        return Rec.Tier(
            t["name"], tuple(map(compile_, require)), None if t["block"] == "inherit" else self.block(t["block"]), tuple((compile_(e), d) for e, d in rank),
            {k: compile_(e) for k, e in shown.items()}, {k: compile_(e) for k, e in flags.items()}, groups.get("a", ()), groups.get("b", ()), aggs["a"], aggs["b"], subset,
        )

    def run(self) -> Rec.Run:
        policy = Rec.Policy(tuple(self.tier(t) for t in self.d["tiers"]), self.block(self.d["block"]), **self.d["options"])
        return Rec.Run(self.rel["a"], self.rel["b"], policy, (self.na, self.nb)).run()
