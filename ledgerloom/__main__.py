"""python -m ledgerloom run|check|test|show|profile|schema|trace|explain|plan|fmt|compile|snapshot|diff FILE ..."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.errors import PySparkException

from ledgerloom.errors import Diagnostic
from ledgerloom.lang import syntax
from ledgerloom.lang.format import formatted
from ledgerloom.lang.program import Program
from ledgerloom.plans import bi, compare
from ledgerloom.relation import Relation
from ledgerloom.session import session


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("command", choices=["run", "check", "test", "show", "profile", "schema", "trace", "explain", "plan", "fmt", "compile", "snapshot", "diff"])
    p.add_argument("file")
    p.add_argument("names", nargs="*")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--today", type=datetime.date.fromisoformat)
    p.add_argument("--keep-going", action="store_true")
    p.add_argument("--out")
    a = p.parse_args(argv)
    if a.command == "fmt":
        return _format([a.file, *a.names])
    spark = spark or session()
    program = None
    try:
        if a.command == "diff":
            found = {k: v for k, v in compare.diff_snapshots(spark, a.file, a.names[0]).items() if "only_in" in v or v["added"] or v["removed"] or any(v["columns"].values())}
            for name, what in found.items():
                print(name, what)
            return int(bool(found))
        program = Program.from_file(spark, a.file, a.today)
        if a.command == "run":
            failed = program.run(a.keep_going)
            for severity, names in failed.items():
                for n in names:
                    print(f"{severity}: {n}")
            return int(bool(failed["require"] or failed["expect"]))
        if a.command == "check":
            for n in program.names():
                program.relation(n)
            for n in program.validated():
                program.checks(n)
        elif a.command == "test":
            bad = 0
            for t in (s for s in program.statements if s.kind == "test"):
                problems = program.test(t.name)
                print(f"test {t.name} ... {'FAILED' if problems else 'ok'}", *problems, sep="\n  " if problems else "")
                bad += bool(problems)
            return int(bool(bad))
        elif a.command == "show":
            r = program.relation(a.names[0])
            for row in [r.columns, *r.show(a.rows)]:
                print(" | ".join(row))
        elif a.command == "profile":
            for row in compare.profile(program.relation(a.names[0])).collect():
                print(row.asDict())
        elif a.command == "schema":
            for n in a.names or program.names():
                print(n, program.relation(n).df.schema.simpleString())
        elif a.command == "trace":
            print("\n".join(program.trace(*a.names[0].rsplit(".", 1))))
        elif a.command == "explain":
            print(program.explain(a.names[0]))
        elif a.command == "plan":
            for n in a.names or program.names():
                program.relation(n).df.explain("formatted")
        elif a.command == "compile":
            print("\n".join(bi.compile_models(program, a.out or ".")))
        else:
            compare.snapshot(spark, a.out or f"{a.file}.snapshot", {n: program.relation(n) for n in a.names or program.names()}, open(a.file, encoding="utf-8").read())
    except Diagnostic as e:
        print(e, file=sys.stderr)
        return 1
    except PySparkException as e:  # messages of the engine can hold data values, so only the condition is shown
        print(f"L900: {e.getCondition() or type(e).__name__}", file=sys.stderr)
        return 1
    except OSError as e:
        print(e.strerror, file=sys.stderr)
        return 2
    finally:
        for n in program.notes if program else ():
            print(f"warning {n}", file=sys.stderr)
    return 0


def _format(paths: list[str]) -> int:
    """Rewrite files in the common style; a file that doesn't parse stays."""
    bad = 0
    for path in paths:
        with open(path, encoding="utf-8") as f:
            source = f.read()
        try:
            syntax.parse(source)
            new = formatted(source)
        except Diagnostic as e:
            print(f"{path}: {e}", file=sys.stderr)
            bad = 1
            continue
        if new != source:
            with open(path, "w", encoding="utf-8") as f:
                f.write(new)
    return bad


__all__ = ["Relation", "main"]

if __name__ == "__main__":
    sys.exit(main())
