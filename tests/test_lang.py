import datetime

import pytest

from ledgerloom.__main__ import main
from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.lang import syntax
from ledgerloom.lang.format import formatted
from ledgerloom.lang.program import Program

PROGRAM = '''
# lines of two shops
source lines = csv("lines.csv") { identity [shop, no]  schema { shop: string, no: int, day: date("%d.%m.%Y"), kind: string?, amount: decimal(10,2)? } }
source rates = csv("rates.csv") { identity day }
mapping kinds { ["A", "a"] => "first"  otherwise => original }
dataset clean = lines
    |> filter amount is not null and amount > 0
    |> derive { net = amount * 0.8  month = month(day) }
    |> normalize kind with kinds
    |> asof left join rates as r on lines.day >= r.day
dataset totals = clean |> group by shop |> aggregate { n = count()  total = sum(amount) share = sum(amount) / count() } |> sort total desc
dataset top = totals |> limit 1
dataset steps = clean |> window partition by shop order by no { so_far = running_sum(amount)  before = lag(amount) } |> select shop, no, so_far, before
dataset both = totals |> join top as t on shop |> select shop, totals.n, t.total
validate clean { require shop not null  expect unique(shop, no) warn sum(amount) < 1 as "small" }
reconcile rec = clean as s with lines as l {
    block by shop
    tier same { require s.amount == l.amount and s.no == l.no }
}
export totals to "out/totals.csv"
export to "out/all.xlsx" { sheet "T" = totals  sheet "S" = steps }
test shops { given rates = "rates.csv"  expect totals == "want.csv"  expect lines.rejects is empty }
'''


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "lines.csv").write_text("shop,no,day,kind,amount\nx,1,01.02.2024,A,10.00\nx,2,03.02.2024,b,5.50\ny,1,04.02.2024,,7\ny,2,05.02.2024,a,\n")
    (tmp_path / "rates.csv").write_text("day,rate\n2024-02-02,2\n2024-02-04,3\n")
    (tmp_path / "want.csv").write_text("shop,total\nx,15.50\ny,7.00\n")
    (tmp_path / "p.txt").write_text(PROGRAM)
    return tmp_path


def test_program(spark, folder):
    p = Program.from_file(spark, str(folder / "p.txt"))
    clean = {(r.shop, r.no): r for r in p.relation("clean").df.collect()}
    assert clean["x", 1].kind == "first" and clean["x", 2].kind == "b" and str(clean["x", 1].net) == "8.000"
    assert [clean[k].rate for k in (("x", 1), ("x", 2), ("y", 1))] == [None, 2, 3]
    assert [tuple(r)[:3] for r in p.relation("TOP").df.collect()] == [("x", 2, clean["x", 1].amount + clean["x", 2].amount)]
    assert {(r.shop, r.no): r.before for r in p.relation("steps").df.collect()}["x", 1] is None
    assert p.relation("both").df.columns == ["shop", "n", "total"]
    assert p.relation("rec.matches").df.count() == 3 and p.relation("clean.checks").df.count() == 3
    assert p.run()["warn"] == ["clean: small"]
    assert (folder / "out/totals.csv").read_text() == "shop,n,total,share\nx,2,15.50,7.75\ny,1,7.00,7.0\n"
    assert p.test("shops") == []
    assert p.trace("totals", "total")[0] == "totals.total"


def test_trace_follows_every_step_to_its_input(spark, folder):
    text = """
    source lines = csv("rates.csv")
    dataset a = lines |> derive { twice = rate * 2  more = twice + month(day) } |> select twice, more, since = day, rate
    dataset b = a |> filter rate > 0 |> window order by rate { before = lag(more) }
    dataset c = b |> group by since |> aggregate { total = sum(before)  n = count() }
    """
    p = Program.from_text(spark, text, str(folder))
    assert p.trace("c", "total") == ["c.total", "  b.before", "    a.more", "      lines.rate", "      lines.day"]
    assert p.trace("c", "since") == ["c.since", "  b.since", "    a.since", "      lines.day"]
    assert p.trace("c", "n") == ["c.n"] and p.trace("b", "Twice") == ["b.Twice", "  a.twice", "    lines.rate"]
    p = Program.from_file(spark, str(folder / "p.txt"))
    assert p.trace("both", "n")[:2] == ["both.n", "  totals.n"] and p.trace("both", "total")[:3] == ["both.total", "  top.total", "    totals.total"]
    assert p.trace("both", "shop")[:2] == ["both.shop", "  totals.shop"] and "rates.rate" in [x.strip() for x in p.trace("clean", "rate")]


def test_command_line(spark, folder, capsys):
    f = str(folder / "p.txt")
    assert main(["test", f], spark) == 0 and main(["show", f, "totals"], spark) == 0
    assert "x | 2 | 15.50" in capsys.readouterr().out
    assert main(["snapshot", f, "totals", "--out", str(folder / "s1")], spark) == 0
    assert main(["diff", str(folder / "s1"), str(folder / "s1")], spark) == 0
    (folder / "bad.txt").write_text("dataset x = nope")
    assert main(["check", str(folder / "bad.txt")], spark) == 1


def test_rollups_and_subsets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,org,amt\n1,o,300\n2,p,50\n")
    (tmp_path / "b.csv").write_text("id,org,amt\n1,o,100\n2,o,200\n3,p,20\n4,p,30\n5,o,999\n")
    text = '''
    source a = csv("a.csv") { identity id }
    source b = csv("b.csv") { identity id }
    reconcile up = a with b { tier t { one a to many b  block by org  group b by org  require a.amt == sum(b.amt)  evidence { lines = count(b.id) } } }
    reconcile sub = a with b { block by org  tier t { subset b max_items 3  require sum(b.amt) == a.amt  rank by count(b.id) } }
    '''
    p = Program.from_text(spark, text, str(tmp_path))
    assert sorted((r.a_id, r.b_id) for r in p.relation("up.matches").df.collect()) == [(2, 3), (2, 4)]
    assert sorted((r.a_id, r.b_id) for r in p.relation("sub.matches").df.collect()) == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_errors(spark, tmp_path):
    make = lambda t: Program.from_text(spark, t, str(tmp_path))
    with pytest.raises(AnalysisError, match="L001"):
        syntax.parse("dataset x = y |> filter a == b == c")
    with pytest.raises(AnalysisError, match="L006"):
        make("dataset x = y\ndataset y = x").relation("x")
    with pytest.raises(AnalysisError, match="L003"):
        make('source x = csv("a")\ndataset x = y')
    (tmp_path / "i.csv").write_text("id\n1\n1\n")
    with pytest.raises(RunError, match="L211"):
        make('source i = csv("i.csv") { identity id }').relation("i")
    p = make('source i = csv("i.csv")\ndataset d = i |> derive { t = today() y = case { id > 0 => "p" otherwise => "n" } z = -id + 2 * 3 }')
    r = make('source i = csv("i.csv")\ndataset d = i |> derive { u = concat(id, "x") } |> filter id > "1"')
    with pytest.raises(AnalysisError, match="L102"):
        r.relation("d")
    row = Program.from_text(spark, 'source i = csv("i.csv")\ndataset d = i |> distinct |> derive { t = today() z = -id + 2 * 3 }', str(tmp_path), datetime.date(2026, 7, 1)).relation("d").df.first()
    assert (row.t, row.z) == (datetime.date(2026, 7, 1), 5) and p.relation("d").df.count() == 2


def test_types_are_checked_before_a_run(spark, tmp_path, capsys):
    (tmp_path / "i.csv").write_text("id,name\n1,x\n")
    make = lambda t: Program.from_text(spark, 'source i = csv("i.csv")\ndataset d = i |> ' + t, str(tmp_path)).relation("d")
    for bad in ("derive { x = upper(id) }", "derive { x = length(2.5) }", "filter name", "derive { x = year(name) }", 'derive { x = if(name, 1, 2) }', "filter id + 1"):
        with pytest.raises(AnalysisError, match="L102"):
            make(bad)
    assert make("derive { x = length(name)  y = upper(null) } |> filter id > 0 and name is not null").df.count() == 1
    (tmp_path / "p.txt").write_text('source i = csv("i.csv")\ndataset d = i |> derive { x = spark.no_such_function(id) }')
    assert main(["show", str(tmp_path / "p.txt"), "d"], spark) == 1
    assert "L900" in capsys.readouterr().err


def test_charts_and_files_are_written_all_or_none(spark, tmp_path):
    (tmp_path / "i.csv").write_text("id,n\n1,5\n1,6\n")
    text = 'source i = csv("i.csv")\nchart c = i { kind: bar x: id y: n }\nexport i to "out/i.csv"\nexport c to "out/c.svg"'
    with pytest.raises(RunError, match="L509"):
        Program.from_text(spark, text, str(tmp_path)).run()
    assert not list((tmp_path / "out").iterdir())
    with pytest.raises(AnalysisError, match="L504"):
        Program.from_text(spark, text.replace("c.svg", "i.csv"), str(tmp_path)).run()


def test_formatter_keeps_the_program(tmp_path):
    messy = PROGRAM.replace("    |>", "|>").replace(" = ", "=").replace("source rates", "\n\n\nsource   rates")
    for text in (PROGRAM, messy, 'dataset x = native_sql { query: """select 1,\n   2   as b""" }  # end'):
        once = formatted(text)
        assert formatted(once) == once and [t.text for t in syntax.tokens(once)] == [t.text for t in syntax.tokens(text)]
    assert "    |> filter amount is not null and amount > 0" in formatted(messy) and "\n\n\n" not in formatted(messy)
    (tmp_path / "a.txt").write_text(messy)
    (tmp_path / "b.txt").write_text("dataset = = x")
    assert main(["fmt", str(tmp_path / "a.txt")]) == 0 and (tmp_path / "a.txt").read_text() == formatted(messy)
    assert main(["fmt", str(tmp_path / "b.txt")]) == 1 and (tmp_path / "b.txt").read_text() == "dataset = = x"


def test_notes(spark, tmp_path, capsys):
    (tmp_path / "i.csv").write_text("k,f,m\na,1.5e0,1.234\nb,2e0,2\n")
    text = """
    runtime { threads: 4  memory_limit: "1GB" }
    source i = csv("i.csv") { schema { f: float, m: decimal(10,2) } }
    source j = csv("i.csv")
    dataset s = i |> aggregate { total = sum(f)  exact = sum(m) }
    dataset x = i |> join j as j on i.m > 1.0
    reconcile r = i as i with j as j { block by k  tier t { } }
    validate i { warn count() > 10 as "many"  require k not null }
    """
    (tmp_path / "p.txt").write_text(text)
    p = Program.from_file(spark, str(tmp_path / "p.txt"))
    for name in ("s", "x", "r.matches"):
        p.relation(name)
    p.run()
    assert {n[:4] for n in p.notes} == {"L121", "L122", "L209", "L306", "L404", "L901"}
    assert main(["show", str(tmp_path / "p.txt"), "s"], spark) == 0 and "warning L122" in capsys.readouterr().err
    with pytest.raises(AnalysisError, match="L103"):
        Program.from_text(spark, text.replace("count() > 10", "count() > m"), str(tmp_path)).run()


def test_failures_cite_rows_of_the_file(spark, tmp_path):
    (tmp_path / "i.csv").write_text("k,n\na,1\nb,-2\nc,-3\n")
    p = Program.from_text(spark, 'source i = csv("i.csv")\nvalidate i { expect n > 0 as "positive" }', str(tmp_path))
    assert sorted((r.check, r.source_row, r.k) for r in p.relation("i.failures").df.collect()) == [("positive", 2, "b"), ("positive", 3, "c")]


def test_shapes_agree_with_groups(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,org,amt\n1,o,300\n")
    text = 'source a = csv("a.csv") { identity id }\nreconcile r = a as x with a as y { tier t { %s block by org  group y by org  require x.amt == sum(y.amt) } }'
    assert Program.from_text(spark, text % "one x to many y", str(tmp_path)).relation("r.matches").df.count() == 1
    for bad in ("many x to one y", "one x to one y"):
        with pytest.raises(AnalysisError, match="L308"):
            Program.from_text(spark, text % bad, str(tmp_path)).relation("r.matches")


def test_subset_conditions_ranks_and_evidence(spark, tmp_path):
    """Of the combinations that add up, those of one day and two lines at least pass; the one with the largest line is best."""
    (tmp_path / "a.csv").write_text("id,amt,day\n1,100,5\n2,60,6\n")
    (tmp_path / "b.csv").write_text("id,amt,day\n1,100,5\n2,70,5\n3,30,5\n4,50,5\n5,45,5\n6,5,5\n7,30,6\n8,30,6\n9,60,7\n")
    text = """
    source a = csv("a.csv") { identity id }
    source b = csv("b.csv") { identity id }
    reconcile r = a with b { tier t {
        one a to many b
        subset b max_items 3
        require sum(b.amt) == a.amt
        require min(b.day) == max(b.day) and max(b.day) == a.day and count(b.id) > 1
        rank by max(b.amt) desc
        evidence { lines = count(b.id)  largest = max(b.amt) }
    } }
    """
    got = Program.from_text(spark, text, str(tmp_path)).relation("r.matches").df.collect()
    assert sorted((r.a_id, r.b_id, r.lines, r.largest) for r in got) == [(1, 2, 2, 70), (1, 3, 2, 70), (2, 7, 2, 30), (2, 8, 2, 30)]
    assert {r.a_id: r.candidates_a for r in got} == {1: 2, 2: 1}
    tied = Program.from_text(spark, text.replace("rank by max(b.amt) desc", ""), str(tmp_path))
    assert {(r.a_id) for r in tied.relation("r.matches").df.collect()} == {2} and {r.a_id for r in tied.relation("r.ambiguous").df.collect()} == {1}
    with pytest.raises(AnalysisError, match="L314"):
        Program.from_text(spark, text.replace("rank by max(b.amt) desc", "rank by b.amt"), str(tmp_path)).relation("r.matches")


def test_native_sql_leaves_no_views(spark, tmp_path):
    (tmp_path / "i.csv").write_text("k,n\na,1\nb,2\n")
    spark.range(3).createOrReplaceTempView("i")
    p = Program.from_text(spark, 'source i = csv("i.csv")\nsource j = csv("i.csv")\ndataset d = native_sql { inputs: [i, j]  query: "select i.k, j.n from i join j on i.k = j.k" }', str(tmp_path))
    assert sorted(map(tuple, p.relation("d").df.collect())) == [("a", 1), ("b", 2)]
    assert spark.table("i").columns == ["id"] and "j" not in {t.name for t in spark.catalog.listTables()}
    spark.catalog.dropTempView("i")
