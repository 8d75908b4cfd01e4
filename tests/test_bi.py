import re

import pytest

from ledgerloom.errors import AnalysisError
from ledgerloom.lang.program import Program
from ledgerloom.plans import bi

TEXT = '''
source voyages = csv("v.csv") { identity voyage  schema { fuel: decimal(12,2) } }
source harbours = csv("h.csv") { identity code }
export voyages to "out/voyages.parquet"
export harbours to "out/harbours.parquet"
model fleet {
    table voyages { description: "A crossing in each row" }
    table harbours
    relationship voyages.sailed_from -> harbours.code
    relationship voyages.bound_for -> harbours.code
    dimension coast = harbours.coast_name { description: "The side of the strait" }
    metric burn { value: sum(voyages.fuel) / count() format: currency }
    %s
}
'''


def test_model(spark, tmp_path):
    (tmp_path / "v.csv").write_text("voyage,sailed_from,bound_for,fuel,toll\n1,1,1,2.50,3.25\n")
    (tmp_path / "h.csv").write_text("code,coast_name\n1,east\n")
    p = Program.from_text(spark, TEXT % "", str(tmp_path))
    (top,) = bi.compile_models(p, str(tmp_path), "/data")
    voyages = open(f"{top}/definition/tables/voyages.tmdl").read()
    assert "measure burn = DIVIDE(SUM('voyages'[fuel]), COUNTROWS('voyages'))" in voyages and "isHidden" in voyages
    # the model's fixed decimal has 14 digits before the point: a declared decimal(12,2) fits, an inferred decimal(18,2) is a double
    kinds = dict(re.findall(r"column (\w+)\n\s+dataType: (\w+)", voyages))
    assert kinds["fuel"] == "decimal" and kinds["toll"] == "double" and kinds["voyage"] == "int64"
    assert "column coast" in open(f"{top}/definition/tables/harbours.tmdl").read()
    rel = open(f"{top}/definition/relationships.tmdl").read()
    assert rel.count("relationship ") == 2 and rel.count("isActive: false") == 1
    for bad, code in (("metric x { value: missing(voyages.fuel) }", "L604"), ("metric fuel { value: sum(voyages.fuel) }", "L603")):
        with pytest.raises(AnalysisError, match=code):
            bi.compile_models(Program.from_text(spark, TEXT % bad, str(tmp_path)), str(tmp_path))
