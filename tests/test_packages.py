"""Designators line by line, drawing codes, and broken JSON."""

import json

from evidentia.functions import json as J
from evidentia.operators import packages

CASES = {
    "Offered as 16-Lead TSSOP for all": [("16-Lead TSSOP", "TSSOP", 16)],
    "a 16-Lead TSSOP to go": [],  # read as a TO package that is qualified by a family, and refused
    "8 PINS To be soldered": [],
    "64 Ld EP-TQFP and 8-Pin Ceramic SOIC": [("64 Ld EP-TQFP", "TQFP", 64), ("8-Pin Ceramic SOIC", "SOIC", 8)],
    "SOIC (8), CMTI(1), SON (6)": [("SOIC (8)", "SOIC", 8), ("SON (6)", "SON", 6)],
    "SOT-23 and Flat-16P": [("SOT-23", "SOT", None), ("Flat-16P", "FLAT", 16)],
    "SOIC2 is a footnote, LQFP100 is not": [("LQFP100", "LQFP", 100)],
    "176 CQFP of 500 SOIC, 55 BGA": [("176 CQFP", "CQFP", 176)],
    "DO0 DO1 DO15 and SOT23": [("SOT23", "SOT", None)],
    "SO48, later Ceramic SO48": [("Ceramic SO48", "SO", 48)],
    "HTSSOP-28": [("HTSSOP-28", "HTSSOP", 28)],
    "": [],
}


def test_variants_over_rows(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)] + [(99, None)], "id long, body string")
    found = {}
    for r in packages.package_variants(rows, "id", "body").orderBy("id", "nth").collect():
        found.setdefault(r.id, []).append((r.designator, r.family, r.leads))
    assert found == {k: v for k, v in enumerate(CASES.values()) if v}


def test_json_is_closed_not_completed():
    assert J.closed('{"a": {"v": 1}, "b": {"v": 4.9') == '{"a": {"v": 1}}'
    assert J.closed('{"a": [1, {"x": "}"}, {"y') == '{"a": [1, {"x": "}"}]}'
    assert J.closed('{"a": 1') is None and J.closed("}") is None and J.closed('{"a": {}}') is None
    assert J.object_in('Sure: {"a": "q\\"}"} ok') == '{"a":"q\\"}"}'
    assert J.object_in("none") is None and J.object_in(None) is None and J.object_in("{bad") is None
    whole = json.dumps({"a": {"value": 1, "page": 2}, "b": [{"c": 3}]})
    for cut in range(len(whole)):
        found = J.object_in(whole[:cut])
        assert found is None or all(json.loads(whole)[k] == v or isinstance(v, list) for k, v in json.loads(found).items())
