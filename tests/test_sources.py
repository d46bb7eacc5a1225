"""Files, known errors, reports, and table rulings on small cases."""

import json

import pytest

from docaudit.operators import report, tables
from docaudit.sources import extracts

HEAD = "kind string, type string, scope string"
REFS = "refs array<struct<" + ", ".join(f"{f} {k}" for f, k in report.REF_FIELDS.items()) + ">>"
FINDING, KNOWN = f"finding_id string, {HEAD}, severity string, {REFS}", f"known_id string, {HEAD}, {REFS}"


def ref(**fields):
    return tuple(fields.get(f) for f in report.REF_FIELDS)


def test_scan_and_incremental(spark, tmp_path):
    for name in ("a.PDF", "~$a.PDF", ".hidden", "sub/b.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("xx")
    files = extracts.scan_files(spark, str(tmp_path))
    assert sorted((r["name"], r["suffix"], r["size"]) for r in files.collect()) == [("a.PDF", ".pdf", 2), ("b.json", ".json", 2)]
    files = files.selectExpr("*", "array('p') as parsers")
    before = files.selectExpr("path", "size", "modified", "parsers", "case when name = 'a.PDF' then 1 else 0 end as errors", "array(concat(name, '.out')) as outputs")
    present = spark.createDataFrame([("a.PDF.out",), ("b.json.out",)], "path string")
    todo, reused = extracts.incremental(files, before, present)
    assert [r["name"] for r in todo.collect()] == ["a.PDF"] and [r["name"] for r in reused.collect()] == ["b.json"]
    for changed in (before.selectExpr("path", "size", "modified", "array('q') as parsers", "errors", "outputs"), before.selectExpr("path", "size + 1 as size", "modified", "parsers", "errors", "outputs")):
        assert extracts.incremental(files, changed, present)[1].count() == 0
    assert extracts.incremental(files, before, present.limit(1))[1].count() == 0


def test_extracts_by_document(spark, tmp_path):
    (tmp_path / "D 1").mkdir()
    (tmp_path / "D2").mkdir()
    (tmp_path / "D 1" / "specification.json").write_text(json.dumps({"document_metadata": {"designation_in_document": "026.1"}, "items": [{"row": 2, "designators": ["K1", "K2"], "quantity": 1.5}, {"row": 3, "code": "X"}]}))
    (tmp_path / "D2" / "specification.json").write_text("{broken")
    got = extracts.read_extracts(spark, str(tmp_path), "specification").orderBy("ord").collect()
    assert [(r.document, r.ord, r.designation, r.row, r.designators, r.quantity, r.code) for r in got] == [("D 1", 0, "026.1", 2, ["K1", "K2"], 1.5, None), ("D 1", 1, "026.1", 3, None, None, "X")]
    (tmp_path / "D2" / "connections.json").write_text(json.dumps({"connections": [{"id": 1, "kks": "A", "pin": "3"}]}))
    (row,) = extracts.read_extracts(spark, str(tmp_path), "connections").collect()
    assert (row.document, row.table_kind, row.kks, row.pin, row.cabinet) == ("D2", "gost_connections", "A", "3", None)
    (tmp_path / "D2" / "classified.json").write_text(json.dumps([{"page_number": 4, "text_spans": [{"text": "K1", "entity_type": "device_tag", "bbox": [1, 2, 3, 4]}]}]))
    (row,) = extracts.read_extracts(spark, str(tmp_path), "spans").collect()
    assert tuple(row) == ("D2", 4, 0, "K1", "device_tag", 1.0, 2.0, 3.0, 4.0)


def test_known_errors_bare_and_wrapped(spark, tmp_path):
    known = [{"kind": "K", "refs": [{"document": "d", "sheet": 3}]}, {"kind": "L"}]
    for i, content in enumerate((known, {"errors": known})):
        (tmp_path / f"{i}.json").write_text(json.dumps(content))
        rows = extracts.read_known_errors(spark, str(tmp_path / f"{i}.json")).orderBy("known_id").collect()
        assert [(r["known_id"], r["kind"]) for r in rows] == [(0, "K"), (1, "L")] and rows[0]["refs"][0]["sheet"] == 3


def test_no_file_of_known_errors(spark, tmp_path):
    assert extracts.read_known_errors(spark, str(tmp_path / "none.json")).count() == 0


def test_known_needs_every_ref_and_some_ref(spark, tmp_path):
    d, e = ref(document="d", designator="x", sheet=3), ref(document="e", designator="y")
    found = spark.createDataFrame([("1", "K", "t", "s", "low", [d, e]), ("2", "K", "t", "s", "high", [d]), ("3", None, None, None, "info", [])], FINDING)
    known = spark.createDataFrame(
        [("both", "K", None, "", [ref(document="d"), ref(document="e", designator="")]), ("wide", "K", None, None, []), ("none", None, None, None, None), ("other", "K", "u", None, [ref(document="d")]), ("sheet", None, None, None, [ref(document="d", sheet=4)])], KNOWN
    )
    assert sorted(r[0] for r in report.suppress_known(found, known).select("finding_id").collect()) == ["2", "3"]
    assert sorted(r[0] for r in report.unused_known(found, known).select("known_id").collect()) == ["none", "other", "sheet", "wide"]
    extracts.write_report(found, str(tmp_path / "report"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(lines) == 4 and [x for x in lines if x["is"] == "summary"][0]["total"] == 3


def test_places_have_known_fields_alone():
    with pytest.raises(ValueError, match="no fields"):
        report.make_ref(documnet=None)


def test_near_separators_belong_to_the_last_kept(spark):
    lines = [(10.0, 100.0), (12.0, 90.0), (14.0, 90.0), (40.0, 20.0), (60.0, 80.0)]
    rulings = spark.createDataFrame([("d", 1, x, 0.0, x, y) for x, y in lines], "document string, sheet int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["x"] for r in tables.column_separators(rulings).collect()) == [10.0, 14.0, 60.0]
