import datetime as dt
import json

from evalloom.operators import drift as D

SCHEMA = "seq long, table_name string, run_id string, file_name string, line_no int, written_at timestamp, body string, path string"


def logs(spark, *files):
    rows = []
    for n, (run, name, lines) in enumerate(files):
        for k, line in enumerate(lines):
            rows.append((len(rows), "t", run, name, k, dt.datetime(2026, 1, 1 + n), line if line is None or isinstance(line, str) else json.dumps(line), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, *files, **kw):
    return {(r.file_name, r.change_kind, r.field_path, r.new_path) for r in D.changes(logs(spark, *files), **kw).collect()}


def test_each_kind_of_change(spark):
    one = [{"cycle": 1, "a": 1, "b": "x", "gone": 1, "old": 0.5}, {"cycle": 2, "a": 2, "b": "y", "gone": 2, "old": 0.75}]
    two = [{"cycle": 2, "a": "2", "b": "y", "new": {"d": 1}, "fresh": 0.75}, {"cycle": 3, "a": "2", "b": "y", "fresh": 9}]
    assert changes(spark, ("r", "f1", one), ("r", "f2", two)) == {("f2", "retyped", "a", ""), ("f2", "renamed", "old", "fresh"), ("f2", "removed", "gone", ""), ("f2", "added", "new.d", "")}


def test_rename_needs_every_common_cycle_and_equal_types(spark):
    assert ("g", "renamed", "o", "n") not in changes(spark, ("r", "f", [{"cycle": 1, "o": 1}, {"cycle": 2, "o": 2}]), ("r", "g", [{"cycle": 1, "n": 1}, {"cycle": 2, "n": 3}]))
    assert ("g", "renamed", "o", "n") not in changes(spark, ("r", "f", [{"cycle": 1, "o": 1}]), ("r", "g", [{"cycle": 1, "n": "1"}]))
    assert ("g", "renamed", "o", "n") not in changes(spark, ("r", "f", [{"cycle": 1, "o": 1}]), ("r", "g", [{"cycle": 2, "n": 1}]))
    assert ("g", "renamed", "o", "n") in changes(spark, ("r", "f", [{"cycle": 1, "o": 1}, {"cycle": 2}]), ("r", "g", [{"cycle": 1, "n": 1.0}, {"cycle": 2, "n": None}]))


def test_order_bad_lines_repeats_and_other_runs(spark):
    f = ("r", "z", [{"cycle": 1, "a": 1}, "{broken", None, "", {"cycle": 1, "a": 1}])
    g = ("r", "y", [{"cycle": 1, "a": 1}])
    assert changes(spark, f, g, ("other", "q", [{"cycle": 1, "b": 2}])) == set()


def test_left_out_and_dotted_config(spark):
    a = [{"cycle": 1, "c": {"m.adapters": [1], "m.x": 1}}]
    b = [{"cycle": 1, "c": json.dumps({"m": {"x": 1}})}]
    assert changes(spark, ("r", "f", a), ("r", "g", b), snapshots=("c",), left_out=("c.m.adapters",)) == set()


def test_empty_and_union_schema(spark):
    assert changes(spark) == set()
    t = logs(spark, ("r", "f", [{"a": 1, "b": True}]), ("r", "g", [{"a": "x", "b": False}]))
    assert {(r.field_path, r.field_type, r.n_files) for r in D.union_schema(t).collect()} == {("a", "string", 2), ("b", "boolean", 2)}


def test_every_field_is_typed_however_few_files_have_it(spark, monkeypatch):
    from evalloom.plans import general

    many = [("r", f"f{n}", [{"cycle": n, "a": n, "ok": True}]) for n in range(8)]
    late = ("r", "late", [{"cycle": 9, "a": "9", "Ok": False, "renamed": {"x": 0.5}, "l": [1, "b", None, {"c": 1}]}, "{broken", None])
    monkeypatch.setattr(general, "_logs", lambda *_: logs(spark, *many, late))
    table = general.p5_table(spark, "")
    rows = {(r.file_name, r.line_no): r for r in table.collect()}
    assert len(rows) == 9 and table.columns == general.p5_table(spark, "").columns
    assert table.columns[:5] == list(D.KEYS) and table.columns[5:] == sorted(table.columns[5:])
    late, early = rows["late", 0].asDict(), rows["f3", 0].asDict()
    assert {k: v for k, v in late.items() if v is not None and k not in D.KEYS} == {"cycle": 9.0, "renamed.x": 0.5, "Ok": False, "a": "9", "l": ["1", "b", None, '{"c": 1}']}
    assert {k: v for k, v in early.items() if v is not None and k not in D.KEYS} == {"cycle": 3.0, "ok#2": True, "a": "3"}


def test_renamed_fields_share_one_name_unless_a_file_has_both(spark):
    a = [{"cycle": 1, "old": 1, "x": 5}, {"cycle": 2, "old": 2, "x": 6}]
    b = [{"cycle": 2, "new": 2, "y": 6}, {"cycle": 3, "new": "3", "y": 7}]
    c = [{"cycle": 4, "x": 1, "y": 2}]
    t = logs(spark, ("r", "f", a), ("r", "g", b), ("s", "h", c))
    schema = D.consistent_schema(t)
    assert schema["old"] == schema["new"] == ("new", "string") and schema["x"] == ("x", "number") and schema["y"] == ("y", "number")
    rows = sorted((r.file_name, r.line_no, r.new) for r in D.typed(t, schema).collect())
    assert rows == [("f", 0, "1"), ("f", 1, "2"), ("g", 0, "2"), ("g", 1, "3"), ("h", 0, None)]
