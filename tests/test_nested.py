import json

from evalloom.operators import nested as N

ARRAYS = {"c.m.a": "a", "c.m.a.g": "g"}


def rows(spark, *bodies):
    return spark.createDataFrame([(i, b, "extra") for i, b in enumerate(bodies)], "seq long, body string, tag string")


def shred(spark, *bodies):
    t = N.shred_json(rows(spark, *bodies), "seq", "body", ARRAYS, ("c",), root="r")
    return sorted((x.tag, x.parent_seq, x.parent_pos, x.pos, json.loads(x.payload)) for x in t.collect() if x.tag != "r")


def test_places_gaps_and_single_objects(spark):
    body = json.dumps({"c": {"m": {"a": [None, {"id": 1, "g": {"w": 2}}, 5, {"id": 3, "g": [None, {"w": 4}]}]}}})
    assert shred(spark, body) == [("a", 0, "", "1", {"id": 1}), ("a", 0, "", "3", {"id": 3}), ("g", 0, "1", "1.0", {"w": 2}), ("g", 0, "3", "3.1", {"w": 4})]


def test_dotted_text_and_nested_forms_are_the_same(spark):
    plain = {"c": {"m": {"a": [{"id": 1}], "x": 7}}}
    dotted = {"c": {"m.a": [{"id": 1}], "m.x": 7}}
    forms = [plain, dotted, {"c": json.dumps(plain["c"])}, {"c": json.dumps(dotted["c"])}]
    assert [x[4] for x in shred(spark, *map(json.dumps, forms))] == [{"id": 1}] * 4
    assert all(N.parsed(json.dumps(f), ("c",)) == plain for f in forms)


def test_invalid_null_and_empty_lines_give_nothing(spark):
    assert shred(spark, None, "", "{", "[1]", '{"c": NaN}', '{"c": "{bad"}', '{"c": null}') == []
    assert shred(spark) == []


def test_typed_column(spark):
    df = spark.createDataFrame([(1, [None, ("b", "v")]), (2, None), (3, [])], "seq long, e array<struct<backend:string,verdict:string>>")
    t = N.exploded(df, "seq", "e").select("parent_seq", "pos", "e.*")
    assert [tuple(r) for r in t.collect()] == [(1, "1", "b", "v")]


def test_write_and_read_by_tag(spark, tmp_path):
    body = json.dumps({"c": {"m": {"a": [{"id": 1, "g": [{"w": 2.5}]}]}}})
    N.write_tagged(N.shred_json(rows(spark, body), "seq", "body", ARRAYS, ("c",), root="r"), str(tmp_path / "t"))
    assert [(r.pos, r.w) for r in N.read_tagged(spark, str(tmp_path / "t"), "g", "w double").collect()] == [("0.0", 2.5)]
    assert [(r.parent_seq, r.id) for r in N.read_tagged(spark, str(tmp_path / "t"), "a", "id long").collect()] == [(0, 1)]
    assert N.read_tagged(spark, str(tmp_path / "t"), "none", "id long").count() == 0


def test_strict_fields_are_strings_only(spark):
    bodies = [json.dumps({"p.q": v, "o": 'say "p.q": "x"'}) for v in ("m", 5, True, None, ["m"])]
    t = N.apply_schema(N.shred_json(rows(spark, *bodies), "seq", "body", {}, (), root="r"), "`p.q` string", strict=("p.q",))
    assert sorted((r.parent_seq, r["p.q"]) for r in t.collect()) == [(0, "m"), (1, None), (2, None), (3, None), (4, None)]
