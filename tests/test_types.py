import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.parsing import FieldType, display, parse
from cohortlake.operators import fieldtypes as ft
from cohortlake.operators.criteria import Condition, filter_dataset, scan, where_all


def inferred(table, values, **options):
    df = table([(v,) for v in values], "v string")
    return ft.infer_types(df, **options)["v"]


@pytest.mark.parametrize(
    "values, kind, is_array",
    [
        ([], "null", False),
        (["", "N/A", None], "null", False),
        ([" 8136", "na", None, "12"], "integer", False),
        ([" 8136", "na", None, "12.1"], "double", False),
        ([" 0", "na", "1", "1"], "boolean", False),
        (["true", "FALSE", ""], "boolean", False),
        (["12.NOV.2012 18:19:20", "2016-08-10 20:45:12", "", " 12.12.2012 10:43", "na"], "date", False),
        (["2014-3-1", "12/31/2014", "11.2012", "2016-08-10 20:45:12.5"], "date", False),
        (['{"a": 1}', '{"b": [1, 2]}', "na"], "json", False),
        (["22,8136", "na", None, "12,"], "integer", True),
        (["1.5,2", "3"], "double", True),
        (["1,0", "true"], "boolean", True),
        (["na,", ",null"], "null", True),
        (["2014-01-01,2015-01-01", "na"], "date", True),
        (["a b c d e f g h".split()[k % 8] + str(k) for k in range(27)], "string", False),
        (["2014-13-01", "2014-01-02"], "string", False),
    ],
)
def test_inference(table, values, kind, is_array):
    t = inferred(table, values)
    assert (t.kind, t.is_array) == (kind, is_array)


def test_enum_inference(table):
    t = inferred(table, ["1", " 1", "1", "null", "Sun "])
    assert (t.kind, t.enum_values) == ("enum", ("1", "Sun"))
    assert inferred(table, ["a", "b"]).kind == "string"  # too few values per label
    assert inferred(table, [f"v{k % 21}" for k in range(100)]).kind == "string"
    assert inferred(table, [f"v{k % 21}" for k in range(100)], max_enum_values=21).kind == "enum"
    many = inferred(table, [f"{'abc'[k % 3]},{'xyz'[k // 3 % 3]},{'uvw'[k // 9 % 3]}" for k in range(200)])
    assert (many.kind, many.is_array, many.enum_values) == ("enum", True, tuple("abcuvwxyz"))


def test_booleans_without_numbers(table):
    assert inferred(table, ["0", "1"], boolean_numbers=False).kind == "integer"


@pytest.mark.parametrize(
    "t, text, value",
    [
        (FieldType("integer"), " -12 ", -12),
        (FieldType("double"), ".2", 0.2),
        (FieldType("boolean", true_label="yes", false_label="no"), "yes", True),
        (FieldType("date"), "12.NOV.2012 18:19:20", dt.datetime(2012, 11, 12, 18, 19, 20)),
        (FieldType("date"), "0", dt.datetime(1970, 1, 1)),
        (FieldType("enum", enum_values=("a", "b")), "b", 1),
        (FieldType("integer", True), "1, na,3", [1, None, 3]),
        (FieldType("string"), "n/a", None),
    ],
)
def test_parse(spark, table, t, text, value):
    assert table([(text,)], "v string").select(parse(F.col("v"), t)).first()[0] == value


@pytest.mark.parametrize(
    "t, value, schema, text",
    [
        (FieldType("double", decimals=1), 2.25, "double", "2.3"),
        (FieldType("boolean", true_label="yes", false_label="no"), False, "boolean", "no"),
        (FieldType("date"), dt.datetime(2020, 5, 6, 7, 8, 9), "timestamp", "2020-05-06 07:08:09"),
        (FieldType("enum", enum_values=("a", "b")), 1, "int", "b"),
        (FieldType("integer", True), [1, None, 3], "array<bigint>", "1,,3"),
    ],
)
def test_display_and_back(table, t, value, schema, text):
    shown = table([(value,)], f"v {schema}").select(display(F.col("v"), t).alias("s"))
    assert shown.first()[0] == text
    if t.decimals is None:
        assert shown.select(parse(F.col("s"), t)).first()[0] == value


def test_strict_parse_raises(table):
    df = table([("x",)], "v string")
    with pytest.raises(Exception, match="not of type integer"):
        ft.retype(df, {"v": FieldType("integer")}).collect()
    assert ft.retype(df, {"v": FieldType("integer")}, strict=False).first()[0] is None
    with pytest.raises(Exception, match="not of type enum"):
        ft.retype(df, {"v": FieldType("enum", enum_values=("a",))}).collect()


def test_translate_drops_empty_columns_and_rows(table):
    df = table([("ja", None), ("nein", ""), (None, "na")], "v string, w string")
    words = table([("ja", "yes"), ("nein", "no")], "from string, to string")
    out = ft.translate(df, ["v"], words, reinfer=False)
    assert out.columns == ["v"] and sorted(r[0] for r in out.collect()) == ["no", "yes"]


def test_unknown_concept_is_an_error(table):
    concepts = table([(1, "one")], "id int, label string")
    ok = ft.concept_enum_map(table([(1,), (None,)], "c int"), "c", concepts, "id", "label")
    assert {(r[0], r[1]) for r in ok.collect()} == {(1, "one"), (None, None)}
    with pytest.raises(Exception, match="unknown concept 2"):
        ft.concept_enum_map(table([(2,)], "c int"), "c", concepts, "id", "label").collect()


def test_conditions_and_missing_values(table):
    df = table([(1, "Abc"), (2, None), (None, "xabc")], "n int, s string")

    def kept(*conditions):
        return sorted((r["n"] or 0) for r in where_all(df, list(conditions)).collect())

    assert kept(Condition("n", "!=", 1)) == [0, 2]
    assert kept(Condition("n", "not in", [1])) == [0, 2]
    assert kept(Condition("n", "in", [1, None])) == [0, 1]
    assert kept(Condition("n", "=", None)) == [0]
    assert kept(Condition("s", "regex", "ABC")) == [0, 1]
    assert kept(Condition("s", "not regex", "^abc")) == [0, 2]
    assert kept(Condition("n", ">=", 1), Condition("n", "<", 2)) == [1]
    assert [r["n"] for r in filter_dataset(df, [Condition("n", "=", " 2 ")], {"n": FieldType("integer")}).collect()] == [2]
    with pytest.raises(ValueError):
        scan(df, skip=1)
    with pytest.raises(ValueError):
        where_all(df, [Condition("zz", "=", 1)])
