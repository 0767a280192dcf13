import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import cells, link, merge
from cohortlake.operators.link import LinkSide
from cohortlake.operators.match import match_confounders


@pytest.fixture(scope="module")
def sides(table):
    left = table([("a", 1, 10), ("a", 1, 11), ("b", 2, 12), (None, 1, 13), ("c", 3, 14)], "k1 string, k2 int, a int")
    one = table([("a", 1, 20), ("a", 1, 21), ("b", 2, 22), (None, 1, 23)], "k1 string, k2 int, b int")
    two = table([("a", 1, 30), ("a", 1, 31), ("a", 1, 32), ("c", 3, 33)], "k1 string, k2 int, c int")
    return left, one, two


@pytest.mark.parametrize("link_fn", [link.link_multi, link.link_sorted])
def test_link_is_a_product_of_the_matches(sides, link_fn):
    left, one, two = sides
    out = link_fn(left, ["k1", "k2"], [LinkSide(one, ["k1", "k2"]), LinkSide(two, ["k1", "k2"], name="set.two")])
    assert out.columns == ["k1", "k2", "a", "b", "set_two-c"]
    got = sorted(((r["a"], r["b"], r["set_two-c"]) for r in out.collect()), key=str)
    want = [(a, b, c) for a in (10, 11) for b in (20, 21) for c in (30, 31, 32)] + [(12, 22, None), (13, None, None), (14, None, 33)]
    assert got == sorted(want, key=str)


def test_a_large_product_is_dealt_to_many_tasks(table, monkeypatch):
    monkeypatch.setattr(link, "PIECE_ROWS", 100, raising=False)
    monkeypatch.setattr(link, "TASK_ROWS", 500, raising=False)
    left = table([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "k int, v string")
    one = table([(1, i // 2) for i in range(60)] + [(2, 7), (None, 8)] + [(4, i) for i in range(150)], "k int, b int")  # equal rows too
    two = table([(1, i) for i in range(40)] + [(2, i) for i in range(3)], "k long, c int")
    three = table([("1", "x"), ("4", "y")], "k string, d string")
    out = link.link_multi(left, ["k"], [LinkSide(one, ["k"]), LinkSide(two, ["k"]), LinkSide(three, ["k"])])
    assert out.columns == ["k", "v", "b", "c", "d"]
    want = 2 * [(1, "a", i // 2, j, "x") for i in range(60) for j in range(40)] + [(2, "b", 7, j, None) for j in range(3)]
    want += [(4, "d", i, None, "y") for i in range(150)] + [(3, "c", None, None, None), (None, "e", None, None, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert per_task < 2400  # before, all 4800 rows of key 1 came from one task


def test_blocks_of_a_large_product_are_unpacked_last_and_sent_once(table, monkeypatch):
    monkeypatch.setattr(link, "PIECE_ROWS", 100)
    monkeypatch.setattr(link, "TASK_ROWS", 500)
    left = table([(1, "a"), (2, "b"), (3, None), (3, "c"), (None, "d")], "k int, v string")
    one = table([(1, i if i % 3 else None) for i in range(90)] + [(3, 5)], "k int, b int")  # nulls in the only kept column
    two = table([(1, i, str(i)) for i in range(50)] + [(2, 1, "x")], "k int, c int, d string")
    none = table([(1,), (1,), (3,)], "k int")  # no kept column
    three = table([(3, i) for i in range(300)], "k int, e int")
    sides = [LinkSide(one, ["k"]), LinkSide(two, ["k"]), LinkSide(none, ["k"]), LinkSide(three, ["k"])]
    out = link.link_multi(left, ["k"], sides)
    assert out.columns == ["k", "v", "b", "c", "d", "e"]
    top, large = out._jdf.queryExecution().executedPlan().toString().split("Union", 1)
    want = 2 * [(1, "a", i if i % 3 else None, j, str(j), None) for i in range(90) for j in range(50)] + [(2, "b", None, 1, "x", None)]
    want += [(3, v, 5, None, None, i) for v in (None, "c") for i in range(300)] + [(None, "d", None, None, None, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert top.count("Generate explode") == 1  # before, a task held all rows of a piece at once, as nothing was unpacked after the union
    pieces = [x for x in large.splitlines() if "Exchange" in x and "__c0" in x and "__c4" in x]
    assert len(pieces) == 5 and all("REPARTITION_BY_NUM" in x for x in pieces)  # a table's blocks go through one shuffle to the pieces


def test_keys_equal_as_values_or_texts_only_keep_their_rows(table, monkeypatch):
    monkeypatch.setattr(link, "PIECE_ROWS", 100)
    left = table([(0.0, 1), (-0.0, 2)], "k double, a int")
    one = table([(0.0, i) for i in range(30)], "k double, b int")
    two = table([("0.0", i) for i in range(20)], "k string, c int")  # large for 0.0 only
    out = link.link_multi(left, ["k"], [LinkSide(one, ["k"]), LinkSide(two, ["k"])])
    got = sorted((r["a"], r["b"], r["c"]) for r in out.na.fill(-1).collect())
    assert got == sorted([(1, b, c) for b in range(30) for c in range(20)] + [(2, b, -1) for b in range(30)])


def test_link_checks(sides):
    left, one, _ = sides
    with pytest.raises(ValueError, match="both sides"):
        link.link_multi(left, ["k1"], [LinkSide(one, ["k1"])])  # k2 is on both sides
    with pytest.raises(TypeError):
        link.link_sorted(left, ["k1"], [LinkSide(one, ["k2"], ["b"])])
    out = link.link_two(left, one.withColumn("k2", F.col("k2").cast("string")), [("k2", "k2")], ["a"], ["b"])
    assert out.where("a = 12").first()["b"] == 22  # keys of different types are compared as text


def test_self_link(table):
    df = table([(1, "Day One", 5, 0), (1, "two", 6, 1), (None, "two", 7, 2), (1, "two", 8, 3), (1, "two", None, 4)], "k int, label string, x int, o int")
    out = link.self_link(df, ["k"], "label", link.distinct_labels(df, "label"), "o")
    got = {(r["day_one_x"], r["two_x"], r["two_k"]) for r in out.collect()}
    assert got == {(5, 8, 1), (None, 7, None)}


def test_compare_and_key_difference(table):
    a = table([(1, 1.0, "x"), (2, None, "y"), (3, 3.0, None)], "id int, a double, b string")
    b = table([(1, 1.0, "z"), (2, 5.0, "y"), (4, 3.0, None)], "id int, a double, b string")
    got = {r[0]: r[1] for r in link.compare_datasets(a, b, "id").collect()}
    assert got == {"a": 1, "b": 1, "only in first": 1, "only in second": 1}
    assert {tuple(r) for r in link.key_difference(a, b, "id", "id").collect()} == {(3, "second"), (4, "first")}


def test_update_from_lookup_needs_a_source_row(table):
    df, ids = table([(1, "a"), (2, "b")], "id int, v string"), table([(1, 9)], "id int, via int")
    ok = link.update_from_lookup(df, "id", ids, table([(9, "new")], "k int, v string"), "k", ["v"])
    assert sorted(tuple(r) for r in ok.collect()) == [(1, "new"), (2, "b")]
    with pytest.raises(Exception, match="no source row"):
        link.update_from_lookup(df, "id", ids, table([(8, "new")], "k int, v string"), "k", ["v"]).collect()


def test_merge_of_different_types_fails(table):
    a, b = table([(1,)], "x int"), table([("1",)], "x string")
    with pytest.raises(TypeError):
        merge.merge_fully([a, b])
    both = merge.merge_fully([a, table([(2.5,)], "y double")], add_source=True)
    assert {tuple(r) for r in both.collect()} == {(1, None, 0), (None, 2.5, 1)}


def test_duplicates(table):
    df = table([(1, "a", None, 3), (1, "a", None, 1), (1, "b", 2.0, 2), (None, "a", 1.0, 4), (None, "a", 1.0, 5)], "k int, s string, v double, o int")
    assert sorted((r["k"] or 0, r["o"]) for r in merge.remove_duplicates(df, ["k"], "o").collect()) == [(0, 4), (1, 1)]
    assert [tuple(r) for r in merge.duplicates_identical(df, ["k"], ["o"]).collect()] == [(1, 3, 2)]
    one = {r["k"]: tuple(r)[1:] for r in merge.coalesce_rows(df, ["k"], "o").collect()}
    assert one == {1: ("a", 2.0, 3), None: ("a", 1.0, 5)}


def test_fill_single_value(table):
    df = table([(1, "a", 1), (1, None, 1), (2, "a", 1), (2, "b", 1), (None, "z", 1), (None, None, 1)], "k int, v string, w int")
    got = sorted((r["k"] or 0, r["v"]) for r in merge.fill_single_value_distinct(df, "k", ["v"]).collect())
    assert got == [(0, "z"), (1, "a"), (2, "a"), (2, "b")]


def test_upsert(table):
    old, new = table([(1, "a"), (2, "b")], "k int, v string"), table([(2, "n"), (3, "m")], "k int, v string")
    assert sorted(map(tuple, merge.upsert_by_key(old, new, "k").collect())) == [(1, "a"), (2, "n"), (3, "m")]
    assert sorted(map(tuple, merge.upsert_by_key(old, new, "k", False).collect())) == [(1, "a"), (2, "b"), (3, "m")]


def test_cell_edits(table):
    df = table([(0, "a.b", None)], "n int, s string, z double")
    assert cells.replace_zero_with_null(df, "n").first()["n"] is None
    assert cells.replace_null_with_number(df, "z", 4).first()["z"] == 4.0
    cut = table([("12.34567",), (".34567",), ("1234567",)], "s string")
    assert [r[0] for r in cells.trim_fraction(cut, "s").collect()] == ["12.345", ".34567", "1234567"]
    with pytest.raises(ValueError):
        cells.drop_fields(df, ["n"], ["s"])
    with pytest.raises(ValueError):
        cells.rename_fields(df, [("nope", "x")])
    assert cells.rename_fields(df, [("nope", "x")], strict=False).first()["x"] is None
    with pytest.raises(Exception, match="unknown value"):
        cells.derive_recode(df, "n", {5: "x"}, [], ["z"], "code", "flag").collect()


def fits(case, other, span, tolerance):
    if case[2] != other[2] or (case[3] is None) != (other[3] is None) or (case[4] is None) != (other[4] is None):
        return False
    d = sum(((a - b) / w) ** 2 for a, b, w in zip(case[3:5], other[3:5], span) if a is not None and w)
    return math.sqrt(d) < tolerance


def test_a_dense_cell_without_a_group_is_left_before_pairing(table, monkeypatch):
    from cohortlake.operators import match

    sizes = {}
    settle = match.settle

    def counted(df, label):
        out = settle(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(match, "settle", counted)
    rows = [(k, "case" if k % 2 else "c1", 0.5 + k / 1e6) for k in range(600)] + [(1000, "c2", 0.0), (1001, "case", 1.0)]
    df = table(rows, "id int, g string, x double")
    assert match_confounders(df, "id", "g", {"case": 1, "c1": 1, "c2": 1}, ["x"], 0.1).count() == 0
    assert sizes["looks"] == [0] and sizes["held"] == [0]


def test_a_dense_cell_pairs_a_bounded_number_of_rows_a_round(table, monkeypatch):
    from cohortlake.operators import match

    sizes = []
    settle = match.settle

    def counted(df, label):
        out = settle(df, label)
        if label == "held":
            sizes.append(out.where("id is not null").count())
        return out

    monkeypatch.setattr(match, "settle", counted)
    monkeypatch.setattr(match, "REFINEMENTS", ())  # all work is left to the neighbours
    rows = [(k, "case" if k < 60 else "c1", 0.5 + (k % 60) / 1e4) for k in range(360)] + [(1000, "case", 0.0), (1001, "case", 1.0)]
    df = table(rows, "id int, g string, x double")
    out = match_confounders(df, "id", "g", {"case": 1, "c1": 2}, ["x"], 0.1, slots=5).collect()
    assert len(out) == 180 and len({r["id"] for r in out}) == 180
    assert max(sizes) <= 60 * 5  # all fit with all, 18,000 pairs




@pytest.mark.parametrize("seed, tolerance, slots", [(1, 0.05, 64), (2, 0.3, 2), (3, math.inf, 64), (4, 0.1, 3)])
def test_matching_is_valid_and_complete(table, seed, tolerance, slots):
    rnd = random.Random(seed)
    rows = []
    for k in range(240):
        age = rnd.choice([None, rnd.uniform(20, 80), 50.0])
        rows.append((k, rnd.choice(["case", "c1", "c1", "c1", "c2"]), rnd.choice(["m", "f", None]), age, rnd.choice([1.0, rnd.uniform(1, 3)])))
    df = table(rows, "id long, g string, sex string, age double, bmi double")
    ratios = {"case": 1, "c1": 2, "c2": 1}
    out = match_confounders(df, "id", "g", ratios, ["sex", "age", "bmi"], tolerance, max_rows=30, slots=slots).collect()
    at = {r[0]: r for r in rows}
    span = [max(r[i] for r in rows if r[i] is not None) - min(r[i] for r in rows if r[i] is not None) for i in (3, 4)]
    served = {}
    for r in out:
        served.setdefault(r["matched_case"], []).append(r["id"])
    assert served and len({r["id"] for r in out}) == len(out)
    for case, ids in served.items():
        groups = [at[i][1] for i in ids]
        assert sorted(groups) == ["c1", "c1", "c2", "case"] and case in ids
        assert all(fits(at[case], at[i], span, tolerance) for i in ids if i != case)
    used = {r["id"] for r in out}
    free = [r for r in rows if r[0] not in used]
    for case in (r for r in free if r[1] == "case"):
        left = {g: sum(1 for r in free if r[1] == g and fits(case, r, span, tolerance)) for g in ("c1", "c2")}
        assert left["c1"] < 2 or left["c2"] < 1


def test_matching_with_an_empty_group_or_constant(table):
    df = table([(1, "a", 5.0), (2, "b", 5.0)], "id long, g string, x double")
    assert match_confounders(df, "id", "g", {"a": 1, "b": 1, "none": 1}, ["x"], 0.1).collect() == []
    assert len(match_confounders(df, "id", "g", {"a": 1, "b": 1}, ["x"], 0.1).collect()) == 2
