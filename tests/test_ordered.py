import random

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.series import extract_peaks, process_series, scale_series, trim_series
from cohortlake.operators import link, ordered
from cohortlake.operators.scan import cut_hot_groups, global_index, positions

SMALL = 25  # a group above 25 rows is cut into ranges


@pytest.fixture(scope="module")
def events(table):
    rnd = random.Random(2)
    rows, n = [], 0
    for user, size in [("hot", 300), ("warm", 60), ("cold", 5), (None, 40)]:
        at = 0
        for _ in range(size):
            at += rnd.choice([0, 1, 1, 2, 30])
            rows.append((user, at, n, rnd.choice([None, None, float(n)])))
            n += 1
    rnd.shuffle(rows)
    return rows, table(rows, "user string, at long, id long, v double")


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_positions(events, limit):
    rows, df = events
    got = {r["id"]: r["p"] for r in positions(df, ["user"], ["at", "id"], "p", limit).collect()}
    assert got == {r[2]: k for rs in by_user(rows).values() for k, r in enumerate(rs)}


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_fill_from_previous(events, limit):
    rows, df = events
    out = ordered.fill_from_previous(df.withColumn("o", F.struct("at", "id").cast("string")).drop("o").withColumn("k", F.col("at") * 1000 + F.col("id")), "user", "k", ["v"], max_rows=limit)
    got = {r["id"]: r["v"] for r in out.collect()}
    want = {}
    for rs in by_user(rows).values():
        last = None
        for r in rs:
            last = r[3] if r[3] is not None else last
            want[r[2]] = last
    assert got == want


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_sessions(events, limit):
    rows, df = events
    got = {r["id"]: r["session_id"] for r in ordered.session_ids(df, ["user"], "at", F.lit(10), "id", max_rows=limit).collect()}
    want = {}
    for rs in by_user(rows).values():
        session, prev = 1, None
        for r in rs:
            session += prev is not None and r[1] - prev > 10
            want[r[2]], prev = session, r[1]
    assert got == want


def windows(n, size, step, allow_last):
    out, start = [], 0
    while start < n and (start == 0 or start - step + size < n):
        if allow_last or start + size <= n:
            out.append((start // step, range(start, min(n, start + size))))
        start += step
    return out


@pytest.mark.parametrize("limit", [SMALL, 10**6])
@pytest.mark.parametrize("size, step, allow_last", [(8, 5, False), (3, 1, True), (6, 9, True), (4, 4, True)])
def test_segments(events, limit, size, step, allow_last):
    rows, df = events
    got = sorted((r["id"], r["segment_id"]) for r in ordered.segments(df, ["user"], ["at", "id"], size, step, allow_last, limit).collect())
    want = sorted((rs[k][2], s) for rs in by_user(rows).values() for s, ks in windows(len(rs), size, step, allow_last) for k in ks)
    assert got == want


@pytest.mark.parametrize("limit", [7, 10**6])
@pytest.mark.parametrize("group", ["user", None])
def test_lag_features(events, limit, group):
    rows, df = events
    out = ordered.lag_features(df.withColumn("x", F.col("id").cast("double")), ["x"], "x", ["at", "id"], 3, 2, group, block_rows=limit)
    keyed = by_user(rows) if group else {"all": sorted(rows, key=lambda r: (r[1], r[2]))}
    want = sorted((k - 2, rs[k - 4][2], rs[k - 3][2], rs[k - 2][2], rs[k][2]) for rs in keyed.values() for k in range(4, len(rs)))
    got = sorted((r["index"], r["x_lag2"], r["x_lag1"], r["x_lag0"], r["label"]) for r in out.collect())
    assert got == want


def test_global_index(events):
    rows, df = events
    got = {r["id"]: r["k"] for r in global_index(df, ["at", "id"], "k").collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


@pytest.mark.parametrize("limit", [SMALL, 10**6])
def test_asof_visit(table, limit):
    rnd = random.Random(4)
    acts = [(rnd.choice("abcx"), rnd.randint(0, 100), k) for k in range(300)]
    visits = [("a", rnd.randint(20, 80), k, rnd.choice([None, float(k)])) for k in range(40)] + [("b", None, 7, 1.5), ("c", 50, 8, None), ("c", None, 9, 2.5)]
    visits = list({(v[0], v[1]): v for v in visits}.values())
    out = link.asof_visit(table(acts, "s string, t long, id long"), table(visits, "s string, vt long, no long, age double"), "s", "t", "vt", ["no"], ["age"], limit)
    got = {r["id"]: (r["visit_no"], r["first_age"]) for r in out.collect()}
    want = {}
    for s, t, k in acts:
        mine = [v for v in visits if v[0] == s]
        if not mine:
            continue
        dated = sorted((v for v in mine if v[1] is not None), key=lambda v: v[1])
        before = [v for v in dated if v[1] <= t]
        chosen = before[-1] if before else dated[0] if dated else mine[0]
        aged = [v[3] for v in [*dated, *[v for v in mine if v[1] is None]] if v[3] is not None]
        want[k] = (chosen[2], aged[0] if aged else None)
    assert got == want


@pytest.mark.parametrize("limit", [SMALL, 10**6])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_asof_visit_keeps_the_whole_order(table, limit, kind):
    """Texts that differ after many bytes and integers beyond the doubles are told apart."""
    at = (lambda k: f"2016-08-{k:03d}") if kind == "string" else (lambda k: 1_600_000_000_000_000_000 + k)
    acts, visits = [("a", at(2 * k + 1), k) for k in range(150)], [("a", at(2 * k), k) for k in range(150)]
    out = link.asof_visit(table(acts, f"s string, t {kind}, id long"), table(visits, f"s string, vt {kind}, no long"), "s", "t", "vt", ["no"], [], limit)
    assert {r["id"]: r["visit_no"] for r in out.collect()} == {k: k for k in range(150)}


def test_text_orders_are_cut(table):
    rows = [("a", f"2016-08-10 {k:06d}", k) for k in range(1000)]
    got, split = cut_hot_groups(table(rows, "s string, t string, id long"), ["s"], "t", 100)
    assert split and got.select("_chunk").distinct().count() >= 8


def test_an_outlier_does_not_keep_texts_together(table):
    rows = [("a", f"2016-08-10T00:{k:06d}", k) for k in range(1000)] + [("a", "!", -1), ("a", None, -2), ("b", "x", 0)]
    got, split = cut_hot_groups(table(rows, "s string, t string, id long"), ["s"], "t", 100)
    sizes = [r["count"] for r in got.where("s = 'a'").groupBy("_chunk").count().collect()]
    assert split and len(sizes) >= 8 and max(sizes) < 300
    assert [r["_chunk"] for r in got.where("s = 'b' OR t IS NULL").collect()] == [0, 0]


def series(table, expr, values):
    return table([(values,)], "a array<double>").select(expr(F.col("a"))).first()[0]


def test_series_operations(table):
    a = [1.0, 2.0, 4.0, -8.0]
    assert series(table, lambda c: process_series(c, "diff"), a) == [1, 2, -12]
    assert series(table, lambda c: process_series(c, "diff", 2, pad=True), a) == [0, 0, 1, -14]
    assert series(table, lambda c: process_series(c, "ratio"), a) == [2, 2, -2]
    assert series(table, lambda c: process_series(c, "relative_diff"), a) == [1, 1, -3]
    assert series(table, lambda c: process_series(c, "log_ratio"), a)[2] is None
    assert series(table, lambda c: process_series(c, "max", 2), a) == [4, 4]
    assert series(table, lambda c: process_series(c, "mean", 9), a) == [-0.25]
    for kind in ("diff", "min"):
        assert series(table, lambda c: process_series(c, kind), []) == []
        assert series(table, lambda c: process_series(c, kind), [5.0]) == [5.0]


def test_series_scaling(table):
    a = [2.0, -4.0, 0.0]
    assert series(table, lambda c: scale_series(c, "l2"), a) == [1, -1, 0]
    assert series(table, lambda c: scale_series(c, "max_abs"), a) == [0.5, -1, 0]
    assert series(table, lambda c: scale_series(c, "min_max_11"), a) == pytest.approx([1, -1, 1 / 3])
    assert series(table, lambda c: scale_series(c, "min_max_01"), [3.0, 3.0]) == [0.5, 0.5]
    assert series(table, lambda c: scale_series(c, "standard"), [3.0, 3.0]) == [0, 0]
    assert series(table, lambda c: scale_series(c, "standard"), [1.0, 2.0, 3.0]) == [-1, 0, 1]
    for kind in ("l1", "standard", "min_max_01", "max_abs"):
        assert series(table, lambda c: scale_series(c, kind), []) == []


def test_peaks_and_trim(table):
    a = [5.0, 1.0, 3.0, 0.0, 4.0, 2.0, 6.0, 1.5, 7.0]  # minima at 1, 3, 5, 7
    assert series(table, lambda c: extract_peaks(c, 2), a) == a[1:5]
    assert series(table, lambda c: extract_peaks(c, 1, 0.5), a) == a[1:3]
    assert series(table, lambda c: extract_peaks(c, 4), a) is None
    assert series(table, lambda c: extract_peaks(c, 1), [1.0]) is None
    assert series(table, lambda c: trim_series(c, 1, 2), a) == a[1:-2]
    assert series(table, lambda c: trim_series(c, 3, length=4), a) == a[3:7]
    assert series(table, lambda c: trim_series(c, 8, length=4), a) is None


def test_alternations(table):
    df = table([([True, True, False, True],), ([],), ([True],)], "a array<boolean>")
    assert [r[0] for r in df.select(ordered.alternations(F.col("a"))).collect()] == [2, 0, 0]
