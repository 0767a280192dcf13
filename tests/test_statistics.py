import math
import random

import pytest

from cohortlake.operators import histogram as h
from cohortlake.operators import hypothesis as hy
from cohortlake.operators import matrix as m
from cohortlake.operators import quantiles, stats

X = [0.5, 0.7, 1.2, 6.3, 0.1, 0.4, 0.7, -1.2, 3.0, 4.2, 5.7, 4.2, 8.1]
Y = [0.5, 0.4, 0.4, 0.4, -1.2, 0.8, 0.23, 0.9, 2.0, 0.1, -4.1, 3.0, 4.0]


def test_basic_stats(table):
    xs = [None, 0.5, 2.0, -3.5, None, 8.9, 4.2, 8.1, 0.0, -1.0]
    ys = [-2.0, None, 3.1, 9.0, None, 2.5, -8.2, None, None, 7.6]
    df = table(list(zip(xs, ys)), "x double, y double")
    r = stats.basic_stats(df, "x").first()
    assert (r["min"], r["max"], r["defined"], r["undefined"]) == (-3.5, 8.9, 8, 2)
    for name, value in {"mean": 2.4, "sum": 19.2, "sum_of_squares": 179.96, "variance": 16.735, "sample_variance": 16.735 * 8 / 7}.items():
        assert r[name] == pytest.approx(value, abs=1e-9)
    both = {r["field"]: r for r in stats.multi_basic_stats(df, ["x", "y"]).collect()}
    assert both["y"]["variance"] == pytest.approx(33.64333333333, abs=1e-9)
    assert (both["y"]["defined"], both["y"]["undefined"], both["x"]["defined"]) == (6, 4, 8)


def test_stats_of_nothing_and_of_one(table):
    assert stats.basic_stats(table([(None,)], "x double"), "x").collect() == []
    one = stats.basic_stats(table([(3.0,), (None,)], "x double"), "x").first()
    assert (one["variance"], one["sample_variance"], one["undefined"]) == (0.0, 0.0, 1)


def test_unique_distribution(table):
    words = [None, "cat", None, "dog", "zebra", "tiger", "dog", None, "dolphin", "dolphin", "cat", "dolphin"]
    df = table([(w,) for w in words], "v string")
    got = {r["value"]: r["count"] for r in stats.unique_distribution(df, "v").collect()}
    assert got == {None: 3, "cat": 2, "dog": 2, "dolphin": 3, "tiger": 1, "zebra": 1}


def bins(df):
    return [(round(r["x"], 9), r["count"]) for r in df.orderBy("bin").collect()]


def test_numeric_distribution(table):
    xs = [0.5, 0.5, 1.5, 2.0, 0.6, 2.4, 2.6, 3.0, 5.0, 7.5, 1.1, 2.0]
    got = bins(h.numeric_distribution(table([(x,) for x in xs], "x double"), "x", 7))
    assert got == [(0.5, 4), (1.5, 4), (2.5, 2), (3.5, 0), (4.5, 1), (5.5, 0), (6.5, 1)]
    ints = [1, None, 1, 3, 2, None, 3, 2, 2, 3, 5, 7, 4, 2, None, None]
    got = bins(h.numeric_distribution(table([(x,) for x in ints], "x long"), "x", 7, special_bin_for_max=True))
    assert got == [(1, 2), (2, 4), (3, 3), (4, 1), (5, 1), (6, 0), (7, 1)]


def test_numeric_distribution_edges(table):
    decimal = [(k / 100,) for k in range(0, 101)]
    got = bins(h.numeric_distribution(table(decimal, "x double"), "x", 10))
    assert [n for _, n in got] == [10] * 9 + [11]  # a value on an edge is in the upper bin
    same = bins(h.numeric_distribution(table([(4.0,), (4.0,)], "x double"), "x", 3))
    assert [n for _, n in same] == [2, 0, 0]
    assert bins(h.numeric_distribution(table([(None,)], "x double"), "x", 3)) == []
    assert bins(h.numeric_distribution(table([(4,), (4,)], "x long"), "x", 3, mode="per_integer")) == [(4, 2)]


@pytest.mark.parametrize("name", ["count", "mean", "min", "max", "variance"])
def test_grid_against_brute_force(table, name):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-5, 5), rnd.choice([0.0, 1.0, 2.5, None]), rnd.uniform(0, 1)) for _ in range(300)]
    df = table(rows, "a double, b double, v double")
    got = {(r["bin_1"], r["bin_2"]): r[2 + 2] for r in h.grid(df, [h.Binning("a", 4), h.Binning("b", 3)], name, None if name == "count" else "v").collect()}
    full = [r for r in rows if r[1] is not None]
    lo, hi = min(r[0] for r in full), max(r[0] for r in full)
    cells = {(i, j): [] for i in range(4) for j in range(3)}
    for a, b, v in full:
        i = 3 if a == hi else math.floor((a - lo) / (hi - lo) * 4)
        j = 2 if b == 2.5 else math.floor(b / 2.5 * 3 + 1e-12)
        cells[i, j].append(v)
    assert got.keys() == cells.keys()
    for k, vs in cells.items():
        if name == "count":
            want = len(vs)
        elif not vs:
            assert got[k] is None
            continue
        else:
            mean = sum(vs) / len(vs)
            want = {"mean": mean, "min": min(vs), "max": max(vs), "variance": sum((v - mean) ** 2 for v in vs) / len(vs)}[name]
        assert got[k] == pytest.approx(want, abs=1e-9)


def brute_quartiles(values):
    s = sorted(values)
    n = len(s)
    q1, q2, q3 = s[n // 4], s[n // 2], s[3 * n // 4]
    fence = 1.5 * (q3 - q1)
    return min(v for v in s if v >= q1 - fence), q1, q2, q3, max(v for v in s if v <= q3 + fence)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 101])
def test_quartiles(table, n):
    rnd = random.Random(n)
    values = [rnd.choice([rnd.gauss(0, 1), 3.0, rnd.gauss(0, 1) * 20]) for _ in range(n)]
    r = quantiles.quartiles(table([(v,) for v in [*values, None]], "x double"), "x").first()
    assert tuple(r) == brute_quartiles(values)


def test_group_quartiles_and_cumulative_counts(table):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, "a", "b"]), rnd.randint(0, 50)) for _ in range(400)] + [("hot", k % 97) for k in range(2000)]
    df = table(rows, "g string, x long")
    got = {r["group"]: tuple(r)[1:] for r in quantiles.quartiles(df, "x", "g").collect()}
    want = {g: brute_quartiles([x for k, x in rows if k == g]) for g in (None, "a", "b", "hot")}
    assert got == want
    running = {(r["group"], r["value"]): r["count"] for r in quantiles.cumulative_counts(df, "x", "g").collect()}
    for (g, v), n in running.items():
        assert n == sum(1 for k, x in rows if k == g and x <= v)


def test_pearson_and_euclid(table):
    df = table(list(zip(X, Y, [1.0] * 13)), "x double, y double, c double")
    r = {(r["i"], r["j"]): r["value"] for r in m.pearson_matrix(df, ["x", "y", "c"]).collect()}
    assert r["x", "y"] == r["y", "x"] == pytest.approx(0.1725323796730674, abs=1e-11)
    assert r["x", "c"] is None and r["x", "x"] == 1.0
    d = {(r["i"], r["j"]): r["value"] for r in m.euclidean_matrix(df, ["x", "y"]).collect()}
    assert d["x", "y"] == pytest.approx(math.sqrt(174.1209), abs=1e-9) and d["y", "y"] == 0


def test_all_defined_forms_agree(table):
    rnd = random.Random(1)
    rows = [tuple(rnd.gauss(k, 1 + k) for k in range(5)) for _ in range(200)]
    names = list("abcde")
    wide = table(rows, ", ".join(f"{n} double" for n in names))
    packed = table([(list(r),) for r in rows], "v array<double>")
    for one, other in ((m.pearson_matrix, m.pearson_all_defined), (m.euclidean_matrix, m.euclidean_all_defined)):
        a = {(r["i"], r["j"]): r["value"] for r in one(wide, names).collect()}
        b = {(r["i"], r["j"]): r["value"] for r in other(packed, "v", names).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-8) for k in a)


def test_matthews(table):
    pairs = "TT FF TF -- FF FT FF F- TT -F TT FF TF".split()
    value = {"T": True, "F": False, "-": None}
    df = table([(value[a], value[b]) for a, b in pairs], "a boolean, b boolean")
    r = {(r["i"], r["j"]): r["value"] for r in m.matthews_matrix(df, ["a", "b"]).collect()}
    assert r["a", "b"] == pytest.approx(0.408248290463863, abs=1e-12)


def test_metric_mds_restores_distances(spark, table):
    points = {"a": (0, 0), "b": (3, 0), "c": (0, 4), "d": (6, 1), "e": (2, 2)}
    rows = [(i, j, math.dist(p, q)) for i, p in points.items() for j, q in points.items()]
    out, values = m.metric_mds(table(rows, "i string, j string, value double"), 2)
    at = {}
    for r in out.collect():
        at.setdefault(r["i"], {})[r["dim"]] = r["value"]
    for i, p in points.items():
        for j, q in points.items():
            assert math.dist([at[i][0], at[i][1]], [at[j][0], at[j][1]]) == pytest.approx(math.dist(p, q), abs=1e-6)
    assert len(values) == 2 and values[0] >= values[1]


def test_standardize(table):
    df = table([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    assert [tuple(r) for r in m.standardize(df, ["x", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def _from_counts(table, counts):
    rows = [(str(g), str(v)) for g, row in enumerate(counts) for v, n in enumerate(row) for _ in range(n)]
    return table(rows, "g string, v string")


@pytest.mark.parametrize(
    "counts, p, stat, df",
    [
        ([[60, 54, 46, 41], [40, 44, 53, 57]], 0.04588650089174715, 8.00606624626254, 3),
        ([[33, 29], [153, 181], [103, 81], [16, 14]], 0.14667851968027895, 5.369138021292619, 3),
    ],
)
def test_chi_square(table, counts, p, stat, df):
    r = hy.chi_square(_from_counts(table, counts), "g", "v").first()
    assert r["p_value"] == pytest.approx(p, abs=1e-11) and r["statistic"] == pytest.approx(stat, abs=1e-10) and r["df1"] == df


def test_chi_square_undefined(table):
    r = hy.chi_square(table([("a", "x"), ("a", "y")], "g string, v string"), "g", "v").first()
    assert r["p_value"] is None and r["statistic"] is None


@pytest.mark.parametrize(
    "groups, p, stat, df1, df2",
    [
        ([X, Y], 0.04405750860028412, 4.516646514922993, 1, 24),
        ([[643, 655, 702], [469, 427, 525], [484, 456, 402]], 0.0012071270284831348, 25.17541122163707, 2, 6),
    ],
)
def test_anova(table, groups, p, stat, df1, df2):
    rows = [(g, float(x)) for g, xs in enumerate(groups) for x in xs] + [(99, None)]  # a group without values is skipped
    r = hy.anova(table(rows, "g int, x double"), "g", "x").first()
    assert r["p_value"] == pytest.approx(p, rel=1e-10) and r["statistic"] == pytest.approx(stat, abs=1e-9)
    assert (r["df1"], r["df2"]) == (df1, df2)


def test_multi_hot_of_unseen_keys(table):
    df = table([(1, "a, b"), (2, "c")], "id int, v string")
    keys = table([(1,), (2,), (3,)], "id int")
    got = {r["id"]: tuple(r)[1:] for r in stats.multi_hot(df, "id", "v", ["a", "b"], {"a": "k", "b": "k"}, keys).collect()}
    assert got == {1: (True, True, 2, 2), 2: (False, False, 0, 0), 3: (False, False, 0, 0)}


@pytest.fixture(scope="module")
def wide_rows():
    rnd = random.Random(9)
    return [tuple(None if rnd.random() < 0.2 else (7.0 if c == 3 else rnd.gauss(c * 10, 1 + c)) for c in range(8)) for _ in range(300)]


@pytest.mark.parametrize("matrix", [m.pearson_matrix, m.euclidean_matrix, m.matthews_matrix])
def test_wide_matrices_equal_narrow_ones(table, wide_rows, monkeypatch, matrix):
    names = [f"c{k}" for k in range(8)]
    rows = wide_rows if matrix is not m.matthews_matrix else [tuple(None if v is None else v > 20 for v in r) for r in wide_rows]
    df = table(rows, ", ".join(f"{n} {'double' if matrix is not m.matthews_matrix else 'boolean'}" for n in names)).repartition(3)
    narrow = {(r["i"], r["j"]): r["value"] for r in matrix(df, names).collect()}
    monkeypatch.setattr(m, "NARROW", 2)
    monkeypatch.setattr(m, "BLOCK", 3)
    wide = {(r["i"], r["j"]): r["value"] for r in matrix(df, names).collect()}
    assert narrow.keys() == wide.keys() and len(wide) == 64
    for k, v in narrow.items():
        assert wide[k] == (None if v is None else pytest.approx(v, abs=1e-8)), k


def test_wide_statistics_equal_narrow_ones(table, wide_rows, monkeypatch):
    names = [f"c{k}" for k in range(8)]
    df = table([(k % 3, *r) for k, r in enumerate(wide_rows)], "g int, " + ", ".join(f"{n} double" for n in names))

    def both():
        one = {(r["g"], r["field"]): tuple(r)[2:] for r in stats.group_multi_basic_stats(df, "g", names).collect()}
        two = {r["field"]: (r["statistic"], r["df1"], r["df2"]) for r in hy.multi_anova(df, "g", names).collect()}
        return one, two

    narrow = both()
    monkeypatch.setattr(stats, "WIDE", 2)
    monkeypatch.setattr(hy, "WIDE", 2)
    for a, b in zip(narrow, both()):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_distribution_of_many_groups(spark, monkeypatch):
    from cohortlake.operators import charts

    monkeypatch.setattr(charts, "PER_STEP", 7)
    rows = spark.range(300).selectExpr("concat('g', id % 100) AS g", "concat('l', id % 3) AS l")
    got = charts.distribution_categorical(rows, "l", "g", top=2).collect()
    assert len(got) == 200 and len({(r["group"], r["label"]) for r in got}) == 200
    want = {(f"g{k % 100}", f"l{k % 3}") for k in range(300)}
    assert all(r["count"] == ((r["group"], r["label"]) in want) for r in got) and {r["position"] for r in got} == {1, 2}
    assert charts.distribution_categorical(rows.where("id < 0"), "l", "g").count() == 0
