import pytest
from pyspark.sql import functions as F

from cohortlake.operators import series
from cohortlake.session import scratch_path, shared_folder
from cohortlake.sources import clinical, delimited, documents, matrices


def write_text(spark, label, lines):
    path = scratch_path(spark, label)
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    return path


def test_shared_folder_is_the_cluster_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_local_session_without_the_setting_has_a_folder_of_its_own(tmp_path):
    """In a Python of its own, whose Spark has no defaults."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
from cohortlake.session import build_session, settle, shared_folder
spark = build_session("plain", 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert settle(spark.range(3)).count() == 3
print("settled")
"""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], env=env, capture_output=True, text=True, timeout=180)
    assert "settled" in done.stdout, done.stderr[-2000:]


def test_column_names():
    got = delimited.column_names([' "a b" ', "a-b", "", "x"])
    assert got == [("a_b_0", "a b 0"), ("a_b_1", "a-b 1"), ("_empty_", "_empty_"), ("x", "x")]
    with pytest.raises(ValueError):
        delimited.column_names(["x" * 101])


def test_read_delimited_with_quotes(spark):
    path = write_text(spark, "quoted", ['id,text', '1,"a, b"', '2,"say ""hi"""', '3,na'])
    out = delimited.read_delimited(spark, path)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "a, b"), (2, 'say "hi"'), (3, None)]
    assert out.schema["id"].metadata["type"] == "integer"
    many = write_text(spark, "multi", ['id,text\n1,"a\nb"\n2,c'])
    assert sorted(r["text"] for r in delimited.read_delimited(spark, many, infer=False, multi_line=True).collect()) == ["a\nb", "c"]


def test_enum_of_three(spark):
    path = write_text(spark, "flowers", ["length,variety", *[f".{k % 9 + 1},{'xyz'[k % 3]}" for k in range(150)]])
    out = delimited.read_delimited(spark, path)
    assert out.count() == 150 and list(out.schema["variety"].metadata["enumValues"]) == ["x", "y", "z"]
    assert out.dtypes == [("length", "double"), ("variety", "int")]


def test_repair_lines(spark):
    path = write_text(spark, "lines", ["a|b|c", "1|2|3", "4|", "5", "|6", "7|8|9", "10|1"])
    got = sorted(r["items"] for r in delimited.repair_lines(spark, path, 3, "|").collect())
    assert got == [["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"]]
    bad = write_text(spark, "overflow", ["1|2", "3|4|5"])
    with pytest.raises(Exception, match="too many items"):
        delimited.repair_lines(spark, bad, 3, "|", header=False).collect()
    assert [r["overflow"] for r in delimited.repair_lines(spark, bad, 3, "|", header=False, strict=False).collect()] == [True]


def test_repair_lines_over_several_blocks(spark):
    rows = [f"{k}|x|y" if k % 3 else f"{k}|x" for k in range(2000)]
    path = write_text(spark, "blocks", [line for r in rows for line in ([r] if r.endswith("y") else [r, "|y"])])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = delimited.repair_lines(spark, path, 3, "|", header=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r["items"][0]) for r in got) == list(range(2000)) and all(r["items"][1:] == ["x", "y"] for r in got)


def test_json_array(spark):
    path = write_text(spark, "json", ['[{"a": ".2", "b": "x"},', ' {"a": 1, "c": true}]'])
    out = documents.read_json_array(spark, path)
    assert sorted(map(tuple, out.collect()), key=str) == [(0.2, "x", None), (1.0, None, True)]


def test_expand_file_column(table):
    df = table([("f1",), ("f2",), ("gone",)], "file string")
    files = table([("f1", '{"x": [1, 2]}'), ("f2", "p\tq\n1\t2\n3")], "file_id string, body string")
    got = [r[0] for r in documents.expand_file_column(df, "file", files).select(F.to_json("file")).collect()]
    assert set(got) == {'{"x":[1,2]}', '[{"p":"1","q":"2"},{"p":"3","q":""}]', None}


def test_mapping_file(spark):
    data = write_text(spark, "data", ["id\tvisit\tage", "1\tV1\t30", "2\tV2\t40"])
    mapping = write_text(spark, "mapping", ["filename\tcategory_cd\tcol_nbr\tdata_label", "data.txt\tDemo_graphy+Base\t3\tAge in years", "data.txt\t\t1\tSUBJ_ID"])
    df, dictionary, tree = clinical.read_with_mapping(spark, data, mapping)
    assert df.schema["age"].metadata["label"] == "Age in years" and df.schema["age"].metadata["category"] == "Demo graphy / Base"
    assert {tuple(r) for r in dictionary.collect()} == {("id", "SUBJ_ID", ""), ("visit", "", ""), ("age", "Age in years", "Demo graphy / Base")}
    assert {tuple(r) for r in tree.collect()} == {("Demo graphy", "Demo graphy", None), ("Demo graphy / Base", "Base", "Demo graphy")}
    wrong = write_text(spark, "mapping", ["filename\tcategory_cd\tcol_nbr\tdata_label", "data.txt\t\t4\tX"])
    with pytest.raises(ValueError):
        clinical.read_with_mapping(spark, data, wrong)


def test_matrix_round_trip(spark, table):
    rows = [("r1", "a.b", 1.5), ("r1", "c", 2.0), ("r2", "c", 3.0)]
    path = scratch_path(spark, "matrix")
    matrices.save_matrix(table(rows, "i string, j string, value double"), path, ["a.b", "c"])
    assert sorted(tuple(r) for r in matrices.load_matrix(spark, path).collect()) == rows


def test_nested_documents(spark, table):
    df = spark.read.json(spark.sparkContext.parallelize(['{"id": 1, "a": {"b": [{"c": [1, 2]}, {"c": [3]}, {}], "d": "x"}}', '{"id": 2, "a": {"b": null}}']))
    got = {r["id"]: r["v"] for r in df.select("id", series.traverse(df, "a.b.c").alias("v")).collect()}
    assert got == {1: [1, 2, 3], 2: []}
    assert df.select(series.traverse(df, "a.nope").alias("v")).first()["v"] == []
    flat = series.flatten_struct(df, "_")
    assert flat.columns == ["a_b", "a_d", "id"]
    assert series.flatten_struct(df, "_", ["a"]).columns == ["a", "id"]
    assert series.nest_columns(flat, "_").select("a.d").first()["d"] == "x"


def test_read_folder_with_differing_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x,y\n1,2\nx,y\n")
    (tmp_path / "c.csv").write_text("y,x,z\n30,3,9\n")
    got = delimited.read_folder(spark, str(tmp_path), infer=False)
    assert sorted(map(tuple, got.select("x", "y", "z").collect())) == [("1", "2", None), ("3", "30", "9"), ("x", "y", None)]
    assert got.where("source = 'c'").count() == 1


def test_long_row_separator_keeps_rows_equal_to_the_header(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a,b~~~1,2~~~a,b~~~3,4")
    got = delimited.read_delimited(spark, str(tmp_path / "t.txt"), eol="~~~", infer=False)
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4"), ("a", "b")]


def _in_blocks(spark, size, read):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return read()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _write_bytes(spark, label, files):
    from pathlib import Path

    path = Path(scratch_path(spark, label))
    path.mkdir(parents=True)
    for name, data in files.items():
        (path / name).write_bytes(data.encode())
    return str(path)


@pytest.mark.parametrize("size", [61, 1000])
def test_json_arrays_are_read_in_blocks(spark, size):
    import json
    import random

    rnd = random.Random(3)
    objects = [
        {"id": k, "text": rnd.choice(["é {[", 'a "b\\" }', "\\", "x\ny", "}{", "", "]"]) * rnd.randint(0, 4), "inner": [{"v": rnd.choice(["}", "ü"])}] * rnd.randint(0, 3), "deep": {"a": {"b": [k]}}}
        for k in range(120)
    ]
    files = {"a.json": json.dumps(objects[:60], ensure_ascii=False), "b.json": json.dumps(objects[60:118], indent=2), "c.json": " " + json.dumps(objects[118]) + "\n", "d.json": "[]", "e.json": "\n[ " + json.dumps(objects[119]) + " ]\n"}
    path = _write_bytes(spark, "arrays", files)
    got = _in_blocks(spark, size, lambda: documents.read_json_array(spark, path, infer=False).collect())
    whole = spark.read.options(multiLine=True, primitivesAsString=True).json(path).collect()
    assert len(got) == 120 and sorted(map(str, got)) == sorted(map(str, whole))
    assert {int(r["id"]): r["text"] for r in got} == {o["id"]: o["text"] for o in objects}


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": ', '[{"a": "}"', '[{"a": 1}'])
def test_an_unfinished_json_array_is_an_error(spark, text):
    path = _write_bytes(spark, "cut", {"a.json": text})
    with pytest.raises(Exception, match="unfinished JSON"):
        documents.read_json_array(spark, path)


@pytest.mark.parametrize("size", [61, 1 << 20])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_in_blocks(spark, size, eol):
    import random

    rnd = random.Random(5)
    cells = ["1", "", "a b", '"x, y"', '"say ""hi"""', f'"two{eol}lines"', f'"{eol}"', '""', f' "é, ""{eol}""" ', '5" wide', 'a"b']
    rows = [",".join(rnd.choice(cells) for _ in range(3)) for _ in range(150)]
    rows = [r if r.strip(",") else "x,y,z" for r in rows]
    files = {"a.csv": eol.join(["k,l,m", *rows[:90]]), "b.csv": eol.join(["k,l,m", "", *rows[90:], ""])}
    path = _write_bytes(spark, "quoted-blocks", files)
    got = _in_blocks(spark, size, lambda: delimited.read_delimited(spark, path, infer=False, multi_line=True).collect())
    whole = spark.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) >= 140
