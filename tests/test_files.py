"""JSON values written by lines are the JSON that any reader takes, and come back the same."""

import json
from pathlib import Path

import pytest

from tripleforge.sources import files


def whole(path):
    return "\n".join(p.read_text().rstrip("\n") for p in sorted(Path(path).glob("part-*")) if p.stat().st_size)


ROWS = [(3, 'a],"}{[', None), (1, "line\nbreak", 1.5), (2, " , ]}", -2.0), (2, " , ]}", -2.0), (4, "é\U0001f600\\\"", 0.0), (5, "", None)]


@pytest.mark.parametrize("wrapper", [None, "results"])
@pytest.mark.parametrize("n", [0, 1, 6])
def test_arrays(spark, tmp_path, wrapper, n):
    df = spark.createDataFrame(ROWS[:n], "k long, name string, x double").repartition(4)
    files.write_array(df, f"{tmp_path}/out", ["k"], wrapper)
    got = json.loads(whole(f"{tmp_path}/out"))
    want = [{"k": k, "name": t, "x": x} for k, t, x in sorted(ROWS[:n], key=lambda r: r[0])]
    assert got == (want if wrapper is None else {wrapper: want})
    back = files.read_lines(spark, f"{tmp_path}/out", "k long, name string, x double").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(ROWS[:n], key=repr)


def test_array_of_many_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_array(spark.range(500).withColumnRenamed("id", "k"), f"{tmp_path}/out", ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(f"{tmp_path}/out").glob("part-*"))) > 1
    assert json.loads(whole(f"{tmp_path}/out")) == [{"k": k} for k in range(500)]


def test_pretty_arrays_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"k": 1, "name": "x"},\n  {"k": 2, "name": "y"}\n]\n')
    (tmp_path / "b.json").write_text('{ "results" : [\n{"k": 3, "name": "z"},\n{"k": 4, "name": ","}\n]}')
    got = [files.read_lines(spark, f"{tmp_path}/{n}.json", "k long, name string").collect() for n in "ab"]
    assert [sorted(map(tuple, g)) for g in got] == [[(1, "x"), (2, "y")], [(3, "z"), (4, ",")]]


@pytest.mark.parametrize("n", [0, 4])
def test_maps(spark, tmp_path, n):
    rows = [("a\": {,}", 1), ("b", 2), ("é\n", -3), ("", 4)][:n]
    files.write_json_map(spark.createDataFrame(rows, "key string, value long"), f"{tmp_path}/out")
    assert json.loads(whole(f"{tmp_path}/out")) == dict(rows)
    assert {r.key: int(r.value) for r in files.read_map_lines(spark, f"{tmp_path}/out").collect()} == dict(rows)


def test_universes(spark, tmp_path):
    rows = [(f'n{i}", "ids": [', i * 7 % 501) for i in range(300)] + [("é\\", 900), ("]}", 901)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_universe(spark.createDataFrame(rows, "name string, id long").repartition(5), f"{tmp_path}/out")
        got = files.read_universe_lines(spark, f"{tmp_path}/out").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: r[1])
    assert json.loads(whole(f"{tmp_path}/out")) == {"names": [n for n, _ in want], "ids": [i for _, i in want]}
    assert sorted(map(tuple, got)) == sorted(rows)


def test_delimiters(spark, tmp_path):
    texts = {"a": "x,y;z,w\n1;2;3;4", "b": "x|y", "c": "x\ty,z,w", "d": "plain\na,b", "e": "a;b,c|d"}
    for n, t in texts.items():
        (tmp_path / n).mkdir()
        (tmp_path / n / "f.txt").write_text(t)
    got = {r.file.split("/")[-2]: (r.sep, r.n_lines) for r in files.sniffed(spark, f"file://{tmp_path}").collect()}
    assert got == {n: (files.sniff_delimiter(spark, f"{tmp_path}/{n}"), t.count("\n") + 1) for n, t in texts.items()}
