import os
import random

import pytest

from pipelab.session import shared_dir
from pipelab.sources import csv_records as cr

SCHEMA = "a int, b string, c string"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in old.items():
        spark.conf.set(k, v)


def _file(spark, name: str, text: str) -> str:
    path = os.path.join(shared_dir(spark).removeprefix("file:"), f"{name}-{os.urandom(6).hex()}.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _whole_file(spark, path, schema=SCHEMA):
    return _rows(spark.read.schema(schema).options(header="true", escape='"', multiLine="true").csv(path))


def _random_csv(rng: random.Random, rows: int, end: str = "\n") -> str:
    def field() -> str:
        kind = rng.randrange(6)
        if kind == 0:
            return ""
        if kind == 1:
            return "plain" + "x" * rng.randrange(9)
        if kind == 2:
            return 'mid"quote"s'
        inner = "".join(rng.choices(['""', ",", end, "ab", " ", '""""', "z" * 20], k=rng.randrange(9)))
        return f'"{inner}"'

    return f"a,b,c{end}" + "".join(f"{k},{field()},{field()}{end}" for k in range(rows))


@pytest.mark.parametrize("line,out,inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('a"b,c', False, False), ('"a""', True, False), ('x"","', True, False),
    ('"a"b,"c', True, True), ('""', False, True), ('",', True, False), ('"', True, False), ('"a""b",""",', True, True), ("", False, True),
])
def test_ends_inside(line, out, inside):
    assert cr.ends_inside(line, False) is out and cr.ends_inside(line, True) is inside


def test_long_lines_do_not_recurse():
    assert cr.ends_inside('"' + '""' * 500_000, False) is True
    assert cr.ends_inside(",".join(['"x"'] * 300_000), False) is False


@pytest.mark.parametrize("seed,end", [(1, "\n"), (3, "\r\n"), (4, "\n")])
def test_many_splits_equal_one(spark, small_splits, seed, end):
    path = _file(spark, "random", _random_csv(random.Random(seed), 400, end))
    want = _whole_file(spark, path)
    small_splits(os.path.getsize(path) // 16 + 1)
    assert spark.read.text(path).rdd.getNumPartitions() >= 16
    got = _rows(cr.read_csv_records(spark, path, SCHEMA))
    if end == "\r\n":  # breaks inside fields keep their form or become line feeds, as the parser has it
        unify = lambda rows: [tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in r) for r in rows]
        got, want = unify(got), unify(want)
    assert got == want and len(got) == 400


def test_a_split_border_at_every_byte(spark, small_splits):
    text = 'a,b,c\n1,"x\ny",\n2,"d""q\n""\n",z\n3,"","\n"\n4,p,"one\n\n\ntwo, ""three"\n5,a"b,"c"\n'
    path = _file(spark, "borders", text)
    want = _whole_file(spark, path)
    assert len(want) == 5
    for size in (3, 4, 7, 10, 16, 25, 37):
        small_splits(size)
        assert _rows(cr.read_csv_records(spark, path, SCHEMA)) == want, size


def test_header_over_borders_and_a_field_over_many_splits(spark, small_splits):
    text = 'a,"b\nlong\nname",c\n1,"' + "many lines\n" * 300 + '",x\n2,y,"z\nz"\n'
    path = _file(spark, "wide", text)
    want = _whole_file(spark, path)
    for size in (5, 64, 400):
        small_splits(size)
        assert _rows(cr.read_csv_records(spark, path, SCHEMA)) == want
        assert cr.read_csv_records(spark, path).columns == ["a", "b\nlong\nname", "c"]


def test_several_files_and_inferred_types(spark, small_splits):
    folder = _file(spark, "folder", "").removesuffix(".csv") + "-dir.csv"
    os.makedirs(folder)
    for k in range(3):
        with open(os.path.join(folder, f"part-{k}.csv"), "w", newline="") as f:
            f.write(f'n,x,t\n{k},{k}.5,"a\nb"\n\n{k + 10},2,plain\n')
    small_splits(12)
    got = cr.read_csv_records(spark, folder)
    assert [t for _, t in got.dtypes] == ["int", "double", "string"]
    assert _rows(got) == sorted([(k, k + 0.5, "a\nb") for k in range(3)] + [(k + 10, 2.0, "plain") for k in range(3)], key=str)


def test_no_break_inside_fields_uses_the_plain_reader(spark):
    path = _file(spark, "plain", 'a,b,c\n1,"x, ""y""",z\n2,a"b,\n')
    got = cr.read_csv_records(spark, path, SCHEMA)
    assert "FileScan csv" in got._jdf.queryExecution().toString() and _rows(got) == _whole_file(spark, path)


def test_empty_files(spark):
    for text in ("", "a,b,c\n", "\n\n"):
        path = _file(spark, "empty", text)
        assert cr.read_csv_records(spark, path, SCHEMA).count() == 0


def test_splits_before_a_border_are_not_shuffled(spark, small_splits):
    path = _file(spark, "plan", _random_csv(random.Random(8), 300))
    small_splits(400)
    states = cr.split_states(cr._lines(spark, path))
    kept = cr._over_borders(cr._lines(spark, path), states).count()
    assert 0 < kept <= states.count()
