import pytest
from pyspark.sql import functions as F

from pipelab.functions import text as tx
from pipelab.session import scratch_path, shared_dir
from pipelab.sources import tables as tb

FENCE = "```"


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    (f'{FENCE}json\n{{"a": 1}}\n{FENCE}', '{"a": 1}'),
    (f'{FENCE}json\n{{"a": 1}} tail\n{FENCE}', None),
    (f'{FENCE}json\n{{"a":\n 1}}', '{"a":\n 1}'),
    (f'{FENCE}json\n{FENCE}\n{{"q": 1}}', '{"q": 1}'),
    (f'{FENCE}json\n\n{FENCE}\n{{"q": 1}}', None),
    (f'text {FENCE}json\n{{"q": 3}}\n{FENCE}', '{"q": 3}'),
    ('no {broken} but {"k": "v\tw"} and {"z": 1}', '{"k": "vw"}'),
    ("nothing here", None),
    ("", None),
    (None, None),
])
def test_extract_json(spark, text, want):
    assert one(spark, text, tx.extract_json) == want


def test_is_json_needs_the_whole_text(spark):
    for text, want in [('{"a":1}', True), ('{"a":1} x', False), ("[1],[2]", False), ("1], [2", False), ("", False), ("null", True), ("{", False)]:
        assert one(spark, text, tx.is_json) is want, text


def test_code_blocks(spark):
    text = f"{FENCE}\n  a = 1\n{FENCE} and {FENCE}python\nb = 2\n{FENCE} {FENCE}python\n \n{FENCE}"
    assert one(spark, text, tx.extract_code_blocks) == ["a = 1", "b = 2"]


def test_repair_json(spark):
    keys = ["reasoning", "new_pipeline_code"]
    broken = f'see {FENCE}json\n{{"reasoning": None,\n# note\n  // note\n"new_pipeline_code": [True,\n]\n}}\n{FENCE} end'
    fix = lambda c: tx.repair_json(c, keys)
    assert one(spark, broken, fix) == '{"reasoning": null,\n"new_pipeline_code": [true\n]\n}'
    assert one(spark, '{"reasoning": 1}', fix) is None
    assert one(spark, f'{FENCE}json {{"reasoning": 1, "new_pipeline_code": 2}}', fix) is None


def test_quality_and_choice(spark):
    assert one(spark, "ok", tx.is_bad_response) and one(spark, None, tx.is_bad_response)
    assert not one(spark, "x" * 20, tx.is_bad_response)
    pick = lambda c: tx.choose_code(c, F.lit("current"))
    assert one(spark, '{"code": "new"}', pick) == "new"
    assert one(spark, f"{FENCE}python\nblock\n{FENCE}", pick) == "block"
    assert one(spark, '{"code": ""}', pick) == "current"


def test_validate_code(spark):
    good = "\n".join([f"def {f}():\n    pass" for f in tx.REQUIRED_FUNCTIONS] + [f"{g} = 1" for g in tx.REQUIRED_GLOBALS])
    assert one(spark, good, tx.code_findings)["valid"] and one(spark, good, tx.missing_parts) == []
    for text in (None, "def (", "-" * 100_000 + "1", "a" + ".b" * 200_000):
        found = one(spark, text, tx.code_findings)
        assert not found["valid"] and len(found["missing"]) == 6


def test_json_is_not_lost(spark):
    assert one(spark, 'x {"a": 1, "a": 2} y', tx.extract_json) == '{"a": 2}'
    assert one(spark, '{"a": NaN, "b": 1}', tx.extract_json) == '{"a": "NaN", "b": 1}'
    long = '{"a": "' + "x" * 22_000_000 + '"}'
    assert one(spark, long, lambda c: F.length(tx.extract_json(c))) == len(long)
    nested = "[" * 1_500 + "]" * 1_500
    assert one(spark, nested, tx.is_json) is True
    hopeless = "[" * 200_000 + "]" * 200_000
    assert one(spark, hopeless, tx.is_json) is False and one(spark, hopeless, tx.json_too_deep) is True


@pytest.mark.parametrize("parent,code", [("p1", "x = 1\n\ny = 2"), (None, "\nfirst line is blank"), ("p", "")])
def test_header_round_trip(spark, parent, code):
    df = spark.createDataFrame([("a1", 3, parent, code)], "a string, g int, p string, c string")
    text = tx.render_code_file(F.col("a"), F.col("g"), F.col("p"), F.col("c"))
    assert tuple(df.select(tx.parse_code_header(text).alias("h")).first()["h"]) == ("a1", 3, parent, code)


def test_header_defaults(spark):
    assert tuple(one(spark, "x = 1", tx.parse_code_header)) == (None, 0, None, "x = 1")


def test_prompt(spark):
    df = spark.createDataFrame([("t", {"b": 0.5, "a": 1.0, "c": None}, "code {task}")], "t string, m map<string,double>, c string")
    got = df.select(tx.build_prompt(F.col("t"), F.col("m"), F.col("c"), "<{task}>\n{metrics}\n{code}").alias("p")).first()["p"]
    assert got == "<t>\n- a: 1.0000\n- b: 0.5000\ncode {task}"


def test_load_table(spark):
    path = scratch_path(spark, "t") + ".csv"
    spark.createDataFrame([(1, 1.5, "a"), (None, 2.5, "b")], "y int, x double, k string").write.option("header", True).csv(path)
    assert tb.load_table(spark, path, "y int, x double, k string", "y").count() == 1
    assert tb.load_table(spark, path).count() == 2
    with pytest.raises(ValueError):
        tb.load_table(spark, "data.xlsx")


def test_csv_with_quotes_breaks_and_null_words(spark):
    path = scratch_path(spark, "quoted") + ".csv"
    lines = 'y,name,n\n1,"Smith, ""Ann"" and\nBob",3\n0,NA,NA\n1,,4'
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)
    got = [tuple(r) for r in tb.load_table(spark, path, "y int, name string, n int", "y").collect()]
    assert sorted(got, key=str) == sorted([(1, 'Smith, "Ann" and\nBob', 3), (0, None, None), (1, None, 4)], key=str)
    assert tb.load_table(spark, path, "y int, name string, n int", "name").count() == 1


def test_predictions_of_a_batch_are_replaced(spark):
    path = scratch_path(spark, "twice")
    df = spark.createDataFrame([(1, 0.5, "a", "b1"), (2, 0.5, "a", "b2")], "id int, p double, agent_id string, batch string")
    tb.write_predictions(df, path)
    tb.write_predictions(df.filter("batch = 'b1'"), path)
    assert tb.read_predictions(spark, path, "id int, p double, agent_id string, batch string").count() == 2


def test_unfinished_snapshot_is_skipped(spark):
    path = scratch_path(spark, "unfinished")
    empty = {n: spark.createDataFrame([], s) for n, s in tb.ARCHIVE_TABLES.items()}
    code = spark.createDataFrame([("t", "a-1", "x = 1")], tb.ARCHIVE_TABLES["agent_code"])
    agents = spark.createDataFrame([("t", "a-1", "r", None, 0, 1)], tb.ARCHIVE_TABLES["agents"])
    tb.save_archive({**empty, "agent_code": code, "agents": agents}, path, 1)
    agents.write.parquet(f"{path}/snapshot=2/agents")
    assert tb.latest_snapshot(spark, path) == 1
    assert tb.load_agent(spark, path, "a-1").first()["code"] == "x = 1"
    with pytest.raises(ValueError):
        tb.load_archive(spark, path, 2)


def test_no_local_scratch_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_json_lines_skip_bad_ones(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([('{"id": 1}',), ("{oops",), ('{"id": 2}',)], "value string").coalesce(1).write.text(path)
    assert [r["id"] for r in tb.read_json_lines(spark, path, "id int").orderBy("id").collect()] == [1, 2]


def test_latest_snapshot_is_loaded(spark):
    path = scratch_path(spark, "snapshots")
    empty = {n: spark.createDataFrame([], s) for n, s in tb.ARCHIVE_TABLES.items()}
    one = {**empty, "agent_metrics": spark.createDataFrame([("t", 1, "accuracy", 0.5)], tb.ARCHIVE_TABLES["agent_metrics"])}
    tb.save_archive(one, path, 9)
    tb.save_archive(empty, path, 2)
    assert tb.latest_snapshot(spark, path) == 9
    assert tb.load_archive(spark, path)["agent_metrics"].count() == 1
    assert tb.load_archive(spark, path, 2)["agent_metrics"].count() == 0


def test_absent_archive_is_empty(spark):
    got = tb.load_archive(spark, scratch_path(spark, "none"))
    assert set(got) == set(tb.ARCHIVE_TABLES) and all(df.isEmpty() for df in got.values())
