"""CSV with line breaks inside quoted fields, read in parallel.

A file is cut into splits like any text. Whether a split begins inside a quoted field is known
once every split before it is: each split is a function of two states (what state it ends in when it
begins outside, and when it begins inside a field), and these functions are composed along
the file. With the first states known, every split puts its own records together; a record
that lies over a border comes from its first and last lines, which are the only rows that are shuffled.

Quotes follow the rules of Spark's parser: a field is quoted when its first character is a
quote, doubled quotes belong to the field, what follows a closing quote belongs to it up to the
comma or the line break. Lines end with a line feed, with or without a carriage return. Blank lines are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelab.functions.numeric import SMALL_ROWS
from pipelab.session import cut_lineage

OPTIONS = {"escape": '"', "multiLine": "true"}
_OPENS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+\Z').match
_CLOSES = re.compile(r'[^"]*+(?:""[^"]*+)*+"').match

_FACTS = "file long, block long, out0 boolean, out1 boolean, broken0 long, broken1 long, closed1 long, opened0 long, opened1 long, header0 boolean"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line."""
    if inside:
        closing = _CLOSES(line)
        if closing is None:
            return True
        comma = line.find(",", closing.end())
        if comma < 0:
            return False
        line = line[comma + 1 :]
    return _OPENS(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), block (start of the split), at (order inside the split) and value of every line."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Pieces of a batch that lie in one split."""
    file, block = (batch.column(n).to_numpy() for n in ("file", "block"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


class _Track:
    """One split, begun in one of the two states."""

    def __init__(self, inside: bool):
        self.inside, self.broken = inside, 0
        self.closed: int | None = None  # line on which the record ends that the split began inside of
        self.opened: int | None = None  # line on which the record begins that is open now
        self.header = False
        self._waits = inside

    def take(self, line: str, at: int, first: bool) -> None:
        now = ends_inside(line, self.inside)
        if now and not self.inside:
            self.opened, self.header = at, first
        if self._waits and not now:
            self.closed, self._waits = at, False
        self.inside = now
        self.broken += now


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, tracks, seen = None, (), False

    def row() -> pa.RecordBatch:
        out, turned = tracks
        values = [*held, out.inside, turned.inside, out.broken, turned.broken, turned.closed, out.opened if out.inside else None,
                  turned.opened if turned.inside and not turned._waits else None, out.header]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5, pa.bool_()]
        names = [f.split()[0] for f in _FACTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for split, part in _runs(batch):
            if split != held:
                if held is not None:
                    yield row()
                held, tracks, seen = split, (_Track(False), _Track(True)), False
            some = part.filter(part.column("value").is_valid())
            for line, at in zip(some.column("value").to_pylist(), some.column("at").to_pylist()):
                first = not seen and split[1] == 0 and bool(line.strip())
                seen = seen or first
                if '"' in line:
                    for t in tracks:
                        t.take(line, at, first)
    if held is not None:
        yield row()


def split_states(lines: DataFrame) -> DataFrame:
    """Per split: inside (how it begins), broken (line breaks inside fields), and the places of its records that lie over its borders.

    One row a split; the window over the splits of a file sees no text.
    """
    marked = lines.withColumn("value", F.when((F.col("block") == 0) | F.contains("value", F.lit('"')), F.col("value")))
    facts = cut_lineage(marked.mapInArrow(_facts, _FACTS))
    along = Window.partitionBy("file").orderBy("block")
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    turns = (F.col("out0") & ~F.col("out1")).cast("int")
    counted = facts.withColumn("__turns", F.sum(turns).over(upto))
    settled = F.last(F.when(F.col("out0") == F.col("out1"), F.struct("out0", "__turns")), ignorenulls=True).over(before)
    known = counted.withColumn("__last", settled).withColumn("__before", F.coalesce(F.lag("__turns").over(along), F.lit(0)))
    odd = (F.col("__before") - F.coalesce(F.col("__last.__turns"), F.lit(0))) % 2 == 1
    state = known.withColumn("inside", F.coalesce(F.col("__last.out0"), F.lit(False)) != odd)
    pick = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    placed = state.select(
        "file", "block", "inside", pick("broken0", "broken1").alias("broken"), pick("out0", "out1").alias("open"),
        F.when(F.col("inside"), F.col("closed1")).alias("closed"), pick("opened0", "opened1").alias("opened"),
        (~F.col("inside") & F.col("header0")).alias("header"),
    )
    begun = F.col("opened").isNotNull().cast("int")
    return placed.withColumn("ends", F.coalesce(F.sum(begun).over(before), F.lit(0))).withColumn("begins", F.sum(begun).over(upto))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in one split, and whether each is the header of its file."""
    held, state, skip, parts, header = None, False, False, [], False
    for batch in batches:
        for split, part in _runs(batch):
            if split != held:
                held, parts, header = split, [], split[1] == 0
                state = skip = part.column("inside")[0].as_py()
            records, kinds = [], []
            for line in part.column("value").to_pylist():
                if state or '"' in line:
                    state = ends_inside(line, state) if '"' in line else state
                    parts.append(line)
                    if state:
                        continue
                    line, parts = "\n".join(parts), []
                if skip:  # the end of a record of an earlier split
                    skip = False
                elif line.strip():
                    records.append(line.removesuffix("\r"))
                    kinds.append(header)
                    header = False
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(kinds, pa.bool_())], ["value", "header"])


def _over_borders(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Records that lie in several splits."""
    cut = states.filter("inside OR open").drop("broken")
    cut = F.broadcast(cut) if cut.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else cut
    near = lines.join(cut, ["file", "block"])
    ending = F.col("inside") & (F.col("closed").isNull() | (F.col("at") <= F.col("closed")))
    beginning = F.coalesce(F.col("at") >= F.col("opened"), F.lit(False))
    pieces = near.filter(ending | beginning).select(
        "file", F.when(ending, F.col("ends")).otherwise(F.col("begins")).alias("record"), F.struct("block", "at", "value").alias("p"), (beginning & F.col("header")).alias("header")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["value"]), "\n")
    return pieces.groupBy("file", "record").agg(joined.alias("value"), F.max("header").alias("header")).select(
        F.regexp_replace("value", "\r$", "").alias("value"), "header"
    )


def _parsed(spark: SparkSession, records: DataFrame, **options) -> DataFrame:
    """Spark's own reading of a table of records."""
    reader = spark.read.options(**OPTIONS, **options)
    return DataFrame(reader._jreader.csv(getattr(records.select("value")._jdf, "as")(spark._jvm.Encoders.STRING())), spark)


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of CSV files with a header each; fields by position. Without a schema the types are inferred in one more pass."""
    lines = _lines(spark, path)
    states = split_states(lines)
    broken = states.agg(F.sum("broken"), F.max("inside")).first()
    plain = not broken[0] and not broken[1]
    if plain and schema is not None:  # no field holds a line break: lines are records
        return spark.read.schema(schema).options(escape='"', header="true").csv(path)
    begun = states.filter("inside").select("file", "block", "inside")
    small = begun.limit(SMALL_ROWS + 1).count()
    if small > SMALL_ROWS:  # a shuffled join would lose the order of the lines
        reader = spark.read.options(header="true", **OPTIONS)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    placed = lines.join(F.broadcast(begun), ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    found = placed.select("file", "block", "inside", "value").mapInArrow(_whole, "value string, header boolean").unionByName(_over_borders(lines, states))
    records = found.filter("NOT header").select("value")
    if schema is None:
        head = found.filter("header").limit(1).select("value")
        names = _parsed(spark, spark.createDataFrame(head.collect(), "value string"), header="true").columns
        kinds = _parsed(spark, records, inferSchema="true").schema.fields
        known = dict(enumerate(f.dataType for f in kinds))
        schema = T.StructType([T.StructField(n, known.get(k, T.StringType())) for k, n in enumerate(names)])
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("value", ddl, OPTIONS).alias("r")).select("r.*")
