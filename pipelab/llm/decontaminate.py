"""Benchmark decontamination with DataFrame operations only.

A document leaks an item when a window of the item's length is similar to the item: weighted
Jaccard of the sets of five-word shingles at least ``SIMILARITY``, the weight of a shingle
being the number of its letters and digits. Case and punctuation do not count.

1. *Windows.* A window is similar only if the shingles it shares with the item weigh at least
   ``SIMILARITY`` of the item. Every shingle of every document is joined with the items'
   shingles, which are broadcast when counted small; running sums over the shared places of a
   document and an item give every start whose window has that weight, and all of these are
   compared.
2. *Fingerprints.* Window and item get a 64-bit SimHash of their shingles. A shingle of weight w
   votes on every bit as w shingles of weight 1 would, each with a hash of its own, so the angle between
   fingerprints follows the weighted overlap however unequal the weights are. It is cut
   into ``RADIUS`` + 1 blocks; fingerprints at most ``RADIUS`` bits apart agree in a block,
   so an equality join on (item, block, value) finds all of them.
3. *Verification.* The weighted Jaccard of the shingle sets themselves decides.

At a similarity of 0.8 fingerprints differ in about 10 bits (standard deviation 3), so a
radius of 24 loses no window but those 5 deviations out; higher similarities are nearer.

Null and empty texts have no shingles and match nothing. Rows with a null id are looked at like all others. A text or item of one to four words
is one shingle as a whole; such an item matches every document that has these words in a row.
Rows of one id give one result an item, the best; what is removed is decided for each id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 24
#: Item shingles sent to every executor at most; above it the join shuffles.
BROADCAST_ROWS = 500_000
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _hash_at(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hash of the ``n`` words from every position; of all words where they are fewer."""
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    several = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: _hash_at(words, i, n))
    return F.when(F.size(words) >= n, several).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def weighted_shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct (hash, weight) pairs."""
    one = F.struct(F.xxhash64(F.concat_ws(" ", words)).alias("h"), F.length(F.concat_ws("", words)).alias("w"))

    def at(i: Column) -> Column:
        letters = sum((F.length(F.get(words, i + k)) for k in range(1, n)), F.length(F.get(words, i)))
        return F.struct(_hash_at(words, i, n).alias("h"), letters.alias("w"))

    several = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), at)
    return F.array_distinct(F.when(F.size(words) >= n, several).otherwise(F.array(one)))


def simhash(shingles: Column, bits: int = BITS) -> Column:
    """Fingerprint as an array of bits: the sign of the votes of all shingles, one vote for each letter."""

    def vote(b: Column) -> Column:
        def ones(s: Column) -> Column:
            """Votes for the bit among the ``w`` of a shingle: set bits of as many hashed ones."""
            full = F.when(s["w"] < 64, F.lit(0)).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(s["w"] / 64), F.lit(1)).cast("int")), F.lit(0), lambda acc, k: acc + F.bit_count(F.xxhash64(s["h"], b, k)))
            )
            rest = F.xxhash64(s["h"], b).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), (s["w"] % 64).cast("int"))))
            return full + F.bit_count(rest)

        total = F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + 2 * ones(s) - s["w"])
        return (total > 0).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), vote)


def _blocks(fingerprint: Column, bits: int, radius: int) -> Column:
    """(number, bits as text) of ``radius`` + 1 blocks of nearly equal width."""
    edges = [round(k * bits / (radius + 1)) for k in range(radius + 2)]
    cut = [F.concat_ws("", F.slice(fingerprint, a + 1, b - a).cast("array<string>")) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.struct(F.lit(k).alias("block"), c.alias("value")) for k, c in enumerate(cut)])


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + s["w"])


def prepare_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items with at least a word: item_id, item_key of the row, size in words, shingles, fingerprint."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    shingled = words.dropDuplicates(["item_id", "words"]).select(
        "item_id", F.xxhash64("item_id", F.concat_ws(" ", "words")).alias("item_key"), F.size("words").alias("n"),
        weighted_shingles(F.col("words")).alias("item_shingles"),
    )
    return shingled.withColumn("item_bits", simhash(F.col("item_shingles")))


def _short_hashes(words: Column, n: int) -> Column:
    """Hash of the ``n`` words from every position, as an item of ``n`` words has it."""
    several = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, n))))
    return F.when(F.size(words) >= n, several).otherwise(F.array().cast("array<bigint>"))


def _starts(hits: DataFrame) -> DataFrame:
    """doc_key, item_key, and ranges (low to high) of starts whose window holds shared shingles of weight ``need``.

    ``hits`` has a row for every shared place: doc_key, item_key, reach (places in a window less
    one), need, pos, w. A place counts for the windows that start at most ``reach`` before it.
    """
    together = ["doc_key", "item_key", "reach", "need"]
    enough = (
        hits.groupBy(*together).agg(F.sum("w").alias("total"), F.collect_list(F.struct("pos", "w")).alias("places"))
        .filter("total >= need")
        .select(*together, F.explode("places").alias("p"))
    )
    events = enough.select(
        *together,
        F.explode(F.array(
            F.struct((F.col("p.pos") - F.col("reach")).alias("low"), F.col("p.w").cast("long").alias("change")),
            F.struct((F.col("p.pos") + 1).alias("low"), (-F.col("p.w")).cast("long").alias("change")),
        )).alias("e"),
    ).select(*together, "e.*")
    along = Window.partitionBy(*together).orderBy("low")
    return (
        events.withColumn("held", F.sum("change").over(along.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("high", F.lead("low").over(along) - 1)
        .filter("held >= need and low <= high")
        .select("doc_key", "item_key", "low", "high")
    )


def _row_leaks(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, similarity: float, radius: int, broadcast_rows: int
) -> DataFrame:
    """doc_key (of id and text), doc_id, item_id, similarity and start of every similar window."""
    ready = prepare_items(items, item_id_col, item_text_col)
    places = ready.select(
        "item_key", F.when(F.col("n") >= SHINGLE, F.col("n") - SHINGLE).otherwise(0).alias("reach"), (_weight(F.col("item_shingles")) * similarity - 1e-6).alias("need"), F.explode("item_shingles").alias("s")
    ).select("item_key", "reach", "need", "s.h", "s.w")
    small = places.limit(broadcast_rows + 1).count() <= broadcast_rows
    short = [r["n"] for r in ready.filter(F.col("n") < SHINGLE).select("n").distinct().collect()]
    worded = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc_key"), words_of(F.col(text_col)).alias("words")
    )
    spots = worded.select("doc_key", F.posexplode(shingle_hashes(F.col("words"))).alias("pos", "h"))
    for n in short:
        spots = spots.unionByName(worded.filter(F.size("words") > n).select("doc_key", F.posexplode(_short_hashes(F.col("words"), n)).alias("pos", "h")))
    hits = spots.join(F.broadcast(places) if small else places, "h")
    found = _starts(hits).groupBy("doc_key").agg(F.collect_list(F.struct("item_key", "low", "high")).alias("ranges"))
    last = F.greatest(F.lit(0), F.size("words") - F.col("n"))
    windows = (
        worded.join(found, "doc_key")
        .select("doc_key", "doc_id", "words", F.explode("ranges").alias("r"))
        .select("doc_key", "doc_id", "words", "r.*")
        .join(F.broadcast(ready) if small else ready, "item_key")
        .withColumns({"low": F.greatest(F.lit(0), F.col("low")), "high": F.least(F.col("high"), last)})
        .filter("low <= high")
        .withColumn("start", F.explode(F.sequence("low", "high")))
    )
    cut = windows.select("doc_key", "doc_id", "item_key", "item_id", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("window")).distinct()
    hashed = cut.withColumn("shingles", weighted_shingles(F.col("window"))).withColumn("bits", simhash(F.col("shingles")))
    probes = hashed.select(
        "doc_key", "doc_id", "item_key", "item_id", "start", "shingles", "bits", F.explode(_blocks(F.col("bits"), BITS, radius)).alias("b")
    ).select("*", "b.block", "b.value")
    index = ready.select("item_key", "item_shingles", "item_bits", F.explode(_blocks(F.col("item_bits"), BITS, radius)).alias("b")).select(
        "item_key", "item_shingles", "item_bits", "b.block", "b.value"
    )
    apart = F.aggregate(F.zip_with("bits", "item_bits", lambda a, b: F.abs(a - b)), F.lit(0), lambda acc, x: acc + x)
    near = (
        probes.join(F.broadcast(index) if small else index, ["item_key", "block", "value"])
        .filter(apart <= radius)
        .dropDuplicates(["doc_key", "item_key", "start", "shingles"])
    )
    shared = _weight(F.array_intersect("shingles", "item_shingles"))
    alike = shared / (_weight(F.col("shingles")) + _weight(F.col("item_shingles")) - shared)
    return near.withColumn("similarity", alike).filter(F.col("similarity") >= similarity).select("doc_key", "doc_id", "item_id", "similarity", "start")


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, item_id, similarity (of the best window) and start (its first word) of every leak."""
    found = _row_leaks(docs, items, id_col, text_col, item_id_col, item_text_col, similarity, radius, broadcast_rows)
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best"))
        .select("doc_id", "item_id", "best.similarity", "best.start")
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows of ``docs`` whose own text leaks no item, whatever other rows have their id; a null id is one like others."""
    found = _row_leaks(docs, items, id_col, text_col, item_id_col, item_text_col, similarity, radius, broadcast_rows)
    leaks = found.select(F.col("doc_key").alias("__leak")).distinct()
    return docs.join(leaks, F.xxhash64(docs[id_col], docs[text_col]) == F.col("__leak"), "left_anti")
