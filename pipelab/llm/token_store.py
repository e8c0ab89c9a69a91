"""Token ids in fixed-width bit packing.

A store is a folder of Parquet files that hold *blocks*. A block packs the ids of some whole
consecutive documents, each id in the fewest bits that hold the vocabulary, little end first,
and carries the document ids, the end of every document inside the block and the block's own
start. Blocks are independent: any of them can be read alone, an id is found by arithmetic
(position * bits), and unpacking is vectorised. Parquet brings atomic commits, so a task that
is lost and run again leaves no half-written or doubled block.

Documents are in ascending order of id over the whole store (null ids first, equal ids by
text), or in an order given as columns. Shards are the ranges written by one task each; their starts come from the shard totals.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_IDS = 1 << 16
#: Shards whose starts are sent to every executor at most; with more the blocks are shuffled to them.
BROADCAST_SHARDS = 500_000
_WORDS_KEPT = 400_000
_CHUNK = 2048
_JOINED = 256
#: What the vocabulary marks the end of a word with; fixed value.
_WORD_END = "</w>"

BLOCK_SCHEMA = (
    "shard int, block int, bits int, start long, n_ids long, "
    "doc_ids array<long>, doc_ends array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit string of ``bits`` bits each."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start``, without touching the bytes around them."""
    first = start * bits
    raw = np.frombuffer(payload, np.uint8, offset=first // 8, count=(first % 8 + count * bits + 7) // 8)
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype(np.uint32)
    flat = np.unpackbits(raw, bitorder="little")[first % 8 :][: count * bits].reshape(count, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and never joins tokens over ASCII white space.

    Words are encoded once each and kept, up to a fixed number, those met more often longest;
    the ids of a text are the ids of its words in order. New words are encoded many at a time
    with a special token of the tokenizer between them, whose id marks where a word ends.
    Words that may hold a special token themselves are left as they are and encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[k for t, k in vocabulary.items() if t.endswith(_WORD_END)]] = True
        special = [t for t in self._tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self._mark_id, self._mark = special[0][0], special[0][1].content
        self._place: dict[str, int] = {}
        self._flat = np.zeros(0, np.uint32)
        self._sizes = np.zeros(0, np.int64)
        self._starts = np.zeros(0, np.int64)
        self._uses = np.zeros(0, np.int64)

    def _ids_of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids_of``, for words of ASCII letters: each has one token that ends a word, its last."""
        groups = [words[k : k + _JOINED] for k in range(0, len(words), _JOINED)]
        coded = self._tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        ends = np.flatnonzero(self._ends_word[ids])
        if len(ends) != len(words):
            return self._ids_of(words)
        return ids, np.diff(ends, prepend=-1)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and the number of ids of each."""
        groups = [words[k : k + _JOINED] for k in range(0, len(words), _JOINED)]
        coded = self._tokenizer.encode_batch_fast([self._mark.join(g) + self._mark for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        ends = np.flatnonzero(ids == self._mark_id)
        return ids[ids != self._mark_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        """A stop after a letter is a token of its own, so such words are put together."""
        stopped = [w for w in words if w[-1] in ".," and "a" <= w[-2:-1] <= "z" and "<" not in w]
        parts = {w[:-1] for w in stopped} | {".", ","} if stopped else set()
        self._learn_whole(list((parts | set(words).difference(stopped)).difference(self._place)))
        if stopped:
            pairs = np.array([[self._place[w[:-1]], self._place[w[-1]]] for w in stopped], np.int64)
            ids, _ = self._gather(pairs.ravel())
            self._add(stopped, ids, self._sizes[pairs].sum(axis=1))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self._place)
        self._place.update(zip(words, range(known, known + len(words))))
        self._flat = np.concatenate([self._flat, ids])
        self._sizes = np.concatenate([self._sizes, sizes]).astype(np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._uses = np.concatenate([self._uses, np.zeros(len(words), np.int64)])

    def _learn_whole(self, words: list[str]) -> None:
        letters = [w for w in words if w.isascii() and w.isalpha()]
        if letters:
            self._add(letters, *self._ids_of_letters(letters))
        other = set(words).difference(letters)
        plain = [w for w in other if "<" not in w]
        if plain:
            self._add(plain, *self._ids_of(plain))
        for w in other.difference(plain):
            ids = np.array(self._tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            self._add([w], ids, np.array([len(ids)]))

    def _gather(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places end to end, and their ends."""
        sizes = self._sizes[used]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self._flat)) < 1 << 31 else np.int64
        at = np.repeat((self._starts[used] - (ends - sizes)).astype(kind), sizes)
        at += np.arange(total, dtype=kind)
        return self._flat[at], ends

    def _forget(self) -> None:
        """Keep the half of the words met most often."""
        words = list(self._place)
        keep = np.sort(np.argsort(-self._uses, kind="stable")[: _WORDS_KEPT // 2])
        self._flat = self._gather(keep)[0]
        self._sizes = self._sizes[keep]
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._uses = self._uses[keep] // 2
        self._place = {words[k]: n for n, k in enumerate(keep.tolist())}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if len(self._place) > _WORDS_KEPT:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        # Lower-casing ASCII words ahead changes no id, but might make a special token of plain text.
        # In other words the tokenizer composes letters before it lower-cases them.
        plain = pc.and_not(pc.string_is_ascii(coded.dictionary), pc.match_substring(coded.dictionary, "<"))
        words = pc.if_else(plain, pc.ascii_lower(coded.dictionary), coded.dictionary).to_pylist()
        # An edge of white space gives an empty word, which has no ids.
        place = np.fromiter(map(self._place.get, words, repeat(-1)), np.int64, len(words))
        unknown = [k for k in np.flatnonzero(place < 0).tolist() if words[k]]
        if unknown:
            asked = [words[k] for k in unknown]
            self._learn(list(dict.fromkeys(asked)))
            place[unknown] = list(map(self._place.__getitem__, asked))
        used = place[coded.indices.to_numpy()]
        counts = np.diff(split.offsets.to_numpy())
        real = used >= 0
        before = np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], np.cumsum(counts)))]
        used = used[real]
        self._uses += np.bincount(used, minlength=len(self._uses))
        ids, ends = self._gather(used)
        return ids, np.diff(np.concatenate(([0], ends))[before])


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _writer(path: str, end_id: int, bits: int, block_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        shard = TaskContext.get().partitionId()
        block, start = 0, 0
        docs: list = []
        parts: list[np.ndarray] = []
        ends: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, docs, parts, ends, held
            row = {
                "shard": shard, "block": block, "bits": bits, "start": start, "n_ids": held,
                "doc_ids": docs, "doc_ends": ends, "payload": pack(np.concatenate(parts), bits),
            }
            block, start = block + 1, start + held
            docs, parts, ends, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("start", pa.int64()),
            ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
            ("payload", pa.binary()),
        ])
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                chunk = batch.slice(at, _CHUNK)
                ids, sizes = encoder.encode(chunk.column("text"))
                cut = np.concatenate(([0], np.cumsum(sizes)))
                for k, doc in enumerate(chunk.column("id").to_pylist()):
                    parts.append(np.append(ids[cut[k] : cut[k + 1]], np.uint32(end_id)))
                    held += len(parts[-1])
                    docs.append(doc)
                    ends.append(held)
                    if held >= block_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_store(
    docs: DataFrame, out: str, tokenizer_path: str, end_id: int, vocabulary: int,
    id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, order: tuple[Column, ...] = (),
) -> None:
    """Encode every whole text (null: empty), end each document with ``end_id`` and write blocks.

    The text is shuffled once, by ranges of the id, or of the columns of ``order`` where these are
    given; documents are stored in that order. A block holds ``block_ids`` ids or a few
    more, since documents are not cut; one very long document makes a larger block of its own.
    An empty table writes an empty store. Only the two named columns and those of ``order`` are read.
    """
    places = [f"order{k}" for k in range(len(order))]
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[c.alias(name) for c, name in zip(order, places)],
    )
    (
        rows.repartitionByRange(*[F.col(c) for c in places], F.col("id"), F.xxhash64("text"))
        .sortWithinPartitions(*places, "id", "text")
        .select("id", "text")
        .mapInArrow(_writer(tokenizer_path, end_id, bits_for(vocabulary), block_ids), BLOCK_SCHEMA)
        .write.mode("overwrite").option("compression", "none").parquet(out)
    )


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``first``, the number of ids in the store before the block."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    small = totals.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    return blocks.join(F.broadcast(bases) if small else bases, "shard").withColumn("first", F.col("base") + F.col("start"))


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
            ends = np.array(row["doc_ends"], np.int64)
            begins = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the stored blocks: place, number of ids and checksum of the ids."""
    blocks = open_store(spark, path).select("bits", "n_ids", "first", "doc_ids", "doc_ends", "payload")
    return blocks.mapInArrow(_read_docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_at(spark: SparkSession, path: str, position: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids of the store from ``position``, reading the blocks they lie in."""
    blocks = open_store(spark, path).filter(
        (F.col("first") < position + count) & (F.col("first") + F.col("n_ids") > position)
    )
    found = [
        unpack(r["payload"], r["bits"], max(0, position - r["first"]),
               min(r["n_ids"], position + count - r["first"]) - max(0, position - r["first"]))
        for r in blocks.orderBy("first").toLocalIterator()
    ]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
