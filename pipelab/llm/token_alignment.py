"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (pieces, which adds the space
itself) the text; both cover the bytes of space + text. All tokens of A and B are sorted
together by where they start; a running maximum of their ends tells where groups break: at a
start that reaches it, no token of either side reaches over. Inside a group every A token is
linked with the B tokens that overlap it.

Neither tokenizer has a token that goes on over a single space between two other characters (checked
for both vocabularies when they are loaded), so a text is cut there into segments, and each distinct segment
is encoded and aligned once for as long as it is remembered. Groups never cross a segment's
border, because tokens of both sides end there.

Aligned texts are stored in *chunks* of whole documents: sizes and the digest of the groups of every document
(the groups themselves where asked for), the id pairs that are linked in the chunk with their numbers of links, and the
links of every document as places among these pairs. Corpus-wide counts come
from the chunks' pairs; each chunk gets back the counts of its own pairs, so nothing that
grows with the corpus is broadcast, and a frequent pair is one row a chunk.

A text that is null, empty, or whose tokens of either side do not give back space + text has
no tokens. Rows of one id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipelab.llm.batches import bound_batches, release

#: Segments a chunk holds at least, but the last one of a task; documents are not cut.
CHUNK_SEGMENTS = 1 << 20
_SEGMENTS_KEPT = 150_000
_LETTERS_KEPT = 1 << 25
_CHUNK_ROWS = 256
_LINKED_AT_ONCE = 1 << 16
SPACE = "▁"
#: A space with a character other than white space (as any of the two tokenizers may see it) on both sides.
_PLAIN = "[^\\s\\x00-\\x20\\u180e\\u200b\\u2581\\ufeff]"
BORDER = re.compile(f"(?<={_PLAIN}) (?={_PLAIN})")
_JOINABLE = re.compile(f"{_PLAIN}(?:[^{SPACE}]*{_PLAIN})?", re.DOTALL).fullmatch
_JOINED = 256
#: Ids as text, for vocabularies up to this size.
_DECIMAL = [str(k) for k in range(1 << 17)]

CHUNK_SCHEMA = (
    "chunk long, doc_ids array<long>, sizes binary, digests array<string>, groups array<string>, "
    "width int, links binary, pair_keys array<long>, pair_links array<long>"
)
_ARROW = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())),
    ("width", pa.int32()), ("links", pa.binary()), ("pair_keys", pa.list_(pa.int64())), ("pair_links", pa.list_(pa.int64())),
])


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: a space mark is a space, <0xHH> is a byte."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


def segments(text: str) -> list[str]:
    """The text cut at borders. Where only plain characters, single spaces and line breaks apart from these occur, every space is one."""
    if not text:
        return []
    if (
        text.replace("\n", "x").isprintable() and text[0] != " " and text[-1] != " "
        and not any(x in text for x in ("  ", " \n", "\n ", SPACE))
    ):
        return text.split(" ")
    return BORDER.split(text)


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of every A token and of every B token, and the linked pairs (A token, B token), for tokens of these sizes in bytes, end to end from 0."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    starts, ends = np.concatenate([a_end - a_sizes, b_end - b_sizes]), np.concatenate([a_end, b_end])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.concatenate([[True], starts[order][1:] >= reached[:-1]])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_end - a_sizes, "right")
    links = np.searchsorted(b_end - b_sizes, a_end, "left") - first
    a_token = np.repeat(np.arange(len(a_sizes)), links)
    b_token = np.arange(len(a_token)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
    return group[: len(a_sizes)], group[len(a_sizes) :], a_token, b_token


class _Pool:
    """Numbers appended end to end; room grows by doubling."""

    def __init__(self, kind: type):
        self._room, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self._room):
            grown = np.zeros(max(need, 2 * len(self._room)), self._room.dtype)
            grown[: self.size] = self._room[: self.size]
            self._room = grown
        self._room[self.size : need] = values
        self.size = need

    def values(self) -> np.ndarray:
        return self._room[: self.size]


class Aligner:
    """Aligns segments and remembers them."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self._a.get_vocab()
        self._a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self._a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        self._b_bytes = [piece_bytes(p) for p in pieces]
        for token in (*self._a_bytes, *self._b_bytes):
            if re.search(f"{_PLAIN} ", token.decode(errors="replace")):
                raise ValueError(f"a token goes on over a space: {token!r}")
        self._a_sizes = np.array([len(x) for x in self._a_bytes], np.int64)
        self._b_sizes = np.array([len(x) for x in self._b_bytes], np.int64)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.letters = 0
        self.groups: list[str] = []
        self._sizes = _Pool(np.int32)  # five numbers a segment
        self._pairs = _Pool(np.int64)
        self._uses = _Pool(np.int64)

    def full(self) -> bool:
        return len(self.place) > _SEGMENTS_KEPT or self.letters > _LETTERS_KEPT

    def forget(self) -> None:
        """Keep segments met more than once, the half met most often at most; their places change."""
        uses, words = self._uses.values(), list(self.place)
        keep = np.sort(np.argsort(-uses, kind="stable")[: min(_SEGMENTS_KEPT // 2, int((uses > 1).sum()))])
        kept = [words[k] for k in keep.tolist()]
        groups, sizes, pairs, uses = [self.groups[k] for k in keep.tolist()], self.sizes[keep].ravel(), self.pairs_of(keep), uses[keep] // 2
        self.reset()
        if sum(map(len, kept)) <= _LETTERS_KEPT // 2:
            self._remember(kept, groups, sizes, pairs, uses)

    def _remember(self, words: list[str], groups: list[str], sizes: np.ndarray, pairs: np.ndarray, uses: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.letters += sum(map(len, words))
        self.groups.extend(groups)
        self._sizes.add(sizes)
        self._pairs.add(pairs)
        self._uses.add(uses)

    @property
    def sizes(self) -> np.ndarray:
        """Per segment: tokens of A, of B, groups, links, and 1 where its tokens give back its bytes."""
        return self._sizes.values().reshape(-1, 5)

    def pairs_of(self, places: np.ndarray) -> np.ndarray:
        """Linked pairs of these segments end to end, each as A id * 2^32 + B id."""
        links = self.sizes[:, 3].astype(np.int64)
        starts, n = (np.cumsum(links) - links)[places], links[places]
        return self._pairs.values()[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B over space + each text, end to end, and which texts are given back by them; the others have no ids."""
        a_ids = [e.ids for e in self._a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        b_ids = self._b.encode(texts, num_threads=1)
        whole = np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            raw = f" {t}".encode()
            whole[k] = b"".join(map(self._a_bytes.__getitem__, a_ids[k])) == raw == b"".join(map(self._b_bytes.__getitem__, b_ids[k]))
        flat = [np.array([x for k in np.flatnonzero(whole) for x in ids[k]], np.int64) for ids in (a_ids, b_ids)]
        return flat[0], flat[1], whole

    def learn(self, words: list[str]) -> None:
        """Encode and align new segments, each given without the space that it begins with.

        Segments that begin and end with plain characters are encoded many at a time, put together as a text.
        """
        joint = [w for w in words if _JOINABLE(w)]
        texts = [" ".join(joint[k : k + _JOINED]) for k in range(0, len(joint), _JOINED)]
        a_flat, b_flat, whole = self._encoded(texts)
        odd = [w for w in words if not _JOINABLE(w)] + [w for k in np.flatnonzero(~whole) for w in joint[k * _JOINED : (k + 1) * _JOINED]]
        a_odd, b_odd, good = self._encoded(odd)
        fine = [w for k in np.flatnonzero(whole) for w in joint[k * _JOINED : (k + 1) * _JOINED]] + [w for w, g in zip(odd, good) if g]
        self._align(fine, np.concatenate([a_flat, a_odd]), np.concatenate([b_flat, b_odd]))
        lost = [w for w, g in zip(odd, good) if not g]
        self._remember(lost, [""] * len(lost), np.zeros(5 * len(lost), np.int32), np.zeros(0, np.int64), np.zeros(len(lost), np.int64))

    def _align(self, words: list[str], a_flat: np.ndarray, b_flat: np.ndarray) -> None:
        a_size, b_size = self._a_sizes[a_flat], self._b_sizes[b_flat]
        a_group, b_group, a_token, b_token = coalesce(a_size, b_size)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        a_upto, b_upto = np.searchsorted(np.cumsum(a_size), ends, "right"), np.searchsorted(np.cumsum(b_size), ends, "right")
        upto = np.stack([a_upto, b_upto, a_group[a_upto - 1] + 1, np.searchsorted(a_token, a_upto)], axis=1) if words else np.zeros((0, 4), np.int64)
        table = np.ones((len(words), 5), np.int32)
        table[:, :4] = np.diff(upto, axis=0, prepend=0)
        texts, cuts = self._texts(a_flat, a_group, b_flat, b_group), [0, *upto[:, 2].tolist()]
        groups = [";".join(texts[s:e]) for s, e in zip(cuts, cuts[1:])]
        self._remember(words, groups, table.ravel(), a_flat[a_token] << 32 | b_flat[b_token], np.zeros(len(words), np.int64))

    @staticmethod
    def _texts(a_flat: np.ndarray, a_group: np.ndarray, b_flat: np.ndarray, b_group: np.ndarray) -> list[str]:
        """``a1,a2|b1`` of every group."""

        def joined(flat: np.ndarray, group: np.ndarray) -> list[str]:
            ids = list(map(_DECIMAL.__getitem__, flat.tolist()))
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(ids)]
            return [ids[s] if e - s == 1 else ",".join(ids[s:e]) for s, e in zip(cuts, cuts[1:])]

        return [f"{a}|{b}" for a, b in zip(joined(a_flat, a_group), joined(b_flat, b_group))]

    def locate(self, texts: list[str]) -> list[np.ndarray]:
        """Places of the segments of each text; none of a text that is empty or not given back by its tokens."""
        split = [segments(t) for t in texts]
        new = list(set().union(*split).difference(self.place))
        if new:
            self.learn(new)
        get, good = self.place.__getitem__, self.sizes[:, 4]
        found = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
        uses = self._uses.values()
        uses += np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=len(uses))
        return [x if good[x].all() else x[:0] for x in found]


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _chunk(aligner: Aligner, number: int, docs: list, found: list[np.ndarray], keep_groups: bool) -> pa.RecordBatch:
    flat = np.concatenate(found)
    used = np.bincount(flat, minlength=len(aligner.place))
    distinct = np.flatnonzero(used)
    keys = np.unique(aligner.pairs_of(distinct))
    width = 2 if len(keys) <= 1 << 16 else 4
    sizes, links, digests, groups = np.zeros((len(docs), 4), "<i8"), [], [], []
    counts = np.zeros(len(keys), np.int64)
    for k, places in enumerate(found):
        sizes[k] = aligner.sizes[places, :4].sum(axis=0, dtype=np.int64)
        text = ";".join(map(aligner.groups.__getitem__, places.tolist()))
        digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        groups.append(text)
    for k in range(0, len(flat), _LINKED_AT_ONCE):
        at = np.searchsorted(keys, aligner.pairs_of(flat[k : k + _LINKED_AT_ONCE]))
        counts += np.bincount(at, minlength=len(keys))
        links.append(at.astype(f"<u{width}").tobytes())
    row = {
        "chunk": number, "doc_ids": docs, "sizes": sizes.tobytes(), "digests": digests, "groups": groups if keep_groups else None,
        "width": width, "links": b"".join(links), "pair_keys": keys, "pair_links": counts,
    }
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ARROW], schema=_ARROW)


def _storer(a_path: str, b_path: str, chunk_segments: int, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        docs, found, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK_ROWS):
                part = batch.slice(at, _CHUNK_ROWS)
                if held >= chunk_segments or aligner.full():
                    if docs:  # a chunk refers to segments that are remembered
                        yield _chunk(aligner, number, docs, found, keep_groups)
                        number, docs, found, held = number + 1, [], [], 0
                    if aligner.full():
                        aligner.forget()
                found.extend(aligner.locate(part.column("text").to_pylist()))
                docs.extend(part.column("id").to_pylist())
                held += sum(map(len, found[-part.num_rows :]))
        if docs:
            yield _chunk(aligner, number, docs, found, keep_groups)
        release()

    return run


def write_alignment(
    docs: DataFrame, out: str, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_segments: int = CHUNK_SEGMENTS, keep_groups: bool = False,
) -> None:
    """Encode and align every whole text (null: empty) and write the chunks, with the groups of every document where asked for; no shuffle."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows.mapInArrow(_storer(a_path, b_path, chunk_segments, keep_groups), CHUNK_SCHEMA).write.mode("overwrite").parquet(out)


def open_alignment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """key, a_id, b_id, links, best: links of every id pair in the corpus; best where no pair of its B id has more.

    A B id has at most as many pairs as A has ids.
    """
    summed = chunks.select(F.explode(F.arrays_zip("pair_keys", "pair_links")).alias("p")).groupBy(F.col("p.pair_keys").alias("key")).agg(F.sum("p.pair_links").alias("links"))
    named = summed.select("key", F.shiftright("key", 32).alias("a_id"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "links")
    return named.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b_id")))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids, digests, counted = (batch.column(n)[k].values for n in ("doc_ids", "digests", "counted"))
            sizes = np.frombuffer(batch.column("sizes")[k].as_buffer(), "<i8").reshape(-1, 4)
            facts = [sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3]]
            if counted is None:  # no document of the chunk has tokens
                facts += [np.zeros(len(sizes), np.int64)] * 2
            else:
                at, links = counted.field("at").to_numpy(), np.frombuffer(batch.column("links")[k].as_buffer(), f"<u{batch.column('width')[k].as_py()}")
                ends = np.cumsum(sizes[:, 3])
                for name in ("best", "links"):
                    score = np.zeros(len(at) + 1, np.int64)
                    score[at] = counted.field(name).to_numpy(zero_copy_only=False)
                    upto = np.concatenate([[0], np.cumsum(score[links])])
                    facts.append(upto[ends] - upto[ends - sizes[:, 3]])
            yield pa.RecordBatch.from_arrays(
                [doc_ids, *[pa.array(x) for x in facts], digests],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )
    release()


def measured_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document of a store."""
    chunks = open_alignment(spark, path)
    counts = pair_counts(chunks).select("key", "links", "best")
    asked = chunks.select("chunk", F.posexplode("pair_keys").alias("at", "key"))
    answers = asked.join(counts, "key").groupBy("chunk").agg(F.collect_list(F.struct("at", "links", "best")).alias("counted"))  # as many as the chunk has pairs
    whole = chunks.select("chunk", "doc_ids", "sizes", "digests", "width", "links").join(answers, "chunk", "left").drop("chunk")
    return whole.mapInArrow(
        _measure, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def aligned_groups(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and groups (structs of a_ids and b_ids, in text order) of every document of a store that keeps groups; none without tokens."""
    texts = open_alignment(spark, path).select(F.explode(F.arrays_zip("doc_ids", "groups")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.groups").alias("text"))
    ids = lambda g, side: F.split(F.split_part(g, F.lit("|"), F.lit(side)), ",").cast("array<int>")
    groups = F.transform(F.split("text", ";"), lambda g: F.struct(ids(g, 1).alias("a_ids"), ids(g, 2).alias("b_ids")))
    return texts.select("doc_id", F.when(F.col("text") != "", groups).otherwise(F.array().cast("array<struct<a_ids:array<int>,b_ids:array<int>>>")).alias("groups"))
