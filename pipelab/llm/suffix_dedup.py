"""Exact removal of repeated substrings by suffix arrays of shards.

Every byte is removed that is covered by a ``LENGTH``-byte string that also starts in a
document with a smaller id. Matches never cross documents and are judged on the input.

1. *Copies.* A text that an earlier document has as a whole is removed as a whole (if it has
   ``LENGTH`` bytes) and takes no further part, since its earliest copy stands for it.
2. *Anchors.* Every window of ``LENGTH`` bytes owns the least of its hashed ``GRAM``-byte
   strings. Equal windows own the same anchor, and neighbouring windows mostly share one.
   Only anchors that occur in two documents matter.
3. *Shards.* The stretch of windows that own such an anchor goes to the shard of the anchor,
   so equal windows meet in one shard. A shard keeps each stretch once, builds the suffix
   array and the permuted common prefixes of all, and finds classes of equal windows; windows
   of a document whose class has an earlier document are repeats.
4. *Spans.* The windows of a document are joined to spans and cut out.

Before each shuffle, what a task already sees in two documents is settled in the task, and
only the earliest document of an anchor or a stretch goes on: a passage that a third of all
documents share reaches a shard once per task. Texts are shuffled once, by id, and read three
times from there.

Null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing. Rows with one id are
no repeats of each other and are each judged against smaller ids; a null id is judged as
larger than all. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelab.llm.suffix_arrays import permuted_lcp, suffix_array

LENGTH = 50
GRAM = 24
#: Bytes of text per shard, on average.
SHARD_BYTES = 12 << 20
_CHUNK_BYTES = 1 << 18
#: Stretches held by a task before they are sent on, and bytes of a suffix array, at most.
_PIECES = 200_000
_ARRAY_BYTES = 1 << 20
_ANCHORS = 1_000_000
_PLACES = 1 << 24
_LOW = np.uint64(_PLACES - 1)
_LAST = np.iinfo(np.int64).max
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 + 8 bytes from every position."""
    h = _TABLE[raw]
    kept = {}
    width = 1
    while width < 16:
        h = h[:-width] * _power(width) + h[width:]
        width *= 2
        kept[width] = h
    h = kept[16][: len(raw) - GRAM + 1] * _power(8) + kept[8][16 : 16 + len(raw) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _owners(hashes: np.ndarray) -> np.ndarray:
    """Position of the least gram of every window, the first among equals.

    Hash and position share 64 bits, so longer arrays are searched in pieces whose positions fit;
    pieces overlap by a window less one gram.
    """
    want = LENGTH - GRAM + 1
    out = np.empty(len(hashes) - want + 1, np.int64)
    for base in range(0, len(out), _PLACES - want + 1):
        part = hashes[base : base + _PLACES]
        least = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= want:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
        out[base : base + len(least)] = (least & _LOW).astype(np.int64) + base
    return out


def anchors(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: document number, anchor hash, first and last window.

    Window numbers count bytes over all blobs end to end; that whole array comes last.
    """
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none.astype(np.uint64), none, none, raw
    hashes = _gram_hashes(raw)
    owner = _owners(hashes)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    windows = np.maximum(sizes - LENGTH + 1, 0)
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(blobs)), windows)
    at = np.arange(windows.sum()) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
    anchor = hashes[owner[at]]
    if not len(at):
        return none, none.astype(np.uint64), none, none, raw
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], anchor[first], at[first], at[last], raw


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows in groups of about _CHUNK_BYTES of text; one long text may be a group of its own."""
    for batch in batches:
        rows: dict[str, list] = {name: [] for name in batch.schema.names}
        held = 0
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pydict()
            for k, text in enumerate(part["text"]):
                if held and held + len(text) > _CHUNK_BYTES:
                    yield rows
                    rows, held = {name: [] for name in rows}, 0
                for name in rows:
                    rows[name].append(part[name][k])
                held += len(text)
        if held or rows["text"]:
            yield rows


def _known(docs: list) -> np.ndarray:
    return np.array([_LAST if d is None else d for d in docs], np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as differences from one to the next, in the fewest bytes that hold them all."""
    steps = np.diff(values, prepend=0)
    for kind in ("i1", "i2", "i4"):
        if not len(steps) or np.abs(steps[1:]).max(initial=0) <= np.iinfo(kind).max:
            return kind.encode() + values[:1].tobytes() + steps[1:].astype(kind).tobytes()
    return b"i8" + values[:1].tobytes() + steps[1:].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) < 10:
        return np.zeros(0, np.int64)
    steps = np.frombuffer(data, data[:2].decode(), offset=10).astype(np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.int64, 1, 2), steps]))


def _short(hashes: np.ndarray) -> np.ndarray:
    """Half of a hash. Two anchors with the same half only bring needless stretches to a shard."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _by_shard(shards: int, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of the hashes that go to each shard."""
    place = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(place[part[0]]), part


def _shared(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(docs, hashes) of hashes in two documents, and the earliest (docs, hashes) of every hash."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    keep = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))) if len(hashes) else np.zeros(0, bool)
    hashes, docs = hashes[keep], docs[keep]
    if not len(hashes):
        return docs, hashes, docs, hashes
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    size = np.diff(np.append(starts, len(hashes)))
    several = np.repeat(size > 1, size)
    return docs[several], hashes[several], docs[starts], hashes[starts]


def _per_doc(docs: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(docs)) if len(docs) else starts
    return pa.RecordBatch.from_arrays(
        [pa.array(docs[starts]), pa.array([hashes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["doc", "hashes"]
    )


def _find_anchors(shards: int):
    """Earliest document of every anchor by shard (shard >= 0), and anchors settled here (shard < 0)."""

    def flush(found: list[np.ndarray], found_docs: list[np.ndarray]) -> pa.RecordBatch:
        docs, hashes, low_docs, low = _shared(np.concatenate(found), np.concatenate(found_docs))
        out: list[tuple[int, bytes, bytes]] = []
        for sign, own, found_hashes in ((-1, docs, hashes), (1, low_docs, low)):
            by_doc = np.argsort(own, kind="stable")
            own, found_hashes = own[by_doc], found_hashes[by_doc]
            for shard, part in _by_shard(shards, found_hashes):
                out.append((shard if sign > 0 else -1 - shard, _packed(own[part]), _short(found_hashes[part]).tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
            ["shard", "docs", "hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        found_docs: list[np.ndarray] = []
        held = 0
        for rows in _chunks(batches):
            doc, anchor, *_ = anchors([t.encode() for t in rows["text"]])
            found_docs.append(_known(rows["id"])[doc])
            found.append(anchor)
            held += len(anchor)
            if held > _ANCHORS:
                yield flush(found, found_docs)
                found, found_docs, held = [], [], 0
        if held:
            yield flush(found, found_docs)

    return run


def _join_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, hashes = [], []
    for batch in batches:
        for shard, d, h in zip(*(batch.column(c).to_pylist() for c in ("shard", "docs", "hashes"))):
            d, h = _unpacked(d), np.frombuffer(h, np.uint32)
            if shard < 0:
                yield _per_doc(d, h)
            else:
                docs.append(d)
                hashes.append(h)
    if docs:
        found_docs, found, _, _ = _shared(np.concatenate(hashes), np.concatenate(docs))
        yield _per_doc(found_docs, found)


def _ranges(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Byte ranges, one row per document: id, tag of its text (0 where the id has one text), starts, ends."""
    order = np.lexsort((starts, tags, docs))
    docs, tags, starts, ends = docs[order], tags[order], starts[order], ends[order]
    cut = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))) if len(docs) else np.zeros(0, np.int64)
    upto = np.append(cut[1:], len(docs)) if len(docs) else cut
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs[cut]), pa.array(tags[cut]),
            pa.array([starts[a:b].tobytes() for a, b in zip(cut, upto)], pa.binary()),
            pa.array([ends[a:b].tobytes() for a, b in zip(cut, upto)], pa.binary()),
        ],
        ["doc", "tag", "starts", "ends"],
    )


def _distinct(pieces: list[bytes], docs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces, the number of each given one among them, and the earliest document of each."""
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
    low = np.full(len(known), _LAST, np.int64)
    np.minimum.at(low, number, docs)
    return list(known), number, low


STRETCHES = "shard int, docs binary, tags binary, starts binary, sizes binary, hashes binary, bytes binary"


def _cut_stretches(shards: int):
    """Stretches of their earliest document by shard; those of later documents are settled repeats (shard < 0)."""

    def flush(pieces: list[bytes], facts: list[np.ndarray], turn: int) -> pa.RecordBatch:
        docs, tags, starts, hashes = np.concatenate(facts, axis=1)
        _, number, low = _distinct(pieces, docs)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        lead = docs == low[number]
        rows = []

        def put(shard: int, part: np.ndarray, blob: bytes) -> None:
            mark = (hashes[part].view(np.uint64) >> np.uint64(56)).astype(np.uint8).tobytes()
            rows.append((shard, *(_packed(x[part]) for x in (docs, tags, starts, sizes)), mark, blob))

        settled = np.flatnonzero(~lead)
        if len(settled):
            put(-1 - turn % shards, settled, b"")
        mine = np.flatnonzero(lead)
        for shard, part in _by_shard(shards, hashes[mine].view(np.uint64)):
            part = mine[part]
            put(shard, part, b"".join([pieces[k] for k in part.tolist()]))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 7))],
            ["shard", "docs", "tags", "starts", "sizes", "hashes", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        facts: list[np.ndarray] = []
        turn = 0
        for rows in _chunks(batches):
            blobs = [t.encode() for t in rows["text"]]
            doc, anchor, first, last, raw = anchors(blobs)
            cut = np.searchsorted(doc, np.arange(len(blobs) + 1))
            wanted = np.zeros(len(doc), bool)
            for k, parts in enumerate(rows["hashes"]):
                a, b = cut[k], cut[k + 1]
                wanted[a:b] = np.isin(_short(anchor[a:b]), np.frombuffer(b"".join(parts), np.uint32))
            doc, anchor, first, last = doc[wanted], anchor[wanted], first[wanted], last[wanted]
            blob = raw.tobytes()
            pieces += [blob[s:e] for s, e in zip(first.tolist(), (last + LENGTH).tolist())]
            begins = np.concatenate(([0], np.cumsum(list(map(len, blobs)))))[:-1]
            ids, tags = _known(rows["id"]), np.array(rows["tag"], np.int64)
            facts.append(np.stack([ids[doc], tags[doc], first - begins[doc], anchor.view(np.int64)]))
            if len(pieces) > _PIECES:
                yield flush(pieces, facts, turn)
                pieces, facts, turn = [], [], turn + 1
        if pieces:
            yield flush(pieces, facts, turn)

    return run


def repeated_windows(pieces: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the pieces that an earlier document has: piece, first and last window."""
    distinct, number, low = _distinct(pieces, docs)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(distinct), np.uint8)
    array = suffix_array(text)
    opens = permuted_lcp(text, array)[array] < LENGTH
    owner = np.repeat(low, sizes)
    left = np.repeat(begins + sizes, sizes) - np.arange(len(text))
    owner[left < LENGTH] = _LAST
    starts = np.flatnonzero(opens)
    least = np.minimum.reduceat(owner[array], starts)
    first_doc = np.empty(len(text), np.int64)
    first_doc[array] = np.repeat(least, np.diff(np.append(starts, len(text))))
    # Every given piece looks up the classes of its windows.
    windows = sizes[number] - LENGTH + 1
    ends = np.cumsum(windows)
    which = np.repeat(np.arange(len(number)), windows)
    offset = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
    later = first_doc[np.repeat(begins[number], windows) + offset] < docs[which]
    fresh = np.concatenate(([True], which[1:] != which[:-1]))
    rises = np.flatnonzero(later & (fresh | ~np.concatenate(([False], later[:-1]))))
    closes = np.concatenate((fresh[1:], [True])) | ~np.concatenate((later[1:], [False]))
    falls = np.flatnonzero(later & closes)
    return which[rises], offset[rises], offset[falls]


def _search_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: list[bytes] = []
    facts: list[np.ndarray] = []
    for batch in batches:
        for row in batch.to_pylist():
            docs, tags, starts, sizes = (_unpacked(row[c]) for c in ("docs", "tags", "starts", "sizes"))
            if row["shard"] < 0:
                yield _ranges(docs, tags, starts, starts + sizes)
                continue
            ends = np.cumsum(sizes)
            pieces += [row["bytes"][a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            facts.append(np.stack([docs, tags, starts, np.frombuffer(row["hashes"], np.uint8)]))
    if not pieces:
        return
    docs, tags, starts, hashes = np.concatenate(facts, axis=1)
    # A shard that came out large is searched in parts; equal windows have the same anchor.
    parts = min(256, 1 + sum(map(len, pieces)) // _ARRAY_BYTES)
    place = hashes % parts
    for k in range(parts):
        some = np.flatnonzero(place == k)
        if len(some):
            which, first, last = repeated_windows([pieces[j] for j in some.tolist()], docs[some])
            own = some[which]
            yield _ranges(docs[own], tags[own], starts[own] + first, starts[own] + last + LENGTH)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges as maximal runs in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist()))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256).to_pydict()
            sizes, removed, runs, kept, digests = [], [], [], [], []
            for text, tag, copy, spans in zip(rows["text"], rows["tag"], rows["copy"], rows["spans"]):
                blob = text.encode()
                if copy:
                    cut = [(0, len(blob))] if len(blob) >= LENGTH else []
                else:
                    own = [s for s in spans or [] if s["tag"] == tag]
                    cut = merged(*(np.frombuffer(b"".join(s[c] for s in own), np.int64) for c in ("starts", "ends")))
                rest, upto = [], 0
                for a, b in cut:
                    rest.append(blob[upto:a])
                    upto = b
                rest.append(blob[upto:])
                left = b"".join(rest)
                sizes.append(len(blob))
                removed.append(len(blob) - len(left))
                runs.append(len(cut))
                kept.append(left)
                digests.append(hashlib.sha256(left).hexdigest())
            ids = [None if d == _LAST else d for d in rows["id"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, total // shard_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(shards, "id")
    summed = rows.select("id", F.md5("text").alias("sum"))
    first = summed.groupBy("sum").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = summed.join(first, "sum").filter("id > first").groupBy("id").agg(F.collect_set("sum").alias("copies"))
    several = summed.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("several"))
    known = copies.join(several, "id", "full_outer")
    # The side that joins the dealt texts is small per id, so the texts are not sorted for it.
    base = dealt.join(known.hint("shuffle_hash"), "id", "left").select(
        "id", "text", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0)).alias("tag"), F.coalesce(F.array_contains("copies", F.md5("text")), F.lit(False)).alias("copy")
    )
    fresh = base.filter(~F.col("copy"))
    route = F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.col("shard"))
    wanted = (
        fresh.select("id", "text")
        .mapInArrow(_find_anchors(shards), "shard int, docs binary, hashes binary")
        .repartitionById(shards, route)
        .mapInArrow(_join_anchors, "doc long, hashes binary")
        .groupBy(F.col("doc").alias("id"))
        .agg(F.collect_list("hashes").alias("hashes"))
    )
    spans = (
        fresh.join(wanted.hint("shuffle_hash"), "id")
        .select("id", "text", "tag", "hashes")
        .mapInArrow(_cut_stretches(shards), STRETCHES)
        .repartitionById(shards, route)
        .mapInArrow(_search_shard, "doc long, tag long, starts binary, ends binary")
        .groupBy(F.col("doc").alias("id"))
        .agg(F.collect_list(F.struct("tag", "starts", "ends")).alias("spans"))
    )
    return (
        base.join(spans.hint("shuffle_hash"), "id", "left")
        .select("id", "text", "tag", "copy", "spans")
        .mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
