"""Document fingerprints: a digest of hashed byte triplets, coded as quartiles.

Every window of ``WINDOW`` bytes gives four byte triplets; each is hashed into one of
``BUCKETS`` counters. A counter is coded in two bits by the quartile of the document's
counters it falls into; a byte for the length, on a log scale, comes first. Two digests
are compared by a difference score with an upper bound, so the likeness lies in 0 to 1.

Empty text: all counters 0, so the digest is all zero; two empty texts are alike (1.0).
Texts shorter than a triplet have no triplet and differ in the length byte only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
WINDOW = 5
#: Offsets of the second and third byte of the triplets taken from a window.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4))
#: Penalty for counters that are 0, 1, 2 or 3 quartiles apart, and for a step of the length byte.
PENALTY = np.array([0, 1, 2, 4], dtype=np.int64)
LENGTH_STEP = 2
#: Differences at or above this share of the buckets count as unlike (likeness 0).
BOUND = 1.0
_CHUNK = 128
_SALT = np.uint32(0x9E3779B1)


def _counts(blobs: list[bytes]) -> np.ndarray:
    """Triplet counters, one row per text."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    raw = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(len(blobs) * BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    owner = np.repeat(np.arange(len(blobs), dtype=np.int64), sizes) * BUCKETS
    left = np.repeat(starts[1:], sizes) - np.arange(len(raw))  # bytes left in the own text
    for k, (b, c) in enumerate(TRIPLETS):
        n = len(raw) - c
        if n <= 0:
            continue
        v = raw[:n] | (raw[b : n + b] << np.uint32(8)) | (raw[c:] << np.uint32(16)) | np.uint32(k << 24)
        v ^= v >> np.uint32(15)
        v *= _SALT
        bucket = (v >> shift).astype(np.int64)
        out += np.bincount((owner[:n] + bucket)[left[:n] > c], minlength=len(out))
    return out.reshape(len(blobs), BUCKETS)


def levels(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile (0 to 3) of every counter, and the length byte, for every text."""
    counts = _counts(blobs)
    ranked = np.sort(counts, axis=1)
    quart = np.zeros(counts.shape, np.uint8)
    for k in (1, 2, 3):
        quart += counts > ranked[:, [k * BUCKETS // 4 - 1]]
    steps = [min(255, round(4 * math.log2(len(b) + 1))) for b in blobs]
    return quart, np.array(steps, np.int64)


def encode(quart: np.ndarray, steps: np.ndarray) -> list[str]:
    packed = quart[:, 0::4] | (quart[:, 1::4] << 2) | (quart[:, 2::4] << 4) | (quart[:, 3::4] << 6)
    return [f"{int(s):02x}{p.tobytes().hex()}" for s, p in zip(steps, packed)]


def decode(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), BUCKETS // 4 + 1)
    packed = raw[:, 1:]
    quart = np.stack([(packed >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(digests), BUCKETS)
    return quart, raw[:, 0].astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 minus the bounded difference of paired digests."""
    gap = np.abs(a[0].astype(np.int8) - b[0].astype(np.int8))
    diff = PENALTY[gap].sum(axis=1) + LENGTH_STEP * np.abs(a[1] - b[1])
    return 1.0 - np.minimum(diff / (BOUND * BUCKETS), 1.0)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _digest_rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [_edited(t, n) for t, n in zip(texts, following)]
    both = levels([t.encode() for t in texts])
    after = levels([t.encode() for t in following])
    changed_bytes = [t.encode() for t in edited]
    changed = levels(changed_bytes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in changed_bytes]),
            pa.array(encode(*both)),
            pa.array(encode(*changed)),
            pa.array(likeness(both, changed)),
            pa.array(likeness(both, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order; the guest row at its end is only somebody's next document."""
    ids: list = []
    texts: list[str] = []
    ended = False
    for batch in batches:
        for start in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(start, _CHUNK).to_pydict()
            for doc, text, guest in zip(part["id"], part["text"], part["guest"]):
                if guest and ended:
                    continue
                ended = ended or guest
                ids.append(doc)
                texts.append(text)
            if len(texts) > _CHUNK:
                yield _digest_rows(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ids[-1:], texts[-1:]
    if len(texts) > 1:
        yield _digest_rows(ids[:-1], texts[:-1], texts[1:])


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text and of its edited text, with the likeness to that and to the next document.

    The next document is the one after it by (id, text), null ids first; after the last comes
    the first. The order is kept by cutting the ids into ranges at ids taken from the data; the
    first rows of a range also go to the end of the range before, so texts are shuffled once.
    Null texts count as empty. An empty table gives an empty result; a single document is its
    own next one. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    seen = rows.agg(
        F.percentile_approx("id", shares, 10 * ranges).alias("cuts"),
        F.min("id").alias("low"),
        F.max(F.col("id").isNull()).alias("nulls"),
    ).first()
    cuts = sorted({c for c in seen["cuts"] or [] if seen["nulls"] or c > seen["low"]}) if ranges > 1 else []
    first = F.col("id").isNull() if seen["nulls"] else F.col("id") == F.lit(seen["low"])
    own = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c).cast("long") for c in cuts])
        # Cuts are distinct and sorted; the number of cuts at or below the id is its range.
        own = F.coalesce(F.size(F.filter(edges, lambda c: c <= F.col("id"))), F.lit(0))
        own = F.when(F.col("id").isNull(), F.lit(0)).otherwise(own)
        opens = F.coalesce(F.array_contains(edges, F.col("id")), F.lit(False))
    else:
        opens = F.lit(False)
    stay = F.struct(own.alias("range"), F.lit(False).alias("guest"), F.lit(0).alias("turn"))
    before = F.struct((own - 1).alias("range"), F.lit(True).alias("guest"), F.lit(0).alias("turn"))
    around = F.struct(F.lit(len(cuts)).alias("range"), F.lit(True).alias("guest"), F.lit(1).alias("turn"))
    places = F.array(stay, F.when(opens, before), F.when(first, around))
    placed = rows.select("id", "text", F.explode(F.array_compact(places)).alias("p")).select("id", "text", "p.*")
    return (
        placed.repartitionById(len(cuts) + 1, "range")
        .sortWithinPartitions("range", "guest", "turn", "id", "text")
        .select("id", "text", "guest")
        .mapInArrow(_walk, RESULT)
    )
