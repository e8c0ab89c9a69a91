import hashlib

import numpy as np

from pipelab.llm import fingerprint as fp


def test_digest_round_trip_and_bounds():
    quart, steps = fp.levels([b"", b"ab", b"some longer text " * 9])
    again = fp.decode(fp.encode(quart, steps))
    assert (again[0] == quart).all() and (again[1] == steps).all()
    assert fp.likeness((quart, steps), (quart, steps)).tolist() == [1.0] * 3
    far = fp.likeness((quart, steps), (quart[::-1], steps[::-1]))
    assert ((far >= 0) & (far <= 1)).all()


def test_counts_match_a_plain_loop():
    blobs = [b"hello world", b"", b"xyz", bytes(range(256))]
    want = np.zeros((4, fp.BUCKETS), int)
    for d, blob in enumerate(blobs):
        for k, (b, c) in enumerate(fp.TRIPLETS):
            for i in range(len(blob) - c):
                v = blob[i] | blob[i + b] << 8 | blob[i + c] << 16 | k << 24
                v ^= v >> 15
                want[d, (v * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - fp.BUCKETS.bit_length() + 1)] += 1
    assert (fp._counts(blobs) == want).all()


def test_neighbours_follow_the_order_of_ids(spark, docs, texts):
    got = {}
    for r in fp.fingerprint_neighbours(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert sum(map(len, got.values())) == len(order)
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert want in {(r["n_chars"], r["edited_sha256"]) for r in got[doc]}
    by_text = {d: t for d, t in texts}
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] and by_text[1] == by_text[2]
    assert got[14][0]["near_edited"] > got[14][0]["near_next"]


def test_single_and_empty(spark, docs, empty):
    assert fp.fingerprint_neighbours(empty).count() == 0
    one = fp.fingerprint_neighbours(docs.filter("doc_id = 11")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
