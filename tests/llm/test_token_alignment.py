import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pipelab.llm import token_alignment as ta  # noqa: E402
from pipelab.session import scratch_path  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "plain words, and more.", "two  spaces and\ta tab \n next\nline ", " leading", "   ", "\n", "a▁b c", "x <|endoftext|> y", "<0x41> <s> </s> <unk>",
    "Ünïcödé 漢字 한국어 \U0001f600\U0001f600 é", "a b 　 c d", "NUL\x00 in \x1c text", "\x85next   line", "12345 6 7.89 it's I'LL",
    "﻿bom ﻿ x", "x" * 500, "a ​ b ᠎ c", "� ퟿", "(a) [b] {c}; -- 'd' \"e\" ...  f", "word▁ ▁word",
]


def brute_groups(text, a, b):
    """Groups of ids, and linked id pairs, of a whole text; None where it has no tokens."""
    if not text:
        return None
    raw = f" {text}".encode()
    letters = {k: v for k, v in ta.byte_letters().items()}
    sides = []
    for ids, tokens in (
        (e := a.encode(f" {text}", add_special_tokens=False)) and (e.ids, [bytes(letters[c] for c in t) for t in e.tokens]),
        (ids_b := b.encode(text)) is not None and (ids_b, [ta.piece_bytes(b.id_to_piece(k)) for k in ids_b]),
    ):
        if b"".join(tokens) != raw:
            return None
        at, spans = 0, []
        for k, t in zip(ids, tokens):
            spans.append((k, at, at + len(t)))
            at += len(t)
        sides.append(spans)
    cuts = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups, start = [], 0
    for cut in cuts:
        groups.append([[k for k, s, e in side if start <= s and e <= cut] for side in sides])
        start = cut
    links = [(i, j) for i, s, e in sides[0] for j, s2, e2 in sides[1] if s < e2 and s2 < e]
    return groups, links


def brute(rows):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found = [(d, brute_groups(t, a, b)) for d, t in rows]
    counts = Counter(p for _, f in found if f for p in f[1])
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(n, top.get(j, 0))
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _measured(spark, df, **options):
    out = scratch_path(spark, "test-alignment")
    ta.write_alignment(df, out, A, B, **options)
    return out, ta.measured_documents(spark, out)


def test_coalescing_small():
    a_group, b_group, a_token, b_token = ta.coalesce(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert a_group.tolist() == [0, 1, 1] and b_group.tolist() == [0, 0, 1]
    assert list(zip(a_token.tolist(), b_token.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert [len(x) for x in ta.coalesce(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0, 0]


def test_segments_give_the_tokens_of_whole_texts():
    rng = random.Random(4)
    bits = [*"ab.,'1\n\t éß漢 ▁　\U0001f600", "  ", " the", " it's", "word", "\r\n", "​", "́", " ", " "]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000)]
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    aligner = ta.Aligner(A, B)
    for text, places in zip(texts, aligner.locate(texts)):
        want = brute_groups(text, a, b)
        got = ";".join(aligner.groups[k] for k in places.tolist())
        assert got == (";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want[0]) if want else ""), text
        pairs = Counter((int(k) >> 32, int(k) & 0xFFFFFFFF) for k in aligner.pairs_of(places).tolist())
        assert pairs == Counter(want[1] if want else [])


def test_fast_cut_is_that_of_borders():
    rng = random.Random(9)
    for text in ODD + ["".join(rng.choices("ab .\n\té\u3000\u2581\x00", k=rng.randint(1, 12))) for _ in range(5000)] + ["one two\nthree four"]:
        assert ta.segments(text) == ta.BORDER.split(text)
    assert ta.segments("") == []


def test_many_pairs_take_wide_places(monkeypatch):
    aligner = ta.Aligner(A, B)
    found = aligner.locate([prose(k, 50) for k in range(20)])
    narrow = ta._chunk(aligner, 0, list(range(20)), found, False).to_pylist()[0]
    monkeypatch.setattr(ta, "_LINKED_AT_ONCE", 7)
    again = ta._chunk(aligner, 0, list(range(20)), found, False).to_pylist()[0]
    assert narrow == again and narrow["width"] == 2 and sum(narrow["pair_links"]) == len(narrow["links"]) // 2


def test_equals_brute_force(spark, docs, texts):
    assert _rows(_measured(spark, docs)[1]) == brute(texts)


def test_small_chunks_and_forgetting_change_nothing(spark, texts, monkeypatch):
    rows = texts + [(100 + k, t) for k, t in enumerate(ODD)] + [(200 + k, prose(1, 50)) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out, got = _measured(spark, df.repartition(3), chunk_segments=40)
    assert _rows(got) == brute(rows)
    assert ta.open_alignment(spark, out).filter("size(doc_ids) > 0").count() > 3


def test_forgetting_keeps_results(texts, monkeypatch):
    whole, aligner, forgot = ta.Aligner(A, B), ta.Aligner(A, B), 0
    monkeypatch.setattr(ta, "_SEGMENTS_KEPT", 60)
    for text in [t or "" for _, t in texts] + ODD + [prose(k % 5, 40) for k in range(30)]:
        if aligner.full():
            aligner.forget()
            forgot += 1
            assert len(aligner.place) == len(aligner.groups) == len(aligner.sizes) <= 30
        (got,), (want,) = aligner.locate([text]), whole.locate([text])
        assert [aligner.groups[k] for k in got.tolist()] == [whole.groups[k] for k in want.tolist()]
        assert (aligner.sizes[got] == whole.sizes[want]).all() and (aligner.pairs_of(got) == whole.pairs_of(want)).all()
    assert forgot > 10


def test_groups_can_be_read_back(spark, docs, texts):
    out, _ = _measured(spark, docs, keep_groups=True)
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    want = []
    for d, t in texts:
        found = brute_groups(t, a, b)
        want.append((d, [tuple(g) for g in found[0]] if found else []))
    got = [(r["doc_id"], [(g["a_ids"], g["b_ids"]) for g in r["groups"]]) for r in ta.aligned_groups(spark, out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark, empty):
    out, got = _measured(spark, empty)
    assert got.count() == 0 and ta.aligned_groups(spark, out).count() == 0 and ta.pair_counts(ta.open_alignment(spark, out)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "a▁b")], "doc_id long, text string")
    assert _rows(_measured(spark, blank)[1]) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_chunks_reach_python_few_at_a_time(spark):
    """Rows of some megabytes come in batches bounded by bytes."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    big = spark.range(0, 120, 1, 1).selectExpr("cast(repeat('x', 4000000) as binary) AS b")
    assert max(r["n"] for r in big.mapInArrow(sizes, "n long").collect()) < 300_000_000
