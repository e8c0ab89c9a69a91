import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pipelab.llm import token_store as ts  # noqa: E402
from pipelab.session import scratch_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_packing_is_exact_and_randomly_accessible(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    data = ts.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (ts.unpack(data, bits, 0, 1003) == ids).all()
    for start, count in ((0, 1), (7, 9), (500, 503), (1002, 1), (3, 0)):
        assert (ts.unpack(data, bits, start, count) == ids[start : start + count]).all()


def test_pack_refuses_wide_ids():
    with pytest.raises(ValueError):
        ts.pack(np.array([8], np.uint32), 3)


def test_bits():
    assert [ts.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_words_give_the_ids_of_whole_texts():
    whole = Tokenizer.from_file(PATH)
    encoder = ts.WordEncoder(PATH)
    odd = [
        "a<|endoftext|>B <|startoftext|> It's I'LL x.y. z., q.. 12,345.67 ,a. <|ENDOFTEXT|>", "", "  \n\t",
        "Ünïcode ΑΣ Σ. é ́x İstanbul K. x y. ſt", "a\x0bb\x0cc\x1cd", "x" * 300 + ".", ". , .. ,,",
    ]
    for text in odd:
        assert encoder.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    ids, sizes = encoder.encode(pa.array(odd))
    assert sizes.tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in odd] and sizes.sum() == len(ids)


def test_capitals_are_composed_before_they_are_lowered():
    """J, H, T, W and Y with marks that only their lower case has a letter for."""
    whole = Tokenizer.from_file(PATH)
    encoder = ts.WordEncoder(PATH)
    odd = ["J\u030c", "H\u0331 h\u0331", "xT\u0308.", "W\u030aORD Word WORD word. WORD.", "Y\u030a, <|endoftext|> J\u030c"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in odd]
    ids, sizes = encoder.encode(pa.array(odd))
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    assert len(encoder._place) == len(encoder._uses) == len(encoder._sizes)


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(ts, "_WORDS_KEPT", 20)
    encoder = ts.WordEncoder(PATH)
    whole = Tokenizer.from_file(PATH)
    for k in range(5):
        text = " ".join(f"word{k}{j}. plain" for j in range(30))
        assert encoder.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(encoder._place) < 140


def test_store_round_trip(spark, docs, texts):
    out = scratch_path(spark, "test-store")
    ts.write_store(docs, out, PATH, 2, 49408, block_ids=64)
    got = sorted(ts.read_documents(spark, out).collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(PATH)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert [r["doc_id"] for r in got] == [d for d, _ in order]
    start, stream = 0, []
    for row, (_, text) in zip(got, order):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    for at, n in ((0, 5), (60, 200), (start - 3, 3)):
        assert ts.ids_at(spark, out, at, n).tolist() == stream[at : at + n]


def test_empty_store(spark, empty):
    out = scratch_path(spark, "test-empty-store")
    ts.write_store(empty, out, PATH, 2, 49408)
    assert ts.read_documents(spark, out).count() == 0 and len(ts.ids_at(spark, out, 0, 4)) == 0
