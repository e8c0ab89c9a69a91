import hashlib
import random

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from pipelab.llm import curriculum as cu
from pipelab.llm import html_extract as he
from pipelab.llm import queries
from pipelab.llm import suffix_dedup as sd
from pipelab.llm import token_counts as tc
from pipelab.llm.suffix_arrays import permuted_lcp, suffix_array


def greedy(word, pieces):
    at = total = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                total, at = total + 1, end
                break
        else:
            total, at = total + len(word[at].encode()), at + 1
    return total


def test_automaton_equals_greedy_matching():
    rng = random.Random(2)
    for _ in range(60):
        letters = "abcé"[: rng.randint(1, 4)]
        pieces = {"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 25))}
        machine = tc.PieceAutomaton(pieces)
        for _ in range(60):
            word = "".join(rng.choices(letters + "z", k=rng.randint(0, 14)))
            assert machine.count(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(spark, docs, empty, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = set(tc.pieces_of_model(path))
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tc.count_tokens(docs, path).collect()), key=str)
    want = []
    for doc, text in texts:
        words = [w.decode() for w in (text or "").encode().split()]
        want.append((doc, len(words), sum(greedy(tc.MARK + w, pieces) for w in words)))
    assert got == sorted(want, key=str) and tc.count_tokens(empty, path).count() == 0


def test_targets_fill_up_by_weight(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"s{k}": rng.choice((0, 1, 10, 100, 5000)) for k in range(rng.randint(1, 9))} | {None: 7}
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        want, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
        while free and left > 1e-9:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if want[s] + share[s] > 3 * sizes[s]}
            if not over:
                for s in free:
                    want[s] += share[s]
                break
            for s in over:
                left -= 3 * sizes[s] - want[s]
                want[s] = 3 * sizes[s]
            free -= over
            left = sum(sizes.values()) - sum(want[s] for s in names if s not in free)
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in cu.source_targets(df).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in names), (sizes, got, want)


def test_mixture_takes_whole_copies_near_the_target(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300))), rng.choice(("a", "a", "a", "b", "c", None))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    planned = cu.plan_mixture(docs, range_rows=20).cache()
    plain = cu.plan_mixture(docs.repartition(2)).select("doc_id", "mix_taken")
    assert planned.select("doc_id", "mix_taken").exceptAll(plain).count() == 0 and planned.count() == 500
    for r in planned.groupBy("source").agg(F.sum("mix_taken").alias("taken"), F.max("mix_target").alias("target"), F.max("mix_copies").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 300 and r["most"] <= 3
    order = cu.training_order(planned).collect()
    positions = [r["mix_position"] for r in order]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert sum(r["mix_size"] for r in order) == planned.agg(F.sum("mix_taken")).first()[0]
    # Source c has the rising schedule: less than half of its words lie in the first half.
    c = [r for r in order if r["source"] == "c"]
    early = sum(r["mix_size"] for r in c if r["mix_position"] < 0.5) / sum(r["mix_size"] for r in c)
    assert abs(early - 0.3125) < 0.1


def brute_positions(rows, weights=(5, 2, 1), most=3):
    """(id, size, taken, positions) of (id, text, source) rows, by a fine grid over every schedule."""
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    size = [len((t or "").split()) for _, t, _ in rows]
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * total[s]}
        if not over:
            break
        target |= {s: float(most * total[s]) for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    target |= {s: level * weight[s] for s in free}
    out = []
    for rank, s in enumerate(names):
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, *zip(*cu.SCHEDULES[rank % 3]))
        demand = np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2)))
        mine = sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), k) for k, r in enumerate(rows) if r[2] == s)
        full, before = min(most, target[s] // total[s]), 0
        for _, k in mine:
            copies = 0 if not size[k] else int(full + (full < most and before + size[k] / 2 <= target[s] - full * total[s]))
            share = [(c * total[s] + before + size[k] / 2) / target[s] for c in range(copies)]
            out.append((rows[k][0], size[k], copies * size[k], [float(np.interp(x * demand[-1], demand, grid)) for x in share]))
            before += size[k]
    return out


def mixed_rows():
    rng = random.Random(8)
    return [(k, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300))), rng.choice(("a", "a", "a", "b", "c", None))) for k in range(400)]


def test_positions_equal_brute_force(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    want = {d: places for d, _, _, places in brute_positions(rows)}
    got = cu.documents_in_order(cu.plan_mixture(docs, range_rows=20)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r["mix_positions"]) == len(want[r["doc_id"]]) and np.allclose(r["mix_positions"], want[r["doc_id"]], atol=1e-4)


def test_curriculum_query_comes_in_training_order(spark, tmp_path):
    """The registered query, written and read file by file, follows the first position of every document."""
    rows = mixed_rows()
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    queries.op6_curriculum(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = [r for f in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    want = {d: (size, taken, places) for d, size, taken, places in brute_positions(rows)}
    assert len(got) == len(rows) and all((r["size"], r["taken"]) == want[r["doc_id"]][:2] for r in got)
    first = [(want[r["doc_id"]][2] or [2.0])[0] for r in got]
    assert all(a <= b + 1e-4 for a, b in zip(first, first[1:])) and first[-1] == 2.0


def test_mixture_edge_cases(docs, empty, texts):
    planned = cu.plan_mixture(docs)
    assert planned.count() == len(texts) and planned.filter("mix_size = 0 and mix_taken > 0").count() == 0
    assert set(docs.columns) <= set(planned.columns) and cu.plan_mixture(empty).count() == 0
    assert cu.training_order(cu.plan_mixture(docs.filter("doc_id in (5, 6, 7)"))).count() == 0


def test_inverse_of_a_schedule(spark):
    for knots in cu.SCHEDULES:
        for share in (0.0, 0.1, 0.33, 0.5, 0.9, 1.0):
            t = spark.range(1).select(cu._inverse(F.lit(share), knots)).first()[0]
            grid = np.linspace(0, t, 20001)
            area = np.trapezoid(np.interp(grid, *zip(*knots)), grid)
            whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
            assert abs(area / whole - share) < 1e-6


@pytest.fixture(scope="module")
def content_model():
    return he.fit_content_model(he.labelled_pages())


def test_unseen_layouts(content_model):
    exact = []
    for page in he.labelled_pages(150, seed=77):
        tree = he.parse(page, "data-content")
        want = "\n".join(x for x, m in zip(tree.text, tree.marked) if x is not None and m)
        exact.append(he.extract_texts([page], content_model)[0] == want)
    assert np.mean(exact) > 0.9


def test_messages_equal_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 7
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, n))])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        leaf, unary, edge = rng.integers(0, 2, n), rng.normal(0, 2, (n, 2)), rng.normal(0, 2, (2, 2, 2))
        p, pairs = he.marginals(parent, depth, leaf, unary, edge)
        states = np.array([[s >> k & 1 for k in range(n)] for s in range(1 << n)])
        score = unary[np.arange(n), states].sum(axis=1)
        for k in range(1, n):
            score = score + edge[leaf[k], states[:, parent[k]], states[:, k]]
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        assert np.allclose(p, weight @ states)
        assert np.allclose(pairs[3, 1, 0], weight[(states[:, parent[3]] == 1) & (states[:, 3] == 0)].sum())


def test_page_details(content_model):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href="/a">Home</a></li>'
        '<li><a href="/b">News</a></li></ul></nav><article><h1>A title &amp; more</h1><p>First   line\n with &eacute; and &#8364;. <b>Bold text.<br>Next one.'
        "<p>Second <a title='x>y' href=/z>linked</a> paragraph here. It goes on &lt;so&gt;."
        '</article><footer>&copy; somebody 2020</footer>'
    )
    assert he.extract_texts([page], content_model) == [
        "A title & more\nFirst line with é and €. Bold text. Next one.\nSecond linked paragraph here. It goes on <so>."
    ]
    assert he.extract_texts(["", "<", "<!-- open", "<p", "<script>x", "</div></p>"], content_model) == [""] * 4 + ["", ""]


def test_no_element_hides_text():
    def leaves(page):
        return [x for x in he.parse(page).text if x is not None]

    assert leaves("<p>So <math><mi>x</mi> = <mn>1</mn></math> holds.</p><p>After.") == ["So x = 1 holds.", "After."]
    for name in ("object", "svg", "template", "noscript"):
        assert leaves(f"<article><{name}><p>inside</p><article><p>after</p></article>") == ["inside", "after"]
        assert leaves(f"<{name}>a<{name}>b</{name}>c</{name}><p>d</p>") == ["a", "b", "c", "d"]
        assert leaves(f"<{name}/><p>d</p>") == ["d"]
    assert leaves("<p>a</p><script>no</script><style>no</style><iframe>no</iframe><textarea>no</textarea><p>b") == ["a", "b"]
    assert leaves("<p>a</p><math><p>b</p>") == ["a", "b"]


def test_all_words_of_a_class_are_seen():
    tree = he.parse('<div class="' + " ".join(f"u{'x' * k}" for k in range(30)) + ' sidebar">text</div>')
    assert "sidebar" in tree.names[1] and len(tree.names[1]) == 31


def test_extract_pages(spark, content_model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>" * 3000), (4, "w", "<div>" * 3000 + "deep"), (4, "w", "plain text only.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = he.extract_pages(pages, content_model).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert he.extract_pages(pages.filter("false"), content_model).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for trial in range(150):
        k, n = rng.choice((1, 2, 4, 26, 250)), rng.randint(0, 70)
        text = bytes(rng.randrange(k) for _ in range(n)) * (rng.randint(1, 5) if trial % 4 == 0 else 1)
        raw = np.frombuffer(text, np.uint8)
        array = suffix_array(raw)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(text) > 1:
            lcp = permuted_lcp(raw, array)
            for r in range(1, len(text)):
                a, b = text[array[r] :], text[array[r - 1] :]
                size = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[array[r]] == size


def brute_repeats(rows):
    order = sorted(rows, key=lambda r: r[0] if r[0] is not None else float("inf"))
    out = []
    for doc, text in rows:
        blob = (text or "").encode()
        low = [(t or "").encode() for d, t in order if d is not None and (doc is None or d < doc)]
        covered = bytearray(len(blob))
        for k in range(len(blob) - 49):
            if any(blob[k : k + 50] in t for t in low):
                covered[k : k + 50] = b"\1" * 50
        left = bytes(x for x, c in zip(blob, covered) if not c)
        runs = sum(1 for k in range(len(blob)) if covered[k] and (not k or not covered[k - 1]))
        out.append((doc, len(blob), sum(covered), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def dedup(df):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in cols) for r in sd.remove_repeats(df).collect()), key=str)


def test_repeats_of_edge_cases(docs, empty, texts):
    assert dedup(docs) == brute_repeats(texts) and dedup(empty) == []


def test_repeats_beyond_16_mib_of_a_text(spark):
    """A passage in the tail of a text over 16 MiB, over its 2^24th byte, and a later copy of the tail."""
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, (1 << 24) + 30_000, dtype=np.uint8).tobytes().decode()
    edge, tail, early = long[(1 << 24) - 400 : (1 << 24) + 400], long[-9000:-1000], prose(71, 300)
    rows = [(1, early), (2, long + early), (3, edge + " new words here"), (4, "other new words " + tail)]
    want = [(1, 0, 0), (2, len(early), 1), (3, 800, 1), (4, 8000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(d, removed, spans) for d, _, removed, spans, _ in dedup(df)] == want


def test_repeats_of_passages(spark, monkeypatch):
    monkeypatch.setattr(sd, "_ANCHORS", 300)
    monkeypatch.setattr(sd, "_PIECES", 100)
    monkeypatch.setattr(sd, "_ARRAY_BYTES", 3000)
    monkeypatch.setattr(sd, "_CHUNK_BYTES", 2000)
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdef ", k=rng.choice((49, 50, 51, 80, 300)))) for _ in range(12)] + ["ab" * 60, "z" * 90]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            parts.append(p if rng.random() < 0.6 else p[rng.randrange(len(p)) :])
            parts.append("".join(rng.choices("ghijkl ", k=rng.choice((0, 1, 30)))))
        rows.append((rng.randrange(50), "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dedup(df) == brute_repeats(rows)
