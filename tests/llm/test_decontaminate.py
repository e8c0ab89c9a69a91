import random
import re
from collections import defaultdict

from llm_texts import prose
from pyspark.sql import functions as F

from pipelab.llm import decontaminate as dc


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def weighted(words):
    if not words:
        return {}
    if len(words) < 5:
        return {tuple(words): len("".join(words))}
    return {tuple(words[k : k + 5]): sum(map(len, words[k : k + 5])) for k in range(len(words) - 4)}


def grams(words):
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]


def brute(rows, items, least=0.8):
    out = {}
    for doc, text in rows:
        words = words_of(text)
        for item, passage in items:
            target = words_of(passage)
            if not target or not words:
                continue
            want, best = weighted(target), 0.0
            spots = {}
            for k, h in enumerate(grams(words)):
                spots.setdefault(h, []).append(k)
            starts = {k - j for j, h in enumerate(grams(target)) for k in spots.get(h, [])}
            for s in {max(0, min(x, len(words) - len(target))) for x in starts}:
                have = weighted(words[s : s + len(target)])
                both = sum(v for k, v in want.items() if k in have)
                best = max(best, both / (sum(want.values()) + sum(have.values()) - both))
            if best >= least:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def test_matches_brute_force(spark, docs, texts):
    passage = prose(99, 30)
    words = passage.split()
    items = [
        (1, passage), (2, passage.upper().replace(" ", " , ")), (3, " ".join(words[:14] + ["odd"] + words[15:])), (4, prose(55, 25)),
        (5, None), (6, ""), (7, "one"), (8, "Two, words!"), (9, prose(6, 5000)[3000:3300]), (10, "x x x x x x x x"), (1, passage),
        (11, " ".join(words[:29] + ["end"])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(docs, bench).collect()}
    want = brute_every_start(texts, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(11, 1), (12, 1), (13, 2), (8, 7), (9, 7), (10, 8)} <= set(got)
    shuffled = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench, broadcast_rows=1).collect()}
    assert shuffled == set(want)
    leaked = {d for d, _ in want}
    stay = [r["doc_id"] for r in dc.without_leaks(docs, bench).collect()]
    assert sorted(map(str, stay)) == sorted(str(d) for d, _ in texts if d not in leaked)


def brute_every_start(rows, items, least=0.8):
    out = {}
    for doc, text in rows:
        words = words_of(text)
        held = weighted(words)
        for item, passage in items:
            want = weighted(words_of(passage))
            n = len(words_of(passage))
            if not want or not words or n >= 5 and not want.keys() & held.keys():
                continue  # a window shares shingles only where the document does
            for s in range(max(0, len(words) - n) + 1):
                have = weighted(words[s : s + n])
                both = sum(v for k, v in want.items() if k in have)
                alike = both / (sum(want.values()) + sum(have.values()) - both)
                if alike >= least:
                    out[doc, item] = max(alike, out.get((doc, item), 0))
    return out


def test_every_start_is_compared(spark):
    """Item 1 of the fixed words is at 0.804 from a start that lays no shared shingle on its place, else at 0.763."""
    rng, rows, items = random.Random(3), [], []
    for k in range(100, 140):
        words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(rng.randint(50, 59))]
        items.append((k, " ".join(words)))
        for _ in range(2):
            words.insert(rng.randrange(2, len(words) - 2), rng.choice("xyz") * rng.randint(1, 12))
        rows.append((k, " ".join(["left"] * 7 + words + ["right"] * 7)))
    words = (
        "jeahbh ahbbji agdgffgci ca aggjbeiic ehgbeb d effjea iahfebicj fggccd d fh cec ccdcdjgah ef cd afhiffhbe hagidc ddbccd g e adhjej g hjb ha "
        "eieahbadd dj ff ficbjjiic hib ebf fi jeh hbbghi dg f ejjdghfcb h cfiifcdjh eh iicgie h fidgjbage hgigag ab g bgffajffj ca cejgce dabjefbeb "
        "jajhff idffbjgif j ei gi"
    ).split()
    items += [(1, " ".join(words)), (2, "seldom seen"), (3, "one")]
    rows.append((1, " ".join(["left"] * 7 + words[:3] + ["x" * 11] + words[3:5] + ["x" * 9] + words[5:] + ["right"] * 7)))
    rows += [(2, "they are seldom seen in a pair of texts"), (3, "no one"), (4, "seldom or seen but not in a row"), (5, "seldom seen")]
    want = brute_every_start(rows, items)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(docs, bench).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert (1, 1) in set(want) - set(brute(rows, items)) and {(2, 2), (3, 3), (5, 2)} <= set(want) and (4, 2) not in want


def test_empty_sides(spark, docs, empty, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(docs, none).count() == 0 and dc.find_leaks(empty, none).count() == 0
    assert dc.without_leaks(docs, none).count() == len(texts)


def test_plan_has_no_python(spark, docs):
    plan = dc.find_leaks(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_blocks_cut_all_bits():
    found = defaultdict(int)
    edges = [round(k * dc.BITS / (dc.RADIUS + 1)) for k in range(dc.RADIUS + 2)]
    for a, b in zip(edges, edges[1:]):
        for k in range(a, b):
            found[k] += 1
    assert dict(found) == {k: 1 for k in range(dc.BITS)}


def test_unequal_weights_lose_no_window(spark):
    """Items of 49 five-letter words and a last word of up to 200 letters; the document has another last word."""
    rng, rows, items = random.Random(12), [], []
    for size in (5, 100, 150, 200):
        for _ in range(40):
            k = len(items)
            words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(49)]
            items.append((k, " ".join([*words, "x" * size])))
            rows.append((k, " ".join(["before"] * 3 + words + ["y" * size] + ["after"] * 3)))
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {k for k in brute_every_start(rows[:1] + rows[40:41] + rows[80:81] + rows[120:121], items)}
    assert {d for d, _ in want} == {0, 40, 80, 120} and got == {(k, k) for k in range(160)}


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    passage = prose(99, 30)
    rows = [(None, passage), (None, prose(3, 30)), (5, prose(4, 20) + " " + passage), (5, prose(5, 30)), (6, prose(6, 30)), (5, prose(5, 30))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r["doc_id"] for r in dc.find_leaks(docs, bench).collect()} == {None, 5}
    stay = sorted(map(str, (tuple(r) for r in dc.without_leaks(docs, bench).collect())))
    assert stay == sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))


def test_shingles_of_63_letters_vote(spark):
    """A weight of 63 above a multiple of 64 takes 63 bits of the last hash; every vote is counted bit by bit here."""
    weights = [1, 2, 62, 63, 64, 65, 126, 127, 128, 191, 255]
    rows = [(w, [(1000 + w, w)]) for w in weights] + [(0, [(5, 63), (6, 127), (7, 20)])]
    frame = spark.createDataFrame(rows, "k int, s array<struct<h: long, w: int>>")
    got = {r["k"]: r["bits"] for r in frame.select("k", dc.simhash(F.col("s")).alias("bits")).collect()}
    hashed = {
        (r["h"], r["b"], r["part"]): r["x"] & (2**64 - 1)
        for r in frame.selectExpr("explode(s) AS s").selectExpr("s.h", "explode(sequence(0, 63)) AS b").distinct()
        .selectExpr("h", "b", "explode(sequence(0, 3)) AS part").selectExpr("*", "if(part = 0, xxhash64(h, b), xxhash64(h, b, part)) AS x").collect()
    }

    def bit(shingles, b):
        ones = 0
        for h, w in shingles:
            ones += sum(hashed[h, b, part].bit_count() for part in range(1, w // 64 + 1))
            ones += sum(hashed[h, b, 0] >> i & 1 for i in range(w % 64))
        return int(2 * ones > sum(w for _, w in shingles))

    assert got == {k: [bit(s, b) for b in range(64)] for k, s in rows}


def test_leaks_of_63_and_127_letters_are_found(spark):
    rows, items = [], []
    for k, sizes in enumerate([(13, 13, 13, 12, 12), (60, 30, 20, 10, 7)]):
        passage = " ".join("abcde"[i] * n for i, n in enumerate(sizes))
        items.append((k, passage))
        rows.append((k, "some words before " + passage + " and some after"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in dc.find_leaks(docs, bench).collect()} == {(0, 0, 1.0), (1, 1, 1.0)}
    assert dc.without_leaks(docs, bench).count() == 0
