"""Language identification of mixed-language text.

The script of a word narrows the languages that come into question; letter n-grams learned
from labelled texts give each word a score per language; a Viterbi pass with a penalty for
every change of language labels the words, so that neighbouring words of one language form
spans. A text's language is the one whose spans hold most letters.

Texts that are null or have no letter are ``und`` with score 0. A script that no learned
language uses leaves its words without evidence. Without any learned language all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: First code points of scripts, each range up to the next one; fixed values.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA4D0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)

BUCKETS = 1 << 15
#: Expected number of labelled texts per language used for fitting, chosen by hash of the id.
FIT_DOCS = 3_000
PENALTY = 14.0
#: A language keeps a script if at least this share of its learned letters is in it.
SCRIPT_SHARE = 0.001
_WORDS_KEPT = 300_000
_CHUNK = 256


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets (1 to 3 letters, word edges included) of words end to end.

    Gives the buckets, the word each belongs to, and of every word its number of letters and
    its script (of its last letter).
    """
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    letter = flat != 32
    owner = np.cumsum(~letter) - 1
    x = flat.astype(np.uint64)
    buckets, owners = [], []
    one = (x * np.uint64(2654435761)) % np.uint64(2**31)
    buckets.append(one[letter])
    owners.append(owner[letter])
    if len(flat) > 1:
        two = one[:-1] * np.uint64(31) + one[1:] + np.uint64(17)
        ok = letter[:-1] | letter[1:]
        buckets.append(two[ok])
        owners.append(np.where(letter[:-1], owner[:-1], owner[1:])[ok])
    if len(flat) > 2:
        three = (one[:-2] * np.uint64(961) + one[1:-1] * np.uint64(31) + one[2:]) * np.uint64(3) + np.uint64(29)
        ok = letter[1:-1]
        buckets.append(three[ok])
        owners.append(owner[1:-1][ok])
    h = np.concatenate(buckets)
    h ^= h >> np.uint64(17)
    h *= np.uint64(0x9E3779B97F4A7C15)
    letters = np.bincount(owner[letter], minlength=len(words))
    script = np.zeros(len(words), np.int64)
    script[owner[letter]] = _SCRIPT_OF[np.searchsorted(_STARTS, flat[letter], "right") - 1]
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(owners), letters, script


def letters_only(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray  # buckets x languages, log probabilities
    scripts: np.ndarray  # scripts x languages, 0 where in question


class _Scorer:
    """Scores of words, kept for words seen before up to a fixed number."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.place) > _WORDS_KEPT:
            self._reset()
        place = self.place
        new = list({w for words in texts for w in words if w not in place})
        if new:
            for w in new:
                place[w] = len(place)
            clean = [letters_only(w) for w in new]
            some = [k for k, w in enumerate(clean) if w]
            scores = np.zeros((len(new), len(self.model.languages)))
            letters = np.zeros(len(new), np.int64)
            if some:
                h, owner, n, script = _ngrams([clean[k] for k in some])
                got = np.zeros((len(some), scores.shape[1]))
                for k in range(scores.shape[1]):
                    got[:, k] = np.bincount(owner, self.model.scores[h, k], len(some))
                narrow = self.model.scripts[script]
                narrow[np.isinf(narrow).all(axis=1)] = 0
                got = np.where(np.isinf(narrow), -1e6, got)
                got[np.isinf(self.model.scripts[script]).all(axis=1)] = 0
                scores[some], letters[some] = got, n
            self.scores = np.vstack([self.scores, scores])
            self.letters = np.concatenate([self.letters, letters])
        get = place.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word on the best path; ``scores`` is words x languages.

    Staying with the best language throughout is the best path when no stretch of words
    gains more than half a penalty by another language; that is tested first, in whole arrays.
    (A path with s switches has at most s + 1 stretches of other languages, which is 2 s at most from
    one switch on; without a switch the best language has the largest sum.)
    """
    if not len(scores):
        return np.zeros(0, np.int64)
    best = int(scores.sum(axis=0).argmax())
    gain = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores - scores[:, [best]], axis=0)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(scores), best, np.int64)
    width = range(scores.shape[1])
    value = [0.0] * scores.shape[1]
    back: list[tuple[int, list[bool]]] = []
    for row in scores.tolist():
        top = max(value)
        lead = value.index(top)
        enter = top - penalty
        moved = [v < enter for v in value]
        back.append((lead, moved))
        value = [(enter if moved[k] else value[k]) + row[k] for k in width]
    at = value.index(max(value))
    path = np.zeros(len(scores), np.int64)
    for k in range(len(scores) - 1, -1, -1):
        path[k] = at
        lead, moved = back[k]
        if moved[at]:
            at = lead
    return path


def spans(words: list[str], path: np.ndarray, languages: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """Runs of words with one label: first word, word after the last, language."""
    if not len(path):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(words)]
    return [(a, b, languages[path[a]]) for a, b in zip(cuts, cuts[1:])]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            for text, lang in zip(*(c.to_pylist() for c in (batch.slice(at, _CHUNK).column("text"), batch.slice(at, _CHUNK).column("lang")))):
                words = [w for w in map(letters_only, text.split()) if w]
                if words:
                    h, _, letters, script = _ngrams(words)
                    into = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES)))
                    into[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                    into[BUCKETS:] += np.bincount(script, letters, len(_NAMES))
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["lang", "feature", "n"]
        )


def fit_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Letter n-gram scores from labelled texts for which ``keep`` holds.

    Of a language with more than ``fit_docs`` texts a share is taken, by hash of the id, that
    gives about so many; the model has languages x (buckets + scripts) numbers at most.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if keep is None else keep)
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(1.0)
    for lang, n in counts.items():
        if n > fit_docs:
            share = F.when(F.col("lang") == lang, fit_docs / n).otherwise(share)
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    summed = chosen.mapInArrow(_count_grams, "lang string, feature long, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    languages = tuple(sorted(counts))
    table = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    for r in summed.collect():
        table[languages.index(r["lang"]), r["feature"]] = r["n"]
    grams = table[:, :BUCKETS] + 0.5
    scores = np.log(grams / grams.sum(axis=1, keepdims=True)).T if languages else np.zeros((BUCKETS, 0))
    if languages:
        scores = scores - scores.mean(axis=1, keepdims=True)
    scripts = table[:, BUCKETS:]
    in_use = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return LanguageModel(languages, scores, np.where(in_use.T & (scripts.T > 0), 0.0, -np.inf))


def _labeller(model: LanguageModel, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                chunk = batch.slice(at, _CHUNK)
                texts = [t.split() for t in chunk.column("text").to_pylist()]
                langs, scores, marked = [], [], []
                for words, rows in zip(texts, scorer.rows(texts)):
                    letters = scorer.letters[rows]
                    if not model.languages or not letters.sum():
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        marked.append([])
                        continue
                    own = scorer.scores[rows]
                    path = viterbi(own, penalty)
                    held = np.bincount(path, letters, len(model.languages))
                    top = int(held.argmax())
                    total = own.sum(axis=0) / max(1.0, np.sqrt(len(rows)))
                    belief = 1.0 / np.exp(np.minimum(total - total[top], 50.0)).sum()
                    langs.append(model.languages[top])
                    scores.append(float(held[top] / held.sum() * belief))
                    marked.append([{"first": a, "end": b, "lang": x} for a, b, x in spans(words, path, model.languages)])
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(marked, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return run


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans (first word, word after the last, language) of every row; no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(
        _labeller(model, penalty), "doc_id long, lang_pred string, score double, spans array<struct<first int, end int, lang string>>"
    )
