"""Statistics of texts that quality rules are made of.

A module of its own, so that the Python workers load neither training code nor pandas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelab.llm.batches import release

STATS = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "marks", "symbols", "letters",
    "marked_words", "same_next", "distinct_words", "top_word", "distinct_pairs", "log_lines", "same_lines",
)

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT[48:58] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_EDGE = tuple(bytes([k]) for k in range(256) if _SYMBOL[k] or k == ord("!"))


def text_statistics(text: str) -> tuple[float, ...]:
    raw = text.encode()
    words = raw.split()
    if not words:
        return (float(np.log1p(len(text))),) + (0.0,) * (len(STATS) - 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return (
        float(np.log1p(len(text))), float(np.log1p(n)), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n,
        upper / max(1, upper + lower), int(seen[_DIGIT].sum()) / size, int(seen[_MARK].sum()) / size,
        int(seen[_SYMBOL].sum()) / size, (upper + lower) / size, sum(w.endswith(_EDGE) for w in words) / n,
        same / n, len(counts) / n, max(counts.values()) / n, len(pairs) / n,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The statistics of each text, in the order of STATS."""
    for texts in parts:
        yield pa.array([text_statistics(t.as_py() or "") for t in texts], pa.list_(pa.float64()))
    release()
