"""Token-set similarity of two descriptions, 0 to 100."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word (or big integer) per step.

    Bit i of the state is 0 once position i of `a` is part of a longest match (Hyyro 2004).
    """
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & places.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best of three comparisons of the common tokens and of each side's remaining tokens.

    100 when one token set contains the other and both share a token. Case is kept.
    """
    if not a or not b:
        return 0.0
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    common = left & right
    if common and (left == common or right == common):
        return 100.0
    rest_a, rest_b = " ".join(sorted(left - common)), " ".join(sorted(right - common))
    shared = len(" ".join(common))
    joint = shared + 1 if common else 0
    apart = len(rest_a) + len(rest_b) - 2 * lcs_length(rest_a, rest_b)
    score = 100.0 * (1 - apart / (2 * joint + len(rest_a) + len(rest_b)))
    if common:
        for rest in (rest_a, rest_b):
            score = max(score, 100.0 * 2 * shared / (2 * shared + 1 + len(rest)))
    return score


@F.pandas_udf(DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def description_score(a: Column, b: Column) -> Column:
    """`token_set_ratio` of two text columns (Arrow batches)."""
    return _score(a, b)


#: Letters are counted in that many classes; classes that hold several letters only make the bound weaker.
LETTER_CLASSES = 64


def _letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each class of letters is in the distinct words of each text, joined by blanks, and the lengths."""
    joined = [" ".join(set(t.split())) for t in texts]
    lengths = np.array([len(t) for t in joined])
    letters = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32) % LETTER_CLASSES
    counts = np.zeros((len(texts), LETTER_CLASSES), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(texts)), lengths), letters), 1)
    return counts, lengths


def pairs_by_letters(batches, min_score: float):
    """Pairs of two lists of texts (columns 0 and 1) whose common letters allow the first comparison to reach `min_score`."""
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (counts_a, length_a), (counts_b, length_b) = _letter_counts(left), _letter_counts(right)
            held = [k for k in range(LETTER_CLASSES) if counts_a[:, k].any() and counts_b[:, k].any()]
            names = np.array(right, object)
            for i, text in enumerate(left):
                common = sum((np.minimum(counts_a[i, k], counts_b[:, k]) for k in held), np.zeros(len(right), np.int32))
                found = names[(common > 0) & (200.0 * common >= min_score * (length_a[i] + length_b) - 1e-6)].tolist()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([text] * len(found), pa.string()), pa.array(found, pa.string())], names=["a", "b"])
