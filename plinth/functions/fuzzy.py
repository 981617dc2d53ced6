"""String similarity: trigram sets, and ratios from longest common subsequences."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plinth.session import workers_find_package


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's alphanumeric words, each padded by two spaces before and one after."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        F.transform(found, lambda w: F.concat(F.lit("  "), w, F.lit(" "))),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of the two; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence: a bit for each place of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        met = open_ & where.get(ch, 0)
        open_ = (open_ + met | open_ - met) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    """The ratio of the two texts with their words in order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's shared words with its others; 100 if one side has no others."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, x, y = left & right, " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and not (x and y):
        return 100.0
    s = len(" ".join(sorted(both)))
    gap = 1 if s else 0
    n, m = s + gap + len(x), s + gap + len(y)
    best = 100.0 * (1 - (len(x) + len(y) - 2 * lcs(x, y)) / (n + m))
    if s:
        best = max(best, 100.0 * (1 - (gap + len(x)) / (s + n)), 100.0 * (1 - (gap + len(y)) / (s + m)))
    return best


#: Characters that fit a word of bits; distinct characters of a batch that are worth a table.
_BITS, _ALPHABET = 64, 512


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text as a row of numbers of characters, 0 after its end; the lengths; the characters that the numbers stand for."""
    made = np.array([*texts, ""])
    points = made.view(np.uint32).reshape(len(made), -1)[:-1] if made.dtype.itemsize else np.zeros((len(texts), 0), np.uint32)
    every = np.unique(np.append(points.ravel(), 0))
    return np.searchsorted(every, points), np.fromiter(map(len, texts), np.int64, len(texts)), every


def lcs_batch(a: list[str], b: list[str], need: np.ndarray | None = None) -> np.ndarray:
    """The longest common subsequences' lengths of all pairs of texts at once; -1 where the characters that both have are fewer than ``need``.

    Texts become rows of characters. Their counts bound a subsequence from above; for the
    pairs that are left, each step adds one character of all second texts to bit sets of
    all first ones.
    """
    n = len(a)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    texts, which = np.unique(np.array([*a, *b], dtype=object), return_inverse=True)
    texts = texts.tolist()
    rows, size, every = _characters(texts)
    i, j = which[:n], which[n:]
    swap = size[i] > size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)  # the first is the shorter
    if len(every) > _ALPHABET or any("\0" in t for t in texts):
        for k in range(n):
            x, y = texts[i[k]], texts[j[k]]
            if need is None or sum((Counter(x) & Counter(y)).values()) >= need[k]:
                out[k] = lcs(x, y)
        return out
    some = np.arange(n)
    if need is not None:
        counts = np.zeros((len(texts), len(every)), np.int32)
        for k in range(rows.shape[1]):
            np.add.at(counts, (np.arange(len(texts)), rows[:, k]), 1)
        counts[:, 0] = 0
        both = np.concatenate([np.minimum(counts[i[k : k + 4096]], counts[j[k : k + 4096]]).sum(1) for k in range(0, n, 4096)])
        some = np.flatnonzero(both >= need)
    for k in some[size[i[some]] > _BITS].tolist():
        out[k] = lcs(texts[i[k]], texts[j[k]])
    some = some[size[i[some]] <= _BITS]
    if len(some):
        short, place = np.unique(i[some], return_inverse=True)
        where = np.zeros((len(short), len(every)), np.uint64)
        for k in range(int(size[short].max())):
            where[np.arange(len(short)), rows[short, k]] |= np.uint64(1) << np.uint64(k)
        where[:, 0] = 0
        full = np.where(size[i[some]] == _BITS, ~np.uint64(0), (np.uint64(1) << (size[i[some]] % _BITS).astype(np.uint64)) - np.uint64(1))
        open_ = full.copy()
        for k in range(int(size[j[some]].max())):
            met = open_ & where[place, rows[j[some], k]]
            open_ = ((open_ + met) | (open_ - met)) & full
        out[some] = size[i[some]] - np.bitwise_count(open_)
    return out


def lcs_column(a: Column, b: Column, need: Column | None = None) -> Column:
    """lcs_batch over whole Arrow batches; null where a text is null or ``need`` isn't reached."""
    workers_find_package(SparkSession.active())

    @F.pandas_udf("int")
    def apply(x: pd.Series, y: pd.Series, least: pd.Series) -> pd.Series:
        good = (x.notna() & y.notna()).to_numpy()
        out = pd.array([None] * len(x), dtype="Int32")
        got = lcs_batch(x[good].tolist(), y[good].tolist(), least[good].to_numpy(np.int64))
        out[np.flatnonzero(good)[got >= 0]] = got[got >= 0]
        return pd.Series(out)

    return apply(a, b, F.lit(0) if need is None else need)


def token_sort_column(a: Column, b: Column) -> Column:
    """The ratio of the two texts with their words in order."""
    in_order = lambda c: F.array_join(F.array_sort(_words(c)), " ")
    x, y = in_order(a), in_order(b)
    return F.when(F.length(x) + F.length(y) == 0, 100.0).otherwise(200.0 * lcs_column(x, y) / (F.length(x) + F.length(y)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def set_words(text: Column) -> Column:
    """A text's distinct words in order."""
    return F.array_sort(F.array_distinct(_words(text)))


def token_set_parts(a: Column, b: Column) -> Column:
    """What a token-set score of two texts, given as set_words, is made of: shared (characters of the shared words) and texts (both sides' other words, the smaller text first)."""
    rest = lambda p, q: F.array_join(F.array_except(p, q), " ")
    return F.struct(F.length(F.array_join(F.array_intersect(a, b), " ")).alias("shared"), F.array_sort(F.array(rest(a, b), rest(b, a))).alias("texts"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_set_known(shared: Column | str, first: Column | str, second: Column | str) -> Column:
    """The part of a token-set score that lengths tell: 100 if one side has no other words, else shared words against each side."""
    shared, n, m = _col(shared), F.length(first), F.length(second)
    of = lambda k: 100.0 * (1 - (1 + k) / (2 * shared + 1 + k))
    return F.when(shared > 0, F.when((n == 0) | (m == 0), 100.0).otherwise(F.greatest(of(n), of(m)))).otherwise(0.0)


def token_set_need(shared: Column | str, first: Column | str, second: Column | str, least: Column) -> Column:
    """The length of a common subsequence of the other words from which a token-set score is ``least`` or more; never too large."""
    shared, n, m = _col(shared), F.length(first), F.length(second)
    both = n + m + 2 * (shared + F.when(shared > 0, 1).otherwise(0))
    return F.greatest(F.lit(0), F.ceil((n + m - (1 - least / 100) * both) / 2 - 1e-6)).cast("int")


def token_set_score(shared: Column | str, first: Column | str, second: Column | str, common: Column) -> Column:
    """The whole score, from the subsequence's length; a null length, which can't matter, leaves what is known."""
    shared, n, m = _col(shared), F.length(first), F.length(second)
    gap = F.when(shared > 0, 1).otherwise(0)
    ratio = 100.0 * (1 - (n + m - 2 * _col(common)) / (n + m + 2 * (shared + gap)))
    return F.greatest(token_set_known(shared, first, second), ratio)


def token_set_column(a: Column, b: Column) -> Column:
    """The token-set ratio of two texts, 0 where one has no words."""
    p = token_set_parts(set_words(a), set_words(b))
    parts = p["shared"], F.get(p["texts"], F.lit(0)), F.get(p["texts"], F.lit(1))
    empty = (F.length(F.trim(a)) == 0) | (F.length(F.trim(b)) == 0)
    return F.when(empty, 0.0).otherwise(token_set_score(*parts, lcs_column(*parts[1:])))
