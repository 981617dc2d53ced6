"""Quality classifier: weak labels from heuristics, and a hashed linear scorer trained on them.

Heuristic labellers look at each document and vote good, bad or nothing. How often each
pattern of votes occurs is counted over all documents; expectation-maximisation on
these counts estimates each labeller's accuracies and the share of good documents, and
gives each pattern a posterior. A linear scorer over hashed features (shapes of words
and binned measures) learns the posteriors of a bounded sample of documents.

A second head of the same scorer learns the human label ``toxic`` from a bounded
sample of labelled documents, over hashed words and their beginnings. A document is kept if the first head finds it good and
the second doesn't find it toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.byte_bpe import _replaced, _with
from plinth.llm.common import column, columns_of, map_arrow, small, utf8

#: Documents that each head is trained on, at most: those with the smallest hashes.
SAMPLE = 20_000
#: Documents of the sample that must have a feature; the pull of weights for toxicity towards zero.
LEAST_DOCS, LASSO = 4, 0.06
#: Bytes of a word's beginning that are a feature of their own; from which toxicity on documents go.
PREFIX, MOST_TOXIC = 5, 0.4
BITS = 18
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_RUN = re.compile(rb"([^\w\s])\1\1")
_WORD = re.compile(r"[^\W\d_]+")
_ASCII = bytes(range(128))
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_APART = bytes(32 if b in _SYMBOLS else b for b in range(256))


class Measures(NamedTuple):
    """What the labellers look at; shares are of words unless said otherwise."""

    words: int
    distinct: float
    symbols: float  # of bytes
    symbol_runs: float
    bars: float
    upper: float
    mean_length: float
    commonest: float
    repeated_lines: float  # of lines
    letters: float  # of characters
    repeated_pairs: float  # of pairs of neighbouring words
    packed: float  # size after deflation, of bytes


def _letters(data: bytes) -> tuple[int, int]:
    """Characters of a text, and those of them that are letters."""
    n = len(data.translate(None, _NOT_LETTERS))
    if data.isascii():
        return len(data), n
    try:
        chars, beyond = len(data.decode()), data.translate(None, _ASCII).decode()
        return chars, n + sum(map(len, _WORD.findall(beyond)))
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
        return len(text), sum(map(len, _WORD.findall(text)))


def measure(data: bytes) -> Measures:
    words = data.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    symbols = (len(data) - len(data.translate(None, _SYMBOLS))) / max(1, len(data))
    chars, letters = _letters(data)
    return Measures(
        len(words),
        len(counts) / n,
        symbols,
        len(_RUN.findall(data)) / n,
        sum(counts.get(w, 0) for w in (b"|", b"/", b"-", b"*")) / n,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
        sum(map(len, words)) / n * chars / max(1, len(data)),
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        letters / max(1, chars),
        1 - len(set(pairwise(words))) / max(1, len(words) - 1),
        len(zlib.compress(data, 1)) / max(1, len(data)),
    )


#: Labellers: (name, bad if, good if) by thresholds on a measure; in between they don't vote.
LABELLERS = (
    ("few_symbols", lambda m: m.words >= 8 and m.symbols > 0.09, lambda m: m.symbols < 0.06),
    ("many_distinct_words", lambda m: m.words >= 20 and m.distinct < 0.45, lambda m: m.distinct > 0.6),
    ("no_symbol_runs", lambda m: m.symbol_runs > 0.1, lambda m: m.symbol_runs < 0.02),
    ("no_bars", lambda m: m.bars > 0.1, lambda m: m.bars < 0.02),
    ("not_upper_case", lambda m: m.words >= 5 and m.upper > 0.5, lambda m: m.upper < 0.2),
    ("usual_word_length", lambda m: not 2.5 <= m.mean_length <= 7.5, lambda m: 3.5 <= m.mean_length <= 6.5),
    ("no_word_prevails", lambda m: m.words >= 20 and m.commonest > 0.2, lambda m: m.commonest < 0.1),
    ("lines_differ", lambda m: m.repeated_lines > 0.4, lambda m: m.repeated_lines < 0.1),
    ("mostly_letters", lambda m: m.words >= 8 and m.letters < 0.7, lambda m: m.letters > 0.76),
    ("pairs_differ", lambda m: m.words >= 20 and m.repeated_pairs > 0.35, lambda m: m.repeated_pairs < 0.15),
    ("hard_to_pack", lambda m: m.words >= 20 and m.packed < 0.22, lambda m: m.packed > 0.3),
)


def votes(m: Measures) -> str:
    """A letter for each labeller: b, g or - (no vote). A text of few words gets few votes."""
    return "".join("b" if bad(m) else "g" if good(m) else "-" for _, bad, good in LABELLERS)


class WeakModel(NamedTuple):
    good: float
    right_good: np.ndarray  # how often a labeller that votes on a good document votes good
    right_bad: np.ndarray
    posterior: dict[str, float]

    def of(self, pattern: str) -> float:
        """The probability that a document with these votes is good."""
        return self.posterior[pattern] if pattern in self.posterior else float(_posteriors(_signs([pattern]), self.good, self.right_good, self.right_bad)[0])


def _signs(patterns: list[str]) -> np.ndarray:
    return np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in p] for p in patterns], np.int8).reshape(len(patterns), len(LABELLERS))


def _posteriors(s: np.ndarray, good: float, right_good: np.ndarray, right_bad: np.ndarray) -> np.ndarray:
    up = np.log(good) + (s == 1) @ np.log(right_good) + (s == -1) @ np.log(1 - right_good)
    down = np.log(1 - good) + (s == -1) @ np.log(right_bad) + (s == 1) @ np.log(1 - right_bad)
    return 1 / (1 + np.exp(np.clip(down - up, -700, 700)))


def expectation_maximisation(counts: dict[str, int], rounds: int = 100, tolerance: float = 1e-9) -> WeakModel:
    """Accuracies and posteriors from how often each pattern of votes occurs. Bad votes start as strong evidence."""
    patterns = sorted(counts)
    s, n = _signs(patterns), np.array([counts[p] for p in patterns], np.float64)
    k = s.shape[1]
    good, right_good, right_bad = 0.8, np.full(k, 0.95), np.full(k, 0.4)
    for _ in range(rounds if len(patterns) else 0):
        p = _posteriors(s, good, right_good, right_bad)
        w, v = n * p, n * (1 - p)
        before = good
        good = float(np.clip((w.sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6))
        right_good = (w @ (s == 1) + 0.95) / (w @ (s != 0) + 1)
        right_bad = (v @ (s == -1) + 0.4) / (v @ (s != 0) + 1)
        right_good, right_bad = np.clip(right_good, 1e-4, 1 - 1e-4), np.clip(right_bad, 1e-4, 1 - 1e-4)
        if abs(good - before) < tolerance:
            break
    p = _posteriors(s, good, right_good, right_bad)
    return WeakModel(good, right_good, right_bad, dict(zip(patterns, p.tolist(), strict=True)))


def _bins(m: Measures) -> list[bytes]:
    return [f"\0{name}:{min(40, int(round(value * 20)))}".encode() for name, value in zip(m._fields[1:], m[1:], strict=True)]


def features(data: bytes, m: Measures | None) -> np.ndarray:
    """Hashed features of a document: its distinct lower-case words and their first bytes, or with ``m`` shapes of words and binned measures."""
    mask = (1 << BITS) - 1
    if m is None:
        words = set(data.lower().translate(_APART).split())
        found = [*words, *{b"\0" + w[:PREFIX] for w in words if len(w) > PREFIX}]
    else:
        found = [*_bins(m), *set(data.translate(_SHAPE).split())]
    return np.unique(np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & mask).astype(np.int32)


_SHAPE = bytes(120 if chr(b).islower() or b > 127 else 88 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def train_scorer(rows: list[np.ndarray], targets: np.ndarray, passes: int = 4, rate: float = 0.3, l1: float = 0.0, least_docs: int = 1, seed: int = 3) -> np.ndarray:
    """Weights of a logistic scorer over hashed features, the bias last: AdaGrad steps, with soft targets, a document at a time.

    Features of fewer than ``least_docs`` documents have no weight, or the scorer would
    learn documents by heart; ``l1`` pulls weights towards zero.
    """
    n = 1 << BITS
    w, g2 = np.zeros(n + 1), np.full(n + 1, 1e-2)
    seen = np.bincount(np.concatenate(rows), minlength=n) if rows else np.zeros(n, np.int64)
    rows = [np.append(f[seen[f] >= least_docs], n) for f in rows]
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            g = targets[i] - 1 / (1 + np.exp(-np.clip(w[f].sum(), -30, 30)))
            g2[f] += g * g
            step = rate / np.sqrt(g2[f])
            moved = w[f] + step * g
            w[f] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1) if l1 else moved
    return w


def apply_scorer(w: np.ndarray, f: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[f].sum() + w[-1], -30, 30))))


def _patterns(batches):
    seen: Counter = Counter()
    for batch in small(batches, "__in"):
        seen.update(votes(measure(t)) for t in column(batch, "__in").to_pylist())
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


def _sampled(toxic: bool):
    def run(batches):
        for batch in small(batches, "__in"):
            rows = [(votes(m), features(t, None if toxic else m).tolist()) for t in column(batch, "__in").to_pylist() for m in (measure(t),)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), column(batch, "target"), column(batch, "__hash")],
                names=["pattern", "features", "target", "__hash"],
            )

    return run


def below(n: int, bound: int) -> int:
    """A bound on hashes of 63 bits that leaves at least ``bound`` of n rows, and few more, whatever n is: a margin of six deviations."""
    want = bound + 6 * math.isqrt(bound) + 10
    return 1 << 63 if want >= n else (want << 63) // n


def picked(rows: DataFrame, n: int, bound: int) -> DataFrame:
    """Those of n rows with the smallest hashes of ``key``, with __hash: a few more than ``bound`` of them."""
    mixed = F.xxhash64(F.lit("sample"), F.xxhash64("key"), F.col("key").cast("string")).bitwiseAND(F.lit((1 << 63) - 1))
    return rows.withColumn("__hash", mixed).where(F.col("__hash") <= F.lit(below(n, bound) - 1))


def _sample(rows: DataFrame, bound: int, toxic: bool) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The ``bound`` rows (key, __in, target, __hash) with the smallest hashes."""
    found = map_arrow(rows, _sampled(toxic), "pattern string, features array<int>, target double, __hash long")
    got = found.orderBy("__hash", "features", "target").limit(bound).toArrow()
    # Views of one array: Python lists of so many numbers would fill the driver.
    ends = np.cumsum([0, *pa.compute.list_value_length(got.column("features")).to_pylist()])
    values = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in got.column("features").chunks)])
    found = [values[a:b] for a, b in pairwise(ends.tolist())]
    order = sorted(range(len(found)), key=lambda i: found[i].tobytes())  # training doesn't depend on how rows arrive
    return [got.column("pattern")[i].as_py() for i in order], [found[i] for i in order], got.column("target").to_numpy()[order]


class Classifier(NamedTuple):
    weak: WeakModel
    quality: np.ndarray
    toxic: np.ndarray | None

    def judge(self, data: bytes) -> tuple[str, float, float, float]:
        """Votes, posterior, score and toxicity of a document."""
        m = measure(data)
        pattern = votes(m)
        toxic = 0.0 if self.toxic is None else apply_scorer(self.toxic, features(data, None))
        return pattern, self.weak.of(pattern), apply_scorer(self.quality, features(data, m)), toxic


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Classifier:
    """Fit on ``docs``; ``labels`` (key, toxic 0/1) are for the second head only.

    All documents count for the accuracies; ``sample`` of them, those with the smallest
    hashes of their keys, train each scorer, or all if there are fewer. Without documents,
    or labels of both kinds, a head finds everything good or nothing toxic. Rows with one
    key (or none) have one hash; if that leaves out all, any ``sample`` rows train.
    """
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("__in"))
    counts = dict(map(tuple, map_arrow(rows.select("__in"), _patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n")).collect()))  # at most 3^11 patterns
    weak = expectation_maximisation(counts)
    n = sum(counts.values())
    targets = rows.withColumn("target", F.lit(0.0))
    patterns, found, _ = _sample(picked(targets, n, sample), sample, False)
    if n and not found:  # too many rows share one key, which is above the bound
        patterns, found, _ = _sample(targets.limit(sample).withColumn("__hash", F.lit(0).cast("long")), sample, False)
    if n and not found:
        raise RuntimeError(f"none of {n} documents is in the sample")
    quality = train_scorer(found, np.array([weak.of(p) for p in patterns]), rate=0.05, least_docs=LEAST_DOCS)
    if not found:
        quality[-1] = 10.0
    del patterns, found
    toxic = None
    if labels is not None:
        told = labels.where("toxic IS NOT NULL").select(F.col(key).alias("key"), F.col("toxic").cast("double").alias("target"))
        n = told.count()
        told = picked(told, n, sample)
        _, found, target = _sample(rows.join(told, "key"), sample, True)
        if len(found) and 0 < target.mean() < 1:
            toxic = train_scorer(found, target, passes=6, rate=0.1, l1=LASSO, least_docs=LEAST_DOCS)
    return Classifier(weak, quality, toxic)


def classify(docs: DataFrame, classifier: Classifier, text: str = "text", least: float = 0.5, most_toxic: float = MOST_TOXIC) -> DataFrame:
    """``docs`` with __votes, __posterior, __score, __toxic and __kept; all other columns stay, as does every row.

    A document is kept if its score is at least ``least`` and its toxicity at most
    ``most_toxic``. Null and empty texts are judged like any other (no words, no letters).
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for batch in small(batches, "__in"):
            judged = [sent.value.judge(t) for t in column(batch, "__in").to_pylist()]
            kept = [s >= least and t <= most_toxic for _, _, s, t in judged]
            out = _replaced(batch, "__votes", pa.array([j[0] for j in judged], pa.string()))
            for k, name in enumerate(("__posterior", "__score", "__toxic"), 1):
                out = out.append_column(name, pa.array([j[k] for j in judged], pa.float64()))
            yield out.append_column("__kept", pa.array(kept, pa.bool_()))

    new = ("__votes", "__posterior", "__score", "__toxic", "__kept")
    rows = docs.drop(*new).withColumn("__in", utf8(text))
    return map_arrow(rows, run, _with(rows, "__votes", "string") + ", __posterior double, __score double, __toxic double, __kept boolean")


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, votes, posterior, score, toxicity, kept.

    Fits on ``docs`` and judges all of them. Repeated rows are judged alike; an empty
    table gives no rows; other columns are not read.
    """
    judged = classify(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), fit(docs, labels, key, text, sample))
    return judged.select("doc_id", F.col("__votes").alias("votes"), F.col("__posterior").alias("posterior"), F.col("__score").alias("score"), F.col("__toxic").alias("toxicity"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return classify(docs, fit(docs, labels, key, text, sample), text).where("__kept").select(*columns_of(docs))
