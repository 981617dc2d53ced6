"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Counts. Tasks cut their rows into blocks of bounded size and send each distinct word of
a block once, packed by hash bucket, with its count in training texts. A bucket adds
up the counts and sends them back to the blocks that asked, in the order they asked
in; a second pass over the same blocks reads them. So counts cover every word of every
text, no table of words is broadcast, and no word is a hot key.

Model. Its outputs are the commonest words, the end of a text, and classes of all other
words by their last two bytes; inside a class a word has its add-one share. Two words of
context, numbered in the same way, predict an output vector: the sum of a vector for
each, by position; the score of an output is its dot product with that vector, plus a
bias. Training is in numpy, over all training texts, in rounds: in each, every task
runs minibatches over its share of the round's texts, in which all positions share their
noise words, so that both passes are matrix products; then the tasks' parameters and
step sizes are averaged, and the next round starts from the average. For scoring, the
normaliser of each distinct context of a block is computed by matrix products, so the
probabilities sum to one over all known words and one unknown word of each class.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import nsmallest
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Answers, blocks, column, forget, grouped, map_arrow, parts_of, shared_dir, stored, utf8, write_answers

#: Text in a block; text for each bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 96 << 20
MOD, HELD = 7, 2


class Shape(NamedTuple):
    """outputs: words with an output of their own; endings: classes of other words; size: of vectors; rounds: averagings."""

    outputs: int = 768
    endings: int = 256
    size: int = 16
    noise: int = 64
    batch: int = 1024
    rate: float = 0.08
    rounds: int = 3
    seed: int = 5


def held_out(key: str) -> Column:
    """True where crc32 of the key as text (null: empty) leaves 2 modulo 7."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % MOD == HELD


class Indexed(NamedTuple):
    """A block's distinct words in the order of their first use, and each text's words as numbers of these."""

    words: list[bytes]
    texts: list[np.ndarray]
    order: np.ndarray
    bucket: np.ndarray


def index_block(texts: list[bytes], n_buckets: int) -> Indexed:
    number: dict[bytes, int] = defaultdict(count().__next__)
    out = []
    for text in texts:
        words = text.lower().split()  # bytes: A-Z, and white space 09-0D and 20 only
        out.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    words = list(number)
    digest = xxhash.xxh32_intdigest
    bucket = np.fromiter((digest(w) % n_buckets for w in words), np.int64, len(words))
    return Indexed(words, out, np.argsort(bucket, kind="stable"), bucket)


def _ask(n_buckets: int):
    """For each block and bucket: the words and how often training texts hold them."""

    def run(batches):
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            texts, held = rows.column("text").to_pylist(), rows.column("held").to_numpy()
            found = index_block(texts, n_buckets)
            seen = np.zeros(len(found.words), np.int64)
            for ids, out in zip(found.texts, held, strict=True):
                if not out and len(ids):
                    np.add.at(seen, ids, 1)
            cuts = np.flatnonzero(np.diff(found.bucket[found.order], prepend=-1, append=-1)).tolist() if found.words else [0]
            for k in range(0, len(cuts) - 1, _ROWS):
                own = [found.order[a:b] for a, b in zip(cuts[k : k + _ROWS], cuts[k + 1 : k + _ROWS + 1], strict=False)]
                yield _rows(
                    bucket=[int(found.bucket[p[0]]) for p in own], block=[block] * len(own), words=[b" ".join([found.words[i] for i in p.tolist()]) for p in own],
                    counts=[seen[p].tobytes() for p in own], ends=[0] * len(own), tokens=[0] * len(own),
                )
            yield _row(bucket=-1, block=block, words=b"", counts=b"", ends=int((~held).sum()), tokens=int(seen.sum()))

    return run


_ASKED = "bucket int, block long, words binary, counts binary, ends long, tokens long"


#: Rows in a batch that leaves a task.
_ROWS = 512


def _rows(**values) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "block": pa.int64(), "ends": pa.int64(), "tokens": pa.int64(), "part": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in values.items()})


def _row(**values) -> pa.RecordBatch:
    return _rows(**{k: [v] for k, v in values.items()})


def ending(word: bytes, endings: int) -> int:
    """The class of a word that has no output of its own."""
    return zlib.crc32(word[-2:]) % endings


def _answer(top: int, endings: int):
    """Totals of a bucket, back to each block; as part -1 its commonest words, and its words and their tokens by class."""

    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            total: dict[bytes, int] = defaultdict(int)
            asked = []
            for words, counts in zip(rows.column("words"), rows.column("counts"), strict=True):
                names = words.as_py().split(b" ")
                asked.append(names)
                for w, n in zip(names, np.frombuffer(counts.as_py(), np.int64).tolist(), strict=True):
                    total[w] += n
            numbers = rows.column("block").to_pylist()
            for k in range(0, len(numbers), _ROWS):
                own, names = numbers[k : k + _ROWS], asked[k : k + _ROWS]
                yield _rows(
                    part=[n >> 24 for n in own], block=own, bucket=[bucket] * len(own), words=[b""] * len(own),
                    counts=[np.fromiter(map(total.__getitem__, x), np.int64, len(x)).tobytes() for x in names], tokens=[0] * len(own),
                )
            known = [(n, w) for w, n in total.items() if n]
            by_class = np.zeros((2, endings), np.int64)
            kinds = np.fromiter((ending(w, endings) for _, w in known), np.int64, len(known))
            np.add.at(by_class[0], kinds, np.fromiter((n for n, _ in known), np.int64, len(known)))
            by_class[1] = np.bincount(kinds, minlength=endings)
            best = nsmallest(top, known, key=_commonest)
            yield _row(part=-1, block=0, bucket=bucket, words=b" ".join(w for _, w in best), counts=by_class.tobytes() + np.array([n for n, _ in best], np.int64).tobytes(), tokens=0)

    return run


def _commonest(word: tuple[int, bytes]) -> tuple[int, bytes]:
    return -word[0], word[1]


def _merge(top: int, endings: int):
    """Notes of buckets (part -1, part -2) as one of each kind for a task."""

    def run(batches):
        best: list[tuple[int, bytes]] = []
        by_class = np.zeros((2, endings), np.int64)
        ends = tokens = 0
        for batch in batches:
            for words, counts, e, t in zip(*(column(batch, c).to_pylist() for c in ("words", "counts", "block", "tokens")), strict=True):
                ends, tokens = ends + e, tokens + t
                if counts:
                    data = np.frombuffer(counts, np.int64)
                    by_class += data[: 2 * endings].reshape(2, endings)
                    best = nsmallest(top, best + list(zip(data[2 * endings :].tolist(), words.split(b" "), strict=False)), key=_commonest)
        yield _row(part=0, block=ends, bucket=0, words=b" ".join(w for _, w in best), counts=by_class.tobytes() + np.array([n for n, _ in best], np.int64).tobytes(), tokens=tokens)

    return run


_ANSWERED = "part int, block long, bucket int, words binary, counts binary, tokens long"


class Vocabulary(NamedTuple):
    """What all tasks know: the commonest words and their counts, and totals over training texts."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int  # N, ends too
    types: int  # V, the end too
    ends: int
    other_tokens: np.ndarray  # of each class
    other_types: np.ndarray

    def numbers(self) -> dict[bytes, int]:
        """Numbers of words: 0 is the end, or as context the start of a text; then the classes; then the commonest words."""
        return {w: k + 1 + len(self.other_types) for k, w in enumerate(self.words)}

    def unigram(self) -> np.ndarray:
        """Counts of the outputs; each class has one unknown word."""
        return np.concatenate([[self.ends], self.other_tokens + 1, self.counts]).astype(np.float64)


def _numbers(words: list[bytes], known: dict[bytes, int], shape: Shape) -> np.ndarray:
    """For distinct words: their numbers as outputs and as context."""
    return np.fromiter((known.get(w) or 1 + ending(w, shape.endings) for w in words), np.int32, len(words))


def _stream(found: Indexed, number: np.ndarray, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all positions of the texts in ``which``: output, the word before, the one before that."""
    y, near, far = [], [], []
    for ids in (found.texts[i] for i in which):
        own = number[ids]
        c = np.concatenate([np.zeros(2, np.int32), own])
        y.append(np.append(own, np.int32(0)))
        near.append(c[1:])
        far.append(c[:-1])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (y, near, far))


class LogBilinear:
    """Context vectors by position, output vectors and biases."""

    def __init__(self, n_out: int, n_context: int, shape: Shape, bias: np.ndarray):
        rng = np.random.default_rng(shape.seed)
        self.shape = shape
        self.near = (rng.standard_normal((n_context, shape.size)) * 0.1).astype(np.float32)
        self.far = (rng.standard_normal((n_context, shape.size)) * 0.1).astype(np.float32)
        self.out = (rng.standard_normal((n_out, shape.size)) * 0.1).astype(np.float32)
        self.bias = bias.astype(np.float32)
        self.squares = [np.full(p.shape, 0.1, np.float32) for p in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.far, self.out, self.bias]

    def pack(self) -> np.ndarray:
        """Parameters and step sizes, as one array."""
        return np.concatenate([p.ravel() for p in self.parts() + self.squares]).astype(np.float64)

    def load(self, flat: np.ndarray) -> LogBilinear:
        at, parts = 0, []
        for p in self.parts() + self.squares:
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        self.near, self.far, self.out, self.bias, *self.squares = parts
        return self

    def train(self, y: np.ndarray, near: np.ndarray, far: np.ndarray, noise_p: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation in shuffled minibatches, with AdaGrad steps."""
        s = self.shape
        log_noise = np.log(s.noise * noise_p).astype(np.float32)
        order = rng.permutation(len(y))
        samples = rng.choice(len(noise_p), size=(len(y) // s.batch + 1, s.noise), p=noise_p)
        for k in range(0, len(y), s.batch):
            at = order[k : k + s.batch]
            w, a, b, drawn = y[at], near[at], far[at], samples[k // s.batch]
            q = self.near[a] + self.far[b]
            vectors = self.out[drawn]
            pull = 1 / (1 + np.exp((q * self.out[w]).sum(1) + self.bias[w] - log_noise[w]))
            push = -1 / (1 + np.exp(-(q @ vectors.T + self.bias[drawn] - log_noise[drawn])))
            to_q = pull[:, None] * self.out[w] + push @ vectors
            to_out = np.concatenate([pull[:, None] * q, push.T @ q])
            to_bias = np.concatenate([pull, push.sum(0)])
            rows = np.concatenate([w, drawn])
            for p, g2, i, g in zip(self.parts(), self.squares, (a, b, rows, rows), (to_q, to_q, to_out, to_bias), strict=True):
                self._step(p, g2, i, g)

    def _step(self, p: np.ndarray, g2: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        cuts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        i, g = rows[order[cuts]], np.add.reduceat(g[order], cuts, axis=0)
        g2[i] += g * g
        p[i] += self.shape.rate * g / np.sqrt(g2[i] + 1e-6)

    def log_p(self, y: np.ndarray, near: np.ndarray, far: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Natural log probabilities of outputs, normalised over all outputs."""
        n = np.int64(len(self.far))
        pair, back = np.unique(near * n + far, return_inverse=True)
        norm = np.empty(len(pair), np.float32)
        for k in range(0, len(pair), chunk):
            part = pair[k : k + chunk]
            scores = (self.near[part // n] + self.far[part % n]) @ self.out.T + self.bias
            top = scores.max(1)
            norm[k : k + chunk] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        got = np.empty(len(y), np.float64)
        for k in range(0, len(y), 1 << 18):
            at = slice(k, k + (1 << 18))
            got[at] = ((self.near[near[at]] + self.far[far[at]]) * self.out[y[at]]).sum(1) + self.bias[y[at]] - norm[back[at]]
        return got


def _fresh(v: Vocabulary, shape: Shape) -> LogBilinear:
    p = v.unigram() + 1e-3
    return LogBilinear(len(p), len(p), shape, np.log(p / p.sum()))


def _train(sent, start, shape: Shape, number: int):
    """Each task's parameters after a pass over its training texts of a round, times its positions."""

    def run(batches):
        v = sent.value
        known, n = v.numbers(), 0
        noise = (v.unigram() + 1e-3) ** 0.75
        noise /= noise.sum()
        model = _fresh(v, shape).load(start.value)
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            found = index_block(rows.column("text").to_pylist(), 1)
            y, near, far = _stream(found, _numbers(found.words, known, shape), range(len(found.texts)))
            model.train(y, near, far, noise, np.random.default_rng([shape.seed, number, block]))
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(model.pack() * n).tobytes()], pa.binary())], names=["n", "sums"])

    return run


def _add(batches):
    n, sums = 0, None
    for batch in batches:
        for k, data in zip(column(batch, "n").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
            n, sums = n + k, np.frombuffer(data) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])


def _score(sent, weights, shape: Shape, n_buckets: int, answers: str):
    def run(batches):
        v = sent.value
        known, model = v.numbers(), _fresh(v, shape).load(weights.value)
        got = None
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            got = got or Answers(answers, ["block", "bucket", "counts"])
            found = index_block(rows.column("text").to_pylist(), n_buckets)
            c = np.zeros(len(found.words), np.int64)
            told = np.frombuffer(b"".join(got.of(block)[1]), np.int64)
            if len(told) != len(c):
                raise RuntimeError("the blocks differ from those of the first pass: score a stored table")
            c[found.order] = told
            number = _numbers(found.words, known, shape)
            y, near, far = _stream(found, number, range(len(found.texts)))
            size = np.array([len(t) + 1 for t in found.texts])
            first = np.cumsum(size) - size
            base = np.log10((c + 1) / (v.tokens + v.types + 1))
            base_end = np.log10((v.ends + 1) / (v.tokens + v.types + 1))
            kind = np.clip(number - 1, 0, shape.endings - 1)
            inside = np.where(number <= shape.endings, np.log((c + 1) / (v.other_tokens[kind] + v.other_types[kind] + 1)), 0.0)
            token_p = model.log_p(y, near.astype(np.int64), far.astype(np.int64))
            token_p += np.concatenate([np.append(inside[t], 0.0) for t in found.texts])
            yield from pa.Table.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("held"),
                    pa.array(size),
                    pa.array([int((c[t] > 0).sum()) + (v.ends > 0) for t in found.texts], pa.int64()),
                    pa.array(np.full(len(size), v.tokens)),
                    pa.array([float(base[t].sum() + base_end) for t in found.texts]),
                    pa.array(np.add.reduceat(token_p, first) / np.log(10)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ).to_batches()

    return run


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased; each text ends in an
    end token. A null text is an empty one: its end only. Rows for which :func:`held_out`
    is false are the training texts, repeated rows each counting. n_known counts tokens
    that training texts hold, train_tokens is their number of tokens N, base_score is the
    sum of log10((c + 1) / (N + V + 1)) and score the model's log10 probability of the whole
    text. Without training texts all words are unknown. An empty table gives no rows; other
    columns are not read. ``docs`` must be a stored table: it is read once for the counts, once
    for each round of training and once for scoring, in the same partitions.

    The network has a fixed size, whatever the corpus: ``shape.outputs`` words have vectors
    of their own, all other words share those of their class, one of ``shape.endings``, and
    are told apart inside it by their counts only. The counts cover all words and grow with
    the corpus. Scores depend slightly on how texts are dealt to tasks, as each task trains
    on its own between averagings.
    """
    shape = shape or Shape()
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held"), utf8(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets, parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // BUCKET_BYTES) + 1), parts_of(rows)
    asked = map_arrow(rows, _ask(n_buckets), _ASKED)
    path = shared_dir(spark, "counts")
    # Totals take the way of the counts, so that the texts are read once for both.
    met = asked.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    write_answers(map_arrow(met, _both(shape), _ANSWERED), path, parts)
    # Empty tables write no files, so the schema is given.
    notes = spark.read.schema(_ANSWERED).parquet(path).where("part < 0")
    v = _vocabulary(map_arrow(notes.repartition(_MERGERS), _merge(shape.outputs, shape.endings), _ANSWERED).collect(), shape)
    sent, flat = sc.broadcast(v), _fresh(v, shape).pack()
    for number in range(shape.rounds):
        own = rows.where(~F.col("held") & (F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(shape.rounds)) == number))
        sums = map_arrow(own.select("text"), _train(sent, sc.broadcast(flat), shape, number), "n long, sums binary")
        n = parts
        while n > _MERGERS:
            n = max(_MERGERS, n // 64)
            sums = map_arrow(sums.repartition(n), _add, "n long, sums binary")
        found = sums.collect()
        if found:
            flat = sum(np.frombuffer(r.sums) for r in found) / sum(r.n for r in found)
    kind = "doc_id " + docs.schema[key].dataType.simpleString() + ", held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # Stored, so that the blocks are those of this plan, whatever is made of the result.
    out = stored(map_arrow(rows, _score(sent, sc.broadcast(flat), shape, n_buckets, path), kind), "scores")
    forget(spark, path)
    return out


#: Tasks whose notes or parameters, of bounded size each, go to the driver.
_MERGERS = 8


def _vocabulary(notes: list, shape: Shape) -> Vocabulary:
    best: list[tuple[int, bytes]] = []
    by_class, ends, tokens = np.zeros((2, shape.endings), np.int64), 0, 0
    for r in notes:
        data = np.frombuffer(r.counts, np.int64)
        by_class += data[: 2 * shape.endings].reshape(2, shape.endings)
        best += zip(data[2 * shape.endings :].tolist(), bytes(r.words).split(b" "), strict=False)
        ends, tokens = ends + r.block, tokens + r.tokens
    best = nsmallest(shape.outputs, best, key=_commonest)
    types = int(by_class[1].sum()) + bool(ends)
    for n, w in best:
        by_class[:, ending(w, shape.endings)] -= (n, 1)
    return Vocabulary([w for _, w in best], np.array([n for n, _ in best], np.int64), tokens + ends, types, ends, by_class[0], by_class[1])


def _both(shape: Shape):
    """Answers for buckets; block totals (bucket -1) are added up as part -2."""
    answer = _answer(shape.outputs, shape.endings)

    def run(batches):
        def words():
            nonlocal ends, tokens
            for batch in batches:
                totals = pa.compute.less(column(batch, "bucket"), 0)
                own = batch.filter(totals)
                ends += pa.compute.sum(column(own, "ends")).as_py() or 0
                tokens += pa.compute.sum(column(own, "tokens")).as_py() or 0
                yield batch.filter(pa.compute.invert(totals))

        ends = tokens = 0
        yield from answer(words())
        if ends or tokens:
            yield _row(part=-2, block=ends, bucket=-1, words=b"", counts=b"", tokens=tokens)

    return run
