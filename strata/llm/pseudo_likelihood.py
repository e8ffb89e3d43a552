"""Masked pseudo-likelihood of documents by a window network (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.text import ALNUM, flat, list_array, mix, row_of, slices, word_hashes, words
from strata.session import Scratch

WORDS = 350  # ids for a corpus of a million words; they grow with the root of its size
LARGEST = 1 << 16  # ids at most: weights must fit a task
GROUPED = 4  # one id in so many is a group of rarer words with one ending
ENDING = 3  # bytes of an ending
HEAD = 1 << 16  # most frequent words of the groups, whose counts every task holds; the others' counts are joined
SIDE = 2  # words seen on either side
SMALL = 60  # single precision holds exp of such logits and their sums
BLOCK = 1 << 17  # logits at a time in scoring, to stay in the processor's cache
EMBED, HIDDEN = 16, 32
ROUNDS = 2  # each predicts every second word of a document, so both together every word once
MILLION = 1_000_000
_ID = np.dtype("<u2")


@dataclass(frozen=True)
class Shape:
    """Sizes of the network: ids are ``side`` classes of ``side`` words, the last ``groups`` ids groups of rarer words."""

    side: int
    groups: int

    @classmethod
    def of(cls, n_words: int) -> Shape:
        """For a corpus of so many words."""
        side = math.ceil(math.sqrt(min(LARGEST, max(64, WORDS * math.sqrt(n_words / MILLION)))))
        return cls(side, side * side // GROUPED)

    @property
    def size(self) -> int:
        return self.side * self.side

    @property
    def batch(self) -> int:
        """Words of a step: a larger network costs more a step, and comes with more words."""
        return max(512, self.size)

    @property
    def frequent(self) -> int:
        return self.size - self.groups

    def arrays(self) -> dict[str, tuple[int, ...]]:
        n = self.side
        return {
            "embed": (self.size + 1, EMBED),  # the last row stands for what lies outside the text
            "inner": (2 * SIDE * EMBED, HIDDEN),
            "inner_bias": (HIDDEN,),
            "class": (HIDDEN + 1, n),  # the last rows of these two are biases
            "word": (n, HIDDEN + 1, n),
        }

    @property
    def n_weights(self) -> int:
        return sum(math.prod(s) for s in self.arrays().values())


def views(weights: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """The network's arrays as parts of one flat array."""
    out, at = {}, 0
    for name, sizes in shape.arrays().items():
        n = math.prod(sizes)
        out[name] = weights[at : at + n].reshape(sizes)
        at += n
    out["to_class"], out["class_bias"] = out["class"][:-1], out["class"][-1]
    out["to_word"], out["word_bias"] = out["word"][:, :-1], out["word"][:, -1]
    return out


def initial(shape: Shape, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights that predict every id by its count alone, whatever stands beside it."""
    weights = np.zeros(shape.n_weights, np.float32)
    v, rng = views(weights, shape), np.random.default_rng(11)
    v["embed"][:] = rng.normal(0, 0.1, v["embed"].shape)
    v["inner"][:] = rng.normal(0, 0.3, v["inner"].shape)
    if counts is not None:
        table = counts.reshape(shape.side, shape.side) + 0.5
        v["class_bias"][:] = np.log(table.sum(1) / table.sum())
        v["word_bias"][:] = np.log(table / table.sum(1, keepdims=True))
    return weights


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their ids and counts; sizes of the groups."""

    shape: Shape
    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # of every id
    total: int  # words of the corpus

    def encode(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        rare = (self.shape.frequent + mix(endings) % np.uint64(self.shape.groups)).astype(np.int64)
        found, at = _find(self.hashes, hashes)
        rare[found] = self.ids[at]
        return rare


@dataclass
class Shares:
    """Counts of the HEAD most frequent words of the groups."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray


def _find(among: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hashes that are in the sorted ``among``, and their places there."""
    if len(among) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # hashes are spread evenly, so few share their first bits
    bits = min(len(among).bit_length() + 2, 24)
    own, first = ((x >> np.uint64(64 - bits)).astype(np.int64) for x in (hashes, among))
    sizes = np.bincount(first, minlength=1 << bits)
    at = (np.cumsum(sizes) - 1)[own]
    hit = among[at] == hashes
    left = np.flatnonzero(~hit & (sizes > 1)[own])
    for back in range(1, int(sizes.max())):
        left = left[sizes[own[left]] > back]
        at[left] -= 1
        hit[left] = among[at[left]] == hashes[left]
        left = left[~hit[left]]
    found = np.flatnonzero(hit)
    return found, at[found]


@dataclass
class _Words:
    """Words of rows ``first`` to ``last``: hash of each, of its ending, its place among SIDE blanks around every text, its row."""

    first: int
    last: int
    hashes: np.ndarray
    endings: np.ndarray
    place: np.ndarray
    owner: np.ndarray

    def ids(self, words_: Vocabulary) -> np.ndarray:
        """Ids of the words with SIDE blanks around every text."""
        ids = np.full(len(self.hashes) + SIDE * (self.last - self.first + 1), words_.shape.size, np.int64)
        ids[self.place] = words_.encode(self.hashes, self.endings)
        return ids


def _hashed(column: pa.Array) -> Iterator[_Words]:
    body, offsets = flat(column)
    for first, last in slices(offsets, 1 << 18):
        part, local = body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, bounds = words(part, local, ALNUM)
        owner = row_of(bounds)
        place = np.arange(len(starts)) + SIDE * (owner + 1)
        yield _Words(first, last, *_both(part, starts, ends), place, owner)


def _encoded(batches: Iterator[pa.RecordBatch], words_: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Ids of every text's words, two bytes each; shard and draw stay."""
    for batch in batches:
        for part in _hashed(batch.column("text")):
            n = part.last - part.first
            ids = words_.encode(part.hashes, part.endings).astype(_ID)
            ends = np.searchsorted(part.owner, np.arange(n + 1)).astype(np.int32) * _ID.itemsize
            column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            kept = [batch.column(c).slice(part.first, n) for c in ("shard", "draw")]
            yield pa.RecordBatch.from_arrays([*kept, column], ["shard", "draw", "ids"])


def _training_ids(batch: pa.RecordBatch, words_: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids with SIDE blanks around every text, places and rows of the words; of texts or of the ids they were encoded to."""
    if "ids" not in batch.schema.names:
        for part in _hashed(batch.column("text")):
            yield part.ids(words_), part.place, part.owner
        return
    body, offsets = flat(batch.column("ids"))
    for first, last in slices(offsets, 1 << 17):
        own = body[offsets[first] : offsets[last]].view(_ID)
        owner = row_of((offsets[first : last + 1] - offsets[first]) // _ID.itemsize)
        place = np.arange(len(own)) + SIDE * (owner + 1)
        ids = np.full(len(own) + SIDE * (last - first + 1), words_.shape.size, np.int64)
        ids[place] = own
        yield ids, place, owner


def _both(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and 31 bits of the hash of its last bytes: rarer words with one ending mostly share a language and a form."""
    found = word_hashes(body, np.concatenate([starts, np.maximum(starts, ends - ENDING)]), np.concatenate([ends, ends]))
    return found[: len(starts)], found[len(starts) :] >> np.uint64(33)


def _context(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ids[place[:, None] + np.array([d for d in range(-SIDE, SIDE + 1) if d])]


def _shifted(logits: np.ndarray) -> np.ndarray:
    """The logits, in place less the greatest of their row unless all of them are small."""
    if logits.size and not -SMALL < logits.min() <= logits.max() < SMALL:
        logits -= logits.max(1, keepdims=True)
    return logits


def _exponents(logits: np.ndarray) -> np.ndarray:
    """exp of the logits, in their place, up to a factor of each row."""
    _shifted(logits)
    return np.exp(logits, out=logits)


def _sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones((rows.shape[1], 1), np.float32)


def _by_class(kind: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by class, and where each class that occurs lies in it."""
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=classes))])
    return order, [(c, slice(cuts[c], cuts[c + 1])) for c in range(classes) if cuts[c + 1] > cuts[c]]


def _word_logits(v: dict[str, np.ndarray], hidden: np.ndarray, runs: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the words of its own class for each row; rows are in the order of classes."""
    out = np.empty((len(hidden), v["word"].shape[2]), np.float32)
    for c, at in runs:
        np.matmul(hidden[at], v["word"][c], out=out[at])
    return out


def _hidden(v: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the inner layer and its outputs, with a last column of ones for the biases."""
    inputs = v["embed"].take(context, 0).reshape(len(context), -1)
    inner = inputs @ v["inner"]
    inner += v["inner_bias"]
    hidden = np.ones((len(context), HIDDEN + 1), np.float32)
    np.tanh(inner, out=hidden[:, :-1])
    return inputs, hidden


def log_probabilities(v: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of every target word given the words on both of its sides."""
    side = v["class"].shape[1]
    order = np.argsort((target // side).astype(np.uint16), kind="stable")
    out = np.empty(len(target), np.float32)
    rows = max(1, BLOCK // side)
    for i in range(0, len(order), rows):
        at = order[i : i + rows]
        kind, word = np.divmod(target[at], side)
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(at)]
        runs = [(kind[a], slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        hidden = _hidden(v, context[at])[1]
        own, each = np.zeros(len(at), np.float32), np.arange(len(at))
        for logits, right in ((hidden @ v["class"], kind), (_word_logits(v, hidden, runs), word)):
            own += _shifted(logits)[each, right]
            own -= np.log(_sums(np.exp(logits, out=logits))[:, 0])
        out[at] = own
    return out


class _Learner:
    """Adaptive gradient descent from given weights, a batch at a time."""

    def __init__(self, shape: Shape, weights: np.ndarray):
        self.shape, self.weights = shape, weights.copy()
        self.power = np.full(shape.n_weights, 1e-6, np.float32)
        self.n = 0
        self._left: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, context: np.ndarray, target: np.ndarray) -> None:
        self._left.append((context, target))
        self._waiting += len(target)
        if self._waiting >= 4 * self.shape.batch:
            self._learn(self.shape.batch)

    def close(self) -> np.ndarray:
        self._learn(1)
        return self.weights

    def _learn(self, least: int) -> None:
        """Steps of whole batches, so that how words arrive doesn't matter; the rest waits."""
        if not self._waiting:
            return
        context, target = np.concatenate([c for c, _ in self._left]), np.concatenate([t for _, t in self._left])
        done, size = 0, self.shape.batch
        while len(target) - done >= least:
            self._step(context[done : done + size], target[done : done + size], 0.1)
            done = min(done + size, len(target))
        self._left, self._waiting, self.n = [(context[done:], target[done:])], len(target) - done, self.n + done

    def _step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        side = self.shape.side
        v, gradient = views(self.weights, self.shape), np.zeros(self.shape.n_weights, np.float32)
        g, n = views(gradient, self.shape), len(target)
        order, runs = _by_class(target // side, side)
        context, target = context[order], target[order]
        kind, word = np.divmod(target, side)
        inputs, hidden = _hidden(v, context)
        each = np.arange(n)
        error = _exponents(hidden @ v["class"])
        error /= _sums(error)
        error[each, kind] -= 1
        np.matmul(hidden.T, error, out=g["class"])
        back = error @ v["to_class"].T
        error = _exponents(_word_logits(v, hidden, runs))
        error /= _sums(error)
        error[each, word] -= 1
        for c, at in runs:
            np.matmul(hidden[at].T, error[at], out=g["word"][c])
            back[at] += error[at] @ v["to_word"][c].T
        hidden = hidden[:, :-1]
        back *= 1 - hidden * hidden
        np.matmul(inputs.T, back, out=g["inner"])
        g["inner_bias"][:] = back.sum(0)
        # by place and part of the embedding, so that each part's numbers lie side by side
        sent = (v["inner"] @ back.T).reshape(-1, EMBED, n)
        seen = np.ascontiguousarray(context.T).ravel()
        for d in range(EMBED):
            g["embed"][:, d] = np.bincount(seen, weights=sent[:, d].ravel(), minlength=self.shape.size + 1)
        gradient /= n
        self.power += gradient * gradient
        self.weights -= rate * gradient / (np.sqrt(self.power) + 1e-6)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes with their endings, summed within the task before they leave it."""
    held, size = [], 0

    def distinct(hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes[first], endings[order[first]], np.add.reduceat(counts[order], first)

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def rows(hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(hashes.view(np.int64)), pa.array(endings.astype(np.int32)), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["hash", "ending", "n"])

    for batch in batches:
        body, offsets = flat(batch.column("text"))
        for first, last in slices(offsets):
            part, local = body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            starts, ends, _ = words(part, local, ALNUM)
            own, endings = _both(part, starts, ends)
            if len(own):
                held.append(distinct(own, endings, np.ones(len(own), np.int64)))
                size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, ending, n) of every word of all documents."""
    parts = docs.select("text").mapInArrow(_counts, "hash long, ending int, n long")
    return parts.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _least(counted: DataFrame, n: int) -> int:
    """A count that at most ``n`` words reach, from a histogram of a few hundred bins."""
    bins = counted.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    left, least = n, 1 << 62
    for r in sorted(bins, key=lambda r: -r["bin"]):
        left -= r["words"]
        if left < 0:
            break
        least = r["least"]
    return least


def _most(counted: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most ``n``; only those reach the driver."""
    top = counted.where(F.col("n") >= _least(counted, n)).select("hash", "n").toArrow()
    hashes, counts = top.column("hash").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -counts))
    return hashes[order], counts[order]


def _sizes(batches: Iterator[pa.RecordBatch], words_: Vocabulary) -> Iterator[pa.RecordBatch]:
    """This task's part of the count of every id."""
    totals = np.zeros(words_.shape.size, np.int64)
    for batch in batches:
        endings = batch.column("ending").to_numpy().astype(np.uint64)
        np.add.at(totals, words_.encode(batch.column("hash").to_numpy().view(np.uint64), endings), batch.column("n").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals)), pa.int32()), pa.array(totals)], ["place", "n"])


def vocabulary(docs: DataFrame, counted: DataFrame | None = None) -> Vocabulary:
    """The most frequent words of all documents, as many as the corpus is large for, and groups of the others."""
    counted = word_counts(docs) if counted is None else counted
    total = int(counted.agg(F.sum("n")).first()[0] or 0)
    shape = Shape.of(total)
    hashes, _ = _most(counted, shape.frequent)
    order = np.argsort(hashes)
    found = Vocabulary(shape, hashes[order], order.astype(np.int64), np.zeros(shape.size, np.int64), total)
    sent = counted.sparkSession.sparkContext.broadcast(found)
    parts = counted.mapInArrow(lambda it: _sizes(it, sent.value), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    sizes = parts.toArrow()
    found.counts[sizes.column("place").to_numpy()] = sizes.column("n").to_numpy()
    return found


def shares(counted: DataFrame, words_: Vocabulary) -> Shares:
    """What every task needs to know of the words in the groups."""
    hashes, counts = _most(counted, words_.shape.frequent + HEAD)
    rare = ~np.isin(hashes, words_.hashes)
    hashes, counts = hashes[rare], counts[rare]
    order = np.argsort(hashes)
    return Shares(hashes[order], counts[order])


def _targets(owner: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Whether a word is predicted in this round: by its number in its text, so once in all rounds."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    first = np.repeat(starts, np.diff(starts, append=len(owner)))
    return (np.arange(len(owner)) - first) % rounds == turn


def _trained(
    batches: Iterator[pa.RecordBatch], words_: Vocabulary, start: np.ndarray, turn: int, rounds: int
) -> Iterator[pa.RecordBatch]:
    """Train on each shard's documents, which stand together and in order, from the common start."""
    shard, learner = None, None

    def result() -> Iterator[pa.RecordBatch]:
        if learner is not None:
            weights = learner.close().astype(np.float64)
            if learner.n:
                value = np.append(weights * learner.n, float(learner.n))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value)], ["place", "value"])

    for batch in batches:
        owners = np.asarray(batch.column("shard"))
        cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            if learner is None or owners[begin] != shard:
                yield from result()
                shard, learner = owners[begin], _Learner(words_.shape, start)
            for ids, place, owner in _training_ids(batch.slice(begin, end - begin), words_):
                chosen = place[_targets(owner, turn, rounds)]
                learner.add(_context(ids, chosen), ids[chosen])
    yield from result()


def train(docs: DataFrame, words_: Vocabulary, rounds: int = ROUNDS, scratch: Scratch | None = None) -> np.ndarray:
    """Weights trained on all words of all documents, each the target of one round.

    Training starts from the words' frequencies. Documents are dealt to shards by a hash of
    doc_id and text and stand there in the order of that hash, so what is learned depends
    neither on partitions nor on the order of the table. In each round every shard trains
    from the same start, and the weights are averaged by the number of words they were
    trained on. There are twice as many shards as the root of the millions of words, so
    shards, too, grow with the corpus. The averages are all that reaches the driver.
    Texts become ids once; ``scratch`` keeps these meanwhile.
    """
    spark = docs.sparkSession
    weights = initial(words_.shape, words_.counts)
    shards = math.ceil(2 * math.sqrt(words_.total / MILLION))
    if not shards:
        return weights
    draw = F.xxhash64("doc_id", "text")
    dealt = docs.select("text", draw.alias("draw"), F.pmod(draw, F.lit(shards)).cast("int").alias("shard"))
    known = spark.sparkContext.broadcast(words_)
    scratch = scratch or Scratch(spark)
    encoded = scratch.table(dealt.mapInArrow(lambda it: _encoded(it, known.value), "shard int, draw long, ids binary"), "ids")
    known.unpersist()
    dealt = encoded.repartition(shards, "shard").sortWithinPartitions("shard", "draw").drop("draw")
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((words_, weights))
        sums = (
            dealt.mapInArrow(lambda it, sent=sent, turn=turn: _trained(it, *sent.value, turn, rounds), "place int, value double")
            .groupBy("place")
            .agg(F.sum("value").alias("value"))
            .toArrow()
        )
        if not sums.num_rows:  # no words, or none in the later rounds
            continue
        value = np.zeros(words_.shape.n_weights + 1)
        value[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
        weights = (value[:-1] / value[-1]).astype(np.float32)
        sent.unpersist()
    scratch.drop(encoded)
    return weights


_SCORED = "row long, doc_id long, n_words long, log_likelihood double, tail array<long>"


def _scored(
    batches: Iterator[pa.RecordBatch], words_: Vocabulary, weights: np.ndarray, within: Shares | None
) -> Iterator[pa.RecordBatch]:
    """Sums of the texts, and the words whose counts are still to be joined."""
    v, shape = views(weights, words_.shape), words_.shape
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids_ = batch.column("doc_id").cast(pa.int64())
        for part in _hashed(batch.column("text")):
            first, last, place, owner = part.first, part.last, part.place, part.owner
            ids = part.ids(words_)
            target = ids[place]
            logs = np.zeros(len(place))
            for i in range(0, len(place), 1 << 16):
                logs[i : i + (1 << 16)] = log_probabilities(v, _context(ids, place[i : i + (1 << 16)]), target[i : i + (1 << 16)])
            tail = np.zeros(0, np.int64)
            if within is not None:
                tail = np.flatnonzero(target >= shape.frequent)
                logs[tail] -= np.log(words_.counts[target[tail]] + 1.0)
                found, at = _find(within.hashes, part.hashes[tail])
                logs[tail[found]] += np.log(within.counts[at])
                tail = np.delete(tail, found)
            n = np.bincount(owner, minlength=last - first)
            total = np.bincount(owner, weights=logs, minlength=last - first)
            bounds = np.searchsorted(owner[tail], np.arange(last - first + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row + first, row + last)),
                    ids_.slice(first, last - first),
                    pa.array(n, pa.int64()),
                    pa.array(total, pa.float64()),
                    list_array(part.hashes[tail].view(np.int64), bounds, pa.int64()),
                ],
                ["row", "doc_id", "n_words", "log_likelihood", "tail"],
            )
        row += batch.num_rows


def score(
    docs: DataFrame,
    words_: Vocabulary,
    weights: np.ndarray,
    counted: DataFrame | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Pseudo-log-likelihood of every document: doc_id, n_words, log_likelihood, mean_log_likelihood.

    The sum, over all words of the whole text, of the log-probability of the word
    given two words on either side. For a word outside the vocabulary that is the
    probability of its group, from the network, times its share of the group, n / (N + 1)
    if it occurs n times among the N words of its group in ``counted`` (see
    ``word_counts``); words that are not in ``counted`` have 1 / (N + 1). Counts of the
    most frequent words go to every task, the others' are joined; ``scratch`` keeps the
    sums meanwhile. Without ``counted`` it is the probability of the group alone.

    Texts without words, empty and null ones, have a sum of 0 and a null mean. Repeated
    rows and null doc_ids are kept; other columns are not read. A network trained on no
    documents scores by the counts it was given.
    """
    within = None if counted is None else shares(counted, words_)
    sent = docs.sparkSession.sparkContext.broadcast((words_, weights, within))
    sums = docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, *sent.value), _SCORED)
    if counted is not None:
        sums = (scratch or Scratch(docs.sparkSession)).table(sums, "sums")  # row numbers must stay
        # words that occur once or never add the logarithm of 1
        known = counted.where("n > 1").select("hash", F.log("n").alias("log_n"))
        tails = sums.select("row", F.explode("tail").alias("hash")).join(known.hint("merge"), "hash")
        tails = tails.groupBy("row").agg(F.sum("log_n").alias("more"))
        sums = sums.drop("tail").join(tails, "row", "left")
        sums = sums.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return sums.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Train on all documents and score each word of each of them as itself."""
    counted = scratch.table(word_counts(docs), "counts")
    found = vocabulary(docs, counted)
    return score(docs, found, train(docs, found, scratch=scratch), counted, scratch)
