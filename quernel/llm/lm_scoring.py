"""LM scoring: a log-bilinear model, trained in numpy by noise-contrastive estimation, that gives normalised log-probabilities."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import Words, checkpoint, slices

#: The end of a text as a token: an empty string, which no word is.
END = b""
#: Tokens in one step of training.
BATCH = 8192
#: Tokens that a shard trains on in one round, and most rounds.
CELL = 1_000_000
MOST_ROUNDS = 4
#: Rows of parameters are averaged in so many blocks, each by one task.
BLOCKS = 128
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Shape:
    """Bounds of what is broadcast, whatever the corpus: words and letter groups that the model predicts, words whose counts are at hand."""

    words: int = 3840
    groups: int = 256
    classes: int = 64
    width: int = 24
    context: int = 3
    listed: int = 200_000
    longest: int = 48

    @property
    def outputs(self) -> int:
        return self.words + self.groups


class Tokens(Words):
    """Words of some texts, each text closed by the end."""

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        w = Words.of(texts)
        at = np.insert(w.at, w.starts + w.sizes, len(w.words))
        return cls(pa.concat_arrays([w.words, pa.array([END], pa.binary())]), at, w.starts + np.arange(len(w.sizes)), w.sizes + 1)


def group_of(token: bytes, groups: int) -> int:
    """The group of a word outside the model's list: by its last three bytes, which say much about language and form."""
    return zlib.crc32(token[-3:]) % groups


class Vocabulary:
    """Frequent tokens with their counts, in order of count; the first ``shape.words`` are predicted one by one.

    All others are predicted as their letter group, and within it by add-half counts with one place for unseen words.
    """

    def __init__(self, shape: Shape, listed: list[tuple[bytes, int]], total: int, types: int, group_mass: np.ndarray, group_types: np.ndarray):
        listed = sorted(listed, key=lambda x: (-x[1], x[0]))
        self.shape, self.total, self.types = shape, total, types
        self.ids = {t: i for i, (t, _) in enumerate(listed)}
        self.counts = np.array([c for _, c in listed], np.int64)
        groups = np.array([group_of(t, shape.groups) for t, _ in listed], np.int64)
        own = min(shape.words, len(listed))
        mass = group_mass - np.bincount(groups[:own], self.counts[:own], shape.groups)
        self.group_room = np.log10(mass + 0.5 * (group_types - np.bincount(groups[:own], minlength=shape.groups) + 1))
        self.output = np.concatenate([np.arange(own), shape.words + groups[own:], [0]])  # of each listed token; one more for none
        self.log_count = np.log10(np.append(self.counts, 0) + 0.5)
        self.base_room = float(np.log10(total + 0.5 * (types + 1)))
        # outputs in order of their share, 64 a class: frequent words are told apart first
        share = np.concatenate([self.counts[:own] + 0.5, np.full(shape.words - own, 1e-3), mass + 0.5])
        order = np.argsort(-share, kind="stable")
        size = -(-shape.outputs // shape.classes)
        self.place = np.empty(shape.outputs, np.int64)  # output -> place; class = place // size
        self.place[order] = np.arange(shape.outputs)
        self.size = size
        self.share = np.full(shape.classes * size, 1e-9)
        self.share[: shape.outputs] = share[order] / share.sum()

    def code(self, words: pa.Array) -> np.ndarray:
        """Index of each word in the list, or -1 - group."""
        words, groups = words.to_pylist(), self.shape.groups
        out = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(out < 0)
        out[rare] = [-1 - group_of(words[i], groups) for i in rare.tolist()]
        return out

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each code the place of its output, whether that is a group, the group's room, and the log10 of its count (0 if not listed)."""
        rare, at = codes < 0, np.maximum(codes, 0)
        output = np.where(rare, self.shape.words - 1 - codes, self.output[at])
        group = output - self.shape.words
        return self.place[output], group >= 0, self.group_room[np.maximum(group, 0)], np.where(rare, 0.0, self.log_count[at])


class Model:
    """Log-bilinear: the sum of the context words' vectors, each scaled by a vector of its position, is matched with output vectors.

    P(word | context) = P(class | context) P(word | class, context), each factor a softmax of such matches plus a
    bias. Biases begin at the logarithms of the shares, so the untrained model is the unigram model.
    """

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        s, rng = vocabulary.shape, np.random.default_rng(seed)
        self.size, self.classes, self.context = vocabulary.size, s.classes, s.context
        places = s.classes * vocabulary.size
        self.pad = places  # the context before a text begins
        self.p = {
            "R": rng.normal(0, 0.1, (places + 1, s.width)), "P": np.ones((s.context, s.width)) / s.context,
            "Q": rng.normal(0, 0.1, (places, s.width)), "b": np.zeros(places), "K": np.zeros((s.classes, s.width)), "a": np.zeros(s.classes),
        }
        by_class = vocabulary.share.reshape(s.classes, -1).sum(1)
        within = vocabulary.share / np.repeat(by_class, vocabulary.size)
        self.p["b"], self.p["a"] = np.log(within), np.log(by_class)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.squares = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self.noise_class, self.noise_word = np.log(by_class).astype(np.float32), np.log(within).astype(np.float32)
        self.share, self.by_class = vocabulary.share, by_class

    def flat(self) -> np.ndarray:
        """All parameters and the squares of their gradients in a row."""
        return np.concatenate([v.ravel() for d in (self.p, self.squares) for v in d.values()])

    def fill(self, flat: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.squares):
            for k, v in d.items():
                d[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size

    def _hidden(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the window's words, and for each position behind the context the scaled sum of those before it.

        A word's vector is read once, though it is in the context of several positions.
        """
        c, p = self.context, self.p
        words = np.take(p["R"], window, axis=0)
        n = len(window) - c
        hidden = words[c - 1 : c - 1 + n] * p["P"][0]
        for i in range(1, c):
            hidden += words[c - 1 - i : c - 1 - i + n] * p["P"][i]
        return words, hidden

    def _sorted(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that are no pads in order of their place (hence of class), their places, and the cuts between classes."""
        true = window[self.context :]
        order = np.argsort(true.astype(np.int16) if self.pad < 1 << 15 else true, kind="stable")  # 16 bits are sorted by digits
        order = order[: len(order) - np.count_nonzero(true == self.pad)]  # pads come last
        places = true[order]
        return order, places, np.searchsorted(places, np.arange(self.classes + 1) * self.size)

    def train(self, window: np.ndarray, rng: np.random.Generator, rate: float = 0.1, noise: int = 16) -> None:
        """One step of noise-contrastive estimation with AdaGrad, over the positions of a window that are no pads.

        Noise classes are drawn from the classes' shares, noise words for each class from the shares within it; the
        tokens of the batch, or of the class in the batch, share them, so that scores are matrix products.
        """
        p, c, size = self.p, self.context, self.size
        P, Q, K = p["P"], p["Q"], p["K"]
        words, every = self._hidden(window)
        order, places, cuts = self._sorted(window)
        if not len(order):
            return
        hidden, counts = every[order], np.diff(cuts)
        lift = np.float32(np.log(noise))

        def drawn(share: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Noise by share, ``noise`` times from each stretch low <= i < high: what is drawn, how often, and the cuts between stretches."""
            ends = np.concatenate([[0], np.cumsum(share)])
            spot = ends[low, None] + rng.random((len(low), noise)) * (ends[high] - ends[low])[:, None]
            found = np.searchsorted(ends, spot, "right") - 1
            found, times = np.unique(np.clip(found, low[:, None], high[:, None] - 1), return_counts=True)
            return found, times, np.searchsorted(found, np.append(low, high[-1]))

        def against(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, times: np.ndarray) -> np.ndarray:
            """Gradient of the noise scores: - times * sigma."""
            x = h @ vectors.T
            x += bias
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            return np.divide(-times.astype(np.float32), x, out=x)

        def towards(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
            """Gradient of the true scores: 1 - sigma."""
            return 1 / (1 + np.exp(np.einsum("nd,nd->n", hidden, vectors) + bias))

        some, times, _ = drawn(self.by_class, np.array([0]), np.array([self.classes]))
        g = against(hidden, K[some], p["a"][some] - self.noise_class[some] - lift, times)
        back = g @ K[some]
        grad_k, grad_a = np.zeros_like(K), np.zeros_like(p["a"])
        grad_k[some], grad_a[some] = g.T @ hidden, g.sum(0)
        near = np.repeat(K, counts, axis=0)
        own = towards(near, np.repeat(p["a"] - self.noise_class - lift, counts))
        near *= own[:, None]
        back += near
        pull = hidden * own[:, None]
        full = np.flatnonzero(counts)
        grad_k[full] += np.add.reduceat(pull, cuts[full], axis=0)
        grad_a[full] += np.add.reduceat(own, cuts[full])

        grad_q, grad_b = np.zeros_like(Q), np.zeros_like(p["b"])
        every_some, every_times, ends = drawn(self.share, np.arange(self.classes) * size, np.arange(1, self.classes + 1) * size)
        for k in full.tolist():
            rows = slice(cuts[k], cuts[k + 1])
            some, times = every_some[ends[k] : ends[k + 1]], every_times[ends[k] : ends[k + 1]]
            h, vectors = hidden[rows], Q[some]
            g = against(h, vectors, p["b"][some] - self.noise_word[some] - lift, times)
            back[rows] += g @ vectors
            grad_q[some], grad_b[some] = g.T @ h, g.sum(0)
        near = Q[places]
        own = towards(near, (p["b"] - self.noise_word - lift)[places])
        near *= own[:, None]
        back += near
        starts = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
        grad_q[places[starts]] += np.add.reduceat(np.multiply(hidden, own[:, None], out=pull), starts, axis=0)
        grad_b[places[starts]] += np.add.reduceat(own, starts)
        for name, grad in (("K", grad_k), ("a", grad_a), ("Q", grad_q), ("b", grad_b)):
            self._step(name, slice(None), grad, rate)

        by_position = np.zeros_like(every)
        by_position[order] = back
        n, grad_p, grad = len(every), np.empty_like(P), np.zeros_like(words)
        for i in range(c):
            there = slice(c - 1 - i, c - 1 - i + n)
            grad_p[i] = np.einsum("nd,nd->d", by_position, words[there])
            grad[there] += by_position * P[i]
        self._step("P", slice(None), grad_p, rate)
        order = np.argsort(window.astype(np.int16) if self.pad < 1 << 15 else window, kind="stable")
        rows = window[order]
        starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
        self._step("R", rows[starts], np.add.reduceat(grad[order], starts, axis=0), rate)

    def _step(self, name: str, rows, grad: np.ndarray, rate: float) -> None:
        square = self.squares[name]
        square[rows] += grad * grad
        self.p[name][rows] += rate * grad / np.sqrt(square[rows])

    def log_probs(self, window: np.ndarray, step: int = 4096) -> np.ndarray:
        """Natural log-probabilities of the window's words behind its context: matrix products for the classes and for the words of each class."""
        p, size = self.p, self.size
        _, every = self._hidden(window)
        order, places, cuts = self._sorted(window)
        hidden = every[order]
        found = np.empty(len(order))
        for at in range(0, len(order), step):
            rows = slice(at, at + step)
            found[rows] = _log_share(hidden[rows], p["K"], p["a"], places[rows] // size)
        for k in range(self.classes):
            own = slice(k * size, (k + 1) * size)
            for at in range(cuts[k], cuts[k + 1], step):
                rows = slice(at, min(at + step, cuts[k + 1]))
                found[rows] += _log_share(hidden[rows], p["Q"][own], p["b"][own], places[rows] - own.start)
        out = np.zeros(len(every))
        out[order] = found
        return out[window[self.context :] != self.pad]


def _log_share(hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of ``hidden @ vectors.T + bias`` at the true columns."""
    s = hidden @ vectors.T
    s += bias
    picked = s[np.arange(len(s)), true].astype(np.float64)
    top = s.max()  # one for all rows: cheaper than one for each
    s -= top
    total = np.exp(s, out=s) @ np.ones(s.shape[1], np.float32)
    low = np.flatnonzero(total < 1e-25)
    total = top + np.log(np.maximum(total, 1e-30)).astype(np.float64)
    if len(low):  # rows far below the top one
        s = hidden[low] @ vectors.T + bias
        own = s.max(1)
        total[low] = own + np.log(np.exp(s - own[:, None]).sum(1))
    return picked - total


def joined_stream(texts: list[np.ndarray], context: int, pad: int) -> np.ndarray:
    """Places of texts one after the other, each behind as many pads as there are context positions."""
    gap = np.full(context, pad, np.int64)
    return np.concatenate([x for t in texts for x in (gap, t)]) if texts else gap[:0]


def windows(stream: np.ndarray, context: int, size: int = BATCH) -> Iterator[np.ndarray]:
    """Stretches of a stream that hold ``size`` positions and the context before them."""
    for at in range(context, len(stream), size):
        yield stream[at - context : at + size]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over ``text``: counted in each task first, so that a frequent token is a row a task in the shuffle."""

    def work(batches):
        seen: defaultdict = defaultdict(int)

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])
            seen.clear()
            return out

        for b in batches:
            for part in slices(b, "text"):
                tokens = Tokens.of(part.column("text"))
                for word, n in zip(tokens.words.to_pylist(), np.bincount(tokens.at, minlength=len(tokens.words)).tolist(), strict=True):
                    seen[word] += n
                if len(seen) > 200_000:
                    yield batch()
        if seen:
            yield batch()

    return docs.select("text").mapInArrow(work, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def learn_vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """The most frequent tokens, at most ``shape.listed``: a threshold found from the tokens' numbers by count range."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    range_of = F.floor(F.log2("c") * 16)
    able = counts.where(F.octet_length("token") <= shape.longest)
    room, least = shape.listed, None
    for r in sorted(able.groupBy(range_of.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.r):  # some hundreds
        if r.n > room:
            break
        room, least = room - r.n, r.r
    listed = [(bytes(r.token), r.c) for r in able.where(range_of >= least).collect()] if least is not None else []
    mass, kinds = np.zeros(shape.groups), np.zeros(shape.groups)
    last = F.substring(F.col("token"), -3, 3)
    for r in counts.groupBy(F.pmod(F.crc32(last), F.lit(shape.groups)).alias("g")).agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("n")).collect():
        mass[r.g], kinds[r.g] = r.m, r.n
    return Vocabulary(shape, listed, total, types, mass, kinds)


def cells_of(tokens: int, cell: int = CELL) -> tuple[int, int]:
    """(rounds, shards): about ``cell`` tokens for each shard in each round; many shards before many rounds, ``MOST_ROUNDS`` at most."""
    cells = max(1, -(-tokens // cell))
    rounds = min(MOST_ROUNDS, max(1, cells // 8))
    return rounds, -(-cells // rounds)


def train(docs: DataFrame, vocabulary: Vocabulary, seed: int = 7, cell: int = CELL) -> Model:
    """A model that has seen every token of ``text`` once; ``docs`` has ``id`` and ``text``.

    A hash of id and text deals texts to rounds and, within a round, to shards; their numbers follow from the number of
    tokens alone. In each round a shard trains a copy of the model on its texts in order of the hash; the copies,
    weighted by their tokens, are averaged in order of shard, and the next round begins from there. So the model does
    not depend on how the table is split. Texts travel as 16- or 32-bit places. Parameters are cut into ``BLOCKS`` blocks that as
    many tasks sum in a streaming way.
    """
    spark = docs.sparkSession
    rounds, shards = cells_of(vocabulary.total, cell)
    words = spark.sparkContext.broadcast(vocabulary)
    model = Model(vocabulary, seed)
    narrow = np.uint16 if model.pad < 1 << 16 else np.uint32

    def code(batches):
        for b in batches:
            for part in slices(b, "text"):
                tokens = Tokens.of(part.column("text"))
                places = words.value.parts(words.value.code(tokens.words))[0].astype(narrow)[tokens.at]
                texts = [places[a : a + n].tobytes() for a, n in zip(tokens.starts.tolist(), tokens.sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.binary())], names=["key", "places"])

    key = F.xxhash64(F.col("id").cast("string"), F.col("text"))
    coded = checkpoint(docs.select(key.alias("key"), "text").mapInArrow(code, "key long, places binary"))
    spot = F.pmod(F.col("key"), F.lit(rounds * shards))
    coded = coded.withColumn("round", (spot % rounds).cast("int")).withColumn("shard", F.floor(spot / rounds).cast("int"))

    def work(batches):
        for shard, texts in _by_shard(batches, narrow):
            own = Model(words.value, seed)
            own.fill(shared.value)
            rng, seen, c = np.random.default_rng([seed, at, shard]), 0, own.context
            stream = np.zeros(0, np.int64)
            for part in texts:  # windows run on over texts and batches
                seen += sum(map(len, part))
                stream = np.concatenate([stream, joined_stream(part, c, own.pad)])
                whole = (len(stream) - c) // BATCH * BATCH
                if whole > 0:
                    for window in windows(stream[: whole + c], c):
                        own.train(window, rng)
                    stream = stream[whole:]
            for window in windows(stream, c):
                own.train(window, rng)
            parts = np.array_split(own.flat().astype(np.float64) * seen, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([seen] * BLOCKS, pa.int64())], names=["block", "shard", "x", "seen"])

    def add(batches):
        last, total, seen = None, 0.0, 0
        for b in batches:
            for k, x, n in zip(*(b.column(i).to_pylist() for i in ("block", "x", "seen")), strict=True):
                if last is not None and k != last:
                    yield _block(last, total, seen)
                    total, seen = 0.0, 0
                last, total, seen = k, total + np.frombuffer(x, np.float64), seen + n
        if last is not None:
            yield _block(last, total, seen)

    for at in range(rounds):
        shared = spark.sparkContext.broadcast(model.flat())
        dealt = coded.where(F.col("round") == at).repartition(3 * shards, "shard").sortWithinPartitions("shard", "key")
        copies = dealt.select("shard", "places").mapInArrow(work, "block int, shard int, x binary, seen long").repartition("block").sortWithinPartitions("block", "shard")
        rows = copies.mapInArrow(add, "block int, x binary, seen long").collect()  # the model's size
        if rows:
            model.fill(np.concatenate([np.frombuffer(r.x, np.float64) / r.seen for r in sorted(rows, key=lambda r: r.block)]))
        shared.unpersist()
    return model


def _by_shard(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple[int, Iterator[list[np.ndarray]]]]:
    """(shard, its texts' places, some texts at a time) for rows that come sorted by shard."""

    def runs():
        for b in batches:
            shards, places = b.column("shard").to_numpy(), b.column("places")
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    yield int(shards[s]), [np.frombuffer(x, kind).astype(np.int64) for x in places.slice(s, e - s).to_pylist()]

    for shard, some in groupby(runs(), key=lambda r: r[0]):
        yield shard, (texts for _, texts in some)


def _block(block: int, total: np.ndarray, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["block", "x", "seen"])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None, seed: int = 7, cell: int = CELL) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``held_out`` is a boolean column: rows where it is true are not learned from; null is false.
    ``base_score`` is the add-half unigram log10-probability, ``score`` the model's; both sum over all tokens of the
    whole text and its end. Null and empty texts are an end alone. Repeated rows count each time and repeat in the
    result; sums have no ties to break. If nothing is learned from, the model is uniform over its outputs. An empty table gives
    no rows. Other columns are not passed on, so their names cannot clash. A very long text is one row of one task, its memory a
    few times its size; it is tokenised whole and scored in windows. ``cell`` is the number of tokens a shard trains on in a round.

    Counts of the most frequent tokens, a bounded list, are broadcast. The other tokens of a text are joined with
    the counts of the whole corpus by token; being rare, none is hot. A text's own part travels with a key of its
    own, so one pass over the texts serves both.
    """
    shape = shape or Shape()
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    known = rows.where(~F.col("held"))
    counts = checkpoint(count_tokens(known))
    vocabulary = learn_vocabulary(counts, shape)
    model = train(known, vocabulary, seed, cell)
    model.squares = {}
    shared = spark.sparkContext.broadcast((vocabulary, model))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        vocabulary, model = shared.value
        for b in batches:
            for part in slices(b, "text"):
                tokens = Tokens.of(part.column("text"))
                codes = vocabulary.code(tokens.words)
                places, grouped, room, count = (x[tokens.at] for x in vocabulary.parts(codes))
                stream = joined_stream(np.split(places, tokens.starts[1:]), model.context, model.pad)
                logs = np.concatenate([model.log_probs(window) for window in windows(stream, model.context, 8 * BATCH)]) / LN10
                rare = codes[tokens.at] < 0
                logs += np.where(grouped, count - room, 0)
                base, total, listed = (np.add.reduceat(x, tokens.starts) for x in (count - vocabulary.base_room, logs, (~rare).astype(np.int64)))
                n, kinds = part.num_rows, len(tokens.words)
                late = np.flatnonzero(rare)
                late, times = np.unique(np.repeat(np.arange(n), tokens.sizes)[late] * kinds + tokens.at[late], return_counts=True)
                owner, m = pa.array(late // kinds), len(late)
                own = pa.array([b" %d %d" % (k, i) for i, k in enumerate(part.column("key").to_pylist())], pa.binary())  # no word has a space: it joins with nothing
                rest = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays([
                    *(pa.concat_arrays([x, x.take(owner)]) for x in map(part.column, ("id", "held", "key"))), pa.concat_arrays([own, tokens.words.take(pa.array(late % kinds))]), pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                    *(pa.array(np.concatenate([x, rest.astype(x.dtype)])) for x in (np.ones(n, np.int64), tokens.sizes, listed, base, total)),
                ], names=["id", "held", "key", "token", "times", "own", "n_tokens", "listed", "base", "total"])

    # a token outside the list takes base_room off in `base` and its group's room in `total`; its count is still to come
    spread = rows.select("id", "held", F.xxhash64("text").alias("key"), "text").mapInArrow(work, f"id {kind}, held boolean, key long, token binary, times long, own long, n_tokens long, listed long, base double, total double")
    table = counts.select(F.col("token").alias("_t"), "c")
    joined = spread.join(table, F.col("token") == F.col("_t"), "left")
    late = F.when(F.col("own") == 0, F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")).otherwise(0.0)
    seen = F.when((F.col("own") == 0) & (F.col("c") > 0), F.col("times")).otherwise(0)
    sums = joined.groupBy("id", "held", "key").agg(
        F.sum("own").alias("copies"), F.sum("n_tokens").alias("n"), (F.sum("listed") + F.sum(seen)).alias("k"), (F.sum("base") + F.sum(late)).alias("b"), (F.sum("total") + F.sum(late)).alias("s")
    )
    each = sums.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return each.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("k") / F.col("copies")).cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("b") / F.col("copies")).alias("base_score"), (F.col("s") / F.col("copies")).alias("score"),
    )
