"""Language ID by cross-parsing: suffix automata of labelled text; the language needing the fewest normalised phrases wins."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import others, text_udf

#: Symbols of a segment. A text's segments are parsed in step with those of other texts and then joined, as if parsed in one go.
SEGMENT = 2048
#: Segments times languages that are parsed in step: bounds memory whatever the batch.
LANES = 8192
#: Bits of a state in the transition table; a key has as many.
MOST_BITS = 31
#: An entry of the transition table that holds nothing, and an odd number that spreads keys over the table.
FREE, MIX = -1, np.int64(0x9E3779B97F4A7C15 - (1 << 64))


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the root."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return step


class LanguageModel:
    """Suffix automata of the languages' texts, with their transitions in one open hash table.

    The table has four to eight entries of 8 bytes for each transition (some 100 bytes for each symbol learned from), whatever the number of
    letters. States are numbered through all languages; ``roots`` has each language's first.

    A parse is greedy: a phrase is the longest stretch of the rest that occurs in the language's text; a symbol that does not occur
    at all is a phrase of its own.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted(set("".join(samples.values())) - {" "})
        self.space, self.symbols = 1, len(letters) + 2  # symbol 0: a letter that no language's text has
        self.codes = np.fromiter((0 if chr(c).isalpha() else self.space for c in range(0x110000)), np.int32, 0x110000)
        for i, c in enumerate(letters):
            self.codes[ord(c)] = i + 2
        steps = [automaton(self.codes[np.frombuffer(samples[x].encode("utf-32-le", "surrogatepass"), np.uint32)]) for x in self.languages]
        self.norms = np.log2([max(2, len(samples[x])) for x in self.languages])
        starts = np.cumsum([0, *map(len, steps)])
        # a state stands as its number times the number of symbols, so that adding a symbol makes a key
        self.roots = starts[:-1] * self.symbols
        keys = [(n + s) * self.symbols + c for n, step in zip(starts.tolist(), steps, strict=False) for s, to in enumerate(step) for c in to]
        values = [(n + t) * self.symbols for n, step in zip(starts.tolist(), steps, strict=False) for to in step for t in to.values()]
        self.low = int(starts[-1] * self.symbols).bit_length()
        if self.low > MOST_BITS:
            raise ValueError("too many letters and states for one table: learn from fewer rows")
        self._fill(np.array(keys, np.int64), np.array(values, np.int64))
        root = np.repeat(self.roots, self.symbols)
        to, missing = self._look(root + np.tile(np.arange(self.symbols), len(steps)))
        to[missing] = root[missing]
        self.first = to  # where a symbol leads from the root: to itself if no phrase begins with it

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX).view(np.uint64) >> np.uint64(64 - self.bits)).view(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Entries hold a key and, in their last bits, a state."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, FREE, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.table[slot] == FREE
            self.table[slot[free]] = (keys[left[free]] << self.low) | values[left[free]]  # of several for one slot the last stays
            mine = self.table[slot] >> self.low == keys[left]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, which keys have none). An entry less its key is the state; anything else is no smaller than 1 << low."""
        slot, wanted, least = self._slot(keys), keys << self.low, np.uint64(1 << self.low)
        to = self.table[slot]
        to ^= wanted
        missing = np.flatnonzero(to.view(np.uint64) >= least)
        at = slot[missing]
        go = self.table[at] != FREE
        more, at = missing[go], at[go]
        while len(more):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.table[at]
            rest = got ^ wanted[more]
            hit = rest.view(np.uint64) < least
            to[more[hit]] = rest[hit]
            go = ~hit & (got != FREE)
            more, at = more[go], at[go]
        return to, missing[to[missing].view(np.uint64) >= least]

    def _miss(self, keys: np.ndarray, symbols: np.ndarray, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, phrases that end) of keys without a transition: a phrase ends, and the symbol begins one or is one."""
        first, root = self.first[languages * self.symbols + symbols], self.roots[languages]
        return first, (keys - symbols != root).view(np.int8) + (first == root)

    def fold(self, text: str) -> np.ndarray:
        """Symbols of a text: letters lower-cased, each other run one space, one space at either end. Empty: no letter."""
        codes = self.codes[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = codes == self.space
        keep = ~gap
        keep[0] = True
        keep[1:] |= gap[1:] & ~gap[:-1]
        codes = codes[keep]
        return codes if len(codes) > 1 else codes[:0]

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text (rows) in each language (columns), the text parsed whole."""
        n = len(self.roots)
        total, state = np.zeros((len(coded), n), np.int64), np.tile(self.roots, (len(coded), 1))
        room, segments = max(1, LANES // n), []
        for k, c in enumerate(coded):
            for at in range(0, len(c), SEGMENT):
                segments.append((k, c[at : at + SEGMENT]))
                if len(segments) == room:
                    self._join(segments, total, state)
                    segments = []
        self._join(segments, total, state)
        return total + (state != self.roots)

    def _join(self, segments: list[tuple[int, np.ndarray]], total: np.ndarray, state: np.ndarray) -> None:
        """Parses segments, in order within each text, on from ``state``; adds their phrases to ``total``.

        First all segments are parsed in step, each from the root. Then, a text's segments one after the other, the true state is
        carried into the segment until it meets that of the first parse; from there on the two are one.
        """
        if not segments:
            return
        n = len(self.roots)
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i][1]))
        sizes = np.array([len(segments[i][1]) for i in order])
        lane = {i: x for x, i in enumerate(order)}
        grid = np.zeros((sizes[0], len(order)), np.int32)
        for i, x in lane.items():
            grid[: sizes[x], x] = segments[i][1]
        states, ended = np.zeros((sizes[0], n, len(order)), np.int32), np.zeros((sizes[0], n, len(order)), np.int8)
        end, now = np.zeros((n, len(order)), np.int64), np.repeat(self.roots[:, None], len(order), 1)
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")  # lanes as long as that or longer
        for at, m in enumerate(alive.tolist()):
            if m < now.shape[1]:
                end[:, m : now.shape[1]] = now[:, m:]
                now = now[:, :m]
            keys = (now + grid[at, :m]).ravel()
            to, missing = self._look(keys)
            row = missing // m
            column = missing - row * m
            to[missing], ended[at, row, column] = self._miss(keys[missing], grid[at, column], row)
            now = to.reshape(n, m)
            states[at, :, :m] = now
        end[:, : now.shape[1]] = now
        counts = ended.sum(0, dtype=np.int64)

        rounds: dict[int, list[tuple[int, int]]] = {}
        seen: dict[int, int] = {}
        for i, (k, _) in enumerate(segments):
            rounds.setdefault(seen.get(k, 0), []).append((k, lane[i]))
            seen[k] = seen.get(k, 0) + 1
        for pairs in (rounds[r] for r in sorted(rounds)):
            texts, lanes = (np.repeat(np.array(x), n) for x in zip(*pairs, strict=True))
            which = np.tile(np.arange(n), len(pairs))
            carried, gain = state[texts, which], counts[which, lanes]
            state[texts, which] = end[which, lanes]
            left = np.flatnonzero(carried != self.roots[which])
            carried = carried[left]
            for at in range(sizes[0]):
                over = at >= sizes[lanes[left]]
                if over.any():
                    state[texts[left[over]], which[left[over]]] = carried[over]
                    left, carried = left[~over], carried[~over]
                if not len(left):
                    break
                own, symbols = lanes[left], grid[at, lanes[left]]
                keys = carried + symbols
                carried, missing = self._look(keys)
                gain[left] -= ended[at, which[left], own]
                carried[missing], phrases = self._miss(keys[missing], symbols[missing], which[left[missing]])
                gain[left[missing]] += phrases
                apart = carried != states[at, which[left], own]
                left, carried = left[apart], carried[apart]
            state[texts[left], which[left]] = carried
            total[texts, which] += gain

    def rates(self, coded: list[np.ndarray]) -> np.ndarray:
        """Normalised phrases for each folded text and language: phrases * log2(size of the language's text) / symbols."""
        sizes = np.array([max(1, len(c)) for c in coded])
        return self.phrases(coded) * self.norms / sizes[:, None]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 12, longest: int = 20_000, most_languages: int = 64) -> LanguageModel | None:
    """Fit a model on a bounded sample of rows with a label and a text; the texts of these rows are learned whole.

    A first pass counts the different labelled texts of at most ``longest`` characters by language; a second takes about
    ``sample_docs`` of them for each language by a hash of the text, so copies count once. So at most some ``sample_docs * longest`` characters of each of the
    ``most_languages`` most frequent languages are held, and fewer rows of each where letters and symbols together would need a table of
    more than 2**31 entries if it were dense. Languages with fewer rows give what they have.
    None if no labelled text has a letter.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) <= longest))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.approx_count_distinct(text_col, 0.02).alias("n")).orderBy(F.desc("n"), lang_col).limit(most_languages).collect()}
    if not counts:
        return None
    mark = F.xxhash64(F.lit("language sample"), F.col(text_col))
    share = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1_000_000, -(-1_000_000 * sample_docs // n)))))), F.col(lang_col))
    rows = known.where(F.pmod(mark, F.lit(1_000_000)) < share).select(F.col(lang_col).alias("lang"), mark.alias("h"), F.col(text_col).alias("t")).distinct().collect()
    rows.sort(key=lambda r: (r.lang, r.h, r.t))
    most = 2 * sample_docs  # the draw is about half of that; never more
    while True:
        samples: dict[str, str] = {}
        taken = Counter()
        for r in rows:
            taken[r.lang] += 1
            if taken[r.lang] <= most:
                folded = " ".join("".join(c if c.isalpha() else " " for c in r.t.lower()).split())
                samples[r.lang] = samples.get(r.lang, " ") + folded + " "
        samples = {k: v for k, v in samples.items() if any(c.isalpha() for c in v)}
        if not samples:
            return None
        if most == 1 or 2 * sum(map(len, samples.values())) * (len(set("".join(samples.values()))) + 2) < 1 << MOST_BITS:
            return LanguageModel(samples)
        most = max(1, most // 2)


def _predict(model):
    def work(texts: list[str | None]) -> pa.Array:
        m, n = model.value, len(texts)
        lang, score, rate = ["und"] * n, [0.0] * n, [None] * n
        folded = [(i, f) for i, t in enumerate(texts) if m is not None and t for f in [m.fold(t)] if len(f)]
        if folded:
            found = m.rates([f for _, f in folded])
            best = found.argmin(1)
            weight = np.exp2(found.min(1, keepdims=True) - found).sum(1)
            for k, (i, _) in enumerate(folded):
                lang[i], score[i], rate[i] = m.languages[best[k]], 1 / weight[k], found[k, best[k]]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["lang", "score", "rate"])

    return text_udf(work, "struct<lang: string, score: double, rate: double>", rows=1024)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrase_rate``.

    A text is folded (letters lower-cased, other runs one space) and parsed whole against each language. The language with the
    lowest normalised phrase count wins; ties go to the first in name order. ``score`` is its share among the languages'
    weights 2**-rate, 0 to 1; ``phrase_rate`` is its normalised phrases a character. Texts that are null or have no letter
    are ``und`` with score 0 and rate null, as are all texts without a model. Rows are independent: repeated rows get one
    answer, an empty table none. Columns named like a result column are replaced, others pass through. A very long text is
    parsed whole by one task, its symbols in memory.
    """
    taken = others(docs, ["lang_pred", "score", "phrase_rate"])
    found = docs.select(*taken).withColumn("_found", _predict(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col)))
    return found.select(*taken, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.rate").alias("phrase_rate"))
