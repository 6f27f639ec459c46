"""Benchmark decontamination by a generalised suffix automaton of the normalised benchmark items."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import fresh, others, text_udf

#: Characters of items in one automaton: some 110 bytes each in a Python worker, so 330 MB.
MOST_CHARS = 3_000_000
#: Bytes that are part of a word once A-Z is lower-cased (digits, a-z and all of a non-ASCII character).
_WORD = bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD or 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SPANS = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; null has none."""
    return (text or "").encode().translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton over the word ids of all items.

    ``windows`` maps a state to the items one of whose ``window`` consecutive words ends there; ``shorts`` maps a
    state to (length, item) of items of fewer words.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = 13):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.windows: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]) for name, text in items]
        coded = [(name, ids) for name, ids in coded if ids]
        self.least = min([window, *(len(ids) for _, ids in coded)]) if coded else 0
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        for name, ids in coded:
            self._mark(name, ids)
        # for each state: the nearest state on its chain of suffixes where a window, or a short item, can end
        self.at_window = [-1] * len(self.step)
        self.at_short = [-1] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.at_short[s] = s if s in self.shorts else self.at_short[up]

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length

        def split(p: int, q: int) -> int:
            if length[p] + 1 == length[q]:
                return q
            twin = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = twin
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = twin
                p = link[p]
            return twin

        if c in step[last]:  # an earlier item has this string
            return split(last, step[last][c])
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            link[new] = split(p, step[p][c])
        return new

    def _mark(self, name: str, ids: list[int]) -> None:
        state, matched = 0, 0
        for c in ids:
            state, matched = self.step[state][c], matched + 1
            while self.length[self.link[state]] >= self.window:  # keep to the last `window` words
                state = self.link[state]
            matched = min(matched, self.window)
            if matched == self.window:
                self.windows.setdefault(state, set()).add(name)
        if len(ids) < self.window:
            self.shorts.setdefault(state, []).append((len(ids), name))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first, last) word spans inside occurrences of windows, and the items whose windows occur."""
        get, step, link, length, window = self.ids.get, self.step, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.least:
            return spans, items
        state = matched = run = 0
        for at, word in enumerate(words):
            c = get(word)
            if c is None:
                state = matched = 0
                continue
            while c not in step[state]:
                state = link[state]
                if state < 0:
                    break
                matched = length[state]
            if state < 0:
                state = matched = 0
                continue
            state, matched = step[state][c], matched + 1
            if matched < self.least:
                continue
            first = at + 1
            if matched >= window:
                first = at - matched + 1
                items |= self.windows[self.at_window[state]]
            s = self.at_short[state]
            while s >= 0:
                for size, name in self.shorts[s]:
                    if size <= matched:
                        items.add(name)
                        first = min(first, at - size + 1)
                s = self.at_short[link[s]]
            if first <= at:
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))
        return spans, items


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the stretches from the first to the last word of each span, one space left in their place."""
    raw = text.encode()
    at = [m.span() for m in _SPANS.finditer(raw.translate(_FOLD))]
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done : at[first][0]])
        done = at[last][1]
    return b"".join([*out, raw[done:]]).decode()


def _measure(automaton, cut_above: float | None = None):
    """A UDF: n_words, n_hit, items and spans of a text; with ``cut_above`` the text without its spans instead of items and spans,
    and whether it stays. One UDF for both, since two in one stage would hold two Python workers a task."""

    def work(texts: list[str | None]) -> pa.Array:
        found, rows = automaton.value, []
        for text in texts:
            words = words_of(text)
            spans, items = found.scan(words)
            hit = sum(b - a + 1 for a, b in spans)
            if cut_above is None:
                rows.append((len(words), hit, sorted(items), [x for s in spans for x in s]))
            else:
                rows.append((cut_spans(text, spans) if spans else text, not hit > len(words) * cut_above))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    if cut_above is None:
        names, kinds = ["n_words", "n_hit", "items", "spans"], (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return text_udf(work, "struct<n_words: long, n_hit: long, items: array<string>, spans: array<long>>")
    names, kinds = ["text", "stays"], (pa.string(), pa.bool_())
    # marked so that the filter on ``stays`` is not pushed below, which would run the UDF twice
    return text_udf(work, "struct<text: string, stays: boolean>").asNondeterministic()


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    parts = []
    for i in range(0, len(texts), 256):
        rows = zip(texts.slice(i, 256).to_pylist(), spans.slice(i, 256).to_pylist(), strict=True)
        parts.append(pa.array([cut_spans(t, list(zip(s[::2], s[1::2], strict=True))) if t and s else t for t, s in rows], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _merge(many: pa.Array) -> pa.Array:
    out = []
    for flat in many.to_pylist():
        joined: list[list[int]] = []
        for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        out.append([x for s in joined for x in s])
    return pa.array(out, pa.list_(pa.int64()))


def _items(benchmark: DataFrame, item_col: str, item_text: str, most_chars: int) -> tuple[DataFrame, int]:
    """(item, text) and the number of slices that an automaton of bounded size can take."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    return items, -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // most_chars) or 1


def _automaton(items: DataFrame, window: int):
    return items.sparkSession.sparkContext.broadcast(ItemAutomaton([(r.item, r.text) for r in items.collect()], window))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, most_item_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` with a struct ``leak``: n_words, n_hit (long), items (sorted strings) and spans (flat first, last word numbers).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A
    document word inside any occurrence of a window is hit. Null texts and items have no words; repeated items
    count once by id; a null item id counts as the text ``null``. Empty tables give no hits or no rows. Repeated rows repeat in the
    result, which knows no ties. A column ``leak`` is replaced, others pass through. A very long text is scanned whole by one task.

    The automaton is broadcast; its size is bounded by ``most_item_chars`` characters of items. A larger benchmark
    is dealt by item hash into slices of about that size, each scanned by a pass of its own; the spans of a row are
    then merged. Documents are streamed: no shuffle of texts in the first case.
    """
    taken = others(docs, ["leak"])
    base = docs.select(*taken)
    items, slices = _items(benchmark, item_col, item_text, most_item_chars)
    if slices == 1:
        return base.withColumn("leak", _measure(_automaton(items, window))(F.col(text_col)))
    a, b, leak = (fresh(n, taken) for n in ("_k1", "_k2", "_leak"))
    keyed = base.withColumns({a: F.xxhash64(F.col(text_col).isNull(), F.col(text_col)), b: F.xxhash64(F.lit("second"), F.col(text_col))})
    found = None
    for i in range(slices):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i)
        one = keyed.select(a, b, _measure(_automaton(part, window))(F.col(text_col)).alias(leak)).distinct()
        found = one if found is None else found.unionAll(one)
    found = found.groupBy(F.col(a).alias("_j1"), F.col(b).alias("_j2")).agg(
        F.max(f"{leak}.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{leak}.items")))).alias("items"), F.flatten(F.collect_list(f"{leak}.spans")).alias("spans")
    ).withColumn("spans", F.arrow_udf(_merge, "array<long>")("spans"))
    flat = F.col("spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.size(flat) - 1), F.lit(0).cast("long"), lambda n, i: n + F.get(flat, i) * F.when(i % 2 == 0, -1).otherwise(1) + (i % 2).cast("long"))
    n_hit = F.when(F.size(flat) == 0, F.lit(0).cast("long")).otherwise(hit).alias("n_hit")
    found = found.select("_j1", "_j2", F.struct("n_words", n_hit, "items", "spans").alias(leak))
    return keyed.join(found, (F.col(a) == F.col("_j1")) & (F.col(b) == F.col("_j2"))).select(*taken, F.col(leak).alias("leak"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, most_coverage: float = 0.5, most_item_chars: int = MOST_CHARS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut from the texts, and rows that are mostly hits are dropped.

    A span is hit if it lies in occurrences of windows of ``window`` words (or of whole shorter items). A text more
    than ``most_coverage`` of whose words are hit goes with its row. Others, null and empty texts among them, stay. Repeated rows
    are treated alike; an empty table, or an empty benchmark, changes nothing. A column ``leak`` is left out, others pass through.
    """
    taken = others(docs, ["leak"])
    items, slices = _items(benchmark, item_col, item_text, most_item_chars)
    if slices == 1:
        found = fresh("_found", taken)
        made = docs.select(*taken).withColumn(found, _measure(_automaton(items, window), most_coverage)(F.col(text_col)))
        return made.where(F.col(f"{found}.stays")).select(*(F.col(f"{found}.text").alias(c) if c == text_col else F.col(c) for c in taken))
    leak = contamination(docs, benchmark, text_col, item_col, item_text, window, most_item_chars)
    cut = leak.where(~(F.col("leak.n_hit") > F.col("leak.n_words") * F.lit(most_coverage)))
    without = F.arrow_udf(_cut, "string")
    return cut.select(*(without(F.col(c), F.col("leak.spans")).alias(c) if c == text_col else F.col(c) for c in taken))
