"""Chat formatting by incremental black-box rendering: turn spans, loss masks and templates that rewrite history."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

#: Strings that chat formats give a meaning, and that a text must therefore not hold as they are.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


class Template:
    """``[INST] role [/INST]text</s>`` for each turn, with control strings in roles and texts escaped.

    Escaping puts a backslash behind the first character of a control string and doubles backslashes; it is undone
    exactly by ``unescape``.
    """

    def __init__(self, opening: str = "[INST] ", middle: str = " [/INST]", closing: str = "</s>", control: Sequence[str] = CONTROL):
        self.opening, self.middle, self.closing = opening, middle, closing
        words = sorted({*control, opening.strip(), middle.strip(), closing.strip()}, key=len, reverse=True)
        self._risky = re.compile(r"\\|" + "|".join(map(re.escape, words)))

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.?)", lambda m: m[1], text, flags=re.DOTALL) if "\\" in text else text

    def __call__(self, turns: Sequence[Turn]) -> str:
        return "".join(f"{self.opening}{self.escape(r)}{self.middle}{self.escape(t)}{self.closing}" for r, t in turns)

    def parse(self, text: str) -> list[Turn]:
        """The turns of a rendered text."""
        out, at = [], 0
        while at < len(text):
            if not text.startswith(self.opening, at):
                raise ValueError(f"no turn begins at {at}")
            mid = text.index(self.middle, at + len(self.opening))
            end = text.index(self.closing, mid + len(self.middle))
            out.append((self.unescape(text[at + len(self.opening) : mid]), self.unescape(text[mid + len(self.middle) : end])))
            at = end + len(self.closing)
        return out


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def common_suffix(a: str, b: str) -> int:
    return common_prefix(a[::-1], b[::-1])


def turn_spans(render: Callable[[Sequence[Turn]], str], turns: Sequence[Turn], loss_roles: Sequence[str] = ("assistant",)) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(rendered text, (start, end, loss start, loss end) of each turn, whether the template rewrote earlier turns).

    ``render`` is a black box. The turns' prefixes are rendered one after the other; what a rendering has beyond the
    one before is the turn's span. A tail that every rendering ends in (an end mark) belongs to no turn. If a
    rendering changes anything before that, the template rewrites history, and the span begins where it changes.
    A text's place within its turn is found by rendering two one-character texts in its stead: they agree on all
    but the text. Turns of other roles have an empty loss span at their end.
    """
    before, spans, rewrites = render(turns[:0]), [], False
    for k, (role, _) in enumerate(turns, 1):
        out = render(turns[:k])
        start, end = len(before), len(out)
        if not out.startswith(before):
            start = common_prefix(before, out)
            tail = before[start:]
            if out.endswith(tail):
                end = len(out) - len(tail)
            else:
                rewrites = True
        low = high = end
        if role in loss_roles:
            one, two = (render([*turns[: k - 1], (role, x)]) for x in "\x02\x03")
            low = common_prefix(one, two)
            high = len(out) - common_suffix(one, two)
        spans.append((start, end, low, high))
        before = out
    return before, spans, rewrites


def format_conversations(table: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 32) -> DataFrame:
    """Conversations as training text: (conv_id, part, formatted, n_turns, spans, rewrites), parts in order within a partition.

    A conversation is formatted in parts of ``block`` turns, so that rendering all prefixes costs in proportion to
    its length and no task holds a conversation of any size whole: rows are dealt by conversation, sorted and
    streamed. Each part is rendered behind the last turn of the part before, whose rendering must come out as it
    did; otherwise the template depends on more than that and the part is marked ``rewrites``. ``spans`` holds
    start, end, loss_start and loss_end of each turn, in characters of the part. Concatenated parts are the text.

    Turns are ordered by turn, then role and text (nulls first); repeated rows are turns of their own. Null roles
    and texts count as empty. Rows with a null conversation id are one conversation. Extra columns are left out.
    """
    template = template or Template()
    kind = table.schema[conv_col].dataType.simpleString()
    rows = table.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        state = {"conv": None, "part": 0, "held": [], "last": None}

        def flush() -> None:
            held = state["held"]
            if not held:
                return
            ahead = [state["last"][0]] if state["last"] else []
            text, spans, rewrites = turn_spans(template, ahead + held)
            skip = 0
            if ahead:
                start, skip, *_ = spans.pop(0)
                rewrites |= text[start:skip] != state["last"][1]
            start, end, *_ = spans[-1]
            made.append((state["conv"], state["part"], text[skip:], len(held), [{"start": a - skip, "end": b - skip, "loss_start": c - skip, "loss_end": d - skip} for a, b, c, d in spans], rewrites))
            state.update(part=state["part"] + 1, held=[], last=(held[-1], text[start:end]))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*made, strict=True))
            made.clear()
            types = (conv_type[0], pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "loss_start", "loss_end")])), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "part", "formatted", "n_turns", "spans", "rewrites"])

        begun, conv_type, size = False, [None], 0
        for b in batches:
            conv_type[0] = b.schema.field("conv_id").type
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != state["conv"]:
                    flush()
                    begun = True
                    state.update(conv=conv, part=0, held=[], last=None)
                elif len(state["held"]) == block:
                    flush()
                state["held"].append((role, text))
                size += len(text)
                if size > 4_000_000 and made:
                    yield batch_of()
                    size = 0
        flush()
        if made:
            yield batch_of()

    return rows.mapInArrow(work, f"conv_id {kind}, part bigint, formatted string, n_turns bigint, spans array<struct<start: bigint, end: bigint, loss_start: bigint, loss_end: bigint>>, rewrites boolean")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of ``format_conversations``' output, one row a conversation, read from the formatted text alone.

    Parts follow one another within a partition, as the formatter leaves them; digests are updated part by part.
    """
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, kind_of = None, None, None
        made: list[tuple] = []

        def close() -> None:
            if now:
                made.append((conv, now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"], now["rewrites"]))

        for b in batches:
            kind_of = b.schema.field("conv_id").type
            for c, text, spans, rewrites in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "spans", "rewrites")), strict=True):
                if now is None or c != conv:
                    close()
                    conv, now = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "rewrites": False}
                for role, said in template.parse(text):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learned = template.unescape(text[s["loss_start"] : s["loss_end"]])
                    now["chars"] += len(learned)
                    now["loss"].update(learned.encode())
                now["size"] += len(text)
                now["rewrites"] |= rewrites
        close()
        if made:
            types = (kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return formatted.select("conv_id", "formatted", "spans", "rewrites").mapInArrow(work, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean")
