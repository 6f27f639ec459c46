"""SentencePiece encoding and decoding by streaming Viterbi over a bounded window of the lattice."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import others, slices

#: Fixed values of the model format: the escaped space, and the piece types.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2
#: Entries of the memo of units, characters of these units, and piece pairs that one Python worker keeps before it starts afresh.
MEMO = 300_000
MEMO_CHARS = 3_000_000
PAIRS = 400_000
#: Units that are held at a time, whatever the number and length of the texts.
UNITS = 100_000


class Codec:
    """Encoder and decoder of one vocabulary: ``pieces`` are (text, score, type) in order of id.

    ``kind`` is UNIGRAM (best sum of scores) or BPE. For BPE the lattice is that of the merges: the last piece of
    the encoding of a prefix is the one piece that ends there and is compatible with the last piece of the prefix
    before it, two pieces being compatible if merging their joined text gives these two again. Following those
    back pointers gives the ids that merging the whole text would give.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, byte_fallback: bool = True):
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.longest = max(map(len, self.id), default=1)
        self.ends = {p[i:] for p in self.id for i in range(len(p))}  # a piece can end in these
        # merges in order of score; a tie is decided by place, so pieces that share a score have no rank of their own
        tied = Counter(self.score.values())
        self.rank = {p: k for k, (p, s) in enumerate(sorted(self.score.items(), key=lambda x: -x[1])) if tied[s] == 1}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE} if byte_fallback else {}
        self.worst = min(self.score.values(), default=0.0) - 10.0  # of a character without a piece
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        inside = set("".join(p for p in self.id if len(p) > 1))
        # no piece crosses from another character to a space, nor holds these: every path has a boundary there
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        alone = "".join(c for c in "\n\r\t" if c not in inside)
        self.unit = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not crossing and kind == BPE else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the memo that was full before: words in use move on
        self.memo_chars = 0
        self.commits, self.widest = 0, 0  # boundaries committed, and the most positions in a window
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        """Read a model file. Normalisation other than escaping spaces is not supported and raises ValueError."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and BPE models that keep the text as it is are supported")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type, n.add_dummy_prefix, m.trainer_spec.byte_fallback)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "older": {}, "memo_chars": 0, "pairs": {}, "halves": {}}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging, best score first, then leftmost; for short texts."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The pieces, and the two that were merged last."""
        parts, score, halves = list(text), self.score, ("", "")
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, halves
            halves = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What a piece is merged from last; itself for one character, None if merging never makes it."""
        if piece not in self.halves:
            parts, last = self._merge(piece)
            self.halves[piece] = (piece, piece) if len(piece) == 1 else last if parts == [piece] else None
        return self.halves[piece]

    def _fits(self, before: str | None, piece: str) -> bool:
        """Whether ``piece`` can stand first, or behind ``before``."""
        if self._halves(piece) is None:
            return False
        if before is None:
            return True
        ok = self.pairs.get((before, piece))
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[before, piece] = self._apart(before, piece)
        return ok

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives a and b again.

        Merges are undone, the latest first: while the symbols on the two sides of the border exist together, they
        would be merged if their merge came before the one that ends them. Ranks decide that unless scores tie.
        """
        rank, halves = self.rank, self._halves
        end_a = end_b = len(rank)  # rank of the merge that ends the symbol on either side of the border
        x, y = a, b
        while True:
            joined = x + y
            if joined in self.id:
                r = rank.get(joined)
                if r is None:
                    return self.merged(a + b) == [a, b]
                if r < end_a and r <= end_b:  # of equal merges the left one is made first
                    return False
            rank_x, rank_y = (-1 if len(x) == 1 else rank.get(x)), (-1 if len(y) == 1 else rank.get(y))
            if rank_x is None or rank_y is None:
                return self.merged(a + b) == [a, b]
            if rank_x < 0 and rank_y < 0:
                return True
            if rank_x >= rank_y:
                end_a, x = rank_x, halves(x)[1]
            else:
                end_b, y = rank_y, halves(y)[0]

    def segment(self, text: str) -> list[str]:
        """Pieces of an escaped text, committed window by window."""
        return [p for part in self.stream([text]) for p in part]

    def stream(self, units: Iterable[str]) -> Iterator[list[str]]:
        """The pieces of each unit, by streaming Viterbi over a window of the lattice.

        Position n of the window holds the piece that ends there on its best path. Only the last ``longest`` positions can be the start
        of a later piece; whenever their back-pointer paths have all met in one boundary, the pieces up to it are committed
        and their positions forgotten, so the window holds a few times ``longest`` positions, whatever the unit. At a unit's end all paths meet.

        Units are independent of each other (no piece crosses their borders). One that begins like the unit before goes on from the
        positions they share, if these are still in the window: in alphabetical order that saves most of the work.
        """
        known, ends, longest, bpe, pairs, fits = self.id, self.ends, self.longest, self.kind == BPE, self.pairs, self._fits
        last: list[str | None] = [None]  # at n - done
        value = [0.0]
        out: list[str] = []  # what is committed of the unit, up to position `done`
        done, before = 0, ""
        for u in units:
            same, most = 0, min(len(u), len(before))
            while same < most and u[same] == before[same]:
                same += 1
            if same < done:
                same = done = 0
                last, value, out = [None], [0.0], []
            del last[same - done + 1 :], value[same - done + 1 :]
            n, size = same, len(u)
            due = max(same, done + 2 * longest)
            while n < size:
                stop = min(due, size)
                for n in range(n + 1, stop + 1):
                    piece = u[n - 1]
                    fitting = [piece]
                    j = n - 2
                    while piece in ends and j >= done:
                        piece = u[j:n]
                        if piece in known:
                            fitting.append(piece)
                        j -= 1
                    top, chosen = n - done, None
                    if bpe:
                        for piece in reversed(fitting):  # long pieces are the likelier ones
                            prior = last[top - len(piece)]
                            if prior is None and n > len(piece):
                                continue
                            ok = pairs.get((prior, piece))
                            if fits(prior, piece) if ok is None else ok:
                                chosen = piece
                                break
                    else:
                        best = 0.0
                        for piece in reversed(fitting):
                            j = top - len(piece)
                            if last[j] is not None or n == len(piece):
                                v = value[j] + (self.score[piece] if piece in known else self.worst)
                                if chosen is None or v > best:
                                    best, chosen = v, piece
                        value.append(best)
                    last.append(chosen)
                if n >= due:
                    self.widest = max(self.widest, len(last))
                    meet = self._meet(last, done, n)
                    if meet > done:
                        out += self._path(last, meet - done)
                        del last[: meet - done], value[: meet - done]
                        done = meet
                        self.commits += 1
                    due = n + longest
            self.commits += 1
            before = u
            tail = self._path(last, size - done)
            yield out + tail if out else tail

    def _meet(self, last: list[str | None], done: int, n: int) -> int:
        """The last boundary that all surviving paths at position n have in common."""
        alive = {p for p in range(max(done, n - self.longest + 1), n + 1) if p == done or last[p - done] is not None}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(last[top - done]))
        return alive.pop()

    @staticmethod
    def _path(last: list[str | None], at: int) -> list[str]:
        """Pieces from where the window begins to its position ``at``."""
        out = []
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def _ids(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a run of unknown characters is one id
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of some texts: their units are streamed, or taken from the memo if the stream has met them before."""
        escaped = [(SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE) if t else "" for t in texts]
        if self.unit is None or not self.bytes:
            return [self._ids(p for part in self.stream([t]) for p in part) for t in escaped]
        out: list[list[int]] = [[] for _ in escaped]
        for block in self._blocks(escaped):
            fresh = self._learn([own for _, own in block])
            memo = self.memo
            for k, own in block:
                ids = out[k]
                for u in own:
                    ids += memo[u]
            for u in fresh:
                if len(u) > 4 * self.longest:  # long ones hardly come again
                    del memo[u]
        return out

    def _blocks(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """The units of the texts as (number of the text, some of its units), in order; a block holds some ``UNITS`` of them."""
        block, n = [], 0
        for k, t in enumerate(texts):
            if len(t) <= UNITS:
                parts = [self.unit.findall(t)]
            else:
                found = (m.group() for m in self.unit.finditer(t))
                parts = iter(lambda found=found: list(itertools.islice(found, UNITS)), [])
            for own in parts:
                block.append((k, own))
                n += len(own)
                if n >= UNITS:
                    yield block
                    block, n = [], 0
        yield block

    def _learn(self, units: list[list[str]]) -> list[str]:
        """Afterwards the memo has the ids of all these units; where it would grow too large it starts afresh with them. Returns the units it had not met."""
        memo, older = self.memo, self.older
        missing = {u for own in units for u in own if u not in memo}
        brief = 4 * self.longest
        chars = sum(n for n in map(len, missing) if n <= brief)
        if len(memo) + len(missing) > MEMO or self.memo_chars + chars > MEMO_CHARS:
            self.older, self.memo = older, memo = memo, {}
            missing = {u for own in units for u in own}
            self.memo_chars, chars = 0, sum(n for n in map(len, missing) if n <= brief)
        self.memo_chars += chars
        fresh = []
        for u in missing:
            ids = older.get(u)
            if ids is None:
                fresh.append(u)
            else:
                memo[u] = ids
        fresh.sort()
        id_of = self.id.get
        for u, pieces in zip(fresh, self.stream(fresh), strict=True):
            ids = tuple([id_of(p) for p in pieces])
            memo[u] = tuple(self._ids(pieces)) if None in ids else ids
        return fresh

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        out = b"".join(map(self.raw.__getitem__, ids))
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids. Bytes that are not UTF-8 become U+FFFD, unknown ids the sign the format gives them."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with ``ids`` (array of int), ``n_ids`` and ``round_trip`` (decoding gives the text back).

    The model file is read on the driver and its vocabulary broadcast (some tens of thousands of pieces). Null and
    empty texts have no ids; null has ``round_trip`` null. A text that holds the escaped space itself comes back
    with spaces there, so its ``round_trip`` is false. Whole texts are encoded; rows are independent, so repeated rows get
    equal ids, and an empty table gives no rows. Columns of the input named like a result column are replaced. A very long text
    is one row of one task: its ids are held, its units come in blocks, its lattice is a window. Rows are taken in stretches of
    some 2 MB of text, so many long texts need no more memory than one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec.load(model_path))
    keep = [c for c in others(docs, ["ids", "n_ids", "round_trip"]) if c != text_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                ids = codec.encode_many(texts)
                same = [None if t is None else codec.decode_bytes(i) == t.encode() for t, i in zip(texts, ids, strict=True)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), lists, pa.array(sizes), pa.array(same, pa.bool_())], names=[*keep, "ids", "n_ids", "round_trip"])

    source = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(work, (kinds + ", " if kinds else "") + "ids array<int>, n_ids bigint, round_trip boolean")
