"""Embedding near-dedup: an exact metric range join of vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.base import checkpoint, components
from quernel.llm.simhash import forest

#: Rows of one side of a comparison block, least and most; a cell is made for about so many vectors. Large chunks are shipped to fewer
#: blocks, small ones give more blocks to share out, so a chunk has a 32nd of the vectors within these bounds.
CHUNKS = (2048, 8192)
#: Rows of a block that are compared at a time.
STRIP = 512
#: Most pivots of one vector length. They are broadcast: 4096 * 64 doubles are 2 MB.
MOST_PIVOTS = 4096
#: Slack for rounding in bounds: a distance near zero is a root of a difference that errs by about 1e-15.
SLACK = 1e-6
#: Ids of classes all of whose rows have null ids begin here; true ids must be below.
NAMELESS = 1 << 62


def unit(vectors: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaling by the largest component first keeps squares finite."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) for the rows of each width of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    return [(int(d), rows := np.flatnonzero(size == d), flat[offsets[rows][:, None] + np.arange(d)]) for d in np.unique(size)]


def choose_pivots(classes: DataFrame, counts: dict[int, int], radius: float, chunk: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector width: about one for ``chunk`` vectors, from a bounded sample by id hash.

    Candidates within twice the radius of a chosen pivot are passed over, so that a dense group gets one cell (which
    is then cut into chunks) instead of many cells that all border on each other.
    """
    out = {}
    for width, n in counts.items():
        want = int(min(MOST_PIVOTS, max(1, -(-n // chunk))))
        rows = classes.where(F.size("vec") == width).orderBy(F.xxhash64("rep")).limit(min(4 * want, 2 * MOST_PIVOTS)).select("vec").collect()
        x = unit([r.vec for r in rows])
        chosen: list[int] = []
        for i in range(len(x)):
            if len(chosen) < want and (not chosen or (2 - 2 * x[chosen] @ x[i]).min() > (2 * radius) ** 2):
                chosen.append(i)
        out[width] = x[chosen]
    return out


def _assign(pivots: dict[int, np.ndarray], first: dict[int, int]):
    """Adds the home cell of each vector (its nearest pivot) and its distance from the pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for width, rows, x in _lists(b.column("vec")) if b.num_rows else []:
                c = unit(x) @ pivots[width].T
                home[rows] = c.argmax(1) + first[width]
                dist[rows] = np.sqrt(np.maximum(0, 2 - 2 * c.max(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(dist)], names=[*b.schema.names, "home", "dist"])

    return work


def _replicate(pivots: dict[int, np.ndarray], first: dict[int, int], reach: np.ndarray, radius: float):
    """Adds ``guests``: the later cells that may hold a vector within the radius.

    x of cell p can have a neighbour in cell q only if, by the triangle inequality, d(x, q) <= radius + the largest
    distance in q from its pivot, and x is within the radius of the bisector of p and q: (d(x, q)**2 - d(x, p)**2) /
    (2 d(p, q)) <= radius, which sharpens d(x, q) - d(x, p) <= 2 radius. One of two vectors meets the other in its
    cell: the one of the earlier cell is the guest.
    """
    gaps = {w: np.sqrt(np.maximum(SLACK, 2 - 2 * p @ p.T)) for w, p in pivots.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            guests: list[list[int]] = [[] for _ in range(b.num_rows)]
            home = b.column("home").to_numpy()
            for width, rows, x in _lists(b.column("vec")) if b.num_rows else []:
                p, at = pivots[width], first[width]
                own = home[rows] - at
                square = np.maximum(0, 2 - 2 * unit(x) @ p.T)
                near = square - square[np.arange(len(rows)), own][:, None] <= 2 * gaps[width][own] * radius + SLACK
                near &= np.sqrt(square) <= radius + reach[at : at + len(p)][None, :] + SLACK
                near &= np.arange(len(p))[None, :] > own[:, None]
                for r, row in enumerate(near):
                    guests[rows[r]] = (np.flatnonzero(row) + at).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("rep", "w", "vec", "home")), pa.array(guests, pa.list_(pa.int32()))], names=["rep", "w", "vec", "home", "guests"])

    return work


def _compare(least: float):
    """For each block: (rep, links, root) of rows that have a link in it; links count copies, roots span the block."""

    def links(rep, w, x, side):
        x = unit(x)
        low = x.astype(np.float32)
        inner = not side.any()
        a, b = (np.arange(len(rep)),) * 2 if inner else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        found = []
        for s in range(0, len(a), STRIP):
            # single precision errs by far less than that; within one chunk a pair is met once
            i, j = np.nonzero(low[a[s : s + STRIP]] @ low[b[s:] if inner else b].T >= least - 1e-4)
            i, j = a[s + i], b[s + j] if inner else b[j]
            found.append((i[i < j], j[i < j]) if inner else (i, j))
        if not found:
            return None
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 100_000):
            keep[s : s + 100_000] = np.einsum("ij,ij->i", x[i[s : s + 100_000]], x[j[s : s + 100_000]]) >= least
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        count = np.bincount(i, w[j], len(rep)) + np.bincount(j, w[i], len(rep))
        label = forest(len(rep), i, j)
        some = np.flatnonzero(count)
        return rep[some], count[some].astype(np.int64), rep[label[some]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def flush():
            if not held:
                return None
            rep, w, x, side = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return links(rep, w, x, side) if len(rep) > 1 else None

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rep", "n", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            block, side, rep, w = (b.column(n).to_numpy() for n in ("block", "side", "rep", "w"))
            vec = b.column("vec")
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if last is not None and block[s] != last and (found := flush()):
                    yield batch(found)
                last = block[s]
                ((_, _, x),) = _lists(vec.slice(s, e - s))  # a cell has vectors of one width
                held.append((rep[s:e], w[s:e], x, side[s:e]))
        if found := flush():
            yield batch(found)

    return work


def cosine_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, chunk: int | None = None) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) for every row of ``vectors``: exact, whatever the data.

    Two vectors link if their cosine in double precision is at least ``least`` (above 0). Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different widths. Rows of equal
    vectors are one class in the join and count as links of each other; repeated rows are vectors of their own. A
    row with a null id takes part, but names no component; ids must be integers below 2**62. An empty table gives no rows.
    Ties need no rule, for the smallest id names a component. Other columns are not passed on, so none can clash.

    Cosine ``c`` is the distance sqrt(2 - 2c) between unit vectors. Pivots cut space into cells of nearest pivot;
    vectors near a border are replicated as the triangle inequality demands, and each cell joins by itself, in blocks of
    at most ``chunk`` by ``chunk`` vectors that spread a cell of any size over many tasks. A block returns at most a
    count and a root for each of its rows, never pairs.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(2 - 2 * least))
    vec = F.col(vec_col)
    fine = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, vec).alias("vec"))
    classes = checkpoint(
        rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.xxhash64("vec").alias("h"))
        .select(F.coalesce("rep", F.col("h").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))).alias("rep"), "w", "vec")
    )
    counts = {r[0]: r[1] for r in classes.groupBy(F.size("vec")).agg(F.count(F.lit(1))).collect()}
    if counts:
        chunk = chunk or min(max(sum(counts.values()) // 32, CHUNKS[0]), CHUNKS[1])
        pivots = choose_pivots(classes, counts, radius, chunk)
        first, n_cells = {}, 0
        for width, p in pivots.items():
            first[width], n_cells = n_cells, n_cells + len(p)
        homes = checkpoint(classes.select("rep", "w", "vec").mapInArrow(_assign(pivots, first), classes.select("rep", "w", "vec").schema.add("home", "integer").add("dist", "double")))
        reach, size = np.zeros(n_cells), np.zeros(n_cells, np.int64)
        for r in homes.groupBy("home").agg(F.max("dist").alias("d"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
            reach[r.home], size[r.home] = r.d, r.n
        dealt = homes.mapInArrow(_replicate(pivots, first, reach, radius), homes.select("rep", "w", "vec", "home").schema.add("guests", T.ArrayType(T.IntegerType())))
        guests = np.zeros(n_cells, np.int64)
        for r in dealt.select(F.explode("guests").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
            guests[r.cell] = r.n
        cells = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(size[i]) // chunk)), -(-int(guests[i]) // chunk)) for i in range(n_cells)], "cell int, k int, f int"))  # a row a pivot
        spot = F.xxhash64("rep")
        at_home = dealt.withColumn("cell", F.col("home")).join(cells, "cell").withColumn("c", F.pmod(spot, "k").cast("int"))
        at_home = at_home.select("cell", "rep", "w", "vec", "c", F.explode(F.sequence(F.lit(0), F.col("k") + F.col("f") - 1)).alias("o"), "k")
        own = F.col("o") < F.col("k")
        at_home = at_home.select(
            "cell", "rep", "w", "vec", F.when(own, F.least("c", "o")).otherwise(F.col("c")).alias("i"), F.when(own, F.greatest("c", "o")).otherwise(F.col("o") - F.col("k")).alias("j"),
            F.when(own, 0).otherwise(1).alias("type"), F.when(own & (F.col("c") == F.col("o")), 0).when(own & (F.col("c") > F.col("o")), 2).otherwise(1).alias("side"),
        )
        visiting = dealt.select("rep", "w", "vec", F.explode("guests").alias("cell")).join(cells, "cell").withColumn("j", F.pmod(spot, "f").cast("int"))
        visiting = visiting.select("cell", "rep", "w", "vec", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "j", F.lit(1).alias("type"), F.lit(2).alias("side"))
        block = ((F.col("cell").cast("long") * 2 + F.col("type")) * (1 << 22) + F.col("i")) * (1 << 22) + F.col("j")
        blocks = at_home.unionByName(visiting).select(block.alias("block"), "side", "rep", "w", "vec").repartition("block").sortWithinPartitions("block")
        found = checkpoint(blocks.mapInArrow(_compare(least), "rep long, n long, root long"))
    else:
        found = spark.createDataFrame([], "rep long, n long, root long")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = classes.join(links.withColumnRenamed("rep", "_r"), F.col("rep") == F.col("_r"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select(F.col("vec").alias("_vec"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")).withColumn("component_id", F.when(F.col("c") < NAMELESS, F.col("c")))
    out = rows.join(by_class, F.col("vec") == F.col("_vec"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
