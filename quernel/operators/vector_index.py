"""A vector index: product-quantised codes are scanned, and rows that their codes cannot rule out are ranked by exact distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import vectors as V

#: Vectors that codebooks are fitted on at most, whatever the table; every row is then encoded.
SAMPLE = 20_000
#: Centroids of a codebook: a code is a byte.
CENTROIDS = 256
#: Keys that are broadcast at most; where the codes leave more rows, all rows are searched.
MOST_KEYS = 100_000
#: Rounding of a bound, as a share of what it is computed from.
SLACK = 1e-9


class ProductQuantizer:
    """Vectors cut into ``parts`` subvectors, each replaced by the nearest of ``CENTROIDS`` centroids fitted by k-means."""

    def __init__(self, sample: np.ndarray, parts: int, rounds: int = 12, seed: int = 7):
        self.width = sample.shape[1]
        self.cuts = [int(x) for x in np.linspace(0, self.width, parts + 1)]
        rng = np.random.default_rng(seed)
        self.books = [self._fit(sample[:, a:b], rounds, rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    @staticmethod
    def _fit(x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
        found = np.unique(x, axis=0)
        book = found[rng.permutation(len(found))[:CENTROIDS]].copy()
        for _ in range(rounds):
            near = _nearest(x, book)
            total, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
            np.add.at(total, near, x)
            book[n > 0] = total[n > 0] / n[n > 0][:, None]
        return book

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A byte for each part of each row."""
        return np.stack([_nearest(x[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The centroids that codes stand for, joined."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)

    def tables(self, query: np.ndarray, metric: str) -> np.ndarray:
        """For each part and centroid what it adds to the squared distance from the query, or to minus the inner product."""
        out = np.zeros((len(self.books), CENTROIDS))
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out[i, : len(book)] = ((book - query[a:b]) ** 2).sum(1) if metric == "l2" else -(book @ query[a:b])
        return out


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 8192):
        part = x[at : at + 8192]
        out[at : at + 8192] = ((book * book).sum(1)[None, :] - 2 * part @ book.T).argmin(1)
    return out


class VectorIndex:
    """Codes of all vectors of one field: (key, hash of the vector, code, norm, gap), ``parts`` bytes a vector; the gap is how far code and vector are apart.

    A search scans the codes with one look-up a part and takes ``ef`` candidates. Their exact distances bound that of the k-th neighbour;
    by code and gap no other row can be nearer than a lower bound. All rows whose lower bound is within the k-th distance are ranked by exact
    distance, so the result is that of a search over all rows, however many copies crowd the candidates. ``refresh`` follows the table: rows that are new or changed are encoded, codes of rows that are gone are dropped. Vectors that are null or of another
    width than the first sample's are not indexed, as they are no neighbours in an exact search either.
    """

    def __init__(self, frame: DataFrame, field: str, key: str, parts: int = 16, persist: Callable[[DataFrame], DataFrame] | None = None):
        self.field, self.key, self.parts = field, key, parts
        self.persist = persist or (lambda df: df)
        self.quantizer: ProductQuantizer | None = None
        self.codes: DataFrame | None = None
        self.refresh(frame)

    def _rows(self, frame: DataFrame) -> DataFrame:
        v = V.doubles(F.col(self.field))
        return frame.where(F.size(self.field) == self.quantizer.width).select(F.col(self.key).alias("key"), F.xxhash64(v).alias("h"), v.alias("v"))

    def refresh(self, frame: DataFrame) -> None:
        if self.quantizer is None:
            rows = frame.where(F.size(self.field) > 0).orderBy(F.xxhash64(self.key)).limit(SAMPLE).select(V.doubles(F.col(self.field)).alias("v")).collect()
            if not rows:
                return
            width = len(rows[0].v)
            sample = np.array([r.v for r in rows if len(r.v) == width and None not in r.v])
            self.quantizer = ProductQuantizer(sample, min(self.parts, width))
        rows, shared = self._rows(frame), frame.sparkSession.sparkContext.broadcast(self.quantizer)
        kind = rows.schema["key"].dataType.simpleString()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("v").values.to_numpy(zero_copy_only=False)[b.column("v").offsets.to_numpy()[0] :][: b.num_rows * shared.value.width].reshape(b.num_rows, -1)
                    codes = shared.value.encode(np.nan_to_num(x))
                    off = x - shared.value.decode(codes)
                    sizes = [pa.array(np.sqrt((v * v).sum(1))) for v in (x, off)]
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h"), pa.array([c.tobytes() for c in codes], pa.binary()), *sizes], names=["key", "h", "code", "norm", "gap"])

        kept, fresh = None, rows
        if self.codes is not None:
            now = rows.select("key", "h")
            kept = self.codes.join(now, ["key", "h"], "left_semi")
            fresh = rows.join(self.codes.select("key", "h"), ["key", "h"], "left_anti")
        made = fresh.mapInArrow(encode, f"key {kind}, h long, code binary, norm double, gap double")
        self.codes = self.persist(made if kept is None else kept.unionByName(made))

    def _by_code(self, query: list[float], metric: str, lower: bool) -> Column:
        """The distance of a code, up to a constant; or a lower bound of the vector's distance, NaN where its components are no bound."""
        q = np.array(query, float)
        tables, parts = self.quantizer.tables(q, metric), len(self.quantizer.books)
        size = float(np.sqrt(q @ q))

        def measure(codes: pa.Array, norms: pa.Array, gaps: pa.Array) -> pa.Array:
            flat = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, parts)
            d = tables[np.arange(parts)[None, :], flat].sum(1)
            norm, gap = norms.to_numpy(zero_copy_only=False), gaps.to_numpy(zero_copy_only=False)
            if lower and metric == "l2":
                d = np.sqrt(d) - gap - SLACK * (norm + gap + size)
            elif lower:
                d = d - size * gap - SLACK * size * (norm + gap)
            if metric == "cosine":
                n = norm * size
                d = lower + np.divide(d, n, out=np.where(n == 0, 0.0, np.nan), where=n > 0)
            return pa.array(d, from_pandas=False)

        return F.arrow_udf(measure, "double")("code", "norm", "gap")

    def candidates(self, query: list[float], ef: int, metric: str) -> DataFrame:
        """(key) of the ``ef`` rows that are nearest by their codes, in one scan and a bounded top-k in each task."""
        near = self.codes.select("key", self._by_code(query, metric, False).alias("d"))
        return near.orderBy("d", "key").limit(ef).select(F.col("key").alias("_key"))

    def within(self, query: list[float], limit: float, metric: str) -> DataFrame:
        """(key) of the rows that can be as near as ``limit``."""
        low = self.codes.select(F.col("key").alias("_key"), self._by_code(query, metric, True).alias("low"))
        return low.where(F.isnan("low") | (F.col("low") <= F.lit(float(limit)))).select("_key")

    def search(self, frame: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", threshold: float | None = None, ef: int | None = None) -> DataFrame:
        """(key, distance, score) of the ``k`` nearest rows, ties by key; ``ef`` candidates, max(5k, 32) if not given, bound what is ranked."""
        from quernel.operators.vector_search import search

        def among(keys: DataFrame | None, least: float | None) -> DataFrame:
            rows = frame if keys is None else frame.join(F.broadcast(keys), F.col(self.key) == F.col("_key"), "left_semi")
            return search(rows, self.field, query, k, metric, self.key, least)

        ef = max(ef or max(5 * k, 32), k)
        if self.quantizer is None or len(query) != self.quantizer.width or ef > MOST_KEYS:
            return among(None, threshold)
        n, limit = among(self.candidates(query, ef, metric), None).agg(F.count(F.lit(1)), F.max("distance")).first()
        if n < k:
            limit = np.inf
        elif limit is None:  # null distances come first
            limit = -np.inf
        keys = self.within(query, limit if threshold is None else min(limit, threshold), metric)
        return among(keys if keys.count() <= MOST_KEYS else None, threshold)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """The share of exact neighbours that were found."""
    total = exact.count()
    return exact.join(found.select(key), key, "left_semi").count() / total if total else 1.0
