"""Vector codes: each part of a vector becomes the number of the nearest entry of its codebook, found by VA-file filtering.

Components are integers (floor of ``scale`` times the value), so distances are exact. For each part, the codebook's entries
are bit-quantised: along each coordinate, 2**``bits`` cells of about as many entries, each cell known by its least and largest
coordinate. A query has a table of the least and of the largest squared distance to each cell of each coordinate; their sums
bound its distance to an entry from both sides. Only entries whose lower bound isn't above the least upper bound are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import map_batches, written

#: Integer components must be nearer to zero, so that squared distances of up to 4,096 components fit 64 bits.
BOUND = 1 << 24


def usable(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """vec_id, label and whole (the vector as integers) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(x.isNotNull() & fine & (F.size(x) > 0) & (F.size(x) % parts == 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("whole"))


def first_vectors(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest vec_ids, ascending; of repeated ones the least vector. At most ``entries`` rows are gathered."""
    named = rows.where("vec_id IS NOT NULL").select("vec_id", "whole")
    found = named.orderBy("vec_id", "whole").limit(entries).collect()
    if len({r.vec_id for r in found}) < len(found):
        found = named.groupBy("vec_id").agg(F.min("whole").alias("whole")).orderBy("vec_id").limit(entries).collect()
    return [r.whole for r in found]


class Filter:
    """A part's codebook (entries x coordinates) with its entries' cells."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries = entries
        count = len(entries)
        cells = min(1 << bits, count)
        order = np.argsort(entries, axis=0, kind="stable")
        number = np.arange(count) * cells // count
        self.cell = np.empty_like(entries)
        np.put_along_axis(self.cell, order, np.repeat(number[:, None], entries.shape[1], axis=1), axis=0)
        inside = np.take_along_axis(entries, order, axis=0)
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        self.low, self.high = np.minimum.reduceat(inside, starts).T, np.maximum.reduceat(inside, starts).T  # coordinate x cell

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry's number, of equally near ones the lowest, and its squared distance, for each row of x."""
        least, most = np.zeros((len(x), len(self.entries)), np.int64), np.zeros((len(x), len(self.entries)), np.int64)
        for d in range(x.shape[1]):
            below, above = self.low[d] - x[:, d, None], x[:, d, None] - self.high[d]
            outside = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (outside * outside)[:, self.cell[:, d]]
            most += (far * far)[:, self.cell[:, d]]
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == best[row])
        hits = hits[np.append(True, row[hits][1:] != row[hits][:-1])]
        return entry[hits], best


def matrices(batches, rows: int = 4096):
    """The batches' vectors as integer matrices of a bounded number of rows, each with its slice of the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            x = part.column("whole").flatten().to_numpy().reshape(part.num_rows, -1)
            if np.abs(x).max() >= BOUND:
                raise ValueError(f"components must be below {BOUND} after scaling")
            yield part, x


def moved(rows: DataFrame, books: np.ndarray, bits: int) -> np.ndarray:
    """The codebooks (part x entry x coordinate) after one round: each entry becomes its parts' mean, rounded down.

    Each task adds its parts up; what reaches the driver has a row for each part and entry.
    """
    parts, entries, width = books.shape

    def run(batches):
        filters = [Filter(book, bits) for book in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in matrices(batches):
            for p, own in enumerate(np.split(x, parts, axis=1)):
                entry, _ = filters[p].nearest(own)
                np.add.at(total[p], entry, own)
                count[p] += np.bincount(entry, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sums = map_batches(rows.select("whole"), run, "part int, entry int, n long, total array<long>")
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total")).collect():
        out[r.part, r.entry] = [t // r.n for t in r.total]
    return out


def coded(rows: DataFrame, books: np.ndarray, bits: int) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts = len(books)

    def run(batches):
        filters = [Filter(book, bits) for book in books]
        for part, x in matrices(batches):
            found = [f.nearest(own) for f, own in zip(filters, np.split(x, parts, axis=1), strict=True)]
            digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes), pa.array(sum(error for _, error in found))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return map_batches(rows, run, f"vec_id long, label {kind}, code string, error long")


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, bits: int) -> tuple[DataFrame, np.ndarray | None]:
    """The rows of one length (that of the smallest vec_id's vector) and the codebooks fitted on all of them."""
    first = first_vectors(rows, entries)
    if not first:
        return rows.where("false"), None
    rows = rows.where(F.size("whole") == len(first[0]))
    if any(len(v) != len(first[0]) for v in first):
        first = first_vectors(rows, entries)
    books = np.stack(np.split(np.array(first, np.int64), parts, axis=1))
    if np.abs(books).max() >= BOUND:
        raise ValueError(f"components must be below {BOUND} after scaling")
    for _ in range(rounds):
        books = moved(rows, books, bits)
    return rows, books


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 4) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of ``vectors`` that takes part.

    Vectors (``embedding``) that are null, hold null or non-finite components, or whose length isn't a positive multiple of
    ``parts`` or isn't that of the smallest vec_id's vector take no part. Each component x becomes floor(scale * x); one of
    2**24 or more raises a ValueError. Codebooks start as the parts of the smallest vec_ids' vectors (repeated ids: the least
    vector), fewer if there are fewer; each of ``rounds`` assigns every part of every vector to the nearest entry (squared
    distance, ties to the lower number) and replaces entries by their parts' floored means, unused ones stay. code: two hex
    digits a part. error: squared distances summed over parts. label_error: error summed over equal labels, nulls together.
    Rows without a vec_id are encoded and start no codebook; if no row has one, or the table is empty, the result is empty.
    Repeated rows are coded each. Other columns are left out.
    """
    rows, books = codebooks(usable(vectors, scale, parts), parts, entries, rounds, bits)
    if books is None:
        kinds = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], kinds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = written(coded(rows, books, bits), "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, codes.label.eqNullSafe(sums.of)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
