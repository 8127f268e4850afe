"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has 64 bits, the majority of the hashes of its shingles. Two fingerprints that differ in at most
``radius`` bits agree in one of ``radius + 1`` parts of their bits, so each goes to one cell a part; a cell beyond ``most``
fingerprints is parted once more by the bits that it hasn't fixed yet. Each round fixes more bits, so cells end: no cap.

A cell's fingerprints are stored vertically, as 64 bit planes of words of 64 candidates. A query's distances to a word's
candidates are counted at once, by carry-save adders over the planes; a word is abandoned as soon as all of its counters
exceed the radius. A cell gives a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import drop, map_batches, whole_texts, written
from flowloom.llm.jaccard_join import components, mixed

SPACE = re.compile(rb"[\x20\x09-\x0D]")
FULL = np.uint64(2**64 - 1)


def word_lists(data: bytes, step: int = 1 << 20):
    """The words of a text, by pieces of about ``step`` bytes that end between words."""
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + step) if at + step < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()  # bytes: at white space of ASCII, as words are defined
        at = end


def fingerprint(text: str, n: int = 4, seed: int = 42) -> int:
    """The bits that are set in over half the XXH64 values of a text's shingles of n words, A-Z in lower case.

    Repeated shingles count each time; a text of fewer words is one shingle, one without words has the fingerprint zero.
    """
    ones, count, last = np.zeros(64, np.int64), 0, []
    for words in word_lists(text.encode().lower()):  # bytes: A-Z only
        words = last + words
        if len(words) >= n:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first, past = np.append(0, ends[:-1])[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist()
            hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(first, past, strict=True)), np.uint64, len(first))
            for k in range(0, len(hashes), 1 << 14):
                ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            count += len(hashes)
            words = words[len(words) - n + 1 :]
        last = words
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(last), seed) if last else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp) of every document, over its whole text; null texts are empty."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, n) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(whole_texts(docs), run, "doc_id long, fp long")


@functools.lru_cache(1 << 16)
def parted(mask: int, parts: int) -> tuple[int, ...]:
    """The mask of bits that are fixed already, with each of ``parts`` even parts of the other bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return tuple(mask | sum(1 << int(b) for b in part) for part in np.array_split(free, parts))


def cells(rows: DataFrame, parts: int) -> DataFrame:
    """(cell, mask, fp) for (mask, fp): the fingerprint's next cells, named by a hash of the bits that they fix.

    Hashes that meet put two cells into one, which compares more and links the same.
    """

    def run(batches):
        for batch in batches:
            fps, masks = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask"))
            for mask in np.unique(masks).tolist():
                mine = fps[masks == np.uint64(mask)]
                for fixed in map(np.uint64, parted(mask, parts)):
                    cell = mixed(mixed(np.full(len(mine), fixed)) ^ (mine & fixed))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (cell, np.full(len(mine), fixed), mine)], names=["cell", "mask", "fp"])

    return map_batches(rows, run, "cell long, mask long, fp long")


def exceeding(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes whose counters (count: their binary digits, low first; over: beyond these) exceed the radius."""
    out, even = over.copy(), ~over
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            even &= count[k]
        else:
            out |= even & count[k]
            even &= ~count[k]
    return out


def near(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a query and a word with lanes within the radius, and these lanes as bits.

    planes: 64 x words; lanes: the candidates of each pair that count. Four planes are added at a time: two carry-save
    adders take them into the ones, a third takes both carries into the twos, the rest ripples up. Pairs whose lanes all
    exceed the radius are left behind.
    """
    at = np.arange(len(queries))
    digits = max(3, radius.bit_length())
    count, over = [np.zeros(len(at), np.uint64) for _ in range(digits)], np.zeros(len(at), np.uint64)

    def add(total, a, b):
        """total + a + b of each lane: its new low digit (in place) and the carry."""
        odd = a ^ b
        carry = (a & b) | (odd & total)
        total ^= odd
        return carry

    for bit in range(0, 64, 4):
        differ = [planes[b, words] ^ np.where(queries >> np.uint64(b) & np.uint64(1), FULL, np.uint64(0)) for b in range(bit, bit + 4)]
        carry = add(count[1], add(count[0], *differ[:2]), add(count[0], *differ[2:]))
        for total in count[2:]:
            carry, total[:] = total & carry, total ^ carry
        over |= carry
        live = (~exceeding(count, over, radius) & lanes) != 0
        if bit == 60 or 4 * np.count_nonzero(live) < 3 * len(live):
            at, queries, words, lanes, over = at[live], queries[live], words[live], lanes[live], over[live]
            count = [c[live] for c in count]
            if not len(at):
                break
    return at, ~exceeding(count, over, radius) & lanes


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least item that each item is linked with, after the links (a, b) are added to those of before."""
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if (root[a] == root[b]).all():
            return root


def linked(cell: np.ndarray, fps: np.ndarray, radius: int, pairs: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(fp, other) of fingerprints linked within cells: other is the first one of the cell that links lead to.

    cell: sorted; each cell begins a new word, so that all cells of a batch are compared at once. A word's candidates after
    the query are compared; those of a word that is all linked with the query already needn't be.
    """
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    own_words = -(-sizes // 64)
    base = np.cumsum(own_words) - own_words
    of = np.repeat(np.arange(len(starts)), sizes)
    rank = np.arange(len(cell)) - starts[of]
    slot = base[of] * 64 + rank
    total = int(own_words.sum())
    used = np.zeros(total * 64, np.uint8)
    used[slot] = 1
    valid = np.packbits(used, bitorder="little").view(np.uint64)
    planes = np.empty((64, total), np.uint64)
    for b in range(64):
        used[slot] = (fps >> np.uint64(b)) & np.uint64(1)
        planes[b] = np.packbits(used, bitorder="little").view(np.uint64)
    root = np.arange(total * 64)
    first = base[of] + rank // 64
    many = base[of] + own_words[of] - first
    ends = np.cumsum(many)
    at = 0
    while at < len(fps):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
        take = np.repeat(np.arange(at, stop), many[at:stop])
        word = first[take] + np.arange(len(take)) - np.repeat(np.cumsum(many[at:stop]) - many[at:stop], many[at:stop])
        lanes = valid[word]
        later = FULL << (rank[take] % 64).astype(np.uint64) << np.uint64(1)  # of a query's own word, the candidates after it
        lanes &= np.where(word == first[take], later, FULL)
        grid = np.where(np.unpackbits(valid.view(np.uint8), bitorder="little").astype(bool), root, -1).reshape(-1, 64) if total > len(starts) else None
        if grid is not None:  # only cells of several words can be worth it
            high = grid.max(axis=1)
            low = np.where(grid < 0, high[:, None], grid).min(axis=1)
            lanes[(low[word] == high[word]) & (low[word] == root[slot[take]])] = 0
        some = lanes != 0
        take, word, lanes = take[some], word[some], lanes[some]
        hit, bits = near(planes, fps[take], word, lanes, radius)
        if len(hit):
            k, lane = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            root = merged(root, slot[take[hit[k]]], word[hit[k]] * 64 + lane)
        at = stop
    to = root[slot]
    ends_of = np.zeros(total * 64, np.uint64)
    ends_of[slot] = fps
    moved = to != slot
    return fps[moved], ends_of[to[moved]]


def links(rows: DataFrame, radius: int, batch: int = 1 << 15) -> DataFrame:
    """(rep, other): a spanning forest of the links within each cell. rows: (cell, fp)."""

    def run(batches):
        kept_cell, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(cell, fps):
            a, b = linked(cell, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["rep", "other"])

        for part in batches:
            kept_cell = np.append(kept_cell, part.column("cell").to_numpy())
            kept_fp = np.append(kept_fp, part.column("fp").to_numpy().view(np.uint64))
            if len(kept_cell) >= batch:
                end = int(np.searchsorted(kept_cell, kept_cell[-1]))  # the last cell may go on
                if end:
                    yield out(kept_cell[:end], kept_fp[:end])
                    kept_cell, kept_fp = kept_cell[end:], kept_fp[end:]
        if len(kept_cell):
            yield out(kept_cell, kept_fp)

    return map_batches(rows.repartition("cell").sortWithinPartitions("cell"), run, "rep long, other long")


def linked_fingerprints(fps: DataFrame, radius: int, most: int) -> DataFrame:
    """(rep, other): links that connect all fingerprints of (fp) within the radius. Each fp occurs once."""
    live, found = written(cells(fps.select(F.lit(0).cast("long").alias("mask"), "fp"), radius + 1), "cells"), []
    while True:
        sizes = written(live.groupBy("cell").count().where(f"count > {most}").select("cell"), "hot")
        if sizes.isEmpty():
            found.append(written(links(live.select("cell", "fp"), radius), "links"))
            drop(live, sizes)
            break
        found.append(written(links(live.join(sizes, "cell", "left_anti").select("cell", "fp"), radius), "links"))
        hot = live.join(sizes, "cell", "left_semi").select("mask", "fp").distinct()  # two ways may fix the same bits
        after = written(cells(hot, radius + 1), "cells")
        drop(live, sizes)
        live = after
    return functools.reduce(DataFrame.unionByName, found)


def near_copies(docs: DataFrame, radius: int = 4, n: int = 4, most: int = 1 << 15) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    fingerprint: 16 lowercase hex digits, of shingles of n words. component_id: the smallest doc_id reachable by links of
    fingerprints with at most ``radius`` differing bits, its own included. Null and empty texts, and such without words, have
    the fingerprint zero and are linked like any other. Repeated rows are copies; rows without a doc_id take part and name no
    component (component_id is null if all of a component are such). An empty table gives an empty one; other columns are
    left out. most: the fingerprints of a cell that one task compares; at least 2**(radius + 1), so that cells can end.
    """
    if most < 2 ** (radius + 1):
        raise ValueError(f"most must be at least {2 ** (radius + 1)}")
    own = written(fingerprints(docs, n), "fingerprints")
    known = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "known")
    edges = linked_fingerprints(known.select("fp"), radius, most)
    roots = written(known.join(components(edges).withColumnRenamed("rep", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
