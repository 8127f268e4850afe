"""An interpolated modified Kneser-Ney n-gram model of any order, counted in Spark and kept as sorted arrays.

Words are hashes of 64 bits, in shards of a sorted array; a word's number is its place. An n-gram is one number of 64
bits: its context's place among the grams one shorter, and its last word's number; grams are sorted by it, in shards of
ranges of contexts, and their places name them in turn. Tasks combine the grams of their texts before they shuffle
them, packed by shard, so a row holds many grams. The number of shards grows with the texts; neighbouring shards share a
file, so that the number of files doesn't. Workers map the files into memory and search them; nothing of the model
passes through the driver except the counts of counts and one row for each file.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.arrays import Growing, mapped, put
from flowloom.llm.common import crc_fold, map_batches, shared_dir, whole_texts

END = b""  # no word is empty
#: The context of a text's first word: no place is as great.
BEGIN = (1 << 31) - 2
#: Text bytes for each shard, and the bounds of their number.
SHARD_BYTES, FEWEST, MOST = 1 << 21, 64, 1 << 15
#: Most files of an array. Workers map all of them and search each one apart.
FILES = 1 << 8
#: Counts whose sums are kept, so that a context's needn't be added up by each batch.
BLOCK = 64
#: Grams that a task combines before it sends them.
HELD = 1 << 21


def tokens(text: str) -> list[bytes]:
    """Words between white space (bytes 32 and 9 to 13), A-Z in lower case, and one end."""
    return [*text.encode().lower().split(), END]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)  # signed, in the same order


def owners(starts: tuple[int, ...], places: np.ndarray) -> np.ndarray:
    """The file of each place, given the files' first places and their end."""
    return np.searchsorted(np.asarray(starts), places, "right") - 1


@dataclass(frozen=True)
class Vocabulary:
    """Files of the words: where, each one's first number (and the end), how many training tokens, shards, and shards a file."""

    top: str
    starts: tuple[int, ...]
    total: int
    shards: int
    each: int

    @property
    def size(self) -> int:
        return self.starts[-1]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers (-1: unknown) and counts of sorted hashes."""
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for k, a, b in stretches(word_shard(hashes, self.shards) // self.each):
            n = self.starts[k + 1] - self.starts[k]
            if n:
                raw = mapped(f"{self.top}/words-{k:05d}")
                keys, own = raw[: 8 * n].view(np.int64), raw[8 * n :].view(np.int64)
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), n - 1)
                hit = keys[at] == hashes[a:b]
                numbers[a:b] = np.where(hit, self.starts[k] + at, -1)
                counts[a:b] = np.where(hit, own[at], 0)
        return numbers, counts


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: shards are ranges of its 32 high bits."""
    return ((hashes >> 32) + (1 << 31)) * shards >> 32


def stretches(shard: np.ndarray):
    """(shard, begin, end) of a sorted array of shards."""
    cuts = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard))
    begin = 0
    for end in cuts.tolist() if len(shard) else []:
        yield int(shard[begin]), begin, end
        begin = end


@dataclass(frozen=True)
class Grams:
    """The grams of one length: files by ranges of ``wide`` contexts, one more for BEGIN; their first places and end."""

    top: str
    length: int
    wide: int
    starts: tuple[int, ...]

    def file(self, keys: np.ndarray) -> np.ndarray:
        return np.where(keys >> 32 == BEGIN, len(self.starts) - 2, (keys >> 32) // self.wide)

    def keys(self, k: int) -> np.ndarray:
        return mapped(f"{self.top}/grams{self.length}-{k:05d}").view(np.int64)

    def counts(self, k: int) -> np.ndarray:
        return counts_in(f"{self.top}/counts{self.length}-{k:05d}")

    def blocks(self, k: int) -> np.ndarray:
        uri = f"{self.top}/counts{self.length}-{k:05d}"
        return mapped(uri)[16 + counts_in(uri).nbytes :].view(np.int64).reshape(3, -1)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The places of sorted keys; -1 of unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        first = int(np.searchsorted(keys, 0))  # contexts that are unknown make negative keys
        for k, a, b in stretches(self.file(keys[first:])):
            if self.starts[k + 1] > self.starts[k]:
                known = self.keys(k)
                at = np.minimum(np.searchsorted(known, keys[first + a : first + b]), len(known) - 1)
                out[first + a : first + b] = np.where(known[at] == keys[first + a : first + b], self.starts[k] + at, -1)
        return out

    def shorter(self, places: np.ndarray) -> np.ndarray:
        """For grams at some places, the place of each without its first word; of BEGIN it is BEGIN. Sorted input."""
        out = np.full(len(places), BEGIN, np.int64)
        last = int(np.searchsorted(places, BEGIN))
        for k, a, b in stretches(owners(self.starts, places[:last])):
            if self.length == 2:
                out[a:b] = self.keys(k)[places[a:b] - self.starts[k]] & 0xFFFFFFFF
            else:
                out[a:b] = mapped(f"{self.top}/links{self.length}-{k:05d}").view(np.int64)[places[a:b] - self.starts[k]]
        return out


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the greatest of them needs."""
    size = next(n for n in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * n - 1)
    return counts.astype(f"<u{size}")


def save_counts(uri: str, pieces: list[np.ndarray]) -> None:
    """Writes narrow counts, in as many bytes each as the widest piece, after that size and their number; then, of all
    counts before each block, the sum and how many are 1 and 2.
    """
    counts, sums = np.concatenate(pieces), [np.zeros((3, 1), np.int64)]
    for at in range(0, len(counts), BLOCK << 12):
        c = counts[at : at + (BLOCK << 12)]
        sums.append(reduced(c, np.arange(0, len(c), BLOCK)))
    put(uri, [np.array([counts.itemsize, len(counts)]), counts, np.cumsum(np.concatenate(sums, axis=1), axis=1)])


def reduced(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum and how many are 1 and 2, of the counts from each place in ``first`` to the next."""
    return np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (counts, (counts == 1).view(np.uint8), (counts == 2).view(np.uint8))])


def counts_in(uri: str) -> np.ndarray:
    raw = mapped(uri)
    size, n = raw[:16].view(np.int64).tolist()
    return raw[16 : 16 + n * size].view(f"<u{size}")


def between(counts: np.ndarray, blocks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The sum and how many are 1 and 2, of the counts from each lo up to its hi: blocks by their sums, the ends one by one."""
    a, b = -(-lo // BLOCK), hi // BLOCK
    whole = a < b
    out = blocks[:, np.where(whole, b, 0)] - blocks[:, np.where(whole, a, 0)]
    for begin, end in ((lo, np.where(whole, a * BLOCK, hi)), (np.where(whole, b * BLOCK, hi), hi)):
        some = end > begin
        size = (end - begin)[some]
        if len(size):
            first = np.cumsum(size) - size
            out[:, some] += reduced(counts[np.arange(size.sum()) + np.repeat(begin[some] - first, size)], first)
    return out


@dataclass(frozen=True)
class KneserNey:
    """A vocabulary, the grams of each length from 2 up to the order, and by length the discounts; the words' totals."""

    vocabulary: Vocabulary
    grams: tuple[Grams, ...]
    discounts: tuple[tuple[float, float, float], ...]
    low_total: int
    low_gamma: float

    @property
    def order(self) -> int:
        return len(self.grams) + 1


def batches_of(batches, most: int = 4 << 20):
    """(doc_ids, token lists) of about ``most`` characters."""
    for batch in batches:
        held, ids, own = 0, [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc)
            own.append(tokens(text))
            held += len(text)
            if held > most:
                yield ids, own
                held, ids, own = 0, [], []
        if ids:
            yield ids, own


def numbered(own: list[list[bytes]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training counts of all tokens of some texts, one after the other."""
    flat = pa.array([w for t in own for w in t], pa.binary()).dictionary_encode()
    words = flat.dictionary.to_pylist()
    hashes = np.fromiter(map(word_hash, words), np.int64, len(words))
    order = np.argsort(hashes)
    numbers, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    numbers[order], counts[order] = vocabulary.look_up(hashes[order])
    at = flat.indices.to_numpy()
    return numbers[at], counts[at]


def contexts(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token the place of the gram that ends one token before: BEGIN before a text's first."""
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[np.append(0, np.cumsum(sizes)[:-1])] = BEGIN
    return before


def keys_of(numbers: np.ndarray, sizes: np.ndarray, grams) -> tuple[np.ndarray, np.ndarray]:
    """For each token its gram's key, one word longer than the last of ``grams``, and the context's place."""
    places = numbers
    for g in grams:
        keys, back = np.unique(contexts(places, sizes) << 32 | (numbers & 0xFFFFFFFF), return_inverse=True)
        places = g.places(keys)[back]
    before = contexts(places, sizes)
    return before << 32 | (numbers & 0xFFFFFFFF), before


def packed(keys: np.ndarray) -> bytes:
    """Sorted whole numbers as the compressed bytes of their steps, by place of the byte."""
    return zstandard.compress(np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else np.zeros(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


PACKED = "shard int, keys binary, counts binary"


class Sender:
    """Combines keys with counts and gives them out as packed rows by shard, whenever it holds many."""

    def __init__(self, shard_of):
        self.shard_of, self.keys, self.counts, self.size = shard_of, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        """Takes sorted distinct keys; yields rows if there are enough."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HELD:
            self.keys, self.counts = ([x] for x in summed(self.keys, self.counts))
            self.size = len(self.keys[0])
            if self.size > HELD // 2:
                yield from self.rest()

    def rest(self):
        if self.keys:
            keys, counts = summed(self.keys, self.counts)
            self.keys, self.counts, self.size = [], [], 0
            order = np.argsort(self.shard_of(keys), kind="stable")
            rows = [(k, packed(keys[order[a:b]]), zstandard.compress(counts[order[a:b]].astype("<u4").tobytes(), 3)) for k, a, b in stretches(self.shard_of(keys[order]))]
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "counts"])


def received(batches):
    """(shard, distinct keys, summed counts) of packed rows that come sorted by shard; one shard is held at a time."""
    now, keys, counts = None, [], []
    for batch in batches:
        for k, a, b in zip(batch.column("shard").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if now is not None and k != now:
                yield now, *summed(keys, counts)
                keys, counts = [], []
            now = k
            keys.append(unpacked(a))
            counts.append(np.frombuffer(zstandard.decompress(b), "<u4").astype(np.int64))
    if keys:
        yield now, *summed(keys, counts)


def received_by_file(batches, each: int):
    """(file, its shards as ``received`` gives them), for ``each`` shards a file."""
    return groupby(received(batches), lambda row: row[0] // each)


def dealt(rows: DataFrame, each: int) -> DataFrame:
    return rows.repartition(F.expr(f"shard div {each}")).sortWithinPartitions("shard")


def count_words(texts: DataFrame, top: str, shards: int, each: int) -> Vocabulary:
    """Counts the words and writes the vocabulary's files."""

    def count(batches):
        sender = Sender(lambda h: word_shard(h, shards))
        for _, own in batches_of(batches):
            found = Counter()
            for t in own:
                found.update(t)
            h, n = np.fromiter(map(word_hash, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            order = np.argsort(h)
            yield from sender.add(h[order], n[order])
        yield from sender.rest()

    def save(batches):
        for k, parts in received_by_file(batches, each):
            out, held = Growing(f"{top}/words-{k:05d}"), []
            for _, keys, counts in parts:
                out.add(keys)
                held.append(counts)
            for counts in held:
                out.add(counts)
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32()), "size": [sum(map(len, held))], "total": [sum(int(c.sum()) for c in held)]})

    sizes, total = [0] * -(-shards // each), 0
    for k, n, t in map_batches(dealt(map_batches(texts, count, PACKED), each), save, "file int, size long, total long").collect():  # one row a file
        sizes[k] = n
        total += t
    return Vocabulary(top, tuple(np.append(0, np.cumsum(sizes)).tolist()), total, shards, each)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of 1, 2 and 3 or more, kept within the counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    three = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(k + 0.95, max(0.05, d)) for k, d in enumerate(three))


def count_grams(texts: DataFrame, vocabulary: Vocabulary, shorter: tuple[Grams, ...], last: bool) -> Grams:
    """Counts the grams one word longer than the last of ``shorter`` (or pairs), writes their files, and the shorter ones'
    counts of continuations. Only if ``last`` their own counts are written; else a longer length's continuations give them.
    """
    length, top, each = len(shorter) + 2, vocabulary.top, vocabulary.each
    below = shorter[-1] if shorter else None
    starts = below.starts if below else vocabulary.starts
    if starts[-1] >= BEGIN:
        raise ValueError(f"{starts[-1]} grams are too many to name in 31 bits")
    wide, files = max(1, -(-starts[-1] // vocabulary.shards)), len(vocabulary.starts) - 1

    def shard(keys):
        return np.where(keys >> 32 == BEGIN, files * each, (keys >> 32) // wide)

    def part(places):
        """A shorter gram's shard: its file has ``each`` of them, of equal lengths."""
        k, begin = owners(starts, places), np.asarray(starts)
        return k * each + (places - begin[k]) * each // np.diff(begin)[k]

    def count(batches):
        sender = Sender(shard)
        for _, own in batches_of(batches):
            numbers, _ = numbered(own, vocabulary)
            keys, _ = keys_of(numbers, np.fromiter(map(len, own), np.int64, len(own)), shorter)
            yield from sender.add(*np.unique(keys, return_counts=True))
        yield from sender.rest()

    def save(batches):
        """Writes each file; sends how often each shorter gram ends one."""
        sender = Sender(part)
        for k, parts in received_by_file(batches, each):
            grams, held = Growing(f"{top}/grams{length}-{k:05d}"), []
            links = Growing(f"{top}/links{length}-{k:05d}") if below and not last else None
            for _, keys, counts in parts:
                grams.add(keys)
                if last:
                    held.append(narrow(counts))
                words = keys & 0xFFFFFFFF
                if below:
                    front, back = np.unique(keys >> 32, return_inverse=True)
                    ends, order = np.unique(below.shorter(front)[back] << 32 | words, return_inverse=True)
                    words = below.places(ends)[order]
                if links:
                    links.add(words)
                yield from sender.add(*np.unique(words, return_counts=True))
            grams.close()
            if last:
                save_counts(f"{top}/counts{length}-{k:05d}", held)
            if links:
                links.close()
        yield from sender.rest()

    def save_below(batches):
        for k, parts in received_by_file(batches, each):
            size, held = starts[k + 1] - starts[k], []
            for p, places, counts in parts:
                begin, end = (starts[k] - (-(p % each + i) * size // each) for i in (0, 1))
                own = np.zeros(end - begin, np.int64)
                own[places - begin] = counts
                held.append(narrow(own))
            save_counts(f"{top}/counts{length - 1}-{k:05d}", held)
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32())})

    sent = map_batches(dealt(map_batches(texts, count, PACKED), each), save, PACKED)
    map_batches(dealt(sent, each), save_below, "file int").count()
    sizes = [r[1] for r in sorted(statistics(texts.sparkSession, f"{top}/grams{length}", files + 1, False))]
    return Grams(top, length, wide * each, tuple(np.append(0, np.cumsum(sizes)).tolist()))


def statistics(spark: SparkSession, name: str, files: int, counts: bool) -> list[tuple]:
    """One row for each file: its number, entries and, of counts, how many are 1, 2, 3, 4 and more than 2, and their sum."""

    def read(batches):
        for batch in batches:
            rows = []
            for k in batch.column("id").to_pylist():
                try:
                    raw = counts_in(f"{name}-{k:05d}") if counts else mapped(f"{name}-{k:05d}").view(np.int64)
                except (FileNotFoundError, ValueError):  # without grams there is no file
                    raw = np.zeros(0, np.int64)
                of = [*((raw == c).sum() for c in (1, 2, 3, 4)), (raw >= 3).sum(), raw.sum(dtype=np.int64)] if counts else [0] * 6
                rows.append((k, len(raw), *map(int, of)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "size", "n1", "n2", "n3", "n4", "more", "total"])

    return [tuple(r) for r in map_batches(spark.range(files), read, "id long, size long, n1 long, n2 long, n3 long, n4 long, more long, total long").collect()]


def complete(rows: list[tuple], starts: tuple[int, ...], found: int, due: int) -> None:
    """Fails unless each file has a count for each of its entries and the counts add up; so no lost file passes for an empty one.

    Each token ends one gram of the longest length; of the shorter ones each is counted by the different grams that end in it.
    """
    wrong = [k for k, size, *_ in rows if size != starts[k + 1] - starts[k]]
    if wrong or found != due:
        raise RuntimeError(f"the model's files are not whole: counts of {found} for {due}, files {wrong[:10]}")


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(counts, 3)]


class Reader:
    """Probabilities from the mapped arrays, for one worker."""

    def __init__(self, model: KneserNey):
        self.model = model

    def low(self, numbers: np.ndarray) -> np.ndarray:
        """Words' lowest-order probabilities, interpolated with the same share for each word and the unknown one; sorted input."""
        m = self.model
        out = np.full(len(numbers), m.low_gamma / (m.vocabulary.size + 1))
        first = int(np.searchsorted(numbers, 0))
        for k, a, b in stretches(owners(m.vocabulary.starts, numbers[first:])):
            n = counts_in(f"{m.vocabulary.top}/counts1-{k:05d}")[numbers[first + a : first + b] - m.vocabulary.starts[k]].astype(np.int64)
            out[first + a : first + b] += np.maximum(0.0, n - discount(n, m.discounts[0])) / m.low_total
        return out

    def level(self, g: Grams, d: tuple[float, float, float], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted keys: the place (-1: unknown), the discounted share, and what the context leaves to shorter grams."""
        places, share, rest = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        first = int(np.searchsorted(keys, 0))
        for k, a, b in stretches(g.file(keys[first:])):
            if g.starts[k + 1] == g.starts[k]:
                continue
            known, counts = g.keys(k), g.counts(k)
            mine = keys[first + a : first + b]
            own = mine >> 32
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            lo, hi = np.searchsorted(known, own[start] << 32), np.searchsorted(known, (own[start] + 1) << 32)
            has = hi > lo
            length = np.diff(np.append(start, b - a))
            kept, which = np.repeat(has, length), np.repeat(np.cumsum(has) - 1, length)
            lo, size = lo[has], (hi - lo)[has]
            if not len(lo):
                continue
            # each context's total and discounted mass
            total, ones, twos = between(counts, g.blocks(k), lo, lo + size)
            mass = d[0] * ones + d[1] * twos + d[2] * (size - ones - twos)
            at = np.minimum(np.searchsorted(known, mine[kept]), len(known) - 1)
            found = known[at] == mine[kept]
            hit = np.where(found, counts[at].astype(np.int64), 0)
            t = total[which[kept]]
            to = first + a + np.flatnonzero(kept)
            places[to] = np.where(found, g.starts[k] + at, -1)
            share[to] = (hit - discount(hit, d)) / t
            rest[to] = mass[which[kept]] / t
        return places, share, rest

    def probabilities(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """p(token | the tokens before it in its text) of texts' numbers, one after the other; unknown words are -1."""
        m = self.model
        words, back = np.unique(numbers, return_inverse=True)
        out, places = self.low(words)[back], numbers
        for g, d in zip(m.grams, m.discounts[1:], strict=True):
            keys, back = np.unique(contexts(places, sizes) << 32 | (numbers & 0xFFFFFFFF), return_inverse=True)
            at, share, rest = self.level(g, d, keys)
            out, places = share[back] + rest[back] * out, at[back]
        return out


def fit(docs: DataFrame, order: int = 3) -> KneserNey:
    """Counts all whole texts of ``docs`` and writes a model of n-grams up to ``order`` (2 or more) to the shared folder.

    A null text counts as empty: just an end. Before a text's first word all words are BEGIN. Without rows the model is
    empty, and all words have the same share. Repeated rows count each; other columns are not read.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark: SparkSession = docs.sparkSession
    top, texts = shared_dir(spark), whole_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = min(MOST, max(FEWEST, -(-size // SHARD_BYTES)))
    vocabulary = count_words(texts, top, shards, -(-shards // FILES))
    if not vocabulary.size:
        return KneserNey(vocabulary, (), ((0.5, 1.0, 1.5),), 0, 1.0)
    grams: tuple[Grams, ...] = ()
    for length in range(2, order + 1):
        grams += (count_grams(texts, vocabulary, grams, length == order),)
    of = []
    for length in range(1, order + 1):
        rows = statistics(spark, f"{top}/counts{length}", len((vocabulary, *grams)[length - 1].starts) - 1, True)
        of.append(tuple(sum(r[k] for r in rows) for k in range(2, 8)))
        complete(rows, (vocabulary, *grams)[length - 1].starts, of[-1][-1], vocabulary.total if length == order else grams[length - 1].starts[-1])
    found = tuple(discounts(*x[:4]) for x in of)
    n1, n2, _, _, more, total = of[0]
    return KneserNey(vocabulary, grams, found, total, (found[0][0] * n1 + found[0][1] * n2 + found[0][2] * more) / total)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probability) of every whole text.

    Null and empty texts are one end. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens. Perplexity is
    10 ** (-score / n_tokens). Repeated rows give repeated rows; other columns are left out.
    """
    vocabulary = model.vocabulary

    def run(batches):
        reader = Reader(model)
        for ids, own in batches_of(batches):
            numbers, counts = numbered(own, vocabulary)
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            begin = np.append(0, np.cumsum(sizes)[:-1])
            logs = np.log10(reader.probabilities(numbers, sizes))
            base = np.log10((counts + 0.5) / (vocabulary.total + 0.5 * (vocabulary.size + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(np.add.reduceat((counts > 0).astype(np.int64), begin)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(logs, begin))], names=[f.split(" ")[0] for f in SCORES.split(", ")])

    return map_batches(whole_texts(docs), run, SCORES)


def held_out_scores(docs: DataFrame, fold: int = 1, folds: int = 5, order: int = 3) -> DataFrame:
    """Scores of all texts under a model of those outside one fold of crc32(doc_id), with the size of the training text."""
    model = fit(docs.where(F.coalesce(crc_fold("doc_id", folds) != fold, F.lit(True))), order)
    return score(docs, model).select("doc_id", F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
