"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the sequence size, so the whole instance is a histogram of at most that many
counts, however many documents there are. The driver solves it on counts: bins of the same content are one
entry with a multiplicity. Spark then deals each piece, by its rank among the pieces of its length, to its place.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.bpe import ChunkStore, PairIndexBpe, by_bytes, slices
from flowloom.llm.common import map_batches, whole_texts, written

#: The split before merging in the word vocabulary (a fixed value of its format), and single white space.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\s""")
#: Chunks that are in normal form and lower-cased letter by letter: printable ASCII and Latin-1 letters.
PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ]*")


class WordLevelTexts:
    """Ids of texts under a word-level BPE that drops white space and case, equal to the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = PairIndexBpe(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letter_bytes = {c: b for b, c in enumerate(_letters())}
        self.store = ChunkStore(self.bpe, self.split)
        self.odd = "|".join(map(regex.escape, self.bpe.special)) or r"\z\A."

    def split(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        plain = [c if PLAIN.fullmatch(c) else "" for c in chunks]
        words = WORDS.findall(" ".join(plain).lower())
        gaps = np.flatnonzero(np.fromiter(map(" ".__eq__, words), bool, len(words)))
        counts = np.diff(np.concatenate([[-1], gaps, [len(words)]])) - 1
        words = [w.encode() for w in words if w != " "]
        others = [k for k, (c, p) in enumerate(zip(chunks, plain, strict=True)) if c != p]
        if others:
            cuts, out, done = np.append(0, np.cumsum(counts)), [], 0
            for k in others:
                own = [bytes(map(self.letter_bytes.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunks[k]))]
                out += words[done : cuts[k]]
                out += own
                done, counts[k] = cuts[k + 1], len(own)
            words = out + words[done:]
        return words, counts

    def ids(self, texts: pa.Array):
        """The ids of each text, in turn."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        spaced = texts.filter(pa.array(~odd))
        for c in "\n\t\r":
            spaced = pc.replace_substring(spaced, c, " ")
        lists = pc.split_pattern(pc.ascii_lower(spaced), " ")
        cuts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        coded = lists.flatten().dictionary_encode()
        del spaced, lists
        at = self.store.places(coded.dictionary.to_pylist())
        at = at[coded.indices.to_numpy()] if len(at) else at
        del coded
        spaced_ids = self.runs(at, cuts)
        for k, alone in enumerate(odd.tolist()):
            yield np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32) if alone else next(spaced_ids)

    def runs(self, at: np.ndarray, cuts: np.ndarray, most: int = 1 << 16):
        """The ids of texts whose chunks are at[cuts[k]:cuts[k + 1]], in turn, laid out for about ``most`` chunks at a time."""
        k = 0
        while k < len(cuts) - 1:
            to = max(k + 1, int(np.searchsorted(cuts, cuts[k] + most, "right")) - 1)
            flat, ends = slices(self.store.ids, self.store.ends, at[cuts[k] : cuts[to]])
            ends = np.append(0, ends)[cuts[k : to + 1] - cuts[k]].tolist()
            for start, end in zip(ends, ends[1:], strict=False):
                yield flat[start:end]
            k = to


def _letters() -> list[str]:
    from flowloom.llm.bpe import byte_letters

    return byte_letters()


_TEXTS: dict[str, WordLevelTexts] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int = 0, batch_bytes: int = 4 << 20) -> DataFrame:
    """Each document's ids and one end id, cut into pieces of at most ``size``.

    part and nth: the task that made the piece, and the piece's number among those of its length there.
    """

    def run(batches):
        texts_of = _TEXTS.get(tokenizer_path) or _TEXTS.setdefault(tokenizer_path, WordLevelTexts(tokenizer_path))
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for cut in by_bytes(batch.column("text"), batch_bytes):
                rows = []
                for doc, ids in zip(batch.column("doc_id")[cut].to_pylist(), texts_of.ids(batch.column("text")[cut]), strict=True):
                    raw, n = np.append(ids, end_id).astype("<u4").tobytes(), len(ids) + 1
                    for k, start in enumerate(range(0, n, size)):
                        length = min(size, n - start)
                        rows.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, int(seen[length])))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return map_batches(whole_texts(docs), run, PIECES)


def reduced(counts: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that some best packing has, with how often, and the counts that remain (Martello and Toth, 1990).

    Each item is tried, longest first; one without a dominating bin is passed over, and all are tried again until nothing
    changes. If nothing fits beside an item, it is alone. Let b be the longest that fits beside it. {item, b} dominates all
    bins with the item if b fills the bin or no two items fit beside it. If at most two fit beside it, let q be the longest
    that fits beside both, if any: {item, b, q} does so if no two others that fit are both longer than q and together longer
    than b (each other pair then fits into b and q, or into b alone).
    """
    left = {k: n for k, n in counts.items() if n}
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def has(x: int, *without: int) -> int:
        return left.get(x, 0) - without.count(x)

    def shortest(k: int, without: int) -> list[int]:
        """The k shortest items beside one of the given length."""
        out: list[int] = []
        for x in lengths:
            out += [x] * min(k - len(out), has(x, without))
            if len(out) == k:
                break
        return out

    def longest(room: int, *without: int) -> int:
        """The longest item of at most ``room`` beside others; 0 without one."""
        at = bisect.bisect_right(lengths, room) - 1
        while at >= 0 and has(lengths[at], *without) < 1:
            at -= 1
        return lengths[at] if at >= 0 else 0

    def pair(room: int, above: int, j: int) -> int:
        """The most that two items longer than ``above`` fill of ``room`` beside j; 0 without two."""
        best, hi = 0, len(lengths) - 1
        for lo in range(bisect.bisect_right(lengths, above), len(lengths)):
            x = lengths[lo]
            while hi >= lo and x + lengths[hi] > room:
                hi -= 1
            if hi < lo:
                break
            at = hi
            while at >= lo and (has(lengths[at], j) < 1 or at == lo and has(x, j) < 2):
                at -= 1
            if at >= lo and has(x, j) >= 1:
                best = max(best, x + lengths[at])
        return best

    def take(content: tuple[int, ...], times: int) -> None:
        fixed.append((content, times))
        for x in set(content):
            left[x] -= times * content.count(x)
            if not left[x]:
                del left[x]
                del lengths[bisect.bisect_left(lengths, x)]

    def bin_of(j: int) -> tuple[tuple[int, ...], bool] | None:
        """A bin that dominates all others with j, and whether that holds as long as its items last."""
        room = size - j
        low = shortest(3, j)
        if not low or low[0] > room:
            return (j,), True
        b = longest(room, j)
        if b == room or len(low) < 2 or low[0] + low[1] > room:
            return (j, b), True
        if len(low) < 3 or sum(low) > room:
            q = longest(room - b, j, b)
            if pair(room, q, j) <= b:
                return ((j, b, q) if q else (j, b)), False
        return None

    changed = True
    while changed:
        changed = False
        for j in lengths[::-1]:
            while j in left and (found := bin_of(j)):
                content, lasts = found
                most = min(left[x] // content.count(x) for x in set(content))
                # tests depend on which lengths have none, one, two or more items left
                take(content, most if lasts and len(content) > 1 and most > 0 else max(1, min((left[x] - 3) // content.count(x) for x in set(content))))
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length on counts: equal bins are filled together."""
    groups: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}
    rooms: list[int] = []

    def put(content: tuple[int, ...], times: int) -> None:
        room = size - sum(content)
        if content in groups:
            groups[content] += times
            return
        groups[content] = times
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(content)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = size // length
                if n // fit:
                    put((length,) * fit, n // fit)
                if n % fit:
                    put((length,) * (n % fit), 1)
                break
            room = rooms[at]
            content = by_room[room][-1]
            times = groups[content]
            fit = min(room // length, n)
            used = min(times, n // fit)
            groups[content] -= used
            if not groups[content]:
                del groups[content]
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    del rooms[at]
            put((*content, *[length] * fit), used)
            n -= used * fit
    return list(groups.items())


def packed(parts: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns length, part and nth, which are dropped)."""
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    fixed, rest = reduced(counts, size)
    # for each length, ranks from..to lie in the sequences from ``base`` on, at ``offset``
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    slots: dict[int, list[tuple[int, int, int]]] = {k: [] for k in counts}
    base = 0
    for content, times in [*fixed, *best_fit(rest, size)]:
        offset = 0
        for x in content:
            slots[x].append((taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                start, first, at = table[int(length[own[0]])]
                k = np.searchsorted(start, rank[own], "right") - 1
                sequence[own], offset[own] = first[k] + rank[own] - start[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = parts.join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` ids.

    A document is its ids and one end id; only longer ones are cut. One row per piece: doc_id, piece, start, length,
    ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), sequence_id, offset. Null and empty texts are just an
    end id. Repeated rows are packed each; an empty table gives an empty one. Other columns are left out.
    """
    return packed(written(pieces(docs, tokenizer_path, size, end_id), "pieces"), size)
