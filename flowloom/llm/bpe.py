"""BPE encoding and decoding with a pair occurrence index.

All distinct words of a batch lie one after the other in one array of symbols. An index maps each mergeable
pair (by its rank) to all positions where it occurs. Active ranks are applied in ascending order, each to all its
positions at once, and the lists of the pairs that appear beside a merge are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from flowloom.llm.common import map_batches, whole_texts

NONE = np.int64(1 << 40)
#: The split of byte-level BPE before merging: a fixed value of the vocabulary's format.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else 256 onwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PairIndexBpe:
    """Encodes words (bytes) by the merges in a tokenizers file; equal to the library's result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        cut = len(self.suffix)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        back = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for word, k in vocab.items():
            body = word[:-cut] if cut and word.endswith(self.suffix) else word
            self.token_bytes[k] = bytes(back[c] for c in body) if all(c in back for c in body) else body.encode()
        for word, k in self.special.items():
            self.token_bytes[k] = word.encode()
        self.id_text = [str(k) for k in range(size)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each word the end of its ids. Words must not be empty."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(raw)
        sym = np.append(self.inner[raw], 0)
        sym[ends - 1] = self.final[raw[ends - 1]]
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1] = n
        prv[0], prv[ends[:-1]] = n, n
        alive = np.ones(n, bool)
        cur = np.full(n + 1, NONE)
        inner = np.flatnonzero(nxt[:n] < n)
        cur[inner] = self.ranks(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            """Puts positions into the lists of their pairs."""
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, where in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(heap, r)

        if len(start := inner[cur[inner] < NONE]):
            enter(start, cur[start])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            p = np.sort(p[cur[p] == r])
            if not len(p):
                continue
            p = p[np.append(True, p[1:] != p[:-1])]
            if self.left[r] == self.right[r] and len(p) > 1:  # of overlapping pairs the leftmost goes first
                k = np.arange(len(p))
                joined = np.append(False, nxt[p[:-1]] == p[1:])
                p = p[(k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 0]
            q = nxt[p]
            z = nxt[q]
            sym[p] = self.made[r]
            nxt[p] = z
            prv[z] = p
            cur[q] = NONE
            cur[p] = NONE
            alive[q] = False
            before = prv[p]
            at = np.concatenate([before[before < n], p[z < n]])
            if not len(at):
                continue
            ranks = self.ranks(sym[at], sym[nxt[at]])
            cur[at] = ranks
            live = ranks < NONE
            if live.any():
                enter(at[live], ranks[live])
        return sym[:n][alive], np.cumsum(alive)[ends - 1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class ChunkStore:
    """Ids of the chunks met so far, one after the other, and where each chunk's ids lie.

    ``split`` turns a list of chunks into all their words (bytes) and the number of words of each chunk. The store is emptied once it holds ``memo`` chunks: a bound on
    memory that changes no result.
    """

    def __init__(self, bpe: PairIndexBpe, split, memo: int = 250_000):
        self.bpe, self.split, self.memo = bpe, split, memo
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def places(self, chunks: list[str]) -> np.ndarray:
        """The place of each of some distinct chunks; new ones are encoded first."""
        if len(self.at) > self.memo:
            self.clear()
        if new := [c for c in chunks if c not in self.at]:
            words, per_chunk = self.split(new)
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids, ends = self.bpe.encode(list(number))
            flat, word_ends = slices(ids.astype(np.int32), np.append(0, ends), np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            chunk_ends = np.append(0, word_ends)[np.cumsum(per_chunk)]
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.ends = np.concatenate([self.ends, chunk_ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))


def slices(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[ends[k]:ends[k + 1]] for each k, one after the other, and where each ends."""
    start, size = ends[which], ends[which + 1] - ends[which]
    to = np.cumsum(size)
    return values[np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - size), size)], to


#: Texts with these keep their white space together: anything but single spaces and line feeds between words. NUL marks a text's begin.
ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Between a printable ASCII character and a space or line feed after it a pre-token always ends and another begins.
SAFE = regex.compile(r"(?<=[!-~])(?=[ \n])")


class ByteLevelTexts:
    """Encodes batches of texts under a byte-level vocabulary, as the library does.

    A pre-token always begins at a single space, or at a line feed, that stands between two other characters;
    so texts are cut there, and each distinct chunk is encoded once. Other texts are cut into long parts where that is safe.
    Strings of special tokens in a text become those tokens.
    """

    def __init__(self, path: str):
        self.bpe = PairIndexBpe(path)
        self.store = ChunkStore(self.bpe, split_chunks)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")") if self.bpe.special else None
        self.odd = ODD + "".join("|" + regex.escape(s) for s in self.bpe.special)

    def parts(self, text: str, longest: int = 1 << 16):
        """The ids of one text, without the store: part by part, each cut at the first safe place after ``longest``."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.bpe.special:
                yield np.array([self.bpe.special[part]], np.int32)
                continue
            at = 0
            while at < len(part):
                place = SAFE.search(part, at + longest) if len(part) - at > longest else None
                end = place.start() if place else len(part)
                yield self.bpe.encode([w.encode() for w in WORDS.findall(part[at:end])])[0].astype(np.int32)
                at = end

    def alone(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *self.parts(text)])

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts are odd; for the others, the places of all their chunks and the number of each one's chunks."""
        odd = pc.match_substring_regex(texts, self.odd)
        plain = texts.filter(pc.invert(odd))
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\0", plain, ""), "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        at = self.store.places(coded.dictionary.to_pylist())
        return odd.to_numpy(zero_copy_only=False), at[coded.indices.to_numpy()] if len(at) else at, pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        odd, at, sizes = self.places(texts)
        total = np.append(0, np.cumsum(np.diff(self.store.ends)[at]))
        ends = np.cumsum(sizes)
        out = np.zeros(len(texts), np.int64)
        out[~odd] = total[ends] - total[ends - sizes]
        for k in np.flatnonzero(odd):
            out[k] = sum(map(len, self.parts(texts[int(k)].as_py())))
        return out

    def ids(self, texts: pa.Array):
        """The ids of each text, in turn."""
        odd, at, sizes = self.places(texts)
        flat, ends = slices(self.store.ids, self.store.ends, at)
        cuts = iter(np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist())
        start = next(cuts)
        for k, alone in enumerate(odd.tolist()):
            if alone:
                yield self.alone(texts[k].as_py())
            else:
                end = next(cuts)
                yield flat[start:end]
                start = end


def split_chunks(chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All words of chunks: after NUL as it is, a line feed and what follows, or else after a space."""
    texts = [c if c[:1] == "\n" else " " + c for c in chunks]
    words = WORDS.findall("".join(texts))  # each chunk begins with white space, where a word begins
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    counts = np.diff(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))) + 1, prepend=0)
    words = [w.encode() for w in words]
    heads = [k for k, c in enumerate(chunks) if c[:1] == "\0"]
    if heads:
        cuts = np.append(0, np.cumsum(counts))
        out, done = [], 0
        for k in heads:
            own = [w.encode() for w in WORDS.findall(chunks[k][1:])]
            out += words[done : cuts[k]]
            out += own
            done, counts[k] = cuts[k + 1], len(own)
        words = out + words[done:]
    return words, counts


_TEXTS: dict[str, ByteLevelTexts] = {}


def byte_level(path: str) -> ByteLevelTexts:
    """One for each worker, which keeps its store from task to task."""
    if path not in _TEXTS:
        _TEXTS[path] = ByteLevelTexts(path)
    return _TEXTS[path]


def by_bytes(column: pa.Array, most: int):
    """Slices of about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
        yield slice(start, end)
        start = end


SCHEMA = "doc_id long, ids array<int>"


def encode(docs: DataFrame, tokenizer_path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and ids (array of int) of every whole text. Null and empty texts have no ids."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch.column("text"), batch_bytes):
                ids = byte_level(tokenizer_path).ids(batch.column("text")[part])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[part], "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))})

    return map_batches(whole_texts(docs), run, SCHEMA)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of every row of ids; special tokens are written out."""

    def run(batches):
        bpe = byte_level(tokenizer_path).bpe
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())})

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, tokenizer_path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Per document the number of ids, and SHA-256 of the ids (decimal, by commas) and of the text decoded from them.

    Null and empty texts have no ids and digests of nothing. Repeated rows give repeated rows; columns other than
    doc_id and text are left out. Encoding and decoding happen in the same pass, so ids never leave their task.
    """

    def run(batches):
        bpe = byte_level(tokenizer_path).bpe
        for batch in batches:
            for part in by_bytes(batch.column("text"), batch_bytes):
                rows: list[tuple[int, str, str]] = []
                for ids in byte_level(tokenizer_path).ids(batch.column("text")[part]):
                    ids = ids.tolist()
                    joined = ",".join(map(bpe.id_text.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[part], "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())})

    return map_batches(whole_texts(docs), run, DIGEST)
