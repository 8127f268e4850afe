"""N-gram Jaccard join by chosen paths.

Each text is the set of its word n-grams, embedded as ``width`` minima of hash functions ("tokens": a position and its
minimum). A run splits all sets recursively: at each node it samples ``branch`` positions, and sets that share the token
there go on together. Buckets of one set end; small buckets, those whose sets are alike on the whole (further splits
wouldn't part them, Christiani, Pagh and Sivertsen 2018), and those still large at the last level, are compared.
Runs are repeated until the chance to miss a link at the least similarity is below ``1 - recall``.

Comparing counts each link in one bucket only (the first that both sets share), so no pair leaves its task: a task emits
for each set its number of links and one edge of a spanning forest. A bucket beyond a task's bounds (sets, n-grams) is
dealt as pairs of blocks. Exact counts of links compare the different sets of a bucket with each other; equal sets are one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import drop, map_batches, whole_texts, written

SIGNATURES = "doc_id long, text_1 long, text_2 long, fp_high long, fp_low long, n_grams int, sketch binary, paths array<long>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a text of fewer words is one gram, without words none.

    Words are what white space separates, in lower case.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids: dict[str, int] = {}
    h = np.fromiter((ids[w] if w in ids else ids.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = mixed(out * np.uint64(31) + h[i : len(words) - k + 1 + i])
    return np.unique(out)


def minima(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each of ``width`` hash functions over a set."""
    out = np.full(width, np.uint64(2**64 - 1))
    seeds = mixed(np.arange(1, width + 1, dtype=np.uint64) * MIX)
    rows = max(1, 65_536 // width)
    for at in range(0, len(grams), rows):
        part = grams[at : at + rows, None] ^ seeds[None, :]
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        part *= MIX
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sampled(node: np.ndarray, branch: int, width: int) -> np.ndarray:
    """For each node (uint64), ``branch`` positions: the same for all sets of the node."""
    return np.stack([mixed(node + step) % np.uint64(width) for step in MIX * np.arange(1, branch + 1, dtype=np.uint64)], axis=1).astype(np.int64)


def children(node: np.ndarray, tokens: np.ndarray, branch: int) -> np.ndarray:
    """The nodes after a split: one row of ``branch`` for each node and row of tokens."""
    at = sampled(node, branch, tokens.shape[1])
    token = np.take_along_axis(tokens, at, axis=1)
    return mixed(mixed(node[:, None] + at.astype(np.uint64) * MIX) ^ token)


def signatures(docs: DataFrame, n: int, width: int, runs: int, branch: int) -> DataFrame:
    """Per document: two hashes of its text, a 128-bit digest of its set, its size, its tokens (32 bits each) and its
    nodes after one split.
    """
    roots = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                grams = gram_hashes(text, n)
                low = minima(grams, width)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                paths = children(roots, np.broadcast_to(low, (runs, width)), branch).view(np.int64).ravel() if len(grams) else np.zeros(0, np.int64)
                rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), len(grams), (low >> np.uint64(32)).astype(np.uint32).tobytes(), np.unique(paths)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_1", "text_2")), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[f.split(" ")[0] for f in SIGNATURES.split(", ")])

    return map_batches(keyed(whole_texts(docs)).select("doc_id", "text_1", "text_2", "text"), run, SIGNATURES)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds text_1 and text_2, which name a text by 128 bits; a null text is the empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"text_1": F.xxhash64(text), "text_2": F.xxhash64(F.lit(1), text)})


def split_further(rows: DataFrame, branch: int) -> DataFrame:
    """(node, rep, sketch) after one more split."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            nodes = children(batch.column("node").to_numpy().view(np.uint64), tokens, branch)
            rep = np.repeat(batch.column("rep").to_numpy(), branch)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(rep)], names=["node", "rep"])

    return map_batches(rows, run, "node long, rep long").distinct()


def alike(big: DataFrame, sketches: DataFrame, mean: float, sample: int = 16) -> DataFrame:
    """(node): nodes whose sets share at least ``mean`` of their tokens on average, by a sample of pairs of each node."""
    first = Window.partitionBy("node").orderBy(F.xxhash64("rep"), "rep")
    some = big.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("node", "rep")
    gathered = some.join(sketches, "rep").groupBy("node").agg(F.collect_list("sketch").alias("sketches"))

    def run(batches):
        for batch in batches:
            kept = []
            for node, own in zip(batch.column("node").to_pylist(), batch.column("sketches").to_pylist(), strict=True):
                tokens = np.frombuffer(b"".join(own), np.uint32).reshape(len(own), -1)
                if np.average([(tokens[:k] == tokens[k]).mean() for k in range(1, len(tokens))], weights=range(1, len(tokens))) >= mean:
                    kept.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["node"])

    return map_batches(gathered, run, "node long")


def buckets(reps: DataFrame, branch: int, small: int, levels: int, mean: float) -> DataFrame:
    """(node, rep): buckets of at least two sets: small ones, those of sets alike, or those of the last level."""
    sketches = reps.select("rep", "sketch")
    live, done, leaves = reps.select(F.explode("paths").alias("node"), "rep"), None, []
    for level in range(levels):
        sizes = live.groupBy("node").count().where("count > 1")
        sized = written(live.join(sizes, "node").select("node", "rep", "count"), "sized")
        if level:
            drop(live)
        big = sized.where(F.col("count") > small).select("node", "rep")
        if level == levels - 1 or big.isEmpty():
            leaves.append(sized.select("node", "rep"))
            break
        dense = written(alike(big, sketches, mean), "alike")
        ended = sized.where(F.col("count") <= small).select("node", "rep").unionByName(big.join(dense, "node", "left_semi"))
        leaves.append(written(ended, "ended"))
        live = written(split_further(big.join(dense, "node", "left_anti").join(sketches, "rep"), branch), "split")
        drop(sized, dense)
    for leaf in leaves:
        done = leaf if done is None else done.unionByName(leaf)
    out = written(done, "buckets")
    drop(*leaves)
    return out


def blocks(rows: DataFrame, size: int, grams: int) -> DataFrame:
    """(cell, left, same, ...): each bucket's sets in pairs of blocks of about ``size`` sets and ``grams`` n-grams.

    left: the set's block is the pair's first; same: the pair is one block with itself. A bucket within both bounds is one
    cell. Of a larger one, each set goes to as many cells as there are blocks, so that every pair of sets meets.
    """
    sizes = rows.groupBy("node").agg(F.ceil(F.greatest(F.count("*") / size, F.sum("n_grams") / grams)).cast("int").alias("parts"))
    own = rows.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return own.select("*", other).select("node", F.xxhash64("node", low, high).alias("cell"), (F.col("part") <= F.col("other")).alias("left"), (F.col("part") == F.col("other")).alias("same"), *[c for c in rows.columns if c not in ("node", "n_grams")])


def by_cell(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(table) for each cell's rows, sorted by rep; it returns columns for ``schema``, or None.

    Cells have at most two blocks of rows, so a partition streams through its worker cell by cell.
    """
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        held = []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(cells)), strict=True):
                part = batch.slice(a, b - a)
                if held and len(part) and held[0].column("cell")[0].as_py() != part.column("cell")[0].as_py():
                    yield from out(held)
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield from out(held)

    def out(parts):
        table = pa.Table.from_batches(parts)
        _, first = np.unique(table.column("rep").to_numpy(), return_index=True)
        columns = work(table.take(first) if len(first) < len(table) else table)
        if columns is not None and len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows.repartition("cell").sortWithinPartitions("cell", "rep"), run, schema)


def first_shared(mine: list[np.ndarray], node: int) -> np.ndarray:
    """Incidence of the nodes before ``node`` that at least two of the sets have."""
    size = [int(np.searchsorted(m, node)) for m in mine]
    flat = np.concatenate([m[:k] for m, k in zip(mine, size, strict=True)]) if mine else np.zeros(0, np.int64)
    names, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(mine), len(names)), np.float32)
    out[np.repeat(np.arange(len(mine)), size), at] = 1
    return out[:, counts > 1]


def forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` items the least item it is linked with, over any number of links."""
    root = np.arange(count)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def halves(table: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a cell pairs a block with itself, and the places of both blocks' rows."""
    if table.column("same")[0].as_py():
        return True, np.arange(len(table)), np.arange(len(table))
    left = table.column("left").to_numpy()
    return False, np.flatnonzero(left), np.flatnonzero(~left)


def node_lists(table: pa.Table) -> list[np.ndarray]:
    lists = table.column("nodes").combine_chunks()
    return np.split(lists.values.to_numpy()[lists.offsets[0].as_py() :], (lists.offsets.to_numpy() - lists.offsets[0].as_py())[1:-1])


def candidate_rows(rows: DataFrame, least: float) -> DataFrame:
    """(cell, left, same, node, rep, nodes) of the sets that may have a link in a cell, by their tokens.

    A pair belongs to the first bucket that both sets share. Its share of equal tokens estimates the similarity; it goes on
    from 5 standard deviations below the least similarity.
    """

    def keep(table):
        if len(table) < 2:
            return None
        tokens = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(table), -1)
        width = tokens.shape[1]
        need = width * (least - 5 * math.sqrt(least * (1 - least) / width))
        seen = first_shared(node_lists(table), table.column("node")[0].as_py())
        same, first, second = halves(table)
        hit = np.zeros(len(table), bool)
        for at in range(0, len(first), 256):
            mine = first[at : at + 256]
            fresh = seen[mine] @ seen[second].T == 0
            if not fresh.any():
                continue
            fresh &= mine[:, None] != second[None, :]
            i, j = np.nonzero(fresh)
            if 8 * len(i) < fresh.size:  # few pairs aren't counted in another bucket
                ok = np.concatenate([(tokens[mine[i[k : k + 65536]]] == tokens[second[j[k : k + 65536]]]).sum(axis=1) >= need for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                hit[mine[i[ok]]] = True
                hit[second[j[ok]]] = True
                continue
            equal = np.zeros((len(mine), len(second)), np.int16)
            for k in range(width):
                equal += tokens[mine, k][:, None] == tokens[second, k][None, :]
            ok = fresh & (equal >= need)
            hit[mine] |= ok.any(axis=1)
            hit[second] |= ok.any(axis=0)
        kept = table.filter(pa.array(hit)).select(["cell", "left", "same", "node", "rep", "nodes"])
        return [c.combine_chunks() for c in kept.columns]

    return by_cell(rows, keep, "cell long, left boolean, same boolean, node long, rep long, nodes array<long>")


def verified(rows: DataFrame, n: int, least: float) -> DataFrame:
    """(rep, other, links) of cells whose rows have texts, by exact comparison of whole sets.

    other: the least set of rep's part of the cell's spanning forest.
    """

    def compare(table):
        if len(table) < 2:
            return None
        grams = [gram_hashes(t, n) for t in table.column("text").to_pylist()]
        count, rep = len(table), table.column("rep").to_numpy()
        size = np.array([len(g) for g in grams])
        _, at, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1  # grams of one set only count in its size
        kept = counts[at] > 1
        owner, order = np.repeat(np.arange(count), size)[kept], column[at][kept]
        wide = int((counts > 1).sum())
        seen = first_shared(node_lists(table), table.column("node")[0].as_py())
        same, first, second = halves(table)

        def dense(which, start, stop):
            """Incidence of some sets with a range of grams."""
            place = np.full(count, -1)
            place[which] = np.arange(len(which))
            use = (place[owner] >= 0) & (order >= start) & (order < stop)
            out = np.zeros((len(which), stop - start), np.float32)
            out[place[owner[use]], order[use] - start] = 1
            return out

        links, ends = np.zeros(count, np.int64), [(first[:0], first[:0])]
        for at in range(0, len(first), 512):
            mine = first[at : at + 512]
            fresh = seen[mine] @ seen[second].T == 0
            if same:
                fresh &= second[None, :] > mine[:, None]
            if not fresh.any():
                continue
            shared = np.zeros(fresh.shape, np.float32)
            for start in range(0, wide, 8192):
                stop = min(wide, start + 8192)
                shared += dense(mine, start, stop) @ dense(second, start, stop).T
            union = size[mine][:, None] + size[second][None, :] - shared
            i, j = np.nonzero(fresh & (shared >= least * union - 1e-6))
            a, b = mine[i], second[j]
            links += np.bincount(a, minlength=count) + np.bincount(b, minlength=count)
            ends.append((a, b))
        root = forest(count, np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))
        some = links > 0
        return [pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some])]

    return by_cell(rows, compare, "rep long, other long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(rep, root): the least set of each set's component, by alternating large and small stars until no edge changes.

    edges: (rep, other), only of sets with a link. Each round is written to the shared folder and the one before it
    deleted. A set with very many edges is one key of the joins; its rows hold two numbers, and adaptive execution splits
    its partition.
    """
    both = lambda e: e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
    now = written(edges.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        near = both(now)
        low = near.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = near.join(low, "v").where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("b", "m", "a")
        stars = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, written(stars, "edges")
        settled = now.join(before, ["a", "b"], "left_anti").isEmpty() and before.join(now, ["a", "b"], "left_anti").isEmpty()
        drop(before)
        if settled:
            return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("rep"), "root")


def runs_for(recall: float, least: float, branch: int, levels: int) -> int:
    """How many runs find a pair at the least similarity with the wanted chance: a chosen path survives each level if one
    of ``branch`` sampled positions has a shared token that survives the next.
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - (1 - least * p) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def join(docs: DataFrame, n: int = 5, least: float = 0.8, recall: float = 0.99999, width: int = 64, branch: int = 2, levels: int = 6, small: int = 96, block: int = 2048, grams: int = 1 << 21) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document; text_1, text_2 (hashes of the text) and class_no follow.

    class_id: the least doc_id that exact copies (equal sets of n-grams) and links (Jaccard similarity of at least ``least``)
    connect it with. n_links: the number of different sets it is linked with. n_copies: documents with its set. class_no
    numbers the classes. Texts are whole; null and empty texts, and such without words, have no set: each is a class of its
    own, without links or class_no. Texts of fewer than n words are one gram. Repeated rows are copies; different texts under
    one doc_id are different sets; rows without a doc_id take part and name no class (class_id is null if all of a class
    are such). An empty table gives an empty one; other columns are left out.
    """
    sig = written(signatures(docs, n, width, runs_for(recall, least, branch, levels), branch), "signatures")
    # copies meet as one row each
    sets = sig.where("n_grams > 0").groupBy("fp_high", "fp_low").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.min(F.struct("text_1", "text_2")).alias("text"), F.first("n_grams").alias("n_grams"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    reps = written(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    rows = buckets(reps, branch, small, levels, least / 2)
    nodes = rows.groupBy("rep").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    about = reps.select("rep", "sketch", "n_grams").join(nodes, "rep")
    found = written(candidate_rows(blocks(rows.join(about, "rep"), block, grams), least), "candidates")
    drop(rows)
    wanted = reps.join(found.select("rep").distinct(), "rep", "left_semi").select("rep", "text.*")
    # one text of each name, combined before the shuffle; always this join, so that all sizes behave alike
    texts = keyed(whole_texts(docs)).groupBy("text_1", "text_2").agg(F.first("text").alias("text"))
    texts = texts.join(wanted.hint("merge"), ["text_1", "text_2"]).select("rep", "text")
    links = written(verified(found.join(texts.hint("merge"), "rep"), n, least), "links")
    drop(found)
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(links.select("rep", "other"))
    known = reps.select("rep", "fp_high", "fp_low", "least", "n_copies").join(counts, "rep", "left").join(roots, "rep", "left").withColumn("class_no", F.coalesce("root", "rep"))
    known = written(known.select("class_no", "fp_high", "fp_low", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "known")
    drop(links, reps)
    named = known.join(known.groupBy("class_no").agg(F.min("least").alias("class_id")), "class_no").drop("least")
    some = sig.where("n_grams > 0").select("doc_id", "text_1", "text_2", "fp_high", "fp_low").join(named, ["fp_high", "fp_low"]).select("doc_id", "class_id", "n_links", "n_copies", "text_1", "text_2", "class_no")
    none = sig.where("n_grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "text_1", "text_2", F.lit(None).cast("long").alias("class_no"))
    return some.unionByName(none)


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that stand for their class in ``joined``: the one with the least doc_id.

    Of several rows of a class with that doc_id one stays (the texts' hashes decide, then the other columns' hash). Rows
    without words are copies of nothing, and rows without a doc_id can't be named: all of them stay.
    """
    order = F.struct("doc_id", "text_1", "text_2")
    stay = joined.where("class_no IS NOT NULL AND doc_id IS NOT NULL").groupBy("class_no").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_1").alias("__1"), F.col("x.text_2").alias("__2"))
    wordless = joined.where("class_no IS NULL").select(F.col("text_1").alias("__1"), F.col("text_2").alias("__2")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.where("doc_id IS NOT NULL").withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)})
    same = (F.col("__a") == F.col("__1")) & (F.col("__b") == F.col("__2"))
    kept = own.join(stay.hint("merge"), same & (F.col("doc_id").cast("long") == F.col("__id")), "left_semi")
    first = Window.partitionBy("__a", "__b", "doc_id").orderBy(F.xxhash64(*docs.columns))
    one = kept.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").select(*docs.columns)
    return one.unionByName(own.join(wordless, same, "left_semi").select(*docs.columns)).unionByName(docs.where("doc_id IS NULL"))
