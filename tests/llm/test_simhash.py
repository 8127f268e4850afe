"""SimHash near-duplicates against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(fps, radius):
    """The least fingerprint that each one is linked with, over any number of links."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {f: top(f) for f in fps}


def signed(fps):
    return np.array(fps, np.uint64).view(np.int64).tolist()


def clustered(count, centres, flips, seed):
    r = random.Random(seed)
    middle = [r.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < count:
        f = r.choice(middle)
        for b in r.sample(range(64), r.randint(0, flips)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b c d", "a b c d E", "x y Ä ä B\x0bC\x1cD e f g", "same same same same same same", "w " * 5000 + "end", " ".join(str(i % 97) for i in range(4000))])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)
    whole = simhash.word_lists
    monkeypatch.setattr(simhash, "word_lists", lambda data: whole(data, 7))  # pieces that shingles cross
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


@pytest.mark.parametrize(("count", "centres", "flips", "radius"), [(300, 300, 0, 4), (300, 4, 6, 4), (700, 1, 5, 4), (500, 3, 9, 3), (400, 2, 12, 8), (64, 1, 3, 0), (1, 1, 0, 4)])
def test_cells_keep_what_is_linked(count, centres, flips, radius):
    fps = clustered(count, centres, flips, count)
    cell = np.zeros(count, np.int64)
    cell[count // 2 :] = 7  # two cells in one batch
    want = plain_roots(fps[: count // 2], radius) | plain_roots(fps[count // 2 :], radius)
    a, b = simhash.linked(cell, np.array(fps, np.uint64), radius, pairs=50)
    root = {f: f for f in fps} | dict(zip(a.tolist(), b.tolist(), strict=True))
    assert root == want


@pytest.mark.parametrize("most", [32, 1 << 15])
def test_all_links_are_found_by_cells_that_part_again(spark, most):
    fps = clustered(900, 2, 7, 1) + clustered(200, 200, 0, 2) + [0, 2**64 - 1, 1, 2**63]
    df = spark.createDataFrame([(f,) for f in signed(sorted(set(fps)))], "fp long")
    edges = simhash.linked_fingerprints(df, 4, most)
    got = {r.rep: r.root for r in simhash.components(edges).collect()}
    want = plain_roots(fps, 4)
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(*signed([f]))
    found = {}
    for f in signed(sorted(set(fps))):
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_documents(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 9) for _ in range(200)) for _ in range(6)]
    texts = [None, "", "  ", "one", "ONE", "two words", "Two\tWords ", *base, *(b + " end" for b in base), base[0].upper(), *(" ".join(w for w in b.split() if r.random() > 0.01) for b in base for _ in range(5))]
    rows = [(100 - i, t, "x", i) for i, t in enumerate(texts)] + [(100, None, "x", 0), (None, base[1], "x", 0), (None, "alone among all", "x", 0), (3, base[2], "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    want_fp = [plain_fingerprint(t) for _, t, _, _ in rows]
    root = plain_roots(want_fp, 4)
    ids = {}
    for (d, *_), f in zip(rows, want_fp, strict=True):
        if d is not None:
            ids[root[f]] = min(d, ids.get(root[f], d))
    want = sorted([(d, f"{f:016x}", ids.get(root[f])) for (d, *_), f in zip(rows, want_fp, strict=True)], key=repr)
    for most in (32, 1 << 15):
        got = simhash.near_copies(df, most=most)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted([tuple(x) for x in got.collect()], key=repr) == want
    assert simhash.near_copies(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="most"):
        simhash.near_copies(df, most=16)


def test_very_long_text(spark):
    text = " ".join(f"W{i % 9973}" for i in range(250_000))
    df = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(df).collect()}
    assert got[1] == (f"{plain_fingerprint(text):016x}", 1)
    assert got[2][1] == 1
