"""Operators against brute force on small fixtures, with nulls, ties, repeated rows and clashing columns."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm import arrays, jaccard_join, kneser_ney, mpeg_audio, nn_descent, packing, token_counts, toxicity, url_filter
from flowloom.llm.queries import tokenizer


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[40:60] = x[0]  # ties
    odd = [(600, None), (620, [0.0] * 8), (640, [float("nan")] + [1.0] * 7), (660, [float("inf")] + [1.0] * 7), (680, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = [(i, v.tolist(), 1.0, i) for i, v in enumerate(x)] + [(i, v, 0.0, 0) for i, v in odd] + [(20, x[20].tolist(), 1.0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, number long")
    got = defaultdict(list)
    for r in nn_descent.search(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, rows in got.items():
        want = [v for v in np.lexsort((np.arange(600), -sims[q])).tolist() if v != q][:20]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(abs(s - sims[q, v]) < 1e-9 for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & set(want))
    assert hits >= 0.9 * 20 * len(got)
    few = {(r.query_id, r.vec_id) for r in nn_descent.search(df.where("vec_id < 3")).collect()}
    assert few == {(0, 1), (0, 2)}
    assert nn_descent.search(df.where("vec_id < 0")).count() == 0
    assert nn_descent.search(df.where("vec_id < 1")).count() == 0
    same = df.where("vec_id < 1").select(F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("vec_id"), "embedding")
    assert [(r.query_id, r.rank, r.vec_id) for r in nn_descent.search(same).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_graph_rounds_go_on_until_it_settles(spark, monkeypatch):
    rounds, improved = [], nn_descent.improved
    monkeypatch.setattr(nn_descent, "improved", lambda *a: rounds.append(a[-1]) or improved(*a))
    vectors = np.random.default_rng(5).normal(size=(800, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nn_descent.search(df, every=50, rounds=1, beam=64).collect()}
    assert len(rounds) > 1  # one round from random neighbours settles nothing
    sims = vectors[::50] @ vectors.T
    sims[np.arange(16), np.arange(0, 800, 50)] = -np.inf
    want = {(50 * q, int(v)) for q, row in enumerate(np.argsort(-sims, axis=1)[:, :20]) for v in row}
    assert len(got & want) >= 0.9 * len(want)


def plain_classes(texts, n=5, least=0.8):
    def grams(t):
        w = (t or "").lower().split()
        k = min(n, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= least * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
                if a != b:
                    links[a].add(b)
                    links[b].add(a)
    return root, [len(links[s]) for s in sets], [sum(s == o for o in sets) if s else 1 for s in sets]


def test_jaccard_join(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "one", "one", "one two"]
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 500, 80)]
        for _ in range(rng.integers(1, 8)):
            own = list(words)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                own[at] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, rep long, node long")
    rows = sorted(jaccard_join.join(df, small=4, block=8).collect())
    root, links, copies = plain_classes(texts)
    assert [r.class_id for r in rows] == root
    assert [r.n_links for r in rows] == links
    assert [r.n_copies for r in rows] == copies
    again = jaccard_join.join(df.unionByName(df.where("doc_id = 5"))).collect()
    assert len(again) == len(texts) + 1


def test_jaccard_join_of_a_large_group(spark):
    """2,000 near copies in one group, next to others: every count of links and class as by brute force."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(70)]
    texts = []
    for _ in range(2000):
        own = list(base)
        for at in rng.integers(0, 70, rng.integers(0, 5)):
            own[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"y{k}" for k in rng.integers(0, 3000, 40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(jaccard_join.join(df, block=512, grams=40_000).collect())
    grams = [jaccard_join.gram_hashes(t, 5) for t in texts]
    distinct = sorted({g.tobytes() for g in grams})
    at = {g: k for k, g in enumerate(distinct)}
    names = {x: k for k, x in enumerate(np.unique(np.concatenate(grams)).tolist())}
    seen = np.zeros((len(distinct), len(names)), np.float32)
    for g in grams:
        seen[at[g.tobytes()], [names[x] for x in g.tolist()]] = 1
    shared, size = seen @ seen.T, seen.sum(axis=1)
    linked = shared >= 0.8 * (size[:, None] + size[None, :] - shared) - 1e-6
    links = linked.sum(axis=1) - 1
    assert [r.n_links for r in rows] == [int(links[at[g.tobytes()]]) for g in grams]
    root = np.arange(len(distinct))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        if (low == root).all():
            break
        root = low
    least: dict = {}
    for k, g in enumerate(grams):
        least.setdefault(int(root[at[g.tobytes()]]), k)
    assert [r.class_id for r in rows] == [least[int(root[at[g.tobytes()]])] for g in grams]


def test_one_of_each_class(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a, 1), (1, a, 2), (2, a + " end", 3), (1, b, 4), (1, a, 2), (None, c, 5), (None, c, 5), (None, a, 6), (7, None, 7), (8, "", 8), (7, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_no int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.class_no) for r in jaccard_join.one_of_each(df, jaccard_join.join(df)).collect())
    assert got == sorted([(False, 1, a, 2), (False, 1, b, 4), (True, 0, c, 5), (True, 0, c, 5), (True, 0, a, 6), (False, 7, "", 7), (False, 7, "", 7), (False, 8, "", 8)])
    none = df.where("doc_id > 100")
    assert jaccard_join.one_of_each(none, jaccard_join.join(none)).count() == 0


def plain_kneser_ney(train, texts):
    """Scores by the definition, with dictionaries."""
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    pairs = Counter((a, b) for t in train for a, b in zip([None, *words(t)], words(t), strict=False))
    after = Counter(b for _, b in pairs)
    v, total = len({w for t in train for w in words(t)}), len(pairs)
    counts = lambda values: [sum(c == k for c in values) for k in (1, 2, 3, 4)]
    high, low = kneser_ney.discounts(*counts(pairs.values())), kneser_ney.discounts(*counts(after.values()))
    off = lambda c, d: (0.0, *d)[min(c, 3)]
    spare = sum(off(c, low) for c in after.values()) / total
    contexts = defaultdict(list)
    for (a, _), c in pairs.items():
        contexts[a].append(c)

    def p(a, b):
        out = (after[b] - off(after[b], low)) / total + spare / (v + 1)
        if own := contexts.get(a):
            c = pairs[a, b]
            out = (c - off(c, high)) / sum(own) + sum(off(k, high) for k in own) / sum(own) * out
        return out

    return [sum(math.log10(p(a, b)) for a, b in zip([None, *words(t)], words(t), strict=False)) for t in texts]


def test_language_model(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", "  unseen words\x85here ", *(" ".join(f"w{k}" for k in rng.zipf(1.6, 30) % 50) for _ in range(60))]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = {r.doc_id: r for r in kneser_ney.held_out_scores(df, order=2).collect()}
    want = plain_kneser_ney([texts[i] for i in train], texts)
    assert len(rows) == len(texts)
    for i, s in enumerate(want):
        assert rows[i].held_out == (i not in train)
        assert abs(rows[i].score - s) < 1e-9 * max(1, abs(s)), i


def test_packing_bounds(spark):
    rng = np.random.default_rng(9)
    texts = [None, "", *(" ".join("the dog ran to a house".split()[k % 6] for k in range(n)) for n in rng.integers(1, 90, 150))]
    path = tokenizer("word_bpe_49k.json")
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, part int, nth string")
    rows = packing.pack(df, path, size=64).collect()
    ids = [[*e.ids, 0] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + 64]
        assert (r.start, r.length, r.ids_crc32) == (64 * r.piece, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, ids)) // 64) * 1.1 + 1


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(11)
    for _ in range(60):
        items = sorted(rng.integers(1, 20, 7).tolist(), reverse=True)
        fixed, rest = packing.reduced(Counter(items), 20)
        assert sorted([x for c, n in fixed for x in c * n] + [x for x, n in rest.items() for _ in range(n)], reverse=True) == items
        assert all(sum(c) <= 20 for c, _ in fixed)
        assert sum(n for _, n in fixed) + fewest([x for x, n in rest.items() for _ in range(n)], 20) == fewest(items, 20)


def test_reduction_goes_on_past_items_without_a_dominating_bin():
    rng = np.random.default_rng(12)
    total = 0
    for _ in range(200):
        items = rng.integers(1, 40, rng.integers(1, 12)).tolist()
        fixed, rest = packing.reduced(Counter(items), 40)
        total += sum(n for _, n in fixed)
        left = [x for x, n in rest.items() for _ in range(n)]
        for k, x in enumerate(left):  # nothing is left that a plain rule fixes
            others = left[:k] + left[k + 1 :]
            assert 40 - x not in others and any(x + y <= 40 for y in others)
            assert any(x + y + z <= 40 for i, y in enumerate(others) for z in others[:i])
        assert sum(n for _, n in fixed) + fewest(left, 40) == fewest(items, 40)
    assert total > 400
    assert packing.reduced(Counter([6, 3, 3, 9, 9]), 12) == ([((9, 3), 2)], {6: 1}) or packing.reduced(Counter([6, 3, 3, 9, 9]), 12)[1] == {}
    # three items: beside 5 fit 4 and 3; no other pair is longer than 3 each and than 4 together
    fixed, rest = packing.reduced(Counter([50, 40, 9, 45, 46]), 99)
    assert not rest
    many, rest = packing.reduced({2048: 10**7, 2000: 10**6, 48: 10**6 + 5, 1500: 7}, 2048)
    assert sum(n * c.count(2000) for c, n in many) == 10**6 and sum(n for c, n in many if c == (2048,)) == 10**7


def fewest(items, size):
    """Bins of a best packing, by trying all."""
    best = len(items)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[at]:
                go(at + 1, (*rooms[:k], rooms[k] - items[at], *rooms[k + 1 :]))
        go(at + 1, (*rooms, size - items[at]))

    if items:
        go(0, ())
    return best


def test_media_digests(spark):
    texts = [None, "", "a" * 192, "a" * 193, "é" * 400, "same", "same"]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = sorted(mpeg_audio.digests(mpeg_audio.store_texts(df)).collect())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        whole = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(whole), zlib.crc32(whole[-16:]))
    assert rows[5][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]


def test_url_filters_edges(spark):
    schema = "page_id long, url string, key string, template string, n long"
    rows = [(None, None, "k", "t", 1), (1, "", "k", "t", 1), (2, "http://", None, None, None), (3, "x://a.org/b/c/d/e/f/g?q", "k", "t", 1), (3, "x://a.org/b/c/d/e/f/g?q", "k", "t", 1), (4, "http://A.COM/de/" + "z" * 5000, "k", "t", 1)]
    got = sorted(url_filter.judge(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert {(r.host, r.rule, r.verdict) for r in got if r.page_id in (3, 4)} == {("a.org", "org/", "allow"), ("a.com", "com/de/", "block")}
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0


def test_url_filters_broadcast_no_urls(spark, monkeypatch):
    """Tables of urls go to no driver, however small their files are; only those of hosts, nodes and names may."""
    plans, write = [], url_filter.written

    def seen(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x.split("Join", 1)[1] for x in plan.split("\n") if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]

    def spied(df, what):
        out = write(df, what)
        plans.extend(seen(df))
        return out

    monkeypatch.setattr(url_filter, "written", spied)
    urls = [f"http://h{i % 3}.net/{'ab'[i % 2]}/{i // 2}/c" for i in range(200)]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert seen(out) == []
    assert plans and all("LeftOuter, BuildRight" in x for x in plans)


def test_counts_and_labels_edges(spark):
    texts = [None, "", "a b" * 2000, "ü"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df, tokenizer("byte_bpe_50k.json"), limit=3).collect()}
    assert [got[i].n_bytes for i in range(4)] == [0, 0, 6000, 2] and got[2].over_limit and not got[0].over_limit
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels) is None
    assert toxicity.without_toxic(df, None).count() == 4


def test_toxicity_keeps_the_labels_shares(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = []
    for i in range(1500):
        toxic = int(rng.random() < 0.1)
        rows.append((i, " ".join([*rng.choice(words, 40), *(["grumblefish"] if rng.random() < (0.8 if toxic else 0.04) else [])]), toxic))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4).cache()
    model = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), per_class=90)
    mean = toxicity.score(data, model).groupBy().avg("score").first()[0]
    assert abs(mean - sum(t for *_, t in rows) / len(rows)) < 0.05


def test_documents_without_id_stay(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (1, "a b c d e f", 3), (2, "a b c d e f", 4)], "doc_id long, text string, class_id int")
    kept = jaccard_join.one_of_each(df, jaccard_join.join(df)).collect()
    assert sorted(r.class_id for r in kept) == [1, 2, 3]


def test_toxicity_scores_are_those_of_plain_windows(spark):
    """Scores from each window compressed by itself, by the definition; repeated, null, empty and long texts."""
    import zstandard

    model = toxicity.ToxicityModel(b" you grumblefish and snarkweed ", b" the dog ran to a house in the green forest ", 3, 2, (-1.0, 0.5, 0.3, 0.2, 0.1, -0.2, 0.4))
    long = "the dog snarkweed ran to a grumblefish in " * 3000
    texts = [None, "", " ", "The  dog\nran to a HOUSE", "you grumblefish and snarkweed", long, long]
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(None, "the dog", 0.1, "y")], "doc_id long, text string, score double, held_out string")

    def size(window, content):
        how = zstandard.ZstdCompressionParameters(window_log=21, hash_log=20, chain_log=20, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress(window))

    def plain(text):
        words = (text or "").lower().split()
        gains = sorted((size(w, model.ordinary) - size(w, model.toxic + model.ordinary) for at in range(0, len(words), 3) for w in [(" " + " ".join(words[at : at + 3]) + " ").encode()]), reverse=True)
        some = [g for g in gains if g >= 2]
        x = [1, gains[0] / 10, sum(gains[:3]) / 30, math.log1p(sum(some)), math.log1p(len(some)), math.log1p(len(gains)), sum(gains) / len(gains)] if gains else [1, *[0] * 6]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(df.collect())
    short = {t: plain(t) for t in [*texts[:5], "the dog"]}
    for r in rows:
        t = "the dog" if r.doc_id is None else texts[r.doc_id]
        if t != long:
            assert abs(r.score - short[t]) < 1e-9
    few = "the dog snarkweed ran to a grumblefish in " * 20
    assert abs(toxicity.score(spark.createDataFrame([(1, few)], "doc_id long, text string"), model).first().score - plain(few)) < 1e-9
    kept = toxicity.without_toxic(df, model)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id or 0) if r.doc_id is not None and r.score < 0.5]
    none = df.where("doc_id > 100")
    assert toxicity.score(none, model).count() == 0 and toxicity.without_toxic(none, model).count() == 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Repeated ids and long texts don't reach the driver beyond the bounds."""
    seen = []
    plain = toxicity.train_dictionaries
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda a, b, *more: seen.append((a, b)) or plain(a, b, *more))
    rows = [(i % 20, f"w{i} word" if i % 7 else "long " * 100) for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, per_class=3, longest=100)
    assert seen and all(len(a) <= 3 and len(b) <= 3 and max(map(len, a + b)) <= 100 for a, b in seen)


def plain_templates(urls, variety=0.5, least=8, cut=3.84, prior=4.0):
    """Template and purity of each (host, path, label) by walking each node's children in plain dictionaries."""
    import re

    def kind(x):
        if re.fullmatch("[0-9]+", x):
            return "{n}"
        if m := re.fullmatch(r"[0-9]+\.([A-Za-z0-9]{1,5})", x):
            return "{n}." + m[1]
        if re.fullmatch("[0-9a-fA-F-]{8,}", x) and re.search("[0-9]", x):
            return "{x}"
        return "{w}" if len(x) > 32 or re.search("[0-9]{3}", x) else x

    def g(b, m, b2, m2):
        if not m or not m2:
            return 0.0
        share = (b + b2) / (m + m2)
        pairs = [(b, m * share), (m - b, m * (1 - share)), (b2, m2 * share), (m2 - b2, m2 * (1 - share))]
        return 2 * sum(o * math.log(o / e) for o, e in pairs if o > 0)

    labels = lambda rows: (sum(r[2] is not None for r in rows), sum(r[2] == "block" for r in rows))
    out = {}

    def walk(rows, template, purity):
        """rows: (host, path, label, rest of the path)."""
        ended = [r for r in rows if not r[3] or len(rows) < least]
        for r in ended:
            out[r[0], r[1]] = (template + "".join("/" + x for x in r[3]), purity)
        going = [r for r in rows if r[3] and len(rows) >= least]
        kids = defaultdict(list)
        for r in going:
            kids[r[3][0]].append(r)
        plain = {k: v for k, v in kids.items() if not k.startswith("{")}
        many = len(plain) >= least and len(plain) > variety * sum(map(len, plain.values()))
        m_all, b_all = labels(going)
        named = defaultdict(list)
        for k, v in kids.items():
            m, b = labels(v)
            merged = len(plain) > 1 and g(b, m, b_all - b, m_all - m) < cut and (len(v) < least or m > 0)
            named[k if k.startswith("{") or not (many or merged) else "*"] += v
        for k, v in named.items():
            m, b = labels(v)
            walk([(*r[:3], r[3][1:]) for r in v], f"{template}/{k}", (b + prior * purity) / (m + prior))

    m, b = labels(urls)
    base = (b + 0.5) / (m + 1)
    for host in {u[0] for u in urls}:
        own = [(*u, [kind(x) for x in u[1].lstrip("/").split("/")]) for u in urls if u[0] == host]
        m, b = labels(own)
        walk(own, "", (b + prior * base) / (m + prior))
    return out


def test_url_templates(spark):
    rng = np.random.default_rng(8)
    rows = [(None, None), (1, ""), (2, "no url"), (3, "http://a.org/"), (4, "http://A.org"), (5, "x://y.net//a//b/")]
    for i in range(6, 900):
        host = ["shop.net", "a.org", "b.example.com", "example.org"][rng.integers(0, 4)]
        first = ["de", "fr", "es", "cat", "user"][rng.integers(0, 5)]
        rest = ["/".join(f"s{rng.integers(0, 4)}" for _ in range(rng.integers(0, 7))), str(rng.integers(0, 10**6)), f"name{rng.integers(0, 60)}x/page", "%x" % rng.integers(2**40, 2**44)][rng.integers(0, 4)]
        rows.append((i, f"http://{host}/{first}/{rest}?q=1"))
    rows += [(i, "http://shop.net/common") for i in range(900, 1000)]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, path string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    want = plain_templates([(r.host, r.path, r.verdict if r.rule else None) for r in got])
    for r in got:
        template, purity = want[r.host, r.path]
        assert r.template == template and abs(r.purity - purity) < 1e-9, (r, template, purity)
        if r.rule is None:
            assert r.verdict == ("block" if r.purity > 0.5 else "allow")
    assert len({r.purity for r in got if r.host == "b.example.com"}) > 2
    free = spark.createDataFrame([(i, f"http://shop.net/a/b/c/d/x{i}/evil") for i in range(4)], "page_id long, url string")
    assert {(r.verdict, r.template) for r in url_filter.judge(free).collect()} == {("allow", f"/a/b/c/d/x{i}/evil") for i in range(4)}
    assert url_filter.judge(df.where("page_id < 0")).count() == 0


def plain_of_order(order, train, texts):
    """Scores of any order by the definition: continuation counts below the highest length, by recursion over dictionaries."""
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    grams = lambda t: [tuple(([None] * (order - 1) + words(t))[k : k + order]) for k in range(len(words(t)))]
    counts = {order: Counter(g for t in train for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off = {n: kneser_ney.discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    cut = lambda n, c: (0.0, *off[n])[min(c, 3)]
    size = len(counts[1])
    by_context = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            by_context[n][g[:-1]].append(v)

    def p(gram):
        n = len(gram)
        lower = 1 / (size + 1) if n == 1 else p(gram[1:])
        if not (own := by_context[n].get(gram[:-1])):
            return lower
        c = counts[n][gram]
        return (max(0, c - cut(n, c)) + sum(cut(n, v) for v in own) * lower) / sum(own)

    return [sum(math.log10(p(g)) for g in grams(t)) for t in texts]


def test_language_model_of_any_order(spark, monkeypatch):
    """Orders 2 to 4 with many small sendings and shards; null, empty, unknown and repeated rows."""
    rng = np.random.default_rng(17)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 64)
    texts = [None, "", "new\twords  only", "w1 w2 w1 w2 w1", *(" ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(1, 60)) % 40) for _ in range(80))]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, keys string, shard int").repartition(5)
    train = df.where("doc_id <> 2").unionByName(df.where("doc_id = 5"))
    known = [t for i, t in enumerate(texts) if i != 2] + [texts[5]]
    for order in (2, 3, 4):
        model = kneser_ney.fit(train, order)
        assert model.order == order and len(model.vocabulary.starts) > 30
        rows = {r.doc_id: r.score for r in kneser_ney.score(df, model).collect()}
        for i, want in enumerate(plain_of_order(order, known, texts)):
            assert abs(rows[i] - want) < 1e-9 * max(1, abs(want)), (order, i)
    with pytest.raises(RuntimeError, match="not whole"):  # a model's lost files aren't empty ones
        longest = model.grams[-1]
        lost = kneser_ney.statistics(spark, f"{longest.top}/lost", len(longest.starts) - 1, True)
        kneser_ney.complete(lost, longest.starts, 0, model.vocabulary.total)
    none = kneser_ney.fit(df.where("doc_id < 0"), 3)
    assert {r.score for r in kneser_ney.score(df.where("doc_id = 3"), none).collect()} == {0.0}
    assert kneser_ney.score(df.where("doc_id < 0"), none).count() == 0
    assert kneser_ney.word_shard(np.array([-(1 << 63), -1, 0, (1 << 63) - 1]), 7).tolist() == [0, 3, 3, 6]
    keys = np.unique(rng.integers(0, 1 << 60, 5000))
    assert (kneser_ney.unpacked(kneser_ney.packed(keys)) == keys).all()


def test_language_model_has_few_files(spark, monkeypatch, tmp_path):
    """However many shards there are, the files of an array are bounded, and mapped ones keep no file open."""
    rng = np.random.default_rng(18)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 16)
    monkeypatch.setattr(kneser_ney, "FILES", 5, raising=False)
    texts = [None, *(" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(1, 60)) % 90) for _ in range(80)), "w1 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for order in (2, 3, 4):
        model = kneser_ney.fit(df, order)
        assert all(len(x.starts) <= 7 for x in (model.vocabulary, *model.grams))
        rows = {r.doc_id: r.score for r in kneser_ney.score(df, model).collect()}
        for i, want in enumerate(plain_of_order(order, texts, texts)):
            assert abs(rows[i] - want) < 1e-9 * max(1, abs(want)), (order, i)
    counts = rng.zipf(1.5, 1000).clip(max=300)
    kneser_ney.save_counts(f"file://{tmp_path}/counts2-00000", [kneser_ney.narrow(counts[:130]), kneser_ney.narrow(counts[130:])])
    one = kneser_ney.Grams(f"file://{tmp_path}", 2, 1, (0, 1000))
    lo = rng.integers(0, 1000, 300)
    hi = np.minimum(1000, lo + 1 + rng.integers(0, 400, 300))
    sums = kneser_ney.between(one.counts(0), one.blocks(0), lo, hi)
    assert one.counts(0).tolist() == counts.tolist()
    assert sums.T.tolist() == [[counts[a:b].sum(), (counts[a:b] == 1).sum(), (counts[a:b] == 2).sum()] for a, b in zip(lo, hi, strict=True)]
    for k in range(20):
        arrays.put(f"file://{tmp_path}/{k}", [np.full(3, k), np.arange(k)])
    before = len(os.listdir("/proc/self/fd"))
    assert all(arrays.mapped(f"file://{tmp_path}/{k}").view(np.int64).tolist() == [k, k, k, *range(k)] for k in range(20))
    assert len(os.listdir("/proc/self/fd")) <= before + 2
