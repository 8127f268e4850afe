"""Vector codes against a plain version and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from flowloom.llm import queries, vector_codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) for (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2]):
        first.setdefault(i, v)
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for k, members in own.items():
                book[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        found = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=repr)


@pytest.mark.parametrize(("entries", "width", "bits", "spread"), [(64, 4, 4, 100), (64, 1, 3, 5), (7, 3, 4, 2), (1, 2, 4, 9), (256, 2, 5, 1000)])
def test_filter_keeps_the_nearest(entries, width, bits, spread):
    rng = np.random.default_rng(entries)
    book, x = rng.integers(-spread, spread, (entries, width)), rng.integers(-2 * spread, 2 * spread, (500, width))
    x[:50] = book[rng.integers(0, entries, 50)]
    distance = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    entry, error = vector_codes.Filter(book, bits).nearest(x)
    assert entry.tolist() == distance.argmin(axis=1).tolist()
    assert error.tolist() == distance.min(axis=1).tolist()


def rows_of(seed, count, dims):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(count, dims)) * 2, 1)  # many ties
    x[20:40] = x[0]
    return [(int(i), v.tolist(), int(i) % 3 if i % 5 else None) for i, v in zip(rng.permutation(count), x, strict=True)]


def test_same_as_plain(spark):
    odd = [(-5, None, 1), (-4, [None] + [1.0] * 31, 1), (-3, [float("nan")] + [1.0] * 31, 1), (-2, [float("-inf")] + [1.0] * 31, 1), (-1, [], None)]
    rows = rows_of(1, 300, 32)
    rows += [(None, rows[3][1], 2), (None, [0.5] * 32, None), rows[7], (rows[9][0], [9.0] * 32, 0), *odd]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = vector_codes.encode(df.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>, label string"
    rows = [(2, [1.5, -2.25] * 16, "a"), (1, [0.0] * 32, None)]
    assert sorted(map(tuple, vector_codes.encode(spark.createDataFrame(rows, kind)).collect()), key=repr) == plain_codes(rows)
    assert vector_codes.encode(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.encode(spark.createDataFrame([(None, [1.0] * 16, "a")], kind)).count() == 0
    mixed = [(1, [1.0] * 16, "a"), (2, [1.0] * 32, "a"), (3, [1.0] * 17, "a"), (4, [2.0] * 16, "a")]
    assert sorted(r.vec_id for r in vector_codes.encode(spark.createDataFrame(mixed, kind)).collect()) == [1, 4]
    with pytest.raises(Exception, match="below"):
        vector_codes.encode(spark.createDataFrame([(1, [1e30] * 16, "a")], kind)).collect()


def test_query_same_as_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = queries.QUERIES["op12_vector_codes"](spark, data)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op12_vector_codes']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
