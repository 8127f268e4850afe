"""The pipeline's stages on a small table, against plain versions of what each must keep."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowloom.llm.queries import tokenizer


def words(r, n):
    return [r.choice(("tree", "river", "stone", "light", "cloud", "field", "house", "table", "green", "seven", "bread", "music", "paper", "winter", "garden", "yellow")) + str(r.randint(0, 99)) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, top = random.Random(5), tmp_path_factory.mktemp("pipeline")
    base = [words(r, 120) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w)) for i, w in enumerate(base[:5])]  # exact copies
    rows += [(200 + i, " ".join([*w[:60], "changed", *w[61:]])) for i, w in enumerate(base[5:10])]  # near ones
    rows += [(300, "write to some.body@mail.example.com or call +1 (807) 555-5623 today"), (301, None), (302, ""), (303, "  "), (None, "nobody's text"), (304, " ".join(words(r, 3000)))]
    spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, piece string, start int").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), rows


def test_rows_of_the_pipeline(spark, folder):
    top, rows = folder
    got = corpus_pipeline.run(spark, top).collect()
    gone = {*range(100, 105), *range(200, 205)}  # the copies with the greater ids
    want = {i: t for i, t in rows if i not in gone}
    want[300] = want[300].replace("some.body@mail.example.com", "[EMAIL]").replace("+1 (807) 555-5623", "[PHONE]")
    assert {r.doc_id for r in got} == set(want)
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for i, text in want.items():
        own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == i)
        total = sum(n for _, _, n in own)
        if i != 300:
            assert total == len(library.encode(text or "", add_special_tokens=False).ids) + 1
        assert [s for _, s, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048


def test_stages_keep_columns_and_redact(spark, folder):
    top, _ = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, top)
        assert docs.columns == ["doc_id", "text", "piece", "start"], name
    (text,) = [r.text for r in docs.where("doc_id = 300").collect()]
    assert "some.body" not in text and "555" not in text


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
