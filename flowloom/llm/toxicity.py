"""Toxicity by compression distance: windows of text compressed with a dictionary of toxic and with one of ordinary text.

zstandard trains both dictionaries apart: the ordinary one on windows of ordinary training texts, the toxic one on those
windows of toxic training texts that compress better with the dictionary trained on the other half's. A text's window gains
what it is shorter with the toxic dictionary before the ordinary one than with the ordinary one alone (most of a toxic text
is ordinary too); a calibrated logistic threshold on a text's gains decides.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import crc_fold, map_batches, whole_texts


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the two dictionaries, the words of a window, the least gain that counts, and the features' weights."""

    toxic: bytes
    ordinary: bytes
    window: int
    least: int
    weights: tuple[float, ...]


def windows(text: str, size: int) -> list[bytes]:
    """The whole text in lower case, ``size`` words at a time, with single white space."""
    w = text.lower().split()
    return [f" {' '.join(w[at : at + size])} ".encode() for at in range(0, len(w), size)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=21, hash_log=20, chain_log=20, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


class Scorer:
    """Scores texts with a model. Compressors can't be pickled, so each task makes its own."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.by_toxic, self.by_ordinary = compressor(model.toxic + model.ordinary), compressor(model.ordinary)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """How many bytes shorter each window is with the toxic dictionary."""
        a, b = self.by_ordinary.compress, self.by_toxic.compress
        return np.fromiter((len(a(w)) - len(b(w)) for w in parts), float, len(parts))

    def features(self, text: str) -> list[float]:
        """1, the largest gain, the three largest, the sum and number of those that count, the windows, the mean gain."""
        g = np.sort(self.gains(windows(text, self.model.window)))[::-1]
        if not len(g):
            return [1.0, *[0.0] * 6]
        some = g[g >= self.model.least]
        return [1.0, float(g[0]) / 10, float(g[:3].sum()) / 30, float(np.log1p(some.sum())), float(np.log1p(len(some))), float(np.log1p(len(g))), float(g.mean())]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(np.array([self.features(t) for t in texts]) @ np.array(self.model.weights))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of some windows; of too few for its training, the windows themselves."""
    samples = [w for w in samples if len(w) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[str], ordinary: list[str], window: int = 8, part: float = 0.5, size: int = 1 << 14, ordinary_size: int = 1 << 21, rounds: int = 3, share: float = 0.1, checked: int = 120_000, again: int = 3) -> tuple[bytes, bytes]:
    """Contents of both dictionaries, each trained by zstandard on windows of its own texts.

    The ordinary one is trained on a ``part`` of the ordinary texts' different windows, taken in random order. The toxic one is
    trained on the ``share`` of the toxic texts' windows with the greatest gains, where each half of the texts is measured
    with the dictionary of the other; this is repeated. Of ``checked`` other ordinary windows, those that gain all the same
    come ``again`` times to the ordinary one's, which is then trained anew.
    """
    plain = sorted({w for t in ordinary for w in windows(t, window)})
    random.Random(1).shuffle(plain)
    cut = -int(-len(plain) * part // 1)
    usual, others = trained(plain[:cut], ordinary_size), plain[cut : cut + checked]
    halves = [[w for t in toxic[h::2] for w in dict.fromkeys(windows(t, window))] for h in (0, 1)]
    chosen = halves
    for _ in range(rounds):
        known = [trained(c, size) for c in chosen]
        better = []
        for h in (0, 1):
            gain = Scorer(ToxicityModel(known[1 - h], usual, window, 0, ())).gains(halves[h])
            least = max(2.0, float(np.quantile(gain, 1 - share))) if len(gain) else 2.0
            better.append([w for w, x in zip(halves[h], gain, strict=True) if x >= least])
        if not all(better):
            break
        chosen = better
    marked = trained(chosen[0] + chosen[1], size)
    gain = Scorer(ToxicityModel(marked, usual, window, 0, ())).gains(others)
    return marked, trained(plain[:cut] + [w for w, x in zip(others, gain, strict=True) if x >= 2] * again, ordinary_size)


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; row i stands for ``counts[i]`` texts."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (counts * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (counts * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 1 << 15, folds: int = 5, window: int = 8, least: int = 4) -> ToxicityModel | None:
    """Trains on at most ``per_class`` labelled texts of each label and of at most ``longest`` bytes, outside the held-out fold.

    The sample is the rows with the smallest hashes of doc_id, one for each doc_id, so what reaches the driver is bounded by
    2 * per_class * longest bytes. A doc_id with several labels counts as toxic if any is; null labels don't count. The
    threshold (a score of 0.5) is calibrated on each half of the sample with dictionaries from the other half, where a text
    counts for as many as there are labelled ones for each sampled one of its label, so that the labels' true shares hold;
    the final dictionaries are from all of it. Null and empty texts have no windows. Without texts of both labels there is no
    model (None), and all texts get the score 0.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_fold("doc_id", folds) != 0)
    # two rows
    labelled = dict(marks.groupBy("toxic").count().where("toxic IN (0, 1)").collect())
    stands_for = {y: max(1.0, n / per_class) for y, n in labelled.items()}
    chosen = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (1, 0)]
    # at most 2 * per_class ids
    sample = whole_texts(docs).where(F.octet_length("text") <= longest).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(sample.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")).collect())
    texts = {y: [t for _, t, v, _ in rows if v == y] for y in (1, 0)}
    if not all(texts.values()):
        return None
    x, y = [], []
    for half in (0, 1):
        toxic, ordinary = train_dictionaries(*([t for _, t, v, h in rows if v == y and h != half] or texts[y] for y in (1, 0)), window)
        scorer = Scorer(ToxicityModel(toxic, ordinary, window, least, ()))
        own = [(t, v) for _, t, v, h in rows if h == half]
        x += [scorer.features(t) for t, _ in own]
        y += [float(v) for _, v in own]
    toxic, ordinary = train_dictionaries(texts[1], texts[0], window, 0.25)  # from as many ordinary windows as each half's, as gains depend on it
    return ToxicityModel(toxic, ordinary, window, least, tuple(logistic(np.array(x), np.array(y), np.array([stands_for[int(v)] for v in y])).tolist()))


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every whole text; null and empty texts are scored as empty.

    Repeated rows give repeated rows; other columns are left out. Windows cover the whole text.
    """

    def run(batches):
        scorer = Scorer(model) if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(texts) if scorer else np.zeros(len(texts)))], names=["doc_id", "score"])

    return map_batches(whole_texts(docs), run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, whole and with all their columns, whose score is below the threshold. No shuffle.

    Null texts are scored as empty ones; without a model all rows stay; an empty table gives an empty one.
    """
    if model is None:
        return docs
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores([t or "" for t in batch.column(at).to_pylist()]) < threshold))

    return map_batches(docs, run, schema)
