"""Toxicity: a counterfactual-regularised linear classifier over the distinct words of a text and their beginnings.

Training rows are a bounded, hash-chosen sample of labelled rows. Words that tell the classes apart are found by a
distributed count; identity terms are always features. Each sampled text that names an identity is also read with the
term swapped for each other term of its group and with none; all features, beginnings included, are those of the swapped
text, and the squared change of the score is penalised, so that naming a group does not move the score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import binary_list, crc_of_id, cut, slices, table

#: Labelled rows of each class to train on, and words that may be features besides identity terms.
SAMPLE, FEATURES = 4_000, 1_024
#: Weight of the mean squared change of the score under swaps, against that of the mean log loss.
FAIR = 20.0
#: Log-likelihood ratio from which a word tells the classes apart; chance reaches it for one word in 100,000.
STRENGTH = 20.0
#: Groups of terms that stand for each other when swapped.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
WORD = re.compile(rb"[a-z\x80-\xff]+")


def plain_words(text: bytes) -> set[bytes]:
    """Distinct runs of letters and non-ASCII bytes of the whole text, A-Z lower-cased."""
    out: set[bytes] = set()
    for part in slices(text):
        out.update(WORD.findall(part.lower()))
    return out


def beginnings(plain: set[bytes]) -> set[bytes]:
    """The first 4 to 7 bytes of the words longer than three, written with a hyphen."""
    starts, out = {w[:7] for w in plain if len(w) > 3}, set()
    for n in (7, 6, 5, 4):
        starts = {w[:n] for w in starts}
        out.update([w + b"-" for w in starts if len(w) == n])
    return out


def words(text: bytes) -> set[bytes]:
    """The features of a text: its words and their beginnings."""
    plain = plain_words(text)
    return plain | beginnings(plain)


def objective(w: np.ndarray, x: np.ndarray, y: np.ndarray, swaps: np.ndarray, times: np.ndarray, l2: float, fair: float) -> float:
    """What fit minimises, for weights with the bias last."""
    n, k = x.shape
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    raw = x @ w[:k] + w[k]
    loss = float((share * (np.logaddexp(0, raw) - y * raw)).sum())
    moved = float((times * (swaps @ w[:k]) ** 2).sum() / times.sum()) if len(swaps) else 0.0
    return loss + l2 * float(w[:k] @ w[:k]) / 2 + 1e-9 * float(w[k] ** 2) / 2 + fair * moved / 2


def fit(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, times: np.ndarray, l2: float = 0.0002, fair: float = FAIR, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on log loss, each class weighing one half, + l2 |w|^2 / 2 + fair * mean (w . swap)^2 / 2.

    x: rows of 0/1 features; y: 0 or 1; swaps: the distinct rows x - x' of the counterfactuals, each met times times. One
    class alone gives its own share as a constant.
    """
    n, k = x.shape
    if not n or y.min() == y.max():
        return np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    z = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    penalty = np.eye(k + 1) * l2
    penalty[k, k] = 1e-9
    for at in range(0, len(swaps), 1024):  # k x k numbers, however many swaps there are
        part = swaps[at : at + 1024].astype(np.float64)
        penalty[:k, :k] += fair / times.sum() * (part.T @ (part * times[at : at + 1024, None]))
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ ((p - y) * share) + penalty @ w
        curve = (z * (np.maximum(p * (1 - p), 1e-6) * share)[:, None]).T @ z + penalty
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:k], float(w[k])


def counterfactuals(plain: set[bytes], index: dict[bytes, int], groups=IDENTITIES):
    """For each identity term of a text's words, swapped for each other term of its group and left out: what the swap takes away (1 + feature) and what it brings (minus that)."""
    known = (plain | beginnings(plain)).intersection(index)
    for group in groups:
        terms = [t.encode() for t in group]
        for a in plain.intersection(terms):
            rest = plain - {a}
            starts = beginnings(rest)
            for b in [*terms, None]:
                if b != a and b not in plain:
                    swapped = (rest | starts | ({b} | beginnings({b}) if b else set())).intersection(index)
                    yield sorted([index[w] + 1 for w in known - swapped] + [-1 - index[w] for w in swapped - known])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, groups=IDENTITIES) -> tuple[dict[bytes, float], float]:
    """Weights of words and the bias, from the sample rows of each class with the least hashes of doc_id (columns doc_id, text; doc_id, toxic)."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # two rows of 12 bytes for each of the sample at most
    texts = cut(docs.join(picked, "doc_id").select("toxic", "text"), "sample")  # read four times below

    def word_counts(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            labels_of, found = batch.column(0).to_pylist(), [words(t or b"") for t in binary_list(batch.column(1))]
            tally = [Counter(w for y, ws in zip(labels_of, found) if y == c for w in ws) for c in (1, 0)]
            names = list({**tally[0], **tally[1]})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([t[w] for w in names], pa.int64()) for t in tally)], ["word", "p", "n"])

    counts = texts.mapInArrow(word_counts, "word binary, p long, n long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p + n >= 5")
    sizes = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos + neg:
        return {}, -2.0
    all_, seen = float(pos + neg), F.col("p") + F.col("n")
    cells = [(F.col("p"), seen * pos / all_), (F.col("n"), seen * neg / all_), (pos - F.col("p"), (all_ - seen) * pos / all_), (neg - F.col("n"), (all_ - seen) * neg / all_)]
    strength = 2 * sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))  # log-likelihood ratio
    best = counts.where(strength >= STRENGTH).orderBy(strength.desc(), "word").limit(features).select("word").collect()  # features rows at most
    names = list(dict.fromkeys([*(bytes(r[0]) for r in best), *(t.encode() for g in groups for t in g)]))
    index = {w: i for i, w in enumerate(names)}

    def rows_of(batches):
        import pyarrow as pa

        for batch in batches:
            plain = [plain_words(t or b"") for t in binary_list(batch.column(1))]
            found = [sorted(index[w] for w in (p | beginnings(p)).intersection(index)) for p in plain]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "features"])

    def swaps_of(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c for t in binary_list(batch.column(1)) for c in counterfactuals(plain_words(t or b""), index, groups)], pa.list_(pa.int32()))], ["swap"])

    rows = texts.mapInArrow(rows_of, "toxic int, features array<int>").collect()  # the sample at most
    rows.sort(key=lambda r: (r[0], r[1]))
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r[1]] = 1
    # distinct swaps: pairs of terms of one group, and which of the beginnings the rest of a text has; not a row for each text
    changes = texts.mapInArrow(swaps_of, "swap array<int>").groupBy("swap").count().orderBy("swap").collect()
    swaps, times = np.zeros((len(changes), len(names)), np.int8), np.array([c[1] for c in changes], float)
    for i, c in enumerate(changes):
        ids = np.array(c[0], np.int64)
        swaps[i, np.abs(ids) - 1] = np.sign(ids)
    w, bias = fit(x, np.array([r[0] for r in rows], float), swaps, times)
    return dict(zip(names, w.tolist())), bias


def scores(docs: DataFrame, weights: dict[bytes, float], bias: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row from its whole text; null and empty texts get the bias alone."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import math

        import pyarrow as pa

        for batch in batches:
            raw = [bias + math.fsum(map(weights.__getitem__, words(t or b"").intersection(weights))) for t in binary_list(batch.column(1))]
            p = [1 / (1 + math.exp(-max(-40.0, min(40.0, s)))) for s in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([int(s >= 0.7) for s in p], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_of_id() % 3 != 1)
    scored = scores(docs, *train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
