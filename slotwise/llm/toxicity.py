"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6 of the lower-cased word between spaces),
hashed into a table of embeddings; a stretch of words is the average of its words, and a linear
softmax over that average gives the two classes. Table and softmax are learned together. A
misspelling that was never seen still shares most n-grams with its word.

A long document with two insults averages to nearly nothing, so the average runs over stretches of
``SPAN`` words that cover the whole text and overlap, and a document counts as toxic as its
worst stretch: training takes the gradient there, and the score is read there.

Since everything up to the softmax is linear, a trained model folds into one weight per n-gram
bucket, and scoring is a sum over the text's n-grams in numpy.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, whole_text

BUCKETS = 1 << 18
#: Words of a stretch, and from one stretch to the next.
SPAN, STEP = 3, 1
#: Labelled rows of each class that the model is fitted on, at most (the bounded sample of training).
SAMPLE_PER_CLASS = 1500
_SIZES = (3, 4, 5, 6)
#: Documents of each class that an n-gram's log-odds are shrunk by.
PRIOR = 4.0
#: Texts scored at a time, in characters.
_TOGETHER = 200_000


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), dtype="<u4")


def _grams(lowered: str):
    """(first character of each word, for each size the positions and buckets of its n-grams, code points) of lower-cased text.

    Places and code points count one space before the text and one after it. An n-gram may begin or end
    with the space around its word but holds none inside.
    """
    points = _code_points(" " + lowered + " ")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(space, np.uint32(32), points)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    # The next space after each position, itself left out.
    places = np.flatnonzero(space)
    after = places[np.minimum(np.cumsum(space), len(places) - 1)]
    grams, hashes = [], points + np.uint32(1)
    for n in range(2, max(_SIZES) + 1):
        if len(hashes) < 2:
            break
        hashes = hashes[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
        if n in _SIZES:
            at = np.flatnonzero(after[: len(hashes)] >= np.arange(n - 1, len(hashes) + n - 1))
            grams.append((at, ((hashes[at] * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32)))
    return starts, grams, len(points)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket of each n-gram, number of its word, count of words) of a whole text."""
    starts, grams, _ = _grams(text.lower())
    if not len(starts):
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32), 0
    at = np.concatenate([g[0] for g in grams])
    owners = np.searchsorted(starts, at + 1, side="right").astype(np.int32) - np.int32(1)
    return np.concatenate([g[1] for g in grams]), owners, len(starts)


def _word_values(weights: np.ndarray, lowered: str) -> tuple[np.ndarray, np.ndarray]:
    """Each word's mean weight over its n-grams, and the place of its first character."""
    starts, grams, points = _grams(lowered)
    if not len(starts):
        return np.zeros(0), starts
    sums, counts = np.zeros(points), np.zeros(points)
    for at, buckets in grams:
        sums[at] += weights[buckets]  # a size has one n-gram at a place
        counts[at] += 1
    # A word's n-grams begin between the space before it and its last character.
    return np.add.reduceat(sums, starts - 1) / np.maximum(np.add.reduceat(counts, starts - 1), 1), starts


def _stretches(words: int) -> np.ndarray:
    """First words of the stretches of a text; they cover it whole."""
    return np.arange(0, max(1, words - STEP), STEP)


def stretch_logits(values: np.ndarray, bias: float) -> np.ndarray:
    """Logit of every stretch from its words' values."""
    if not len(values):
        return np.array([bias])
    sums = np.concatenate([[0.0], np.cumsum(values)])
    first = _stretches(len(values))
    last = np.minimum(first + SPAN, len(values))
    # A short text is averaged as if filled up with neutral words.
    return (sums[last] - sums[first]) / SPAN + bias


@dataclass
class Model:
    """Weight of each n-gram bucket (embedding table times softmax difference) and the bias."""

    weights: np.ndarray
    bias: float

    def score_all(self, texts: list[str]) -> np.ndarray:
        # Words of many texts at once, with a space between two texts; a word is its text's by its place.
        lowered = [t.lower() for t in texts]
        values, starts = _word_values(self.weights, " ".join(lowered))
        ends = np.searchsorted(starts, 1 + np.cumsum([len(t) + 1 for t in lowered])).tolist()
        logits = np.array([stretch_logits(values[a:b], self.bias).max() for a, b in zip([0, *ends[:-1]], ends)])
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))

    def score(self, text: str) -> float:
        return float(self.score_all([text])[0])


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 7) -> Model:
    """Fit embeddings and softmax together by stochastic gradient descent over the texts.

    Each step takes one stretch of a text with the text's label: the worst one, which is also what
    the score reads. In the first passes the log-odds of the n-grams tell which one that is, later
    the model itself. Of a clean text a second, random stretch is taken. Without both classes the
    model is neutral and scores every text by the one class it knows.
    """
    truth = np.array(labels, dtype=np.int64)
    if not len(texts) or truth.min() == truth.max():
        known = -4.0 if not len(texts) or truth[0] == 0 else 4.0
        return Model(np.zeros(BUCKETS, dtype=np.float32), known)
    rng = np.random.default_rng(seed)
    head = rng.normal(0, 0.5, (2, dim)).astype(np.float32)  # softmax rows of clean and toxic
    bias = np.array([1.0, -1.0], dtype=np.float32)
    bags = [subwords(t) for t in texts]
    seen = np.zeros((2, BUCKETS))
    for (buckets, _, _), label in zip(bags, labels, strict=True):
        seen[label, np.unique(buckets)] += 1
    sizes = np.bincount(truth, minlength=2).astype(float)
    # Shrunk as if each n-gram had been in PRIOR toxic documents and in clean ones at the same rate.
    share = (seen + PRIOR * (sizes / sizes[1])[:, None]) / (sizes * (1 + 2 * PRIOR / sizes[1]))[:, None]
    odds = np.log(share[1] / share[0])
    # Embeddings begin at their log-odds along the softmax's difference, which is one start of many
    # for the joint descent.
    way = head[1] - head[0]
    table = rng.normal(0, 0.02, (BUCKETS, dim)).astype(np.float32)
    table += (odds[:, None] * way / (way @ way)).astype(np.float32)

    def step(bag, first: int, label: int, speed: float) -> None:
        nonlocal head, bias
        buckets, owners, words = bag
        last = min(first + SPAN, words)
        inside = np.flatnonzero((owners >= first) & (owners < last))
        ids, own = buckets[inside], owners[inside] - first
        part = (1.0 / np.bincount(own, minlength=last - first)[own] / SPAN).astype(np.float32)[:, None]
        mean = (table[ids] * part).sum(0)
        z = np.clip(head @ mean + bias, -30, 30)
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1.0
        back = p @ head
        head = np.clip(head - (0.1 * speed) * np.outer(p, mean).astype(np.float32), -3, 3)
        bias = bias - np.float32(0.1 * speed) * p
        # The steps of an average are small; they are scaled to those of one word.
        np.subtract.at(table, ids, (speed * SPAN * SPAN) * part * back[None, :])

    # The rarer class is passed over as often again as it is rarer, up to four times.
    rare = int(sizes[1] < sizes[0])
    extra = min(3, int(sizes[1 - rare] / sizes[rare]) - 1)
    turns = np.concatenate([np.arange(len(texts)), *[np.flatnonzero(truth == rare)] * extra])
    for epoch in range(epochs):
        speed = rate * (1 - epoch / epochs)
        folded, offset = (odds if epoch < 2 else table @ (head[1] - head[0])), float(bias[1] - bias[0])
        for i in rng.permutation(turns):
            buckets, owners, words = bags[i]
            if not words:
                continue
            counts = np.maximum(np.bincount(owners, minlength=words), 1)
            values = np.bincount(owners, weights=folded[buckets], minlength=words) / counts
            worst = stretch_logits(values, offset).argmax()
            step(bags[i], int(_stretches(words)[worst]), int(truth[i]), speed)
            if not truth[i]:
                step(bags[i], int(rng.choice(_stretches(words))), 0, speed)
    return Model((table @ (head[1] - head[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_: Column) -> Column:
    """Whether a row's label is never learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, chosen by a hash of their ids.

    One task learns from this sample; the driver sees the folded model only, a megabyte.

    Held-out rows, rows without id or label and labels other than 0 and 1 are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    picked = None
    for label in (0, 1):
        own = known.filter(F.col("label") == label).dropDuplicates(["id"])
        own = own.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    # At most 2 * per_class ids, so this side may be sent to every task.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    sample = rows.join(F.broadcast(picked), "id").select("id", "label", "text").dropDuplicates(["id"])

    def learn(stream):
        """All of the bounded sample in one task; in order of ids, so that a task that runs again learns the same."""
        got = sorted(stream)
        model = train([r[2] for r in got], [r[1] for r in got])
        yield model.weights.astype("<f4").tobytes(), model.bias

    learned = mapped(sample.repartition(1), "weights binary, bias double", learn).first()
    if learned is None:  # no partition at all
        return train([], [])
    return Model(np.frombuffer(bytes(learned.weights), dtype="<f4"), learned.bias)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1, higher is likelier toxic), of the whole text.

    Null texts count as empty and get the score of a text without words. Repeated rows each get
    their score, null ids are kept, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream):
        own, ids, texts, size = shared.value, [], [], 0
        for id_, text in stream:
            ids.append(id_)
            texts.append(text)
            size += len(text)
            if size > _TOGETHER:
                yield from zip(ids, own.score_all(texts).tolist(), strict=True)
                ids, texts, size = [], [], 0
        if ids:
            yield from zip(ids, own.score_all(texts).tolist(), strict=True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return mapped(rows, "id long, score double", run)


def crc_remainder(id_: int) -> int:
    return zlib.crc32(str(id_).encode()) % 3
