"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Characters' 1- to 3-grams are hashed into a fixed number of buckets. Document frequencies are counted over
all training documents. The weights are fitted on a bounded sample (see SAMPLE) with the proximal
follow-the-regularised-leader rule and an elastic net, and the scores are calibrated by one temperature on a
fifth of that sample which the weights have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let_go, tidied

BITS = 15
#: The classifier is fitted on at most about SAMPLE documents, and on about PER_LANG of each language.
SAMPLE, PER_LANG = 4000, 600
#: It learns the so many most frequent values of lang.
LANGUAGES = 500
EPOCHS, ALPHA, BETA = 4, 0.5, 1.0
#: Elastic net, per example: with this L1 about one in ten weights of the seen buckets stays, at the same held-out
#: accuracy.
L1, L2 = 5e-4, 5e-5
#: Buckets are summed in this many slices, so that no task meets all of a large corpus's partial sums.
SLICES = 32
#: A bucket's count in a text is cut here, in training and in prediction alike.
MOST = 65_535
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Characters below 128 that are no letters become a blank.
_BLANK = {c: " " for c in range(128) if not chr(c).isalpha()}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's character n-grams and how often each occurs."""
    c = np.frombuffer(f" {text.translate(_BLANK).lower()} ".encode("utf-32-le"), np.uint32)
    one = (c + np.uint32(1)) * _K[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _K[1] + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _K[2] + one[2:]
    grams = np.concatenate([one, two, three])
    counts = np.bincount(((grams ^ (grams >> np.uint32(16))) * _K[1]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, np.minimum(counts[at], MOST)


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    let_go()
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            part = whole.slice(k, 500)
            yield part, part.column(column).to_pylist()


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every bucket, over all docs that have a letter."""
    size = (1 << BITS) // SLICES

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for _, texts in _texts(batches, 0):
            for text in filter(has_letter, texts):
                df[features(text)[0]] += 1
                n += 1
        blobs = [df[k * size : (k + 1) * size].tobytes() for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n] + [0] * (SLICES - 1), pa.int64())], ["slice", "blob", "n"])

    @tidied
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for k, blob, n in zip(*(c.to_pylist() for c in batch.columns)):
                df, m = sums.get(k, (0, 0))
                sums[k] = (df + np.frombuffer(blob, np.int64), m + n)
        for k, (df, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["slice", "blob", "n"])

    schema = "slice int, blob binary, n long"
    rows = docs.select("text").mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()  # SLICES rows
    df, n = np.zeros(1 << BITS, np.int64), sum(r["n"] for r in rows)
    for r in rows:
        df[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["blob"], np.int64)
    return np.log((n + 1) / (df + 1)) + 1.0


def sample(docs: DataFrame, per_lang: int = PER_LANG, at_most: int = SAMPLE, languages: int = LANGUAGES) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of about per_lang labelled documents of each of the most frequent languages, picked
    by a hash of id and text, in an order that does not depend on how the table is split."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("of_lang")).orderBy(F.desc("of_lang"), "lang").limit(languages)
    known = sizes.count()
    if not known:
        return []
    each = max(1, min(per_lang, at_most // known))
    pick = F.abs(F.xxhash64("doc_id", "text") % 1_000_003) / 1_000_003
    docs = docs.join(F.broadcast(sizes), "lang").filter(pick < F.lit(each) / F.col("of_lang"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 0):
            pairs = [features(t) if has_letter(t) else (np.empty(0, np.int64), np.empty(0, np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array([a.astype(np.uint16).tobytes() for a, _ in pairs], pa.binary()), pa.array([n.astype(np.uint16).tobytes() for _, n in pairs], pa.binary())],
                ["lang", "at", "n"],
            )

    chosen = docs.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect()
    rows = sorted(((zlib.crc32(r["at"] + r["n"]), r["lang"], bytes(r["at"]), bytes(r["n"])) for r in chosen if r["at"]))
    return [(lang, np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(n, np.uint16).astype(np.int64)) for _, lang, a, n in rows]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Proximal follow-the-regularised-leader for a linear softmax model; the last row is the bias."""

    def __init__(self, rows: int, labels: int, examples: int = 1):
        self.z, self.n = np.zeros((rows + 1, labels)), np.zeros((rows + 1, labels))
        self.l1, self.l2 = L1 * examples, L2 * examples

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass
class Model:
    """Labels, weights (a row per bucket and the bias), temperature; and on the calibration documents, which no
    weight was learned from, their number, log loss and calibration error."""

    labels: list[str]
    weights: np.ndarray
    temperature: float = 1.0
    aside: int = 0
    loss: float = float("nan")
    error: float = float("nan")

    @property
    def kept(self) -> float:
        """Share of the buckets with any weight that keep one that is not zero."""
        return float((self.weights[:-1] != 0).mean()) if self.weights[:-1].size else 0.0


def calibration_error(p: np.ndarray, truth: np.ndarray, bins: int = 10) -> float:
    """Mean gap between confidence and accuracy over bins of confidence."""
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    where = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[where == b].mean() - right[where == b].mean()) * (where == b).mean() for b in range(bins) if (where == b).any()))


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Copies of a text go to one side of the split, so calibration documents are unseen ones. The temperature is
    that of the least log loss, with targets smoothed by one document more and one label more, as few errors
    would else push it to zero."""
    labels = sorted({lang for lang, _, _ in examples})
    bias = len(idf)
    vectors = [(labels.index(lang), np.append(at, bias), np.append(weighted(at, n, idf), 1.0)) for lang, at, n in examples]
    side = [zlib.crc32(at.tobytes() + n.tobytes(), 7) % 5 == 0 for _, at, n in examples]
    aside, used = [v for v, a in zip(vectors, side) if a], [v for v, a in zip(vectors, side) if not a]
    used = used or aside
    model = Ftrl(len(idf), len(labels), len(used))
    for _ in range(EPOCHS):
        for label, at, x in used:
            model.learn(at, x, label)
    made = Model(labels, model.weights())
    if aside and len(labels) > 1:
        scores, truth = np.array([x @ made.weights[at] for _, at, x in aside]), np.array([label for label, _, _ in aside])
        target = np.full(scores.shape, 1.0 / (len(aside) + len(labels)))
        target[np.arange(len(truth)), truth] += len(aside) / (len(aside) + len(labels))
        loss = lambda t: -(target * np.log(softmax(scores / t) + 1e-300)).sum(axis=1).mean()
        made.temperature = float(min(np.exp(np.linspace(np.log(1e-3), np.log(1e2), 231)), key=loss))
        p = softmax(scores / made.temperature)
        made.aside, made.error = len(aside), calibration_error(p, truth)
        made.loss = float(-np.log(p[np.arange(len(truth)), truth] + 1e-300).mean())
    return made


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with lang_pred and lang_score; training has text, lang and doc_id, and only it is learned from.

    lang_pred is a language of the training documents, or `und` with score 0 if the text is null or has no
    letter, or if nothing could be learned. lang_score is the calibrated probability. Training rows without
    a language are left out. All columns pass through (lang_pred and lang_score are replaced); rows are
    judged one by one, so repeated rows and ids don't matter; whole texts are read, however long.
    """
    labelled = training.filter("lang IS NOT NULL").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    idf = inverse_frequencies(labelled)
    examples = sample(labelled)
    model = fit(examples, idf) if examples else Model([], np.zeros((1, 0)))
    labels, weights, temperature = model.labels, model.weights.astype(np.float32), model.temperature
    passed = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    place = passed.index("text")
    frame = docs.select(*[F.col(f"`{c}`") for c in passed])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, place):
            names, scores = [], []
            for text in texts:
                name, score = "und", 0.0
                if labels and has_letter(text):
                    at, n = features(text)
                    p = softmax((weighted(at, n, idf) @ weights[at] + weights[-1]) / temperature)
                    k = int(np.argmax(p))
                    name, score = labels[k], min(1.0, float(p[k]))
                names.append(name), scores.append(score)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    out = StructType(list(frame.schema.fields)).add("lang_pred", "string", False).add("lang_score", "double", False)
    return frame.mapInArrow(run, out)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves `fold`; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is told with at least that probability; lang becomes the language told.

    The labels of the documents themselves (folds that aren't held out) train the model.
    """
    told = identify(docs, docs.filter(~held_out())).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= least))
    return told.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
