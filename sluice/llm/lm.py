"""Word n-gram language model in an Elias-Fano trie.

Level 1 holds every training token's hash and count; level k holds, for every node of level k - 1 as
context, its back-off weight and its successors: monotone pointers into one sequence of successor ids made
monotone by adding the last value of the context before, and one byte of quantised log probability each. A
successor's place is its node for level k + 1. Words are numbered by hash, and every level is dealt to shards by
ranges of (context, word): a frequent word's successors are split over several shards, other contexts are whole.
A shard is one flat file that workers map into memory. A query
finds the word by successor search in level 1, then each next word among the context's successors by
successor search relative to the context.

Probabilities: p(w) = (c + 1) / (N + V + 1), the contract's base; p(w | v) = max(c(vw) - D, 0) / c(v) +
b(v) p(w), and p(w | uv) from p(w | v) likewise up to the model's order. Contexts start at the end before the
text, so its first word has one word of context. b(v) is what discounting (and pruning, if min_bigram asks for
it) leaves. By default every n-gram is kept.

Texts are tokenised twice: once to count words, once to number them. The numbers are written, and all further
levels and the scores are made from them.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, held, tidied
from .elias_fano import EliasFano, from_buffer, to_bytes

END = np.uint64(xxhash.xxh3_64_intdigest(b""))
DISCOUNT, MIN_BIGRAM, ORDER = 0.5, 1, 2
#: Two bytes hold a log10 probability of 0 to -20 in equal steps, so counts up to 10 ** 20 keep their place.
QUANTA = 20.0 / 65_535
#: A word that has more than its shard's share by HOT_IN_SHARD, and than all shards' mean by SPLIT, has its successors
#: split by ranges, each of about 1 / SPLIT of a shard.
HOT_IN_SHARD, SPLIT = 8, 2
#: The least back-off weight.
LEAST = 1e-8
#: Tokens a counting task holds before it sends on what it has counted.
FLUSH = 6_000_000
_VALUES = 10.0 ** (np.arange(65_536) * -QUANTA)
_U = np.uint64


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) / QUANTA), 0, 65_535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text followed by its end; and the texts' token counts."""
    words = [t.lower().split() if t else [] for t in texts]
    for w in words:
        w.append(b"")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum())), sizes


def _slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            part = whole.slice(at, rows)
            yield part, part.column(column).cast(pa.binary()).to_pylist()


def _counted(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    if counts is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return to_bytes({**EliasFano.encode(keys).arrays("k"), "c": _small(counts)})


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [from_buffer(b) for b in blobs]
    return _counted([EliasFano.of(p, "k").decode() for p in parts], [p["c"].astype(np.int64) for p in parts])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blobs.setdefault(bucket, []).append(blob)
    return blobs


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name of its own; a task that is run again leaves the first file unused."""
    fs, base = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    file = f"{name}-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(f"{base}/{file}") as out:
        out.write(data)
    return f"{folder}/{file}"


def _mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory mapped; a file of a remote store is first copied to an unnamed one."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        with open(path, "rb") as f:
            return from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as source:
        while data := source.read(1 << 24):
            f.write(data)
        f.flush()
        return from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Words:
    """Level 1: finds tokens among the shards, which divide the range of hashes evenly."""

    def __init__(self, files: list[str], first: list[int]):
        self.shards = [_mapped(f) if f else None for f in files]
        self.first = np.array(first, np.int64)
        self.hashes = [EliasFano.of(s, "hash") if s else None for s in self.shards]

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each; the hashes are in ascending order."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        at = np.searchsorted(_bucket(sorted_hashes, len(self.shards)), np.arange(len(self.shards) + 1))
        for b, (s, e) in enumerate(zip(at, at[1:])):
            if e > s and self.shards[b]:
                i = self.hashes[b].find(sorted_hashes[s:e])
                known = np.flatnonzero(i >= 0)
                ids[s + known] = i[known] + self.first[b]
                counts[s + known] = self.shards[b]["count"][i[known]]
        return ids, counts


    def counts(self, sorted_ids: np.ndarray) -> np.ndarray:
        """Counts of ids in ascending order; an id beyond the last is unknown."""
        counts, at = np.zeros(len(sorted_ids), np.int64), np.searchsorted(sorted_ids, self.first)
        for b, (s, e) in enumerate(zip(at, at[1:])):
            if e > s:
                counts[s:e] = self.shards[b]["count"][sorted_ids[s:e] - self.first[b]]
        return counts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash's share of the whole range; ascending with the hash."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


class Trie(Words):
    """All levels."""

    def __init__(self, model: dict):
        super().__init__(model["words"], model["nodes"][0])
        self.model, self.vocabulary = model, model["nodes"][0][-1]
        self.nodes = [np.array(n, np.int64) for n in model["nodes"]]
        self.levels = [[_mapped(f) if f else None for f in files] for files in model["levels"]]
        self.bounds = [np.array(b, np.uint64) for b in model["bounds"]]
        self.split = [(np.array(s["contexts"], np.int64), np.array(s["weights"])) for s in model["split"]]
        self.pointers = [[EliasFano.of(s, "pointer") if s else None for s in level] for level in self.levels]
        self.successors = [[EliasFano.of(s, "successor") if s else None for s in level] for level in self.levels]

    @staticmethod
    def of(model: dict) -> Trie:
        """This process's trie of the model."""
        return held("trie", json.dumps(model), lambda: Trie(model))

    def _look(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(discounted probability, back-off weight, node or -1) of successors in the k-th level of contexts, ordered by context and word."""
        direct, weight, node = np.zeros(len(word)), np.ones(len(word)), np.full(len(word), -1, np.int64)
        bounds, vocabulary = self.bounds[k], _U(self.vocabulary)
        key = context.astype(np.uint64) * vocabulary + np.maximum(word, 0).astype(np.uint64)
        at = np.searchsorted(key, bounds)
        for b, (s, e) in enumerate(zip(at, at[1:])):
            if e > s and (level := self.levels[k][b]):
                local = context[s:e] - int(bounds[b] // vocabulary)
                weight[s:e] = dequantise(level["weight"][local])
                start, end = (self.pointers[k][b].get(local + i).astype(np.int64) for i in (0, 1))
                some = np.flatnonzero((end > start) & (word[s:e] >= 0))
                start, end = start[some], end[some]
                base = np.where(start > 0, self.successors[k][b].get(np.maximum(start - 1, 0)), _U(0)) if len(some) else np.empty(0, np.uint64)
                i = self.successors[k][b].find(base + word[s:e][some].astype(np.uint64), start, end)
                hit = np.flatnonzero(i >= 0)
                direct[s + some[hit]] = dequantise(level["probability"][i[hit]])
                if k + 1 < len(self.nodes):
                    node[s + some[hit]] = i[hit] + self.nodes[k + 1][b]
        split, whole = self.split[k]
        if len(split):  # shards know only their part of these
            i = np.minimum(np.searchsorted(split, context), len(split) - 1)
            weight = np.where(split[i] == context, whole[i], weight)
        return direct, weight, node

    def follow(self, k: int, context: np.ndarray, word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places with a known context, their discounted probability, their back-off weight, contexts of the next level)."""
        at = np.flatnonzero(context >= 0)
        key = context[at].astype(np.uint64) * _U(self.vocabulary + 1) + (word[at] + 1).astype(np.uint64)
        distinct, again = np.unique(key, return_inverse=True)
        last = (distinct % _U(self.vocabulary + 1)).astype(np.int64) - 1  # -1: an unknown word; the back-off weight still counts
        direct, weight, node = self._look(k, (distinct // _U(self.vocabulary + 1)).astype(np.int64), last)
        after = np.full(len(word) + 1, -1, np.int64)
        after[at + 1] = node[again]
        after[starts] = -1
        return at, direct[again], weight[again], after[:-1]

    @staticmethod
    def first_contexts(word: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        context = np.concatenate([[-1], word[:-1]])
        context[starts] = end
        return context


def _words_of(model: dict) -> Words:
    """This process's level 1 of the model."""
    return held("words", json.dumps(model["words"]), lambda: Words(model["words"], model["nodes"][0]))


def numbered(docs: DataFrame, model: dict, passed: tuple[str, ...] = ()) -> DataFrame:
    """(passed columns, ids) of docs: each token's number as four bytes (eight beyond 2 ** 32 words), the end's
    last; a token that training did not see has the number of words there are."""
    vocabulary = model["nodes"][0][-1]
    kind = _id_type(vocabulary)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(model)
        for part, texts in _slices(batches, 0):
            hashes, sizes = token_hashes(texts)
            distinct, back = np.unique(hashes, return_inverse=True)
            ids, _ = words.find(distinct)
            data = np.where(ids < 0, vocabulary, ids).astype(kind)[back].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)]) * kind.itemsize
            if ends[-1] < 2**31:
                blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
            else:
                blobs = pa.array([data[x:y] for x, y in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], blobs], [*part.schema.names[1:], "ids"])

    frame = docs.select(F.col("text").cast("string").alias("text"), *passed)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[1:]), "ids binary"])
    return frame.mapInArrow(run, fields)


def _id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u4" if vocabulary < 2**32 - 1 else "<u8")


def _numbers(batches: Iterator[pa.RecordBatch], column: int, kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, all their token numbers, tokens of each row)."""
    for part, blobs in _slices(batches, column):
        yield part, np.frombuffer(b"".join(blobs), kind).astype(np.int64), np.fromiter(map(len, blobs), np.int64, len(blobs)) // kind.itemsize


def count_words(docs: DataFrame, folder: str) -> dict:
    """A model of level 1 alone: the tokens of docs.text, numbered by hash, and their counts."""
    spark, parts = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, parts // 2)
    text = docs.select(F.col("text").cast("string").alias("text"))

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(keys: list[np.ndarray]) -> pa.RecordBatch:
            key, n = _counted(keys)
            at = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
            return _rows([(b, _blob(key[s:e], n[s:e])) for b, (s, e) in enumerate(zip(at, at[1:])) if e > s])

        waiting: list[np.ndarray] = []
        for _, texts in _slices(batches, 0):
            waiting.append(token_hashes(texts)[0])
            if sum(map(len, waiting)) > FLUSH:
                yield send(waiting)
                waiting = []
        if waiting:
            yield send(waiting)

    @tidied
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches).items():
            key, n = _merged(blobs)
            file = _put(folder, f"words-{b}", to_bytes({**EliasFano.encode(key).arrays("hash"), "count": _small(n)}))
            hot = np.flatnonzero(n * HOT_IN_SHARD > n.sum())  # fewer than HOT_IN_SHARD
            columns = [pa.array([x]) for x in (b, file, len(key), int(n.sum()))] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (hot, n[hot])]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "file", "n", "total", "hot", "times"])

    work = Workspace(spark, "lm")
    merged = text.mapInArrow(count, "bucket int, blob binary").repartition(parts, "bucket").mapInArrow(merge, "bucket long, file string, n long, total long, hot array<long>, times array<long>")
    made = {r["bucket"]: r for r in work.save(merged, "words").collect()}  # one row per shard
    words = [made[b]["file"] if b in made else None for b in range(buckets)]
    first = np.concatenate([[0], np.cumsum([made[b]["n"] if b in made else 0 for b in range(buckets)])]).tolist()
    total = sum(r["total"] for r in made.values())
    hot = [[first[b] + i, n] for b, r in sorted(made.items()) for i, n in zip(r["hot"], r["times"]) if n * SPLIT * buckets > total]
    work.drop()
    return {"words": words, "nodes": [first], "levels": [], "bounds": [], "split": [], "hot": hot, "total": total}


def train(docs: DataFrame, folder: str, discount: float = DISCOUNT, min_bigram: int = MIN_BIGRAM, order: int = ORDER) -> dict:
    """Counts all of docs.text and writes the trie's files to folder; returns the model's directory.

    The model's longest n-grams have `order` words, 2 or more; n-grams seen less than min_bigram times are pruned.

    The directory names one file per shard and level (their number follows spark.sql.shuffle.partitions, not
    the corpus) and the totals; all counts stay in the files.
    """
    model, work = count_words(docs, folder), Workspace(docs.sparkSession, "lm-ids")
    model = add_levels(work.save(numbered(docs, model), "ids"), model, folder, discount, min_bigram, order)
    work.drop()
    return model


def add_levels(ids: DataFrame, model: dict, folder: str, discount: float = DISCOUNT, min_bigram: int = MIN_BIGRAM, order: int = ORDER) -> dict:
    """The model with the levels above words, counted over the numbered training texts."""
    work = Workspace(ids.sparkSession, "lm")
    for k in range(order - 1) if model["nodes"][0][-1] else ():
        bounds = _bounds(model)
        files, sizes, split = _train_level(ids.select("ids"), folder, work, model, bounds, discount, min_bigram)
        nodes = [np.concatenate([[0], np.cumsum(sizes)]).tolist()] if k < order - 2 else []
        model = model | {key: [*model[key], *more] for key, more in (("levels", [files]), ("bounds", [bounds]), ("split", [split]), ("nodes", nodes))}
    work.drop()
    return model


def _bounds(model: dict) -> list[int]:
    """Where the next level's shards begin, as context * words + word, and where the last one ends."""
    buckets, vocabulary = len(model["words"]), model["nodes"][0][-1]
    if model["levels"]:
        contexts = model["nodes"][-1][-1]
        return sorted({contexts * b // buckets * vocabulary for b in range(buckets + 1)})
    made = {first * vocabulary for first in model["nodes"][0]}
    for word, n in model["hot"]:
        parts = -(-n * SPLIT * buckets // model["total"])
        made |= {word * vocabulary + vocabulary * i // parts for i in range(parts + 1)}
    return sorted(made)


def _train_level(ids: DataFrame, folder: str, work: Workspace, model: dict, bounds: list[int], discount: float, min_bigram: int) -> tuple[list[str | None], list[int], dict]:
    """Counts the successors of the last level's nodes; returns the next level's files, their numbers of nodes and
    the back-off weights of contexts whose successors are split."""
    first, depth = model["nodes"][-1], len(model["levels"])
    vocabulary, name, shards = model["nodes"][0][-1], f"level{depth + 2}", len(bounds) - 1
    if first[-1] * (vocabulary + 1) >= 2**64:
        raise ValueError(f"{first[-1]} contexts of {vocabulary} words are too many for keys of 64 bits")
    split = [word for word, _ in model["hot"]] if depth == 0 else []

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, begins = Trie.of(model), np.array(bounds, np.uint64)

        def send(keys: list[np.ndarray]) -> pa.RecordBatch:
            key, n = _counted(keys)
            at = np.searchsorted(key, begins)
            return _rows([(b, _blob(key[s:e] - begins[b], n[s:e])) for b, (s, e) in enumerate(zip(at, at[1:])) if e > s])

        waiting: list[np.ndarray] = []
        for _, word, sizes in _numbers(batches, 0, _id_type(vocabulary)):
            starts = np.cumsum(sizes) - sizes
            context = trie.first_contexts(word, starts, int(word[-1]))  # the last token is an end
            for k in range(depth):
                context = trie.follow(k, context, word, starts)[3]
            ok = context >= 0
            if depth == 0 and min_bigram > 1:
                distinct, back = np.unique(word, return_inverse=True)
                often = trie.counts(distinct)[back] >= min_bigram  # a rarer word is in no pair that stays
                ok = often & np.concatenate([[True], often[:-1]])
            waiting.append(context[ok].astype(np.uint64) * _U(vocabulary) + word[ok].astype(np.uint64))
            if sum(map(len, waiting)) > FLUSH:
                yield send(waiting)
                waiting = []
        if waiting:
            yield send(waiting)

    @tidied
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches).items():
            key, n = _merged(blobs)
            key = key + _U(bounds[b])
            begin, end = bounds[b] // vocabulary, -(-bounds[b + 1] // vocabulary)
            size, context = end - begin, (key // _U(vocabulary)).astype(np.int64) - begin
            # Every context but a text's end has a successor wherever it occurs, so longer contexts' counts are sums.
            of_context = np.bincount(context, n, minlength=size) if depth else _words_of(model).counts(np.arange(begin, end)).astype(np.float64)
            stays = n >= min_bigram
            key, n, context = key[stays], n[stays], context[stays]
            word = key % _U(vocabulary)
            direct = (n - discount) / of_context[context]
            mass = np.bincount(context, direct, minlength=size)
            weight = np.maximum(1.0 - mass, LEAST)
            pointer = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=size))])
            # Context-relative: a context's ids start at the last value of the context before.
            heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.empty(0, np.int64)
            lasts = word[np.concatenate([heads[1:], [len(key)]]).astype(np.int64) - 1] if len(key) else np.empty(0, np.uint64)
            base = np.concatenate([[_U(0)], np.cumsum(lasts)[:-1]]).astype(np.uint64) if len(key) else lasts
            successor = word + np.repeat(base, np.diff(np.concatenate([heads, [len(key)]])))
            arrays = {
                **EliasFano.encode(pointer).arrays("pointer"), **EliasFano.encode(successor).arrays("successor"),
                "probability": quantise(direct), "weight": quantise(weight),
            }
            here = [c for c in split if begin <= c < end]
            told = [pa.array([x], pa.list_(kind)) for x, kind in ((here, pa.int64()), ([float(mass[c - begin]) for c in here], pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([_put(folder, f"{name}-{b}", to_bytes(arrays))]), pa.array([len(key)]), *told], ["bucket", "file", "n", "split", "mass"])

    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = ids.mapInArrow(count, "bucket int, blob binary").repartition(parts, "bucket").mapInArrow(merge, "bucket long, file string, n long, split array<long>, mass array<double>")
    made = {r["bucket"]: r for r in work.save(merged, name).collect()}  # one row per shard
    mass = dict.fromkeys(split, 0.0)
    for r in made.values():
        for c, m in zip(r["split"], r["mass"]):
            mass[c] += m
    weights = dequantise(quantise(np.maximum(1.0 - np.array(list(mass.values())), LEAST))).tolist()
    return [made[b]["file"] if b in made else None for b in range(shards)], [made[b]["n"] if b in made else 0 for b in range(shards)], {"contexts": list(mass), "weights": weights}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text).

    A null or empty text is its end alone. Rows that repeat a doc_id (null too) are scored one by one; long
    texts count whole; other columns are ignored; an empty table gives an empty result. A model of an empty
    training set knows no token.
    """
    return score_numbered(numbered(docs.select(F.col("doc_id").cast("long"), "text"), model, ("doc_id",)), model)


def score_numbered(ids: DataFrame, model: dict) -> DataFrame:
    """score() of texts that `numbered` has numbered, from (doc_id, ids)."""
    vocabulary = model["nodes"][0][-1]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(model)
        denominator = model["total"] + vocabulary + 1
        for part, token, sizes in _numbers(batches, 1, _id_type(vocabulary)):
            starts = np.cumsum(sizes) - sizes
            distinct, back = np.unique(token, return_inverse=True)
            counts = trie.counts(distinct)[back]
            base, word = (counts + 1) / denominator, np.where(token == vocabulary, -1, token)
            probability, context = base.copy(), trie.first_contexts(word, starts, int(word[-1]))
            for k in range(len(trie.levels)):
                at, direct, weight, context = trie.follow(k, context, word, starts)
                probability[at] = direct + weight * probability[at]
            total = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(sizes), pa.array(total((counts > 0).astype(np.int64))), pa.array(np.full(len(sizes), model["total"], np.int64)),
                    pa.array(total(np.log10(base))), pa.array(total(np.log10(probability))),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text leaves `fold`; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_and_score(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the documents that are not held out and scores all of them; each text is numbered once."""
    folder, work = Workspace(spark, "trie").at("model"), Workspace(spark, "numbered")
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held", held_out())
    model = count_words(docs.filter("NOT held"), folder)
    ids = work.save(numbered(docs, model, ("doc_id", "held")), "ids")
    model = add_levels(ids.filter("NOT held"), model, folder, order=order)
    return score_numbered(ids, model).withColumn("held_out", held_out())
