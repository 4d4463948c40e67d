"""Exact n-gram Jaccard join in the metric space of shingle sets.

Regions. A pivot may be any set, so the first level takes one-shingle sets as pivots: unrelated texts all lie
at distance 1 from any document, but a document is nearer than that to the pivots whose shingle it holds. Ties
go to the pivot that comes first in one global order, which is the document's home. The triangle inequality
bounds how much of a set a partner within distance 1 - t may miss: |x minus y| <= (1 - t) |x|. So x is
replicated to as many further regions as that window needs, its first floor((1 - t) |x|) + 1 shingles, and every
pair within the threshold meets in at least one region. Any global order is exact; rare shingles come first,
by the counts of a fixed number of hashed cells over all documents. A window that is some shingles longer makes
every pair meet that often (``SHARED``), so a pair that meets less, and only in small regions, meets by chance;
and what a pair shares beyond the k-th meeting stands behind that shingle in both documents.

Recursion. Regions of more than a handful get a document pivot, and what meets at one pivot is one region of
the second level, however many shingles it met at. Such a region is joined inside a task by further document
pivots, Voronoi cells and triangle-inequality windows (``voronoi.Region``). A region too large for a task is
re-centred on its pivot instead, which deals its documents to smaller regions by what they don't share with it.

Sets are 64-bit hashes of word n-grams; equal sets are one class and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, voronoi
from .common import Workspace, let_go, release, tidied
from .components import components

#: Cells that order the shingles; more of them tell rare from frequent in larger corpora.
COUNT_CELLS = 1 << 20
#: Cells that tell which texts are read again; full cells only mean that more texts are.
TEXT_CELLS = 1 << 24
#: A key that one task holds more often than this goes on row by row, not to one task.
HOT = 64
#: Regions in which every pair within the threshold meets (or in as many as it has shingles in common).
SHARED = 4
#: (key, node) pairs that a task sorts at once.
SORTED_PAIRS = 400_000
#: A second-level region of more documents or shingles than this is re-centred, not joined in one task.
MAX_MEMBERS, MAX_CODES = 4_096, 4_000_000
#: Lists of up to this many 8-byte ids are broadcast; longer ones are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the n-word shingles (one shingle if there are fewer words)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    k, m = min(n, len(words)), len(words)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, m)
    end = m - k + 1
    mixed = codes[:end] * _MIX1 + np.uint64(k)
    for j in range(1, k):
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX2
        mixed += codes[j : end + j]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX1
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    let_go()
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            yield batch, batch.column(column).cast(pa.binary()).to_pylist()


def shingle_counts(docs: DataFrame, n: int, size: int) -> np.ndarray:
    """How often the shingles of each cell occur in documents, up to 65,535."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, held, many = None, [], 0

        def add():
            nonlocal total, held, many
            counted = np.bincount((np.concatenate(held) & np.uint64(size - 1)).astype(np.int64), minlength=size)
            total = counted if total is None else total + counted
            held, many = [], 0

        for _, texts in _texts(batches, 0):
            held += [shingle_set(t, n) for t in texts]
            many = sum(map(len, held))
            if many > size:
                add()
        if many:
            add()
        return None if total is None else np.minimum(total, 65_535)

    def saturated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint32) + b, 65_535).astype(np.uint16)

    return cells.merged(docs.select(F.col("text").cast("string")), fill, size, saturated, np.uint16)


def shingle_windows(docs: DataFrame, n: int, percent: int, counts, keyed: bool = False) -> DataFrame:
    """(doc_id, n, fp, th, keys) per row: size and 128-bit fingerprint of the set, 128-bit hash of the text, and
    the first shingles of the set in the global order, as 32-bit keys. fp, th and keys are null for an empty set.

    With keyed also text_key, which tells different texts of one doc_id apart.
    """
    added = ["text_key"] if keyed else []

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        low = np.uint64(len(often) - 1)
        for batch, texts in _texts(batches, 1):
            sets, keys = [shingle_set(t, n) for t in texts], []
            for s in sets:
                # Codes ascend, so a stable sort by count is one total order.
                first = np.argsort(often[(s & low).astype(np.int64)], kind="stable")[: len(s) * (100 - percent) // 100 + SHARED]
                keys.append((s[first] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([xxhash.xxh3_128_digest(t) if len(s) else None for t, s in zip(texts, sets)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int32))),
                    *(batch.column(2 + i) for i in range(len(added))),
                ],
                ["doc_id", "n", "fp", "th", "keys", *added],
            )

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[_text_key().alias(c) for c in added])
    return text.mapInArrow(run, ", ".join(["doc_id long, n long, fp binary, th binary, keys array<int>", *(f"{c} long" for c in added)]))


def _text_key():
    return F.xxhash64(F.col("text").cast("string"))


#: One row of a key in one document: the key, the document, its set's size, the key's place in its window.
_ROW = np.dtype([("key", "<u4"), ("place", "<u2"), ("size", "<u4"), ("node", "<i8")])


def meetings(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Who meets whom, from (node, n, keys): rows (kind, a, b, n, times, least).

    kind 0: document b, of n shingles, belongs to the second-level region of pivot a. kind 1: document b, of n
    shingles, is in the region of the hot key a. kind 2: documents a and b, of n shingles, meet so many times in
    regions of a handful; in all such regions a pair within the threshold, unless it meets in a larger one, does
    at least `least` times. Rows travel packed; the key of a hot region is known to all
    tasks that its rows meet, and its rows are dealt by turns.
    """
    plain, marker, spread = 0, 1, 2

    @tidied
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, many, turn
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            begins = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
            often = np.diff(np.concatenate([begins, [len(rows)]]))
            hot = np.repeat(often > HOT, often)
            out = []
            for kind, chosen in ((plain, rows[~hot]), (marker, rows[begins[often > HOT]])):
                bucket = ((chosen["key"].astype(np.uint64) * _MIX1) >> np.uint64(33)).astype(np.int64) % parts
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(parts + 1))
                out += [(b, kind, chosen[by[s:e]].tobytes()) for b, (s, e) in enumerate(zip(edges, edges[1:])) if e > s]
            crowd = rows[hot]
            for at in range(0, len(crowd), 50_000):
                out.append(((int(crowd["node"][0] >> 33) + turn) % parts, spread, crowd[at : at + 50_000].tobytes()))
                turn += 1
            held, many = [], 0
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "rows"])

        for batch in (whole.slice(at, 2_000) for whole in batches for at in range(0, whole.num_rows, 2_000)):
            ends = batch.column(2).offsets.to_numpy()
            keys = batch.column(2).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            each = np.diff(ends)
            rows = np.empty(len(keys), _ROW)
            rows["key"] = keys.view(np.uint32)
            rows["place"] = np.minimum(np.arange(len(keys)) - np.repeat(ends[:-1] - ends[0], each), 65_535)
            rows["size"] = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), each)
            rows["node"] = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)
            held.append(rows)
            many += len(rows)
            if many > SORTED_PAIRS:
                yield from flush()
        if many:
            yield from flush()

    @tidied
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), 200_000):
                some = [pa.array(np.ascontiguousarray(c[at : at + 200_000]).astype(np.int64)) for c in columns]
                some += [pa.nulls(len(some[0]), pa.int64())] * (5 - len(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), kind, np.int32)), *some], ["kind", "a", "b", "n", "times", "least"])

        held, hot = [], []
        for batch in batches:
            for kind, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = np.frombuffer(packed, _ROW)
                if kind == spread:
                    yield from out(1, rows["key"], rows["node"], rows["size"])
                else:
                    (held if kind == plain else hot).append(rows)
        if not held:
            return
        rows = np.concatenate(held)
        if hot:
            crowd = np.isin(rows["key"], np.unique(np.concatenate(hot)["key"]))
            yield from out(1, rows["key"][crowd], rows["node"][crowd], rows["size"][crowd])
            rows = rows[~crowd]
        members, pairs = second_level(rows, percent)
        yield from out(0, *members)
        yield from out(2, *pairs)

    dealt = classes.select("node", "n", "keys").mapInArrow(scatter, "bucket int, kind int, rows binary").repartition(parts, "bucket")
    return dealt.mapInArrow(gather, "kind int, a long, b long, n long, times long, least long")


def second_level(rows: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From all rows of some keys: distinct members (pivot, document, its size) of second-level regions, and pairs
    (document, document, size of the latter, times met, least times) of regions of up to a handful.

    Larger regions are cut where sizes leave a gap that no pair spans, lose documents without a possible partner,
    and what is left meets at the document with the smallest hash.
    """
    rows = rows[np.lexsort((rows["node"], rows["size"], rows["key"]))]
    size, place = rows["size"].astype(np.int64), rows["place"].astype(np.int64)
    if len(rows) < 2:
        return [np.empty(0, np.int64)] * 3, [np.empty(0, np.int64)] * 5
    parted = (rows["key"][1:] != rows["key"][:-1]) | (100 * size[:-1] < percent * size[1:])
    begins = np.concatenate([[0], np.flatnonzero(parted) + 1])
    length = np.diff(np.concatenate([begins, [len(rows)]]))

    def least(a, b):  # shared shingles of a pair of such sizes within the threshold
        return -(-percent * (a + b) // (100 + percent))

    # The pair's SHARED-th meeting at the latest, so SHARED - 1 shingles in common may stand before this one.
    behind = size - place + (SHARED - 1)

    def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shared = np.minimum(behind[i], behind[j])
        return (shared >= least(size[i], size[j])) & (100 * size[i] >= percent * size[j]) & (rows["node"][i] != rows["node"][j])

    pivots, members, met = [], [], []

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        near = possible(i, j)
        x, y = i[near], j[near]
        swap = rows["node"][x] > rows["node"][y]
        met.append((np.where(swap, y, x), np.where(swap, x, y)))

    small = np.flatnonzero((length > 1) & (length <= voronoi.HANDFUL))
    for lag in range(1, voronoi.HANDFUL):
        for step in range(voronoi.HANDFUL - lag):
            first = begins[small[length[small] > step + lag]] + step
            pairs(first, first + lag)
    core = behind >= least(size, size)  # the smaller one of a pair is, the larger one needn't be
    hashed = (rows["node"].view(np.uint64) * _MIX1) ^ (rows["node"].view(np.uint64) >> np.uint64(7))
    for k in np.flatnonzero(length > voronoi.HANDFUL).tolist():
        at = np.arange(begins[k], begins[k] + length[k])
        s, c = size[at], core[at]
        low, high = -(-percent * s // 100), 100 * s // percent
        below = np.searchsorted(s[c], s, "right") - np.searchsorted(s[c], low, "left") - c
        above = np.searchsorted(s, high, "right") - np.searchsorted(s, s, "left") - 1
        at = at[(below > 0) | (c & (above > 0))]
        if len(at) < 2:
            continue
        pivot = at[hashed[at].argmin()]
        at = at[rows["node"][at] != rows["node"][pivot]]
        pivots.append(np.full(len(at), pivot))
        members.append(at)
    joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    node, p, m = rows["node"], joined(pivots), joined(members)
    found = np.unique(np.rec.fromarrays([node[p], node[m], size[m]], names="a,b,n"))
    x, y = joined([a for a, _ in met]), joined([b for _, b in met])
    pair, times = np.unique(np.rec.fromarrays([node[x], node[y], size[y], np.minimum(least(size[x], size[y]), SHARED)], names="a,b,n,least"), return_counts=True)
    return [found["a"], found["b"], found["n"]], [pair["a"], pair["b"], pair["n"], times, pair["least"]]


def _listed(ids: DataFrame, width: int) -> DataFrame:
    """Rows of so many ids each, marked for broadcast where there are few enough."""
    return F.broadcast(ids) if ids.count() * width <= MAX_BROADCAST_IDS else ids


def _read_again(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(th, codes) of the wanted (th, doc): the sets of those texts, read from docs once more.

    A table of hashed cells tells the scan which rows to take, so copies with other ids are passed over; what a
    full cell lets through besides is for the caller to drop. A task gives a text once.
    """
    spark = docs.sparkSession

    def cell(h: bytes, doc: int | None) -> int:
        return (int.from_bytes(h[:8], "little") ^ (doc or 0) & 0xFFFFFFFFFFFFFFFF) % TEXT_CELLS

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(TEXT_CELLS, np.uint8)
        for batch in batches:
            bits[[cell(h, d) for h, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]] = 1
        return np.packbits(bits)

    asked = spark.sparkContext.broadcast(cells.merged(wanted.select("th", "doc"), fill, TEXT_CELLS // 8, np.bitwise_or, np.uint8))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = asked.value, set()
        for batch, texts in _texts(batches, 1):
            hashes, sets = [], []
            for doc, t in zip(batch.column(0).to_pylist(), texts):
                h = xxhash.xxh3_128_digest(t) if t else b""
                at = cell(h, doc)
                if h and bits[at >> 3] >> (7 - (at & 7)) & 1 and h not in seen:
                    seen.add(h)
                    hashes.append(h)
                    sets.append(shingle_set(t, n).view(np.int64))
            if hashes:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["th", "codes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "th binary, codes array<long>")


def jaccard_components(docs: DataFrame, work: Workspace, n: int = 3, percent: int = 90, keyed: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles; a
    text with fewer than n words is one shingle; null, empty or blank texts are linked with nothing and keep
    their own doc_id. Repeated rows and rows that share a doc_id each get a row. A null doc_id never becomes
    a component_id unless all documents of the component have none. Extra columns are ignored, an empty
    table gives an empty result. Long texts count whole.

    With keyed also text_key, a hash of the text, and root, which is the same within a component and nowhere
    else (null for texts without words); component_ids of different components can be equal where doc_ids repeat.
    """
    keys, root = (["text_key"], ["root"]) if keyed else ([], [])
    spark, parts = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.sparkContext.broadcast(shingle_counts(docs, n, COUNT_CELLS))
    rows = shingle_windows(docs, n, percent, counts, keyed).withColumn("node", F.monotonically_increasing_id())
    rows = work.save(rows, "documents")
    # Rows of one fp have equal n and keys, and any of their texts has the class's set: that of the smallest doc_id.
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    classes = rows.filter("n > 0").groupBy("fp").agg(
        F.min("node").alias("node"), named["doc_id"].alias("doc"), F.coalesce(named["th"], F.min("th")).alias("th"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("keys").alias("keys"),
    )
    classes = work.save(classes, "classes")
    met = work.save(meetings(classes, percent, parts), "met")
    links = work.save(_links(docs, met, classes, work, n, percent), "links")
    roots = components(links, work)
    release(spark)
    # Only classes of several documents or with links need anything but their own doc_id and node.
    named = classes.select("fp", "node", "doc", "copies").join(roots, "node", "left").filter("copies > 1 OR root IS NOT NULL")
    named = work.save(named.select("fp", "doc", F.coalesce("root", "node").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id", "root")
    out = rows.drop("keys", "th").join(named, "fp", "left")
    single = F.col("root").isNull()
    result = Workspace(spark, "components").save(
        out.select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            *keys, *[F.when(F.col("n") > 0, F.coalesce("root", "node")).alias(c) for c in root],
        ),
        "result",
    )
    work.drop()
    return result


def _links(docs: DataFrame, met: DataFrame, classes: DataFrame, work: Workspace, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs within the threshold connect."""
    regions = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "n")
    often = met.filter("kind = 2").groupBy("a", "b", "n", "least").agg(F.sum("times").alias("times")).filter("times >= least")
    members = _second(regions, work, "pivots-0").union(met.filter("kind = 0").select("a", "b", "n")).union(often.select("a", "b", "n"))
    members = work.save(members.distinct(), "members-0")
    texts = classes.select("node", "th", "doc")
    links, held, step = [], None, 0
    while True:
        size = members.groupBy("a").agg(F.count("*").alias("members"), F.sum("n").alias("codes"))
        large = work.save(size.filter((F.col("members") > MAX_MEMBERS) | (F.col("codes") > MAX_CODES)).select("a"), f"large-{step}")
        over = not large.isEmpty()
        inside = members.join(large, "a", "left_anti") if over else members
        inside = inside.select("a", F.col("b").alias("node")).union(inside.select("a", F.col("a").alias("node")).distinct())
        inside = work.save(inside.join(texts, "node"), f"inside-{step}")
        links.append(work.save(_joined(docs, inside, n, percent), f"links-{step}"))
        if not over:
            break
        # Too large for one task: all are compared with the pivot, and what that leaves open is dealt anew.
        if held is None:
            nodes = members.select(F.col("a").alias("node")).union(members.select("b")).distinct().join(texts, "node")
            nodes = work.save(nodes, "nodes")
            held = work.save(_read_again(docs, nodes, n).join(nodes, "th").groupBy("node").agg(F.first("codes").alias("codes")), "held")
        cells_ = work.save(_centred(members.join(large, "a", "left_semi"), held, percent), f"cells-{step}")
        links.append(cells_.filter("linked").select("a", "b"))
        open_ = cells_.filter(~F.col("linked")).select("a").distinct()
        regions = work.save(_recentred(cells_.join(open_, "a", "left_semi"), percent), f"regions-{step}")
        step += 1
        members = work.save(_second(regions, work, f"pivots-{step}").distinct(), f"members-{step}")
        release(docs.sparkSession)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _second(regions: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Members (a, b, n) of second-level regions, from regions (key, node, n) of any size: the document with the
    smallest hash is the pivot. A list of pivots of checked size is broadcast, so rows of a hot key stay where they are."""
    pivots = work.save(regions.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("a")), name)
    return regions.join(_listed(pivots, 2), "key").filter("a <> node").select("a", F.col("node").alias("b"), "n")


def _joined(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of all second-level regions, from their members (a, node, th, doc), each joined in one task."""

    def join(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        lists = table.column("codes").combine_chunks()
        ends, codes = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        found = voronoi.Region([codes[ends[i] : ends[i + 1]] for i in first.tolist()], percent).join()
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[pairs[:, 0]], pa.int64()), "b": pa.array(nodes[pairs[:, 1]], pa.int64())})

    placed = _listed(members.select("th", "a", "node"), 2)
    rows = _read_again(docs, members, n).join(placed, "th").select("a", "node", "codes")
    return rows.groupBy("a").applyInArrow(join, "a long, b long")


def _centred(members: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Members (a, b) seen from their pivot a: sizes na and nb, whether they link, and what they don't share."""
    x, y = held.toDF("b", "sb"), held.toDF("a", "sa")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = common * 100 >= (F.col("na") + F.col("nb") - common) * percent
    both = members.join(x, "b").join(y, "a").select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), "sa", "sb")
    return both.select("a", "b", "na", "nb", linked.alias("linked"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("delta"))


def _recentred(cells: DataFrame, percent: int) -> DataFrame:
    """Recursion, second kind: a large region seen from its pivot p falls into smaller regions.

    With D(x) = x symmetric-minus p and s = |D|, two documents differ in |D(x) symmetric-minus D(y)| shingles;
    the threshold allows at most c (|x| + |y|), c = (1 - t) / (1 + t). So a link needs that the differences
    share o >= (s(x) + s(y) - c (|x| + |y|)) / 2 shingles, and the triangle inequality s(y) >= s(x) - c (|x| + |y|).
    Documents linked to p are connected already; every other link has an end u that is not, so s(u) > c (|u| + |p|),
    and then o > 0: were s(u) + s(v) <= c (|u| + |v|), s(v) < c (|v| - |p|) <= c s(v) would follow. So the rarest
    s - o + 1 shingles of both differences meet, which makes them regions of a lower level.
    """
    c = (100 - percent) / (100 + percent)
    widest = F.col("nb") * (c * (1 + 100 / percent))  # of c (|x| + |y|), over all sizes a partner may have
    s = F.size("delta")
    # For u: s(v) >= s(u) - widest, so o >= s(u) - widest. For v linked to p: s(u) > c (|u| + |p|).
    least = F.when(F.col("linked"), (s - F.greatest(F.col("nb") - F.col("na"), F.lit(0)) * c) / 2).otherwise(s - widest)
    cells = cells.withColumn("s", s).withColumn("p", s - F.greatest(F.ceil(least - 1e-6), F.lit(1)).cast("int") + 1)
    exploded = cells.filter("s > 0").select("a", "b", "nb", "p", F.explode("delta").alias("shingle"))
    often = exploded.groupBy("a", "shingle").agg(F.count("*").alias("often"))
    order = F.sort_array(F.collect_list(F.struct("often", "shingle")))
    rarest = exploded.join(often, ["a", "shingle"]).groupBy("a", "b").agg(order.alias("order"), F.first("p").alias("p"), F.first("nb").alias("nb"))
    lower = rarest.select("a", "b", "nb", F.explode(F.slice("order", 1, F.col("p"))).alias("x")).filter("x.often > 1")
    return lower.select(F.xxhash64("a", "x.shingle").alias("key"), F.col("b").alias("node"), F.col("nb").alias("n"))


def keep_one(docs: DataFrame, work: Workspace, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id. All columns pass through, whatever
    their names and types.

    Rows of a group that share its smallest doc_id count as copies too, and so do repeated rows; one of them
    stays, picked by all its columns. Rows that share a doc_id but are in different groups are told apart by
    their texts. Documents without doc_id stay.
    """
    found = work.save(jaccard_components(docs, Workspace(docs.sparkSession, "join"), n, percent, keyed=True), "found")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = (F.col("row.doc_id") == F.col("id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("key"))
    gone = work.save(found.filter("doc_id <> component_id").select("doc_id", "text_key").distinct(), "gone").toDF("id", "key")
    left = rows.join(_listed(gone, 2), here, "left_anti")
    # Texts without words are linked with nothing: only the same text again is a copy.
    first = found.filter("doc_id = component_id").select("doc_id", "text_key", F.struct("root", F.when(F.col("root").isNull(), F.col("text_key")).alias("blank")).alias("group"))
    several = first.groupBy("doc_id", "group").count().filter("count > 1").select("doc_id", "group")
    twice = work.save(first.distinct().join(several, ["doc_id", "group"], "left_semi"), "twice").select("doc_id", "text_key", "group").toDF("id", "key", "group")
    if twice.isEmpty():
        return left.select("row.*")
    twice = _listed(twice, 4)
    ordered = not any(kind in docs.schema.simpleString() for kind in ("map<", "variant"))  # Spark has no order for these
    picked = left.join(twice, here).groupBy("id", "group").agg((F.min("row") if ordered else F.min_by("row", F.to_json("row"))).alias("row"))
    return left.join(twice, here, "left_anti").union(picked.select("row")).select("row.*")
