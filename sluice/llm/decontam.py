"""Benchmark decontamination: a hash set of benchmark word windows is looked up for every window of every document.

Each document yields the hashes of its word windows, of every length that benchmark windows have. They probe
the set of the benchmark's window hashes; a hit is verified word for word. The set is broadcast while its
measured size allows it; beyond that narrow (document, place, hash) rows are joined by shuffle and verified
against the document afterwards. Only hits and one row per document are shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Workspace, bind, lower_ascii

#: A set of up to this many windows and characters is broadcast.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_CHARS = 200_000, 64 << 20
#: A list of contaminated documents of up to this many 16-byte keys is broadcast.
MAX_BROADCAST_KEYS = 500_000
WINDOW = 13


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, gram, item): every distinct window of every item, its hash and the item that holds it.

    An item with fewer words than a window is one window by itself; one without words gives none.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    grams = items.select(
        "item",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window))).alias("gram"),
    )
    codes = F.transform("gram", lambda x: F.xxhash64(x))
    return grams.distinct().select(_hash(codes).alias("hash"), "gram", "item")


def _placed(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, words, start, length, hash) per window of every row of docs, and one row with start -1
    and the row's number of words as its length."""
    rows = bind(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("t")), words=_words(F.col("t"))).drop("t")
    rows = bind(rows, codes=F.transform("words", lambda x: F.xxhash64(x)))

    def windows(n: int) -> Column:
        every = F.transform(
            F.sequence(F.lit(0), F.size("codes") - n),
            lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), _hash(F.slice("codes", i + 1, n)).alias("hash")),
        )
        return F.when(F.size("codes") >= n, every).otherwise(F.array().cast("array<struct<start:int,length:int,hash:bigint>>"))

    size = F.array(F.struct(F.lit(-1).alias("start"), F.size("words").alias("length"), F.lit(None).cast("long").alias("hash")))
    return rows.select("doc_id", "text_key", "words", F.inline(F.concat(size, *map(windows, lengths))))


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, start, length, item): every occurrence of a window, and every row's size with start -1."""
    grams = benchmark_windows(benchmark, window)
    size = grams.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("gram", " ")) + F.length("item")).alias("chars"), F.collect_set(F.size("gram")).alias("lengths")).first()
    placed = _placed(docs, sorted(size["lengths"]))  # at most `window` lengths
    stands = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("gram")) == F.col("gram")
    if size["n"] <= MAX_BROADCAST_WINDOWS and (size["chars"] or 0) <= MAX_BROADCAST_CHARS:
        lookup = F.broadcast(grams.withColumnRenamed("hash", "h"))
        hits = placed.join(lookup, (F.col("hash") == F.col("h")) & stands, "left")
        return hits.filter("start < 0 OR item IS NOT NULL").select("doc_id", "text_key", "start", "length", "item")
    placed = placed.drop("words")
    sizes = placed.filter("start < 0").select("doc_id", "text_key", "start", "length", F.lit(None).cast("string").alias("item"))
    likely = placed.filter("start >= 0").join(grams.select("hash").distinct(), "hash", "left_semi")
    likely = likely.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "length", "hash")).alias("places"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("t")).withColumnsRenamed({"doc_id": "i", "text_key": "k"})
    texts = texts.join(likely, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).dropDuplicates(["doc_id", "text_key"])
    read = bind(texts.select("doc_id", "text_key", "places", "t"), words=_words(F.col("t")))
    read = read.select("doc_id", "text_key", F.explode(F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), F.slice("words", p["start"] + 1, p["length"]).alias("gram")))).alias("p"))
    read = read.select("doc_id", "text_key", "p.*").join(grams.select("gram", "item"), "gram").select("doc_id", "text_key", "start", "length", "item")
    return sizes.unionByName(read)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word is hit if it lies inside any occurrence of a benchmark window; a document is contaminated if it
    has a hit and at least `percent` percent of its words are hit. spans: the hit words as merged
    (start, length) runs, in order. Null text or item text has no words. Rows are told apart by doc_id and
    text: repeated rows each get the same result, and rows that share a doc_id (null too) keep their own.
    Whole texts are scanned, however long. An empty benchmark hits nothing, an empty table gives an empty
    result; other columns are ignored.
    """
    return _judged(docs, benchmark, window, percent).drop("text_key")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, percent: int) -> DataFrame:
    # Hits are first reduced to distinct places and items, so a passage repeated in a text stays small.
    run = F.when(F.col("start") >= 0, F.struct("start", "length"))
    rows = _found(docs, benchmark, window).groupBy("doc_id", "text_key").agg(
        F.count(F.when(F.col("start") < 0, 1)).alias("copies"), F.max(F.when(F.col("start") < 0, F.col("length"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(run)).alias("runs"), F.collect_set("item").alias("item_ids"),
    )
    # Of the windows that start at one word the longest counts. No window is longer than `window`, so the end of
    # what stands before run k is the largest end of the `window` runs before it.
    rows = bind(rows, runs=F.filter("runs", lambda r, k: F.coalesce(F.get("runs", k + 1)["start"] != r["start"], F.lit(True))))

    def end_before(k: Column) -> Column:
        low = F.greatest(k - window, F.lit(0))
        return F.array_max(F.transform(F.slice("runs", low + 1, k - low), lambda r: r["start"] + r["length"]))

    parted = F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda k: (k == 0) | (end_before(k) < F.get("runs", k)["start"]))
    rows = bind(rows, heads=F.when(F.size("runs") > 0, parted).otherwise(F.array().cast("array<int>")))
    spans = F.transform(
        "heads",
        lambda k, j: F.struct(
            F.get("runs", k)["start"].alias("start"),
            (end_before(F.coalesce(F.get("heads", j + 1), F.size("runs"))) - F.get("runs", k)["start"]).alias("length"),
        ),
    )
    rows = bind(rows, spans=spans)
    rows = bind(rows, n_hit=F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("item_ids")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"),
        "spans", "text_key",
    )


def _keyed(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """(row, text, doc_id, text_key and found's other columns), row being the whole of docs' row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    other = found.withColumnsRenamed({"doc_id": "i", "text_key": "k"})
    return rows.join(other, F.col("row.doc_id").eqNullSafe(F.col("i")) & F.xxhash64("row.text").eqNullSafe(F.col("k")), how)


def _list(found: DataFrame, work: Workspace, name: str) -> DataFrame:
    """found, written; broadcast if it has no more than MAX_BROADCAST_KEYS rows."""
    found = work.save(found, name)
    return F.broadcast(found) if found.count() <= MAX_BROADCAST_KEYS else found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, work: Workspace, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """Documents without the contaminated ones; all columns pass through, whatever their names; repeated rows stay.

    The keys of contaminated documents are written first. A list of checked size is broadcast, so that
    texts stay where they are; a longer one is joined by shuffle. Null texts have no words and stay.
    """
    bad = _judged(docs, benchmark, window, percent).filter("contaminated").select("doc_id", "text_key").distinct()
    return _keyed(docs, _list(bad, work, "contaminated"), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, work: Workspace, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """docs with the hit words of contaminated documents cut out, each with what separates it from the next word.

    Other documents keep their texts as they are; n_chars (if present) is recounted for those that are cut. All
    rows and columns stay.
    """
    cut = _judged(docs, benchmark, window, percent).filter("contaminated").select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    rows = _keyed(docs, _list(cut.filter(F.size("spans") > 0), work, "cut"), "left").select("row", "spans")
    text, inside = F.col("row.text"), r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
    rows = bind(rows, pieces=F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"[^{inside}]+[{inside}]*"), F.lit(0))))
    begin = lambda j: F.coalesce(F.get("spans", j - 1)["start"] + F.get("spans", j - 1)["length"], F.lit(0))
    end = lambda j: F.coalesce(F.get("spans", j)["start"], F.size("pieces"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda j: F.slice("pieces", begin(j) + 1, end(j) - begin(j))))
    rows = bind(rows, cut=F.when(F.col("spans").isNotNull(), F.concat(F.regexp_extract(text, f"^[{inside}]*", 0), F.array_join(kept, ""))))
    same = F.col("spans").isNull()
    changed = {"text": F.when(same, text).otherwise(F.col("cut"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
