"""Line-first quality rules.

Every line is judged alone (punctuation, navigation, boilerplate); failing lines are removed; a document
then fails if it lost too much of its text, or if it fails the base rules on its whole text. All of it is
built from Spark SQL functions over one row, so the operator is a single pass without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind

#: Characters that count as symbols (fixed by the query's contract).
SYMBOLS = r"[#*$%&|<>]"
#: A line is navigation if it has this many separators and few words between them.
SEPARATOR = r"[|»›•]"
MIN_SEPARATORS, MAX_WORDS_PER_SEGMENT = 3, 2
#: Phrases of lines without a text of their own. Fixed values.
PHRASES = (
    "all rights reserved", "cookie policy", "cookie settings", "accept cookies", "privacy policy", "terms of use", "terms of service", "sign up", "log in",
    "subscribe now", "subscribe to our", "newsletter", "click here", "read more", "enable javascript", "share this", "share on",
)
#: A short line is boilerplate if such phrases, as whole words, hold at least half of its letters and digits. With
#: two blanks for whatever parts words, neighbouring phrases don't share a border.
NOT_IN_WORDS = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
BOILERPLATE = "(?i) (" + "|".join(x.replace(" ", "  ") for x in PHRASES) + ") "
#: Every phrase has one of these; most lines have none and cost no more than this look.
HINT = "(?i)(reserved|cookie|privacy|terms|sign|log|subscribe|newsletter|click|read|javascript|share)"
MAX_BOILERPLATE_CHARS = 120
#: A line needs a letter or digit, and at most this share (percent) of its characters may be symbols.
LETTER_OR_DIGIT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
MAX_SYMBOL_PERCENT = 10
#: A document may lose this share (percent) of its characters to failing lines.
MAX_LOST_PERCENT = 50


def chars_in_words(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def line_fails(line: Column) -> Column:
    """Whether one line (with at least one word) is removed."""
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D|»›•]+"))
    navigation = line.rlike(SEPARATOR) & (separators >= MIN_SEPARATORS) & (words <= MAX_WORDS_PER_SEGMENT * (separators + 1))
    bare = F.concat(F.lit(" "), F.regexp_replace(line, NOT_IN_WORDS, "  "), F.lit(" "))
    letters = lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))
    boilerplate = (F.length(line) <= MAX_BOILERPLATE_CHARS) & line.rlike(HINT) & (letters(F.regexp_replace(bare, BOILERPLATE, "")) * 2 <= letters(bare))
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 100 > chars_in_words(line) * MAX_SYMBOL_PERCENT
    return navigation | boilerplate | (line.rlike(SYMBOLS) & symbols) | ~line.rlike(LETTER_OR_DIGIT)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    window: int = 5,
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """Adds the rule columns and the cleaned text to every row of docs.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept,
    cleaned (the text without its failing lines). Input columns of these names are replaced.

    Null or empty text: no words, all counts 0, base_failed true, kept false, cleaned null or empty.
    Very long texts are judged whole. Repeated rows and equal doc_ids are judged row by row; an empty
    table gives an empty result; other columns, whatever their names, pass through.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "cleaned"]
    passed = [c for c in docs.columns if c.lower() not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"

    # A line's verdict is a function of the line, so each line is judged once and its verdict kept beside it.
    d = bind(
        docs.select(row, F.col(f"`{text}`").alias("original"), whole.alias("t")),
        words=F.array_remove(F.split("t", SPACE), ""),
        judged=F.transform(
            F.split("t", "\n"),
            lambda x: F.struct(x.alias("line"), x.rlike(has_word).alias("worded"), (x.rlike(has_word) & line_fails(x)).alias("fails")),
        ),
    )
    d = bind(
        d,
        lines=F.transform(F.filter("judged", lambda x: x["worded"]), lambda x: x["line"]),
        windows=F.when(
            F.size("words") > window,
            F.transform(F.sequence(F.lit(1), F.size("words") - (window - 1)), lambda i: F.xxhash64(F.slice("words", i, window))),
        ),
    )
    # Only texts with a repeated window pay for the sort that finds which words the repeats cover.
    d = bind(
        d,
        ordered=F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda k, j: F.coalesce(F.get("ordered", j)["h"] == F.get("ordered", k)["h"], F.lit(False))
    d = bind(d, starts=F.sort_array(F.transform(F.filter("ordered", lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda x, k: F.least(F.coalesce(F.get("starts", k + 1) - x, F.lit(window)), F.lit(window))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    d = bind(
        d,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_symbols=F.regexp_count("t", F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
        lost_chars=F.aggregate(F.filter("judged", lambda x: x["fails"]), F.lit(0).cast("long"), lambda a, x: a + chars_in_words(x["line"])),
        cleaned=F.when(~F.exists("judged", lambda x: x["fails"]), F.col("original")).otherwise(
            F.concat_ws("\n", F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["line"]))
        ),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return d.select(
        *[F.col("row").getField(c).alias(c) for c in passed],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", failed.alias("base_failed"),
        (~failed & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent)).alias("kept"),
        "cleaned",
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their failing lines removed and n_chars (if present) recounted.

    Null, empty and blank texts fail the base rules and go. Repeated rows are judged one by one, an empty table
    stays empty. Other columns pass through, also where they bear a rule column's name.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = quality_rules(docs.select(row, F.col("text"))).filter("kept")
    changed = {c: (F.col("cleaned") if c == "text" else F.length("cleaned").cast(docs.schema[c].dataType)) for c in docs.columns if c in ("text", "n_chars")}
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
