"""Quality rules with limits that adapt to language and source, in DataFrame functions only.

Signals of every text are integers, so that results are the same on every engine and every retry.
Their distribution is kept as a quantile sketch for each language and source: counts of logarithmic
buckets with linear steps inside each power of two. Sketches merge by adding counts, so those of
days, shards, sources or languages can be stored and put together later without reading texts again.
Any quantile read from one is wrong by at most one part in 2 ** (PRECISION + 1) of its value.

A signal's limits are fences around the middle half of its distribution. A source with few texts
takes the fences of its language, a language with few those of the corpus. Rows meet the fences of
their group by a salted join, since one source may hold a third of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage
from ..operators.spread import join_per_key
from .common import whole_text

# Fixed by the contract: what parts words, what counts as a symbol, and the base rules.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Bits of a value that its bucket keeps.
PRECISION = 6
#: A group with fewer texts takes the limits of the next wider group.
LEAST_ROWS = 200
#: Fences lie this many times the middle half's width outside it ...
WIDTHS = 3
#: ... and at least this far: thousandths of a character, of a symbol a word, of the lines, of the words.
SLACK = {"word_length": 3000, "symbols": 100, "dup_lines": 400, "repeats": 200}
#: Signals that are bad when low, too.
TWO_SIDED = ("word_length",)
SIGNALS = tuple(SLACK)


def _same_beside(items: Column, field: str):
    """Filter condition: an element of the sorted ``items`` that equals one beside it in ``field``."""
    before = lambda i: F.get(items, i - 1)[field]
    after = lambda i: F.get(items, i + 1)[field]
    return lambda x, i: F.coalesce(before(i) == x[field], F.lit(False)) | F.coalesce(after(i) == x[field], F.lit(False))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple = ("lang", "source")) -> DataFrame:
    """Counts of every whole text: one narrow row per input row, without the text.

    Columns: id, the two group keys (``lang_key``, ``source_key``; null is a group of its own),
    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words.
    Null texts count as empty. Nothing is shuffled; the work of a text grows as n log n with its words.
    """
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for g in groups)
    keys = ["id", "lang_key", "source_key"]
    texts = docs.select(F.col(id_col).alias("id"), lang.alias("lang_key"), source.alias("source_key"), whole_text(text_col).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    counted = texts.select(
        *keys,
        F.array_remove(F.split("t", SPACE + "+", -1), "").alias("words"),
        lines.alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        *keys,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # A window's hash only says where to look; whether windows are equal is decided on their words.
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    kept = [*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    at_type = "array<struct<h:bigint,at:int>>"
    by_hash = counted.select(
        *kept,
        "words",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))).cast(at_type),
        ).otherwise(F.array().cast(at_type)).alias("by_hash"),
    )
    by_words = by_hash.select(
        *kept,
        F.array_sort(
            F.transform(
                F.filter("by_hash", _same_beside(F.col("by_hash"), "h")),
                lambda x: F.struct(F.array_join(F.slice("words", x["at"] + 1, WINDOW), " ").alias("w"), x["at"].alias("at")),
            )
        ).alias("by_words"),
    )
    placed = by_words.select(
        *kept,
        F.array_sort(F.transform(F.filter("by_words", _same_beside(F.col("by_words"), "w")), lambda x: x["at"])).alias("starts"),
    )
    # Words that the windows cover: each adds the ones before the next window starts, five at most.
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.coalesce(F.get(F.col("starts"), i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return placed.select(*kept, covered.cast("long").alias("n_repeat_words"))


def _per_thousand(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"{part} * 1000 div {whole}"))


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`signals` with the judged values, in thousandths; null for a text without a word."""
    return rows.withColumns(
        {
            "word_length": _per_thousand("word_chars", "n_words"),
            "symbols": _per_thousand("n_symbols", "n_words"),
            "dup_lines": _per_thousand("n_dup_lines", "n_lines"),
            "repeats": _per_thousand("n_repeat_words", "n_words"),
        }
    )


def bucket_of(value: Column) -> Column:
    """Bucket of a whole number from 0: small ones have their own, larger ones share one with near ones."""
    shift = F.greatest(F.length(F.bin(value)) - 1 - PRECISION, F.lit(0))
    return shift * (1 << PRECISION) + F.call_function("shiftright", value, shift)


def middle_of(bucket: Column) -> Column:
    """The value that stands for a bucket: its middle."""
    shift = F.greatest(F.call_function("shiftright", bucket, F.lit(PRECISION)) - 1, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", bucket - shift * (1 << PRECISION), shift)
    return low + F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), shift), F.lit(1))


def sketch(rows: DataFrame, keys: list[str], values: tuple = SIGNALS) -> DataFrame:
    """Quantile sketches of ``values`` per ``keys``: (keys, signal, bucket, n), null values left out.

    At most some 3700 rows for a key and signal, whatever the number of rows; counted where rows are
    read, so a key that holds a third of them reaches its task as that many counts.
    """
    long_form = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("signal"), F.col(v).alias("value")) for v in values])).alias("s"))
    return (
        long_form.filter("s.value IS NOT NULL")
        .groupBy(*keys, F.col("s.signal").alias("signal"), bucket_of(F.col("s.value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups, or of tables put together, from those of their parts."""
    return sketches.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, signal, n, one column per wanted quantile). A quantile a/b is the least value that a/b of the rows reach."""
    ordered = Window.partitionBy(*keys, "signal").orderBy("bucket")
    whole = Window.partitionBy(*keys, "signal")
    summed = sketches.withColumns({"upto": F.sum("n").over(ordered), "total": F.sum("n").over(whole)})
    least = {
        name: F.min(F.when(F.col("upto") * b >= F.col("total") * a, F.col("bucket"))) for name, (a, b) in wanted.items()
    }
    return summed.groupBy(*keys, "signal").agg(
        F.first("total").alias("n"), *[middle_of(value).alias(name) for name, value in least.items()]
    )


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its number of texts and, per signal, the limits ``<signal>_low`` and ``<signal>_high``."""
    found = quantiles(sketches, keys, {"q1": (1, 4), "q3": (3, 4)})
    slack = reduce(lambda c, s: c.when(F.col("signal") == s, F.lit(SLACK[s])), SIGNALS[1:], F.when(F.col("signal") == SIGNALS[0], F.lit(SLACK[SIGNALS[0]])))
    reach = F.greatest(WIDTHS * (F.col("q3") - F.col("q1")), slack)
    limited = found.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    pick = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c)))
    return limited.groupBy(*keys).agg(
        F.max("n").alias("n_rows"),
        *[pick(s, "high").alias(f"{s}_high") for s in SIGNALS],
        *[pick(s, "low").alias(f"{s}_low") for s in TWO_SIDED],
    )


def group_limits(sketches: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Limits of every (lang_key, source_key): its own, its language's or the corpus's, as ``scope`` tells."""
    keys = ["scope", "lang_key", "source_key"]
    levels = F.array(
        F.struct(F.lit("source").alias("scope"), "lang_key", "source_key"),
        F.struct(F.lit("language").alias("scope"), "lang_key", F.lit("").alias("source_key")),
        F.struct(F.lit("corpus").alias("scope"), F.lit("").alias("lang_key"), F.lit("").alias("source_key")),
    )
    every = merge(sketches.select(F.explode(levels).alias("g"), "signal", "bucket", "n").select("g.*", "signal", "bucket", "n"), keys)
    limits = cut_lineage(fences(every, keys))
    sources = limits.filter("scope = 'source'").select("lang_key", "source_key", "n_rows")
    languages = limits.filter("scope = 'language'").select("lang_key", F.col("n_rows").alias("lang_rows"))
    chosen = sources.join(languages, "lang_key").select(
        F.when(F.col("n_rows") >= least_rows, "source").when(F.col("lang_rows") >= least_rows, "language").otherwise("corpus").alias("scope"),
        F.col("lang_key").alias("own_lang"),
        F.col("source_key").alias("own_source"),
    )
    named = chosen.withColumns(
        {
            "lang_key": F.when(F.col("scope") == "corpus", "").otherwise(F.col("own_lang")),
            "source_key": F.when(F.col("scope") == "source", F.col("own_source")).otherwise(""),
        }
    )
    return named.join(limits.drop("n_rows"), keys).drop("lang_key", "source_key").withColumnsRenamed(
        {"own_lang": "lang_key", "own_source": "source_key"}
    )


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of :func:`measured` with base_failed, kept, ``reasons`` (names, comma-joined) and ``scope``."""
    # One column for the join; the length keeps two keys from running into each other.
    joint = F.concat_ws(":", F.length("lang_key").cast("string"), "lang_key", "source_key")
    met = join_per_key(
        rows.withColumn("joint", joint), limits.withColumn("joint", joint).drop("lang_key", "source_key"), "joint", "id", "left"
    )
    outside = lambda s: F.col(s) > F.col(f"{s}_high") if s not in TWO_SIDED else (
        (F.col(s) > F.col(f"{s}_high")) | (F.col(s) < F.col(f"{s}_low"))
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    reasons = F.concat_ws(",", *[F.when(outside(s), s) for s in SIGNALS])
    return met.withColumns({"base_failed": base, "reasons": reasons}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("reasons") == "")
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple = ("lang", "source"), least_rows: int = LEAST_ROWS) -> DataFrame:
    """Every row's signals and verdict: one row out per row in.

    Limits come from all texts of the table with a word. Null and empty texts have no signals and fail
    the base rules; a null language or source is a group of its own; equal rows get equal answers, each
    its own row; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    # Texts are read once; their signals are read twice, for the sketches and for the verdicts.
    rows = cut_lineage(measured(signals(docs, id_col, text_col, groups)))
    return judge(rows, group_limits(sketch(rows, ["lang_key", "source_key"]), least_rows))
