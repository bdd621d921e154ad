"""Quality rules by the frequency of lines across documents, in built-in functions only.

Lines are normalised (lower case, runs of white space to one blank, none at the ends) and hashed.
Per host and line the distinct documents are counted, where documents with the same text count once,
so that copies of one text make no line frequent. A line is above the limits where more than
`least_docs` documents of the host, and more than `share` of them, hold it; without a share the
count alone decides, whatever the size of the host. Such lines are removed
from every document but the first (smallest doc_id) of the host that has them, so that no content
goes with its last copy. A document that loses more than `most_removed` of its words is depleted and
rejected; so is one that fails the base rules (fewer than 50 words, or more than half of them in
repeated three-word windows).

What later steps need of a document (its counts, and hash and words of each line) is written once to
the shared folder; texts are read and parsed once. Counting combines map-side, so a hot host or line
is no hot task; joins are on (host, line), which adaptive execution splits where they are skewed.

Defined cases: a null text has no words and fails the base rules; null hosts form one host; a null
doc_id is never the first document; repeated rows get the same verdict each; lines without a word
are never removed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.shared import fresh, named, written

LEAST_WORDS = 50
LEAST_DOCS = 5
SHARE = 0.02
MOST_REMOVED = 0.7

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _has_word(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\f\r", "")) > 0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, windows compared by a 64-bit hash."""

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - 3)
        return F.transform(places, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False)),
            )

        def three(e: Column) -> Column:
            return F.array(e["i"], e["i"] + 1, e["i"] + 2)

        return _let(placed, lambda s: F.size(F.array_distinct(F.flatten(F.transform(twice(s), three)))))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(hashes, windows), count))


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with COUNTS and base_failed of the whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    made = _let(
        _words(whole),
        lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")),
    )
    full = F.filter(F.split(whole, "\n"), _has_word)
    frame = docs.withColumn("_words", made).withColumns(
        {
            "n_words": F.col("_words")["n_words"].cast("long"),
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("_words")["n_repeat_words"].cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return frame.drop("_words").withColumn("base_failed", failed)


def _line_hashes(text: Column) -> Column:
    """Hash of the normalised line and its words, for each line with a word."""
    full = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _has_word)
    return F.transform(
        full, lambda x: F.struct(F.xxhash64(_normalised(x)).alias("h"), F.size(_words(x)).alias("n"))
    )


KEY = ["_id", "_host", "_t1", "_t2"]


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    host: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    share: float | None = SHARE,
    most_removed: float = MOST_REMOVED,
) -> DataFrame:
    """One row per document: KEY (id, host, two hashes of the text), COUNTS, base_failed,
    n_removed_words, removed (hashes of the lines that go) and kept."""
    frame = docs.select(
        F.col(id_col).alias("_id"),
        F.col(host).alias("_host"),
        F.xxhash64(text).alias("_t1"),
        F.crc32(F.col(text)).alias("_t2"),
        _line_hashes(F.col(text)).alias("_lines"),
        F.col(text).alias("_text"),
    )
    rows = written(counted(frame, "_text").drop("_text"), "lines")
    lines = rows.select(*KEY, F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("h"))
    found = lines.groupBy("_host", "h").agg(
        F.count_distinct("_t1", "_t2").alias("docs"), F.min("_id").alias("first")
    )
    above = found.where(F.col("docs") > least_docs)
    if share is not None:
        hosts = rows.where(F.col("_t2").isNotNull()).groupBy(F.col("_host").alias("_of")).agg(
            F.count_distinct("_t1", "_t2").alias("all_docs")
        )
        above = above.join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).where(
            F.col("docs") > share * F.col("all_docs")
        )
    above = above.select(F.col("_host").alias("_of"), F.col("h").alias("_h"), "first")
    gone = (
        lines.join(above, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_h")))
        .where(~F.col("_id").eqNullSafe(F.col("first")) | F.col("_id").isNull())
        .groupBy(*KEY)
        .agg(F.collect_set("h").alias("removed"))
        .select(*(F.col(k).alias(f"g{k}") for k in KEY), "removed")
    )
    condition = F.lit(True)
    for k in KEY:
        condition &= F.col(k).eqNullSafe(F.col(f"g{k}"))
    judged = rows.join(gone, condition, "left").drop(*(f"g{k}" for k in KEY))
    lost = F.aggregate(
        F.filter("_lines", lambda x: F.array_contains("removed", x["h"])),
        F.lit(0).cast("long"),
        lambda total, x: total + x["n"],
    )
    judged = judged.withColumn("n_removed_words", F.when(F.col("removed").isNull(), 0).otherwise(lost).cast("long"))
    depleted = F.col("n_removed_words") > most_removed * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_lines")


def cleaned(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The documents that are kept, with the same columns, their frequent lines removed."""
    judged = verdicts(docs, id_col, host, text, **limits)
    names = {k: fresh(k, docs.columns) for k in (*KEY, "removed")}
    kept = judged.where("kept").dropDuplicates(KEY).select(*(F.col(k).alias(n) for k, n in names.items()))
    own = {"_id": F.col(id_col), "_host": F.col(host), "_t1": F.xxhash64(text), "_t2": F.crc32(F.col(text))}
    condition = F.lit(True)
    for k, value in own.items():
        condition &= value.eqNullSafe(F.col(names[k]))
    gone = F.col(names["removed"])

    def stays(line: Column) -> Column:
        return ~_has_word(line) | ~F.array_contains(gone, F.xxhash64(_normalised(line)))

    left = F.concat_ws("\n", F.filter(F.split(text, "\n"), stays))
    joined = docs.join(kept, condition).withColumn(text, F.when(gone.isNull(), F.col(text)).otherwise(left))
    return joined.select(*named(docs.columns))
