"""Language identification by n-gram filters with one bit per language.

Learning counts character n-grams per language in a grouped aggregation, and lists in each language
those that are typical of it. The lists go into one bit-sliced Bloom filter: a table of bit masks,
one bit per language, in which an n-gram sets its language's bit at several places. Looking up an
n-gram is the AND of the masks at its places, which gives all languages that list it at once.

A text's n-grams are looked up; per language the set bits are counted and corrected for the false
positives that the filter's fill leads one to expect: of N n-grams, hits h and false positive rate
f, the share (h/N - f) / (1 - f). The largest corrected share decides, ties by language name; it is
the score, between 0 and 1.

The filter is sent to every task where the list is short enough (`LISTED` n-grams, counted before
anything is collected). A longer one stays a table of masks by place, made by a distributed or: the
n-grams of a document, each once, are then joined with it by place. Both ways give the same languages and
scores.

Combining marks (such as vowel signs) belong to the word of the letter before them.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without a language
are not learned from, nor are texts without a letter; with nothing learned every text is `und`;
repeated rows give repeated rows; an empty table gives an empty result; output columns replace
input columns of the same name. Texts of any length are read whole; one longer than a chunk is a chunk of
its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.shared import chunks, code_points, mixed, named, ship, with_text, written

UNKNOWN = "und"
#: Code points per n-gram; words are read with a blank on either side.
N = 3
#: Documents learned from, per language at most (the fit is on a bounded sample).
FIT_ROWS = 20_000
#: Rows of the sample's keys (about 40 bytes each) that are sent to every task; more are shuffled with the texts.
SENT = 500_000
#: Share of the n-gram occurrences of a language that its list covers at least, the most frequent first.
COVER = 0.999
#: An n-gram is listed where its frequency is at least this part of that in its foremost language.
TYPICAL = 0.2
PLACES = 3
#: Places of the filter for each listed n-gram.
ROOM = 16
#: N-grams of all languages (24 bytes each) that the driver takes; their filter has 32 places for each at most.
LISTED = 1_000_000
#: Bytes of a filter that is sent to every task.
FILTER_BYTES = 64 << 20


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(whether a code point is a letter, whether it is a combining mark)."""
    kinds = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)], dtype=np.uint8)
    return kinds == ord("L"), kinds == ord("M")


def _in_words(points: np.ndarray) -> np.ndarray:
    """Which code points belong to words: letters, and marks in a row behind a letter."""
    letters, marks = _letters()
    letter, mark = letters[points], marks[points]
    if mark.any():
        # The last place before each that is no mark decides.
        at = np.maximum.accumulate(np.where(mark, 0, np.arange(len(points))))
        return letter | (mark & letter[at])
    return letter


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, n-grams per text). Everything but letters separates words."""
    lowered = [(t or "").lower() for t in texts]
    points = code_points(" " + " ".join(lowered) + " " * (N - 1)).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    points[~_in_words(points)] = 32
    last = len(points) - N + 1
    # An n-gram may reach over one separator only as its first or last code point.
    inner = np.ones(last, dtype=bool)
    codes = points[:last].copy()
    for i in range(1, N):
        codes |= points[i : i + last] << np.uint64(21 * i)
        if i < N - 1:
            inner &= points[i : i + last] != 32
    ends = np.cumsum(sizes)
    # An n-gram belongs to the text of its middle; the first text starts after one blank.
    at = np.flatnonzero(inner)
    text_of = np.searchsorted(ends, at, side="right")
    inside = text_of < len(texts)
    return codes[at[inside]], np.bincount(text_of[inside], minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # (places, bytes): bit l of a row is language l
    false: np.ndarray  # false positive rate of each language
    size: int = 0  # places, where the masks are not here but in a table (place, byte, mask)
    table: DataFrame | None = None

    def share(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected share of each text and language, n-grams per text)."""
        codes, counts = grams_of(texts)
        hits = np.zeros((len(texts), len(self.languages)))
        if len(codes) and self.languages:
            found = self._lookup(codes)
            text_of = np.repeat(np.arange(len(texts)), counts)
            bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
            for i in range(found.shape[1]):
                seen = np.bincount(text_of * 256 + found[:, i], minlength=256 * len(texts))
                part = seen.reshape(-1, 256) @ bits
                hits[:, 8 * i : 8 * i + 8] = part[:, : hits.shape[1] - 8 * i]
        return self.corrected(hits, counts), counts

    def corrected(self, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        share = hits / np.maximum(counts, 1)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1)

    def _lookup(self, codes: np.ndarray) -> np.ndarray:
        places = places_of(codes, len(self.masks))
        found = self.masks[places[0]]
        for place in places[1:]:
            found &= self.masks[place]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        share, counts = self.share(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        return self.chosen(share, counts)

    def chosen(self, share: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        best = share.argmax(axis=1)
        score = np.where(counts > 0, share[np.arange(len(counts)), best], 0.0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
        return names, score


def places_of(codes: np.ndarray, size: int) -> list[np.ndarray]:
    first = mixed(codes)
    step = mixed(first) | np.uint64(1)
    mask = np.uint64(size - 1)
    return [((first + np.uint64(i) * step) & mask).astype(np.int64) for i in range(PLACES)]


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    fit_rows: int = FIT_ROWS,
    cover: float = COVER,
    typical: float = TYPICAL,
    room: int = ROOM,
) -> Model:
    """Learn from documents with a language: at most `fit_rows` (nearly) of each.

    Of more, every group of equal texts gives its part, rounded up or down by a hash of the text: the
    text is read once and its n-grams count as often as the part says.
    Counting is distributed; the driver gets the n-grams that cover the texts, if they are `LISTED` at most
    and their filter takes `FILTER_BYTES` at most. Otherwise it gets the names of the languages alone.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    plain = [f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    same = [F.xxhash64(text).alias("_t1"), F.crc32(F.col(text)).alias("_t2")]
    rows = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), *same, F.xxhash64(*named(plain)).alias("_row"))
    groups = rows.groupBy("_lang", "_t1", "_t2").agg(F.count("*").alias("_n"), F.min("_row").alias("_row"))
    groups = written(groups, "language-texts")
    sizes = groups.groupBy("_lang").agg(F.sum("_n").alias("_rows"))
    part = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("_rows"))
    point = F.pmod(F.col("_t1"), F.lit(1 << 30)) / float(1 << 30)
    chosen = groups.join(F.broadcast(sizes), "_lang") if _few(sizes) else groups.join(sizes, "_lang")
    chosen = chosen.withColumn("_times", F.floor(F.col("_n") * part + point)).where(F.col("_times") > 0)
    chosen = written(chosen.select("_lang", "_t1", "_t2", "_row", "_times"), "language-sample")
    # One row of each group is joined, so that a group of copies is not gathered.
    key = ["_lang", "_t1", "_t2"]
    if chosen.count() <= SENT:
        chosen = F.broadcast(chosen)
    sample = rows.join(chosen, [*key, "_row"]).dropDuplicates(key).select("_lang", "_text", "_times")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), name))
                for a, b, texts in chunks(own.column(1)):
                    codes, counts = grams_of(texts)
                    times = np.repeat(own.column(2).slice(a, b - a).to_numpy(), counts)
                    codes, which = np.unique(codes, return_inverse=True)
                    n = np.bincount(which, weights=times, minlength=len(codes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(codes), pa.string()),
                            pa.array(codes.astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        names=["lang", "gram", "n"],
                    )

    counted = (
        sample.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counted = written(counted, "language-grams")
    # By how often a gram occurs, so that no window holds all grams of a language.
    levels = counted.groupBy("lang", "n").agg(F.sum("n").alias("occurrences"))
    more = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("before", F.coalesce(F.sum("occurrences").over(more), F.lit(0)))
    levels = levels.withColumn("total", F.sum("occurrences").over(Window.partitionBy("lang")))
    least = levels.where(F.col("before") < cover * F.col("total")).groupBy("lang").agg(F.min("n").alias("least"))
    listed = counted.join(least, "lang").where(F.col("n") >= F.col("least"))
    listed = written(listed.select("lang", "gram", "n"), "language-listed")
    count, languages = listed.agg(F.count("*"), F.count_distinct("lang")).collect()[0]
    if count > LISTED or _size(count, room) * -(-languages // 8) > FILTER_BYTES:
        return build_table(listed, typical, room)
    table = listed.toPandas()
    return build(table["lang"].to_numpy(), table["gram"].to_numpy(), table["n"].to_numpy(), typical, room)


def _few(sizes: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of languages is small enough to send to every task."""
    return sizes.limit(most + 1).count() <= most


def _size(grams: int, room: int) -> int:
    """Places of a filter of so many different n-grams."""
    return 1 << max(10, int(room * grams - 1).bit_length())


def build_table(listed: DataFrame, typical: float, room: int) -> Model:
    """The filter of (lang, gram, n) as a table: bits of each place are or-ed by a grouped aggregation."""
    spark = listed.sparkSession
    languages = sorted(row["lang"] for row in listed.select("lang").distinct().collect())
    if not languages:
        return build(*[np.zeros(0)] * 3, typical, room)
    numbers = spark.createDataFrame(list(enumerate(languages)), "number int, lang string")
    size = _size(listed.select("gram").distinct().count(), room)
    totals = listed.groupBy("lang").agg(F.sum("n").alias("total")).join(numbers, "lang")
    frequent = listed.join(totals, "lang").select("gram", "number", (F.col("n") / F.col("total")).alias("part"))
    foremost = frequent.groupBy("gram").agg(F.max("part").alias("most"))
    kept = frequent.join(foremost, "gram").where(F.col("part") >= typical * F.col("most")).select("gram", "number")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in places_of(batch.column(0).to_numpy().astype(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["place", "number"])

    bits = written(kept.mapInArrow(placed, "place long, number int").distinct(), "language-bits")
    fill = dict(bits.groupBy("number").agg(F.count("*")).collect())
    bit = F.expr("shiftleft(1, number % 8)")
    table = bits.groupBy("place", F.floor(F.col("number") / 8).alias("byte")).agg(F.bit_or(bit).alias("mask"))
    false = np.array([(fill.get(i, 0) / size) ** PLACES for i in range(len(languages))])
    return Model(languages, np.zeros((0, 0), dtype=np.uint8), false, size, written(table, "language-filter"))


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, typical: float, room: int) -> Model:
    languages = sorted(set(lang.tolist()))
    if not languages:
        return Model([], np.zeros((1, 1), dtype=np.uint8), np.zeros(0))
    number = np.searchsorted(np.array(languages, dtype=object), lang).astype(np.int64)
    every, which = np.unique(gram.astype(np.uint64), return_inverse=True)
    totals = np.bincount(number, weights=n)
    frequency = n / totals[number]
    foremost = np.zeros(len(every))
    np.maximum.at(foremost, which, frequency)
    kept = frequency >= typical * foremost[which]
    size = _size(len(every), room)
    masks = np.zeros((size, -(-len(languages) // 8)), dtype=np.uint8)
    bit = (1 << (number[kept] % 8)).astype(np.uint8)
    for place in places_of(every[which[kept]], size):
        np.bitwise_or.at(masks, (place, number[kept] // 8), bit)
    fill = np.array([np.count_nonzero(masks[:, i // 8] >> (i % 8) & 1) for i in range(len(languages))])
    return Model(languages, masks, (fill / size) ** PLACES)


def identify(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    keep: list[str] | None = None,
    lang_out: str = "lang_pred",
    score_out: str = "score",
) -> DataFrame:
    """The columns in `keep` (all, if not given) with the language and its score.

    No shuffle, unless the model is a table.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (lang_out, score_out)]
    frame, fields = with_text(docs, text, kept)
    schema = T.StructType(
        [
            *fields,
            T.StructField(lang_out, T.StringType()),
            T.StructField(score_out, T.DoubleType()),
        ]
    )
    if model.table is not None:
        return _identified_by_join(frame, schema, model)
    # `fit` has checked the size of the masks.
    sent = spark.sparkContext.broadcast((model.languages, model.masks, model.false))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in batches:
            for a, b, texts in chunks(batch.column(0)):
                names, score = known.predict(texts)
                columns = [batch.column(i + 1).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(score)], names=schema.names
                )

    return frame.mapInArrow(run, schema)


def _identified_by_join(frame: DataFrame, schema: T.StructType, model: Model) -> DataFrame:
    """The same as `identify` for (text, kept columns), by a join of n-grams with the table of masks."""
    size, last = model.size, len(frame.columns)
    rows = written(frame.withColumn("_row", F.monotonically_increasing_id()), "language-rows")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(0)):
                codes, counts = grams_of(texts)
                row = np.repeat(batch.column(1).slice(a, b - a).to_numpy(), counts)
                total = np.repeat(counts, counts)
                # Each n-gram of a row once, with how often it occurs.
                order = np.lexsort((codes, row))
                codes, row, total = codes[order], row[order], total[order]
                new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])][: len(codes)])
                times = np.diff(np.r_[new, len(codes)])
                codes, row, total = codes[new], row[new], total[new]
                places = np.sort(np.stack(places_of(codes, size)), axis=0)
                distinct = np.ones(places.shape, dtype=bool)
                distinct[1:] = places[1:] != places[:-1]
                asked = distinct.sum(axis=0)
                for place, one in zip(places, distinct, strict=True):
                    columns = [row, codes.astype(np.int64), times, total, asked, place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[one].astype(np.int64)) for c in columns],
                        names=["_row", "gram", "times", "total", "asked", "place"],
                    )

    asked = rows.select("c0", "_row").mapInArrow(
        looked_up, "_row long, gram long, times long, total long, asked long, place long"
    )
    masks = (
        asked.join(model.table, "place")
        .groupBy("_row", "gram", "byte")
        .agg(
            F.bit_and("mask").alias("mask"), F.count("*").alias("found"), F.any_value("asked").alias("asked"),
            F.any_value("times").alias("times"), F.any_value("total").alias("total"),
        )
        .where("found = asked AND mask <> 0")
    )
    # At most 255 masks of each byte, whatever the length of the text.
    seen = masks.groupBy("_row", "byte", "mask").agg(F.sum("times").alias("times"), F.any_value("total").alias("total"))
    seen = seen.groupBy("_row").agg(
        F.collect_list(F.array("byte", "mask", "times")).alias("_hits"), F.any_value("total").alias("_total")
    )
    # Rows of which no n-gram was found still have their number of n-grams.
    totals = asked.groupBy("_row").agg(F.any_value("total").alias("_grams"))
    joined = rows.join(totals, "_row", "left").join(seen, "_row", "left").drop("_row", "_total")
    names, false = model.languages, model.false

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(names, np.zeros((0, 0), dtype=np.uint8), false)
        for batch in batches:
            hits = np.zeros((batch.num_rows, len(names)))
            counts = pc.fill_null(batch.column(last), 0).to_numpy(zero_copy_only=False)
            for i, found in enumerate(batch.column(last + 1).to_pylist()):
                for byte, mask, times in found or []:
                    for bit in range(8):
                        if mask >> bit & 1:
                            hits[i, 8 * byte + bit] += times
            chosen, score = known.chosen(known.corrected(hits, counts), counts)
            columns = [batch.column(i + 1) for i in range(last - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(chosen, pa.string()), pa.array(score)], names=schema.names
            )

    return joined.mapInArrow(scored, schema)


def usual_scores(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """language, usual: the median score of the labelled documents that are identified as their language."""
    label, score = F.col("language"), F.col("score")
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("language"), F.col(text).alias("text"))
    own = identify(labelled, model, keep=["language"]).where(label == F.col("lang_pred"))
    return written(own.groupBy("language").agg(F.percentile_approx(score, 0.5).alias("usual")), "language-scores")
