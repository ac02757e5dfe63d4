"""The word index: which places hold a word, in their name or in their context.

The exploded pairs are the primary form, so that a word that very many places hold is never one row.
Sizes of the compressed postings, which the search's caps refer to, are added up over ranges of places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import romanisations, with_word_sets
from waymark.lineage import children, exists, read_text, remove, replace_text

RANGE_BITS, BOUND_BITS, KEY_CHARS = 12, 7, 3


def terms(places: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``places`` (place_id, name, context) with ``name_terms`` and ``context_terms``, sorted word sets.

    With ``names`` (place_id, ord, name) all variants of a place's name count.
    """
    if names is not None:
        joined = names.groupBy("place_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda n: n["name"]), " ").alias("_names"))
        places = places.join(joined, "place_id", "left")
    latin = F.array_join(F.transform(romanisations(F.col("context")), lambda r: r["value"]), " ")
    # Each text is a column before it is folded: folding names it several times.
    texts = places.withColumns({
        "_own": F.coalesce(F.col("_names"), F.col("name")) if names is not None else F.col("name"), "_around": F.concat_ws(" ", "context", latin),
    })
    out = with_word_sets(texts, {"name_terms": "_own", "_around_words": "_around"})
    return out.withColumn("context_terms", F.array_except("_around_words", "name_terms")).drop("_names", "_own", "_around", "_around_words")


def pairs(termed: DataFrame) -> DataFrame:
    """(word, place_id, named): one row for each word of each place."""
    marked = lambda terms, named: F.transform(terms, lambda w: F.struct(w.alias("word"), F.lit(named).alias("named")))
    # An outer explode: Spark adds no filter on the size, which would find every text's words once more.
    every = termed.select("place_id", F.explode_outer(F.concat(marked("name_terms", True), marked("context_terms", False))).alias("term"))
    return every.where("term is not null").select("term.word", "place_id", "term.named")


def packed_ref(place_id: Column, named: Column) -> Column:
    return F.shiftleft(place_id, 1).bitwiseOR(named.cast("bigint"))


def unpacked_ref(ref: Column) -> tuple[Column, Column]:
    return F.shiftright(ref, 1), ref.bitwiseAND(F.lit(1)) == 1


def varint_bytes(delta: Column) -> Column:
    """Bytes of a non-negative number at seven bits a byte."""
    return F.lit(1) + sum(((delta >= (1 << 7 * k)).cast("int") for k in range(1, 10) if 7 * k < 63), F.lit(0))


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(word, n_chars, places, blob_bytes) of each word; blob_bytes is the size of its delta-coded postings."""
    # Deltas inside (word, range of places): no word's postings meet in one task.
    parts = map_runs(pairs, _sizes, "word string, range bigint, n bigint, low bigint, high bigint, bytes bigint")
    along = Window.partitionBy("word").orderBy("range")
    first = varint_bytes(F.col("low") - F.coalesce(F.lag("high").over(along), F.lit(0)))
    return (
        parts.withColumn("first", first).groupBy("word")
        .agg(F.sum("n").alias("places"), F.sum(F.col("bytes") + F.col("first")).cast("bigint").alias("blob_bytes"))
        .select("word", F.length("word").alias("n_chars"), "places", "blob_bytes")
    )


def _sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(word, range, n, low, high, bytes) of runs: their ends, and the bytes of the steps between."""
    lists = batch.column(3)
    refs, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    some = np.diff(bounds) > 0
    steps = np.diff(refs, prepend=0)
    size = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    size[bounds[:-1][some]] = 0  # the first of each run
    total = np.r_[0, np.cumsum(size)]
    end = lambda at: pa.array(np.r_[refs, 0][np.where(some, at, len(refs))], mask=~some)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), end(bounds[:-1]), end(bounds[1:] - 1), pa.array(np.diff(total[bounds]))], names=["word", "range", "n", "low", "high", "bytes"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, range, places, postings) for rows (word, ref) in that order; a run that goes on in the next batch waits for it."""
    rest = None
    for batch in chain(batches, (None,)):
        parts = [b for b in (rest, batch) if b is not None and len(b)]
        if not parts:
            continue
        word, ref = (pa.concat_arrays([b.column(k) for b in parts]) for k in (0, 1))
        refs = ref.fill_null(0).to_numpy()
        ranges = np.where(ref.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, refs >> RANGE_BITS)
        new = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False) | (ranges[1:] != ranges[:-1])
        starts = np.r_[0, np.flatnonzero(new) + 1, len(ref)]
        if batch is not None:  # the last run may go on
            starts, rest = starts[:-1], pa.RecordBatch.from_arrays([word[starts[-2] :], ref[starts[-2] :]], names=["word", "ref"])
        if len(starts) > 1:
            first = pa.array(starts[:-1])
            blank = ranges[starts[:-1]] == np.iinfo(np.int64).min
            held = np.ones(starts[-1], dtype=bool)
            counts = np.diff(starts)
            held[np.repeat(blank, counts)] = False
            bounds = pa.array(np.r_[0, np.cumsum(np.where(blank, 0, counts))], pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(refs[: starts[-1]][held]))
            yield pa.RecordBatch.from_arrays([word.take(first), pa.array(ranges[starts[:-1]], mask=blank), pa.array(counts), lists], names=["word", "range", "places", "postings"])


def map_runs(pairs: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` of Arrow batches (word, range, places, postings) of ``pairs``: one row for each word and range of places, refs ascending.

    Spark deals out and sorts the refs; a task reads them in a stream and holds no more than a batch and one range of a word.
    """
    refs = pairs.select("word", packed_ref(F.col("place_id"), F.col("named")).alias("ref"))
    dealt = refs.repartition("word", F.shiftright("ref", RANGE_BITS)).sortWithinPartitions("word", "ref")
    return dealt.mapInArrow(lambda batches: map(run, _runs(batches)), schema)


def postings(pairs: DataFrame) -> DataFrame:
    """(word, range, places, postings): the array form, one row for each word and range of places, so that no array outgrows its range."""
    return map_runs(pairs, lambda batch: batch, "word string, range bigint, places bigint, postings array<bigint>")


def unpack_postings(posted: DataFrame) -> DataFrame:
    """Back to (word, place_id, named)."""
    place, named = unpacked_ref(F.col("ref"))
    return posted.select("word", F.explode("postings").alias("ref")).select("word", place.alias("place_id"), named.alias("named"))


def prefixes(vocab: DataFrame) -> DataFrame:
    """(key, candidate, n_chars, places, blob_bytes): each word under its first one to ``KEY_CHARS`` characters."""
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(KEY_CHARS)), lambda n: F.substring("word", F.lit(1), n)))
    return vocab.select(F.explode(keys).alias("key"), F.col("word").alias("candidate"), "n_chars", "places", "blob_bytes")


def bound_range(place_id: Column) -> Column:
    """The range of places that a row of :func:`bounds` speaks of."""
    return F.shiftright(place_id, BOUND_BITS)


def bounds(pairs: DataFrame) -> DataFrame:
    """(word, range, refs, named): how many places of a range hold a word, and whether any does in its name: what a search can gain there at most."""
    return pairs.groupBy("word", bound_range(F.col("place_id")).alias("range")).agg(F.count("*").alias("refs"), F.bool_or("named").alias("named"))


def trigrams(word: Column) -> Column:
    """The distinct runs of three characters of a word that has so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda k: F.substring(word, k, F.lit(3))))


def grams(vocab: DataFrame) -> DataFrame:
    """(gram, candidate, blob_bytes): each word under its trigrams."""
    long = vocab.where("n_chars >= 3")
    return long.select(F.explode(trigrams(F.col("word"))).alias("gram"), F.col("word").alias("candidate"), "blob_bytes")


def gram_counts(grams: DataFrame) -> DataFrame:
    """(gram, words): how many words hold each trigram, so that a search can begin with the rarest."""
    return grams.groupBy("gram").agg(F.count("*").alias("words"))


CURRENT = "CURRENT"


def write_index(termed: DataFrame, folder: str) -> None:
    """The tables of an index as Parquet, each ranged and sorted by what it is asked for, so that a search reads few row groups.

    They go to a new version folder, and one small file that names it is put in place last: until then, and if the work
    fails, readers see the index of before.  The version before stays for searches under way; older ones are removed.
    """
    spark = termed.sparkSession
    before = current_version(spark, folder)
    version = f"version-{uuid4().hex}"

    def save(table: DataFrame, name: str, *order: str) -> DataFrame:
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/{version}/{name}")
        return spark.read.parquet(f"{folder}/{version}/{name}")

    try:
        termed.write.parquet(f"{folder}/{version}/places")
        places = spark.read.parquet(f"{folder}/{version}/places")
        saved = save(pairs(places), "pairs", "word", "place_id")
        # Whole places are ranged, and their words put in order inside each row: the exploded pairs need no second shuffle and sort.
        ranged = places.select("place_id", F.array_sort(F.concat("name_terms", "context_terms")).alias("words")).repartitionByRange("place_id").sortWithinPartitions("place_id")
        ranged.select("place_id", F.explode("words").alias("word")).write.parquet(f"{folder}/{version}/by_place")
        save(bounds(saved), "bounds", "word", "range")
        vocab = save(vocabulary(saved), "vocab", "word")
        save(prefixes(vocab), "prefixes", "key", "candidate")
        save(gram_counts(save(grams(vocab), "grams", "gram", "candidate")), "gram_counts", "gram")
    except BaseException:
        remove(spark, f"{folder}/{version}")
        raise
    replace_text(spark, f"{folder}/{CURRENT}", f"{version}\n{before or ''}\n")
    if before and (older := _versions(spark, folder) - {version, before}):
        for name in older:
            remove(spark, f"{folder}/{name}")


def current_version(spark, folder: str) -> str | None:
    """The version that readers see, or None where there is none."""
    return read_text(spark, f"{folder}/{CURRENT}").split("\n")[0] if exists(spark, f"{folder}/{CURRENT}") else None


def _versions(spark, folder: str) -> set[str]:
    return {name for name in children(spark, folder) if name.startswith("version-")}


class Index:
    """An index on disk, or in the making: places (place_id, name, context, …), pairs, and its other tables."""

    TABLES = ("places", "pairs", "vocab", "prefixes", "grams", "by_place", "gram_counts", "bounds")

    def __init__(self, places: DataFrame, pairs: DataFrame, vocab: DataFrame, prefixes: DataFrame, grams: DataFrame, by_place: DataFrame, gram_counts: DataFrame, bounds: DataFrame):
        self.places, self.pairs, self.vocab, self.prefixes, self.grams, self.by_place, self.gram_counts, self.bounds = places, pairs, vocab, prefixes, grams, by_place, gram_counts, bounds

    @classmethod
    def of(cls, termed: DataFrame) -> "Index":
        exploded = pairs(termed)
        vocab = vocabulary(exploded)
        held = grams(vocab)
        return cls(termed, exploded, vocab, prefixes(vocab), held, exploded.select("place_id", "word"), gram_counts(held), bounds(exploded))

    @classmethod
    def open(cls, spark, folder: str) -> "Index":
        version = current_version(spark, folder)
        if version is None:
            raise FileNotFoundError(f"no index in {folder}")
        return cls(*(spark.read.parquet(f"{folder}/{version}/{name}") for name in cls.TABLES))

    @classmethod
    def open_stored(cls, spark, folder: str | None) -> "Index | None":
        """The index of a remembered folder, or None where it is gone or unreadable."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException

        if not folder:
            return None
        try:
            found = cls.open(spark, folder)
            for name in cls.TABLES:  # a damaged file shows when it is read
                getattr(found, name).limit(1).collect()
            return found
        except (PySparkException, Py4JJavaError, FileNotFoundError):
            return None
