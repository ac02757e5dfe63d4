"""Benchmark decontamination by spaced seeds (DataFrame operations only).

Texts are read as lower-case words of letters and digits.  A seed is a fixed mask over ``SPAN`` words:
it hashes the words at its marked places and ignores the others, so a substituted word only spoils the
seeds that look at it.  Seeds of all benchmark items meet the seeds at every place of every document.
A hit fixes how item and document lie against each other; along that diagonal the words are compared
one by one and the best run is scored: a match counts 1, a substitution costs 1.  The pair is reported if
the run scores at least ``LEAST``, or four fifths of the words of a shorter item.

Items of fewer than ``SMALL`` words have masks of their own length.  From ``LOOSE`` words on each mask leaves out one place,
so that one substituted word is tolerated anywhere; items of ``RUN`` words are found word for word.  Shorter ones are
found word for word too, but marked ``brief`` unless they are the whole document, because such words follow each other in any prose.

The seeds of the benchmark go to all executors, in blocks of whole items of at most ``BLOCK`` seeds
(counted first), so that a larger benchmark means more passes over the corpus and never a larger
broadcast.  The corpus is never shuffled: only hits are.

Defined results: null texts and texts without a word match nothing; ties between runs go to the earliest; repeated rows with one doc_id are reported once; null doc_ids are
reported as null; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import settle, table

MASKS, LEAST, RUN, LOOSE, SMALL, BLOCK = ("1101011", "11100101", "10110011"), 10, 4, 5, 10, 500_000
SPAN = max(map(len, MASKS))


def word_hashes(text):
    """The hashes of a text's words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes, at, masks=MASKS):
    """The keys of all masks laid on ``hashes`` at place ``at``."""
    return F.array(*(
        F.xxhash64(F.lit(k), *(F.get(hashes, at + F.lit(j)) for j, mark in enumerate(mask) if mark == "1"))
        for k, mask in enumerate(masks)
    ))


def _placed(rows: DataFrame, column: str, span: int) -> DataFrame:
    """A row for each place of ``column`` where a mask fits."""
    # An outer explode: Spark adds no filter on the size, which would read every text's words twice.
    places = F.when(F.size(column) >= span, F.sequence(F.lit(0), F.size(column) - span))
    return rows.withColumn("at", F.explode_outer(places)).where("at is not null")


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, matched, score, doc_word, item_word, words, brief): the best run of each pair that leaks.

    ``doc_word`` and ``item_word`` are where the run begins, ``words`` its length; ``brief`` marks runs too short to tell a leak.
    """
    span = max(map(len, masks))
    known = settle(items.select("item_id", word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0).distinct())
    small = max(span, SMALL)
    places = F.when(F.size("item") < small, F.size("item")).otherwise((F.size("item") - (span - 1)) * len(masks))
    total = known.agg(F.sum(places).alias("n")).first()["n"] or 0
    sizes = [r["n"] for r in known.where(F.size("item") < small).select(F.size("item").alias("n")).distinct().collect()]  # fewer than small
    blocks = max(1, -(-total // block))
    body = docs.select("doc_id", word_hashes(F.col("text")).alias("doc"))
    probes = _placed(body, "doc", span).select("doc_id", "doc", "at", F.explode(_seeds(F.col("doc"), F.col("at"), masks)).alias("key"))
    # Blocks by the words, not the ids: many items may share an id, or have none.
    parts = [known if blocks == 1 else known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) for k in range(blocks)]
    found = [_block(probes, part.where(F.size("item") >= small), span, masks, least) for part in parts]
    if sizes:
        found += [_short(body, part.where(F.size("item") < small), sorted(sizes)) for part in parts]
    best = F.max_by("run", F.struct("run.score", -F.col("run.doc_word"), -F.col("run.item_word"))).alias("run")
    pairs = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", "run.matched", "run.score", "run.doc_word", "run.item_word", "run.words", F.col("run.brief").alias("brief"))


def _block(probes: DataFrame, items: DataFrame, span: int, masks: tuple[str, ...], least: int) -> DataFrame:
    placed = _placed(items, "item", span).withColumnRenamed("at", "item_at")
    seeds = placed.select("item_id", "item_at", F.explode(_seeds(F.col("item"), F.col("item_at"), masks)).alias("key"))
    # Both sides of a bounded block: at most `block` seeds (or those of a single item), and their items.
    hits = probes.join(F.broadcast(seeds), "key").join(F.broadcast(items.withColumnRenamed("item_id", "_id")), F.expr("item_id <=> _id"))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(F.lit(0), -shift)
    count = F.least(F.size("item"), F.size("doc") - shift) - first
    # Only the stretches along the diagonal go on, once each: the document's words stay behind. They are
    # settled, so that Spark does not move the comparison into the join and copy whole texts for every hit.
    stretches = hits.withColumns({"shift": shift, "first": first, "count": count}).select(
        "doc_id", "item_id", "shift", "first", F.size("item").alias("size"),
        F.slice("doc", F.col("shift") + F.col("first") + 1, F.col("count")).alias("own"),
        F.slice("item", F.col("first") + 1, F.col("count")).alias("other"),
    ).distinct()
    lined = settle(stretches).withColumn("same", F.zip_with("own", "other", lambda x, y: x == y))
    enough = F.least(F.lit(least), F.ceil(F.col("size") * 0.8))
    scored = lined.withColumn("run", _best_run(F.col("same"))).where(F.col("run.score") >= enough)
    return scored.select(
        "doc_id", "item_id",
        F.struct(
            "run.score", "run.matched", (F.col("shift") + F.col("first") + F.col("run.start")).alias("doc_word"),
            (F.col("first") + F.col("run.start")).alias("item_word"), (F.col("run.end") - F.col("run.start")).alias("words"), F.lit(False).alias("brief"),
        ).alias("run"),
    )


def short_masks(size: int) -> list[list[int]]:
    """The places that each mask over an item of so few words looks at."""
    every = list(range(size))
    return [every] if size < LOOSE else [every[:k] + every[k + 1 :] for k in every]


def _short(body: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Items of so many words that stand in a document, but for one word from ``LOOSE`` words on."""

    def seeds(hashes, size: int):
        return F.array(*(F.xxhash64(F.lit(size), F.lit(k), *(F.get(hashes, F.lit(j)) for j in places)) for k, places in enumerate(short_masks(size))))

    def probes(n: int) -> DataFrame:
        # Of each place only its own words go on, not the whole text.
        spots = F.transform(F.sequence(F.lit(0), F.size("doc") - n), lambda at: F.struct(at.alias("at"), F.slice("doc", at + 1, F.lit(n)).alias("own")))
        whole = (F.size("doc") == n).alias("whole")
        placed = body.select("doc_id", whole, F.explode_outer(F.when(F.size("doc") >= n, spots)).alias("spot")).where("spot is not null")
        return placed.select("doc_id", "whole", "spot.at", "spot.own", F.lit(n).alias("n"), F.explode(seeds(F.col("spot.own"), n)).alias("key"))

    own = [items.where(F.size("item") == n).select("item_id", "item", F.explode(seeds(F.col("item"), n)).alias("key")) for n in sizes]
    # A bounded block of the benchmark, with at most SMALL - 1 seeds an item.
    known = F.broadcast(reduce(DataFrame.unionByName, own))
    hits = reduce(DataFrame.unionByName, map(probes, sizes)).join(known, "key").where(F.size("item") == F.col("n"))
    met = hits.select("doc_id", "item_id", "at", "n", "item", "own", "whole").distinct()
    matched = F.size(F.filter(F.zip_with("own", "item", lambda x, y: x == y), lambda same: same))
    scored = met.withColumn("matched", matched).where(F.col("matched") >= F.col("n") - (F.col("n") >= LOOSE).cast("int"))
    brief = (F.col("n") < RUN) & ~F.col("whole")
    run = F.struct((2 * F.col("matched") - F.col("n")).alias("score"), "matched", F.col("at").alias("doc_word"), F.lit(0).alias("item_word"), F.col("n").alias("words"), brief.alias("brief"))
    return scored.select("doc_id", "item_id", run.alias("run"))


def _best_run(same):
    """The best-scoring stretch of matches (+1) and substitutions (-1): start, end, matched, score."""
    part = "struct<start: int, end: int, matched: int, score: int>"
    zero = F.from_json(F.lit('{"start": 0, "end": 0, "matched": 0, "score": 0}'), part)

    def step(state, hit):
        open_, best = state["open"], state["best"]
        begin = open_["score"] <= 0
        grown = F.struct(
            F.when(begin, open_["end"]).otherwise(open_["start"]).alias("start"),
            (open_["end"] + 1).alias("end"),
            (F.when(begin, 0).otherwise(open_["matched"]) + hit.cast("int")).alias("matched"),
            (F.when(begin, 0).otherwise(open_["score"]) + F.when(hit, 1).otherwise(-1)).alias("score"),
        ).cast(part)
        return F.struct(grown.alias("open"), F.when(grown["score"] > best["score"], grown).otherwise(best).alias("best"))

    return F.aggregate(same, F.struct(zero.alias("open"), zero.alias("best")), step, lambda s: s["best"])


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The documents that hold passages of the benchmark, with the items and where they lie."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
