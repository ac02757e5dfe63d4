"""Typo-tolerant search for many queries in one plan.

Words are resolved, not rows: each distinct query word meets the vocabulary once (by prefix, and by
containment where that is thin), the resolved words' postings score the places, and only queries that
stay short of hits have places read in full.  On request (``early``) ranges of places are left out whose
bounds say that no hit can lie there.  All caps hold per query and word, as windows.

The index is stored by what is asked for.  A small batch (at most ``FEW`` distinct words) names its keys in
filters that reach the files, so that a single query reads a few row groups; a large one joins by shuffles.
The results are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import equirectangular_m
from waymark.functions.present import address_parts, display_name, is_area, primary_name
from waymark.functions.similarity import score_pairs
from waymark.functions.text import normalise, words
from waymark.lineage import settle
from waymark.operators.index import KEY_CHARS, Index, bound_range, trigrams
from waymark.schema import LAST_CHAR, SearchParams

FEW, AT_ONCE = 2000, 8
BROADCAST = 200_000  # rows of a batch's own tables, a hundred bytes each


def tokens(queries: DataFrame) -> DataFrame:
    """(query_id, k, i, word): the words of each query with their places; blank queries vanish."""
    split = queries.withColumn("words", words(normalise(F.col("text"))))
    return split.select("query_id", F.size("words").alias("k"), F.posexplode("words").alias("i", "word"))


def few(rows: DataFrame, column: str, most: int = FEW) -> list | None:
    """The distinct values of a column where they are at most ``most``, else None."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    return None if len(found) > most else sorted(r[0] for r in found)


def only(table: DataFrame, column: str, values: list | None) -> DataFrame:
    """``table`` without most rows that have none of a few (sorted) values, for a join that follows.

    Short lists reach the Parquet files value by value, long ones as a few ranges, so that row groups are skipped.
    """
    if values is None:
        return table
    if len(values) <= AT_ONCE:
        return table.where(F.col(column).isin(values))
    step = -(-len(values) // AT_ONCE)
    parts = [values[k : k + step] for k in range(0, len(values), step)]
    return table.where(reduce(Column.__or__, (F.col(column).between(part[0], part[-1]) for part in parts)))


def beside(rows: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``rows`` of the batch (settled), broadcast where they are few, so that the index's table is not shuffled to meet them.

    A checkpoint has lost its size, and Spark would take it for a large one.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def prefix_candidates(asked: DataFrame, prefixes: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(word, candidate, n_chars, places, blob_bytes, rn, run) of each distinct word: shortest first, with running sizes."""
    # Equal leading characters make a hash join of the range; the range keeps its own upper end.
    probe = asked.select("word").distinct().withColumn("key", F.substring("word", F.lit(1), F.lit(KEY_CHARS)))
    keyed = only(prefixes, "key", few(probe, "key"))
    hit = keyed.join(beside(probe), "key").where((F.col("candidate") >= F.col("word")) & (F.col("candidate") < F.concat("word", F.lit(LAST_CHAR))))
    order = Window.partitionBy("word").orderBy("n_chars", "candidate")
    ranked = hit.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= params.max_vocab_words)
    return ranked.withColumn("run", F.sum("places").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("key")


def word_totals(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(word, tot): how many places the capped prefix range of each word has."""
    totals = found.groupBy("word").agg(F.max("run").alias("tot"))
    return asked.select("word").distinct().join(totals, "word", "left").withColumn("tot", F.coalesce("tot", F.lit(0)))


def usable_grams(probe: Column) -> Column:
    """The trigrams that any word containing the probe contains; an underscore stands for any sign in a LIKE pattern."""
    return F.filter(trigrams(probe), lambda g: ~F.contains(g, F.lit("_")))


def by_grams(probes: DataFrame, index: Index, grams: int = 2) -> DataFrame:
    """(word, probe, candidate, blob_bytes): the indexed words that hold the ``grams`` rarest trigrams of each probe (word, probe).

    The rarest one makes a hash join whose size is that of the thinnest list; the lists of the others only thin it out.
    """
    asked = probes.select("word", "probe", F.explode(usable_grams(F.col("probe"))).alias("gram"))
    counts = only(index.gram_counts, "gram", few(asked, "gram"))
    rarest = Window.partitionBy("word").orderBy(F.coalesce("words", F.lit(0)), "gram")
    chosen = asked.join(counts, "gram", "left").withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= grams).select("word", "probe", "gram", "nth")
    chosen = settle(chosen)  # a few rows a word
    held = only(index.grams, "gram", few(chosen, "gram"))
    hit = held.join(beside(chosen.where("nth = 1").drop("nth")), "gram").drop("gram")
    for nth in range(2, grams + 1):
        also = chosen.where(F.col("nth") == nth).select("word", "gram")
        listed = held.join(beside(also), "gram").select("word", "candidate")
        # Probes of a single trigram have no further list.
        hit = hit.join(listed.withColumn("_in", F.lit(1)), ["word", "candidate"], "left").join(also.select("word", F.lit(1).alias("_asked")), "word", "left")
        hit = hit.where("_asked is null or _in is not null").drop("_in", "_asked")
    return hit.select("word", "probe", "candidate", "blob_bytes")


def fuzzy_candidates(totals: DataFrame, index: Index, found: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(word, candidate, blob_bytes, score, ord): indexed words that contain the probe of a thinly resolved word."""
    thin_enough = (F.col("tot") < params.min_confident_places) & (F.col("tot") <= params.max_refs)
    thin = totals.where(thin_enough & (F.length("word") >= params.min_fuzzy_word))
    probe = F.substring("word", F.lit(1), F.greatest(F.lit(params.min_probe), F.length("word") - params.probe_trim))
    like = F.expr("candidate like concat('%', probe, '%')")
    keyed = thin.select("word", probe.alias("probe"))
    hit = by_grams(keyed, index).where(like)
    odd = keyed.where(F.size(usable_grams(F.col("probe"))) == 0)
    if few(odd, "word", 0) is None:
        # Rare: of such probes a single sign is the key; of underscores alone, which only words with one resemble enough, that one.
        sign = F.coalesce(F.get(F.filter(F.split("probe", ""), lambda c: c != "_"), F.lit(0)), F.lit("_"))
        signs = index.vocab.where("n_chars >= 3").select(F.explode(F.array_distinct(F.split("word", ""))).alias("gram"), F.col("word").alias("candidate"), "blob_bytes")
        hit = hit.unionByName(signs.join(odd.withColumn("gram", sign), "gram").where(like).select(*hit.columns))
    fresh = hit.join(found.select("word", "candidate"), ["word", "candidate"], "left_anti")
    scored = score_pairs(fresh.select("word", "candidate", "blob_bytes"), params=params, least=F.lit(params.min_score)).where(F.col("score") >= params.min_score)
    order = Window.partitionBy("word").orderBy("candidate")
    return scored.withColumn("ord", F.lit(1000) + F.row_number().over(order))


def resolve(asked: DataFrame, index: Index, params: SearchParams = SearchParams()) -> DataFrame:
    """(word, candidate, score, exact, ord, names_only): what each distinct word could be, within the caps."""
    found = settle(prefix_candidates(asked, index.prefixes, params))  # capped: at most max_vocab_words a query word
    totals = word_totals(asked, found)
    kept = found.where(F.col("run") <= params.max_refs)
    by_prefix = kept.select("word", "candidate", "blob_bytes", F.lit(1.0).alias("score"), (F.col("candidate") == F.col("word")).alias("exact"), F.col("rn").alias("ord"))
    by_part = fuzzy_candidates(totals, index, kept, params).withColumn("exact", F.lit(False)).select(*by_prefix.columns)
    before = Window.partitionBy("word").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    walked = by_prefix.unionByName(by_part).withColumn("before", F.coalesce(F.sum("blob_bytes").over(before), F.lit(0)))
    capped = totals.select("word", (F.col("tot") > params.max_refs).alias("names_only"))
    return walked.where(F.col("before") <= params.max_refs).join(capped, "word").select("word", "candidate", "score", "exact", "ord", "names_only")


def gain(named: Column, params: SearchParams) -> Column:
    """A candidate's score where it stands in a name, or in the context."""
    return F.when(named, F.col("score")).otherwise(F.col("score") - params.context_penalty)


def tally(asked: DataFrame, resolved: DataFrame, pairs: DataFrame, params: SearchParams = SearchParams(), spans: DataFrame | None = None) -> DataFrame:
    """(query_id, i, place_id, score, exact, ord): each place's best score for each query word.

    With ``spans`` (query_id, range) only places in those ranges of each query, and only postings in them are joined.
    """
    rows = only(pairs, "word", few(resolved, "candidate")).withColumnRenamed("word", "candidate")
    by, at = ["candidate"], ["word"]
    if spans is not None:
        asked, rows = asked.join(spans.select("query_id", "range"), "query_id"), rows.withColumn("range", bound_range(F.col("place_id")))
        resolved = resolved.join(asked.select("word", "range").distinct(), "word")
        by, at = [*by, "range"], [*at, "range"]
    refs = (
        rows.join(beside(resolved), by)
        .where(~F.col("names_only") | F.col("named"))
        .select(*at, "place_id", "ord", gain(F.col("named"), params).alias("score"), (F.col("exact") & F.col("named")).alias("exact"))
    )
    # Of equal scores the first candidate counts; the earliest one that reached the place is kept too.
    best = F.min(F.struct((-F.col("score")).alias("s"), "ord", "exact")).alias("b")
    by_word = refs.groupBy(*at, "place_id").agg(best, F.min("ord").alias("first"))
    return asked.select("query_id", "i", *at).join(by_word, at).select("query_id", "i", "place_id", (-F.col("b.s")).alias("score"), "b.exact", F.col("b.ord").alias("ord"), "first")


def reach(asked: DataFrame, resolved: DataFrame, queries: DataFrame, index: Index, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, range, whole, most): the ranges of places with a hit or a partial one of each query, by what its words can score there.

    ``whole``: every word can reach the threshold, so only there are ranked places.  ``most``: the largest sum of scores.  In ranges
    that are not listed no word reaches the threshold.
    """
    listed = only(index.bounds, "word", few(resolved, "candidate")).withColumnRenamed("word", "candidate").join(resolved, "candidate")
    at_most = listed.where(~F.col("names_only") | F.col("named")).groupBy("word", "range").agg(F.max(gain(F.col("named"), params)).alias("score"))
    by_query = asked.join(at_most, "word").groupBy("query_id", "range", "k").agg(F.sort_array(F.collect_list(F.struct("i", "score"))).alias("s"))
    known = by_query.join(queries.select("query_id", "threshold"), "query_id").withColumn("scores", F.transform("s", lambda x: x["score"]))
    good = F.size(F.filter("scores", lambda x: x >= F.col("threshold")))
    return known.withColumn("good", good).where("good > 0").select("query_id", "range", (F.col("good") == F.col("k")).alias("whole"), total("scores").alias("most"))


def grid(tallied: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, place_id, k, scores, exact_count, first): dense scores of each place that any word reached."""
    gathered = tallied.groupBy("query_id", "place_id").agg(
        F.collect_list(F.struct("i", "score")).alias("hits"), F.count_if("exact").alias("exact_count"), F.min(F.struct("i", F.col("first").alias("ord"))).alias("first")
    )
    sized = gathered.join(asked.groupBy("query_id").agg(F.max("k").alias("k")), "query_id")
    at = lambda i: F.coalesce(F.get(F.filter("hits", lambda h: h["i"] == i), F.lit(0))["score"], F.lit(0.0))
    return sized.select("query_id", "place_id", "k", F.transform(F.sequence(F.lit(0), F.col("k") - 1), at).alias("scores"), "exact_count", "first")


def total(scores: str) -> Column:
    """The sum in order, so that it equals a sequential one bit for bit."""
    return F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)


def classified(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """``scored`` with the query's ``lim`` and ``threshold`` and ``kind``: ranked, partial or null."""
    asked = scored.join(queries.select("query_id", "lim", "threshold"), "query_id")
    low, high = F.array_min("scores"), F.array_max("scores")
    return asked.withColumn("kind", F.when(low >= F.col("threshold"), "ranked").when(high >= F.col("threshold"), "partial"))


def complete(kinds: DataFrame, asked: DataFrame, by_place: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Partly matched places of queries that lack hits, with their open words judged against all their words.

    The result has the columns of ``kinds`` and ``pn``, the place's rank among the partial ones.
    """
    ranked = kinds.where("kind = 'ranked'").groupBy("query_id").agg(F.count("*").alias("nr"))
    short = kinds.where("kind = 'partial'").join(ranked, "query_id", "left").where(F.coalesce("nr", F.lit(0)) < F.col("lim"))
    order = Window.partitionBy("query_id").orderBy(F.col("sum").desc(), "first", "place_id")
    read = short.withColumn("sum", total("scores")).withColumn("pn", F.row_number().over(order)).where(F.col("pn") <= params.max_incomplete)
    read = settle(read)  # at most max_incomplete places a query
    ids = few(read, "place_id")
    if ids == []:
        return read.select(*kinds.columns, "pn")
    open_ = read.select("query_id", "place_id", "threshold", F.posexplode("scores").alias("i", "s")).where("s < threshold").select("query_id", "place_id", "i", "threshold")
    terms = only(by_place, "place_id", ids).select("place_id", F.col("word").alias("candidate")).join(beside(open_.select("place_id").distinct()), "place_id")
    first = lambda c: F.substring(c, 1, 1)
    worded = open_.join(asked.select("query_id", "i", "word"), ["query_id", "i"])
    judged = terms.withColumn("f", first("candidate")).join(worded.withColumn("f", first("word")), ["place_id", "f"])
    # Scores below the lowest threshold change no hit.
    distinct = score_pairs(judged.groupBy("word", "candidate").agg(F.min("threshold").alias("threshold")), params=params, least=F.col("threshold")).drop("threshold")
    best = judged.join(distinct, ["word", "candidate"]).groupBy("query_id", "place_id", "i").agg(F.max("score").alias("s"))
    filled = best.groupBy("query_id", "place_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("new"))
    joined = read.join(filled, ["query_id", "place_id"], "left")
    again = F.transform("scores", lambda s, i: F.when(s >= F.col("threshold"), s).otherwise(F.coalesce(F.try_element_at("new", i), F.lit(0.0))))
    done = joined.withColumn("scores", again).where(F.array_min("scores") >= F.col("threshold"))
    return done.select(*kinds.columns, "pn")


def rank(kinds: DataFrame, completed: DataFrame, asked: DataFrame, places: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Hits in order: the lossy prefilter on the mean score, then the five keys, then the limit."""
    straight = kinds.where("kind = 'ranked'").select("*", F.lit(0).alias("pn"), F.lit(0).alias("stage"))
    every = straight.unionByName(completed.withColumn("stage", F.lit(1))).withColumn("score", total("scores") / F.col("k"))
    if not params.exact_topk:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "stage", "pn", "first", "place_id")
        every = every.withColumn("_pf", F.row_number().over(order)).where(F.col("_pf") <= F.col("lim") * params.prefilter).drop("_pf")
    every = settle(every)  # at most lim * prefilter places a query, without exact_topk
    # What orders the hits is narrow; whole addresses are joined to the last hits only.
    shown = places.select("place_id", primary_name(display_name(F.col("name"), F.col("context"))).alias("name"), "category", "lon", "lat")
    origin = queries.select("query_id", F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    hits = shown.join(beside(every), "place_id").join(origin, "query_id").withColumns({
        "is_area": is_area(F.col("category")),
        "metres": equirectangular_m(F.col("olat"), F.col("olon"), F.col("lat"), F.col("lon")),
    })
    order = Window.partitionBy("query_id").orderBy(
        F.col("exact_count").desc(), F.col("is_area").desc(), F.col("score").desc(), F.coalesce("metres", F.lit(0.0)), "name", "place_id"
    )
    asked_words = asked.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("words"))
    last = hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= F.col("lim")).join(asked_words, "query_id")
    last = settle(last)  # at most lim a query
    last = places.select("place_id", F.col("name").alias("_name"), F.col("context").alias("_context")).join(beside(last), "place_id")
    last = last.withColumn("address", address_parts(display_name(F.col("_name"), F.col("_context"))))
    matched = F.zip_with("words", "scores", lambda w, s: F.struct(w.alias("word"), s.alias("score")))
    return last.select("query_id", "pos", "place_id", "score", F.col("exact_count").cast("int").alias("exact_count"), "is_area", "name", "address", matched.alias("matched"), "lon", "lat", "metres")


def judged_places(index: Index, queries: DataFrame, params: SearchParams = SearchParams()) -> tuple[DataFrame, DataFrame]:
    """The query words, and the places that are ranked or partly matched.

    Each step's result is read several times by the next, so it is settled once.
    """
    asked = settle(tokens(queries))
    resolved = settle(resolve(asked, index, params))
    return asked, _kinds(asked, resolved, queries, index, params)


def _kinds(asked: DataFrame, resolved: DataFrame, queries: DataFrame, index: Index, params: SearchParams, spans: DataFrame | None = None) -> DataFrame:
    scored = grid(tally(asked, resolved, index.pairs, params, spans), asked)
    return settle(classified(scored, queries).where("kind is not null"))


def needed_places(index: Index, queries: DataFrame, params: SearchParams = SearchParams(), early: bool = False) -> tuple[DataFrame, DataFrame]:
    """Like :func:`judged_places`, without partly matched places that no hit can come from.

    With ``early``, first only ranges of places in which every word can reach the threshold are read.  Queries that have
    their hits then need no partial ones; for the others the rest is read, except ranges whose largest sum lies below the
    ``max_incomplete``-th partial one already found.  It pays where most queries find enough hits; the hits are the same.
    """
    asked = settle(tokens(queries))
    resolved = settle(resolve(asked, index, params))
    if not early:
        return asked, _kinds(asked, resolved, queries, index, params)
    ranges = settle(reach(asked, resolved, queries, index, params))
    kinds = _kinds(asked, resolved, queries, index, params, ranges.where("whole"))
    rest = settle(still_open(ranges, kinds, queries, params))
    if few(rest, "query_id", 0) is None:
        kinds = kinds.unionByName(_kinds(asked, resolved, queries, index, params, rest))
    return asked, kinds


def still_open(ranges: DataFrame, kinds: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, range): the ranges not yet read that could give a query without enough ranked places another partial one."""
    ranked = kinds.where("kind = 'ranked'").groupBy("query_id").agg(F.count("*").alias("nr"))
    short = queries.select("query_id", "lim").join(ranked, "query_id", "left").where(F.coalesce("nr", F.lit(0)) < F.col("lim")).select("query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("sum").desc())
    partial = kinds.where("kind = 'partial'").join(short, "query_id").select("query_id", total("scores").alias("sum"))
    floor = partial.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == params.max_incomplete).select("query_id", F.col("sum").alias("floor"))
    return ranges.where("not whole").join(short, "query_id").join(floor, "query_id", "left").where("floor is null or most >= floor").select("query_id", "range")


def search(index: Index, queries: DataFrame, params: SearchParams = SearchParams(), early: bool = False) -> DataFrame:
    """Ranked hits of ``queries`` (query_id, text, lim, threshold, lat, lon); lat and lon null without an origin."""
    asked, kinds = needed_places(index, queries, params, early)
    return rank(kinds, complete(kinds, asked, index.by_place, params), asked, index.places, queries, params)


def primary_and_related(hits: DataFrame, most_related: int = 30) -> DataFrame:
    """``hits`` with ``part``: if the first hit is exact, exact hits are primary and the first others related."""
    whole = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = hits.withColumn("_lead", F.first("exact_count").over(whole) > 0)
    inexact = Window.partitionBy("query_id", F.col("exact_count") > 0).orderBy("pos")
    ranked = lead.withColumn("_n", F.row_number().over(inexact))
    part = F.when(~F.col("_lead") | (F.col("exact_count") > 0), "primary").when(F.col("_n") <= most_related, "related")
    return ranked.withColumn("part", part).where("part is not null").drop("_lead", "_n")
