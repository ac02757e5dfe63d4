"""The word index and the search, against a plain model of both."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from waymark.operators import index, search
from waymark.schema import LAST_CHAR, QUERY, SearchParams


def encoded_size(refs):
    size, last = 0, 0
    for ref in refs:
        delta, last = ref - last, ref
        size += max(1, -(-delta.bit_length() // 7))
    return size


def similarity(word, candidate, gap=3):
    if candidate.startswith(word):
        return 1.0
    if word in candidate:
        return 0.9
    return 0.0 if abs(len(word) - len(candidate)) > gap else SequenceMatcher(None, word, candidate, autojunk=False).ratio()


class Model:
    """What the search means, in loops: (place -> name words, context words)."""

    def __init__(self, places, params):
        self.places, self.p = places, params
        self.refs = {}
        for place, (name, around, *_) in places.items():
            for w in name:
                self.refs.setdefault(w, []).append((place, True))
            for w in around - name:
                self.refs.setdefault(w, []).append((place, False))

    def resolve(self, word):
        p, out, total = self.p, [], 0
        for w in sorted((w for w in self.refs if word <= w < word + LAST_CHAR), key=lambda w: (len(w), w))[: p.max_vocab_words]:
            total += len(self.refs[w])
            if total > p.max_refs:
                return out, True
            out.append((w, 1.0, w == word))
        if total < p.min_confident_places and len(word) >= p.min_fuzzy_word:
            probe, known = word[: max(p.min_probe, len(word) - p.probe_trim)], {w for w, _, _ in out}
            for w in sorted(self.refs):
                if probe in w and w not in known and similarity(word, w) >= p.min_score:
                    out.append((w, similarity(word, w), False))
        return out, False

    def search(self, words, limit, threshold):
        p, scores, exact, first = self.p, {}, {}, {}
        for i, word in enumerate(words):
            found, names_only = self.resolve(word)
            walked = 0
            for k, (w, score, same) in enumerate(found):
                refs = sorted((place * 2 + named, place, named) for place, named in self.refs[w])
                for _, place, named in refs:
                    if names_only and not named:
                        continue
                    here = score if named else score - p.context_penalty
                    scores.setdefault(place, [0.0] * len(words))
                    exact.setdefault(place, [False] * len(words))
                    first.setdefault(place, (i, k))
                    if here > scores[place][i]:
                        scores[place][i], exact[place][i] = here, named and same
                walked += encoded_size([r[0] for r in refs])
                if walked > p.max_refs:
                    break
        order = sorted(scores, key=lambda x: (first[x], x))
        ranked = [(x, scores[x]) for x in order if min(scores[x]) >= threshold]
        if len(ranked) < limit:
            partial = [x for x in order if min(scores[x]) < threshold <= max(scores[x])]
            for x in sorted(partial, key=lambda x: -sum(scores[x]))[: p.max_incomplete]:
                hay = self.places[x][0] | self.places[x][1]
                new = [s if s >= threshold else max((similarity(words[i], w) for w in hay if w[:1] == words[i][:1]), default=0.0) for i, s in enumerate(scores[x])]
                if min(new) >= threshold:
                    ranked.append((x, new))
        best = sorted(ranked, key=lambda h: -sum(h[1]) / len(words))[: limit * p.prefilter]
        hits = [(-sum(exact[x]), not self.places[x][3].startswith("place="), -sum(s) / len(words), self.places[x][2], x) for x, s in best]
        return [h[-1] for h in sorted(hits)[:limit]]


def build(spark, places):
    rows = [(k, name, "", category, 23.4, 48.8, sorted(own), sorted(around - own)) for k, (own, around, name, category) in places.items()]
    termed = spark.createDataFrame(rows, "place_id long, name string, context string, category string, lon double, lat double, name_terms array<string>, context_terms array<string>")
    return index.Index.of(termed.repartition(3))


def ask(spark, idx, queries, params=SearchParams()):
    frame = spark.createDataFrame([(k, q, lim, 0.6, None, None) for k, (q, lim) in enumerate(queries)], QUERY)
    out = {}
    for r in sorted(search.search(idx, frame, params).collect(), key=lambda r: (r["query_id"], r["pos"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_two_places(spark):
    places = {1: ({"славсько"}, set(), "Славсько", "place=town"), 2: ({"медовий", "двір"}, {"славсько"}, "Медовий двір", "tourism=hotel")}
    hits = ask(spark, build(spark, places), [("Славсько", 20), ("Медовий двір", 20), ("сладьско", 20), ("", 20), ("  !", 5)])
    assert hits[0][0]["name"] == "Славсько" and hits[0][0]["exact_count"] == 1
    assert hits[1][0]["name"] == "Медовий двір"
    assert 3 not in hits and 4 not in hits


@pytest.mark.parametrize("caps", [{}, {"max_refs": 30, "max_vocab_words": 6, "max_incomplete": 5, "prefilter": 2}])
def test_search_equals_the_model(spark, caps):
    rng = random.Random(7)
    stems = ["alder", "aldersea", "bridge", "bridgend", "castle", "castlegate", "harbour", "harborough", "meadow", "meadowhall", "north", "northgate", "winter"]
    places = {}
    for k in range(1, 90):
        own = set(rng.sample(stems, rng.randint(1, 3)))
        places[k] = (own, set(rng.sample(stems, rng.randint(0, 3))), " ".join(sorted(own)), rng.choice(["place=town", "shop=x"]))
    params = SearchParams(**caps)
    model, idx, queries = Model(places, params), build(spark, places), []
    for _ in range(40):
        words = [rng.choice(stems) for _ in range(rng.randint(1, 3))]
        words = [w if rng.random() < 0.5 else w[:-2] + rng.choice("xyz") + w[-1] if rng.random() < 0.6 else w[: rng.randint(1, 4)] for w in words]
        queries.append((" ".join(words), rng.choice([1, 3, 20])))
    got = ask(spark, idx, queries, params)
    for k, (text, limit) in enumerate(queries):
        assert [r["place_id"] for r in got.get(k, [])] == model.search(text.split(), limit, 0.6), text


def test_postings(spark):
    rng = random.Random(3)
    rows = [(w, p, bool(rng.getrandbits(1))) for w in ("a", "b", "c") for p in rng.sample(range(1, 3_000_000), 150)]
    pairs = spark.createDataFrame(rows, "word string, place_id long, named boolean")
    posted = index.postings(pairs)
    assert {tuple(r) for r in index.unpack_postings(posted).collect()} == set(rows)
    assert all(len(r["postings"]) == r["places"] and {x >> index.RANGE_BITS for x in r["postings"]} == {r["range"]} for r in posted.collect())
    whole = {}
    for r in sorted(posted.collect(), key=lambda r: r["range"]):
        whole[r["word"]] = whole.get(r["word"], []) + list(r["postings"])
    sizes = {w: encoded_size(refs) for w, refs in whole.items()}
    assert {r["word"]: r["blob_bytes"] for r in index.vocabulary(pairs).collect()} == sizes


def test_index_round_trip_and_missing_index(spark, tmp_path):
    places = {1: ({"alpha"}, {"beta"}, "Alpha", "shop=x")}
    built = build(spark, places)
    index.write_index(built.places, str(tmp_path / "i"))
    opened = index.Index.open_stored(spark, str(tmp_path / "i"))
    assert {tuple(r) for r in opened.pairs.collect()} == {tuple(r) for r in built.pairs.collect()}
    assert index.Index.open_stored(spark, str(tmp_path / "none")) is None and index.Index.open_stored(spark, None) is None
    for part in (tmp_path / "i").glob("version-*/vocab/*.parquet"):
        part.write_bytes(b"damaged")
    for sums in (tmp_path / "i").glob("version-*/vocab/.*.crc"):
        sums.unlink()
    assert index.Index.open_stored(spark, str(tmp_path / "i")) is None


def test_primary_and_related(spark):
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 0), (2, 1, 0), (2, 2, 1)], "query_id int, pos int, exact_count int")
    got = {(r["query_id"], r["pos"]): r["part"] for r in search.primary_and_related(hits, 1).collect()}
    assert got == {(1, 1): "primary", (1, 2): "related", (2, 1): "primary", (2, 2): "primary"}


def test_range_plan_is_a_hash_join(spark):
    places = {1: ({"alpha"}, {"beta"}, "Alpha", "shop=x")}
    asked = spark.createDataFrame([("al",)], "word string")
    plan = search.prefix_candidates(asked, build(spark, places).prefixes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert F.col("x") is not None
