"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by joining pieces.

A text is cut into words by the tokenizer's pattern.  A word that is a token is its id.  Else its bytes, written in
hexadecimal, are parts that a fold of higher-order functions merges: in each step the adjacent parts whose
joined bytes have the lowest rank become one.  Ranks are read from a constant map, dealt into slots by a hash
so that a look-up takes constant time.

The distinct words that a sample of ``SAMPLE`` rows holds (the commonest ``REMEMBERED`` of them) are folded once, and go to the tasks as
one bounded table; the few occurrences of other words are folded where they stand, by the same fold.  What is remembered
only saves work: no id depends on it.  Words are looked up among the ``COMMON`` commonest first, since a hash table of all is
costly to build.  Documents are neither shuffled nor written.  Ids are put together, and decoded by joining their binary
pieces, as whole Arrow arrays.

Short words merge the leftmost lowest pair in each step.  Longer ones merge all pairs of the lowest rank at once, so that a
run of a million equal signs takes twenty steps; that gives the same parts, unless a merged part has a
lower rank with a neighbour, and where the ranks allow that it is looked for, and if found only the leftmost pair is merged.  Long words of
very many different pairs still cost steps times length.

Spark's regular expressions may know fewer letters and digits than the tokenizer's; both are asked for all code points, and
the pattern is completed by the difference.

Defined results: a null text is an empty one, without ids; repeated rows are encoded each; null doc_ids pass; an empty table
gives no rows; other columns pass through, but those called ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._common import lean, table

RANKS, SLOTS, SHORT, ROUND = "byte_bpe_multi_50k.tiktoken", 1 << 15, 32, 64
REMEMBERED, SAMPLE, LONGEST, AT_ONCE = 1 << 20, 50_000, 64, 1 << 19
COMMON, TOGETHER = 1 << 16, 8
PLACE, NONE, MARK, MOST = 8, 1 << 40, 1 << 62, 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines (token in base 64, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def uneasy(ranks: dict[bytes, int]) -> set[bytes]:
    """The tokens that, joined with a neighbouring token, can have a lower rank than their own."""
    found = set()
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = token[:k], token[k:]
            if left in ranks and right in ranks:
                found.update(part for part in (left, right) if ranks[part] > rank)
    return found


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant_map(entries: dict[str, object], kind: str) -> Column:
    """A constant map from strings to values of type ``kind``, for :func:`look_up`."""
    from xxhash import xxh64_intdigest

    slots: list[dict[str, object]] = [{} for _ in range(SLOTS)]
    for key, value in entries.items():
        slots[xxh64_intdigest(key.encode(), 42) % SLOTS][key] = value  # Spark's xxhash64
    return F.from_json(F.lit(json.dumps(slots)), f"array<map<string, {kind}>>")


def look_up(held: Column, key: Column) -> Column:
    """The value of ``key``, or null."""
    return F.try_element_at(F.get(held, F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1)).cast("int")), key)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Twice the rank of each token in hexadecimal, and one more if it is uneasy."""
    odd = uneasy(ranks)
    return constant_map({t.hex().upper(): 2 * r + (t in odd) for t, r in ranks.items()}, "int")


@dataclass(frozen=True)
class Merges:
    """The fold of a :func:`rank_map` over words in hexadecimal."""

    held: Column

    def rank(self, piece: Column) -> Column:
        return look_up(self.held, piece)

    def _parts(self, word: Column) -> Column:
        """(parts, ranks of neighbouring parts) at the start: single bytes."""
        signs = F.regexp_extract_all(word, F.lit(".."), F.lit(0))  # one pass: substrings of a long text would count its signs again and again
        return bound(signs, lambda parts: F.struct(parts.alias("parts"), F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda a, b: self.rank(F.concat(a, b))).alias("ranks")))

    def _short(self, word: Column) -> Column:
        """The ids of a word of at most ``MOST`` bytes: its leftmost pair of the lowest rank merges in each step.

        The state is an array of numbers: a mask of the bytes where parts start, above all others by ``MARK``, then for each part the rank of
        it with the next one, or ``NONE``, and behind that the byte where it starts.  So the least number is the leftmost lowest pair,
        parts are cut from the word, and the mask tells a part's place; lambdas copy what they return, which costs little for numbers.
        """
        size = F.shiftright(F.length(word), 1)
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
        start = lambda number: number.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
        piece = lambda low, high: F.substr(word, 2 * low + 1, 2 * (high - low))
        none = lambda low: F.lit(NONE) + low

        def pair(low: Column, high: Column) -> Column:
            return F.coalesce(F.shiftleft(self.rank(piece(low, high)).cast("bigint"), PLACE), F.lit(NONE)) + low

        def merged(state: Column, low: Column, at: Column) -> Column:
            end = lambda k: F.coalesce(start(F.get(state, k)), size)
            mask = F.get(state, F.lit(0)) - bit(start(F.get(state, at + 1)))
            new = F.when(at + 2 < F.size(state), pair(low, end(at + 3))).otherwise(none(low))
            rest = F.slice(state, at + 3, F.size(state))
            met = bound(start(F.get(state, at - 1)), lambda before: pair(before, end(at + 2)))
            return F.when(at > 1, F.concat(F.array(mask), F.slice(state, F.lit(2), at - 2), F.array(met, new), rest)).otherwise(F.concat(F.array(mask, new), rest))

        def step(state: Column, _: Column) -> Column:
            place = lambda low: F.bit_count(F.get(state, F.lit(0)).bitwiseAND(bit(low) - 1)) + 1
            go = lambda least: bound(start(least), lambda low: bound(place(low), lambda at: merged(state, low, at)))
            return bound(F.array_min(state), lambda least: F.when(least >= NONE, state).otherwise(go(least)))

        def done(state: Column) -> Column:
            return F.transform(F.slice(state, F.lit(2), F.size(state)), lambda x, k: F.shiftright(self.rank(piece(start(x), F.coalesce(start(F.get(state, k + 2)), size))), 1))

        begun = F.transform(F.sequence(F.lit(0), size - 1), lambda low: F.when(low + 1 < size, pair(low, low + 2)).otherwise(none(low)))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.concat(F.array(F.lit(MARK) + (bit(size) - 1)), begun), step, done)

    def _all(self, state: Column) -> Column:
        """The state with all pairs of the lowest rank merged, from left to right, or just the leftmost where a merged part has a lower rank with a neighbour."""
        parts, ranks, best = state["parts"], state["ranks"], state["best"]
        flags = F.array_join(F.transform(ranks, lambda r: F.when(r == best, "1").otherwise("0")), "")
        # Of a run of neighbouring pairs every second one can merge.
        every = F.replace(flags, F.lit("11"), F.lit("10"))
        first = bound(flags, lambda f: F.rpad(F.concat(F.substring_index(f, "1", 1), F.lit("1")), F.length(f), "0"))

        def made(marks: Column) -> Column:
            """The state after the merges that ``marks`` names, and the lowest rank that a merged part has with a neighbour."""

            def merged(p: Column, k: Column) -> Column:
                new = F.get(marks, k + 1) == "1"
                # The right neighbour as it was is met before it merges itself.
                met = F.when(new & (best % 2 == 1), self.rank(F.concat(p, F.get(parts, k + 1), F.get(parts, k + 2))))
                whole = F.when(new, F.concat(p, F.get(parts, k + 1))).otherwise(p)
                return F.struct(whole.alias("p"), new.alias("new"), (F.get(marks, k) == "1").alias("gone"), F.get(ranks, k).alias("r"), met.alias("met"))

            return bound(F.filter(F.transform(parts, merged), lambda x: ~x["gone"]), ranked)

        def ranked(kept: Column) -> Column:
            again = F.transform(F.slice(kept, 1, F.size(kept) - 1), lambda x, k: F.when(x["new"] | F.get(kept, k + 1)["new"], self.rank(F.concat(x["p"], F.get(kept, k + 1)["p"]))).otherwise(x["r"]))
            return bound(again, lambda r: F.struct(kept["p"].alias("parts"), r.alias("ranks"), F.array_min(r).alias("best"), F.least(F.array_min(r), F.array_min(kept["met"])).alias("low")))

        def marked(pick: Column) -> Column:
            return bound(F.split(F.concat(F.lit("0"), pick, F.lit("0")), ""), made)

        step = bound(marked(every), lambda new: F.when((best % 2 == 0) | new["low"].isNull() | (new["low"] > best), new).otherwise(marked(first)))
        return F.when(best.isNull(), state).otherwise(step)

    def ids(self, word: Column) -> Column:
        """The ids of a word in hexadecimal, which is not empty."""
        number = lambda piece: F.shiftright(self.rank(piece), 1)
        done = lambda state: F.transform(state["parts"], number)
        begun = bound(self._parts(word), lambda s: F.struct(s["parts"].alias("parts"), s["ranks"].alias("ranks"), F.array_min(s["ranks"]).alias("best"), F.lit(None).cast("int").alias("low")))
        # Rounds of steps: a fold cannot end early, but a round that has nothing to merge is passed over whole.
        rounds = F.sequence(F.lit(1), F.greatest((F.length(word) / (2 * ROUND)).cast("int") + 1, F.lit(1)))
        several = lambda state: F.aggregate(F.sequence(F.lit(1), F.lit(ROUND)), state, lambda s, _: self._all(s))
        long = F.aggregate(rounds, begun, lambda state, _: F.when(state["best"].isNull(), state).otherwise(several(state)), done)
        short = bound(word, self._short)
        return bound(number(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(F.length(word) <= 2 * min(SHORT, MOST), short).otherwise(long))


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_PATTERNS: dict[tuple[str, str], str] = {}


def spark_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for Spark's regular expressions, with the letters, digits and white space of the tokenizer's library."""
    key = (spark.sparkContext.applicationId, pattern)
    if key not in _PATTERNS:
        _PATTERNS[key] = _completed(spark, pattern)
    return _PATTERNS[key]


def _completed(spark: SparkSession, pattern: str) -> str:
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    points = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    kinds = (r"\p{L}", r"\p{N}")
    known = points.select("id", *(F.col("c").rlike(k).alias(f"k{n}") for n, k in enumerate(kinds))).where("k0 or k1").toPandas()  # code points: at most some 150,000
    out = pattern.replace(r"\S", r"[^\s]")
    for n, kind in enumerate(kinds):
        own = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs = set(map(ord, own.decode(own.encode_ordinary(every))))
        if missing := theirs - set(known["id"][known[f"k{n}"]].tolist()):
            # A look at the range first spares most signs the comparison with all parts.
            out = out.replace(kind, f"{kind}[\\x{{{min(missing):x}}}-\\x{{10ffff}}&&[{_ranges(list(missing))}]]")
    return "(?U)" + _classed(out)


def _classed(pattern: str) -> str:
    """Wrap completed kinds that stand outside of brackets in brackets."""
    out, depth, k = [], 0, 0
    while k < len(pattern):
        if pattern[k] == "\\":
            end = pattern.index("}", k) + 1 if pattern[k + 1 : k + 3] in ("p{", "x{") else k + 2
            if depth == 0 and end < len(pattern) and pattern[end] == "[" and pattern[k + 1] == "p":
                close, level = end, 0
                while True:
                    level += {"[": 1, "]": -1}.get(pattern[close], 0)
                    close += 1
                    if level == 0:
                        break
                out.append("[" + pattern[k:close] + "]")
                k = close
                continue
            out.append(pattern[k:end])
            k = end
            continue
        depth += {"[": 1, "]": -1}.get(pattern[k], 0)
        out.append(pattern[k])
        k += 1
    return "".join(out)


def frequent_words(docs: DataFrame, own: str, most: int = REMEMBERED, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """(word, n): the commonest words with their counts, at most ``most`` of at most ``longest`` characters, of about ``sample`` rows of ``docs`` (text)."""
    share = max(1, docs.count() // max(1, sample))
    some = docs.withColumn("k", F.monotonically_increasing_id()).where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0)
    # An outer explode: Spark adds no filter on the size, which would cut every text twice.
    found = some.select(F.explode_outer(F.regexp_extract_all("text", F.lit(own), F.lit(0))).alias("word")).where(F.length("word") <= longest)
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)


def encode_words(found: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The words ``found`` (word and any others) with ``ids``, their token ids."""
    # The constant map is bound once a row, so that the plan names it once.
    return found.select(*found.columns, bound(rank_map(ranks), lambda held: Merges(held).ids(F.hex("word"))).alias("ids"))


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _slices(batch: pa.RecordBatch, column: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` elements in the lists of a column, so that a worker stays small."""
    bounds = batch.column(column).offsets.to_numpy()
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def _places(words: pa.Array, known: pa.Array) -> pa.Array:
    """Where each of ``words`` is in ``known``, null if nowhere.  Only the distinct words, not ``known``, are put into a hash table."""
    coded = words.dictionary_encode()
    at = pc.index_in(known, value_set=coded.dictionary)
    place = np.full(len(coded.dictionary), -1, dtype=np.int32)
    place[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    found = place[coded.indices.to_numpy()]
    return pa.array(found, mask=found < 0)


def _looked_up(batch: pa.RecordBatch, column: int, known: pa.Array, common: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The slices of a batch, each with the places in ``known`` of the words in its lists, null for each other word.

    Most words are among the few at the places ``common``.  The others of several slices are looked up at once, since each look-up passes over ``known``.
    """
    hot, slices = known.take(common), list(_slices(batch, column))
    for low in range(0, len(slices), TOGETHER):
        group = slices[low : low + TOGETHER]
        flats = [part.column(column).flatten() for part in group]
        held = [common.take(pc.index_in(flat, value_set=hot)) for flat in flats]
        others = [flat.filter(at.is_null()) for flat, at in zip(flats, held, strict=True)]
        places, start = _places(pa.concat_arrays(others), known), 0
        for part, at, other in zip(group, held, others, strict=True):
            yield part, pc.replace_with_mask(at, at.is_null(), places.slice(start, len(other)))
            start += len(other)


def _known_ids(lists: pa.Array, at: pa.Array, ids: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For lists of words, whose ids are at the places ``at``, the ids in turn, -1 for each word without a place, and the lists of these."""
    flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    missing = at.is_null().to_numpy(zero_copy_only=False)
    held = ids.take(at.drop_null())
    sizes = np.ones(len(flat), dtype=np.int64)
    sizes[~missing] = np.diff(held.offsets.to_numpy())
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.empty(starts[-1], dtype=np.int32)
    gap = np.zeros(len(out), dtype=bool)
    gap[starts[:-1][missing]] = True
    out[gap], out[~gap] = -1, held.flatten().to_numpy(zero_copy_only=False)
    rare = np.r_[0, np.cumsum(missing)]
    return (
        pa.ListArray.from_arrays(pa.array(starts[bounds], pa.int32()), pa.array(out)),
        pa.ListArray.from_arrays(pa.array(rare[bounds], pa.int32()), flat.filter(pa.array(missing))),
    )


def _filled(coded: pa.Array, rare: pa.Array) -> pa.Array:
    """The lists of ids with each -1 replaced by the ids of the next of the lists ``rare``."""
    flat, bounds = coded.flatten().to_numpy(zero_copy_only=False), coded.offsets.to_numpy() - coded.offsets[0].as_py()
    each = rare.flatten()
    sizes, gap = np.ones(len(flat), dtype=np.int64), flat < 0
    sizes[gap] = np.diff(each.offsets.to_numpy())
    starts = np.r_[0, np.cumsum(sizes)]
    own = np.zeros(starts[-1], dtype=bool)
    own[starts[:-1][~gap]] = True
    out = np.empty(len(own), dtype=np.int32)
    out[own], out[~own] = flat[~gap], each.flatten().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(starts[bounds], pa.int32()), pa.array(out))


def joined_pieces(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """The bytes that lists of ids decode to: their binary pieces, joined."""
    found = pieces.take(ids.flatten())
    ends = np.r_[0, np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)]
    bounds = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    whole = pa.py_buffer(ends[bounds].astype("<i8").tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, whole, found.buffers()[2] or pa.py_buffer(b"")])


def _piece_array(ranks: dict[bytes, int]) -> pa.Array:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pa.array(pieces, pa.large_binary())


def decode(df: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``df`` (ids and any others) with ``decoded``, the bytes that the ids decode to."""
    kept = df.drop("decoded")
    pieces, where = kept.sparkSession.sparkContext.broadcast(_piece_array(ranks)), kept.columns.index("ids")  # the tokenizer's pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, where):
                whole = joined_pieces(part.column(where), pieces.value)
                yield pa.RecordBatch.from_arrays([*part.columns, whole.cast(pa.binary())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED, sample: int = SAMPLE, decoded: bool = False) -> DataFrame:
    """``docs`` (text and any others) with ``ids``, the token ids of the text, in place of the text; ``decoded`` adds what :func:`decode` gives."""
    spark, own = docs.sparkSession, spark_pattern(docs.sparkSession, pattern)
    kept = [c for c in docs.columns if c not in ("ids", "text", "decoded")]
    pieces = spark.sparkContext.broadcast(_piece_array(ranks))  # the tokenizer's pieces
    tasks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = encode_words(frequent_words(docs.select("text"), own, remembered, sample).repartition(tasks), ranks).toArrow()  # at most ``remembered`` short words
    common = np.argsort(-table["n"].to_numpy(), kind="stable")[:COMMON].astype(np.int32)
    shared = spark.sparkContext.broadcast((_one(table["word"]), _one(table["ids"]), pa.array(common)))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(own), F.lit(0)).alias("words"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, each, common = shared.value
        for batch in batches:
            for part, at in _looked_up(batch, 1, known, common):
                coded, rare = _known_ids(part.column(1), at, each)
                yield pa.RecordBatch.from_arrays([part.column(0), coded, rare], names=["row", "coded", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                ids = _filled(part.column(1), part.column(2))
                more = [joined_pieces(ids, pieces.value).cast(pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *more], names=["row", "ids", "decoded"][: 2 + len(more)])

    known = rows.mapInArrow(lean(look), T.StructType([rows.schema["row"], T.StructField("coded", T.ArrayType(T.IntegerType())), T.StructField("rare", T.ArrayType(T.StringType()))]))
    folded = bound(rank_map(ranks), lambda held: F.transform("rare", lambda w: Merges(held).ids(F.hex(w))))
    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    made = known.select("row", "coded", folded.alias("rare")).mapInArrow(lean(fill), T.StructType(fields if decoded else fields[:2]))
    return made.select(*(F.col(f"row.`{c}`") for c in kept), *made.columns[1:])


def op11_bytepairs(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, and the text that they decode to, as digests."""
    import public_tokenizers

    docs, ranks = table(spark, sf_dir, "documents").select("doc_id", "text"), read_ranks(public_tokenizers.path(RANKS))
    return encode(docs, ranks, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
