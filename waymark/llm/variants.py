"""Spelling variants by forward and backward minimal acyclic automata.

Words that occur often enough are compared with all words one error (an inserted, deleted or replaced code point) away.
The error lies in the word's first or second half, so the other half stands unchanged: the forward
automaton matches the first half exactly and completes the rest with one error, the backward automaton,
which reads words from their end, does the same for the second half.  Both are minimal, and every path
through one adds up to the number of its word among the sorted words (a perfect hash), which finds the
word and its count in plain arrays.  What both directions find is counted by the forward one only.

Spark deals the work: words of one length that share the exact half's first letters form a group (the
part of the half that all askers' lengths have), groups are hashed to buckets of about ``BUCKET`` words,
and a word asks once for each of the three lengths its variants can have, in each direction.  A group
above ``BUCKET`` words is cut into parts, and each part of its words meets each part of its askers in a cell of
its own.  A task holds one bucket or cell and hands on one row for each asking word: how many it found, and the best.

A word's form is its commonest near word if that is at least ``RATIO`` times as common; counts at least double along
forms, so that following them ends, and pointers are doubled until every word has its root.

Defined results: null and empty texts hold no words; repeated rows count each; a null doc_id is written as nothing before the colon;
ties of counts go to the smallest word in code-point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import settle, table

RUNS, LEAST_LENGTH, LEAST_COUNT, RATIO, SPOIL, BUCKET = r"[A-Za-zÀ-ÿ]+", 5, 3, 2, 97, 4096
INDEX, DELETE, REPLACE, INSERT = range(4)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; an arc has its target and how many words come before those beyond it."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[bool] = [False]
        sizes, known, path, last = [0], {}, [0], ""

        def close(depth: int) -> None:
            """Finish the states of the last word below ``depth``; equal ones become one."""
            while len(path) > depth + 1:
                state = path.pop()
                arcs, total = self.arcs[state], int(self.ends[state])
                for sign, (target, _) in arcs.items():
                    arcs[sign] = (target, total)
                    total += sizes[target]
                sizes[state] = total
                first = known.setdefault((self.ends[state], tuple(arcs.items())), state)
                self.arcs[path[-1]][last[len(path) - 1]] = (first, 0)

        for word in words:
            same = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            for sign in word[same:]:
                self.arcs.append({})
                self.ends.append(False)
                sizes.append(0)
                self.arcs[path[-1]][sign] = (len(sizes) - 1, 0)
                path.append(len(sizes) - 1)
            self.ends[path[-1]] = True
            last = word
        close(0)
        total = int(self.ends[0])
        for sign, (target, _) in self.arcs[0].items():
            self.arcs[0][sign] = (target, total)
            total += sizes[target]

    def walk(self, text: str, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        """The state after ``text``, and how many words come before those beyond it."""
        for sign in text:
            step = self.arcs[state].get(sign)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def ended(self, text: str, state: int, number: int) -> Iterator[int]:
        """The number of the word that ``text`` leads to from ``state``, if it is one."""
        at = self.walk(text, state, number)
        if at is not None and self.ends[at[0]]:
            yield at[1]

    def one_error(self, exact: str, rest: str, kind: int) -> set[int]:
        """The numbers of the words that begin with ``exact`` and go on with ``rest`` but for one error of ``kind``."""
        at, found = self.walk(exact), set()
        for k in range(len(rest) + 1):
            if at is None:
                break
            if kind == DELETE:
                found.update(self.ended(rest[k + 1 :], *at) if k < len(rest) else ())
            elif kind == INSERT or k < len(rest):
                tail = rest[k:] if kind == INSERT else rest[k + 1 :]
                for sign, (state, before) in self.arcs[at[0]].items():
                    if kind == INSERT or sign != rest[k]:
                        found.update(self.ended(tail, state, at[1] + before))
            at = self.walk(rest[k], *at) if k < len(rest) else None
        return found


def near_in_bucket(words: list[str], counts: list[int], roles: list[int], back: bool) -> Iterator[tuple[str, int, int, str]]:
    """(asking word, near words found, count of the commonest, the commonest) of one bucket in one direction."""
    turned = (lambda w: w[::-1]) if back else (lambda w: w)
    own = sorted((turned(w), n) for w, n, role in zip(words, counts, roles, strict=True) if role == INDEX)
    known, sizes = [w for w, _ in own], [n for _, n in own]
    automaton = Automaton(known)
    for word, role in zip(words, roles, strict=True):
        if role == INDEX:
            continue
        half = len(word) // 2
        asked = turned(word)
        exact = len(word) - half if back else half
        found = automaton.one_error(asked[:exact], asked[exact:], role)
        if back:  # what begins with the first half is the forward automaton's
            found = {k for k in found if turned(known[k])[:half] != word[:half]}
        if found:
            best = min((-sizes[k], turned(known[k])) for k in found)
            yield word, len(found), -best[0], best[1]


def words_of(docs: DataFrame, spoil: int = SPOIL, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, A-Z in lower case; of one in ``spoil`` occurrences a code point is left out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(RUNS), F.lit(0))
    # An outer explode: Spark adds no filter on the size, which would read every text twice.
    every = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode_outer(runs).alias("run"))
    every = every.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = every.select(F.when(F.col("h") % spoil == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _dealt(words: DataFrame) -> DataFrame:
    """(back, length, part, role, word, n): every word in its two groups, and asking in six."""
    sides = []
    for back in (False, True):
        turned = F.reverse("word") if back else F.col("word")
        for role, change in ((INDEX, 0), (DELETE, -1), (REPLACE, 0), (INSERT, 1)):
            length = F.length("word") + change
            sides.append(F.struct(F.lit(back).alias("back"), length.alias("length"), F.substring(turned, F.lit(1), ((length - 1) / 2).cast("int")).alias("part"), F.lit(role).alias("role")))
    return words.select("word", "n", F.explode(F.array(*sides)).alias("side")).select("side.*", "word", "n")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, found, near_n, near): for asking words how many near words one bucket holds, and the commonest."""
    group = ["back", "length", "part"]
    dealt = _dealt(words)
    large = settle(dealt.where(F.col("role") == INDEX).groupBy(*group).agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts")).where("parts > 1"))
    buckets = max(1, -(-words.count() // bucket))
    # A part of a large group's words meets every part of its askers: copies grow with the parts, not with the group.
    cut = dealt.join(large, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    copies = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    index = F.col("role") == INDEX
    cells = copies.select(
        "back", F.pmod(F.xxhash64("length", "part"), F.lit(buckets)).cast("int").alias("bucket"),
        F.when(index, F.col("own")).otherwise(F.col("other")).alias("held"), F.when(index, F.col("other")).otherwise(F.col("own")).alias("asks"), "word", "n", "role",
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = list(near_in_bucket(rows["word"].to_pylist(), rows["n"].to_pylist(), rows["role"].to_pylist(), key[0].as_py()))
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "found", "near_n", "near"])

    return cells.groupBy("back", "bucket", "held", "asks").applyInArrow(run, "word string, found bigint, near_n bigint, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each word's chain of forms."""
    known = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return known


def variants(words: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n), which are distinct."""
    words = settle(words.select("word", F.col("n").cast("bigint").alias("n")))
    near = near_words(words, bucket).select("word", F.lit(None).cast("bigint").alias("n"), "found", F.struct((-F.col("near_n")).alias("less"), "near").alias("best"))
    every = near.unionByName(words.select("word", "n", F.lit(0).cast("bigint").alias("found"), F.lit(None).cast("struct<less: bigint, near: string>").alias("best")))
    judged = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("found").alias("n_near"), F.min("best").alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    formed = settle(judged.select("word", "n", "n_near", F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")))
    joined = formed.join(roots(formed.where("form is not null")), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return variants(words_of(table(spark, sf_dir, "documents")))
