"""Best-fit packing of token sequences under several capacities at once.

Every piece of a document is a demand vector (tokens, documents, attention cost), where the attention
cost of a piece is the square of its length.  Pieces go, longest first, into the open sequence that
every constraint allows and that fits best: by the smallest weighted norm of what would be left
(``rule="norm"``) or by the largest weighted dot-product of demand and room (``rule="dot"``).

The demand vector is a function of the length, so best fit needs no rows: it runs on the histogram of
lengths (at most ``max_tokens`` numbers, however large the corpus).  Sequences with equal contents are
kept as one range, one step puts a run of equal pieces into a run of equal sequences, and the steps
form a small table.  Each piece finds its step by its rank among the pieces of its length.  Ranks are
counted within (length, salt) cells, so that a hot length never meets in one task.

Tokens: words between white space are encoded once per worker and remembered, which gives the same ids
as encoding the whole text because the tokenizer drops white space and never merges over it.

Defined results: a null or empty text is the single id 0; repeated rows are packed like others;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import lean, literal_table, settle, table, text_chunks

TOKENIZER, MAX_TOKENS, SALTS, MEMORY_WORDS, LONG_WORD = "word_bpe_49k.json", 2048, 64, 600_000, 64


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and the weight of each kind of room."""

    tokens: int = MAX_TOKENS
    documents: int = MAX_TOKENS
    attention: int = MAX_TOKENS**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    @property
    def sizes(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


#: Texts of these characters only fall into the tokenizer's own pieces at fixed places: runs of letters,
#: single digits and runs of signs. An apostrophe (contractions) or "<" (special tokens) may not occur.
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff0-9!-&(-/:;=-@\[-`{-~ \t-\r]*")
UNITS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
WORDS = re.compile(r"[^ \t-\r]+")
RAW = " "  # begins the key of a word that is encoded as it is


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit numbers, from remembered pieces.

    White space always parts the tokenizer's pieces, so a text's ids are those of its words in turn.
    Plain texts and words are split on into the tokenizer's pieces, and new ones are encoded many at a
    time: each piece ends in the one id that carries the end-of-word mark. Other words are encoded as
    they are. Memory is bounded: it is emptied beyond ``MEMORY_WORDS`` pieces, and long ones do not stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.known: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The keys of a text's pieces in turn."""
        if PLAIN.fullmatch(text):
            return UNITS.findall(text.lower())
        out: list[str] = []
        for word in WORDS.findall(text):
            if PLAIN.fullmatch(word):
                out += UNITS.findall(word.lower())
            else:
                out.append(RAW + word)
        return out

    def _learn(self, missing: set[str], at_once: int = 64) -> None:
        raw = [u for u in missing if u[0] == RAW]
        for unit, found in zip(raw, self.tokenizer.encode_batch_fast([u[1:] for u in raw], add_special_tokens=False), strict=True):
            self.known[unit] = np.array(found.ids, dtype="<u4").tobytes()
        units = [u for u in missing if u[0] != RAW]
        lines = [" ".join(units[k : k + at_once]) for k in range(0, len(units), at_once)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            own = units[k * at_once : (k + 1) * at_once]
            if len(ends) != len(own):
                raise ValueError("the tokenizer does not end each piece with one end-of-word id")
            data, low = ids.tobytes(), 0
            for unit, high in zip(own, (4 * ends).tolist(), strict=True):
                self.known[unit] = data[low:high]
                low = high

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        split = [self.pieces(t) for t in texts]
        missing = set(chain.from_iterable(split))
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        known = self.known
        missing.difference_update(known)
        self._learn(missing)
        for units in split:
            yield b"".join(map(known.__getitem__, units))
        for unit in missing:
            if len(unit) > LONG_WORD:
                del known[unit]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The encoder of this worker, kept over its tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if str(path) not in _ENCODERS:
        _ENCODERS[str(path)] = WordEncoder(str(path))
    return _ENCODERS[str(path)]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenize_pieces(df: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``with_ids`` adds the ids themselves as ``ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.zeros(1, dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = (ids for low, high in text_chunks(texts, 1 << 20) for ids in words.encode_all(texts[low:high]))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[start : start + 4 * max_tokens]
                    row = (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<i4") if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select("doc_id", "text").mapInArrow(lean(run), PIECES + ", ids array<int>" * with_ids)


def plan_bins(histogram: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, on counts: steps (length, first rank, end rank, first sequence, offset)."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    size, weights = capacity.sizes, np.array(capacity.weights)
    scale = weights / size
    room = np.zeros((64, 3), dtype=np.int64)  # of each range of equal open sequences
    first, many = np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int64)
    used, made, steps = 0, 0, []
    by_room: dict[tuple[int, ...], list[int]] = {}
    free: list[int] = []

    def release(k: int) -> None:
        by_room[tuple(room[k].tolist())].remove(k)
        free.append(k)

    for length in sorted(histogram, reverse=True):
        demand, rank, left = np.array([length, 1, length * length], dtype=np.int64), 0, histogram[length]
        if (demand > size).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        per_bin = int((size // demand).min())
        while left:
            fits = np.flatnonzero((many[:used] > 0) & (room[:used] >= demand).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = (((room[fits] - demand) * scale) ** 2).sum(axis=1)
                else:
                    score = -((room[fits] * scale) @ (demand * scale))
                k = int(fits[np.argmin(score)])
                take, begin, rest = min(left, int(many[k])), int(first[k]), room[k].copy()
                first[k] += take
                many[k] -= take
                if not many[k]:
                    release(k)
            else:
                take, begin, rest = -(-left // per_bin), made, size.copy()
                made += take
            steps.append((length, rank, rank + take, begin, int(size[0] - rest[0])))
            rank, left, rest = rank + take, left - take, rest - demand
            if not (rest[0] and rest[1]):
                continue
            same = by_room.setdefault(tuple(rest.tolist()), [])
            if (k := next((j for j in same if first[j] + many[j] == begin), None)) is not None:
                many[k] += take
                continue
            if not free:
                if used == len(first):
                    room, first, many = np.vstack([room, np.zeros_like(room)]), np.append(first, np.zeros_like(first)), np.append(many, np.zeros_like(many))
                free.append(used)
                used += 1
            k = free.pop()
            room[k], first[k], many[k] = rest, begin, take
            same.append(k)
    return steps


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", salts: int = SALTS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    cells = settle(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    steps = literal_table(pieces.sparkSession, plan_bins(histogram, capacity, rule), "length bigint, _low bigint, _high bigint, _bin bigint, _offset bigint")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_row", F.row_number().over(inside) - F.lit(1))
    # Both small sides have proven bounds: max_tokens * salts cells, and a few steps a length.
    placed = (
        ranked.join(F.broadcast(base), ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row"))
        .join(F.broadcast(steps), "length")
        .where("_rank >= _low and _rank < _high")
    )
    return placed.withColumns(
        {"sequence_id": F.col("_bin") + F.col("_rank") - F.col("_low"), "offset": F.col("_offset")}
    ).drop("_salt", "_row", "_base", "_rank", "_low", "_high", "_bin", "_offset")


def pack_documents(df: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut, tokenize and pack whole documents; pieces are settled so that they are tokenized once."""
    longest = int(min(capacity.tokens, capacity.attention**0.5))
    return pack(settle(tokenize_pieces(df, tokenizer, longest, with_ids)), capacity, rule)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
