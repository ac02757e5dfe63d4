"""Postings as bytes, against a plain writer and reader of one number after the other."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import codec, index


def written(refs):
    out, last = bytearray(), 0
    for ref in refs:
        delta, last = ref - last, ref
        while delta > 127:
            out.append(delta % 128 + 128)
            delta //= 128
        out.append(delta)
    return bytes(out)


def test_numbers_and_bytes():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62, 5, 2**63 - 1], dtype=np.int64)
    data, sizes = codec.to_bytes(numbers)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 9, 1, 9]
    assert codec.from_bytes(data).tolist() == numbers.tolist()
    assert len(codec.from_bytes(np.zeros(0, dtype=np.uint8))) == 0
    assert len(codec.to_bytes(np.array([0, 1_000_000]))[0]) < 8
    with pytest.raises(ValueError):
        codec.to_bytes(np.array([-1]))


def test_blocks_equal_a_plain_writer(spark):
    rnd = random.Random(1)
    held = {w: sorted({(rnd.choice((rnd.randrange(50), rnd.randrange(10**6), rnd.randrange(10**12))), rnd.random() < 0.5) for _ in range(n)}) for w, n in (("common", 5000), ("some", 40), ("one", 1), ("dense", 3))}
    held["dense"] = [(k, True) for k in range(9000)]
    rows = [(w, p, named) for w, refs in held.items() for p, named in refs]
    rnd.shuffle(rows)  # refs come in any order
    pairs = spark.createDataFrame(rows, "word string, place_id bigint, named boolean").repartition(5)
    blocks = codec.encode(pairs)
    refs = {w: sorted(p * 2 + named for p, named in own) for w, own in held.items()}
    streams = {}
    for r in sorted(codec.streams(blocks).collect(), key=lambda r: (r["word"], r["range"])):
        streams[r["word"]] = streams.get(r["word"], b"") + bytes(r["data"])
        own = [x for x in refs[r["word"]] if x >> index.RANGE_BITS == r["range"]]
        assert (r["first"], r["last"], r["places"]) == (own[0], own[-1], len(own))
    assert streams == {w: written(own) for w, own in refs.items()}
    back = {}
    for r in sorted(codec.decode(blocks).collect(), key=lambda r: (r["word"], r["range"])):
        back[r["word"]] = back.get(r["word"], []) + list(r["postings"])
    assert back == refs
    sizes = {r["word"]: r["blob_bytes"] for r in index.vocabulary(pairs).collect()}
    assert sizes == {w: len(data) for w, data in streams.items()}
    # A block is read without the others.
    middle = blocks.where("word = 'dense'").where(F.col("range") == 2)
    assert codec.decode(middle).first()["postings"] == [x for x in refs["dense"] if x >> index.RANGE_BITS == 2]


def test_no_pairs(spark):
    none = codec.encode(spark.createDataFrame([], "word string, place_id bigint, named boolean"))
    assert codec.streams(none).collect() == codec.decode(none).collect() == []
