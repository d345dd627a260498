"""Which stretches of one anchor have their strings refined: by what stands beside the anchor's gram."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import substring_dedup as sd
from flowsieve.llm.common import keyed


def brute(texts: dict[int, str], length: int) -> dict[int, int]:
    """Removed bytes of every document."""
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        raw = texts[d].encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i:i + length], d)
    out = {}
    for d, t in texts.items():
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < d:
                gone[i:i + length] = True
        out[d] = int(gone.sum())
    return out


def removed(spark, texts, length, **more) -> dict[int, int]:
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.n_removed for r in sd.substring_dedup(df, length=length, **more).collect()}


def common_grams(n=60, seed=5) -> dict[int, str]:
    """Texts that share 20 bytes again and again, with other bytes around them, so no 47 bytes."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    return {d: " ".join(word(60) + " in the middle of it " + word(60) for _ in range(8)) for d in range(n)}


def periodic(seed=9) -> dict[int, str]:
    """Runs of one letter and short periods, cut at random, with copies of pieces of 40 to 140 bytes."""
    rng = random.Random(seed)
    out = {}
    for d in range(40):
        parts = ["".join(rng.choices("ab", k=rng.randrange(1, 4))) * rng.randrange(5, 70) for _ in range(6)]
        if d:
            t, k = out[rng.randrange(d)], rng.randrange(40, 140)
            i = rng.randrange(max(1, len(t) - k))
            parts.insert(rng.randrange(6), t[i:i + k])
        out[d] = "".join(parts)
    return out


def edited(seed=3) -> dict[int, str]:
    """Copies of one text with a byte changed here and there, so shared strings end anywhere beside their anchors."""
    rng = random.Random(seed)
    base = "".join(rng.choices("abcdefgh ", k=900))
    out = {}
    for d in range(50):
        t = list(base)
        for _ in range(14):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        out[d] = "".join(t)[rng.randrange(100):]
    return out


@pytest.mark.parametrize("length", [16, 40, 47, 50, 78])
@pytest.mark.parametrize("make", [common_grams, periodic, edited])
def test_removed_bytes_are_those_of_brute_force(spark, make, length):
    texts = make()
    assert removed(spark, texts, length) == brute(texts, length)


def test_texts_that_share_grams_but_no_strings_are_not_refined(spark):
    """All stretches around a common 16-gram were fetched and refined, a share that grew with the input."""
    df = spark.createDataFrame(list(common_grams().items()), "doc_id long, text string")
    parts = sd.sampled(keyed(df, "doc_id", "text"), 50).cache()
    crowded = parts.groupBy("anchor").agg(F.count_distinct("content").alias("n")).filter("n > 1").agg(F.sum("n")).first()[0]
    # two of 400 stretches may have the same 16 bits by chance
    assert crowded > 400 and sd.refine_contents(parts).filter("anchor is not null").count() * 20 < crowded


@pytest.mark.parametrize("most", [0, 3, sd.HELD])
def test_buckets_too_large_to_hold_go_on_whole(spark, most):
    """Rows to refine with few held are those with all held, and more of the large buckets; none is lost or doubled."""
    df = spark.createDataFrame(list(edited().items()), "doc_id long, text string")
    parts = sd.sampled(keyed(df, "doc_id", "text"), 50).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in sd.refine_contents(parts, most).collect()]
        want = [tuple(r) for r in sd.refine_contents(parts).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(want) <= set(got) and want
    assert {x for x in got if x[0] is None} == {x for x in want if x[0] is None}
