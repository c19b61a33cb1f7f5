"""Steps whose work or memory once grew faster than their input: folds, cells and glyphs."""

import random
import sys
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from loomdoc.functions import rules as R
from loomdoc.operators import blocks, cells, similarity


def test_a_fold_holds_a_document_at_a_time(spark):
    docs = lambda n: spark.range(0, n, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(i, F.lit(" line of "), "id")).alias("lines"))
    fold = lambda t: [(sys.getallocatedblocks(), len(t), t[-1])]
    run = lambda n: blocks.folded(docs(n), "id", "lines", fold, "alive bigint, n int, end string").collect()
    few, many = run(1), run(150)
    # 150 documents of 4,000 lines would be 600,000 values
    assert max(r["alive"] for r in many) - few[0]["alive"] < 150_000
    assert [(r["id"], r["n"], r["end"]) for r in many] == [(k, 4000, f"4000 line of {k}") for k in range(150)]
    assert run(0) == []


def test_cells_are_not_broadcast(spark):
    own = spark.range(40).select(F.col("id").alias("page"), F.lit(0).alias("row"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(100).alias("x1"), F.lit(50).alias("y1"))
    put = spark.range(400).select((F.col("id") % 40).alias("page"), F.col("id").alias("k"), F.lit(5).alias("x0"), F.lit(5).alias("y0"), F.lit(20).alias("x1"), F.lit(15).alias("y1"), F.lit("w").alias("word"))
    found = cells.words_in_cells(own, put, "page", ["row"], ["k"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["page"], r["text"]) for r in found.collect()} == {(p, "w w w w w w w w w w") for p in range(40)}


def test_the_mean_of_glyphs_is_computed_once_a_text(spark):
    rows = spark.createDataFrame(
        [(1, [("가", 0.0, 8.0), ("", 8.0, 8.0), ("b", 9.0, 17.0), ("c", 30.0, 38.0)]), (2, [("a", 0.0, 8.0), ("b", 30.0, 38.0)]), (3, [("가", 5.0, 5.0), ("b", 30.0, 30.0)]), (4, []), (5, None), (6, [(None, 0.0, 8.0), ("가", 30.0, 38.0)])],
        "id int, g array<struct<c: string, x0: double, x1: double>>",
    )
    out = rows.select("id", R.glyph_text(F.col("g")).alias("t"))
    assert {r["id"]: r["t"] for r in out.collect()} == {1: "가b c", 2: "ab", 3: "가b", 4: "", 5: None, 6: "가"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_blocks_of_long_texts_lose_no_pair_and_leave_few():
    rnd = random.Random(3)
    pieces = [a + b for a in "the an in er on st re at en".split() for b in "th an is or ti ly ed".split()]
    text = lambda n: " ".join("".join(rnd.choices(pieces, k=rnd.randrange(1, 4))) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))
    near = 0
    for _ in range(600):
        x = text(rnd.randrange(20, 70))
        words = x.split(" ")
        for _ in range(rnd.randrange(len(words) // 2)):
            words[rnd.randrange(len(words))] = rnd.choice(["", "kqz", rnd.choice(words)])
        y, limit = " ".join(words), rnd.choice([0.5, 0.7, 0.75, 0.9])
        if SequenceMatcher(None, x, y).ratio() >= limit:
            near += 1
            assert similarity.may_have_blocks([x], [y], limit)[0, 0]
            assert 2 * similarity.common_lengths([x], [y], np.array([[0, 0]]))[0] >= limit * (len(x) + len(y))
    assert near > 100
    others = [text(40) for _ in range(200)]
    assert min(map(len, others)) >= similarity.POPULAR
    assert similarity.may_have_blocks(others[:100], others[100:], 0.7).mean() < 0.3
    assert similarity.may_have_blocks(["", "ab"], ["", "x" * 250], 0.7).shape == (2, 2)
