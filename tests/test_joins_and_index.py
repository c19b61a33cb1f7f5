"""Words in cells, the vector index, numbering, whole-run leaders, and answers that white space or broken values once made wrong."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from loomdoc.functions import rules as R
from loomdoc.functions import text as T
from loomdoc.functions import verdicts as V
from loomdoc.operators import blocks, cells, store, vector_index
from loomdoc.operators.stages import shared_folder


def values(spark, texts, use):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", use(F.col("t")).alias("v")).orderBy("i").collect()]


def test_words_in_cells_against_all_pairs(spark):
    rng = random.Random(4)
    boxes = [(p, r, c, c * 70 + rng.random(), r * 30 - 40, c * 70 + 66, r * 30 - 12) for p in range(3) for r in range(6) for c in range(4)] + [(0, 9, 9, None, 0.0, 5.0, 5.0), (0, 9, 8, 10.0, 0.0, 5.0, 5.0), (1, 7, 0, -500.0, -500.0, 900.0, 900.0)]
    words = []
    for k in range(900):
        x, y = rng.uniform(-10, 290), rng.uniform(-50, 160)
        words.append((rng.choice([0, 0, 1, None]), k, x, y, x + rng.uniform(1, 30), y + 8, rng.choice(["a", "b", None])))
    words += [(2, 1, -2.0, -42.0, 3.0, -35.0, "edge"), (2, 2, -2.1, -42.0, 3.0, -35.0, "out")]
    own = spark.createDataFrame([(*b[:3], *[None if v is None else float(v) for v in b[3:]]) for b in boxes], "page int, row int, col int, x0 double, y0 double, x1 double, y1 double")
    put = spark.createDataFrame(words, "page int, k int, x0 double, y0 double, x1 double, y1 double, word string")
    got = {(r["page"], r["row"], r["col"]): r["text"] for r in cells.words_in_cells(own, put, "page", ["row", "col"], ["k"]).collect()}
    want = {}
    for p, r, c, x0, y0, x1, y1 in boxes:
        if x0 is None or x0 > x1:
            continue
        inside = [w for q, k, a, b, d, e, w in sorted(words, key=lambda w: w[1]) if q == p and x0 - 2 <= a and d <= x1 + 2 and y0 - 2 <= b and e <= y1 + 2]
        if inside:
            want[p, r, c] = " ".join(w for w in inside if w is not None)
    assert got == want and len(want) > 40
    full = own.withColumn("text", F.when(F.col("col") == 1, "given").when(F.col("col") == 2, ""))
    out = {(r["page"], r["row"], r["col"]): r["text"] for r in cells.patched(full, put, "page", ["row", "col"], ["k"]).collect()}
    assert len(out) == len(boxes) and all(out[k] == ("given" if k[2] == 1 else "" if k[2] == 2 else want.get(k)) for k in out)
    assert cells.words_in_cells(own.limit(0), put, "page", ["row", "col"], ["k"]).count() == 0


def test_recall_of_the_vector_index(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [1.0] * 3), (10**6 + 3, [float("nan")] * 64)], "vec_id bigint, embedding array<float>")
    rows = rows.select("vec_id", "embedding").union(odd)
    centres, path = vector_index.train(rows, "embedding", 64, 16), shared_folder(spark, "index")
    vector_index.build(rows, "vec_id", "embedding", centres, path)
    asked = rows.filter("vec_id % 5 = 0")
    found = lambda probe: {(r["query"], r["id"]) for r in vector_index.search(spark, path, asked, "vec_id", "embedding", centres, 10, probe).collect()}
    own = [r for r in rows.filter("size(embedding) = 64 and not isnan(embedding[0])").collect()]
    ids, v = np.array([r["vec_id"] for r in own]), np.array([r["embedding"] for r in own], float)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
    want = set()
    for i in np.flatnonzero((ids % 5 == 0)).tolist():
        scores = unit[i] @ unit.T
        best = sorted(range(len(ids)), key=lambda j: (-round(scores[j], 12), ids[j]))[:10]
        want |= {(int(ids[i]), int(ids[j])) for j in best if scores[j] > 0.1}
    assert found(16) == want
    assert len(found(12) & want) / len(want) >= 0.9
    assert vector_index.search(spark, path, asked.limit(0), "vec_id", "embedding", centres).count() == 0


def test_numbers_of_sparse_ids(spark):
    rng = random.Random(9)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(3000)] + [5] * 40
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint").repartition(7)
    got = store.positions(rows, "i", partitions=9).collect()
    assert sorted(r["number"] for r in got) == list(range(1, len(ids) + 1))
    assert [r["i"] for r in sorted(got, key=lambda r: r["number"])] == sorted(ids)
    assert store.positions(rows.limit(0), "i").count() == 0


def test_unicode_white_space(spark):
    numbers = " 1.1 a 1.2 b 2.1 c 2.2 d 3.1 e"
    assert values(spark, [f"목　차{numbers}", f"목 차{numbers}", f"목차{numbers}", f"항목{numbers}"], T.is_contents) == [True, True, True, False]
    assert values(spark, ["　" * 20 + "가", "--------------------가", "　" * 20], T.is_symbol_noise) == [False, True, True]
    assert values(spark, ["정리66　", "정리 66자"], R.is_contents_block) == [True, False]
    rows = spark.createDataFrame([(0, "\t"), (1, " \n"), (2, "　"), (3, ""), (4, " a "), (5, None)], "i int, t string")
    assert [r["t"] for r in store.without_blank(rows, "t").orderBy("i").collect()] == [None, None, None, None, " a ", None]


def test_clause_marks():
    import re

    assert all(re.match(blocks.CLAUSE, c) for c in "①⑳⓪㉑㉟") and not re.match(blocks.CLAUSE, "㉠")


def test_markup_rules(spark):
    got = values(spark, ["*시행 2024* a\n\n  b [t](u) []() ", "| --- | --- |\n----\n:::\n|-|", "a\\nb\\\\nc", "*other* x", None], T.clean_markup)
    assert got == ["a\nb t []()", "----\n:::", "a\nb\nc", "*other* x", None]


def test_answers_fail_as_a_whole(spark):
    answers = ['{"relevance": 8, "groundedness": 7.9, "context_relevance": "9"}', '{"relevance": "high", "groundedness": 7, "context_relevance": 9}', '{"relevance": null}', '{"relevance": "8.5"}', '{"relevance": 12, "groundedness": -3}', 'Here:\n```json\n{"relevance": true}\n```', "[1]", "no", None, '{"relevance": [1]}']
    want = [(0.8, 0.7, 0.9), (0.65,) * 3, (0.65,) * 3, (0.65,) * 3, (1.0, 0.0, 0.6), (0.65,) * 3, (0.65,) * 3, (0.65,) * 3, (0.65,) * 3, (0.65,) * 3]
    assert [tuple(x) for x in values(spark, answers, V.triad)] == want
    assert tuple(values(spark, ['```json\n{"relevance": true}\n```'], V.triad)[0]) == (0.1, 0.6, 0.6)


def test_lines_are_joined_in_linear_time(spark):
    import time

    def seconds(n):
        rows = spark.createDataFrame([("\n".join(f"line {k} of the text" + ("." if k % 9 == 0 else "") for k in range(n)),)], "t string")
        began = time.time()
        rows.select(F.length(T.join_lines(F.col("t")))).collect()
        return time.time() - began

    seconds(100)
    assert seconds(80_000) < 10 * max(seconds(8_000), 1.0)


def test_functions_of_the_session(spark):
    from loomdoc.functions.callable import register

    chunks = [(f"c{d}_{i}", d, i, 100 + d // 2, "a" if d < 3 else "b") for d in range(5) for i in range(7)]
    spark.createDataFrame(chunks, "id string, document_id int, chunk_index int, created_at int, filename string").createOrReplaceTempView("doc_chunks")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "id bigint, embedding array<double>").createOrReplaceTempView("vectors")
    register(spark)
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM stride_sample('a', 3) ORDER BY rn").collect()] == [("c2_0", 1), ("c2_2", 3), ("c2_4", 5)]
    assert spark.sql("SELECT * FROM stride_sample('none', 3)").count() == 0
    assert [r["id"] for r in spark.sql("SELECT * FROM match_vectors(array(1D, 0D), 0.5D, 2) ORDER BY similarity DESC, id").collect()] == [1, 5]
    assert spark.sql("SELECT * FROM match_vectors(null, 0.5D, 2)").count() == 0
    assert [r[0] for r in spark.sql("SELECT hierarchy_path(x, '', 'c') FROM VALUES ('a'), (null) t(x)").collect()] == ["a > c", "c"]
    assert spark.sql("SELECT hierarchy_path('', null, '')").first()[0] == "Uncategorized"
    cases = ['{"h2":"old","x":[1,{"y":null}]}', "[1]", "broken"]
    found = spark.createDataFrame([(c,) for c in cases] + [(None,)], "m string").selectExpr("patch_levels(m, 'a', NULL, 'it''s') AS p", "json_at(m, '$.x[0]') AS a").collect()
    assert [r["p"] and json.loads(r["p"]) for r in found] == [{"h1": "a", "h2": None, "h3": "it's", "x": [1, {"y": None}]}, None, None, None] and [r["a"] for r in found] == ["1", None, None, None]
    starts = spark.createDataFrame([("ab\n\nc\U0001f600\n",), ("",), (None,)], "t string").select(blocks.line_starts(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in starts] == [[0, 3, 4, 7], [0], None]
