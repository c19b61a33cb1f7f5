"""Rules on rows that are made for them, and folds and leaders against plain loops."""

import random
import re
import shutil
import subprocess
import sys
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdoc.functions import rules as R
from loomdoc.functions import text as T
from loomdoc.operators import blocks, similarity, statistics, store
from loomdoc.plans import chunks

ROOT = Path(__file__).resolve().parents[1]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_noise_flags_on_noise(spark):
    rows = [("발행일 2024 발행처 x",), ("발행일 2024",), ("ISBN 1 편집 2",), ("□" * 16,), ("| | | | | | | |",), ("■ a ■ ■ ■ ■",), ("a" * 20,), ("short",), ("",)]
    got = values(spark, rows, "t string", T.is_colophon(F.col("t")), T.is_symbol_noise(F.col("t")))
    assert got == [(True, False), (False, False), (True, False), (False, True), (False, True), (False, False), (False, False), (False, False), (False, False)]


def test_admin_chunks_with_hangul(spark):
    sentence = "이 법은 개인정보의 처리 및 보호에 관한 사항을 정한다."
    rows = [(sentence,), ("제1장 총칙 목차",), ("2024-01-01 부서 02-123-4567 abc",), ("x" * 500,), (sentence * 20,), ("",)]
    assert [r[0] for r in values(spark, rows, "t string", T.is_admin(F.col("t")))] == [False, True, True, False, False, True]


def slow_leaders(texts, threshold, newer_first):
    leader = {}
    for i, a in enumerate(texts):
        if i in leader:
            continue
        for j in range(i + 1, len(texts)):
            x, y = (texts[j], a) if newer_first else (a, texts[j])
            if j not in leader and (x == y or SequenceMatcher(None, x, y).ratio() >= threshold):
                leader[j] = i
    return leader


@pytest.mark.parametrize("newer_first", [False, True])
def test_leaders_of_near_questions(spark, newer_first):
    rng = random.Random(17)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        texts.append("".join(t))
    texts += ["", "", "tide", "diet", "tide"]
    rows = spark.createDataFrame([("run", i, t) for i, t in enumerate(texts)], "k string, i int, t string").repartition(3)
    got = {r["i"]: r["leader"] for r in similarity.near_leaders(rows, "k", "i", "t", 0.70, newer_first).collect() if r["leader"] is not None}
    want = slow_leaders(texts, 0.70, newer_first)
    assert got == want and len(want) > 20


@given(st.text("abcd", min_size=1, max_size=150), st.text("abcd", min_size=1, max_size=150))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    found = similarity.common_lengths(["x" * 100, a, "b"], [b, "a"], np.array([[1, 0], [0, 0], [2, 1]]))
    assert found.tolist() == [row[-1], 0, 0]
    # what two texts share in characters bounds it, so no pair is lost
    counts = similarity.folded_counts([a, b])
    assert np.minimum(*counts).sum() >= row[-1]
    assert [0, 0] in similarity.may_reach(counts[:1], counts[1:], 2 * row[-1] / (len(a) + len(b))).tolist()
    assert 2 * row[-1] >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) * 2


def test_statistics_of_runs(spark):
    qa = [("a", i, f"question number {i} of run a?", "yes", "c" * 20, "d1", "fact") for i in range(3)] + [("b", 0, "What?", "", None, "d1", None), ("b", 1, "something else entirely", "x", "c", "d2", "how")]
    rows = spark.createDataFrame(qa, "run string, n int, q string, a string, context string, doc string, intent string")
    got = {r["run"]: r.asDict() for r in statistics.layer(rows, "run", "n").collect()}
    assert got["a"]["duplication"] == 0.0 and got["b"]["duplication"] == 10.0
    assert got["a"]["skewness"] == 2.0 and got["b"]["skewness"] == 8.0
    # two of ten fields of run b are empty, and an intent
    assert got["a"]["sufficiency"] == 10.0 and got["b"]["sufficiency"] == 7.0
    assert got["a"]["diversity"] == round(5 * 0.6 + 8 / 18 * 10 * 0.4, 2) and got["b"]["diversity"] == 10.0
    assert statistics.layer(rows.limit(0), "run", "n").count() == 0


def test_numbers_of_rows(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-5000, 5000), 300)
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint").repartition(5)
    for width in (1, 7, 20):
        assert {r["i"]: r["number"] for r in store.positions(rows, "i", partitions=width).collect()} == {i: k for k, i in enumerate(sorted(ids), 1)}


def slow_continued(items):
    out = []
    for text, y0, y1, font, table in items:
        t = text.strip()
        if out and not table:
            before, last = out[-1][0].rstrip(), out[-1]
            korean = re.match(r"^[가-힣]{1,4}(?:[\s.,。;!?]|$)", t) and re.search(r"[가-힣][\s①-⑳]*$", before) and not (y0 - last[2] > 15 and abs(last[3] - font) > 1.5)
            if korean:
                base = before.rstrip(" ①②③④⑤")
                out[-1] = (base + t + before[len(base) :], *last[1:])
                continue
            if re.match(r"^(\([A-Za-z]|[A-Z][a-z]+\))", t):
                out[-1] = (f"{before} {t}", *last[1:])
                continue
        out.append((text, y0, y1, font, table))
    return [x[0] for x in out]


def test_blocks_that_go_on(spark):
    rng = random.Random(5)
    words = ["알고리즘개 ③", "발", "니 된다.", "(Return on)", "Abc) x", "하여야 한", "text", "제목", "ROI ", "발전하는 것", "① 가"]
    rows = []
    for k in range(60):
        y, items = 0.0, []
        for _ in range(rng.randrange(0, 12)):
            y += rng.choice([5.0, 12.0, 30.0])
            items.append((rng.choice(words), y, y + rng.choice([2.0, 10.0]), rng.choice([10.0, 11.0, 14.0]), rng.random() < 0.1))
        rows.append((k, items))
    schema = "k int, items array<struct<text:string,y0:double,y1:double,font:double,is_table:boolean>>"
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, schema).select("k", F.transform(R.continued(F.col("items")), lambda x: x["text"]).alias("t")).collect()}
    assert got == {k: slow_continued(items) for k, items in rows}
    assert any(len(got[k]) < len(items) for k, items in rows)


def slow_absorbed(texts, sources, threshold):
    kept = []
    for i, (t, s) in enumerate(zip(texts, sources)):
        for k, (place, own, of) in enumerate(kept):
            a, b = set(t.split()), set(own.split())
            c, d = set(s), set(of)
            if (a | b and len(a & b) / len(a | b) > threshold) or (c | d and len(c & d) / len(c | d) > threshold):
                if len(t) > len(own):
                    kept[k] = (place, t, s)
                break
        else:
            kept.append((i, t, s))
    return [x[:2] for x in kept]


@given(st.lists(st.tuples(st.text("abc ", max_size=12), st.lists(st.integers(0, 4), max_size=3)), max_size=15), st.sampled_from([0.3, 0.5]))
@settings(max_examples=150, deadline=None)
def test_absorbing(rows, threshold):
    texts, sources = [t for t, _ in rows], [s for _, s in rows]
    assert blocks.absorbed(texts, threshold, sources) == slow_absorbed(texts, sources, threshold)
    assert blocks.absorbed(texts, threshold) == slow_absorbed(texts, [[]] * len(rows), threshold)


@given(st.lists(st.text("ab ,", max_size=6).map(lambda t: t), max_size=8), st.data())
@settings(max_examples=150, deadline=None)
def test_conjunctions(texts, data):
    texts = [t + data.draw(st.sampled_from(["", " 또한", ", 이를 통해 ", " 또한 그러나"])) for t in texts]
    want = list(texts)
    for i in range(len(want) - 1):
        if found := blocks.DANGLING.search(want[i]):
            want[i + 1] = found.group().strip().lstrip(",").strip() + " " + want[i + 1].lstrip()
            want[i] = want[i][: found.start()].rstrip()
    assert blocks.conjunctions_moved(texts) == want


def test_next_chunk_is_stripped_before_the_article_test():
    assert blocks.merged(["short", "  제1조 목적"], 300, 1200) == [(0, "short"), (1, "  제1조 목적")]
    assert blocks.merged(["short", "제1 조 목적"], 300, 1200) == [(0, "short\n제1 조 목적")]


def test_batches_with_their_contexts():
    assert blocks.batch_ranges([1] * 7, 3, 100, 2) == [(0, 0, 0, 2), (1, 1, 3, 5), (2, 4, 6, 6)]
    assert blocks.batch_ranges([], 3, 100, 2) == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test data")
def test_fold_queries_against_loops(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r["document_id"], r["chunk_index"]): r["content"] for r in chunks.r10_similar_chunks(spark, sf).collect()}
    assert got == {(d, i): t for d, own in texts.items() for i, t in slow_absorbed(own, [[]] * len(own), 0.5)}
    got = {(r["document_id"], r["chunk_index"]): r["content"] for r in chunks.r10_similar_sources(spark, sf).collect()}
    assert got == {(d, i): t for d, own in texts.items() for i, t in slow_absorbed(own, [[k - 1, k] for k in range(len(own))], 0.3)}


def test_answers_of_models(spark):
    given_blocks = [(3, 7, "first line\nmore"), (4, 8, "other")]
    answers = ['[{"text": "x", "section_title": "", "source_blocks": [9, 4, 3]}]', "```json\n[]\n```", "no json", '[{"text": null, "section_title": "t", "source_blocks": [3]}, {"text": "y", "source_blocks": [1]}]', "", '{"a": 1}']
    rows = [(k, a, given_blocks) for k, a in enumerate(answers)]
    got = spark.createDataFrame(rows, "k int, a string, b array<struct<index:int,page:int,text:string>>").select("k", R.answered_chunks(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()
    fallback = [("first line\nmore", "first line", [3], 7), ("other", "other", [4], 8)]
    assert [[tuple(c) for c in r["c"]] for r in got] == [[("x", "x", [4, 3], 8)], [], fallback, [(None, "t", [3], 7)], fallback, fallback]


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for name in ("loomdoc", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eval_summary' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    # a broken module is not taken for an absent folder
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}).returncode
