"""Pairs of near questions: bounds that lose none, and a shuffle that grows with the rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import similarity


def questions(n: int, seed: int) -> list[str]:
    """Texts of three kinds and all lengths around 200, every other one a change of an earlier one."""
    rnd = random.Random(seed)
    kinds = ["the an in er on st re at en is or ti ly ed".split(), "ein sch cht ung ver ä ü en de be ge".split(), list("가나다라마바사아자차카타파하")]
    out = ["", "a", "aa", "x" * 260, "\U0001f600" * 40]
    while len(out) < n:
        if rnd.random() < 0.5:
            kind, words = rnd.choice(kinds), rnd.randrange(1, 60)
            out.append(" ".join("".join(rnd.choices(kind, k=rnd.randrange(1, 4))) + rnd.choice(["", "", "", ",", "."]) for _ in range(words)))
            continue
        text = list(rnd.choice(out))
        for _ in range(rnd.randrange(1 + len(text) // 3)):
            at = rnd.randrange(len(text))
            text[at] = rnd.choice(["", "q", "e ", text[at] * 2, rnd.choice(text)])
        out.append("".join(text))
    return out


@pytest.mark.parametrize("threshold, newer_first", [(0.7, False), (0.75, True), (0.4, False), (0.95, True)])
def test_tiles_lose_no_pair(threshold, newer_first):
    texts = questions(260, 7)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    ratio = lambda i, j: SequenceMatcher(None, *((texts[j], texts[i]) if newer_first else (texts[i], texts[j]))).ratio()
    want = {(i, j, r) for j in range(len(texts)) for i in range(j) if (r := ratio(i, j)) >= threshold}
    assert len(want) > 50 and any(len(texts[i]) >= 200 for i, _, _ in want) and any(0 < len(texts[i]) < 100 for i, _, _ in want)
    assert sorted(similarity._near(rows, None, threshold, newer_first)) == sorted(want)
    first, second = rows[:90], rows[90:]
    found = [*similarity._near(first, None, threshold, newer_first), *similarity._near(second, None, threshold, newer_first), *similarity._near(first, second, threshold, newer_first)]
    assert sorted(found) == sorted(want)


def test_the_shuffle_grows_with_the_rows(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    def shuffled(n: int) -> int:
        before = written()
        rows = spark.range(n).select(F.lit("run").alias("k"), "id", F.md5(F.col("id").cast("string")).alias("t"))
        # groups or blocks of 25 rows
        similarity.near_pairs(rows, "k", "id", "t", 0.9, False, 25).collect()
        return written() - before

    assert shuffled(4800) < 6 * shuffled(1200)


def test_runs_of_many_groups(spark):
    texts = questions(120, 11)
    rows = spark.createDataFrame([(key, n, t) for key in ("a", None, "b") for n, t in enumerate(texts)] + [("c", 0, "alone"), ("d", 1, None)], "k string, n int, t string")
    want = {(i, j) for j in range(len(texts)) for i in range(j) if SequenceMatcher(None, texts[i], texts[j]).ratio() >= 0.7}
    for group in (1, 7, 1000):
        found = similarity.near_pairs(rows, "k", "n", "t", 0.7, False, group).collect()
        assert sorted((r["k"], r["older"], r["newer"]) for r in found) == sorted((k, i, j) for k in "ab" for i, j in want)


@pytest.mark.parametrize("name", ["g14_statistics_layer", "q08_final_with_statistics"])
def test_texts_of_contexts_are_not_shuffled(spark, tmp_path, name):
    from loomdoc import catalog

    def shuffled(size: int) -> int:
        folder = str(tmp_path / str(size))
        rnd = random.Random(2)
        docs = [(n, "".join(rnd.choices("abcdefghijklmnop ", k=size)), "en", f"s{n % 3}", size) for n in range(40)]
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
        turns = [(n, t, role, f"{role} number {n * 7919 % 1000} says") for n in range(40) for t, role in enumerate(("user", "assistant"))]
        spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        spark.createDataFrame([(n, 1, 0) for n in range(40)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
        store = spark.sparkContext._jsc.sc().statusStore()
        before = store.executorSummary("driver").totalShuffleWrite()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert len(catalog.QUERIES[name](spark, folder).collect()) == 1
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        return store.executorSummary("driver").totalShuffleWrite() - before

    # 40 texts of 20,000 characters are some 500,000 bytes
    assert shuffled(20_000) < shuffled(100) + 100_000
