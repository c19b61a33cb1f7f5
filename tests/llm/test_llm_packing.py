import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdoc.llm import packing


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=80, deadline=None)
def test_best_fit_is_that_of_a_plain_search(lengths):
    rows = packing.best_fit(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    free = []
    for n in sorted(lengths, reverse=True):  # plain best fit decreasing, by the spaces alone
        fit = [s for s in free if s >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(64 - n)
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_tokens_are_those_of_whole_texts():
    t = packing.Tokens(packing.default_ranks())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab éß1,.!\n\t  '漢") for _ in range(80)) for _ in range(300)] + ["a b", " a", "a ", "a  b", "a \nb", "don't we'll", ""]
    for x in texts:
        assert t.encode(x) == t.encoder.encode_ordinary(x)


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000, None), (10_001, "word " * 9000)], docs.schema))
    rows = packing.pack(docs, size=256, window=20_000)
    t, got = packing.Tokens(packing.default_ranks()), defaultdict(dict)
    for r in rows.collect():
        assert len(r["ids"]) == 2 * r["n_tokens"] <= 512 and r["cu_lengths"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_lengths"][:-1]
    for r in packing.unpack(rows).collect():
        got[r["doc_id"]][r["start"]] = r["ids"]
    for doc_id, text in docs.collect():
        assert [i for s in sorted(got[doc_id]) for i in got[doc_id][s]] == t.encode(text or "") + [t.end]
    assert packing.pack(docs.limit(0)).count() == 0


def test_wide_capacities():
    c = packing.Capacities(10)
    assert c.least(1) is None
    c.add(4, 0)
    c.add(7, 1)
    assert (c.least(1), c.least(5), c.least(8)) == (4, 7, None)
    assert c.take(4) == 0 and c.least(1) == 7
    assert np.dtype("<u2").itemsize == 2
