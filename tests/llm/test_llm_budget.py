"""Steps made cheaper: the same results by fewer operations."""

import random

import numpy as np

from loomdoc.llm import packing, prefix_tree
from loomdoc.llm.clusters import Joined


def test_ids_of_parts_are_those_of_whole_texts():
    tokens, rnd = packing.Tokens(packing.default_ranks()), random.Random(5)
    end = np.array([tokens.end], tokens.kind).tobytes()
    pieces = ["a", "the", " ", "  ", "\n", "\t", "　", " ", "\r\n", "12", "é", "한", "!?", "'s", " of the"]
    for x in ["", " ", "a ", " a", "\n", "a\n", *("".join(rnd.choices(pieces, k=rnd.randrange(9))) for _ in range(3000))]:
        assert tokens.ids(x, end).tolist() == [*tokens.encoder.encode_ordinary(x), tokens.end]
    assert all(x and not x[0].isspace() and not x[-1].isspace() for x in tokens.kept)


def test_some_subtrees_are_left_before_their_run():
    rnd = random.Random(7)
    sets = [sorted(rnd.sample(range(1 << 40), 60)) for _ in range(300)]
    # every tenth with a copy that has two elements more
    sets += [sorted({*own, rnd.randrange(1 << 40), rnd.randrange(1 << 40)}) for own in sets[::10]]
    members, joined = [prefix_tree.Member(i, len(own), own) for i, own in enumerate(sets)], Joined(len(sets))
    tree, found = prefix_tree.PrefixTree(members, joined, 85, 100), []
    for i, m in enumerate(members):
        found += [(i, j) for j, _ in tree.near(m, i)]
        tree.add(i)
    assert sorted(found) == [(300 + k, 10 * k) for k in range(30)]
    # 54,211 looks at runs before the first elements were asked
    assert tree.visited < 53_500
