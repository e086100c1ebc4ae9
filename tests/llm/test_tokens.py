import random

import numpy as np

from lumenloom.llm.fertility import Fertility, token_measures
from lumenloom.llm.tokens import Ids, JointIds, public_path, public_pattern

ODD = ["", " ", "\n", " a", "a ", "a\n", "\na", "a  b", "x\0y", "a b\x1cc", "it's, he'll.\n#tag 12,5", "日本語 テキスト。", "😀 é <|endoftext|>"]


def vocabularies():
    return tuple(Ids(public_path(v), public_pattern()) for v in Fertility().vocabularies)


def texts(seed, n):
    r = random.Random(seed)
    return ODD + ["".join(r.choice("ab' ,.\n1é語😀") for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_joint_ids_are_those_of_each_vocabulary():
    vocabs = vocabularies()
    for limit in (800_000, 4):
        ids = JointIds(vocabs, limit)
        for text in texts(1, 400):
            got = ids.of(text)
            for v, low, high in zip(vocabs, ids.starts, [*ids.starts[1:], 1 << 32]):
                assert (got[(got >= low) & (got < high)] - low).tolist() == v.encode(text).tolist(), text
        assert len(ids) == 4 or limit > 4


def test_known_cuts_ask_no_vocabulary():
    vocabs = vocabularies()
    ids = JointIds(vocabs)
    first = ids.of("one two\nthree two")
    for v in vocabs:
        v.encode = None
    assert ids.of("one two\nthree two").tolist() == first.tolist() and len(ids.of("three\none")) > 0


def test_measures_of_two_vocabularies_in_one_pass():
    r = np.random.default_rng(2)
    fallback = r.random(70) < 0.3
    for a, b in ((0, 0), (0, 5), (9, 0), (40, 300)):
        x, y = r.integers(0, 30, a).astype("<u4"), r.integers(0, 40, b).astype("<u4")
        want = token_measures(x, 17, fallback[:30]) + token_measures(y, 17, fallback[30:])
        mixed = r.permutation(np.concatenate([x, y + np.uint32(30)]))
        assert token_measures(mixed, 17, fallback, (0, 30)) == want
