import random

import numpy as np

from lockstep.llm.chars import Words


def test_runs_do_not_depend_on_their_neighbours():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abÉ ,!\n7漢😀", k=rng.randrange(30))) for _ in range(200)] + ["x" * 300, "x" * 301]
    for by_space in (False, True):
        whole = Words(texts, by_space, (3,))
        for i, t in enumerate(texts):
            alone = Words([t], by_space, (3,))
            mine = whole.text == i
            for name in ("hash", "kind", "length", "capital"):
                assert np.array_equal(getattr(whole, name)[mine], getattr(alone, name)), (name, t)
            assert np.array_equal(whole.prefix[3][mine], alone.prefix[3])
    a, b, c = Words(["Abc abc aBc abd"]).hash[[0, 1, 3]]
    assert a == b != c and Words(["x" * 300]).hash[0] != Words(["x" * 301]).hash[0]


def test_shingles_stay_in_their_text():
    words = Words(["a b c d e f", "", "a b", "a b c d e"])
    text, h = words.shingles(5)
    assert text.tolist() == [0, 0, 2, 3] and h[0] == h[3] != h[1]
