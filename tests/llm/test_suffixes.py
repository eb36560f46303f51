import random

from lockstep.llm.suffixes import suffix_array


def plain(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def test_equals_plain_sorting():
    rng = random.Random(1)
    assert suffix_array([]) == [] and suffix_array([5]) == [0]
    for _ in range(3000):
        text = rng.choices(range(rng.choice([1, 2, 3, 20])), k=rng.randrange(1, 60))
        assert suffix_array(text) == plain(text), text
    for text in ([1] * 300, [1, 2] * 150, [2, 1] * 150 + [2], list(range(100)), list(range(100))[::-1], list(b"abracadabra" * 20)):
        assert suffix_array(text) == plain(text)
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    assert suffix_array(b) == plain(b)
