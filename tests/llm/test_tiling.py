"""Greedy string tiling against the plain definition."""

import random
import time

from timberline.llm.decontamination import tile


def by_hand(item, text, least):
    """The longest common unmarked runs, by text start and then item start, marked until none of ``least`` words is left."""
    a, b, covered = [False] * len(item), [False] * len(text), 0
    for n in range(min(len(item), len(text)), least - 1, -1):
        for j in range(len(text) - n + 1):
            for i in range(len(item) - n + 1):
                if item[i:i + n] == text[j:j + n] and not any(a[i:i + n]) and not any(b[j:j + n]):
                    a[i:i + n] = b[j:j + n] = [True] * n
                    covered += n
    return covered


def test_tiles_equal_the_definition():
    dice = random.Random(5)
    for _ in range(600):
        letters = range(1, dice.choice((2, 3, 5)) + 1)
        item, text = (dice.choices(letters, k=dice.randint(0, 30)) for _ in range(2))
        least = dice.randint(1, 5)
        assert tile(item, text, least) == by_hand(item, text, least), (item, text, least)


def test_repeated_words_take_seconds():
    started = time.monotonic()
    assert tile([1] * 400, [1] * 20_000, 5) == 400
    assert tile([1, 2] * 200, [2, 1] * 5_000, 5) == 400
    assert time.monotonic() - started < 20
