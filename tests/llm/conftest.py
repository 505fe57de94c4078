import random

import pytest

WORDS = "the of and river stone cloud paper green quiet market window letter seven morning garden".split()


@pytest.fixture
def prose():
    """Deterministic invented texts by number and length."""

    def make(number: int, n_words: int) -> str:
        draw = random.Random(number)
        return " ".join(f"{draw.choice(WORDS)}{draw.randrange(400)}" for _ in range(n_words))

    return make
