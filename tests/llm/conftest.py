import random

import pytest

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "den lor mis pan rut sal tev".split()]


@pytest.fixture
def sentence():
    """Reproducible prose: sentence(seed, n) gives n words."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text, source) rows with a clashing extra column."""

    def make(rows):
        rows = [(i, t, "en", s, len(t or ""), "x") for i, t, s in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, h string")

    return make
