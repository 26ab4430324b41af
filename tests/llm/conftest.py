import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so", "ne", "pa") for b in ("ra", "li", "mo", "te", "nu", "sa", "bo", "vi")]


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text and source: prose, exact and near copies, repeated lines, odd texts."""
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = ["\n".join(prose(rng.randint(8, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    base = prose(150)
    for _ in range(40):
        words = base.split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [texts[1].upper(), "", None, "one two", "one  two", "one two three", " \n\t", "of " * 400, "of " * 399, texts[2] + "\n" + texts[3], "é" * 300, "é" * 300 + "x", prose(6000)]
    return [(i, t, f"src{i % 3}" if i % 11 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(3)
