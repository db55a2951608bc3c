import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def edge_rows():
    """Documents with nulls, blanks, ties, repeats, long and odd texts."""
    random.seed(3)
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "Über", "naïve", "日本", "x,", "y."]
    long = " ".join(random.choice(words) + str(random.randrange(50)) for _ in range(4000))
    base = [random.choice(words) + random.choice(words) for _ in range(60)]
    near = [*base]
    near[30] = "changed"
    return [
        (0, " ".join(base)), (1, " ".join(base)), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, long), (9, long + " tail"),
        (10, "A b C d E f g\x0bh\x0ci"), (11, "line\nline\nline\n\nother line"), (11, "line\nline\nline\n\nother line"), (None, " ".join(base)), (None, None),
        (12, "start " + " ".join(base[:20]) + " end"), (13, "***" * 40), (14, "<|endoftext|> word <|im_end|>"), (15, "one two three"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with further columns whose names results also use."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2, True) for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, component_id string, n_tokens int, kept boolean")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
