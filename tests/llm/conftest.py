import random

import pytest

import granary.workspace

WORDS = "the of and to a in is it that for stone river cloud Émile größe señor 12 3,5 x-y don't It's".split()


def prose(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", ". ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty, repeated and very long ones."""
    r = random.Random(11)
    out = [prose(r, r.randint(0, 80)) for _ in range(60)]
    out[3:9] = [None, "", " \n\t ", out[10], out[10], prose(r, 20_000)]
    out += ["日本語のテキスト 🦊", "a\x1cb\x1dc \x85 d e", "  lead", "trail  \n", "x" * 3000, "end<|endoftext|>mid", "...", "1 2  3   4"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    granary.workspace.ship_package(spark)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s0", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def vocabulary():
    from granary.llm.queries import vocabulary

    return vocabulary
