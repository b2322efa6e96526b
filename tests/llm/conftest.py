import random

import pytest

SYLLABLES = "ka lo mi tan ver sol en dar pu ri go nel".split()


def prose(rng, n, small=("the", "of", "and", "to", "in")):
    return " ".join(rng.choice(small) if rng.random() < 0.3 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, edge cases."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(60)]
    shared = prose(rng, 60)
    out = list(base)
    out += [base[3], base[3], base[7].upper(), base[7].replace(" ", "\n")]
    for k in range(8):
        w = base[10].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    for k in range(6):
        out.append(f"{base[k + 20]} {shared} {base[k + 30]}")
    out += [None, "", "  \n\t ", "one", "one two", "a b c", "été ÉTÉ x y", prose(rng, 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s0", None, "s2")[i % 4], i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
