import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, th string, size string, n_lines int, key string, features string"


def frame(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    full = [(i, t, "en", s, None, "x", None, "y", 7, "k", None) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages and lines, nulls, empty and
    long texts, repeated rows, one id with two texts, rows without id, and ties."""
    rnd = random.Random(11)
    vocabulary = ["the", "of", "and", "Über", "in", "to", "é", "is"] + [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, menu = prose(70), "Home | About | Contact 12"
    base = [prose(rnd.randint(3, 160)) for _ in range(24)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s0") for i in range(6)]                               # exact copies
    rows += [(120 + i, base[0] + f" end{i}", "s0") for i in range(6)]                    # near copies
    rows += [(140 + i, f"{prose(20)}\n{passage}\n{prose(15)}", "s1") for i in range(8)]    # a shared passage
    rows += [(160 + i, f"{menu}\n{prose(40)}\n  {menu.upper()}\t", "s2") for i in range(14)]   # a shared line
    rows += [(180, f"{menu}\n{prose(9)}\n{menu}", "s2"), (181, menu, "s2"), (182, f"{menu}\n{menu}\n\n", "s2")]
    rows += [(200, None, "s0"), (201, "", None), (202, " \t\n\x0b\x0c\r ", "s1"), (203, "one", "s1"), (204, "one two", None)]
    rows += [(205, prose(6000) + "\n" + passage, "s0"), (206, "z " * 3000, "s0"), (207, "\n".join(["same line"] * 50), "s1")]
    rows += [(208, base[3], "s1"), (208, base[3], "s1"), (209, base[4], "s1"), (209, prose(60), "s1")]
    rows += [(None, None, None), (None, base[5], "s0"), (None, base[5], "s0"), (None, passage, None), (None, prose(12), "s2")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
