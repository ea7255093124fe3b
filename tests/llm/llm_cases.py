"""Documents with every awkward case, and an empty table of the same columns."""

import random

KIND = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, digest string, "
        "file string, row long, component long, key long, n long, rep long, label int")


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = words(9, 6000)
UNBROKEN = "xy" * 20_000
ROWS = [
    (1, words(1, 60)), (2, words(1, 60).replace(" ", " \n ")), (3, words(1, 59)), (3, words(1, 59)), (4, words(2, 40)),
    (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, LONG), (9, UNBROKEN), (None, words(1, 60)), (None, None),
    (10, "one"), (11, "ONE"), (12, "!!! 123 ..."), (13, "Éa ß 漢字 \U0001F600 ▁x <|endoftext|>"), (14, LONG + " end"),
]


def frame(spark, rows=ROWS):
    full = [(i, t, None if k % 5 == 4 else "ab"[k % 2], None if k % 4 == 3 else "s", None, 1.0, None, "d", "f", k, 7, 8, 9, 10, 1)
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, KIND).coalesce(2)


def empty(spark):
    return spark.createDataFrame([], KIND)
