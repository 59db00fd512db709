"""Small documents with every awkward case, and a table with clashing column names."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = SCHEMA + ", row int, size int, key int, id int, fp int, h int, cell int, copies int, score int, shard int, n int"


def make_rows(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, "en", rng.choice(["src0", "src0", "src1", "src2", None]), len(text)))
    near = rows[3][1].split()
    rows.append((n, " ".join(near), "en", "src0", 1))
    rows.append((n + 1, "\t" + rows[3][1].upper() + "  ", "en", "src1", 1))
    rows.append((n + 2, None, None, None, None))
    rows.append((n + 3, "", "en", "src1", 0))
    rows.append((n + 4, " \n\t ", "en", "src1", 4))
    rows.append((n + 5, "two words", "en", "src1", 9))
    rows.append((n + 6, "long " * 5000, "en", "src2", 25000))
    rows.append((None, "without an id", "en", "src2", 13))
    rows.append((5, rows[5][1], "en", rows[5][3], rows[5][4]))  # the same row again
    rows.append((7, "another text under a used id", "en", "src1", 1))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *range(1, 12)) for r in rows], CLASHING)
