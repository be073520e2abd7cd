"""Small documents with everything that tables may hold: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, token string, __id long"


def rows(n=60, seed=3):
    rnd = random.Random(seed)
    pool = ["The", "and", "over", "naïve", "straße", "año", "x", "token:", "Zürich.", "9", "--", "e\u0301", "it's", "HELLO"]
    gaps = [" ", " ", " ", "  ", "\n", " \n \n", "\t", "\u00a0", "   "]
    out = []
    for i in range(n):
        text = "".join(rnd.choice(pool) + rnd.choice(gaps) for _ in range(rnd.randrange(0, 60)))
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "é", None]), len(text), 5, "t", 1))
    out += [(100, None, "en", "a", None, None, None, None), (101, "", None, None, 0, 1, "", 2), (None, "a b c d", "en", "b", 7, 1, "", 2)]
    out += [(102, "long " * 9000, "en", "b", 1, 1, "x", 1), (103, "w" * 30000, "en", "c", 1, 1, "x", 1)]
    return [*out, out[0], out[1], out[1]]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def write_documents(spark, folder, data=None):
    documents(spark, data).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder
