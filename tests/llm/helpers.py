"""Small document tables with the awkward cases, and plain versions of the word rules."""

import random
import re

WORDS = re.compile("[^ \t-\r]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or whole rows."""
    whole = [r if len(r) == 5 else (*r, "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(whole, schema).repartition(3)


def awkward(seed=1, n=40):
    """Null, empty, blank and long texts, null ids and columns, copies and repeated rows."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["of", "the", "é", "漢字", "😀"]
    text = lambda m: " ".join(rnd.choice(vocab) for _ in range(m))
    rows = [(k, text(rnd.randint(0, 120))) for k in range(n)]
    rows += [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r"), (103, text(6000)), (None, text(30)), (None, None), (104, "one"), (105, "one\ttwo\nthree  four")]
    rows += [(200 + k, rows[3][1]) for k in range(4)] + [(k, t.replace(" ", "\n")) for k, t in rows[5:8]] + [rows[9], rows[9]]
    rows = [(*r, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None, "é"]), None) for r in rows]
    return rows


def clashing(df):
    """``df`` with columns named like those that the operators make inside."""
    from pyspark.sql import functions as F

    names = ["_row", "_id", "_sha", "_digest", "_size", "_key", "_nth", "fp", "hash", "doc", "packs", "size", "target", "kept", "score", "words", "host", "label", "n", "q", "_copies", "_total", "_held", "n_words"]
    return df.select("*", *(F.lit("x").alias(n) for n in names))


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
