"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["h", "n", "key", "line", "slot", "g", "score", "band", "row", "word", "kept", "rest", "root", "id"]
PROSE = "the river runs past the old mill and the miller counts his sacks of flour by the light of one lamp".split()


def table(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source) with further columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def odd_rows(seed=1):
    draw = random.Random(seed)
    base = [" ".join(draw.choices(PROSE, k=draw.randint(8, 60))) for _ in range(12)]
    long = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(20_000))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, " \t\n"), (23, long), (24, base[0]), (25, base[0]), (26, base[1] + " more"), (27, "é ß ñ 漢字 \U0001f600")]
    rows += [(28, "one line of text that stands twice\none line of text that stands twice\n"), (28, "one line of text that stands twice\none line of text that stands twice\n")]
    rows += [(None, base[2]), (29, base[2][:-1] + "x"), (30, "a" * 300), (31, "<|endoftext|> a  <|endoftext|>"), (32, "it's  two  spaces \n x")]
    return rows
