"""Document quality rules and the frequency of lines across a host's documents, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import SPACES, stored

_GAP = r"[\x20\x09-\x0D]+"
_SALTS = 16
LINE_SHARE, LINE_DOCUMENTS, LEFT_SHARE, LEFT_WORDS = 0.1, 20, 0.5, 10


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def repeated_window_words(tokens: Column, hashes: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more among ``hashes``, one hash per window.

    Only a text with a repeated window sorts its windows; each repeated window
    then adds the words up to the next one.
    """

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)
        places = F.filter(
            F.transform(
                ordered,
                lambda x, j: F.when(
                    ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(ordered, j + 1)["h"] == x["h"])),
                    x["i"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return _bind(
            F.sort_array(places),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    located = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bind(located, covered)).otherwise(F.lit(0).cast("long"))


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, host``, the base counts, ``base_failed`` and ``lines`` (hash and words of each line with a word)."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("l"),
    )
    rows = rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    wh = F.col("wh")
    rows = rows.withColumn(
        "windows",
        F.when(
            F.size("wh") >= 5,
            F.transform(F.slice(wh, 1, F.size("wh") - 4), lambda a, i: F.xxhash64(a, *[F.get(wh, i + k) for k in range(1, 5)])),
        ).otherwise(F.array().cast("array<long>")),
    )
    normal = lambda x: F.regexp_replace(F.lower(F.btrim(x, F.lit(SPACES))), _GAP, " ")
    rows = rows.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w"), F.col("windows")).alias("n_repeat_words"),
        F.transform(
            "l", lambda x: _bind(normal(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.size(F.split(y, " ")).alias("n")))
        ).alias("lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def line_frequency(
    docs: DataFrame,
    line_share: float = LINE_SHARE,
    line_documents: int = LINE_DOCUMENTS,
    left_share: float = LEFT_SHARE,
    left_words: int = LEFT_WORDS,
) -> DataFrame:
    """Base counts of every whole text and the verdict of the line frequencies.

    Lines are trimmed, lower-cased, their white space made single, and hashed.
    A line in more than ``line_documents`` documents of a host and in more than
    the share ``line_share`` of the host's documents is removed there. A
    document is kept if the base rules pass and, without those lines, at least
    ``left_words`` words and the share ``left_share`` of its words are left.

    Counting combines before its shuffle; the join with the frequent lines is
    salted by row, so a line that a third of all documents share is split.

    Null texts count as empty, a null host as the empty host, each row as one
    document (repeated rows give equal rows, each counted). Extra columns are
    ignored; an empty table gives no rows.
    """
    base = stored(base_rules(docs).withColumn("row", F.monotonically_increasing_id()))
    hosts = base.groupBy("host").agg(F.count("*").alias("documents"))
    seen = base.select("host", F.explode(F.array_distinct(F.col("lines")["h"])).alias("h"))
    often = (
        seen.groupBy("host", "h")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > line_documents)
        .join(hosts, "host")
        .filter(F.col("n") > line_share * F.col("documents"))
        .select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    )
    occurrences = base.select(
        "row", "host", F.pmod(F.col("row"), F.lit(_SALTS)).cast("int").alias("salt"), F.inline("lines")
    )
    removed = occurrences.join(often, ["host", "h", "salt"]).groupBy("row").agg(F.sum("n").alias("removed"))
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    return base.drop("lines").join(removed, "row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (left >= left_words) & (left >= left_share * F.col("n_words"))).alias("kept"),
        F.coalesce(F.col("removed"), F.lit(0)).cast("long").alias("n_removed_words"),
    )
