"""Line deduplication by a segment-partition edit join, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import SPACES, stored

THRESHOLD, LEAST_CHARS = 2, 20
_SALTS, _SLOTS = 16, 1 << 20
_BLOCK, _OFTEN = 256, 64
_COUNTED = " etaoinshrdlu.,"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def bucket(n: Column) -> Column:
    """The least length of the bucket of length ``n``: eight buckets between powers of two, one for each length below 16."""
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.floor(F.log2(n)).cast("int") - 3))
    return n - n % width


def places(threshold: int) -> list[tuple[int, int, int]]:
    """Places (delta, i, shift): segment i, ``shift`` characters further right, in the bucket of a line ``delta`` shorter.

    All lines of a bucket have segments of the same sizes, the first half measured
    from their left end and the others from their right end. Of two lines within
    reach some segment i has i edits before it and threshold - i after it at most,
    so it has moved by no more than that from its end.

    For two edits a middle segment counts only if the outer ones differ, which is
    so in both lines or in none: there is an edit in each of them, the middle of either
    line is whole in the other, and a move to the left is one to the right seen
    from the other line. A longer line of another bucket has no move to the left:
    its second edit would have to add two characters.
    """
    found = []
    for i in range(threshold + 1):
        reach = i if 2 * i <= threshold else threshold - i
        found += [(delta, i, shift) for delta in range(threshold + 1) for shift in range(0 if threshold <= 2 else -reach, reach + 1)]
    return found


def _keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``key, h, own`` of each line and place: hash of bucket, segment number and text; ``own`` marks a line's own segments.

    A line takes part in its own bucket and in those of lines up to ``threshold``
    shorter, so it meets all lines as long or shorter in the bucket of the shorter.
    Places are rows, so one short expression serves all of them. No key where the
    text would leave the line.
    """
    parts = threshold + 1
    rows = F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d, i, s in places(threshold)])
    placed = lines.select("line", "n", "h", F.inline(rows)).withColumn("m", bucket(F.col("n") - F.col("delta")))
    # the bucket of a line one longer is the same: no place of its own
    placed = placed.filter((F.col("delta") == 0) | ((F.col("n") - F.col("delta") > threshold) & (F.col("m") != bucket(F.col("n") - F.col("delta") + 1))))
    longer = F.col("m") % parts - (parts - F.col("i"))
    placed = placed.withColumn("start", F.expr(f"(m div {parts}) * i").cast("int") + F.greatest(F.lit(0), longer) + 1 + F.col("shift") + F.when(2 * F.col("i") <= threshold, 0).otherwise(F.col("n") - F.col("m")))
    placed = placed.withColumn("size", F.expr(f"m div {parts}").cast("int") + (longer >= 0).cast("int"))
    inside = (F.col("start") >= 1) & (F.col("start") + F.col("size") <= F.col("n") + 1)
    text = F.substring(F.col("line"), F.col("start"), F.col("size"))
    own = (F.col("delta") == 0) & (F.col("shift") == 0)
    return placed.filter(inside).select(F.xxhash64("m", "i", text).alias("key"), "h", own.alias("own"))


def common_prefix(one: Column, other: Column, most: Column) -> Column:
    """Length of the common prefix, at most ``most``, by halving steps."""
    steps = F.transform(
        F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e)
    )
    return F.aggregate(
        steps,
        F.lit(0),
        lambda n, step: F.when(
            (n + step <= most) & (F.left(one, n + step) == F.left(other, n + step)), n + step
        ).otherwise(n),
    )


def banded_distance(pattern: Column, text: Column, threshold: int) -> Column:
    """Edit distance if at most ``threshold``, else some larger number.

    ``pattern`` and ``text`` are arrays of characters whose sizes differ by at
    most the threshold. The 2 * threshold + 1 diagonals around the main one are
    the bits of the vertical difference vectors; each character of the text
    updates all of them at once. The distance is followed down the lowest
    diagonal and then along the pattern's last row.
    """
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    m, n = F.size(pattern), F.size(text)

    def bits(x: Column) -> Column:
        return x.bitwiseAND(F.lit(full).cast("long"))

    def step(state: Column, j: Column) -> Column:
        char = F.get(text, j - 1)
        match = sum(
            (F.when(F.get(pattern, j - 1 - t + k) == char, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(width)),
            F.lit(0).cast("long"),
        )
        vp, vn = state["vp"], state["vn"]

        def rows(x: Column) -> Column:
            diagonal = bits((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))

            def columns(d: Column) -> Column:
                plus = bits(vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))))
                minus = d.bitwiseAND(vp)
                lower = F.shiftright(d, 1)
                at = (m - j + t).cast("int")
                down = F.when(d.bitwiseAND(F.lit(1 << (width - 1)).cast("long")) == 0, 1).otherwise(0)
                along = F.getbit(plus, at).cast("int") - F.getbit(minus, at).cast("int")
                return F.struct(
                    bits(minus.bitwiseOR(F.bitwise_not(lower.bitwiseOR(plus)))).alias("vp"),
                    lower.bitwiseAND(plus).alias("vn"),
                    (state["d"] + F.when(j <= m - t, down).otherwise(along)).cast("int").alias("d"),
                )

            return _bind(diagonal, columns)

        # a path within the threshold keeps the lowest diagonal at 3 * threshold or less
        return F.when(state["d"] > 3 * t, state).otherwise(_bind(match, rows))

    start = F.struct(
        F.lit(((1 << (t + 1)) - 1) << t).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(t)).cast("int").alias("d")
    )
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s["d"])


def within(one: Column, other: Column, threshold: int) -> Column:
    """True if the edit distance is at most ``threshold``; common ends are cut off before the banded pass."""

    def prefix_cut(n: Column) -> Column:
        a, b = F.substring(one, n + 1, F.char_length(one)), F.substring(other, n + 1, F.char_length(other))

        def suffix_cut(rest: Column) -> Column:
            x, y = rest["a"], rest["b"]
            shared = common_prefix(F.reverse(x), F.reverse(y), F.least(F.char_length(x), F.char_length(y)))

            def verdict(s: Column) -> Column:
                p, q = F.left(x, F.char_length(x) - s), F.left(y, F.char_length(y) - s)
                shortest, longest = F.least(F.char_length(p), F.char_length(q)), F.greatest(F.char_length(p), F.char_length(q))
                return (
                    F.when(longest - shortest > threshold, False)
                    .when(longest <= threshold, True)
                    .when(shortest == 0, longest <= threshold)
                    .otherwise(_bind(F.struct(F.split(p, "").alias("p"), F.split(q, "").alias("q")), lambda z: banded_distance(z["p"], z["q"], threshold)) <= threshold)
                )

            return _bind(shared, verdict)

        return _bind(F.struct(a.alias("a"), b.alias("b")), suffix_cut)

    return _bind(common_prefix(one, other, F.least(F.char_length(one), F.char_length(other))), prefix_cut)


def _documents(docs: DataFrame) -> DataFrame:
    """All columns and the key (k, k2) of the row's id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__k": F.xxhash64("doc_id", text), "__k2": F.xxhash64(F.lit(1), "doc_id", text)})


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """``k, k2, id, at, line, n, h, h2`` of each trimmed line of at least ``least_chars`` characters; a null id is the least."""
    id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = _documents(docs.select("doc_id", "text")).select(
        F.col("__k").alias("k"), F.col("__k2").alias("k2"), id.alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACES))).withColumn("n", F.char_length("line")).filter(F.col("n") >= least_chars)
    return rows.select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _slot() -> Column:
    return F.pmod("h", F.lit(_SLOTS)).cast("int")


def _in_slots(lines: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``lines`` in slots of the hashes in ``rows`` (or not in them): at most ``_SLOTS`` slots whatever the input, so they are broadcast."""
    slots = F.broadcast(rows.select(_slot().alias("slot")).distinct())
    return lines.withColumn("slot", _slot()).join(slots, "slot", how).drop("slot")


def links(lines: DataFrame, seen: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of different lines within ``threshold`` edits: ``h, h2`` and ``g, g2``, each pair once.

    Only lines of more than ``threshold`` characters have the segments and take
    part. ``seen`` counts the lines (h, n). Lines in the slot of one that stands
    over ``_OFTEN`` times are made distinct; the others stay where they are,
    as a few copies do no harm. Of a key's own members a place meets two
    at most, the least and the largest, which tell whether another line has the
    key; so the join makes no more rows than there are places. All that are
    left, and the entry they meet where it is the only one, are members of their
    keys. Texts are fetched after a slot filter, and members compared within blocks.
    """
    lines = lines.filter(F.col("n") > threshold).select("line", "n", "h", "h2")
    often = seen.filter(F.col("n") > _OFTEN)
    different = _in_slots(lines, often, "left_anti").unionByName(_in_slots(lines, often).distinct())
    keys = _keys(different, threshold).repartition("key")
    own = F.when(F.col("own"), F.col("h"))
    index = keys.groupBy("key").agg(F.min(own).alias("least"), F.max(own).alias("most"))
    met = keys.join(index.hint("merge"), "key").filter("least <> h OR most <> h")
    both = F.array(F.struct("h", "own"), F.struct(F.col("least").alias("h"), F.lit(True).alias("own")))
    met = stored(met.select("key", F.inline(both)).groupBy("key", "h").agg(F.max("own").alias("own")))
    wanted = stored(met.select("h").distinct())
    texts = _in_slots(lines, wanted).join(wanted.hint("merge"), "h", "left_semi").distinct()
    texts = stored(texts.select("*", _counts(F.col("line")).alias("counts")))
    return stored(_compared(met, texts, threshold))


def _counts(line: Column) -> Column:
    """How often each character of ``_COUNTED`` stands in a line, and how many others do."""
    own = [F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit(""))) for c in _COUNTED]
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*own, F.char_length(line) - sum(own, F.lit(0))])])


def _compared(met: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs of members of a key within ``threshold`` edits.

    Members meet a block at a time, and only links become rows. An edit adds one
    to one count of characters at most and takes one from one at most; pairs
    whose lengths or counts are further apart are not compared.
    """
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks")).hint("merge")
    rows = met.join(sizes, "key").join(texts.select("*", F.inline(F.array("counts"))).drop("counts").hint("merge"), "h")
    one = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    other = rows.withColumn("block", F.pmod("h", "blocks").cast("int")).drop("blocks")
    other = other.withColumnsRenamed({c: f"{c}_g" for c in other.columns if c not in ("key", "block")})
    changes = [F.col(f"c{i}") - F.col(f"c{i}_g") for i in range(len(_COUNTED) + 1)]
    near = (F.col("h") < F.col("h_g")) & (F.col("own") | F.col("own_g")) & (F.abs(F.col("n") - F.col("n_g")) <= threshold)
    for sign in (1, -1):
        near &= sum((F.greatest(F.lit(0), sign * c) for c in changes), F.lit(0)) <= threshold
    near &= within(F.col("line"), F.col("line_g"), threshold)
    together = (one["key"] == other["key"]) & (one["block"] == other["block"])
    found = one.join(other.hint("merge"), together & near)
    return found.select("h", "h2", F.col("h_g").alias("g"), F.col("h2_g").alias("g2")).distinct()


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs``, all columns, with repeated lines taken out of ``text``, and the columns ``n_lines``, ``n_removed``, ``n_near``, ``n_links``.

    Lines are compared without white space at their ends; those under
    ``least_chars`` characters stay (with 1, only empty lines do), and those of up
    to ``threshold`` characters go only for the same line. A line goes if the same line stands earlier
    (in a document with a smaller id, or above it in its own), or if an earlier
    line is within ``threshold`` edits: earlier by the smallest id of a document
    that has it, then by hash. ``n_links`` counts, over the document's different
    lines, the other lines within reach; ``n_near`` the lines that go only for such a link.

    Counts combine before they are shuffled, and the lines that repeat are joined
    with a salt, so a line of a third of all documents is split.

    A null text stays null and has no lines; a null id sorts before all others;
    repeated rows are treated alike and come back as often; extra columns stay;
    an empty table gives no rows.
    """
    lines = stored(line_rows(docs, least_chars))
    seen = stored(lines.groupBy("h", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    found = links(lines, seen, threshold)
    touched = found.select("h", "h2").unionByName(found.select(F.col("g").alias("h"), F.col("g2").alias("h2"))).distinct()
    times = stored(seen.join(touched.withColumn("linked", F.lit(True)), ["h", "h2"], "left").filter("n > 1 OR linked"))
    mine = times.filter("linked").select("h", "h2", F.col("first").alias("hf"))
    yours = times.filter("linked").select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("first").alias("gf"))
    dated = found.join(mine, ["h", "h2"]).join(yours, ["g", "g2"])
    later = F.struct("hf", "h", "h2") > F.struct("gf", "g", "g2")
    degree = (
        dated.select("h", "h2", later.alias("near"))
        .unionByName(dated.select(F.col("g").alias("h"), F.col("g2").alias("h2"), (~later).alias("near")))
        .groupBy("h", "h2")
        .agg(F.max("near").alias("near"), F.count("*").alias("links"))
    )
    known = times.join(degree, ["h", "h2"], "left").select(
        "h", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    )
    # one row per document and line: where it stands first there, and all its places
    own = _in_slots(lines.select("k", "k2", "id", "at", "h", "h2"), times).groupBy("k", "k2", "h", "h2").agg(F.min("at").alias("top"), F.min("id").alias("id"), F.collect_set("at").alias("places"))
    own = own.withColumn("salt", F.pmod("k", F.lit(_SALTS)).cast("int"))
    judged = own.join(known.hint("merge"), ["h", "h2", "salt"]).select(
        "k",
        "k2",
        "links",
        F.when(F.col("near") | (F.col("id") > F.col("first")), F.col("places")).otherwise(F.array_remove("places", F.col("top"))).alias("gone"),
        F.when(F.col("near") & (F.col("id") == F.col("first")), 1).otherwise(0).alias("near"),
    )
    per_row = judged.groupBy("k", "k2").agg(F.flatten(F.collect_list("gone")).alias("__gone"), F.sum("links").alias("n_links"), F.sum("near").alias("n_near"))
    rows = _documents(docs).join(per_row.withColumnsRenamed({"k": "__k", "k2": "__k2"}), ["__k", "__k2"], "left")
    split = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "__gone")
    shortened = _bind(split, lambda parts: F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    text = F.when(F.size("__gone") > 0, shortened).otherwise(F.col("text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        zero(F.when(F.size("__gone") > 0, F.size("__gone"))).alias("n_removed"),
        zero(F.col("n_near")).alias("n_near"),
        zero(F.col("n_links")).alias("n_links"),
    )


def digest(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id``, the counts, and the hash of the text that is left (null: empty)."""
    rows = deduplicated(docs.select("doc_id", "text"), threshold, least_chars)
    left = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "n_lines", "n_removed", "n_near", "n_links", left.alias("kept_sha256"))
