r"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if an equal line, or one within one edit (and at least 0.8 similar, so the longer has five signs or more), comes earlier in the corpus. The signs that
an edit inserts, deletes or replaces are the line's words (cut at single spaces), so a changed date, counter or name is one edit; lines of four words or fewer are
compared by their characters. Earlier means in a lower document id, for different lines of one document the lower hash; equal lines in one document: the first
stays. So the first line of every class stays, all others go; documents keep their row even where no line is left.

One pass over the text makes a light table: each line's place, its hash in 128 bits and the hashes of its segments. A line of n signs is cut into
threshold + 1 = 2 segments, at the middle of n, and also where a line one shorter would be cut; two lines within one edit share the first or the last segment
of the shorter one's cut, at the same place from that side. A segment's hash takes in side and length of the shorter line, so only lines of fitting
length meet. Texts are read again only for lines of candidate pairs, found in their documents by bitmaps of fixed size (2^20 words, broadcast whatever
the corpus's size; where they fill up more texts move, with equal results).

Two or three lines that share a segment are paired. More are split by further segments: what a line holds beside the shared segment is cut in the same way, and
only lines that share a segment of that as well meet, and so on until two signs are left. What differs in at most one sign then is within one edit of the
first of its group, without pairs. Each step halves what isn't shared, so there are as many as the logarithm of a line's signs, each linear in the group; no
group is joined with itself, so there are no more pairs than rows.

Pairs are verified by a banded bit-parallel edit distance: the band of 2 * threshold + 1 cells around the diagonal is one integer a column, and a fold over
the signs of one line takes all cells of a column in a few bit operations.

A line that holds more than a thousandth of all lines joins its places by broadcast (a thousand such lines at most); no other can weigh on a task.

Defined results: null text counts as empty and stays null; blank lines (white space only) always stay and have no links; null ids come last; rows with equal id and
text share their result, so rows repeated with one id keep equal lines; an empty table gives no rows; extra columns are returned as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.common import counted_join, cut, table, tidy

#: Lines that share a segment and are paired as they are, three at most (`_meet` tells no more apart); more are split by further segments.
GROUP = 3
EDITS = 1
#: Signs of the longer line of a pair: with fewer, one edit leaves less than 0.8 of it.
LEAST = 5
WORDS = 1 << 20
_LAST = (1 << 63) - 1
_MADE = ("n_lines", "n_exact", "n_near", "dup_of", "n_links", "class_id")


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(a: Column, b: Column, most: int = EDITS) -> Column:
    """The edit distance of two arrays where it is at most `most` (14 or less), else -1; null where either is null or has no more than `most` elements.

    Columns of the matrix are taken one after the other. Of each, only the cells within `most` of the diagonal count; the vertical differences of these
    are kept as two bit masks (vp: +1, vn: -1), and the score is followed down the lowest diagonal and then along the last row."""
    width = 2 * most + 1
    mask = F.lit((1 << width) - 1)
    whole = F.struct(a.alias("rows"), b.alias("text"), F.size(a).alias("m"), F.size(b).alias("n"))

    def run(w: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            sign = F.get(w["text"], j - 1)
            same = [F.when(F.get(w["rows"], j + (i - most - 1)) == sign, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(width)]
            return _bind(reduce(Column.bitwiseOR, same), lambda eq: _bind((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(mask), lambda d0: after(s, j, d0)))

        def after(s: Column, j: Column, d0: Column) -> Column:
            """d0: cells that are as small as their upper left neighbour."""
            hp, hn = s["vn"].bitwiseOR(mask.bitwiseXOR(d0.bitwiseOR(s["vp"]))), s["vp"].bitwiseAND(d0)
            down, last = F.shiftright(d0, 1), w["m"] - j + most  # last: the bit of the last row
            diagonal = 1 - F.shiftright(d0, 2 * most).bitwiseAND(F.lit(1))
            along = F.getbit(hp, last).cast("int") - F.getbit(hn, last).cast("int")
            return F.struct(hn.bitwiseOR(mask.bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["score"] + F.when(j <= w["m"] - most, diagonal).otherwise(along)).alias("score"))

        start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("score"))
        return F.aggregate(F.sequence(F.lit(1), w["n"]), start, step, lambda s: s["score"])

    m, n = F.size(a), F.size(b)
    near = F.when((m > most) & (n > most), F.abs(m - n) <= most)
    return F.when(near, _bind(_bind(whole, run), lambda score: F.when(score <= most, score).otherwise(F.lit(-1)))).when(~near, F.lit(-1))


def _signs(signs: Column) -> Column:
    """How many signs a string of signs with single spaces between them has (empty: one, empty)."""
    return F.octet_length(signs) - F.octet_length(F.replace(signs, F.lit(" "), F.lit(""))) + 1


def _characters(line: Column) -> Column:
    """A line's characters with spaces between them; a space of its own is another character."""
    return F.rtrim(F.regexp_replace(F.translate(line, " ", "\x01"), "(?s)(.)", "$1 "))


def _slots(signs: Column, n: Column, group: Column, least: int) -> list[tuple[Column, int, Column, Column]]:
    """(key, own, rest, signs of the rest) for both sides of the cuts of a line of n signs and of one shorter (of `least` signs or more); null keys where there is no such cut."""
    out = []
    for grid, own in ((n, 1), (n - 1, 0)):
        left = F.floor(grid / 2).cast("int")
        for side, size in ((1, left), (2, grid - left)):
            sign = 1 if side == 1 else -1
            segment, rest = (F.call_function("substring_index", signs, F.lit(" "), k) for k in (sign * size, -sign * (n - size)))
            out.append((F.when(grid >= least, F.xxhash64(F.lit(side), group, grid, segment)), own, rest, n - size))
    return out


#: The light table's segment columns: k words, c characters; the line's own cuts, then those of a line one shorter.
_KEYS = [(f"{kind}{side}", own) for kind in "kc" for side, own in (("a", 1), ("b", 1), ("x", 0), ("y", 0))]


def _line_slots(line: Column) -> list[tuple[Column, int, Column, Column]]:
    """The slots of a line by words, then by characters, in the order of _KEYS."""
    n, out = _signs(line), []
    for kind, signs, size, here in ((1, line, n, n >= LEAST - 1), (2, _characters(line), F.length(line), n < LEAST)):
        out += [(F.when(here, key), own, rest, left) for key, own, rest, left in _slots(signs, size, F.lit(kind).cast("long"), LEAST - 1)]
    return out


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r, text): r names a row by what it holds."""
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.select(F.coalesce("id", F.lit(_LAST)).alias("id"), F.xxhash64("id", "text").alias("r"), "text")


def lines_of(rows: DataFrame) -> DataFrame:
    """(id, r, no, line): the lines that aren't blank."""
    return rows.select("id", "r", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.length(F.trim("line", F.lit(" \t\r\f\x0b"))) > 0)


def light_lines(rows: DataFrame) -> DataFrame:
    """(id, r, no, k1, k2, segment hashes): all lines without their text. (k1, k2) names a line."""
    line = F.col("line")
    keys = [key.alias(name) for (name, _), (key, *_) in zip(_KEYS, _line_slots(line))]
    return lines_of(rows).select("id", "r", "no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"), *keys)


def distinct_lines(light: DataFrame) -> DataFrame:
    """One row a distinct line: its hashes, first place, number of occurrences and segment hashes."""
    return light.groupBy("k1", "k2").agg(F.min(F.struct("id", "r", "no")).alias("at"), F.count("*").alias("n"), *(F.min(name).alias(name) for name, _ in _KEYS)).select("*", F.col("at.id").alias("first"))


def _bitmap(df: DataFrame, *cols: str) -> DataFrame:
    h = F.xxhash64(*cols)
    word, bit = F.pmod(h, F.lit(WORDS)).cast("int"), F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(63)).cast("int")
    return df.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def _marked(df: DataFrame, bitmap: DataFrame, *cols: str) -> DataFrame:
    """The rows whose hash may be in the bitmap (WORDS rows at most, hence broadcast)."""
    h = F.xxhash64(*cols)
    found = df.withColumns({"word": F.pmod(h, F.lit(WORDS)).cast("int"), "bit": F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(63)).cast("int")}).join(F.broadcast(bitmap), "word")
    return found.where("(shiftrightunsigned(mask, bit) & 1) = 1").drop("word", "bit", "mask")


def _meet(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, own, k1): the pairs of lines that share a key, one of them by its own cut, from groups of GROUP lines at most; the keys of larger ones.

    Two and three lines are told by their least, greatest and the exclusive or of all, so no row is joined and a group makes no more pairs than it has lines."""
    groups = keyed.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("own"), F.min("k1").alias("x"), F.max("k1").alias("y"), F.bit_xor("k1").alias("z"))
    groups = cut(groups.where("c > 1 AND own = 1"), gathered=True)
    middle, most = "z ^ x ^ y", min(GROUP, 3)
    pairs = F.expr(f"CASE WHEN c = 2 THEN array(struct(x, y)) ELSE array(struct(x, y), struct(x, {middle} AS y), struct({middle} AS x, y)) END")
    return groups.where(f"c <= {most}").select(F.inline(pairs)), groups.where(f"c > {most}").select("key")


def _split_further(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (grp, k1, first, size, rest, n), lines that share a segment and what each holds beside it: pairs to verify, and (k1, near) decided without.

    The loop ends when no group is larger than GROUP or no line has more than two signs left; every step is written before the next one, and the driver sees one bit of it."""
    out = items.where("false").select(F.col("k1").alias("x"), F.col("k1").alias("y"), F.col("first").alias("near"))
    items = cut(items, gathered=True)
    while not items.isEmpty():
        tidy(items.sparkSession)
        # one sign or none left: all within one edit of each other; lines of LEAST - 1 signs only with longer ones
        end = items.where("n <= 1")
        place = F.struct("first", "k1")
        least = end.groupBy("grp").agg(F.min(place).alias("all"), F.min(F.when(F.col("size") >= LEAST, place)).alias("longer"))
        least_of = end.join(least, "grp").withColumn("least", F.when(F.col("size") >= LEAST, F.col("all")).otherwise(F.col("longer")))
        decided = least_of.where(F.col("least") < place).select(F.col("k1").alias("x"), F.lit(None).cast("long").alias("y"), F.col("least.first").alias("near"))
        # one left against two: the one is among the two
        words = items.where("n = 2").select("grp", F.explode(F.array_distinct(F.split("rest", " "))).alias("rest"), F.col("k1").alias("y"))
        found = end.where("n = 1").select("grp", "rest", F.col("k1").alias("x")).join(words, ["grp", "rest"]).select("x", "y")
        slots = [F.struct(key.alias("key"), F.lit(own).alias("own"), rest.alias("left_over"), left.alias("m")) for key, own, rest, left in _slots(F.col("rest"), F.col("n"), F.col("grp"), 2)]
        each = cut(items.where("n >= 2").select("k1", "first", "size", F.inline(F.array(*slots))).where("key IS NOT NULL"), gathered=True)
        more, hot = _meet(each.select("key", "own", "k1"))
        pairs = found.unionByName(more).distinct().withColumn("near", F.lit(None).cast("long"))
        out = out.unionByName(cut(decided.unionByName(pairs), gathered=True))
        items = cut(each.join(hot, "key").select(F.col("key").alias("grp"), "k1", "first", "size", F.col("left_over").alias("rest"), F.col("m").alias("n")), gathered=True)
    return out.where("y IS NOT NULL").select("x", "y"), out.where("y IS NULL").select(F.col("x").alias("k1"), "near")


def _texts(rows: DataFrame, distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, first, line) of the wanted lines (k1), from their first places."""
    places = cut(_marked(distinct.select("k1", "at", "first"), _bitmap(wanted, "k1"), "k1").join(wanted.distinct(), "k1").select("k1", "first", "at.id", "at.r", "at.no"), gathered=True)
    lines = lines_of(_marked(rows, _bitmap(places, "r"), "r"))
    found = _marked(lines, _bitmap(places, "r", "no"), "r", "no").join(places, ["id", "r", "no"]).select("k1", "first", "line")
    return cut(found.dropDuplicates(["k1"]), gathered=True)


def near_lines(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(k1, near): lines within one edit of an earlier one, and the least first document of those."""
    keyed = distinct.select("k1", F.inline(F.array(*(F.struct(F.col(name).alias("key"), F.lit(own).alias("own")) for name, own in _KEYS)))).where("key IS NOT NULL")
    found, hot = _meet(keyed)
    pairs = cut(found.distinct(), gathered=True)
    tidy(pairs.sparkSession)
    wanted, decided, crowded = pairs.select(F.explode(F.array("x", "y")).alias("k1")), None, None
    if not hot.isEmpty():
        crowded = cut(_marked(keyed, _bitmap(hot, "key"), "key").join(hot, "key").select("k1", "key"), gathered=True)
        wanted = wanted.unionByName(crowded.select("k1"))
    texts = _texts(rows, distinct, wanted)
    if crowded is not None:
        kinds = [_signs(F.col("line"))] * (len(_KEYS) // 2) + [F.length("line")] * (len(_KEYS) // 2)
        slots = [F.struct(key.alias("key"), size.alias("size"), rest.alias("rest"), left.alias("n")) for (key, _, rest, left), size in zip(_line_slots(F.col("line")), kinds)]
        items = texts.join(crowded.select("k1").distinct(), "k1").select("k1", "first", F.inline(F.array(*slots))).join(crowded, ["key", "k1"]).withColumnRenamed("key", "grp")
        further, decided = _split_further(items)
        pairs = cut(pairs.unionByName(further).distinct(), gathered=True)
    a, b = (texts.select(F.col("k1").alias(k), F.col("line").alias(f"{k}_line"), F.col("first").alias(f"{k}_first")) for k in ("x", "y"))
    words = [_signs(F.col(f"{k}_line")) for k in "xy"]
    both = pairs.join(a, "x").join(b, "y")
    for by_word, here, signs in ((True, F.greatest(*words) >= LEAST, lambda c: c), (False, F.greatest(*words) < LEAST, _characters)):
        x, y = (F.when(here, F.split(signs(F.col(f"{k}_line")), " ")) for k in "xy")
        close = (banded_distance(x, y) >= 0) & (F.greatest(F.size(x), F.size(y)) >= LEAST)
        both = both.withColumn("by_word" if by_word else "by_sign", close)
    x_first = F.struct("x_first", "x") < F.struct("y_first", "y")
    later = both.where("by_word OR by_sign").select(F.when(x_first, F.col("y")).otherwise(F.col("x")).alias("k1"), F.when(x_first, F.col("x_first")).otherwise(F.col("y_first")).alias("near"))
    return (later if decided is None else later.unionByName(decided)).groupBy("k1").agg(F.min("near").alias("near"))


def drops(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, r, gone, n_exact, n_near, dup_of) of every row that loses lines: their places, how many have an equal or a near earlier line (both count), and the documents that keep them."""
    rows = _rows(df, id_col, text_col)
    light = cut(light_lines(rows))
    distinct = cut(distinct_lines(light), gathered=True)
    near = near_lines(rows, distinct)
    tidy(df.sparkSession)
    judged = cut(distinct.select("k1", "k2", "first", "n").join(near, "k1", "left").where("n > 1 OR near IS NOT NULL"), gathered=True)
    found = counted_join(light.select("id", "r", "no", "k1", "k2"), judged, ["k1", "k2"], "n", distinct.agg(F.sum("n")).first()[0] or 0)
    found = found.repartition("id", "r").dropDuplicates(["id", "r", "no"])
    again = F.row_number().over(Window.partitionBy("id", "r", "k1", "k2").orderBy("no")) > 1
    each = found.withColumn("equal", again | (F.col("id") > F.col("first"))).where("equal OR near IS NOT NULL")
    keepers = F.array_compact(F.flatten(F.collect_set(F.array(F.when(F.col("equal"), F.col("first")), F.col("near")))))
    return each.groupBy("id", "r").agg(F.collect_list("no").alias("gone"), F.count_if("equal").alias("n_exact"), F.count("near").alias("n_near"), F.array_sort(F.array_distinct(keepers)).alias("dup_of"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the text of the lines that stay, and columns n_lines, n_exact, n_near, dup_of (the documents that keep its lost lines), n_links (how many those are)
    and class_id (the least of those and the document itself)."""
    gone = drops(df, id_col, text_col).withColumnsRenamed({c: f"_{c}" for c in ("id", "r", "gone", "n_exact", "n_near", "dup_of")})
    own = df.withColumns({"_own": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "_row": F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))})
    both = own.join(gone, (F.col("_own") == F.col("_id")) & (F.col("_row") == F.col("_r")), "left")
    text = F.col(text_col)
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), text).otherwise(_bind(F.split(text, "\n"), lambda lines: F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")))
    others = [F.col(f"`{c}`") for c in df.columns if c not in (text_col, *_MADE)]
    none = F.array().cast("array<bigint>")
    return both.select(
        *others,
        kept.alias(text_col),
        F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.coalesce("_n_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("_n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("_dup_of", none).alias("dup_of"),
        F.size(F.coalesce("_dup_of", none)).cast("long").alias("n_links"),
        F.least(F.col(id_col).cast("long"), F.get("_dup_of", F.lit(0))).alias("class_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
