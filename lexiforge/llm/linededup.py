"""Line dedup by a segment-partition edit join, with built-in functions only.

Distinct lines are split into one segment more than the edits allowed; two
lines within that distance share a segment at nearly the same place.  Segments
are indexed under the line's class of lengths and their number, other lines
probe the index with substrings of the places that can match, and what meets is
verified with a banded bit-parallel edit distance.  A line is dropped when it
repeats an earlier line or lies within the distance of one.

The limit grows with the line.  Lines of fewer than ``WORDS_FROM`` words are
strings of characters and may differ by ``edits`` of them.  Longer ones are
strings of words and may differ by ``WORD_EDITS`` whole words.  The shorter line
of a pair says which holds.

A line only has to find one earlier neighbour, so pairs are met in rounds:
first each line and the earliest one of each of its keys, then, for lines not
settled, all members of small keys, and in large keys only lines that share one
of the parts that are rarest under that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_within, cut, meet

#: Letters whose parity of occurrence each line carries; one edit changes at most two of these.
PARITY = "etaoinshrdlucmpgbv"
#: From so many words on a line is compared word by word.
WORDS_FROM = 20
#: So many words may differ.
WORD_EDITS = 2
#: Lengths in one class, in words or characters.
CLASS = 8
#: Characters of a part of a line that is compared by characters.
GRAM = 3
#: A group of up to so many lines meets pair by pair, a larger one in blocks of about ``BLOCK``.
SMALL, BLOCK = 32, 256

ID = ["h1", "h2"]


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row.

    A filter on a plain column is pushed down and takes the column's expression
    along, into every place that names it; a generated column stays as it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def probes(edits: int) -> list[tuple[int, bool, int]]:
    """(segment, from the right, shift): where a line of the same class of lengths can hold a segment.

    Of ``edits`` + 1 segments one, number i, is untouched and has at most i - 1
    edits before it and the rest behind it.  It is looked for from the end of the
    line on whose side fewer edits can have moved it.
    """
    out = []
    for i in range(1, edits + 2):
        before, behind = i - 1, edits + 1 - i
        out += [(i, behind < before, s) for s in range(-min(before, behind), min(before, behind) + 1)]
    return out


def _places(by_words: bool, length: Column, edits: int, least: int, when: Column) -> Column:
    """The (by_words, parts, class, i, right, shift) under which a line is indexed and probes.

    A line at the lower border of its class, where a shorter line within the
    distance may lie in the class below, has the places of that class as well.
    """
    listed = lambda below: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("by_words", "parts", "below", "i", "right", "shift"), (by_words, edits + 1, below, *p), strict=True)]) for p in probes(edits)])
    none, border = F.slice(listed(0), F.lit(1), F.lit(0)), (length % CLASS < edits) & (length - length % CLASS > least)
    return F.when(when & border, F.concat(listed(0), listed(1))).when(when, listed(0)).otherwise(none)


def segment_keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``lines`` (with a column ``line``) and the ``key`` of each segment that a line is indexed under or probes.

    The segments of a class are of one size, a part of its least length, so that
    they lie at the same places in all its lines, counted from the nearer end.
    A key is the hash of the class, the number of the segment and its text.
    ``code`` is the line in UTF-32, where a place is found without counting
    characters.  The places are exploded first, so that the key is plain generated code.
    """
    own = lines.columns
    rows = lines.withColumn("list", F.split("line", " ", -1)).withColumn("words", F.size("list"))
    # an edit may add a word, so the longer line of a pair by characters has up to ``edits`` more
    by_chars = F.col("words") < WORDS_FROM + edits
    rows = rows.withColumn("code", F.when(by_chars, F.encode("line", "UTF-32"))).withColumn("n", F.when(by_chars, F.length("line")).otherwise(0))
    places = F.concat(_places(False, F.col("n"), edits, min_chars, by_chars), _places(True, F.col("words"), WORD_EDITS, WORDS_FROM, F.col("words") >= WORDS_FROM))
    rows = rows.select(*own, "list", "words", "code", "n", F.explode(places).alias("p"))
    p = F.col("p")

    def segment(length: Column) -> tuple[Column, Column, Column]:
        """Number of the class, start (from 1) and length of the segment."""
        number = F.floor(length / CLASS).cast("int") - p["below"]
        size = F.floor(number * CLASS / p["parts"]).cast("int")
        left = (p["i"] - 1) * size + 1
        right = length - (p["parts"] - p["i"] + 1) * size + 1
        return number, (F.when(p["right"], right).otherwise(left) + p["shift"]).cast("int"), size

    number, start, size = segment(F.col("n"))
    chars = F.xxhash64(number, p["i"], F.substring(F.col("code"), start * 4 - 3, size * 4))
    number, start, size = segment(F.col("words"))
    words = F.xxhash64(number, -p["i"], F.slice("list", start, size))
    return rows.select(*own, F.when(p["by_words"], words).otherwise(chars).alias("key"))


def letter_parity(line: Column) -> Column:
    """Bits: whether each letter of ``PARITY`` occurs an odd number of times."""
    letters = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(1 << k).alias("bit")) for k, c in enumerate(PARITY)])
    odd = lambda x: (F.octet_length(line) - F.octet_length(F.replace(line, x["c"], F.lit("")))) % 2 == 1
    return F.aggregate(letters, F.lit(0), lambda acc, x: acc + F.when(odd(x), x["bit"]).otherwise(0))


def glyphs(line: Column, *seed: Column) -> Column:
    """A character for each word, by its hash: two lines differ by no more characters than words."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(*seed, w), F.lit(800_000)) + 0x10000), 8, "0")
    return F.array_join(F.transform(F.split(line, " ", -1), lambda w: F.decode(F.unhex(code(w)), "UTF-32")), "")


def _common(same, room: Column) -> Column:
    """Length of the longest common end, by halving steps; ``same(n)`` says whether ends of length n are equal."""
    steps = F.array(*[F.lit(1 << k) for k in range(17, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= room) & same(n + s), n + s).otherwise(n))


def within_distance(pairs: DataFrame, a: str, b: str, edits: int, by: str = "") -> DataFrame:
    """The rows of ``pairs`` whose strings in columns ``a`` and ``b`` differ by at most ``edits`` edits.

    Edits are of characters, or of the parts between ``by`` if it is given.
    Common ends are cut off.
    What is left is compared column by column in a band of 2 * edits + 1 cells
    held in one integer: vp and vn say where the vertical steps of the edit
    matrix are +1 and -1; the distance is followed down the lowest diagonal and
    then along the last row.
    """
    keep = pairs.columns
    p = held(held(pairs, "__s", F.split(a, by, -1 if by else 0)), "__t", F.split(b, by, -1 if by else 0))
    p = p.filter(F.abs(F.size("__s") - F.size("__t")) <= edits)
    s, t = F.col("__s"), F.col("__t")
    room = F.least(F.size(s), F.size(t))
    p = held(p, "__head", _common(lambda n: F.slice(s, F.lit(1), n) == F.slice(t, F.lit(1), n), room))
    p = held(p, "__tail", _common(lambda n: F.slice(s, F.size(s) - n + 1, n) == F.slice(t, F.size(t) - n + 1, n), room - F.col("__head")))
    mid = lambda x: F.concat(F.slice(x, F.col("__head") + 1, F.size(x) - F.col("__head") - F.col("__tail")), F.array_repeat(F.lit("\x01"), edits + 1))
    p = held(held(p, "__x", mid(s)), "__y", mid(t))
    m, n, width = F.size("__x"), F.size("__y"), 2 * edits + 1
    mask, low = (1 << width) - 1, 1 << (2 * edits)
    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(edits).alias("d"))

    def step(s: Column, j: Column) -> Column:
        char = F.get(F.col("__y"), j - 1)
        match = F.lit(0).cast("bigint")
        for k in range(width):
            match = match + F.when(F.coalesce(F.get(F.col("__x"), j + (k - edits - 1)) == char, F.lit(False)), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        vp, vn = s["vp"], s["vn"]
        first = F.struct(vp.alias("vp"), vn.alias("vn"), match.alias("m"))
        # names for the vectors, one at a time, so that each is computed once
        named = F.transform(F.array(first), lambda t: F.struct(t["vp"].alias("vp"), t["vn"].alias("vn"), ((t["m"].bitwiseAND(t["vp"]) + t["vp"]).bitwiseXOR(t["vp"]).bitwiseOR(t["m"]).bitwiseOR(t["vn"]).bitwiseAND(F.lit(mask))).alias("d0")))
        named = F.transform(named, lambda t: F.struct(t["d0"].alias("d0"), t["vn"].bitwiseOR(F.bitwise_not(t["d0"].bitwiseOR(t["vp"]))).bitwiseAND(F.lit(mask)).alias("hp"), t["d0"].bitwiseAND(t["vp"]).alias("hn")))

        def finish(t: Column) -> Column:
            down = F.shiftright(t["d0"], 1)
            diagonal = s["d"] + F.when(t["d0"].bitwiseAND(F.lit(low)) == 0, 1).otherwise(0)
            # on the last row the cell moves up the band by one each column
            at = (m - j + edits).cast("int")
            row = s["d"] + F.pmod(F.call_function("shiftright", t["hp"], at), F.lit(2)).cast("int") - F.pmod(F.call_function("shiftright", t["hn"], at), F.lit(2)).cast("int")
            return F.struct(
                t["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(t["hp"]))).bitwiseAND(F.lit(mask)).alias("vp"),
                down.bitwiseAND(t["hp"]).alias("vn"),
                F.when(j <= m - edits, diagonal).otherwise(row).cast("int").alias("d"),
            )

        moved = F.element_at(F.transform(named, finish), 1)
        return F.when(s["d"] > 3 * edits, s).otherwise(moved)  # too far to come back

    distance = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"])
    return held(p, "__d", distance).filter(F.col("__d") <= edits).select(*keep)


def with_company(places: DataFrame, edits: int, min_chars: int, broadcast_bytes: int) -> DataFrame:
    """h1, h2, first, line, keys: distinct lines that share a key with another line, and their shared keys.

    First the keys that two different lines share are found by an aggregation
    over all keys, in which repeats of one line fold; lines are only looked at
    further if they hold such a key.
    """
    keyed = cut(segment_keys(places.select("h1", "line"), edits, min_chars).select("h1", "key"))
    met = keyed.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"))
    shared = cut(met.filter("least < most").select("key"))
    seats = keyed.join(F.broadcast(shared), "key", "left_semi") if bytes_within(shared, broadcast_bytes) else keyed.distinct().join(shared, "key", "left_semi")
    seats = cut(seats.groupBy("h1").agg(F.collect_set("key").alias("keys")))
    ids = seats.select("h1")
    held_ones = places.join(F.broadcast(ids), "h1", "left_semi") if bytes_within(ids, broadcast_bytes) else places  # else they fold before they are joined
    lines = held_ones.groupBy(*ID).agg(F.min(F.struct("at", "line")).alias("f")).join(seats, "h1")
    return cut(lines.select(*ID, F.col("f.at").alias("first"), F.col("f.line").alias("line"), "keys", F.size(F.split("f.line", " ", -1)).alias("words"), letter_parity(F.col("f.line")).alias("parity"), F.when(F.size(F.split("f.line", " ", -1)) >= WORDS_FROM, glyphs(F.col("f.line"))).alias("glyphs")))


def near_ones(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """h1, h2 of the later lines b of pairs (a1, a2, b1, b2) that are near the earlier line a."""
    side = lambda x: lines.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), *[F.col(c).alias(f"{c}_{x}") for c in ("line", "words", "parity", "glyphs")])
    pairs = cut(pairs.distinct())
    both = meet(pairs, side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    fewer = F.least("words_a", "words_b")
    chars = both.filter((fewer < WORDS_FROM) & (F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 2 * edits) & (F.abs(F.length("line_a") - F.length("line_b")) <= edits))
    words = both.filter((fewer >= WORDS_FROM) & (F.abs(F.col("words_a") - F.col("words_b")) <= WORD_EDITS) & (F.call_function("levenshtein", F.col("glyphs_a"), F.col("glyphs_b"), F.lit(WORD_EDITS)) >= 0))
    near = within_distance(chars, "line_a", "line_b", edits).unionByName(within_distance(words, "line_a", "line_b", WORD_EDITS, " "))
    return near.select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct()


def all_pairs(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Pairs of an earlier and a later line of one group, groups being of up to ``SMALL`` lines."""
    a = earlier.select(key, F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("first_a"))
    b = later.select(key, F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("first_b"))
    return a.join(b, key).filter("first_a < first_b").select("a1", "a2", "b1", "b2")


def block_pairs(earlier: DataFrame, later: DataFrame, edits: int) -> DataFrame:
    """For groups ``t``: pairs that the built-in bounded distance doesn't rule out.

    A group is dealt in blocks of about ``BLOCK`` lines, and blocks meet.  From
    each a later line takes the first earlier line that can be near; by words
    what is compared are glyphs by two hashes, the second one only where the first
    lets a pair pass, so that words of one hash don't hide a line that is near.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    member = F.struct(*ID, "first", "words", "line", "glyphs").alias("member")
    dealt = lambda df: df.withColumn("block", F.pmod(F.xxhash64(*ID), n).cast("int")).select("t", n.alias("n"), "block", member)
    a = dealt(earlier).groupBy("t", "block").agg(F.collect_list("member").alias("others"))
    b = dealt(later).groupBy("t", "n", F.col("block").alias("own")).agg(F.collect_list("member").alias("open")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def close(x: Column, y: Column) -> Column:
        fewer = F.least(x["words"], y["words"])
        by_chars = F.call_function("levenshtein", x["line"], y["line"], F.lit(edits)) >= 0
        near = lambda a, b: F.call_function("levenshtein", a, b, F.lit(WORD_EDITS)) >= 0
        by_words = near(x["glyphs"], y["glyphs"]) & near(glyphs(x["line"], F.lit(2)), glyphs(y["line"], F.lit(2)))
        return (x["first"] < y["first"]) & F.when(fewer < WORDS_FROM, by_chars).otherwise(by_words)

    found = F.transform("open", lambda y: F.struct(F.get(F.filter("others", lambda x: close(x, y)), F.lit(0)).alias("x"), y.alias("y")))
    return b.join(a, ["t", "block"]).select(F.explode(found).alias("p")).filter("p.x is not null").select(*[F.col(f"p.{s}.h{k}").alias(f"{z}{k}") for s, z in ("xa", "yb") for k in (1, 2)])


def rare_parts(seats: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """h1, h2, t for the ``seats`` (h1, h2, e1, e2) of lines in groups, each with its earliest line e: the parts of a line that are rarest there.

    The parts of a line compared by words are its words, of one compared by
    characters its runs of ``GRAM`` characters; lines at the border have both.
    Parts that the earliest line of the group lacks come first, by how many lines of
    the group have them, then the others in the order of the alphabet.  So lines that
    are copies of one with some words changed meet where they share a change, not by
    what all of them have.

    If at most k parts of either line are missing in the other, their first k + 1
    parts in any order common to both have one in common; a line of up to k parts
    has a mark that stands for no part at all.  An edit of a character takes away up
    to ``GRAM`` parts.
    """
    places = F.sequence(F.lit(1), F.greatest(F.length("line") - GRAM + 1, F.lit(1)))
    words, grams = F.array_distinct(F.split("line", " ", -1)), F.array_distinct(F.transform(places, lambda i: F.substring(F.col("line"), i, F.lit(GRAM))))
    kind = lambda by, lost, parts: F.struct(F.lit(by).alias("by"), F.lit(lost).alias("lost"), parts.alias("parts"))
    by_words, by_chars = F.col("words") >= WORDS_FROM, F.col("words") < WORDS_FROM + edits
    kinds = F.array_compact(F.array(F.when(by_words, kind("words", WORD_EDITS, words)), F.when(by_chars, kind("characters", GRAM * edits, grams))))
    parted = cut(lines.join(seats.select(*ID).distinct(), ID, "left_semi").select(*ID, F.explode(kinds).alias("k")).select(*ID, "k.*"))
    # lines that share a key have parts of its kind, and so has the earliest one
    group = ["e1", "e2", "by"]
    heads = seats.select("e1", "e2").distinct().join(parted.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), "by", F.col("parts").alias("known")), ["e1", "e2"])
    rows = meet(cut(seats.join(parted, ID)), cut(heads), group).withColumn("new", F.array_except("parts", "known"))
    others = F.slice(F.array_sort(F.array_intersect("parts", "known")), F.lit(1), F.greatest(F.col("lost") + 1 - F.size("new"), F.lit(0)))
    listed = lambda parts, known: F.transform(parts, lambda x: F.struct(F.lit(known).alias("known"), x.alias("part")))
    tokens = cut(rows.select(*ID, *group, "lost", F.explode(F.concat(listed(F.col("new"), False), listed(others, True))).alias("x")).select(*ID, *group, "lost", "x.*"))
    often = tokens.filter("not known").groupBy(*group, "part").agg(F.count("*").alias("often"))
    counted = tokens.join(often, [*group, "part"], "left").withColumn("often", F.when(F.col("known"), 0).otherwise(F.col("often")))
    first = counted.groupBy(*ID, *group).agg(F.max("lost").alias("lost"), F.array_sort(F.collect_list(F.struct("known", "often", "part"))).alias("ranked"))
    chosen = F.transform(F.slice("ranked", F.lit(1), F.col("lost") + 1), lambda x: F.xxhash64(*group, x["part"]))
    none = F.array(F.xxhash64(*group))
    return first.select(*ID, F.explode(F.when(F.size("ranked") <= F.col("lost"), F.concat(chosen, none)).otherwise(chosen)).alias("t"))


def near_earlier(places: DataFrame, edits: int, min_chars: int, broadcast_bytes: int) -> DataFrame:
    """h1, h2 of lines near an earlier one, from places (h1, h2, line, at); ``at`` sets the order."""
    lines = with_company(places, edits, min_chars, broadcast_bytes)
    seats = cut(lines.select(*ID, "first", F.explode("keys").alias("key")))
    groups = seats.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("first", *ID)).alias("e"))
    seats = cut(meet(seats, cut(groups), ["key"], "size"))
    settled = cut(near_ones(seats.filter(F.col("e.first") < F.col("first")).select(F.col("e.h1").alias("a1"), F.col("e.h2").alias("a2"), F.col("h1").alias("b1"), F.col("h2").alias("b2")), lines, edits))

    # the earliest line of a key has no earlier one there; with two lines all is said
    left = cut(seats.filter("size > 2 and e.first < first").join(settled, ID, "left_anti"))
    small = all_pairs(seats.filter(F.col("size").between(3, SMALL)), left.filter(F.col("size") <= SMALL), "key")
    # large keys in which a line is open; those of one earliest line are one group, in which a line stands once
    open_ = left.filter(F.col("size") > SMALL)
    large = meet(cut(seats.filter(F.col("size") > SMALL).select(*ID, "key", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))), cut(open_.groupBy("key").agg(F.max("size").alias("size"))), ["key"], "size")
    large, open_ = cut(large.select(*ID, "e1", "e2").distinct()), cut(open_.select(*ID).distinct())
    ranked = cut(rare_parts(large, lines, edits).join(lines.select(*ID, "first"), ID))
    ranked = cut(meet(ranked, cut(ranked.groupBy("t").agg(F.count("*").alias("size"))), ["t"], "size"))
    # groups of any size: pairs that the bounded distance rules out don't leave their group
    crowd = cut(ranked.filter("size > 1").join(lines.select(*ID, "words", "line", "glyphs"), ID))
    many = block_pairs(crowd, crowd.join(open_, ID, "left_semi"), edits)
    return settled.unionByName(near_ones(small.unionByName(many), lines, edits)).distinct()


def dropped_lines(rows: DataFrame, edits: int = 2, min_chars: int = 24, min_exact: int | None = None, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """id, text_hash, exact and near from rows (id, text): places (from 0) of a document's dropped lines.

    Only documents with a dropped line have a row.  Lines of ``min_exact`` to
    ``min_chars`` characters are matched exactly only.
    """
    least = min_chars if min_exact is None else min_exact
    places = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw")).withColumn("raw", F.trim("raw")).filter(F.length("raw") >= least)
    places = places.select(F.struct("id", "text_hash", "place").alias("at"), F.lower("raw").alias("line"))
    places = cut(places.select("at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")))
    near = cut(near_earlier(places.filter(F.length("line") >= min_chars), edits, min_chars, broadcast_bytes).withColumn("near", F.lit(True)))
    # the earliest place of each line that has several or is near another
    ids = places.select(*ID, "at")
    first = ids.groupBy(*ID).agg(F.min("at").alias("first"), F.count("*").alias("n")).join(near, ID, "left").filter("n > 1 or near")
    gone = meet(ids, cut(first), ID, "n").withColumn("is_first", F.col("at").eqNullSafe(F.col("first"))).filter("near or not is_first")
    return gone.groupBy(F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash")).agg(
        F.collect_set(F.when(~F.col("is_first"), F.col("at.place"))).alias("exact"),
        F.collect_set(F.when(F.col("is_first"), F.col("at.place"))).alias("near"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 24, min_exact: int | None = None, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """doc (the input row), n_lines, kept (text without dropped lines), able, exact and near (counts) for each row of ``docs``.

    Lines are trimmed and lower-cased for comparison; those under ``min_chars``
    characters stay, unless ``min_exact`` is given: then exact repeats of at least
    that many characters go too.  Earlier means smaller (id, text hash, place);
    rows repeated with the same id and text count as one document, rows of one
    id with different texts as several.  Null texts stay null, empty ones empty;
    null ids come first.  Shared keys and lists of dropped lines of up to
    ``broadcast_bytes`` go to every task; larger ones are joined by shuffling.
    """
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"))
    drops = cut(dropped_lines(rows.select("id", "text"), edits, min_chars, min_exact, broadcast_bytes))
    drops = drops.select(F.col("id").alias("drop_id"), "text_hash", "exact", "near")
    found = rows["id"].eqNullSafe(F.col("drop_id")) & (F.xxhash64(rows["text"]) == F.col("text_hash"))
    joined = rows.join(F.broadcast(drops) if bytes_within(drops, broadcast_bytes) else drops, found, "left")
    least = min_chars if min_exact is None else min_exact
    gone, all_lines = F.array_union("exact", "near"), F.col("lines")
    none = F.col("text_hash").isNull()
    return joined.withColumn("lines", F.split("text", "\n", -1)).select(
        "doc",
        "id",
        "text",
        F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"),
        F.when(none, F.col("text")).otherwise(F.array_join(F.filter(all_lines, lambda line, k: ~F.array_contains(gone, k)), "\n")).alias("kept"),
        F.coalesce(F.size(F.filter(all_lines, lambda line: F.length(F.trim(line)) >= least)), F.lit(0)).alias("able"),
        F.when(none, 0).otherwise(F.size("exact")).alias("exact"),
        F.when(none, 0).otherwise(F.size("near")).alias("near"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_left and the digest of the text left, for each input row."""
    out = dedup_lines(docs.select(id_col, text_col), id_col, text_col, **options)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("exact").cast("long").alias("n_exact"),
        F.col("near").cast("long").alias("n_near"),
        (F.col("able") - F.col("exact") - F.col("near")).cast("long").alias("n_left"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text, all columns kept.

    A document that had lines long enough to compare and lost every one of them
    is dropped: it only repeats others.
    """
    out = dedup_lines(docs, id_col, text_col, **options).filter("able = 0 or able > exact + near")
    return out.select(*[(F.col("kept") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
