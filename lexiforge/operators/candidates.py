"""Candidate joins: phonetic neighbours, registered variants, window scans."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions import phonetic as P
from lexiforge.functions.phrases import MOST_BYTES, Finder, held_table
from lexiforge.functions.readings import HAN_RUN, Reader
from lexiforge.functions.text import flatten
from lexiforge.written import bytes_within, cut, small


def merge_targets(layers: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """ord, correct, flat, is_cag from rows (ord, correct, is_cag): first spelling, upgraded if any is in the fuzzy layer."""
    rows = layers.withColumn("flat", flatten(F.col("correct"), glyphs))
    return rows.groupBy("flat").agg(F.min("ord").alias("ord"), F.min_by("correct", "ord").alias("correct"), F.bool_or("is_cag").alias("is_cag")).select("ord", "correct", "flat", "is_cag")


def grade_variants(variants: DataFrame, targets: DataFrame, common: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """variant, correct, ambiguous from rows (ord, variant, correct).

    A variant that is a common word, or a target already known at its place in
    the order, only hints; others are certain.  Within each grade the first row
    of a variant counts.
    """
    rows = variants.filter((flatten(F.col("variant"), glyphs) != flatten(F.col("correct"), glyphs)) & (F.length("variant") >= 2))
    t, c = targets.select(F.col("flat").alias("t_flat"), F.col("ord").alias("t_ord")), common.select(F.col("word").alias("c_word")).distinct()
    rows = rows.join(c, F.col("variant") == F.col("c_word"), "left").join(t, flatten(F.col("variant"), glyphs) == F.col("t_flat"), "left")
    rows = rows.withColumn("ambiguous", F.col("c_word").isNotNull() | F.coalesce(F.col("t_ord") <= F.col("ord"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("variant", "ambiguous").orderBy("ord"))
    return rows.withColumn("n", first).filter("n = 1").select("variant", "correct", "ambiguous", "ord")


def _edits(n: Column, t: Column, limit: float) -> Column:
    """Edits that the limit allows between words of n and t letters."""
    return F.floor(F.lit(limit) * F.greatest(n, t)).cast("int")


def _lengths(n: Column, limit: float) -> Column:
    """Lengths that a word near one of length n can have."""
    return F.sequence(F.ceil(n * (1 - limit)).cast("int"), F.floor(n / (1 - limit)).cast("int"))


def segment_pairs(surfaces: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """surface, correct of ``surfaces`` (surface, s_len, sounds) and ``targets`` (correct, t_len, sounds) that may lie within the limit.

    ``sounds`` has one character for each sound (see ``one_sign``), and confusable
    ones have the same, so the plain edit distance is a lower bound.  Within k
    edits one of k + 1 segments of the target stands in the surface, moved by what
    the edits on either side allow; such segments are the keys that words meet by.
    """

    def keyed(df: DataFrame, word: str) -> DataFrame:
        own = word == "correct"
        mine, other = ("t_len", "n") if own else ("s_len", "t")
        df = df.withColumn(other, F.explode(_lengths(F.col(mine), limit)))
        n, t = (F.col("n"), F.col("t_len")) if own else (F.col("s_len"), F.col("t"))
        df = df.withColumn("parts", _edits(n, t, limit) + 1).filter(F.abs(n - t) < F.col("parts")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        i, parts, size = F.col("i"), F.col("parts"), F.floor(t / F.col("parts")).cast("int")
        short = parts - t % parts
        start, size = 1 + size * (i - 1) + F.greatest(F.lit(0), i - 1 - short), size + (i > short).cast("int")
        if not own:
            low, high = F.greatest(1 - i, n - t - (parts - i)), F.least(i - 1, n - t + (parts - i))
            df = df.filter(low <= high).withColumn("shift", F.explode(F.sequence(low, high)))
            start = start + F.col("shift")
            df = df.filter((start >= 1) & (start + size - 1 <= n))
        text = F.substring(F.col("sounds"), start.cast("int"), size.cast("int"))
        return df.select(F.xxhash64(t, n, i, text).alias("key"), word).distinct()

    return keyed(surfaces, "surface").join(keyed(targets, "correct"), "key").select("surface", "correct").distinct()


def han_pairs(surfaces: DataFrame, targets: DataFrame, reader: Reader, limit: float) -> DataFrame:
    """surface, correct of words of ideographs that may lie within the limit: equally long, and one chosen place near enough.

    All places of such a pair are within the limit.  A target is keyed by the
    sounds near that of one place, the one whose near sounds are rarest among the
    surfaces; a surface by the sound of each of its places.
    """
    spark = surfaces.sparkSession
    near = cut(reader.neighbours(spark, limit))
    heard = lambda df, word: df.select(word, F.length(word).alias("n"), reader.sounds(F.col(word)).alias("sounds"))
    placed = lambda df, word: cut(heard(df, word).select(word, "n", F.posexplode("sounds").alias("i", "sound")))
    s, t = placed(surfaces, "surface"), placed(targets, "correct")
    often = s.groupBy(F.col("sound").alias("near")).agg(F.count("*").alias("rows"))
    # an unread character is near itself alone
    of = t.select("sound").distinct().join(small(near), "sound", "left").select("sound", F.coalesce("near", "sound").alias("near"))
    of = cut(of)
    rarity = of.join(often, "near", "left").groupBy("sound").agg(F.sum(F.coalesce("rows", F.lit(0))).alias("rows"))
    chosen = t.join(small(rarity), "sound").groupBy("correct", "n").agg(F.min_by(F.struct("i", "sound"), F.struct("rows", "i")).alias("at"))
    keys = chosen.select("correct", "n", "at.i", "at.sound").join(small(of), "sound").select("correct", "n", "i", F.col("near").alias("sound"))
    return s.join(keys, ["n", "i", "sound"]).select("surface", "correct").distinct()


def one_sign(tokens: Column) -> Column:
    """Tokens without tones as one character each, confusable ones as the same: one of 127 by hash, so some others are the same too."""
    root = P.confusion_roots()
    names = F.create_map(*[x for t, r in root.items() for x in (F.lit(t), F.lit(r))])
    sounds = F.filter(tokens, lambda t: ~t.isin(*P.TONES))
    return F.array_join(F.transform(sounds, lambda t: F.chr(F.pmod(F.xxhash64(F.coalesce(F.try_element_at(names, t), t)), F.lit(127)) + 1)), "")


def phonetic_join(surfaces: DataFrame, targets: DataFrame, costs: P.Costs = P.DEFAULT, glyphs: dict[str, str] | None = None, reader: Reader | None = None) -> DataFrame:
    """surface, correct, d, is_cag, rank: the nearest targets within the limit of their layer.

    Words of ideographs meet by the sound of one place, others by segments of
    their sounds.  The exact layer joins on the tokens themselves.
    """
    reader = reader or Reader(costs=costs)
    s = surfaces.select("surface").distinct().filter(F.length("surface") > 0)
    t = cut(targets.filter(F.col("is_cag") & (F.length("correct") > 0)))
    s = cut(s)
    plain = segment_pairs(*(_spelled(df.filter(P.spelled(F.col(w))), w, n) for df, w, n in ((s, "surface", "s_len"), (t, "correct", "t_len"))), costs.fuzzy)
    bound = F.levenshtein(P.canonical_letters(F.col("surface")), P.canonical_letters(F.col("correct"))) <= costs.fuzzy * F.greatest(F.length("surface"), F.length("correct"))
    plain = plain.filter(bound).withColumn("d", P.spelled_distance(costs)(F.col("surface"), F.col("correct")))
    fuzzy = plain
    s_han, t_han = s.filter(~P.spelled(F.col("surface"))), t.filter(~P.spelled(F.col("correct")))
    if not (s_han.isEmpty() and t_han.isEmpty()):
        pure = [df.filter(P.is_han(F.col(w))) for df, w in ((s, "surface"), (t, "correct"))]
        read = han_pairs(*pure, reader, costs.fuzzy).unionByName(mixed_pairs(s, t, reader, costs.fuzzy))
        fuzzy = fuzzy.unionByName(read.withColumn("d", reader.word_distance(F.col("surface"), F.col("correct"))))
    fuzzy = fuzzy.filter(F.col("d") <= costs.fuzzy).join(small(t), "correct")
    exact = s.withColumn("ipa", reader.ipa(F.col("surface"))).join(targets.filter("not is_cag").withColumn("ipa", reader.ipa(F.col("correct"))), "ipa").filter((F.col("ipa") != "") & (F.length("surface") == F.length("correct"))).withColumn("d", F.lit(0.0))
    cols = ["surface", "correct", "flat", "ord", "is_cag", "d"]
    hits = fuzzy.select(cols).unionByName(exact.select(cols)).filter(flatten(F.col("surface"), glyphs) != F.col("flat"))
    rank = F.row_number().over(Window.partitionBy("surface").orderBy("d", "ord"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= costs.candidates).select("surface", "correct", "d", "is_cag", "rank")


def _spelled(words: DataFrame, word: str, length: str) -> DataFrame:
    return words.select(word, F.length(word).alias(length), P.canonical_letters(F.col(word)).alias("sounds")).distinct()


def mixed_pairs(surfaces: DataFrame, targets: DataFrame, reader: Reader, limit: float) -> DataFrame:
    """surface, correct of words that may lie within the limit, at least one with ideographs, not both of ideographs only."""

    def sounded(df: DataFrame, word: str, length: str) -> DataFrame:
        read = cut(df.select(word, one_sign(reader.tokens(F.col(word))).alias("sounds")).distinct())
        return read.withColumn(length, F.length("sounds")).filter(F.col(length) > 0)

    s, t = sounded(surfaces, "surface", "s_len"), sounded(targets, "correct", "t_len")
    kinds = lambda df, w: (df.filter(P.is_han(F.col(w))), df.filter(~P.spelled(F.col(w)) & ~P.is_han(F.col(w))), df.filter(P.spelled(F.col(w))))
    (s_han, s_both, s_plain), (t_han, t_both, t_plain) = kinds(s, "surface"), kinds(t, "correct")
    ways = ((s_han, t_both.unionByName(t_plain)), (s_both, t), (s_plain, t_han.unionByName(t_both)))
    out = [segment_pairs(a, b, limit) for a, b in ways if not (a.isEmpty() or b.isEmpty())]
    none = surfaces.sparkSession.createDataFrame([], T.StructType([s.schema["surface"], t.schema["correct"]]))
    return reduce(DataFrame.unionByName, out, none)


def variant_scan(texts: DataFrame, variants: DataFrame, id_col: str = "id", text_col: str = "text", glyphs: dict[str, str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """id, start (from 0), surface, correct: every occurrence of a variant, overlapping ones too.

    One automaton over all variants finds them in folded texts, batch by batch;
    only hits become rows.  Variants of more than ``most`` bytes are looked for
    in several passes over the texts, each with a part of them.
    """
    v = cut(variants.filter("correct is not null and variant <> ''").select(flatten(F.col("variant"), glyphs).alias("window"), "correct"))
    parts = 1
    while not all(bytes_within(v.filter(_part(F.col("window"), parts) == i), most) for i in range(parts)):
        parts *= 2
    kind = texts.schema[id_col].dataType
    result = T.StructType([T.StructField("id", kind), T.StructField("start", T.IntegerType()), T.StructField("surface", T.StringType()), T.StructField("correct", T.StringType())])
    read = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), flatten(F.col(text_col), glyphs).alias("folded")).filter("text is not null")

    def scan(words: dict[str, list[str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Finder(words)
            for batch in batches:
                out: list[tuple] = []
                for row, (text, folded) in enumerate(zip(batch.column("text").to_pylist(), batch.column("folded").to_pylist(), strict=True)):
                    out += ((row, at, text[at : at + n], c) for at, n, correct in find.places(folded) for c in correct)
                    if len(out) >= ROWS_OUT:
                        yield _hits(batch, out)
                        out = []
                yield _hits(batch, out)

        return read.mapInArrow(run, result)

    found = None
    for i in range(parts):
        words: dict[str, list[str]] = {}
        for window, correct in held_table(v.filter(_part(F.col("window"), parts) == i)):
            words.setdefault(window, []).append(correct)
        if words:
            found = scan(words) if found is None else found.unionByName(scan(words))
    return found if found is not None else texts.sparkSession.createDataFrame([], result)


#: Hits that a task hands on at once.
ROWS_OUT = 10_000
#: Texts that are scanned at once.
TEXTS = 500


def _part(word: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts))


def _hits(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    """Rows (row of the batch, start, surface, correct) with the ids of their rows."""
    rows, starts, surfaces, correct = zip(*out, strict=True) if out else ((), (), (), ())
    ids = batch.column("id").take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(surfaces, pa.string()), pa.array(correct, pa.string())], names=["id", "start", "surface", "correct"])


def window_scan(texts: DataFrame, targets: DataFrame, id_col: str = "id", text_col: str = "text", costs: P.Costs = P.DEFAULT, glyphs: dict[str, str] | None = None, reader: Reader | None = None, most: int = MOST_BYTES) -> DataFrame:
    """id, start, surface, correct: windows of ideographs that sound like a target of the same length.

    A window of ideographs lies near a target of ideographs if each place does, so
    a target is looked for where a sound near its rarest one stands, and its other
    places are looked up in the table of near sounds.  Targets of more than
    ``most`` bytes are looked for in several passes.  Targets with other letters
    meet the distinct windows of their length by segments of their sounds.
    """
    reader = reader or Reader(costs=costs)
    spark, kind = texts.sparkSession, texts.schema[id_col].dataType
    result = T.StructType([T.StructField("id", kind), T.StructField("start", T.IntegerType()), T.StructField("surface", T.StringType()), T.StructField("correct", T.StringType())])
    held = texts.filter(F.col(text_col).rlike("[一-鿿㐀-䶿]{2}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), flatten(F.col(text_col), glyphs).alias("folded"))
    t = cut(targets.filter(F.col("is_cag") & (F.length("correct") >= 2)).select("correct", "flat").distinct())
    pure = t.filter(P.is_han(F.col("correct")))
    found = spark.createDataFrame([], result)
    parts = 1
    while not all(bytes_within(pure.filter(_part(F.col("correct"), parts) == i), most) for i in range(parts)):
        parts *= 2
    near: dict[str, set[str]] = {}
    for a, b in held_table(reader.neighbours(spark, costs.fuzzy)):
        near.setdefault(a, set()).add(b)
    for i in range(parts):
        part = held_table(pure.filter(_part(F.col("correct"), parts) == i))
        if part:
            found = found.unionByName(held.mapInArrow(_near_windows(part, near, reader), result))
    mixed = t.filter(~P.is_han(F.col("correct")) & (F.lit(costs.fuzzy >= costs.tone) | ~P.spelled(F.col("correct"))))
    lengths = [r["n"] for r in mixed.select(F.length("correct").alias("n")).distinct().collect()]
    if lengths:
        w = cut(held.mapInArrow(_all_windows(sorted(lengths)), result))
        pairs = mixed_pairs(w.select("surface").distinct(), mixed.select("correct"), reader, costs.fuzzy).filter(F.length("surface") == F.length("correct"))
        pairs = pairs.filter(reader.word_distance(F.col("surface"), F.col("correct")) <= costs.fuzzy).join(mixed, "correct")
        met = w.drop("correct").join(small(pairs), "surface").filter(flatten(F.col("surface"), glyphs) != F.col("flat"))
        found = found.unionByName(met.select("id", "start", "surface", "correct"))
    return found.distinct()


def _near_windows(targets: list[tuple[str, str]], near: dict[str, set[str]], reader: Reader):
    """Task code: windows near targets (correct, flat) of ideographs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sound = lru_cache(None)(reader.made().sound)
        spoken = [([sound(c) for c in correct], correct, flat) for correct, flat in targets]
        often = Counter(x for sounds, _, _ in spoken for x in set(sounds))
        anchors: dict[str, list[tuple[int, list[str], str, str]]] = {}
        for sounds, correct, flat in spoken:
            at = min(range(len(sounds)), key=lambda i: (often[sounds[i]] * len(near.get(sounds[i], ())), i))
            for x in near.get(sounds[at], {sounds[at]}):
                anchors.setdefault(x, []).append((at, sounds, correct, flat))
        kinds: dict[str, int] = {}  # sounds met so far, by number
        number = np.full(0x110000, -2, np.int32)  # of the sound of each character: -2 not met yet, -1 no ideograph
        for batch in batches:
            for at_row in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at_row, TEXTS)
                texts, folds = part.column("text").to_pylist(), part.column("folded").to_pylist()
                codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
                for code in np.unique(codes[number[codes] == -2]).tolist():
                    number[code] = kinds.setdefault(sound(chr(code)), len(kinds)) if HAN_RUN.match(chr(code)) else -1
                heard = number[codes]
                heard = heard.astype(np.int16) if len(kinds) < 32_000 else heard  # short numbers are sorted by radix
                order = np.argsort(heard, kind="stable")
                bounds = np.searchsorted(heard[order], np.arange(len(kinds) + 1))
                fits: dict[str, np.ndarray] = {}
                begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
                out: list[tuple] = []
                for x, n in kinds.items():
                    stand = order[bounds[n] : bounds[n + 1]]
                    for at, sounds, correct, flat in anchors.get(x, ()) if len(stand) else ():
                        first = stand - at
                        first = first[(first >= 0) & (first + len(sounds) <= len(heard))]
                        for k, s in enumerate(sounds):
                            if s not in fits:
                                fits[s] = np.zeros(len(kinds) + 1, bool)  # the last place is for -1
                                fits[s][[kinds[y] for y in {s, *near.get(s, ())} if y in kinds]] = True
                            first = first[fits[s][heard[first + k]]]
                        rows = np.searchsorted(begins, first, "right") - 1
                        for row, a in zip(rows.tolist(), (first - begins[rows]).tolist()):
                            if folds[row][a : a + len(sounds)] != flat:
                                out.append((row, a, texts[row][a : a + len(sounds)], correct))
                        if len(out) >= ROWS_OUT:
                            yield _hits(part, out)
                            out = []
                yield _hits(part, out)

    return run


def _all_windows(lengths: list[int]):
    """Task code: every window of ideographs of the given lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for run_ in HAN_RUN.finditer(text):
                    for n in lengths:
                        out += ((row, a, text[a : a + n], "") for a in range(run_.start(), run_.end() - n + 1))
                        if len(out) >= ROWS_OUT:
                            yield _hits(batch, out)
                            out = []
            yield _hits(batch, out)

    return run


def acoustic_evidence(surfaces: DataFrame, graded: DataFrame, neighbours: DataFrame, costs: P.Costs = P.DEFAULT, glyphs: dict[str, str] | None = None) -> DataFrame:
    """surface, rank, candidate, score, note: a certain variant first, then neighbours by distance."""
    sure = surfaces.join(graded.filter("not ambiguous"), F.col("surface") == F.col("variant")).select("surface", F.lit(0).alias("place"), F.col("correct").alias("candidate"), F.lit(1.0).alias("score"), F.lit("variant").alias("note"))
    hint = graded.filter("ambiguous").select(F.col("variant").alias("h_variant"), flatten(F.col("correct"), glyphs).alias("h_flat"))
    score = P.acoustic_score(F.col("d"), F.when(F.col("is_cag"), costs.fuzzy).otherwise(costs.exact))
    near = neighbours.join(hint, (F.col("surface") == F.col("h_variant")) & (flatten(F.col("correct"), glyphs) == F.col("h_flat")), "left").select(
        "surface", F.col("rank").alias("place"), F.col("correct").alias("candidate"), score.alias("score"), F.when(F.col("h_variant").isNotNull(), "ambiguous").otherwise("ipa").alias("note")
    )
    both = sure.unionByName(near).withColumn("flat", flatten(F.col("candidate"), glyphs))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("surface", "flat").orderBy("place"))).filter("n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("surface").orderBy("place"))).select("surface", "rank", "candidate", "score", "note")


def fuse_detectors(hits: DataFrame) -> DataFrame:
    """Rows (seg_id, detector, ord, surface, correct, start, via): the first hit of each surface in a segment, numbered."""
    first = Window.partitionBy("seg_id", "surface").orderBy("detector", "ord")
    kept = hits.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    j = F.row_number().over(Window.partitionBy("seg_id").orderBy("detector", "ord")) - 1
    return kept.withColumn("j", j).withColumn("span_id", F.concat("seg_id", F.lit("_d"), F.col("j").cast("string")))


def without_targets(entities: DataFrame, targets: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """Entities whose surface isn't a target itself."""
    return entities.join(targets.select(F.col("flat").alias("__flat")), flatten(F.col("surface"), glyphs) == F.col("__flat"), "left_anti")
