import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.functions import phonetic as P
from lexiforge.functions.readings import Reader
from lexiforge.functions import text as T
from lexiforge.functions.vectors import cosine
from lexiforge.operators import chunks as C


def edit(a, b):
    """Weighted edit distance without tones, by the book."""
    pairs = set(P.confusion_pairs())
    cost = lambda x, y: 0 if x == y else 0.34 if f"{x} {y}" in pairs else 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + cost(x, y)))
        row = new
    return min(1.0, row[-1] / max(len(a), len(b), 1)) if a and b else float(bool(a) != bool(b))


def test_distance_matches_the_definition(spark):
    words = ["", "n", "small", "smal", "lut", "nut", "ring", "ling", "banana", "lalala", "naln"]
    pairs = list(itertools.product(words, repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.distance(P.letters(F.col("a")), P.letters(F.col("b"))).alias("d"))
    for r in df.collect():
        assert abs(r.d - edit(r.a, r.b)) < 1e-9, r


def test_lower_bound_never_excludes_a_hit(spark):
    words = ["nal", "lan", "lanl", "nnnn", "llll", "abcd", "abnd"]
    df = spark.createDataFrame(list(itertools.product(words, repeat=2)), "a string, b string")
    bound = F.levenshtein(P.canonical_letters(F.col("a")), P.canonical_letters(F.col("b"))) / F.greatest(F.length("a"), F.length("b"))
    assert df.filter(bound > Reader().word_distance(F.col("a"), F.col("b")) + 1e-9).count() == 0


def test_syllables():
    assert P.syllable_tokens("hai2") == ["x", "a", "i", "T2"]
    assert P.syllable_tokens("shi4") == ["ʂ", "ʐ̩", "T4"]
    assert P.syllable_tokens("xue2") == ["ɕ", "T2"]  # finals outside the table vanish


def test_cosine_of_zero_vector(spark):
    df = spark.sql("SELECT array(0.0D, 0.0D) a, array(1.0D, 2.0D) b").select(cosine(F.col("a"), F.col("b")).alias("z"), F.round(cosine(F.col("b"), F.col("b")), 9).alias("o"))
    assert tuple(df.first()) == (0.0, 1.0)


def test_pack_golden():
    ids = [k for k, (a, b) in enumerate(C.packed([3, 4, 5, 2, 9, 1], 8)) for _ in range(a, b)]
    assert ids == [0, 0, 1, 1, 2, 3]


def test_overlap_and_hard_split(spark):
    df = spark.sql("SELECT array('aaa', 'bb', 'cccc', 'd') p, 'abcdefg' t, 1 id")
    o = [r.text for r in C.pack_overlap(df, "id", F.col("p"), 6, 1).orderBy("chunk").collect()]
    assert o == ["aaabb", "bbcccc", "ccccd"] and df.select(T.hard_split(F.col("t"), 3).alias("h")).first().h == ["abc", "def", "g"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=40), st.booleans(), st.data())
def test_valley_cuts_tile(lengths, known, data):
    likeness = data.draw(st.lists(st.floats(-1, 1), min_size=max(0, len(lengths) - 1), max_size=max(0, len(lengths) - 1))) if known else None
    cuts = C.valley_cuts(lengths, 120, 400, likeness or None)
    assert cuts == sorted(set(cuts)) and (not lengths or cuts[0] == 0)


def test_offset_chunks_tile_the_text(spark):
    rows = spark.createDataFrame([("d", "。".join(f"句子{i}" * (i % 9 + 1) for i in range(120)))], "id string, text string")
    atoms = C.atoms(rows, "id", T.split_sentences(F.col("text")))
    full = "\n".join(r.text for r in atoms.orderBy("pos").collect())
    out = C.offset_chunks(atoms, 200).orderBy("chunk").collect()
    assert "".join(r.core for r in out) == full
    assert all(len(r.core) <= 210 for r in out)
    assert C.offset_chunks(atoms.withColumn("likeness", F.rand(3)), 200).agg(F.sum(F.length("core"))).first()[0] == len(full)


def test_nulls_and_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \n ",)], "t string")
    out = df.select(T.split_sentences(F.col("t")).alias("s"), T.is_term(F.col("t")).alias("k"), T.doc_title(F.col("t")).alias("d"), T.safe_name(F.col("t")).alias("n")).collect()
    assert all(r.s == [] and r.k is False and r.d == "" for r in out)
    assert [r.n for r in out] == ["term"] * 3
