"""Phrase tables, readings of words, and words of ideographs that meet by sound."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import phonetic as P
from lexiforge.functions import text as T
from lexiforge.functions.phrases import Finder, Phrases, held_table, load_phrases, replace_phrases
from lexiforge.functions.readings import Lattice, Reader, Sounds, morae, token_distance
from lexiforge.operators import candidates as C


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# ---- phrases


def test_phrases_in_one_pass(spark):
    soft = {"软": "軟", "件": "件"}
    assert one(spark, T.to_tw(F.lit("软件"), soft, {"軟件": "軟體", "體": "身"})) == ("軟體",)  # what was put in is not looked at again
    assert one(spark, replace_phrases(F.lit("abcab"), {"ab": "bc", "bc": "X", "abc": "ab"})) == ("abbc",)  # the longest first, then on
    assert one(spark, replace_phrases(F.lit("aXb"), {"a": "1"}, {"1X": "2"})) == ("2b",)  # the next table sees it all
    assert one(spark, replace_phrases(F.lit(None).cast("string"), {"a": "b"}), replace_phrases(F.lit(""), {"a": "b"}), replace_phrases(F.lit("ab"), {})) == (None, "", "ab")
    assert one(spark, T.to_trad(F.lit("头发发展"), {"发": "發", "头发": "頭髮", "头": "頭"})) == ("頭髮發展",)


def test_phrases_equal_trying_every_length():
    r = random.Random(2)
    word = lambda a, b: "".join(r.choice("abc龍") for _ in range(r.randint(a, b)))
    table = {word(1, 5): word(0, 3) for _ in range(40)} | {"": "never"}
    for _ in range(300):
        text, out, i = word(0, 30), [], 0
        while i < len(text):
            n = next((n for n in range(6, 0, -1) if text[i : i + n] in table and len(text[i : i + n]) == n), 0)
            out.append(table[text[i : i + n]] if n else text[i])
            i += n or 1
        assert Phrases(table).replace(text) == "".join(out)


def test_large_phrase_tables(spark):
    han = [chr(0x4E00 + i) for i in range(2000)]
    table = spark.range(50_000).select(F.concat(*(F.element_at(F.array(*map(F.lit, han[:200])), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(200)) + 1).cast("int")) for k in range(2)), F.col("id").cast("string")).alias("phrase"), F.concat(F.lit("<"), F.col("id"), F.lit(">")).alias("to"))
    phrases = load_phrases(table)
    assert len(phrases) == 50_000
    texts = spark.createDataFrame([(k, f"x{k}y") for k in list(phrases)[::97]], "phrase string, text string").repartition(3)
    got = texts.select("phrase", replace_phrases(F.col("text"), phrases).alias("out")).collect()
    assert len(got) == 516 and all(r.out == f"x{phrases[r.phrase]}y" for r in got)
    with pytest.raises(ValueError):
        held_table(table, most=1000)


def test_finder_has_every_place():
    r = random.Random(5)
    words = {"".join(r.choice("ab龍") for _ in range(r.randint(1, 4))): ["x"] for _ in range(20)}
    text = "".join(r.choice("ab龍😀") for _ in range(200))
    assert sorted((i, n) for i, n, _ in Finder(words).places(text)) == sorted((i, len(w)) for w in words for i in range(len(text)) if text.startswith(w, i))


def test_variants_in_several_passes(spark):
    texts = spark.createDataFrame([(i, "abcab龍xab" * (i % 3)) for i in range(9)] + [(20, None)], "id int, text string")
    variants = spark.createDataFrame([(w, c) for w in ("ab", "b", "龍x", "cab") for c in ("p", "q")] + [("", "x"), ("a", None)], "variant string, correct string")
    whole, parts = (sorted(map(tuple, C.variant_scan(texts, variants, most=m).collect())) for m in (1 << 20, 70))
    assert whole == parts and len(whole) == sum(2 * ("abcab龍xab" * (i % 3)).count(w) for i in range(9) for w in ("ab", "b", "龍x", "cab"))
    assert C.variant_scan(texts, variants.limit(0)).count() == 0


# ---- readings


def test_words_decide_readings(spark):
    table = {"行": "xing2", "銀": "yin2", "銀行": "yin2 hang2", "長": "chang2", "長大": "zhang3 da4", "大": "da4", "樂": "le4", "音樂": "yin1 yue4", "音": "yin1"}
    s = Sounds(table, None, P.DEFAULT)
    say = lambda w: [r for _, r in s.chinese.path(w)]
    assert say("銀行") == ["yin2 hang2"] and say("行長大") == ["xing2", "zhang3 da4"] and say("音樂行") == ["yin1 yue4", "xing2"]
    assert s.tokens("A銀行!") == ["A", *P.syllable_tokens("yin2"), *P.syllable_tokens("hang2"), "!"]
    assert s.tokens("無行") == P.syllable_tokens("xing2")  # no reading, no token
    reader = Reader.of(spark.createDataFrame(list(table.items()) + [("", "x"), ("空", "")], "word string, reading string"))
    assert one(spark, reader.tokens(F.lit("音樂")), reader.ipa(F.lit("行")), reader.tokens(F.lit(None).cast("string"))) == (s.tokens("音樂"), " ".join(P.syllable_tokens("xing2")), None)


def test_lattice_takes_the_shortest_path():
    r = random.Random(1)
    for _ in range(200):
        words = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): "x" for _ in range(6)}
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))

        def every(i):
            if i == len(text):
                return [()]
            pieces = {text[i : i + n] for n in range(1, 5)} & words.keys() | {text[i]}
            return [(p, *rest) for p in pieces for rest in every(i + len(p))]

        unread = lambda p: sum(x not in words for x in p)
        best = min(every(0), key=lambda p: (unread(p), len(p), [-len(x) for x in p]))
        assert [p for p, _ in Lattice(words).path(text)] == list(best)


def test_kana_by_morae():
    assert morae("きょうと") == [["k", "j", "o"], ["ɯ"], ["t", "o"]] and morae("シャッター") == [["ɕ", "a"], ["ʔ"], ["t", "a"], ["ː"]]
    assert morae("ファン") == [["ɸ", "a"], ["ɴ"]] and morae("ティー") == [["t", "i"], ["ː"]] and morae("ぁ") == [["a"]] and morae("ァa") == [["a"], ["a"]]
    s = Sounds({"東": "dong1", "京": "jing1"}, {"東京": "とうきょう"}, P.DEFAULT)
    assert s.tokens("東京タワ") == [t for m in morae("とうきょうたわ") for t in m] and s.tokens("東京") == P.syllable_tokens("dong1") + P.syllable_tokens("jing1")
    assert Sounds({"東": "dong1"}, None, P.DEFAULT).tokens("東か") == [*P.syllable_tokens("dong1"), "k", "a"]


def test_forty_thousand_readings(spark):
    base = sorted(P.SYLLABLES)[:400]
    rows = [(chr(0x4E00 + i), f"{base[i % 400]}{i % 4 + 1}") for i in range(20_000)] + [(chr(0x4E00 + i) + chr(0x4E00 + i + 1), f"{base[(i + 7) % 400]}1 {base[(i + 9) % 400]}2") for i in range(20_000)]
    reader = Reader.of(spark.createDataFrame(rows, "word string, reading string"))
    assert len(reader.words) == 40_000
    texts = spark.range(500).select((F.chr(F.lit(65))).alias("a"), F.col("id")).select(F.udf(lambda i: chr(0x4E00 + i) + chr(0x4E00 + i + 1) + "x", "string")("id").alias("t"), "id")
    for r in texts.select("id", reader.tokens(F.col("t")).alias("tokens")).collect():
        assert r.tokens == [*P.syllable_tokens(f"{base[(r.id + 7) % 400]}1"), *P.syllable_tokens(f"{base[(r.id + 9) % 400]}2"), "x"]


def test_distance_in_tasks_equals_the_column(spark):
    r = random.Random(6)
    some = lambda: sum((P.syllable_tokens(r.choice(list(P.READINGS.values()))) for _ in range(r.randint(0, 3))), [r.choice("nl")] * r.randint(0, 2))
    pairs = [(some(), some()) for _ in range(150)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", P.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(abs(x.d - token_distance(x.a, x.b)) < 1e-9 for x in got)


# ---- meeting by sound


def generated(seed=4, n=120):
    """Readings for 60 characters in groups of near sounds, and words of them."""
    r = random.Random(seed)
    syllables = ["shi4", "si4", "shi1", "si1", "zhi4", "zi4", "ban1", "bang1", "pan1", "lin2", "ling2", "nin2", "li4", "ni4", "hua4", "hua2", "zhuang1", "chuang1", "zhang1", "e4"]
    chars = [chr(0x4E00 + 7 * i) for i in range(60)]
    readings = {c: syllables[i % 20] for i, c in enumerate(chars[:55])}  # five characters have none
    word = lambda: "".join(r.choice(chars) for _ in range(r.randint(1, 4)))
    words = [word() for _ in range(n)]
    words += ["".join(r.choice([c, chars[(chars.index(c) + r.choice([1, 20, 40, 2])) % 60]]) for c in w) for w in words]
    return readings, chars, words


def test_words_of_ideographs_meet_as_if_all_were_compared(spark):
    readings, chars, words = generated()
    r = random.Random(8)
    mixed = [w[:1] + r.choice("ab") + w[1:] for w in words[::9]] + ["shi", "si", "ban"]
    reader, costs = Reader(readings), P.Costs(candidates=10_000)
    surfaces = spark.createDataFrame([(w,) for w in words + mixed], "surface string")
    targets = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(set(words[::2] + mixed)))], "ord int, correct string").withColumn("flat", F.col("correct")).withColumn("is_cag", F.lit(True))
    s = Sounds(readings, None, costs)
    names = sorted(set(words + mixed)), sorted(set(words[::2] + mixed))
    want = {(a, b) for a in names[0] for b in names[1] if a != b and s.word_distance(a, b) <= costs.fuzzy}
    got = {(x.surface, x.correct) for x in C.phonetic_join(surfaces, targets, costs, reader=reader).collect()}
    assert got == want and len(want) > 100
    # what meets, against all pairs of equal length
    han = [df.filter(P.is_han(F.col(w))) for df, w in ((surfaces.distinct(), "surface"), (targets, "correct"))]
    met = C.han_pairs(*han, reader, costs.fuzzy).count()
    n = [[len(w) for w in set(ws) if not set(w) & set("abhisn")] for ws in names]
    assert met < 0.5 * sum(x == y for x in n[0] for y in n[1])


def test_windows_near_targets_as_if_all_were_compared(spark):
    readings, chars, words = generated(9, 40)
    r = random.Random(10)
    texts = [(i, "".join(r.choice(chars + ["a", "，"] + [w for w in words if len(w) > 1][:30]) for _ in range(r.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "no han"), (92, chars[0])]
    wanted = sorted({w for w in words[::3]} | {"a" + words[0], words[1] + "si"})
    targets = spark.createDataFrame([(w, w, len(w) % 4 != 3) for w in wanted], "correct string, flat string, is_cag boolean")
    s, limit = Sounds(readings, None, P.DEFAULT), P.DEFAULT.fuzzy
    want = set()
    for i, t in texts:
        for w in wanted:
            for a in range(len(t or "") - len(w) + 1):
                x = t[a : a + len(w)]
                if len(w) >= 2 and len(w) % 4 != 3 and all("一" <= c <= "鿿" for c in x) and x != w and s.word_distance(x, w) <= limit:
                    want.add((i, a, x, w))
    df = spark.createDataFrame(texts, "id int, text string")
    for most in (1 << 20, 200):
        got = {tuple(x) for x in C.window_scan(df, targets, reader=Reader(readings), most=most).collect()}
        assert got == want and len(want) > 50
    loose = P.Costs(fuzzy=0.45)  # letters alone can come near, too
    assert {(0, "si")} & {(x.start, x.correct) for x in C.window_scan(spark.createDataFrame([(1, "是是")], "id int, text string"), spark.createDataFrame([("si", "si", True)], targets.schema), costs=loose, reader=Reader({"是": "i4"}, costs=loose)).collect()} == set()
