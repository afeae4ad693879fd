"""Scripts and languages: block patterns, detection and the language registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unicode blocks by ISO 15924 script, in order of precedence, and the language each stands for.
BLOCKS = (
    ("Jpan", "jpn", "぀-ヿ"),
    ("Hang", "kor", "가-힣ᄀ-ᇿ"),
    ("Han", "cmn", "一-鿿㐀-䶿"),
    ("Latn", "eng", "A-Za-zÀ-ɏ"),
    ("Cyrl", "rus", "Ѐ-ӿ"),
    ("Thai", "tha", "฀-๿"),
    ("Arab", "ara", "؀-ۿ"),
    ("Deva", "hin", "ऀ-ॿ"),
    ("Taml", "tam", "஀-௿"),
)
SIMPLIFIED_HINT = "这国说对实现产发会无与时间们个为来"
TAG_SCRIPT = {"jpn": "Jpan", "kor": "Hang", "eng": "Latn", "rus": "Cyrl", "tha": "Thai", "ara": "Arab", "hin": "Deva", "tam": "Taml"}

# Registered languages: ISO 639-3 code, script, aliases.
REGISTRY = (
    ("cmn", "Hant", ("zh", "zho", "cmn", "mandarin", "chinese", "中文", "國語", "華語")),
    ("eng", "Latn", ("en", "eng", "english", "英文", "英語")),
    ("jpn", "Jpan", ("ja", "jpn", "jp", "japanese", "日文", "日語")),
    ("kor", "Hang", ("ko", "kor", "korean", "韓文", "韓語")),
    ("tha", "Thai", ("th", "tha", "thai", "泰文", "泰語")),
    ("vie", "Latn", ("vi", "vie", "vietnamese", "越南文", "越語", "越南語")),
    ("tgl", "Latn", ("tl", "tgl", "fil", "tagalog", "filipino", "他加祿", "菲律賓語")),
    ("ind", "Latn", ("id", "ind", "indonesian", "印尼文", "印尼語")),
    ("deu", "Latn", ("de", "deu", "ger", "german", "德文", "德語")),
    ("fra", "Latn", ("fr", "fra", "fre", "french", "法文", "法語")),
    ("spa", "Latn", ("es", "spa", "spanish", "西班牙文", "西班牙語")),
    ("por", "Latn", ("pt", "por", "portuguese", "葡萄牙文", "葡萄牙語")),
    ("ita", "Latn", ("it", "ita", "italian", "義大利文", "義大利語")),
    ("nld", "Latn", ("nl", "nld", "dut", "dutch", "荷蘭文", "荷蘭語")),
    ("ces", "Latn", ("cs", "ces", "cze", "czech", "捷克文", "捷克語")),
    ("swe", "Latn", ("sv", "swe", "swedish", "瑞典文", "瑞典語")),
    ("ltz", "Latn", ("lb", "ltz", "luxembourgish", "盧森堡語")),
    ("slk", "Latn", ("sk", "slk", "slo", "slovak", "斯洛伐克語")),
    ("pol", "Latn", ("pl", "pol", "polish", "波蘭文", "波蘭語")),
    ("ukr", "Cyrl", ("uk", "ukr", "ukrainian", "烏克蘭文", "烏克蘭語")),
    ("rus", "Cyrl", ("ru", "rus", "russian", "俄文", "俄語")),
    ("ara", "Arab", ("ar", "ara", "arabic", "阿拉伯文", "阿拉伯語")),
    ("tur", "Latn", ("tr", "tur", "turkish", "土耳其文", "土耳其語")),
    ("hin", "Deva", ("hi", "hin", "hindi", "印地文", "印地語")),
    ("tam", "Taml", ("ta", "tam", "tamil", "泰米爾文", "泰米爾語")),
    ("urd", "Arab", ("ur", "urd", "urdu", "烏爾都文", "烏爾都語")),
)
DENSE_SCRIPTS = ("Hant", "Hans", "Jpan", "Hang", "Thai")
DENSE_LIMITS, SPACED_LIMITS = (16, 0), (28, 4)


def registry_rows() -> list[tuple[str, str, str, int, int]]:
    """(alias, iso, script, max_chars, max_words); every code is an alias of itself."""
    rows = {}
    for iso, script, aliases in REGISTRY:
        limits = DENSE_LIMITS if script in DENSE_SCRIPTS else SPACED_LIMITS
        for alias in (iso, *aliases):
            rows[alias.lower()] = (alias.lower(), iso, script, *limits)
    return list(rows.values())


def languages(spark: SparkSession) -> DataFrame:
    """The registry as a small table: one row for each alias."""
    return spark.createDataFrame(registry_rows(), "alias string, iso string, script string, max_chars int, max_words int")


def canon_lang(key: Column) -> Column:
    """ISO 639-3 code of any alias, '' where unknown."""
    table = F.create_map(*[F.lit(x) for alias, iso, *_ in registry_rows() for x in (alias, iso)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(key, F.lit(""))))), F.lit(""))


def name_limits(iso: Column) -> Column:
    """struct(max_chars, max_words) for names in a language; 0 words means no limit."""
    dense = sorted({i for _, i, script, *_ in registry_rows() if script in DENSE_SCRIPTS})
    return F.struct(F.when(iso.isin(*dense), DENSE_LIMITS[0]).otherwise(SPACED_LIMITS[0]).alias("max_chars"), F.when(iso.isin(*dense), DENSE_LIMITS[1]).otherwise(SPACED_LIMITS[1]).alias("max_words"))


def char_script(char: Column) -> Column:
    """Script of one character; Zyyy for signs, digits and blanks."""
    out = F.lit("Zyyy")
    for script, _, block in reversed(BLOCKS):
        ranges = re.findall("(.)-(.)", block)
        out = F.when(reduce(or_, [char.between(a, b) for a, b in ranges]), script).otherwise(out)
    return out


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _counts(text: Column) -> Column:
    """Characters of each block as a struct: what is missing once its runs are taken out."""
    return F.struct(*[(F.length(text) - F.length(F.regexp_replace(text, f"[{block}]+", ""))).alias(iso) for _, iso, block in BLOCKS])


def _by_language(n: Column) -> dict[str, Column]:
    """The counts by language; Han counts as cmn only without kana."""
    counts = {iso: n[iso] for _, iso, _ in BLOCKS}
    return counts | {"cmn": F.when(n["jpn"] > 0, 0).otherwise(n["cmn"])}


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each language's own block."""
    return _by_language(_counts(text))


def _present(n: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(c > 0, iso) for iso, c in _by_language(n).items()]))
    return _once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("und"))))


def _first(n: Column) -> Column:
    counts = _by_language(n)
    most, out = F.greatest(*counts.values()), F.lit("und")
    for iso, c in reversed(counts.items()):
        out = F.when(c == most, iso).otherwise(out)
    return F.when(most == 0, "und").otherwise(out)


def _tag(text: Column, lang: Column) -> Column:
    script = F.when(lang == "cmn", F.when(text.rlike(f"[{SIMPLIFIED_HINT}]"), "Hans").otherwise("Hant"))
    for iso, s in TAG_SCRIPT.items():
        script = script.when(lang == iso, s)
    return F.concat(lang, F.lit("-"), script.otherwise("Zyyy"))


def langs_present(text: Column) -> Column:
    """Codes of all languages seen, in block order; [und] if none."""
    return _once(_counts(F.coalesce(text, F.lit(""))), _present)


def primary_lang(text: Column) -> Column:
    """Language with most characters, the earlier block on ties; und if none."""
    return _once(_counts(F.coalesce(text, F.lit(""))), _first)


def lang_tag(text: Column) -> Column:
    """Language and script, as in cmn-Hant."""
    return _once(primary_lang(text), lambda lang: _tag(text, lang))


def language_facts(text: Column) -> Column:
    """struct(lang, tag, present): ``primary_lang``, ``lang_tag`` and ``langs_present`` from one count of the characters."""
    known = _once(_counts(F.coalesce(text, F.lit(""))), lambda n: F.struct(_first(n).alias("lang"), _present(n).alias("present")))
    return _once(known, lambda k: F.struct(k["lang"].alias("lang"), _tag(text, k["lang"]).alias("tag"), k["present"].alias("present")))


def run_pattern() -> str:
    """Matches maximal runs of one script; alphabets with blanks keep them inside and after."""
    parts = []
    for script, _, block in BLOCKS:
        parts.append(rf"[{block}][{block}\s]*" if script in ("Latn", "Cyrl") else f"[{block}]+")
    return "|".join(parts)


def runs(text: Column) -> Column:
    """The runs of ``script_runs`` alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({run_pattern()})"), F.lit(1))


def script_runs(text: Column) -> Column:
    """array<struct<script, run>>: runs of one script; signs and digits end a run and vanish."""
    return F.transform(runs(text), lambda r: F.struct(char_script(F.substring(r, 1, 1)).alias("script"), r.alias("run")))
