"""Text columns: punctuation, guards, splitting and parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import canon_lang, name_limits
from .phrases import replace_phrases

# Signs that carry no sound.
PUNCT = "\\s　，、。．‧·・！？!?；;：:,.…—─\\-－~～「」『』（）()《》〈〉【】\\[\\]｛｝{}＂\"'“”‘’`*#＃@＠/／\\\\｜|＿_"
SENTENCE_END = "。！？!?；;\n"
MAX_TERM, CJK_SIGNS, ASCII_SIGNS = 16, "[。！？，、；：…]", "[.!?;:,\"]"
FILLERS = ("all right", "well thank you", "i think so", "you know", "ok", "okay", "right", "yeah", "thank you", "i mean")
NAME_END, QUOTES = "[。！？!?．.、]$", "「」『』\"'"
# Categories of entities, and key words that stand for them, in order.
UNCLASSIFIED = "未分類"
CATEGORIES = {
    "人名": ("人名", "人物", "姓名", "綽號", "職稱"),
    "組織機構": ("組織", "機構", "公司", "單位", "部門", "團體", "機關", "企業"),
    "地點地名": ("地點", "地名", "國家", "城市", "地區", "場所", "地標", "位置"),
    "產品品牌": ("產品", "品牌", "服務", "系統", "平台", "商品"),
    "技術或概念術語": ("技術", "概念", "術語", "理論", "方法", "法則", "原則", "思維", "知識", "主題"),
    "外來詞或英文詞": ("外來", "英文", "外語", "音譯", "縮寫", "abbr"),
    "事件活動": ("事件", "活動", "會議", "專案", "計畫", "計劃", "典禮", "流程", "簽核"),
    "作品或標題": ("作品", "標題", "書名", "章節", "課程", "文章", "簡報", "題目"),
}
CLEAN_EXTENSIONS = (".xlsx", ".docx", ".pptx", ".pdf")
DIRTY_NAME = "字幕|逐字|校正|三語對齊|transcript|L3"
DROP_PREFIX = "(?i)^(en|ja|ko|jpn|eng|fr|de|es)\\s*[:：]"
ANCHOR_PREFIX = "(?i)^(zh|cmn|zho|zh-tw|zh-cn|中文)\\s*[:：]\\s*"
MARKER, NUMBERED = "^-{2,}\\s*\\d*\\s*$", "^-{2,}\\s*\\d+\\s*$"
HAN = "[一-鿿]"
NUMERIC_TYPES = ("CARDINAL", "DATE", "MONEY", "ORDINAL", "PERCENT", "QUANTITY", "TIME")


def strip(text: Column) -> Column:
    """White space off both ends, the wide blank included."""
    return F.regexp_replace(text, "^[\\s\\u3000]+|[\\s\\u3000]+$", "")


def strip_punct(text: Column) -> Column:
    """Only letters, digits and ideographs; '' for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{PUNCT}]+", "")


def flatten(text: Column, glyphs: dict[str, str] | None = None) -> Column:
    """Glyph variants folded to one form by a character table; the identity without one."""
    if not glyphs:
        return text
    return F.translate(text, "".join(glyphs), "".join(glyphs.values()))


def to_simp(text: Column, table: dict[str, str]) -> Column:
    """Traditional glyphs to simplified ones by a table of characters or phrases."""
    return replace_phrases(text, table)


def to_trad(text: Column, table: dict[str, str]) -> Column:
    """Simplified glyphs to traditional ones by a table of characters or phrases, which settle glyphs that have several."""
    return replace_phrases(text, table)


def to_tw(text: Column, table: dict[str, str], phrases: dict[str, str]) -> Column:
    """Traditional glyphs, then local vocabulary; for text in the anchor language only, as other languages share its glyphs.

    Both tables are phrases, of one character or more: where several fit, the
    longest counts, and what it became is not looked at again by the same table.
    """
    return replace_phrases(text, table, phrases)


def fold_table(simplified: dict[str, str], traditional: dict[str, str]) -> dict[str, str]:
    """The table for ``flatten`` that turns every glyph into the traditional form of its simplified one."""
    whole = {c: traditional.get(simplified.get(c, c), simplified.get(c, c)) for c in simplified | traditional}
    return {c: to for c, to in whole.items() if c != to}


def parallel_text(langs: Column, anchor: str = "cmn", most: int = 600) -> Column:
    """The other languages of a map by code, one a line, at most ``most`` characters."""
    others = F.filter(F.map_entries(langs), lambda e: (e["key"] != anchor) & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.substring(F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), 1, most)


def same_flat(a: Column, b: Column, glyphs: dict[str, str] | None = None) -> Column:
    return flatten(a, glyphs) == flatten(b, glyphs)


def split_sentences(text: Column) -> Column:
    """Sentences with their end signs, trimmed, blank ones dropped."""
    return F.filter(F.transform(_sentence_parts(F.coalesce(text, F.lit(""))), strip), lambda s: s != "")


def _sentence_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{SENTENCE_END}]*[{SENTENCE_END}]|[^{SENTENCE_END}]+)"), F.lit(1))


def hard_split(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last one shorter."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1)), F.array().cast("array<string>"))


def is_term(text: Column) -> Column:
    """Whether a string can be a term: short, no sentence signs, no number, no filler."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t != "") & (F.length(t) <= MAX_TERM) & ~t.rlike(CJK_SIGNS) & ~t.rlike(ASCII_SIGNS) & ~t.rlike("^[0-9.,]+$") & ~F.lower(t).isin(*FILLERS)


def clean_name(text: Column, iso: Column) -> Column:
    """A fixed translation without quotes, '' where it is too long or looks like a sentence."""
    t = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), f"^[{QUOTES}]+|[{QUOTES}]+$", "")
    limits = name_limits(iso)
    words = F.size(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    bad = (F.length(t) > limits["max_chars"]) | t.rlike(NAME_END) | t.rlike(CJK_SIGNS) | t.rlike("[「」。]") | ((limits["max_words"] > 0) & (words > limits["max_words"]))
    return F.when(bad, "").otherwise(t)


def canon_category(category: Column) -> Column:
    """One of the known categories, by name or by the first rule with a key word inside."""
    c = strip(F.coalesce(category, F.lit("")))
    out = F.lit(UNCLASSIFIED)
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(c.rlike("|".join(words)), name).otherwise(out)
    return F.when((c == "") | (c == UNCLASSIFIED), UNCLASSIFIED).when(c.isin(*CATEGORIES), c).otherwise(out)


def auto_decision(file_name: Column) -> Column:
    """extract for clean file types whose name doesn't tell of transcripts, else exclude."""
    ext = F.lower(F.regexp_extract(file_name, "(\\.[^./]*)$", 1))
    return F.when(ext.isin(*CLEAN_EXTENSIONS) & ~file_name.rlike(DIRTY_NAME), "extract").otherwise("exclude")


def effective_decision(override: Column, file_name: Column) -> Column:
    return F.coalesce(override, auto_decision(file_name))


def clean_detection(text: Column) -> Column:
    """Without warning signs and notes like (?...)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "⚠️?|[(（][?？][^)）]*[)）]", "")


def keep_entity(surface: Column, kind: Column) -> Column:
    """Entities worth a look: two characters or more, no number or time."""
    return (F.length(surface) >= 2) & ~kind.isin(*NUMERIC_TYPES)


def local_sentence(context: Column, surface: Column) -> Column:
    """First sentence that holds the surface when signs are taken out, else 80 characters, else the surface."""
    whole = F.coalesce(context, F.lit(""))

    def first(bare: Column) -> Column:
        """Signs are taken out of sentences up to the one that is found, and of none if the whole text lacks the surface."""
        holds = lambda s: F.contains(strip_punct(s), bare) & ((bare != "") | (strip(s) != ""))
        found = F.aggregate(_sentence_parts(whole), F.lit(None).cast("string"), lambda hit, s: F.coalesce(hit, F.when(holds(s), strip(s))))
        return F.when(F.contains(strip_punct(whole), bare), found)

    hit = F.element_at(F.transform(F.array(strip_punct(surface)), first), 1)
    return F.coalesce(hit, F.nullif(F.substring(whole, 1, 80), F.lit("")), surface)


def safe_name(text: Column) -> Column:
    """A file name: bad characters to _, at most 80 characters, never empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\\\/:*?\"<>|\\s]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "term").otherwise(F.substring(t, 1, 80))


def doc_title(text: Column) -> Column:
    """First line that isn't blank, 60 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), strip), lambda s: s != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 60)


def fits(text: Column, most: int = 6000) -> Column:
    """Whether a text is short enough to be taken whole; longer ones are rejected, never cut."""
    return F.length(F.coalesce(text, F.lit(""))) <= most


def bracket_first(context: Column, word: Column) -> Column:
    """The first occurrence of a word put in square brackets."""
    at = F.instr(context, word)
    marked = F.concat(F.substring(context, F.lit(1), at - 1), F.lit("["), word, F.lit("]"), F.substring(context, at + F.length(word), F.length(context)))
    return F.when((at > 0) & (word != ""), marked).otherwise(context)


def split_variants(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[、,，;；/\\s]+"), lambda v: v != "")


def clean_variants(raw: Column, correct: Column, existing: Column | None = None, glyphs: dict[str, str] | None = None) -> Column:
    """Distinct usable variants, after the existing ones, in order."""
    good = F.filter(F.transform(raw, strip), lambda v: (v != "") & ~v.rlike("^[0-9]+$") & is_term(v) & ~same_flat(v, correct, glyphs))
    return ordered_distinct(F.concat(existing, good) if existing is not None else good, glyphs)


def ordered_distinct(values: Column, glyphs: dict[str, str] | None = None) -> Column:
    """First of each value after folding, in order."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda x: same_flat(x, v, glyphs)), acc).otherwise(F.array_append(acc, v)))


def extract_json(text: Column) -> Column:
    """From the first brace to the last, or bracket to bracket; null if it doesn't parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)(\\{.*\\}|\\[.*\\])", 1), F.lit("")))


def judge_answer(text: Column) -> Column:
    """struct(parsed, abandon, xling) from the first braces of an answer; by default abandon, not xling."""
    raw = F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)(\\{.*?\\})", 1)
    got = F.from_json(raw, "abandon boolean, xling boolean")
    parsed = F.try_parse_json(F.nullif(raw, F.lit(""))).isNotNull()
    return F.struct(parsed.alias("parsed"), F.coalesce(got["abandon"], F.lit(True)).alias("abandon"), F.coalesce(got["xling"], F.lit(False)).alias("xling"))


def json_parses(text: Column) -> Column:
    """Whether an answer, a code fence around it taken off, is JSON."""
    bare = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)^\\s*```[a-zA-Z]*|```\\s*$", ""))
    return F.when(bare == "", False).otherwise(F.try_parse_json(bare).isNotNull())


def parse_names(names: Column) -> Column:
    """map<iso, name> from map<key, name>: known languages only, guarded names only."""
    pairs = F.transform(F.map_entries(names), lambda e: F.struct(canon_lang(e["key"]).alias("iso"), e["value"].alias("value")))
    good = F.filter(F.transform(pairs, lambda e: F.struct(e["iso"].alias("iso"), clean_name(e["value"], e["iso"]).alias("value"))), lambda e: (e["iso"] != "") & (e["value"] != ""))
    isos = F.array_distinct(F.transform(good, lambda e: e["iso"]))
    # of several keys for one language the last one counts
    return F.map_from_entries(F.transform(isos, lambda i: F.struct(i.alias("key"), F.element_at(F.filter(good, lambda e: e["iso"] == i), -1)["value"].alias("value"))))


def name_sources(names: Column, text: Column) -> Column:
    """text where a name occurs in the source, else gen."""
    return F.transform_values(names, lambda k, v: F.when(F.contains(F.coalesce(text, F.lit("")), v), "text").otherwise("gen"))


def migrate_names(names: Column, en: Column, ja: Column) -> Column:
    """Old single columns moved into the map where it lacks them; empty values dropped."""
    old = F.map_from_arrays(F.array(F.lit("eng"), F.lit("jpn")), F.array(en, ja))
    merged = F.map_zip_with(names, old, lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    return F.map_filter(merged, lambda k, v: v.isNotNull() & (v != ""))


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both; the new value wins where there is one."""
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))


def card_text(*parts: Column) -> Column:
    """Non-empty parts joined by the wide bar."""
    return F.concat_ws("｜", *[F.nullif(p, F.lit("")) for p in parts])


def card_hash(*parts: Column) -> Column:
    """Identity of a card's content: 16 hexadecimal digits."""
    return F.substring(F.sha2(card_text(*parts), 256), 1, 16)


def title_text(text: Column) -> Column:
    """Page title with underscores as blanks."""
    return F.trim(F.replace(text, F.lit("_"), F.lit(" ")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n", -1)


def has_markers(text: Column) -> Column:
    """Whether two or more lines are numbered markers."""
    return F.size(F.filter(lines_of(text), lambda s: strip(s).rlike(NUMBERED))) >= 2


def extract_anchor(text: Column, rewrite=None) -> Column:
    """Lines of the anchor language: other languages' lines and markers dropped, prefix taken off."""

    def line(s: Column) -> Column:
        s = strip(s)
        bare = strip(F.regexp_replace(s, ANCHOR_PREFIX, ""))
        return F.when((s == "") | s.rlike(MARKER) | s.rlike(DROP_PREFIX), "").when(s.rlike(ANCHOR_PREFIX), bare).when(s.rlike(HAN), s).otherwise("")

    out = F.array_join(F.filter(F.transform(lines_of(text), line), lambda s: s != ""), "\n")
    return rewrite(out) if rewrite else out
