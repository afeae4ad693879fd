"""Secret scans with built-in functions only.

Fixed rules find assignments, access keys and hexadecimal runs.  Beside them
the Shannon entropy of a window is slid over candidate strings, for each
character class with its own window and limit; the counts of the window are
updated as one character enters and one leaves.  Candidates on the allow list
are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules for base spans, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Stands for the characters of an assignment; candidates that touch one are no candidates.
MASK = "\uffff"
FREE = rf"(?<![A-Za-z0-9+/_=\-{MASK}])[A-Za-z0-9+/_=-]{{20,}}+(?!{MASK})"
#: Character classes of candidates: name, pattern of the whole string, alphabet, window, least entropy in bits.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 16, 3.05),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.93),
)
#: Never reported by the entropy rule: placeholders, counting runs, UUIDs.
ALLOW = r"(?i)example|sample|dummy|placeholder|x{6}|0123456789|abcdefghij|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _named(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _steps(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches m, the gap g before each, and the group's text v."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.filter(F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"), part.alias("v")), lambda s: s["m"].isNotNull())


def _spans(text: Column, pattern: str, kind: str, rank: int, keep: tuple[int, int] | None = None) -> Column:
    """Spans (code points, end exclusive) of leftmost non-overlapping matches.

    Positions are running sums over the matches and the gaps between them, first
    over blocks of matches, then inside each block: an array that grows by one
    is copied each time, so none may grow beyond the root of their number.
    ``keep`` = (group, least length) drops matches whose group is shorter.
    """
    both = lambda s: (F.length(s["g"]) + F.length(s["m"])).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def running(items: Column, size, begin: Column, make) -> Column:
        """An array with ``make(item, start)``, the start being the sum of the sizes before."""
        empty = F.struct(begin.alias("at"), F.slice(F.transform(items, lambda x: make(x, zero)), F.lit(1), F.lit(0)).alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.array_append(acc["out"], make(x, acc["at"])).alias("out"))
        return F.aggregate(items, empty, step, lambda acc: acc["out"])

    def span(s: Column, at: Column) -> Column:
        start = at + F.length(s["g"])
        return F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), (at + both(s)).alias("end"), F.lit(kind).alias("kind"), s["m"].alias("value"), s["v"].alias("v"))

    def blocks(steps: Column) -> Column:
        width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(steps).cast("double"))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int")), lambda b: F.slice(steps, b * width + 1, width))
        return F.transform(cut, lambda x: F.struct(x.alias("steps"), F.aggregate(x, zero, lambda acc, s: acc + both(s)).alias("size")))

    def located(steps: Column) -> Column:
        starts = running(blocks(steps), lambda x: x["size"], zero, lambda x, at: F.struct(x["steps"].alias("steps"), at.alias("at")))
        return F.flatten(F.transform(starts, lambda x: running(x["steps"], both, x["at"], span)))

    found = _named(_steps(text, pattern, keep[0] if keep else None), located)
    kept = F.filter(found, lambda s: F.length(s["v"]) >= keep[1]) if keep else found
    plain = F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")]))
    return F.when(F.regexp_like(text, F.lit(pattern)), plain).otherwise(F.array().cast(_SPAN))


def _masked(text: Column) -> Column:
    """The text with every character of its assignments replaced by ``MASK``; places stay as they are."""
    clear = F.translate(text, MASK, " ")
    hide = lambda s: F.concat(s["g"], F.when(F.length(s["v"]) >= ASSIGN_LEAST, F.repeat(F.lit(MASK), F.length(s["m"]))).otherwise(s["m"]))
    rest = F.element_at(F.split(clear, ASSIGN, -1), -1)
    return F.when(F.regexp_like(clear, F.lit(ASSIGN)), F.concat(F.array_join(F.transform(_steps(clear, ASSIGN, 2), hide), ""), rest)).otherwise(clear)


#: Weights are whole numbers of this share of a bit, so that they add up exactly over windows of any number.
UNIT = 2.0**-40


def _weight(n: Column, window: int) -> Column:
    """n log2 n for a count up to the window, in units."""
    table = F.array(*[F.lit(round(c * math.log2(c) / UNIT) if c > 1 else 0).cast("bigint") for c in range(window + 1)])
    return F.element_at(table, n + 1)


def _times(c: Column, window: Column) -> Column:
    """How often a character stands in a short string."""
    return F.length(window) - F.length(F.replace(window, c, F.lit("")))


def least_weight(value: Column, window: int, enough: float = 0.0) -> Column:
    """Least sum of n log2 n, in bits, over the windows of a string: its most varied window, or one of at most ``enough``.

    The first window is counted outright; each further one follows by taking
    one character out of the counts and putting one in.  The fold carries the
    window itself, so a step costs the same at every place of a long string,
    and nearly nothing once a window is varied enough.
    """
    first = F.substring(value, 1, window)
    letters = F.array_distinct(F.split(first, ""))
    weight = F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(c == "", F.lit(0)).otherwise(_weight(_times(c, first), window)))
    begin = F.struct(first.alias("window"), weight.alias("w"), weight.alias("least"))
    stop = F.lit(int(enough / UNIT)).cast("bigint")

    def step(acc: Column, come: Column) -> Column:
        gone, rest = F.substring(acc["window"], 1, 1), F.substring(acc["window"], 2, window)
        a, b = _times(gone, rest), _times(come, rest)
        w = acc["w"] - _weight(a + 1, window) + _weight(a, window) - _weight(b, window) + _weight(b + 1, window)
        moved = _named(w, lambda w: F.struct(F.concat(rest, come).alias("window"), w.alias("w"), F.least(acc["least"], w).alias("least")))
        return F.when((acc["least"] <= stop) | (come == ""), acc).otherwise(moved)

    more = F.when(F.length(value) > window, F.split(F.substring(value, window + 1, 2**31 - 1), "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(more, begin, step, lambda acc: acc["least"] * F.lit(UNIT))


def _suspicious(span: Column) -> Column:
    value = span["value"]
    tests = F.lit(False)
    for _, whole, alphabet, window, least in reversed(CLASSES):
        folded = F.lower(value) if alphabet == alphabet.lower() else value
        most = (math.log2(window) - least) * window + 1e-9
        tests = F.when(F.regexp_like(value, F.lit(whole)), least_weight(folded, window, most) <= most).otherwise(tests)
    return F.when(F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")) & ~F.regexp_like(value, F.lit(ALLOW)), tests).otherwise(F.lit(False))


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the arrays of spans: assign, access, hex, entropy, for each input row.

    Null texts count as empty and have no spans; whole texts of any length are
    scanned.  An entropy span is left out where a base span already overlaps
    it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        _spans(text, ASSIGN, "assign", 0, (2, ASSIGN_LEAST)).alias("assign"),
        _spans(text, ACCESS, "access", 1).alias("access"),
        _spans(text, HEX, "hex", 2).alias("hex"),
        _spans(_masked(text), FREE, "candidate", 3).alias("candidate"),
    )
    base = rows.withColumn("base", F.concat("assign", "access", "hex"))
    # other base spans lie inside one candidate, as all their characters are of its kind
    free = F.filter("candidate", lambda c: ~F.regexp_like(c["value"], F.lit(f"{ACCESS}|{HEX}")) & _suspicious(c))
    kind = F.when
    named = F.transform(
        free,
        lambda c: F.struct(
            c["start"].alias("start"),
            kind(F.regexp_like(c["value"], F.lit(CLASSES[0][1])), F.lit(3)).otherwise(F.lit(4)).alias("rank"),
            c["end"].alias("end"),
            kind(F.regexp_like(c["value"], F.lit(CLASSES[0][1])), F.lit(CLASSES[0][0])).otherwise(F.lit(CLASSES[1][0])).alias("kind"),
            c["value"].alias("value"),
        ),
    )
    return base.select("doc_id", "assign", "access", "hex", "base", named.alias("entropy"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each input row."""
    return secret_spans(docs, id_col, text_col).select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_join(F.col("base")), 256).alias("base_sha256"),
        _join(F.concat("base", "entropy")).alias("spans"),
    )
