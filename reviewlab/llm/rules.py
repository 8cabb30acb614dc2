"""Quality rules (operator 13), in DataFrame functions only.

A table of thresholds (``RULES``) is compiled into one Spark projection: every
measure (lengths, symbol, stop-word and line ratios) is a column expression
over the words and lines of a row, and every threshold a comparison. Nothing
is shuffled, and no user function runs.

Repeated 8-word windows are found inside the row. A window's hash is made by
doubling (of 2, 4, then 8 word hashes); only texts in which some window hash
is met twice sort their windows, and the words that repeated windows cover are
counted from the gaps between their starts. Two different windows of one text
count as equal only if their 64-bit hashes meet (about n^2 / 2^65 for n
words)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: white space between words
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: a word of these alone has no letter (other characters beyond ASCII count as letters)
NO_LETTERS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
#: words in a window, a power of two
WINDOW = 8
#: of the base rule: fewer words, or a larger share of words in repeated windows (per cent), fail
MIN_WORDS, MAX_REPEATED = 20, 30

#: frequent function words (fixed values)
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on", "not", "he",
           "by", "are", "this", "at", "from", "but", "have", "an", "they", "which", "or", "we", "his", "you", "had"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "dans", "pour", "pas",
           "sur", "par", "au", "aux", "ce", "il", "elle", "ne", "se", "sont", "avec", "plus", "on", "ou"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "ist", "des", "dem", "ein", "eine", "nicht", "mit",
           "auf", "für", "im", "sich", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "que", "en", "un", "una", "es", "por", "con", "para", "no", "se",
           "su", "al", "lo", "como", "más", "o", "pero", "sus", "le", "ha", "me", "si", "sin"],
}


class Rule(NamedTuple):
    """A measure must lie within [low, high]; None sets no bound."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: the threshold table
RULES = [
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("letters", "letter_word_ratio", 0.8, None),
    Rule("stop_words", "stop_word_ratio", 0.06, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
]


def _split(text: Column, pattern: str) -> Column:
    """Pieces of a text; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, pattern))


def _doubled(hashes: str, span: int) -> Column:
    """Hashes of windows twice as long, from those of windows of ``span``."""
    n = F.greatest(F.size(hashes) - span, F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + span)))


def _count(items: str, meets) -> Column:
    return F.size(F.filter(items, meets)).cast("long")


def measured(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, counts, ratios): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and the measures that rules can name. Ratios of a text
    without words (or lines) are 0."""
    stop = stop_words if stop_words is not None else sorted({w for ws in STOP_WORDS.values() for w in ws})
    stop = sorted({*stop, *(w.capitalize() for w in stop)})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", _split(F.btrim("text", F.lit(SPACE)), r"[ \t\n\x0B\f\r]+").alias("words"),
                       F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"))
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    span = 1
    while span < WINDOW:
        rows = rows.withColumn("h", _doubled("h", span))
        span *= 2
    rows = rows.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    rows = rows.withColumn("met", F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("at", F.sort_array(F.transform(
        F.filter("met", lambda e, k: same(e, F.get(F.col("met"), k - 1)) | same(e, F.get(F.col("met"), k + 1))), lambda e: e["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - x, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    line = lambda x: F.btrim(x, F.lit(SPACE))
    bare = lambda w: F.rtrim(w, F.lit(".,;:!?"))
    counts = F.struct(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count("words", lambda w: F.ltrim(w, F.lit(NO_LETTERS)) != "").alias("n_letter_words"),
        _count("words", lambda w: bare(w).isin(stop)).alias("n_stop_words"),
        _count("lines", lambda x: F.substring(line(x), 1, 1).isin("-", "*", "•", "·", "‣")).alias("n_bullet_lines"),
        _count("lines", lambda x: line(x).endswith("...") | line(x).endswith("…")).alias("n_ellipsis_lines"))
    # the generator is a barrier: a later filter on a count is not pushed into
    # the expressions above, where each step would be written out within the next
    counts = rows.select(F.explode(F.array(counts)).alias("c")).select("c.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counts.select(
        "*", ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_letter_words", "n_words").alias("letter_word_ratio"), ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"))


def compiled(rules: list[Rule]) -> Column:
    """Names of the rules that a row of ``measured`` breaks, as one expression."""
    broken = []
    for r in rules:
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (F.col(r.measure) < r.low)
        if r.high is not None:
            outside = outside | (F.col(r.measure) > r.high)
        broken.append(F.when(outside, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, stop_words: list[str] | None = None) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text): the
    columns of ``measured``, base_failed, broken (names of the broken rules)
    and kept (neither the base rule nor any other is broken).

    A null text counts as empty and fails the base rule, as does any text of
    fewer than ``MIN_WORDS`` words. Each row is judged by itself: repeated rows
    and ids, null ids and ties change nothing; other columns are not looked at;
    no rows, no result. A text is one row, whatever its length."""
    rows = measured(docs, stop_words)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.select("*", base.alias("base_failed"), compiled(rules).alias("broken"))
    return rows.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))
