"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages, a choice of the rule table's.
STOP_WORDS = {
    "en": "the of and to in is that for a it with as was on are be this by an or from at not have".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
}
SPACE = "\\x20\\x09-\\x0D"


@dataclass(frozen=True)
class Rule:
    """A row of the table: ``low <= measure <= high`` over ``measure``; a null bound does not bind. Texts of fewer than ``at_least`` words are not held to it."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    at_least: int = 0

    def broken(self) -> Column:
        m, parts = F.col(self.measure), []
        if self.low is not None:
            parts.append(m < F.lit(self.low))
        if self.high is not None:
            parts.append(m > F.lit(self.high))
        return (F.col("n_words") >= self.at_least) & (parts[0] | parts[1] if len(parts) == 2 else parts[0])


#: The production table. Measures are ratios in exact double arithmetic over counts of the whole text.
RULES = (
    Rule("too_many_words", "n_words", high=1_000_000),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("stop_words", "stop_word_ratio", low=0.02, at_least=30),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("alphabetic_words", "alpha_word_ratio", low=0.5),
)
#: The base rules, in whole numbers.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words inside a window of ``window`` words that occurs twice or more in the text.

    Windows are told apart by 64-bit hashes. Only a text with an equal pair of windows is sorted:
    window hashes with their places, so that equal ones are neighbours, then the places in order,
    each adding what the one before it does not cover.
    """
    size = F.size(words)
    def covered(hashed: Column) -> Column:
        order = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(o: Column) -> Column:
            same = F.filter(o, lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        places = _let(order, twins)
        return _let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))), F.lit(0), lambda s, x: s + x))

    def hashes(h: Column) -> Column:  # from the words' own hashes, which are taken once
        return F.transform(F.sequence(F.lit(0), size - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    counted = _let(_let(F.transform(words, lambda x: F.xxhash64(x)), hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(size < window + 1, F.lit(0)).otherwise(counted).cast("long")


def _let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures that rules may name, one row per document row, in a narrow projection."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    id_name = d.columns[0]
    d = d.select(id_name, "_t", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"))
    w, ln = F.col("_w"), F.col("_l")
    stops = sorted({x for v in STOP_WORDS.values() for x in v})
    text = F.col("_t")
    return d.select(
        id_name,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(ln).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ln, lambda x: x.rlike(f"^[{SPACE}]*[-*•‣▪][{SPACE}]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(ln, lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).cast("long").alias("n_alpha_words"),
    )


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed, broken (names of the rules a document breaks, in table order) and kept.

    Null and empty texts have no words and fail the base rules; repeated rows each get their row; very long texts
    are measured whole; an empty table has no rows; columns other than the two named are not read.
    """
    m = measure(docs, id_col, text_col)
    m = m.select(
        "*",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_alpha_words"), F.col("n_words")).alias("alpha_word_ratio"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    broken = F.filter(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return m.select("*", broken.alias("broken")).select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))
