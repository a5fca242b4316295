"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import let, without_separators, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from had he in is it not of on or that the this to was with "
    "au ce de des du elle en est et il la le les on par pas pour que qui sur un une "
    "das dem den der des die ein eine ist mit nicht sich und von zu "
    "al como con del el es las lo los no para por se su un una y"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document fails if the measure is under least or over most (either may be None)."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


DEFAULT_RULES = (
    Threshold("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    Threshold("symbol_ratio", "n_symbols / n_words", None, 0.25),
    Threshold("stop_word_ratio", "n_stop_words / n_words", 0.05, None),
    Threshold("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Threshold("alpha_word_ratio", "n_alpha_words / n_words", 0.7, None),
)


def _covered(tokens: Column) -> Column:
    """Positions that lie in a 3-word window found twice or more.

    Windows are sorted as (hash, start), so equal ones are neighbours: n log n for any text
    length. Hashes have 64 bits; in a text of a million words two different windows agree with
    a chance below one in ten million.
    """
    starts = F.sequence(F.lit(0), F.size(tokens) - 3)
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def start(w: Column, k: Column) -> Column:
            twin = (F.get(s, k - 1)["h"] == w["h"]) | (F.get(s, k + 1)["h"] == w["h"])
            return F.when(F.coalesce(twin, F.lit(False)), w["i"])

        return F.array_sort(F.filter(F.transform(s, start), lambda x: x.isNotNull()))

    def cover(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(i + 2 - acc["end"], F.lit(3))).alias("n"), (i + 2).alias("end"))
        return F.aggregate(p, zero, step, lambda acc: acc["n"])

    return F.when(F.size(tokens) < 3, F.lit(0).cast("long")).otherwise(cover(let(windows, repeated)))


def verdict(text: Column, rules: tuple[Threshold, ...] = DEFAULT_RULES) -> Column:
    """One struct of the counts of a text, base_failed, failed_rules and kept.

    Every part is bound once, so the struct costs the same in a projection and in a filter.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without_separators(x)) > 0)
    trimmed = lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?"))

    def count(s: Column) -> Column:
        w, x = s["w"], s["l"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(without_separators(text)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _covered(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda v: trimmed(v).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda v: v.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        )

    def decide(c: Column) -> Column:
        base = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        failed = F.array_compact(F.array(*[F.when(_broken(c, r), F.lit(r.name)) for r in rules]))
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_alpha_words")
        return F.struct(*[c[n].alias(n) for n in names], base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))

    return let(let(F.struct(words(text).alias("w"), lines.alias("l")), count), decide)


def _broken(counts: Column, rule: Threshold) -> Column:
    over, under = (counts[x.strip()] for x in rule.measure.split("/"))
    ratio = F.try_divide(over, under)
    least = ratio < rule.least if rule.least is not None else F.lit(False)
    most = ratio > rule.most if rule.most is not None else F.lit(False)
    return least | most


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Threshold, ...] = DEFAULT_RULES) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept for every row of docs.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows.
    kept: not base_failed and within every threshold. Empty and null texts have no words and
    fail; a ratio over nothing breaks no rule. Rows that repeat are judged alike, a null doc_id
    stays null. Other columns of docs are not read, so their names can't clash. Empty table: no
    rows. One projection over the scan, without user functions or shuffle.
    """
    judged = docs.select(F.col("doc_id"), verdict(F.col(f"`{text_col}`"), rules).alias("_v"))
    return judged.select("doc_id", "_v.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Threshold, ...] = DEFAULT_RULES) -> DataFrame:
    """The rows of docs that judge() keeps, unchanged: a filter over the scan."""
    return docs.filter(verdict(F.col(f"`{text_col}`"), rules)["kept"])
