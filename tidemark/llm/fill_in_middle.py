"""Fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, and put in another order.

A text is split into units by one zero-width regex: a border lies between two neighbouring
characters unless both belong to one run class of the grammar. Java's split keeps every character,
so the units joined are the text. All of it is one projection; no row meets another.

Cases. Null or empty text: no units, plain, empty output. A text that holds a sentinel: plain, since
it could not be told apart. Null doc_id: drawn as if its decimal text were empty. Equal rows get
equal output. Very long texts are cut whole. Empty table: no rows. Other columns stay; `text` is
replaced where the output goes by that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import let

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Grammar:
    """Units: maximal runs of each class in `runs` (a regex class), every other code point alone."""

    runs: tuple[str, ...] = ()

    def border(self) -> str:
        """Regex of the empty places between units.

        Neither end of the text is a border, nor the inside of a surrogate pair, nor a place
        between two members of one run class.
        """
        joined = "".join(f"(?!(?<={c}){c})" for c in self.runs)
        return rf"(?<=[\s\S])(?=[\s\S])(?![\uDC00-\uDFFF]){joined}"


CHARACTERS = Grammar()
LETTER_RUNS = Grammar(("[A-Za-z]",))
WORDS = Grammar((r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"))
LINES = Grammar((r"[^\n]",))


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text as an array; none for null or empty text, which split would give one."""
    return F.when(F.length(text) > 0, F.split(text, grammar.border(), -1)).otherwise(F.array().cast("array<string>"))


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Four numbers below 2^32: the first four groups of eight hex digits of one sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return let(digest, lambda h: F.array(*(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))))


def transform(docs: DataFrame, grammar: Grammar = LETTER_RUNS, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    Prefix and middle end after the smaller and the larger of two drawn unit counts. psm puts
    prefix, suffix, middle; spm puts suffix first.
    """
    text = F.coalesce("text", F.lit(""))
    drawn = docs.withColumns({"_u": units(text, grammar), "_h": draws(F.col("doc_id"), seed)})
    n = F.size("_u")
    cuts = drawn.withColumns({"_a": F.col("_h")[0] % (n + 1), "_b": F.col("_h")[1] % (n + 1)})
    low, high = F.least("_a", "_b").cast("int"), F.greatest("_a", "_b").cast("int")
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (n == 0) | held | (F.col("_h")[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm_percent, "spm").otherwise("psm")

    def part(first: Column, count: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_u", first, count), ""))

    cut = cuts.withColumn("form", form).withColumns({
        "n_units": n.cast("long"),
        "prefix": part(F.lit(1), low),
        "middle": part(low + 1, high - low),
        "suffix": part(high + 1, n - high),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return cut.withColumn("output", output).drop("_u", "_h", "_a", "_b")


def restore(output: Column, form: Column) -> Column:
    """The text that transform() turned into this output. A sentinel stands in it once each."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
