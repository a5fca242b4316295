"""Line dedup by a log-template tree: recurring templates across documents are dropped."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SEPARATORS, let
from tidemark.runtime import broadcast_if_small, materialize

# Words with a digit are variable fields wherever they stand: numbers, dates, ids, addresses.
VARIABLE = "<*>"
FIELD = "<>"  # a variable field of a generalised template
SEGMENTS = 5
_WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(SEPARATORS)) != ""


def lines_of(docs: DataFrame, text: Column, depth: int) -> DataFrame:
    """One row a line with a word: the columns of docs, pos, n, path, full and m, the words of the
    line joined by one space, with variable fields masked. path is the tree's leaf, by token count
    n and `depth` leading tokens, full the whole masked line; both hashes have 64 bits.

    Each step looks for what it replaces first, as most lines hold no such thing.
    """
    rows = docs.select("*", F.posexplode(F.split(text, "\n")).alias("pos", "_line")).filter(_has_words(F.col("_line")))
    rows = rows.withColumn("_line", F.btrim("_line", F.lit(SEPARATORS)))
    others = [F.contains("_line", F.lit(c)) for c in SEPARATORS.strip(" \n")]
    blank = others[0]
    for more in others[1:]:
        blank |= more
    rows = rows.withColumn("_line", F.when(blank, F.translate("_line", SEPARATORS, " " * len(SEPARATORS))).otherwise(F.col("_line")))
    rows = rows.withColumn("_line", F.when(F.contains("_line", F.lit("  ")), F.regexp_replace("_line", " +", " ")).otherwise(F.col("_line")))
    rows = rows.withColumn("m", F.when(F.col("_line").rlike("[0-9]"), F.regexp_replace("_line", _WITH_DIGIT, VARIABLE)).otherwise(F.col("_line"))).drop("_line")
    rows = rows.withColumn("n", (F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1).cast("int"))
    return rows.withColumn("path", F.xxhash64("n", F.substring_index("m", " ", depth))).withColumn("full", F.xxhash64("m"))


def parsed(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """Lines of docs as (row, doc_id, pos, n, path, full), written once for all steps. row is a
    hash of doc_id and text; rows that repeat as a whole are one document."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.xxhash64("doc_id", text).alias("row"), F.col("doc_id"), text.alias("_text"))
    return materialize(lines_of(rows, F.col("_text"), depth).select("row", "doc_id", "pos", "n", "path", "full"), "lines")


def masked_templates(words: Column, depth: int) -> Column:
    """Hashes of the templates that a line may belong to: what stands behind its leading tokens is
    cut into SEGMENTS runs, and the tokens of one or two of them become variable fields, in every
    way that leaves three fifths of these tokens. So lines with variable fields in any two of the
    runs share a template, and a line has fifteen of them at most."""

    def key(w: Column, t: Column, a: int, b: int) -> Column:
        edge = lambda g: F.floor(g * t / SEGMENTS)
        inside = lambda i, g: (i - depth >= edge(g)) & (i - depth < edge(g + 1))
        size = edge(a + 1) - edge(a) + (edge(b + 1) - edge(b) if a != b else 0)
        line = F.transform(w, lambda x, i: F.when(inside(i, a) | inside(i, b), F.lit(FIELD)).otherwise(x))
        return F.when((size > 0) & (SEGMENTS * size <= 2 * t), F.xxhash64(line))

    def keys(w: Column, t: Column) -> Column:
        each = [key(w, t, a, b) for a, b in combinations_with_replacement(range(SEGMENTS), 2)]
        return F.array_distinct(F.filter(F.array(*each), lambda x: x.isNotNull()))

    return let(words, lambda w: let(F.size(w) - depth, lambda t: keys(w, t)))


def _variants(docs: DataFrame, lines: DataFrame, counted: DataFrame, text_col: str, depth: int, min_docs: int) -> DataFrame:
    """Lines of generalised templates that recur, as (path, full, first), over counted(.., recurs).

    A template recurs if min_docs documents have lines of it and one of the lines is rare; lines
    that recur verbatim count as well. Documents with several lines in a leaf count once a
    template: they are counted apart from the rest. Behind the leading tokens of a line of
    depth + 2 tokens or fewer too little stands for a field to vary, so those only recur verbatim.
    Every line gives its own templates, however many share its leaf, so work grows with lines.
    """
    leaves = counted.filter(F.col("n") > depth + 2).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum("docs").alias("docs"), F.count_if(~F.col("recurs")).alias("rare"))
    leaves = leaves.filter((F.col("lines") > 1) & (F.col("docs") >= min_docs) & (F.col("rare") > 0)).select("path")
    member = lines.join(broadcast_if_small(materialize(leaves, "voting-leaves")), "path").select("path", "full", "row", "doc_id").distinct()
    member = materialize(member, "voting-lines")
    several = member.groupBy("path", "row").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("path", "row")
    several = materialize(member.join(broadcast_if_small(materialize(several, "several")), ["path", "row"]).select("path", "full", "row").distinct(), "several-lines")
    shared = several.groupBy("path", "full").agg(F.count(F.lit(1)).alias("shared"))
    voters = member.groupBy("path", "full").agg(F.countDistinct("row").alias("docs"), F.min("row").alias("row"), F.min("doc_id").alias("first"))
    voters = voters.join(shared, ["path", "full"], "left").join(counted.select("path", "full", "recurs"), ["path", "full"])
    voters = materialize(voters.select("path", "full", "row", "first", "recurs", (F.col("docs") - F.coalesce("shared", F.lit(0))).alias("single")), "voters")

    text = F.col(f"`{text_col}`")
    where = broadcast_if_small(materialize(voters.select(F.col("row").alias("_row")).distinct(), "voter-rows"))
    again = docs.select(F.xxhash64("doc_id", text).alias("row"), text.alias("_text")).join(where, F.col("row") == F.col("_row"), "left_semi")
    words = lines_of(again, F.col("_text"), depth).select("row", "path", "full", "m").distinct()
    keyed = words.join(voters, ["path", "full", "row"]).select("path", "full", "single", "first", "recurs", F.explode(masked_templates(F.split("m", " "), depth)).alias("template"))
    keyed = materialize(keyed, "line-templates")

    alone = keyed.groupBy("path", "template").agg(F.sum("single").alias("docs"), F.min("first").alias("first"), F.bool_and("recurs").alias("verbatim"))
    more = keyed.select("path", "full", "template").join(several, ["path", "full"]).select("path", "template", "row").distinct()
    more = more.groupBy("path", "template").agg(F.count(F.lit(1)).alias("more"))
    found = alone.join(more, ["path", "template"], "left").filter((F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs) & ~F.col("verbatim"))
    return keyed.drop("first").join(found.select("path", "template", "first"), ["path", "template"]).select("path", "full", "first")


def templates(docs: DataFrame, lines: DataFrame, text_col: str = "text", depth: int = 4, min_docs: int = 3, long_tokens: int = 50) -> DataFrame:
    """Recurring templates as (path, full, first): whole masked lines, and generalised ones.

    The tree's first level is the token count, then come `depth` leading tokens; a line's path
    leads to a leaf. A masked line that min_docs documents share is a template as it stands, one
    of more than long_tokens tokens as soon as two do. In a leaf where other lines meet too,
    runs of tokens in which they differ become variable fields: see _variants. Only documents with lines
    in such leaves are parsed again, for the words.
    """
    once = lines.select("path", "full", "n", "row", "doc_id").distinct()
    counted = once.groupBy("path", "full", "n").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
    recurs = (F.col("docs") >= min_docs) | ((F.col("n") > long_tokens) & (F.col("docs") >= 2))
    counted = materialize(counted.withColumn("recurs", recurs), "line-counts")
    whole = counted.filter("recurs").select("path", "full", "first")
    found = whole.unionByName(_variants(docs, lines, counted, text_col, depth, min_docs))
    return broadcast_if_small(materialize(found.groupBy("path", "full").agg(F.min("first").alias("first")), "templates"))


def dedup(docs: DataFrame, text_col: str = "text", depth: int = 4, min_docs: int = 3, long_tokens: int = 50) -> DataFrame:
    """docs with the text of each row cleared of recurring lines, and n_lines, n_dropped.

    A line goes if its template recurs (see templates) and this is not the template's first
    document, the one with the smallest doc_id: so one document keeps a passage that many
    share, and the rest lose it. Lines without words stay. Null text stays null with no lines.
    A row whose lines all go keeps an empty text. Rows that repeat as a whole fare alike; rows
    with a null doc_id are documents that are never first unless all are. Columns of docs that
    are named n_lines or n_dropped are replaced. Empty table: no rows.

    Decisions are (row hash, line number) pairs, which meet the rows of docs in one join, where
    every text is shuffled once; work on a text grows with its lines, not their square. A hot
    line is spread by its documents before they are counted, and Spark may split it in the join
    with the templates, as those are unique there.
    """
    docs = docs.drop("n_lines", "n_dropped")
    columns = docs.columns
    text = F.col(f"`{text_col}`")
    lines = parsed(docs, text_col, depth)
    found = templates(docs, lines, text_col, depth, min_docs, long_tokens)
    hit = lines.join(found, ["path", "full"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    drops = hit.groupBy("row", F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("_drop"))
    joined = docs.withColumn("_row", F.xxhash64("doc_id", text)).join(drops.withColumnRenamed("row", "_key"), (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    gone = F.col("_drop")
    kept = let(F.split(text, "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _has_words)).cast("long")
    new = {c: F.col(f"`{c}`") for c in columns} | {text_col: F.when(gone.isNull(), text).otherwise(kept)}
    n_dropped = F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")
    return joined.select(*[v.alias(c) for c, v in new.items()], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
