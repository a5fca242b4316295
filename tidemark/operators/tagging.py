"""Company tags: codes and names in titles, a stop-list of names that say little, guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.runtime import materialize

MAX_NAMES = 100_000  # of the dictionary that workers hold

# What a financial holding's subsidiaries add to its stem.
SUBSIDIARIES = ("金", "銀", "證", "投信", "人壽", "產險")
CODE = r"[(（]([0-9]{4,6})[)）]"


def dictionary(tickers: DataFrame, stop: list[str] = ()) -> dict[str, str]:
    """Name to code of names that one ticker alone has and that are not on the stop-list."""
    names = tickers.filter(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ticker").alias("ticker")).filter("n = 1")
    if stop:
        names = names.filter(~F.col("name").isin(*stop))
    return _held(names)


def _held(names: DataFrame) -> dict[str, str]:
    """Names and codes as each worker holds them: MAX_NAMES at most."""
    rows = names.select("name", "ticker").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"over {MAX_NAMES} names")
    return {r["name"]: r["ticker"] for r in rows}


def found_names(text: str, automaton, order: dict[str, int]) -> list[str]:
    """Names in text, longer ones first: a name only counts where no longer one covers it."""
    hits = sorted((-len(name), order[name], end - len(name) + 1, name) for end, name in automaton.iter(text))
    taken = bytearray(len(text))
    out = []
    for size, _, start, name in hits:
        if not any(taken[start : start - size]):
            taken[start : start - size] = b"\1" * -size
            out.append(name)
    return list(dict.fromkeys(out))


def _tagger(names: dict[str, str], codes: bool):
    """Titles to the names in them, or to the codes of those names."""

    @F.pandas_udf(ArrayType(StringType()))
    def tag(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        order = {n: i for i, n in enumerate(sorted(names))}
        for n in names:
            automaton.add_word(n, n)
        if names:
            automaton.make_automaton()
        for part in texts:
            yield part.map(lambda t: [names[n] if codes else n for n in found_names(t, automaton, order)] if names and t else [])

    return tag


def tag(articles: DataFrame, tickers: DataFrame, stop: list[str] = (), title: str = "title") -> DataFrame:
    """articles with related_tickers: bracketed codes that exist, and names, sorted, once each."""
    named = _tagger(dictionary(tickers, list(stop)), True)(F.col(title))
    rows = articles.withColumn("_at", F.monotonically_increasing_id()).withColumn("_named", named)
    rows = materialize(rows.withColumn("_said", F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(CODE), F.lit(1))), "tagged")
    said = rows.filter(F.size("_said") > 0).select("_at", F.explode(F.array_distinct("_said")).alias("ticker"))
    known = said.join(tickers.select("ticker").distinct(), "ticker", "left_semi").groupBy("_at").agg(F.collect_list("ticker").alias("_known"))
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct(F.concat(F.coalesce("_known", none), "_named")))
    return rows.join(known, "_at", "left").withColumn("related_tickers", found).drop("_at", "_named", "_said", "_known")


def stop_list(articles: DataFrame, tickers: DataFrame, fires: int = 30, rate: float = 0.02) -> DataFrame:
    """(name, ticker, fires, cooccur_rate) of names that often appear without their code. Over
    MAX_NAMES names raise."""
    names = tickers.filter("name is not null and name <> ''").groupBy("name").agg(F.min("ticker").alias("ticker"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    plain = _held(names)
    hits = articles.select(text.alias("t")).select("t", F.explode(_tagger(plain, False)(F.col("t"))).alias("name")).join(F.broadcast(names), "name")
    agg = hits.groupBy("name", "ticker").agg(F.count(F.lit(1)).alias("fires"), F.avg(F.contains("t", F.col("ticker")).cast("int")).alias("r"))
    return agg.filter((F.col("fires") >= fires) & (F.col("r") < rate)).select("name", "ticker", "fires", F.round("r", 4).alias("cooccur_rate"))


def mentioned(ticker: Column, name: Column, corpus: Column) -> Column:
    """Whether the corpus has the code, the name, or a subsidiary of a holding's stem."""
    stem = F.substr(name, F.lit(1), F.length(name) - 1)
    alias = F.lit(False)
    for s in SUBSIDIARIES:
        alias = alias | F.contains(corpus, F.concat(stem, F.lit(s)))
    return F.contains(corpus, ticker) | F.coalesce((name != "") & F.contains(corpus, name), F.lit(False)) | F.coalesce(F.endswith(name, F.lit("金")) & alias, F.lit(False))


def verified(entities: DataFrame, tickers: DataFrame, corpora: DataFrame) -> DataFrame:
    """event_id with the tickers that its articles mention, in order; foreign-looking codes go.

    corpora: event_id, corpus.
    """
    placed = entities.select("event_id", F.posexplode(F.array_distinct("tickers")).alias("pos", "ticker"))
    placed = placed.filter(~F.contains("ticker", F.lit(".")) & ~F.col("ticker").rlike("^[0-9]{5,}$"))
    joined = placed.join(F.broadcast(tickers.select("ticker", "name")), "ticker", "left").join(corpora, "event_id")
    kept = joined.filter(mentioned(F.col("ticker"), F.col("name"), F.col("corpus"))).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ticker"))).alias("k"))
    return entities.select("event_id").join(kept, "event_id", "left").select("event_id", F.coalesce(F.transform("k", lambda x: x["ticker"]), F.array().cast("array<string>")).alias("tickers"))
