"""Checks of generated event fields: the output contract, and cases of past mistakes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

# What the contract allows.
STATUSES = ("official_confirmed", "rumor_unconfirmed", "developing", "market_reacting")
DIRECTIONS = ("利多", "利空", "中性")
CONFIDENCES = ("high", "low")
TEXTS = ("title", "summary", "occurred_at_text", "confidence_note")
ZONE = "+08:00"


def instant(stamp: Column) -> Column:
    """The seconds of an ISO time; one without a zone is local. Null: no such time."""
    zoned = stamp.rlike(r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & stamp.rlike("[T ]")
    day = stamp.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    full = F.when(zoned, stamp).when(day, F.concat(stamp, F.lit("T00:00:00" + ZONE))).when(stamp.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.concat(stamp, F.lit(ZONE)))
    return F.unix_timestamp(F.try_to_timestamp(full))


def output_problems(categories: Sequence[str], industries: Sequence[str], now: int, statuses: Sequence[str] = STATUSES) -> Column:
    """An array of 'field: fault' over the columns of a generated event; empty: it passes.

    A missing field is a null one, but for occurred_at_iso, which may be null. If any field is
    missing, only that is said. Times over a day after now (seconds) are the future.
    """
    one = lambda bad, message: F.when(bad, F.lit(message))
    enums = {"status": statuses, "expected_direction": DIRECTIONS, "direction_confidence": CONFIDENCES}
    lists = {"categories": categories, "industries": industries}
    missing = [one(F.col(c).isNull(), f"{c}: missing") for c in (*TEXTS, *enums, *lists, "related_tickers")]
    faults = [one(text.strip(F.col(c)) == "", f"{c}: empty") for c in TEXTS]
    faults += [one(~F.col(c).isin(*allowed), f"{c}: illegal") for c, allowed in enums.items()]
    faults.append(one(F.size("categories") == 0, "categories: empty"))
    for c, allowed in lists.items():
        faults.append(one(F.size(F.array_except(c, F.array(*map(F.lit, allowed)))) > 0, f"{c}: illegal"))
        faults.append(one(F.size(F.array_distinct(c)) < F.size(c), f"{c}: repeated"))
    at = instant(F.col("occurred_at_iso"))
    faults.append(one(F.col("occurred_at_iso").isNotNull() & at.isNull(), "occurred_at_iso: unreadable"))
    faults.append(one(at > now + 86400, "occurred_at_iso: future"))
    faults.append(one(F.exists("related_tickers", lambda t: ~F.coalesce(t.rlike("^[0-9]{4}"), F.lit(False))), "related_tickers: illegal"))
    said = lambda x: F.filter(F.array(*x), lambda m: m.isNotNull())
    return F.when(F.size(said(missing)) > 0, said(missing)).otherwise(said(faults))


def regression_checks(cases: DataFrame) -> DataFrame:
    """(case_id, key, passed) for every expectation that a case has.

    cases: case_id, occurred_at_iso, published (array of ISO times), related_tickers, status,
    expected_direction, and what is expected: within_published (boolean), tickers_allowed,
    status_not, direction_is; a null one is not checked. A time may be null, else its local day
    is at most one after the last publication's; tickers may be any of the allowed, none too.
    """
    day = lambda c: F.to_date(F.timestamp_seconds(instant(c) + 8 * 3600))
    deadline = F.date_add(F.array_max(F.transform("published", day)), 1)
    checks = {
        "occurred_at_within_published": (F.col("within_published"), F.col("occurred_at_iso").isNull() | (day(F.col("occurred_at_iso")) <= deadline)),
        "related_tickers_allowed": (F.col("tickers_allowed").isNotNull(), F.size(F.array_except("related_tickers", "tickers_allowed")) == 0),
        "status_not": (F.col("status_not").isNotNull(), ~F.col("status").eqNullSafe(F.col("status_not"))),
        "expected_direction": (F.col("direction_is").isNotNull(), F.col("expected_direction").eqNullSafe(F.col("direction_is"))),
    }
    rows = F.array(*[F.when(F.coalesce(has, F.lit(False)), F.struct(F.lit(k).alias("key"), F.coalesce(ok, F.lit(False)).alias("passed"))) for k, (has, ok) in checks.items()])
    return cases.select("case_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("c")).select("case_id", "c.key", "c.passed")


# The extended forms of ISO 8601 that carry a day, a day and a time, or those and an offset.
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"


def item_fault(title: Column, url: Column, content: Column, published_at: Column, least: int = 200, distinct: float = 0.55) -> Column:
    """The first thing wrong with a scraped item; null where nothing is.

    In this order: fields that are null or empty, by name; a time that is no ISO day or time of
    the calendar; one without an offset; content of under `least` characters once white space is
    single; content that begins with its title and says it again; content whose eight-word windows
    are different in under `distinct` of the cases.
    """
    fields = {"title": title, "url": url, "content": content, "published_at": published_at}
    missing = F.filter(F.array(*(F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"'{k}'")) for k, c in fields.items())), lambda x: x.isNotNull())
    day = F.try_to_timestamp(F.substring(published_at, 1, 10), F.lit("yyyy-MM-dd"))
    valid = F.coalesce(published_at.rlike(_ISO) & day.isNotNull(), F.lit(False))
    zoned = (F.length(published_at) > 10) & published_at.rlike("(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    body, head = tidy(content), F.lower(tidy(title))
    again = (head != "") & F.startswith(F.lower(body), head) & F.contains(F.substr(F.lower(body), F.length(head) + 1), head)
    share = text.distinct_share(content)
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_fields:["), F.array_join(missing, ", "), F.lit("]")))
        .when(~valid, "published_at_invalid")
        .when(~zoned, "published_at_missing_timezone")
        .when(F.length(body) < least, F.concat(F.lit("content_too_short:"), F.length(body).cast("string")))
        .when(again, "content_repeats_title")
        .when(share < distinct, F.concat(F.lit("content_duplicate_ratio:"), F.format_string("%.3f", share)))
    )
