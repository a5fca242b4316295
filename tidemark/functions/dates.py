"""Dates and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "Asia/Taipei"


def to_day(value: Column) -> Column:
    """The first ten characters as a day; what is no day is null."""
    return F.to_date(F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")))


def resolve_d0(ts: Column, zone: str = ZONE) -> Column:
    """The day an event counts for: from 13:30 local time on it is the next calendar day."""
    local = F.from_utc_timestamp(ts, zone)
    late = F.hour(local) * 60 + F.minute(local) >= 810
    return F.when(late, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))


def calendar_bound(now: Column, zone: str = ZONE) -> Column:
    """Yesterday before 16:00 local time, else today; weekends roll back to Friday."""
    local = F.from_utc_timestamp(now, zone)
    day = F.date_sub(F.to_date(local), F.when(F.hour(local) < 16, 1).otherwise(0))
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def roc_date(text: Column) -> Column:
    """YYYMMDD, years from 1912, seven digits; else null."""
    y, m, d = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 3), (4, 2), (6, 2)))
    padded = F.format_string("%04d-%02d-%02d", y + 1911, m, d)
    return F.when(text.rlike("^[0-9]{7}$"), F.to_date(F.try_to_timestamp(padded, F.lit("yyyy-MM-dd"))))


def classify(text: Column) -> Column:
    """struct(kind, has_tz) of a date text, by the first form that fits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    zone = t.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    iso = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}")
    kind = (
        F.when(t == "", "missing")
        .when(t.rlike(r"^[0-9]{13}$"), "epoch_millis")
        .when(t.rlike(r"^[0-9]{10}$"), "epoch_seconds")
        .when(iso & zone, "iso8601_tz")
        .when(iso, "iso8601_naive")
        .when(t.rlike(r"^[0-9]{2,3}[/年.-][0-9]{1,2}[/月.-][0-9]{1,2}"), "roc_year")
        .when(t.rlike(r"^[A-Z][a-z]{2}, [0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}"), "rfc822")
        .when(t.rlike(r"前|昨天|剛剛|ago"), "relative")
        .when(t.rlike(r"^[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}$"), "date_only")
        .otherwise("unknown")
    )
    has_tz = kind.isin("epoch_millis", "epoch_seconds", "iso8601_tz", "rfc822")
    return F.struct(kind.alias("kind"), has_tz.alias("has_tz"))


def parse(text: Column, now: Column) -> Column:
    """A timestamp from the forms that feeds use; naive ones are local (+08:00).

    Relative forms (minutes, hours or days ago, yesterday, just now) count from now.
    """
    t = F.trim(text)
    n = F.regexp_extract(t, r"([0-9]+)", 1).try_cast("int")
    local = lambda c: F.to_utc_timestamp(c, ZONE)
    mail = F.regexp_replace(t, r"^[A-Z][a-z]{2}, ", "")
    forms = [F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))]
    naive = [local(F.try_to_timestamp(t, F.lit(f))) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")]
    ago = (
        F.when(t.contains("剛剛"), now)
        .when(t.contains("分鐘前"), F.timestamp_seconds(F.unix_timestamp(now) - n * 60))
        .when(t.contains("小時前"), F.timestamp_seconds(F.unix_timestamp(now) - n * 3600))
        .when(t.contains("天前"), F.timestamp_seconds(F.unix_timestamp(now) - n * 86400))
        .when(t.contains("昨天"), F.timestamp_seconds(F.unix_timestamp(now) - 86400))
    )
    epoch = F.when(t.rlike(r"^[0-9]{13}$"), F.timestamp_seconds(t.try_cast("long") / 1000)).when(t.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(t.try_cast("long")))
    return F.coalesce(epoch, *forms, *naive, ago)


def age(seconds: Column) -> Column:
    """An age in the largest unit that it fills."""
    whole = lambda by: F.floor(seconds / by).cast("string")
    return F.when(seconds < 60, F.concat(whole(1), F.lit(" 秒"))).when(seconds < 3600, F.concat(whole(60), F.lit(" 分"))).when(seconds < 86400, F.concat(whole(3600), F.lit(" 小時"))).otherwise(F.concat(whole(86400), F.lit(" 天")))


def guarded_event_time(event: Column, first_article: Column, days: int = 60) -> Column:
    """Event seconds, unless they lie over `days` before the first article: then the article's."""
    return F.when(event < first_article - days * 86400, first_article).otherwise(event)


def month_day(at: Column) -> Column:
    return F.date_format(at, "MM/dd")


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)


def request_windows(since: Column, until: Column) -> Column:
    """An array of (first, end) seconds, one for each local day from since to until."""
    first = lambda d: F.unix_date(d).cast("long") * 86400 - 8 * 3600
    return F.transform(F.sequence(since, until), lambda d: F.struct(first(d).alias("first"), (first(d) + 86400).alias("end")))


def years_of(rows: DataFrame, list_col: str, order: str, month: str, year: int) -> DataFrame:
    """rows with `year`: a list that goes back in time without naming years, which begins in
    `year` and is a year further back wherever the month gets larger."""
    w = Window.partitionBy(list_col).orderBy(order)
    larger = F.coalesce((F.col(month) > F.lag(month).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_larger", larger).withColumn("year", (year - F.sum("_larger").over(w)).cast("int")).drop("_larger")
