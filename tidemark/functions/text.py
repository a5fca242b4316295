"""Text rules as column expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Titles of columns that appear by schedule. The first list overrules the list of
# true events, the second does not.
COLUMNS_ALWAYS = (
    ("海外/商品行情欄", r"^《(歐股|美股|美債|油價|農產品|台股盤後|日股|日股早盤|貴金屬|金屬|貴金屬/金屬|日韓股|韓股|港股|台股|匯市|債市|強勢美股特報|美股主題週報)》"),
    ("台股盤勢", r"〈台股風向球〉"),
    ("每周回顧", r"本周大事回顧|本週大事回顧"),
    ("匯市日報", r"〈台幣〉"),
    ("選股/薦股", r"【量大強漲股整理】"),
    (
        "盤勢評論",
        r"資金輪動|籌碼換手|資金卡位|資金集中|主流股|拉積盤|接盤俠|該追還是該收|該收手還是換手|後市怎麼看|存活指南|耐震名單|名單曝光"
        r"|(台股|大盤)[^，。！？]{0,20}(爆量|天量|巨量|量縮|洗盤|換手|創高|新高|震盪|千點|漲點|翻黑|翻多|重挫|噴漲|大反攻|失守|守住|背離|乖離|補跌|急殺|熔斷|上影線|連[0-9一二三四五六七]紅)",
    ),
)
EVENTS = r"法說|財報|法人說明會|理監事會|併購|收購|入股|處分|重訊|停牌|下市|上市掛牌|IPO|除權息|減資|增資|私募|違約交割|股東會"
COLUMNS = (
    ("營收速報", r"營收速報|營收快報"),
    ("熱門股/焦點股", r"〈熱門股〉|〈焦點股〉"),
    ("台股盤勢", r"〈台股(盤後|盤中|開盤|收盤|風向球)〉|台股(盤後|盤中|開盤|收盤)|(台股|大盤|加權|千點|萬點|指數)[^，。！？]{0,12}(早盤|尾盤|盤前)|(早盤|尾盤|盤前)[^，。！？]{0,12}(台股|大盤|加權|千點|萬點|指數)"),
    ("選股/薦股", r"選股策略|強漲股|飆股|布局策略|操作策略|存股"),
    ("航運指數", r"〈航運指數〉|SCFI|BDI|運價指數"),
    ("籌碼日報", r"三大法人|外資買賣超|投信買賣超|融資融券|(外資|投信|自營商)[^，。！？]{0,12}(買超|賣超|調節|甩賣|回補|提款|敲進|倒貨|加碼|大買|大砍|小買)|(買超|賣超)[^，。！？]{0,8}(億元|萬張)"),
    ("大盤指數", r"〈美股〉|道瓊|那斯達克|標普|費半|收黑|收紅|四大指數"),
)
DATA_DRIVEN = "資料驅動模板"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: a name inside a lambda would be computed for
    every element."""
    return F.transform(F.array(value), body)[0]


# White space in Python's sense, which Unicode's own leaves four control characters out of.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NO_SPACE = SPACE.replace("[", "[^", 1)


def strip(text: Column) -> Column:
    """text without white space at its ends, that of other scripts included."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space of any script to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """text with HTML's character references replaced. Only texts with an ampersand go to Python."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def clean_html(text: Column) -> Column:
    """Character references once, tags to blanks, white space collapsed; null: empty."""
    return collapse(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), r"<[^>]+>", " "))


def clean_html_legacy(text: Column) -> Column:
    """Tags removed, character references once, ends trimmed."""
    return strip(unescape(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")))


def clean_html_twice(text: Column) -> Column:
    return clean_html(unescape(F.coalesce(text, F.lit(""))))


def article_id(prefix: Column, identity: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.substring(F.sha2(strip(identity), 256), 1, 16))


def event_id(day: Column, tickers: Column, member_ids: Column) -> Column:
    digits = F.coalesce(F.regexp_replace(day.cast("string"), "-", ""), F.lit("00000000"))
    first = F.coalesce(F.get(tickers, F.lit(0)), F.lit("NA"))
    return F.concat(F.lit("evt_"), digits, F.lit("_"), first, F.lit("_"), F.substring(F.sha1(F.array_join(F.array_sort(member_ids), "")), 1, 8))


def composite_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def pick(identity: Column, n: Column) -> Column:
    """The 160-bit SHA-1 of identity modulo n, digit by digit."""
    digits = F.transform(F.filter(F.split(F.sha1(identity), ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % n)


# What a title's template leaves out, and what a number, a code in brackets, a year
# in brackets and an amount look like.
CODE_IN_TITLE, NUMBER, DATE_MARKS = r"\([0-9]{3,6}[-A-Za-z]*\)", r"[0-9]+[.,]?[0-9]*", "[年月日]"
YEAR_IN_BRACKETS = r"[今去前明後隔]\s*\([0-9]{3,4}\)\s*年"
CODE_IN_BRACKETS = r"\(([0-9]{3,6})(-[A-Za-z]{1,4})?\)"
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|％|億元|億|萬張|萬|張|點|倍|美元|元))"


def title_template(title: Column) -> Column:
    t = F.regexp_replace(title, CODE_IN_TITLE, "")
    t = F.regexp_replace(t, NUMBER, "#")
    return collapse(F.regexp_replace(t, DATE_MARKS, ""))


def periodic_type(title: Column) -> Column:
    """The name of the scheduled column that a title belongs to; null for other titles."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(COLUMNS):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    out = F.when(title.rlike(EVENTS), F.lit(None)).otherwise(out)
    for name, pattern in reversed(COLUMNS_ALWAYS):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def bracketed_tickers(text: Column) -> Column:
    """Codes in brackets in order, once each; a bare code that looks like a year needs a twin
    with a market suffix in the same text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), YEAR_IN_BRACKETS, " ")
    codes, suffixes = (F.regexp_extract_all(t, F.lit(CODE_IN_BRACKETS), F.lit(k)) for k in (1, 2))
    hits = F.arrays_zip(codes.alias("c"), suffixes.alias("s"))

    def fine(h: Column) -> Column:
        known = F.transform(F.filter(h, lambda x: x["s"] != ""), lambda x: x["c"])
        kept = F.filter(h, lambda x: (x["s"] != "") | ~x["c"].rlike(r"^(19|20)[0-9]{2}$") | F.array_contains(known, x["c"]))
        return F.array_distinct(F.transform(kept, lambda x: x["c"]))

    return let(hits, fine)


def money_details(text: Column) -> Column:
    """Numbers with a financial unit, blanks removed, once each."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def embed_text(title: Column, content: Column, n: int = 500) -> Column:
    """A title and the beginning of its text, as one document to embed."""
    return F.concat(strip(title), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, n))


def feature_text(title: Column, content: Column, n: int = 50) -> Column:
    """A title and the beginning of its text, white space collapsed in both, as a classifier reads them."""
    # the rest is not read: what is taken holds more than n characters other than white space, or all
    begins = F.regexp_extract(F.coalesce(content, F.lit("")), f"^{SPACE}*+(?:{NO_SPACE}{SPACE}*+){{0,{n + 1}}}", 0)
    lead = F.substring(collapse(begins), 1, n)
    return strip(F.concat(collapse(F.coalesce(title, F.lit(""))), F.lit("\n"), lead))


def form_encoded(text: Column) -> Column:
    """text as a form's parameter: letters, digits and _.-~ stay, a blank is a plus sign."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, keep: Sequence[str] = ()) -> Column:
    """Scheme and host lower-cased, user and default port gone, no slash at the path's end, no
    fragment; of the query only the parameters named in keep, decoded, their names lower-cased,
    sorted and encoded again. Text without a host keeps its form but for these rules; an address
    with an impossible port comes back stripped."""

    def parts(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        rest = F.when(scheme != "", F.regexp_replace(u, r"^[^:]*:", "")).otherwise(u)
        place = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
        host_port = F.regexp_replace(place, r"^.*@", "")
        return F.struct(
            u.alias("u"),
            scheme.alias("scheme"),
            F.lower(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
            F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1).alias("port"),
            F.startswith(rest, F.lit("//")).alias("placed"),
            F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1), "/+$", "").alias("path"),
            F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        )

    def kept(query: Column) -> Column:
        decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
        pair = lambda x: F.struct(F.lower(decoded(F.regexp_extract(x, "^([^=]*)", 1))).alias("k"), decoded(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v"))
        wanted = F.filter(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair), lambda x: x["k"].isin(*[k.lower() for k in keep]))
        return F.array_join(F.transform(F.array_sort(wanted), lambda x: F.concat(form_encoded(x["k"]), F.lit("="), form_encoded(x["v"]))), "&")

    def written(p: Column) -> Column:
        port = F.regexp_replace(p["port"], "^0+(?=[0-9])", "")
        plain = (port == "") | (port == "0") | ((p["scheme"] == "http") & (port == "80")) | ((p["scheme"] == "https") & (port == "443"))
        place = F.concat(p["host"], F.when(plain, "").otherwise(F.concat(F.lit(":"), port)))
        query = kept(p["query"]) if keep else F.lit("")
        head = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""), F.when(place != "", F.concat(F.lit("//"), place)).otherwise(""))
        path = F.when((place != "") & (p["path"] != "") & ~F.startswith(p["path"], F.lit("/")), F.concat(F.lit("/"), p["path"])).otherwise(p["path"])
        full = F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        wrong = (p["port"] != "") & ~(p["port"].rlike("^[0-9]+$") & (F.try_to_number(F.substring(port, 1, 9), F.lit("999999999")) <= 65535) & (F.length(port) <= 5))
        return F.when(wrong, p["u"]).otherwise(full)

    return let(let(F.translate(strip(url), "\t\r\n", ""), parts), written)


def host_allowed(host: Column, domains: Sequence[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return out


def distinct_share(text: Column, n: int = 8, least: int = 24) -> Column:
    """Different n-word windows over all of them; 1 for texts of under `least` words."""
    def share(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
        return F.when(F.size(words) < least, 1.0).otherwise(let(windows, lambda w: F.size(F.array_distinct(w)) / F.size(w)))

    return let(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""), share)


def signed(x: Column, digits: int = 1) -> Column:
    """x with its sign and so many digits, rounded by the double's exact value as C and Python do:
    Java rounds its shortest decimal form, so that 0.15, a little less than it says, would become 0.2."""

    @F.pandas_udf(StringType())
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:+.{digits}f}")

    # a null and a NaN are one thing to pandas
    kept = x.cast("double")
    return F.when(F.isnan(kept), F.lit("+nan")).when(kept.isNotNull(), shown(kept))


def floored(x: Column) -> Column:
    """The next whole number down as a double, as C has it: Spark's floor is a long, which has no
    negative zero, no infinity and no NaN."""
    return F.when((F.abs(x) < 2.0**53) & (x != F.floor(x)), F.floor(x).cast("double")).otherwise(x.cast("double"))


def signed_percent(x: Column, digits: int = 1) -> Column:
    return F.concat(signed(x * 100, digits), F.lit("%"))


def lots(x: Column) -> Column:
    """Lots in thousands and ten thousands, signed."""
    whole = F.format_string("%+d", x.cast("long"))
    return F.when(F.abs(x) >= 10000, F.concat(signed(x / 10000), F.lit("萬"))).when(F.abs(x) >= 1000, F.concat(signed(x / 1000), F.lit("k"))).otherwise(whole)


# What lines that lead to other news begin with.
LEAD_INS = ("延伸閱讀", "相關新聞", "更多新聞")


def paragraphs(text: Column) -> Column:
    """Lines of at least two characters, white space collapsed; repeated ones and lead-ins dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), collapse)
    leads = lambda x: F.substring(x, 1, len(LEAD_INS[0])).isin(*LEAD_INS)
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & ~leads(x))), "\n\n")


def clip(text: Column, limit: int) -> Column:
    """At most limit characters (and a sentence's mark): up to a paragraph's end past 70% of it,
    else a sentence's, else cut; white space at the end goes."""
    head, least = F.substring(text, 1, limit + 1), int(limit * 0.7)

    def last(mark: str, size: int = 1) -> Column:
        """Characters before the last mark in head that lies whole in it; -1 if none does."""
        at = F.locate(mark[::-1], F.reverse(head))
        return F.when(at > 0, F.length(head) - at - size + 1).otherwise(-1)

    paragraph, sentence = last("\n\n", 2), F.greatest(last("。"), last("！"), last("？"))
    cut = F.when(paragraph >= least, F.substr(text, F.lit(1), paragraph)).when(sentence >= least, F.substr(text, F.lit(1), sentence + 1)).otherwise(F.substring(text, 1, limit))
    return F.when(F.length(text) <= limit, text).otherwise(rstrip(cut))
