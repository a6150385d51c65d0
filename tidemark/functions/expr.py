"""Column expressions for text, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Query parameters that name an article.
KEY_PARAMETERS = ["article", "oid", "sid"]


def canonical_url(url: Column, keys: list[str] = KEY_PARAMETERS) -> Column:
    """The address with only the parameters whose name holds one of the keys, sorted."""
    base = F.element_at(F.split(url, r"\?"), 1)
    query = F.element_at(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "#"), 1)
    keep = F.array_sort(F.filter(F.split(query, "&"), lambda p: F.element_at(F.split(p, "="), 1).rlike("|".join(keys))))
    return F.when(F.size(keep) > 0, F.concat(base, F.lit("?"), F.array_join(keep, "&"))).otherwise(base)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def links(html: Column) -> Column:
    """Targets of all anchors, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def json_ld(html: Column) -> Column:
    """The first ld+json block."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script type="application/ld\+json">(.*?)</script>', 1), F.lit(""))


def parse_news_time(s: Column) -> Column:
    """UTC of a Seoul time in one of three notations: ISO, `Y-m-d H:M:S`, or with a.m./p.m. in Korean."""
    korean = F.regexp_replace(F.regexp_replace(s, "오전", "AM"), "오후", "PM")
    at = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(korean, F.lit("yyyy.MM.dd. a h:mm")))
    return at - F.expr("INTERVAL 9 HOURS")


def squeezed(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def occurrences(text: Column, word: Column) -> Column:
    """How often a text holds a word, without overlaps; 0 for an empty word."""
    return F.when(F.length(word) > 0, F.expr("0") + (F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).otherwise(0).cast("int")


def base_and_lag(feature: Column) -> tuple[Column, Column]:
    """`word_L3` as word and 3; without a suffix lag 1."""
    lag = F.regexp_extract(feature, r"^(.*)_L(\d+)$", 2)
    return F.when(lag != "", F.regexp_extract(feature, r"^(.*)_L(\d+)$", 1)).otherwise(feature), F.coalesce(F.nullif(lag, F.lit("")).cast("int"), F.lit(1))


def hours_since(then: Column, now: Column) -> Column:
    """Hours, at least 0; a time of midnight sharp stands for a date alone and counts 24."""
    alone = (F.hour(then) == 0) & (F.minute(then) == 0) & (F.second(then) == 0)
    gap = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 3600.0
    return F.when(alone, 24.0).otherwise(F.greatest(gap, F.lit(0.0)))


def time_decay(hours: Column, rate: float = 0.02) -> Column:
    return F.least(F.greatest(F.exp(-rate * hours), F.lit(0.0)), F.lit(1.0))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def return_on_equity(per: str, pbr: str, eps: str, bps: str) -> Column:
    return F.when(F.col(bps) > 0, F.col(eps) / F.col(bps) * 100).when(F.col(per) > 0, F.col(pbr) / F.col(per) * 100).otherwise(0.0)


def _joined(tokens: Column, k: int):
    return lambda i: F.array_join(F.slice(tokens, i, k), ";")


def ngrams(tokens: Column, n: int) -> Column:
    """Unigrams, then all bigrams, then trigrams and so on, joined by semicolons."""
    parts = [tokens]
    for k in range(2, n + 1):
        starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _joined(tokens, k)))
    return F.concat(*parts)


def sentences(text: Column, least: int = 6) -> Column:
    """Sentences of at least so many characters, after agency bylines and bracketed headings are gone."""
    bare = F.regexp_replace(text, r"\([가-힣]+=연합뉴스\)|\[[가-힣\s]+\]", "")
    return F.filter(F.transform(F.split(bare, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, of over 20 characters; a text without blank lines is one part if it has up to four sentences, else threes of
    sentences. Nothing for null or empty text."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 20)
    s = sentences(text)
    threes = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(s, i * 3 + 1, 3), " "))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).when(text.contains("\n\n"), parts).when(F.size(s) <= 4, F.array(text)).otherwise(threes)


def register(spark: SparkSession) -> None:
    """Makes the tokenizer and the address hash callable from SQL."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION tm_tokens(t STRING) RETURN filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+', 0), w -> length(w) > 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tm_decay(hours DOUBLE) RETURN least(greatest(exp(-0.02D * hours), 0.0D), 1.0D)")
