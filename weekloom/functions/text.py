"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword lists of the rule-based sentiment.
POSITIVE_KEYWORDS = ("上涨", "大涨", "涨停", "突破", "牛市", "利好", "增长", "盈利", "超预期", "创新高", "买入", "看多", "推荐", "增持", "景气", "回暖")
NEGATIVE_KEYWORDS = ("下跌", "大跌", "跌停", "熊市", "利空", "亏损", "不及预期", "创新低", "卖出", "看空", "减持", "萧条", "衰退", "风险")


def both_null(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNull()
    return out


def joined(a: Column, b: Column, sep: str = " ") -> Column:
    """Both parts with nulls as empty; the separator always stands."""
    return F.concat(F.coalesce(a, F.lit("")), F.lit(sep), F.coalesce(b, F.lit("")))


def model_text(title: Column, content: Column, chars: int = 256, sep: str = " [SEP] ") -> Column:
    """Title and cut content; content alone if there is no title; otherwise empty."""
    has = lambda c: c.isNotNull() & (c != "")
    cut = F.substring(content, 1, chars)
    return F.when(has(title) & has(content), F.concat(title, F.lit(sep), cut)).when(has(content), cut).otherwise("")


def training_text(title: Column, content: Column, chars: int = 256) -> Column:
    """Title, a bare separator and cut content; the title alone if there is no content."""
    cut = F.substring(F.coalesce(content, F.lit("")), 1, chars)
    return F.when(cut == "", F.coalesce(title, F.lit(""))).otherwise(F.concat(F.coalesce(title, F.lit("")), F.lit("[SEP]"), cut))


def trimmed_text(title: Column, content: Column, chars: int = 256) -> Column:
    """The older builder: parts are trimmed first, and either one alone will do."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.substring(F.trim(F.coalesce(content, F.lit(""))), 1, chars)
    return F.when((t != "") & (c != ""), F.concat(t, F.lit(" [SEP] "), c)).when(c != "", c).otherwise(t)


def safe_name(name: Column) -> Column:
    """Slashes, backslashes and blanks become underscores."""
    return F.translate(name, "/\\ ", "___")


def keyword_sentiment(text: Column, positive: Sequence[str] = POSITIVE_KEYWORDS, negative: Sequence[str] = NEGATIVE_KEYWORDS) -> Column:
    """(p - n) / (p + n) over the distinct keywords that a text contains; 0 without any."""
    count = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    p, n = count(positive), count(negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def unfenced(text: Column) -> Column:
    """Without a code fence's first and last line."""
    return F.when(F.trim(text).startswith("```"), F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"\n```$", "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
