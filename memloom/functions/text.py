"""Text keys, token estimates, term sets, templates and hashes as Column expressions.

Null texts count as empty throughout: the data model has no nulls in text columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own in a question.
STOP_WORDS = (
    "the and for with that this from what when where which who how did does has have had was were are is about into "
    "your their they them you user assistant anchor original conversation"
).split()


#: Case foldings beyond lower case.
FOLDINGS = (("ß", "ss"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def casefold(c: Column) -> Column:
    """Lower case with the full foldings that lower-casing leaves out: sharp s, final sigma and the Latin ligatures."""
    plain = F.lower(c)
    x = plain
    for a, b in FOLDINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.when(plain.rlike("[" + "".join(a for a, _ in FOLDINGS) + "]"), x).otherwise(plain)


def normalize_key(c: Column) -> Column:
    """Case folded; separators to spaces; other non-word characters dropped; blanks squeezed (G1)."""
    x = casefold(F.trim(_text(c)))
    x = F.regexp_replace(x, r"[\s\-_:/\\|,;\x{ff0c}\x{ff1b}\x{ff1a}]+", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_ ]+", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def record_id(c: Column) -> Column:
    """Content address of a record."""
    return F.sha2(_text(c), 256)


def node_id(kind: Column, key: Column) -> Column:
    """Id of an evidence node from its type and key."""
    return F.concat(F.lit("ev_"), kind, F.lit("_"), F.substring(F.sha2(F.concat(kind, F.lit(":"), key), 256), 1, 24))


def image_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def token_estimate(c: Column) -> Column:
    """CJK characters + ASCII words + a quarter of what is left, 1 at least."""
    t = _text(c)
    n_cjk = F.length(t) - F.length(F.regexp_replace(t, r"[\x{4e00}-\x{9fff}]", ""))
    in_words = F.length(t) - F.length(F.regexp_replace(t, r"[A-Za-z0-9_]+", ""))
    other = F.greatest(F.lit(0), F.length(t) - n_cjk - in_words)
    return F.greatest(F.lit(1), n_cjk + F.regexp_count(t, F.lit(r"[A-Za-z0-9_]+")) + F.floor(other / 4)).cast("bigint")


def token_set(c: Column) -> Column:
    """Distinct case-folded words in any script."""
    return F.array_distinct(F.regexp_extract_all(casefold(_text(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def query_terms(c: Column) -> Column:
    """ASCII words of three or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[a-z0-9_]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def head_and_tail(c: Column, limit: int = 4000, joint: str = "\n...\n") -> Column:
    """Texts over limit keep their first and last halves."""
    half = (limit - len(joint)) // 2
    t = _text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, half), F.lit(joint), F.right(t, F.lit(half))))


def turn_line(role: Column, content: Column, speaker: Column | None = None) -> Column:
    """"role: content", with the speaker's name once in front of the content."""
    body = _text(content)
    if speaker is not None:
        name = F.trim(_text(speaker))
        has = (name == "") | F.startswith(body, F.concat(name, F.lit(":")))
        body = F.when(has, body).otherwise(F.concat(name, F.lit(": "), body))
    return F.concat(role, F.lit(": "), body)


def clean_terms(c: Column) -> Column:
    """Trimmed, non-empty, distinct terms in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body names it many times: within lambdas Spark shares nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_folded(c: Column) -> Column:
    """Order-preserving distinct without regard to case: the first spelling stays (A6). Null elements go."""
    first = lambda a: bound(F.transform(a, casefold), lambda folded: F.filter(a, lambda x, i: F.array_position(folded, F.get(folded, i)) == i + 1))
    return bound(c, first)


def strip_fence(c: Column) -> Column:
    """Model output without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(_text(c), r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))


def session_segment(c: Column, limit: int = 128) -> Column:
    """A session id of safe characters; over-long ones end in a hash."""
    safe = F.regexp_replace(F.trim(_text(c)), r"[^A-Za-z0-9_.:\-]+", "_")
    cut = F.concat(F.substring(safe, 1, limit - 13), F.lit("-"), F.substring(F.sha1(_text(c)), 1, 12))
    return F.when(F.length(safe) <= limit, safe).otherwise(cut)


def data_url(c: Column) -> Column:
    """struct(mime, base64) of a data URL; nulls if it is none."""
    pattern = r"^data:([A-Za-z0-9.+/\-]+);base64,(.+)$"
    part = lambda i: F.nullif(F.regexp_extract(_text(c), pattern, i), F.lit(""))
    return F.struct(part(1).alias("mime"), part(2).alias("base64"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


#: Words that mark something worth remembering.
SIGNAL_WORDS = ("remember", "keep in mind", "default", "preference", "workflow", "policy", "requirement", "standard", "prefer", "always", "never", "must")
SIGNAL_TERMS = ("记住", "记下", "默认", "以后", "规范", "规则", "要求", "偏好", "优先", "必须", "流程", "标准", "部署前", "文档")


def long_term_signal(c: Column) -> Column:
    """Whether a text holds one of the words as a whole, in either case, or one of the terms anywhere."""
    return _text(c).rlike(rf"(?i)\b({'|'.join(SIGNAL_WORDS)})\b|" + "|".join(SIGNAL_TERMS))


def search_text(kind: str, **parts: Column) -> Column:
    """"field: value" lines of a node's search text, empty values left out."""
    lines = [F.lit(f"type: {kind}")]
    lines += [F.when(F.length(_text(v)) > 0, F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()]
    return F.concat_ws("\n", *lines)
