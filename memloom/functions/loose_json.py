"""JSON of unknown shape, as models and services answer it.

Values are read as VARIANT, so one of another kind than expected is that value's default and leaves its neighbours whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip_fence

#: How JSON writes what counts as nothing when it is not a string.
NOTHING = ("false", "0", "0.0", "-0.0", "[]", "{}")


def parsed(c: Column) -> Column:
    """The VARIANT of a JSON text, with or without a code fence around it; null if it is malformed."""
    return F.try_parse_json(strip_fence(c))


def inner(v: Column, name: str) -> Column:
    """A field of an object; null if it is missing or v is no object. A JSON null is a VARIANT that holds null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def has_kind(v: Column, kind: str) -> Column:
    """Whether a VARIANT is of a kind, as schema_of_variant names it: STRING, OBJECT, ARRAY, VOID."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def as_text(v: Column) -> Column:
    """The text of a value: empty for null, false, zero and what holds nothing; lists and objects as canonical JSON."""

    def told(t: Column) -> Column:
        return F.when(t["text"].isin(*NOTHING) & ~has_kind(t["v"], "STRING"), F.lit("")).otherwise(t["text"])

    read = lambda x: F.struct(x.alias("v"), F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")).alias("text"))
    return bound(v, lambda x: bound(read(x), told))


def first_text(v: Column, *names: str) -> Column:
    """The first of the named fields that is not empty, or an empty text."""
    return F.coalesce(*[F.nullif(as_text(inner(v, n)), F.lit("")) for n in names], F.lit(""))


def items(v: Column, name: str) -> Column:
    """The elements of a list; any other value that is not empty is a list of itself."""
    none = F.array().cast("array<variant>")
    found = lambda one: F.when(has_kind(one, "ARRAY"), F.try_variant_get(one, "$", "array<variant>")).when(as_text(one) != "", F.array(one)).otherwise(none)
    return bound(inner(v, name), found)


def list_items(v: Column, name: str) -> Column:
    """The elements of a list; any other value holds none."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def texts(found: Column, limit: int | None = None) -> Column:
    """The elements' texts that are not blank, in order, the first limit of them."""
    kept = F.filter(F.transform(found, as_text), lambda x: F.trim(x) != "")
    return kept if limit is None else F.slice(kept, 1, limit)


def choice(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A name in lower case with underscores, or the default if it is not one of those allowed (P10)."""
    name = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")
    return F.when(name.isin(*allowed), name).otherwise(F.lit(default))


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null if it is malformed."""
    return F.to_json(F.try_parse_json(json))


def distinct_json(found: Column) -> Column:
    """Each JSON text whose canonical form no earlier one has, as it was written.

    Null, empty texts and the JSON of both go; a malformed text is its own form.
    """
    kept = F.filter(found, lambda x: ~F.coalesce(F.trim(x), F.lit("")).isin("", "null", '""'))
    forms = lambda a: F.transform(a, lambda x: F.coalesce(canonical(x), x))
    return bound(kept, lambda a: bound(forms(a), lambda f: F.filter(a, lambda x, i: F.array_position(f, F.get(f, i)) == i + 1)))


def rerank_items(answer: Column) -> Column:
    """index and score of each result in a reranker's answer of whatever shape.

    The list is the answer itself, or under the first of its names that is not null. The first name of an index, and of a score, that
    a result has counts: an index that is no whole number is -1, a score that is no number is 0, one in a list is its last.
    A bare value is a score without index. Malformed answers give no results.
    """
    v = parsed(answer)
    some = lambda n: F.when(~has_kind(inner(v, n), "VOID"), inner(v, n))
    chosen = F.when(has_kind(v, "ARRAY"), v).otherwise(F.coalesce(some("data"), some("results"), some("rerank_results")))
    rows = F.coalesce(F.try_variant_get(chosen, "$", "array<variant>"), F.array().cast("array<variant>"))

    def number(x: Column) -> Column:
        last = F.when(has_kind(x, "ARRAY"), F.element_at(F.try_variant_get(x, "$", "array<variant>"), F.lit(-1))).otherwise(x)
        text = F.try_variant_get(last, "$", "string")
        return F.coalesce(F.when(has_kind(last, "BOOLEAN"), (text == "true").cast("double")).otherwise(F.trim(text).try_cast("double")), F.lit(0.0))

    def whole(x: Column) -> Column:
        text = F.trim(F.try_variant_get(x, "$", "string"))
        plain = F.when(has_kind(x, "STRING") & ~text.rlike(r"^[+-]?\d+$"), F.lit(None)).otherwise(text)
        return F.coalesce(plain.try_cast("double").try_cast("int"), F.lit(-1))

    def first(x: Column, *names: str) -> Column:
        return F.coalesce(*[inner(x, n) for n in names])

    def result(x: Column) -> Column:
        record = has_kind(x, "OBJECT")
        score = number(F.when(record, first(x, "relevance_score", "relevance", "score", "rerank_score")).otherwise(x))
        return F.struct(F.when(record, whole(first(x, "index", "document_index", "doc_index"))).otherwise(F.lit(-1)).alias("index"), score.alias("score"))

    return F.transform(rows, result)
