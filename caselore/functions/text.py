"""Text expressions: repair, normalise, label, shorten, inspect. All JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .numbers import let

_SPACE = r"[\s\x1c-\x1f]"


def fix_mojibake(x: Column) -> Column:
    """Undo UTF-8 text that was once read as latin-1; anything that does not decode cleanly stays as it is.

    ``x`` appears once: copied into every condition, and from there into the filters pushed below, the expressions behind it
    made methods that the JVM no longer compiles.
    """

    def fixed(t: Column) -> Column:
        latin = ~t.rlike(r"[^\x{00}-\x{FF}]")
        marked = t.contains("â") | t.contains("Ã")
        # The guard keeps encode() away from characters latin-1 does not have.
        raw = F.encode(F.when(marked & latin, t).otherwise(F.lit("")), "ISO-8859-1")
        return F.when(marked & latin, F.coalesce(F.try_validate_utf8(raw.cast("string")), t)).otherwise(t)

    return let(x, fixed)


def strip(x: Column) -> Column:
    """Strip Unicode white space on both sides; null becomes empty."""
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(V.WHITE_SPACE))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(V.WHITE_SPACE))


def words(x: Column) -> Column:
    """White-space separated words of the whole text."""
    return F.filter(F.split(x, rf"(?U){_SPACE}+"), lambda w: w != "")


def collapse(x: Column) -> Column:
    return F.array_join(words(x), " ")


def is_missing(x: Column) -> Column:
    return F.lower(x).isin(V.MISSING_TOKENS)


def blank_missing(x: Column) -> Column:
    return let(x, lambda t: F.when(is_missing(t), F.lit("")).otherwise(t))


def identity_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u001f", *parts)), 1, 10)


def tidy_label(x: Column) -> Column:
    """Title case for labels written fully in capitals; a capital follows every non-letter."""

    def titled(v: Column) -> Column:
        is_upper = v.rlike(r"\p{Lu}") & ~v.rlike(r"[\p{Ll}\p{Lt}]")
        runs = F.regexp_extract_all(v, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
        return F.when(is_upper, F.array_join(F.transform(runs, F.initcap), "")).otherwise(v)

    return let(x, titled)


def _join_labels(sep: str, labels) -> Column:
    parts = F.array(*[tidy_label(c) for c in labels])
    return F.array_join(F.filter(parts, lambda p: p != ""), sep)


def pattern_text(*labels: Column) -> Column:
    return _join_labels(". ", labels)


def candidate_label(*labels: Column) -> Column:
    return _join_labels(" / ", labels)


def clean_complaint(x: Column) -> Column:
    return collapse(x)


def complaint_accepted(x: Column) -> Column:
    """Length limits hold for the text as received, before white space is collapsed."""
    return F.length(x).between(V.COMPLAINT_MIN, V.COMPLAINT_MAX)


def is_truncated(x: Column) -> Column:
    t = rstrip(x)
    return (F.length(t) >= V.TRUNCATED_AT) & ~t.rlike(r'[.!?")]$')


def sentences(x: Column) -> Column:
    return F.split(strip(x), rf"(?U)(?<=[.!?]){_SPACE}+")


def filled(template: str, *values: Column) -> Column:
    """The template with its places {} taken by the values, in order; null if one of them is."""
    texts = template.split("{}")
    if len(texts) != len(values) + 1:
        raise ValueError(f"{len(values)} values for {len(texts) - 1} places")
    parts = [F.lit(texts[0])]
    for value, after in zip(values, texts[1:], strict=True):
        parts += [value.cast("string"), F.lit(after)]
    return F.concat(*parts)


def first_sentences(x: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(x), 1, n), " ")


def shorten(x: Column, width: int, placeholder: str = " [...]") -> Column:
    """Collapse white space; if too long keep the leading words that fit together with the placeholder."""
    room = width - len(placeholder)
    # The longest start of the text that fits the room and ends at a space or behind the hyphen of a word.
    stop = r"(?= |$)|(?<=[^\d\W]{2}-)(?=[^\d\W]-?[^\d\W])"

    def cut(flat: Column) -> Column:
        head = F.regexp_extract(flat, rf"(?U)^(.{{1,{room}}})(?:{stop})", 1)
        short = let(head, lambda h: F.when(h == "", placeholder.strip()).otherwise(F.concat(h, F.lit(placeholder))))
        return F.when(F.length(flat) <= width, flat).otherwise(short)

    return let(collapse(x), cut)


def numbers_in(x: Column) -> Column:
    """Numbers of a text after its citation marks are taken out, as strings."""
    bare = F.regexp_replace(x, "(?U)" + V.CITATION, "")
    return F.regexp_extract_all(bare, F.lit("(?U)" + V.NUMBER), F.lit(0))


def is_prediction(x: Column) -> Column:
    return x.rlike("(?U)" + V.PREDICTION)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))


def bare_citation(c: Column) -> Column:
    """A citation without the brackets and blanks around it."""
    return F.btrim(c, F.lit("[] "))


def log_row(request: Column, text: Column) -> Column:
    """What may be logged about a complaint: a hash prefix and the length, never the text."""
    return F.struct(
        request.alias("request"),
        F.substring(F.sha1(text), 1, 10).alias("text_hash"),
        F.length(text).alias("text_length"),
    )
