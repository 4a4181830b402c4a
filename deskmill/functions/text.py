"""Text and number expressions: JVM-side Columns only."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


#: White space as Unicode has it, and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _odd_folds() -> dict[str, str]:
    """Full case folding of every character that lower case alone does not fold, or that old Unicode versions do not have."""
    old = unicodedata.ucd_3_2_0
    folds = ((c, c.casefold()) for c in map(chr, range(128, sys.maxunicode + 1)))
    return {c: f for c, f in folds if f != c.lower() or c in "\u03a3\u0130" or (f != c and (old.category(c) == "Cn" or len(f) > 1))}


def _class_of(characters: Iterable[str]) -> str:
    codes = sorted(map(ord, characters))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


_FOLDS = _odd_folds()
_FOLDS.pop("ß")  # so common that it has a way of its own
#: Latin text is told by the first part alone.
_ODD = f"[\\xb5\\x{{100}}-\\x{{10ffff}}&&{_class_of(_FOLDS)}]"


def clean(c: Column) -> Column:
    """Null to '', white space runs (Unicode) to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def fold_clean(t: Column) -> Column:
    """Full Unicode case folding. Texts without a character that folds otherwise than to lower case, nearly all, go the short way; in the
    others only such characters are looked up."""
    t = F.replace(t, F.lit("ß"), F.lit("ss"))
    one = F.from_json(F.lit(json.dumps(_FOLDS)), "map<string,string>")  # one literal
    runs = F.regexp_extract_all(t, F.lit(f"{_ODD}|[^{_ODD[1:]}+"), F.lit(0))
    each = F.transform(runs, lambda x: F.when(F.regexp_like(F.substring(x, 1, 1), F.lit(_ODD)), F.try_element_at(one, x)).otherwise(F.lower(x)))
    return F.when(F.regexp_like(t, F.lit(_ODD)), F.array_join(each, "")).otherwise(F.lower(t))


def fold(c: Column) -> Column:
    """Cleaned and case folded."""
    return _let(clean(c), fold_clean)


def classifier_text(subject: Column, body: Column) -> Column:
    return join_clean(clean(subject), clean(body))


def join_clean(subject: Column, body: Column, between: str = "\n\n") -> Column:
    """What is not empty of two cleaned texts."""
    return F.array_join(F.filter(F.array(subject, body), lambda x: x != ""), between)


def fingerprint(text: Column) -> Column:
    return F.sha2(fold(text), 256)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def word_count_clean(t: Column) -> Column:
    """Words of a cleaned text: its spaces and one."""
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def preview(c: Column, limit: int, mark: str = "...") -> Column:
    return _let(clean(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - len(mark))), F.lit(mark))))


def prefix_signature(c: Column, tokens: int = 12) -> Column:
    return F.array_join(F.slice(F.split(fold(c), " "), 1, tokens), " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def row_id(c: Column) -> Column:
    return F.format_string("ticket-%06d", c)


def source_id(c: Column) -> Column:
    return F.concat(F.lit("TP-"), clean(c))


def safe_rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clamp_probability(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.when((total == 0) | F.isnan(total) | total.isNull(), F.transform(scores, lambda _: 1.0 / F.size(scores))).otherwise(F.transform(e, lambda x: x / total))


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def split_pair(a: Column, b: Column) -> Column:
    rank = lambda c: F.when(c == "train", 0).when(c == "validation", 1).otherwise(2)
    return F.when(rank(a) <= rank(b), F.concat_ws("_vs_", a, b)).otherwise(F.concat_ws("_vs_", b, a))


def threshold_key(t: Column) -> Column:
    return F.format_string(">=%.2f", t)


def relevance(c: Column) -> Column:
    """A relevance label 0, 1 or 2 from text, else null."""
    v = F.trim(c).try_cast("double")
    return F.when(v.isin(0.0, 1.0, 2.0), v.cast("int"))


def utc_text(at: Column) -> Column:
    """A timestamp as ISO text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def format_metric(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.3f", c.cast("double")))


def format_percent(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.1f%%", 100.0 * c.cast("double")))


def format_counts(counts: Column) -> Column:
    """A map of counts as 'a=1, b=2' in the order of its keys, or 'none'."""
    pairs = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return F.when(F.coalesce(F.size(counts), F.lit(0)) > 0, F.array_join(pairs, ", ")).otherwise("none")
