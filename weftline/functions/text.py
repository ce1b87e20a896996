"""Text expressions. All are Column -> Column and stay in the JVM.

White space and line separators are the Unicode sets below, in Java's regex syntax; Spark's trim and \\s know fewer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
LS = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f of the value of x, computed once however often f uses it (inside lambdas too)."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"^{WS}+|{WS}+$", "")


def words(text: Column | str) -> Column:
    """White-space tokens; an empty array for a blank text, null for null."""
    s = strip(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+"))


def lines(text: Column | str) -> Column:
    """Lines without their ends; no empty line after the last end."""
    t = _c(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, rf"(?:{LS})\z", ""), LS))


def kept_lines(text: Column | str) -> Column:
    """Lines that keep their newline, as when a file is iterated: only \\n ends one."""
    return F.regexp_extract_all(_c(text), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def join_lines(text: Column | str) -> Column:
    """One line: separators become blanks; one at the very end is dropped."""
    return F.regexp_replace(F.regexp_replace(_c(text), rf"(?:{LS})\z", ""), LS, " ")


def newlines_to_blanks(text: Column | str) -> Column:
    return F.replace(_c(text), F.lit("\n"), F.lit(" "))


def collapse(text: Column | str) -> Column:
    return strip(F.regexp_replace(_c(text), f"{WS}+", " "))


def excerpt(text: Column | str, n: int) -> Column:
    return strip(newlines_to_blanks(F.substring(_c(text), 1, n)))


def occurrences(text: Column | str, what: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    t = _c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(what), F.lit("")))) / len(what)).cast("int")


def fold_latin(text: Column | str) -> Column:
    """Latin letters without their marks, in the JVM; the table follows from Unicode's. fold_marks does any script."""
    import unicodedata

    table = {}
    for code in range(0xC0, 0x250):
        base = "".join(ch for ch in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(ch) != "Mn")
        if len(base) == 1 and base != chr(code):
            table[chr(code)] = base
    out = F.translate(_c(text), "".join(table), "".join(table.values()))
    return F.regexp_replace(out, r"\p{Mn}+", "")


@F.pandas_udf(StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """NFD without combining marks, for any script."""
    import unicodedata

    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def normalize(text: Column | str, full: bool = False) -> Column:
    """Lower case, marks dropped, everything but letters, digits, _ and blanks deleted, blanks collapsed."""
    t = F.lower(_c(text))
    t = fold_marks(t) if full else fold_latin(t)
    return collapse(F.regexp_replace(t, r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]", ""))


def ngrams(tokens: Column | str, n: int) -> Column:
    """The set of joined n-grams of an array of words; empty where there are fewer than n."""

    def grams(t: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(all_))

    return let(_c(tokens), grams)


def strip_label(label: Column | str) -> Column:
    return F.replace(_c(label), F.lit("__label__"), F.lit(""))


def label_line(label: str, text: Column | str, collapse_blanks: bool = True) -> Column:
    """`__label__<label> <text>` on one line."""
    body = collapse(text) if collapse_blanks else strip(newlines_to_blanks(text))
    return F.concat(F.lit(f"__label__{label} "), body)


def fill_template(template: Column | str, **values: Column | str) -> Column:
    """A template with {name} replaced by columns."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _c(v))
    return out


def is_blank(text: Column | str) -> Column:
    return strip(text) == ""


def type_token_ratio(tokens: Column | str) -> Column:
    """Distinct over all tokens, case-sensitive; 0 where there are none."""
    t = _c(tokens)
    return F.coalesce(F.try_divide(F.size(F.array_distinct(t)), F.size(t)), F.lit(0.0))


def word_tokens(text: Column | str) -> Column:
    """Words, numbers and punctuation marks apart from one another: a documented stand-in for a treebank tokeniser, which
    also splits clitics ('s, n't)."""
    return F.regexp_extract_all(_c(text), F.lit(r"n't|'(?:s|m|d|ll|re|ve)\b|\p{L}+(?=n't)|[\p{L}\p{N}_]+(?:[.,'-][\p{L}\p{N}_]+)*|\.\.\.|[^\s\p{L}\p{N}_]"), F.lit(0))


def keyword_context(text: Column | str, pattern: str, width: int = 100) -> Column:
    """For each match of a pattern the match with up to `width` characters on either side; contexts may overlap."""
    import re

    rx = re.compile(pattern)

    @F.pandas_udf(ArrayType(StringType()))
    def contexts(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [t[max(0, m.start() - width) : m.end() + width] for m in rx.finditer(t)])

    return contexts(_c(text))
