"""Column-level text expressions and their DuckDB SQL twins.

Whitespace is the explicit class ``[\\t\\n\\x0B\\f\\r ]`` in every regex so
that Java (Spark) and RE2 (DuckDB) agree character for character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (BASIC_STOPWORDS, DOMAIN_STOPWORDS, FRENCH_STOPWORDS, KEEP_CHARS,
                        SLUG_FOLD)

WS = r"\t\n\x0B\f\r "
STRIP_RE = rf"^[{WS}]+|[{WS}]+$"
NONKEEP_RE = rf"[^{KEEP_CHARS}{WS}]"
WSRUN_RE = rf"[{WS}]+"


def training_stopwords() -> list[str]:
    """French stop list plus the domain words, in declaration order."""
    seen, out = set(), []
    for w in list(FRENCH_STOPWORDS) + DOMAIN_STOPWORDS:
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out


# ------------------------------------------------------------ Spark columns

def clean_text_col(c: Column) -> Column:
    """lower -> strip -> characters outside the kept class to space ->
    collapse whitespace.  NULL gives ''."""
    x = F.lower(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(x, STRIP_RE, "")
    x = F.regexp_replace(x, NONKEEP_RE, " ")
    return F.regexp_replace(x, WSRUN_RE, " ")


def words_col(cleaned: Column) -> Column:
    """Non-empty space-separated words of an already cleaned string."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def raw_words_col(c: Column) -> Column:
    """Whitespace-separated words of a raw string (``str.split()``)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WSRUN_RE), lambda w: w != "")


TOKEN_SPLIT_RE = rf"[^{KEEP_CHARS}]+"


def text_words_col(c: Column) -> Column:
    """Words of the cleaned text in one regex pass: maximal runs of kept
    characters of the lower-cased text (same words as
    ``words_col(clean_text_col(c))``)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SPLIT_RE), lambda w: w != "")


def kept_tokens_col(cleaned: Column, stopwords: list[str], min_len: int = 3, raw: bool = False) -> Column:
    """Words of at least ``min_len`` characters that are not stop-words
    (``isin`` over many literals becomes a hash-set probe, ``InSet``).
    With ``raw`` the input is the raw text (one-pass tokenisation)."""
    words = text_words_col(cleaned) if raw else words_col(cleaned)
    if not stopwords:
        return F.filter(words, lambda w: F.char_length(w) >= min_len)
    return F.filter(words, lambda w: (F.char_length(w) >= min_len) & ~w.isin(*stopwords))


def ngrams_col(tokens: Column, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """Word n-grams joined by one space, unigrams first then bigrams, ..."""
    lo, hi = ngram_range
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(tokens)
            continue
        grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), _gram_fn(tokens, n))
        parts.append(F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _gram_fn(tokens: Column, n: int):
    # one-argument lambda: a two-argument one would receive (element, index)
    return lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")


def label_slug_col(c: Column) -> Column:
    src = "".join(SLUG_FOLD)
    dst = "".join(SLUG_FOLD[k] for k in SLUG_FOLD)
    return F.translate(F.lower(c), src, dst)


# ------------------------------------------------------------ SQL twins

def sql_str_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_clean(expr: str) -> str:
    x = f"lower(coalesce({expr}, ''))"
    x = f"regexp_replace({x}, '{STRIP_RE}', '', 'g')"
    x = f"regexp_replace({x}, '{NONKEEP_RE}', ' ', 'g')"
    return f"regexp_replace({x}, '{WSRUN_RE}', ' ', 'g')"


def sql_words(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda w: w <> '')"


def sql_raw_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{WSRUN_RE}'), lambda w: w <> '')"


def sql_kept_tokens(cleaned: str, stopwords: list[str], min_len: int = 3) -> str:
    stop = sql_str_list(stopwords) if stopwords else "CAST([] AS VARCHAR[])"
    return (f"list_filter({sql_words(cleaned)}, lambda w: length(w) >= {min_len} "
            f"AND NOT list_contains({stop}, w))")


def sql_ngrams(tokens: str, ngram_range: tuple[int, int] = (1, 1)) -> str:
    lo, hi = ngram_range
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(tokens)
        else:
            parts.append(f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n - 2}), "
                         f"lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE CAST([] AS VARCHAR[]) END")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def sql_label_slug(expr: str) -> str:
    src = "".join(SLUG_FOLD)
    dst = "".join(SLUG_FOLD[k] for k in SLUG_FOLD)
    return f"translate(lower({expr}), '{src}', '{dst}')"


BASIC_STOP = BASIC_STOPWORDS
