"""Text expressions: identifiers, tokens, stems, templates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text that is embedded.
EMBED_CHARS = 4096


def split_identifier(name: Column) -> Column:
    """Words of an identifier: camelCase apart, anything but letters and digits is a space."""
    apart = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_join(F.filter(F.split(apart, "[^A-Za-z0-9]+"), lambda t: t != ""), " ")


def embedding_text(kind: Column, name: Column, qualified: Column, path: Column, parent: Column, language: Column) -> Column:
    """The labelled lines that stand for a node."""
    lines = [("qualified name", qualified), ("name", name), ("name terms", split_identifier(name)), ("kind", kind), ("parent scope", F.coalesce(parent, F.lit(""))), ("relative path", path), ("language", language)]
    return F.substring(F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines]), 1, EMBED_CHARS)


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


#: Letters of the Latin blocks that lose an accent, and what is left: from the Unicode decompositions.
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(_bare(c)) == 1 and _bare(c) != c)
_PLAIN = "".join(map(_bare, _ACCENTED))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without accents."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """tokens() of a query, on the driver."""
    return re.findall(r"[^\W_]+", "".join(_bare(c) for c in text.lower()))


def safe_group(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "-")


def valid_name(name: Column, longest: int = 64) -> Column:
    return name.rlike(r"^[a-z0-9][a-z0-9._-]*$") & (F.length(name) <= longest)


def strip_fences(reply: Column) -> Column:
    """A reply without the Markdown fence around it."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?", ""), r"(?s)```$", "")
    return F.regexp_replace(inner, r"(?s)^\s+|\s+$", "")


# --- Porter's stemming algorithm, from its published description ---

_VOWEL = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWEL:
        return False
    return c != "y" or i == 0 or not _is_consonant(w, i - 1)


def _measure(w: str) -> int:
    forms = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", forms))


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n >= 3 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1) and w[-1] not in "wxy"


# Fixed values of the algorithm: suffixes and what replaces them.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    """The stem of a lower-case word of a-z; other words stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, _STEP4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem_batch(batch: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return batch.map(lambda ws: [known[w] if w in known else known.setdefault(w, porter(w)) for w in ws])


def stem_tokens(words: Column) -> Column:
    """Stems of an array of tokens, with each different word of a batch stemmed once."""
    return F.pandas_udf(_stem_batch, "array<string>")(words)
