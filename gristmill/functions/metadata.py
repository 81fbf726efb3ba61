"""Expressions that bring dirty file metadata into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings by which a language is known, beside its two-letter code.
LANGUAGE_NAMES = {
    "en": ("eng", "english", "englisch", "anglais", "inglés", "inglese", "inglês"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "alemão"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francés", "francese", "francês"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "spagnolo", "espanhol"),
    "it": ("ita", "italian", "italiano", "italienisch", "italien"),
    "pt": ("por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portoghese"),
}


def canonical_language(c: Column) -> Column:
    """The two-letter code of a language label in any spelling or regional form; else null.

    Null, blank, placeholder and unknown labels give null.
    """
    s = F.regexp_replace(F.lower(F.trim(c)), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    head = F.regexp_extract(s, r"^([^\-_\s.]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(head.isin(code, *names), F.lit(code)).otherwise(out)
    return out


def path_domain(c: Column) -> Column:
    """The folder under the corpus root, or the first segment of a URL's path, in lower case.

    Backslashes, repeated slashes, dot segments and case are evened out first. A path without
    such a segment gives null.
    """
    p = F.regexp_replace(F.lower(F.trim(c)), r"\\", "/")
    p = F.regexp_replace(p, r"^(https?:)/+[^/]+/", "/corpus/")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(p, r"/+", "/")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(p, r"/[^/.][^/]*/\.\./", "/")
    d = F.regexp_extract(p, r"/corpus/([^/]+)/", 1)
    return F.when(d != "", d)
