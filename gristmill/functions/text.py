"""Row-wise text expressions, all evaluated in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split() sees it.
WS = r"[\s\u001C-\u001F\u0085   -     　]+"

#: Digits and signs read as letters, and letters that look like Latin ones.
LEET = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "в": "b", "к": "k",
    "м": "m", "н": "h", "т": "t", "İ": "i", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe",
}

#: Fixed value: where a text is cut into sentences.
SENTENCE = r"(?<=\w{2}[.!?])\s+|(?:^|\n)\s*[•\-\*●◦▪]\s+|\n{2,}|\n(?=[A-Z])"

_FENCE = "`" * 3


def words(c: Column) -> Column:
    """Words between white space; an empty array for an empty text, null for null."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def grounding_tokens(c: Column) -> Column:
    """Words in lower case with punctuation as space and ``x16`` read as ``x 16``."""
    s = F.regexp_replace(F.lower(c), r"\bx(?=\d)", "x ")
    return F.filter(F.split(F.regexp_replace(s, r"(?U)[^\w\s]+", " "), WS), lambda w: w != "")


def dedup_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), WS), lambda w: w != ""))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """All substrings of low to high characters."""
    n = F.length(c)

    def sized(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[sized(k) for k in range(low, high + 1)]))


def windows(arr: Column, n: int) -> Column:
    """Runs of n neighbours of an array, joined by a space; empty for a shorter array."""

    def runs(a: Column) -> Column:
        return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    # bound to a name, as an expression in the place of the array would be worked out again for each run
    return F.get(F.transform(F.array(arr), lambda a: runs(a)), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE), lambda s: F.trim(s)), lambda s: s != "")


def clean_text(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Characters mapped, ASCII punctuation as space, white space collapsed."""
    if mapping:
        c = F.translate(c, "".join(mapping), "".join(mapping.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Punct}]", " "), WS, " "))


def drop_stop_words(c: Column, stop: list[str]) -> Column:
    """The words that are not in the list, whatever their case, joined by a space."""
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(stop)), " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS, " "))


@F.pandas_udf(StringType())
def unicode_normalise(texts: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed (no built-in function normalises)."""
    return texts.map(lambda t: t if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def _fold_wide(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    table = str.maketrans(CONFUSABLES | LEET)
    for texts in parts:
        yield texts.map(lambda t: t if t is None else " ".join(unicodedata.normalize("NFKC", t.lower()).casefold().translate(table).split()))


def compliance_normalise(c: Column) -> Column:
    """Text in the form in which banned phrases are compared: no case, look-alikes or leet spelling.

    Texts of ASCII alone are folded in the JVM, others in an Arrow batch.
    """
    plain = collapse(F.translate(F.lower(c), "".join(LEET), "".join(LEET.values())))
    return F.when(c.rlike(r"[^\x00-\x7F]"), _fold_wide(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(plain)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared over the distinct elements of the smaller; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(0.0)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def token_estimate(c: Column) -> Column:
    """Tokens reckoned as 1.3 for a word, rounded down."""
    return (word_count(c) * 1.3).cast("int")


def summary_estimate(c: Column) -> Column:
    """The greater of the token estimate and the bytes."""
    return F.greatest(token_estimate(c), F.octet_length(F.coalesce(c, F.lit(""))))


def output_budget(context: Column, system: Column, prompt: Column, reserved: Column) -> Column:
    left = context - system - prompt
    return F.when(left <= 0, reserved).otherwise(F.least(left, reserved))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def path_normalise(c: Column) -> Column:
    return F.regexp_replace(c, r"\\", "/")


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def guard_label(c: Column) -> Column:
    """A guard model's answer as S0 to S9, unsafe or safe; unsafe words are looked for first."""
    s = F.lower(F.trim(c))
    code = F.upper(F.regexp_extract(s, r"\b(s[0-9])\b", 1))
    return (
        F.when(code != "", code)
        .when(s.rlike(r"\b(unsafe|not safe|harmful|blocked|refuse|violation)\b"), "unsafe")
        .when(s.rlike(r"\b(safe|ok|allowed|harmless|benign)\b"), "safe")
    )


def breadcrumb(text: Column, trail: Column, mode: str, label: str = "section") -> Column:
    """A heading trail put before or after a text, or left off."""
    mark = F.concat(F.lit(f"[{label}: "), trail, F.lit("]"))
    full = {"prefix": F.concat(mark, F.lit("\n"), text), "suffix": F.concat(text, F.lit("\n"), mark), "off": text}[mode]
    return F.when(F.coalesce(F.trim(trail), F.lit("")) == "", text).otherwise(full)


def linkify(c: Column, base: str = "file://") -> Column:
    """Absolute source paths as Markdown links; paths already in a link stay."""
    return F.regexp_replace(c, r"(?<![(\w/\[])(/[\w.\-]+(?:/[\w.\-]+)+)", f"[$1]({base}$1)")


#: Spans of credentials in text for logs.
CREDENTIALS = [
    (r"(https?://)[^\s/@]+@", r"$1***@"),
    (r"(?i)([?&#](?:api[_-]?key|access[_-]?token|token|secret|password|passwd|pwd|sig|signature)=)[^&\s#]*", r"$1******"),
    (r"(?i)(authorization\s*[:=]\s*(?:bearer|basic|token)?\s*)[^\s,;]+", r"$1******"),
    (r"(?i)\b((?:api[_-]?key|secret|password|passwd|pwd|access[_-]?token)\s*[:=]\s*)(?![*]{6})[^\s,;&]+", r"$1******"),
]


def mask_credentials(c: Column) -> Column:
    for pattern, to in CREDENTIALS:
        c = F.regexp_replace(c, pattern, to)
    return c


#: What is masked, as (name, priority, pattern, mask).
MASKS = [
    ("CREDIT_CARD_STRICT", 10, r"\b(?:\d{4}[- ]?){3}\d{4}\b", "mask_credit_card"),
    ("CREDIT_CARD_LOOSE", 11, r"(?<![0-9a-fA-F])(?:\d[ -]*?){13,19}(?![0-9a-fA-F])", "mask_credit_card"),
    ("CREDIT_CARD_PLAIN_FALLBACK", 12, r"(?<![0-9a-fA-F])(?:\d{13,19})(?![0-9a-fA-F])", "mask_credit_card"),
    ("EMAIL", 20, r"(?<local>[A-Za-z0-9._%+-]+)@(?<domain>[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "mask_email"),
    ("SSN_DASH", 30, r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("SSN_PLAIN", 31, r"\b\d{9}\b", "[SSN]"),
    ("AWS_ACCESS_KEY", 40, r"\b(?:AKIA|ASIA)[0-9A-Z]{12,20}\b", "[AWS]"),
    ("IPV4_LAST_OCTET", 40, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "mask_ip_last_octet"),
    ("MAC", 50, r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "[MAC]"),
    ("UUID", 60, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "[UUID]"),
    ("JWT", 70, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "mask_jwt"),
    ("LONG_BASE64_LIKE", 90, r"\b[A-Za-z0-9/+=]{40,}\b", "[SECRET]"),
    ("KV_PASSWORDS", 100, r"(\bpassword\b|\bpasswd\b|\bsecret\b|\bapi_key\b|\bapikey\b|\baccess_token\b)(\s*[:=]\s*)([^,\s;\"']+)", "mask_kv_secret"),
    ("WINDOWS_PWD", 101, r"(\bPwd\b|\bPassword\b|\bpwd\b)(\s*[:=]\s*)([^,\s;\"']+)", "mask_kv_secret"),
    ("PASSWORD_SIMPLE", 110, r"\b(pass(word)?|pw)\b\s*[:=]\s*([^\s,;]+)", "[PASSWORD]"),
]


def mask(c: Column, specs: list[tuple[str, int, str, str]] | None = None) -> Column:
    """Each pattern replaced by its mask, by rising priority and then name, in any case and line."""
    for _, _, pattern, to in sorted(specs or MASKS, key=lambda s: (s[1], s[0])):
        c = F.regexp_replace(c, "(?im)" + pattern, to.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def l2_normalise(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(a, lambda v: v.cast("double") / norm)).otherwise(F.transform(a, lambda v: v.cast("double")))


def language_threshold(n_words: Column, low: float = 0.60, short: float = 0.90, few: int = 3, full: int = 10) -> Column:
    """The confidence a detected language needs, falling from ``short`` to ``low`` between few and full words."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n_words - few) / (full - few)))
    return F.lit(short) - at * (short - low)


def detected_language(n_words: Column, top: Column, top_score: Column, second: Column, second_score: Column, installed: list[str]) -> Column:
    """The detector's language with its fallbacks: under three words en; below the threshold the
    runner-up if it is installed and has at least half the top's score, else en."""
    ok = top_score >= language_threshold(n_words)
    return F.when(n_words < 3, "en").when(ok & top.isin(installed), top).when(second.isin(installed) & (second_score >= 0.5 * top_score), second).otherwise("en")
