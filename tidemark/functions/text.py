"""Text functions as Column expressions; an Arrow UDF only where Spark has no builtin."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A term of the lexical index: ASCII class, lower-cased.
TERM = "[a-z0-9_]+"

# Patterns that mark a line as an injected instruction.
INJECTION_PATTERNS = (
    r"ignore\s+previous",
    r"system\s+prompt",
    r"developer\s+message",
    r"you\s+are\s+chatgpt",
    r"do\s+not\s+cite",
    r"tool\s+call",
    r"function\s+call",
    r"jailbreak",
    r"prompt\s+injection",
    r"override\s+instructions",
)

# Secrets, each with what replaces it.
SECRET_PATTERNS = (
    (r"(?i)bearer\s+[A-Za-z0-9._+/=-]{8,}", "Bearer [REDACTED]"),
    (r"(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9._+/=-]{6,}", "[REDACTED]"),
    (r"(?i)token\s*[:=]\s*[A-Za-z0-9._+/=-]{6,}", "[REDACTED]"),
    (r"(?i)secret\s*[:=]\s*[A-Za-z0-9._+/=-]{6,}", "[REDACTED]"),
    (r"(?i)sk-[A-Za-z0-9-]{8,}", "sk-[REDACTED]"),
    (r"(?i)gh[pous]_[A-Za-z0-9-]{8,}", "gh[REDACTED]"),
)

# Personal data.
PII_PATTERNS = (
    r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
)

# Typographic characters and what stands for them in an index.
PUNCTUATION = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00ab": '"',
    "\u00bb": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " ",
}

# Leet digits and signs and the letters that they stand for.
LEET = ("013457@$", "oleastas")


def terms(text: Column) -> Column:
    """All terms of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no builtin."""
    return text.str.normalize("NFKC")


def normalise_text(text: Column) -> Column:
    """Index form: NFKC, plain punctuation, no format characters, single spaces."""
    plain = F.translate(nfkc(text), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    shown = F.regexp_replace(plain, r"\p{Cf}", "")
    return F.trim(F.regexp_replace(shown, r"(?U)\s+", " "))


def normalise_document(text: Column) -> Column:
    """Document form: NFKC, LF line ends, no format characters, no blanks at line ends."""
    lines = F.regexp_replace(nfkc(text), r"\r\n?", "\n")
    plain = F.regexp_replace(F.translate(lines, "\u00a0", " "), r"\p{Cf}", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def normalise_title(title: Column, most: int | None = None) -> Column:
    """A window title in index form, lower-cased, cut to ``most`` characters; blank titles are null."""
    plain = F.lower(normalise_text(title))
    cut = plain if most is None else F.trim(F.left(plain, F.lit(most)))
    return F.nullif(cut, F.lit(""))


def normalise_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; one at least, none for the empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.ceil(n / 4), F.lit(1))).cast("long")


def snippet(text: Column, query: str, around: int = 200, lead: int = 400) -> tuple[Column, Column]:
    """(snippet, 0-based offset): ``around`` characters about the first match, else the first ``lead``."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - 1 - around, F.lit(0))
    upto = F.least(at - 1 + len(query) + around, F.length(text))
    found = F.substring(text, start + 1, upto - start)
    return (
        F.when(at > 0, found).otherwise(F.substring(text, 1, lead)),
        F.when(at > 0, start).otherwise(F.lit(0)).cast("long"),
    )


def browse_snippet(text: Column, query: str, most: int = 180, lead: int = 40) -> Column:
    """One line of ``most`` characters that begins ``lead`` before the first match, with ellipses."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.locate(query.lower(), F.lower(flat))
    start = F.when(at > 0, F.greatest(at - 1 - lead, F.lit(0))).otherwise(F.lit(0))
    body = F.substring(flat, start + 1, F.lit(most))
    return F.concat(
        F.when(start > 0, "...").otherwise(""),
        body,
        F.when(start + most < F.length(flat), "...").otherwise(""),
    )


def redact_secrets(text: Column) -> Column:
    for pattern, instead in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def has_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns occurs; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def injection_risk(text: Column) -> Column:
    """Share of non-empty lines that hold an injected instruction; 0 without lines."""
    joined = "(?i)(?:" + "|".join(INJECTION_PATTERNS) + ")"
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    bad = F.size(F.filter(lines, lambda x: x.rlike(joined)))
    return F.when(F.size(lines) > 0, bad / F.size(lines)).otherwise(F.lit(0.0))


def without_injection(text: Column, instead: str = "[REMOVED]") -> Column:
    """The text with every marked line replaced."""
    joined = "(?i)(?:" + "|".join(INJECTION_PATTERNS) + ")"
    lines = F.transform(
        F.split(text, "\n"), lambda x: F.when(x.rlike(joined), F.lit(instead)).otherwise(x)
    )
    return F.array_join(lines, "\n")


def like_pattern(query: str) -> str:
    """A LIKE pattern that finds query literally, with backslash as the escape."""
    for c in "\\%_":
        query = query.replace(c, "\\" + c)
    return f"%{query}%"


def hmac_sha256(text: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex, composed from sha2 (there is no builtin)."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def url_identity(url: Column, process: Column | None = None, title: Column | None = None) -> Column:
    """Host (without www.) and first two path segments; otherwise process and title."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    key = F.array_join(F.concat(F.array(host), F.slice(path, 1, 2)), "/")
    fallback = F.lit(None).cast("string")
    if process is not None:
        fallback = F.concat_ws(":", F.lower(F.trim(process)), title if title is not None else F.lit(None))
    return F.when(host.isNotNull(), key).otherwise(fallback)


def process_name(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def corpus_id(text: Column) -> Column:
    """Letters, digits, dot, dash and underscore; the rest becomes one underscore; 64 characters."""
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit(64))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and SHA-256 of the canonical JSON of named parts (keys in the order given)."""
    packed = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + "_"), F.sha2(packed, 256))


# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "mr.", "mrs.", "ms.", "dr.", "vs.", "prof.", "sr.", "jr.")


def sentences(text: Column) -> Column:
    """Sentences by end marks followed by white space, unless the text so far ends like an abbreviation.

    An abbreviation counts at the end of a longer word too.
    """
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    # White space that ends a sentence begins with a mark of its own; that of an abbreviation loses it again.
    marked = F.regexp_replace(plain, r"(?U)([.!?])(\s+)", "$1\u0001$2")
    marked = F.regexp_replace(marked, rf"(?i)({short})\x01", "$1")
    parts = F.transform(F.split(marked, "\u0001"), lambda x: F.regexp_replace(x, r"(?U)^\s+", ""))
    return F.filter(parts, lambda x: x != "")


#: A citation such as [E1], [E1:L2-L3] or the same in lenticular brackets (fixed value).
CITATION = r"(?:\[|【)(E\d+)(?::L\d+-L\d+)?(?:\]|】)"


def citations(text: Column) -> Column:
    """Evidence ids cited in a text, in order."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
