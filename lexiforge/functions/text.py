"""Scalar text functions: redaction (F1), condition notes (F22), document type (F21), private signs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, replacement) in the order in which they apply.
REDACTIONS = [
    (r"sk-ant-[A-Za-z0-9_\-]{10,}", "API_KEY=<redacted>"),
    (r"\bsk-[A-Za-z0-9_\-]{20,}", "API_KEY=<redacted>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "AWS_ACCESS_KEY_ID=<redacted>"),
    (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "GITHUB_TOKEN=<redacted>"),
    (r"\bAIza[0-9A-Za-z_\-]{30,}\b", "GOOGLE_API_KEY=<redacted>"),
    (r"\bxox[abpr]-[A-Za-z0-9\-]{10,}\b", "SLACK_TOKEN=<redacted>"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----", "PRIVATE_KEY=<redacted>"),
    (r"(?i)\b(api[_-]?key|secret|password|passwd|token|auth)\b(\s*[:=]\s*)(['\"]?)[^\s'\"]{6,}\3", "$1$2<redacted>"),
]

#: For each redaction what a text must hold, one of them, for its pattern to occur; the last is sought in the lower-case text.
HINTS = [["sk-ant-"], ["sk-"], ["AKIA"], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["AIza"], ["xox"], ["-----BEGIN "], ["key", "secret", "passw", "token", "auth"]]

#: Document types and the marks of which two must occur; of equal numbers the first type counts.
DOCUMENT_TYPES = [
    ("legal or licence text", ["hereby", "licence", "license", "warranty", "liability", "pursuant"]),
    ("letter or email", ["dear ", "regards", "sincerely", "subject:"]),
    ("invoice or financial record", ["invoice", "total", "amount due", "gst", "qty"]),
    ("academic or technical paper", ["abstract", "introduction", "references", "et al"]),
    ("code or configuration", ["def ", "import ", "function", "{", "};"]),
]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the column redacted and ``hits``, the substitutions of all patterns, each counted on what it sees."""
    out = docs.withColumn("_t", F.coalesce(column, F.lit(""))).withColumn("hits", F.lit(0))
    for (pattern, replacement), hints in zip(REDACTIONS, HINTS, strict=True):
        seen = F.lower("_t") if pattern.startswith("(?i)") else F.col("_t")
        maybe = reduce(or_, [F.contains(seen, F.lit(x)) for x in hints])
        out = out.withColumn("hits", F.col("hits") + F.when(maybe, F.regexp_count("_t", F.lit(pattern))).otherwise(0)).withColumn("_t", F.when(maybe, F.regexp_replace("_t", pattern, replacement)).otherwise(F.col("_t")))
    return out.withColumn(column, F.col("_t")).drop("_t")


def document_type(text: Column) -> Column:
    """F21."""
    low = F.lower(text)
    hits = [sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0)) for _, marks in DOCUMENT_TYPES]
    most = F.greatest(*hits)
    out = F.lit("general prose")
    for (name, _), h in reversed(list(zip(DOCUMENT_TYPES, hits, strict=True))):
        out = F.when((h == most) & (most >= 2), name).otherwise(out)
    return out


def condition(text: Column) -> list[Column]:
    """F22 of digital text: characters, lines, replacement characters."""
    return [F.char_length(text).alias("characters"), (F.regexp_count(text, F.lit("\n")) + 1).alias("lines"), F.regexp_count(text, F.lit("�")).alias("unreadable")]


def label(sign: Column) -> Column:
    """G000... for glyphs of images, P000... for private-use signs, else the sign."""
    cp = F.ascii(sign)

    def numbered(letter: str, base: int) -> Column:
        n = (cp - base).cast("string")
        return F.concat(F.lit(letter), F.when(F.char_length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))

    return F.when(cp >= 0xF0000, numbered("G", 0xF0000)).when(cp.between(0xE000, 0xF8FF), numbered("P", 0xE000)).otherwise(sign)


def show(text: Column, glyph_mode: bool = False) -> Column:
    """labels joined by hyphens where the text has private signs, else the text."""
    labels = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), label), "-")
    return labels if glyph_mode else F.when(text.rlike(r"[\x{E000}-\x{F8FF}]"), labels).otherwise(text)


def parse_label(text: Column, has_case: Column) -> Column:
    """the signs of a token written in labels (G000, P000, joined by hyphens); another token as it is, in lower case where the text has both cases."""
    labels = text.rlike(r"^[GP][0-9]{3}(-[GP][0-9]{3})*$")

    def sign(part: Column) -> Column:
        cp = F.substring(part, 2, 3).cast("int") + F.when(F.startswith(part, F.lit("G")), 0xF0000).otherwise(0xE000)
        return F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 8, "0")), "UTF-32")

    signs = F.array_join(F.transform(F.when(labels, F.split(text, "-")), sign), "")
    return F.when(labels, signs).when(has_case, F.lower(text)).otherwise(text)


def claim(label: str, text: Column) -> Column:
    """a claim: OBSERVED (measured), INFERRED (probable from patterns) or HYPOTHESIS (a guess to be tested)."""
    if label not in ("OBSERVED", "INFERRED", "HYPOTHESIS"):
        raise ValueError(label)
    return F.struct(F.lit(label).alias("label"), text.alias("text"))


#: Names of languages by code.
LANGUAGES = {
    "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "ca": "Catalan", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fa": "Persian",
    "fi": "Finnish", "fr": "French", "he": "Hebrew", "hi": "Hindi", "hu": "Hungarian", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "la": "Latin", "nl": "Dutch",
    "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sv": "Swedish", "ta": "Tamil", "tr": "Turkish", "uk": "Ukrainian", "ur": "Urdu", "vi": "Vietnamese", "zh": "Chinese",
}


def language_name(code: Column) -> Column:
    """the name of a language, else its code."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), code), code)


def anchor_phrase(anchor: Column) -> Column:
    """F24."""
    return F.when(anchor == "numbers", "next to a number").when(anchor == "line_start", "at the start of a unit").when(anchor == "line_end", "at the end of a unit").otherwise(F.concat(F.lit("next to "), anchor))


def _plain_latin() -> tuple[str, str]:
    """Letters with marks that Unicode decomposes to one basic letter, and those letters, in the order of their codes."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs += [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x1E00, 0x1F00)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Latin letters that do not decompose.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}


def transliterated(text: Column) -> Column:
    """lower-case Latin text in basic letters; other scripts as they are."""
    out = F.translate(F.lower(text), *_plain_latin())
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def deletions(word: Column) -> Column:
    """a word and what is left of it without one of its signs, in order; each once."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.when(F.char_length(word) > 0, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def mapped(word: Column, mapping: Column) -> Column:
    """F16: a word with each sign replaced by its value in a map; a sign without one becomes a question mark."""
    return F.array_join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(mapping, c), F.lit("?"))), "")


def generated() -> Column:
    """the time of the report to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
