"""Text expressions with Python's Unicode rules, kept on the JVM wherever Spark has the means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The characters str.strip(), str.split() and the regex \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The characters str.splitlines() breaks at.
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _all_but(characters: str) -> str:
    """Bracket content for every other character, as plain ranges: a negated bracket is many times slower in Java,
    which looks up characters below 256 in a bit table only for plain ones.
    """
    ranges, low = [], 0
    for code in sorted(map(ord, characters)) + [0x110000]:
        if code > low:
            ranges.append(rf"\x{{{low:x}}}-\x{{{code - 1:x}}}")
        low = code + 1
    return "".join(ranges)


# White space in a bracket, without and with the line feed. The intersection rules out the rare characters by one test.
WS_INLINE = (
    r"\t\x0b-\r\x1c-\x20\x85\xa0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
WS = r"\n" + WS_INLINE
VISIBLE = _all_but(WHITESPACE)
IN_LINE = _all_but(LINE_BREAKS)
WORD = r"[\p{L}\p{N}_]"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def settled(value: Column) -> Column:
    """The value by way of a one-element explode.

    The optimizer copies a projected expression into every filter and projection above it; what an explode yields it
    has to take as a column. Costly expressions used in many places are thus evaluated once per row.
    """
    return F.explode(F.array(value))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def head(text: Column) -> Column:
    """The first 64 bytes, of which the last may be part of a character. A text is not decoded for them, nor its characters counted."""
    return F.substring(text.cast("binary"), 1, 64).cast("string")


def is_blank(text: Column) -> Column:
    """True for text without a visible character; NULL stays NULL. A text is decoded whole only if no ASCII one is at its head."""
    return ~(head(text).rlike("[!-~]") | text.rlike(f"[{VISIBLE}]"))


def squeeze(text: Column) -> Column:
    """Every white-space run becomes one blank, none at the ends."""
    return strip(F.regexp_replace(text, f"[{WS}]+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{VISIBLE}]+"))


def visible_line_count(text: Column) -> Column:
    """Lines with at least one visible character: each match starts at the line's first one."""
    return F.regexp_count(text, F.lit(f"[{VISIBLE}][{IN_LINE}]*"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold_ascii_word(text: Column) -> Column:
    """Case folding exact enough to compare with ASCII words: the long s and the fi ligature fold to them."""
    return F.replace(F.translate(F.lower(text), "\u017f", "s"), F.lit("\ufb01"), F.lit("fi"))


def _icu(owner: str, function: str, text: Column) -> Column:
    """A function of the Unicode library that Spark carries, with its one switch on. It takes no NULL."""
    return F.reflect(F.lit(f"com.ibm.icu.{owner}"), F.lit(function), F.coalesce(text, F.lit("")), F.lit(True))


def case_folded(text: Column) -> Column:
    """Full case folding, one character to several where that is its folding; like str.casefold()."""
    return F.when(text.isNotNull(), _icu("lang.UCharacter", "foldCase", text))


def compatible(text: Column) -> Column:
    """The text in normal form NFKC."""
    return F.when(text.isNotNull(), _icu("text.Normalizer", "compose", text))


def folded_digest(text: Column, compatibility: bool = False, native: bool = False) -> Column:
    """SHA-256 of the squeezed, case-folded text (NFKC-normalized first if ``compatibility``), all on the JVM.

    ASCII text, where folding is plain lower-casing and NFKC changes nothing, takes the short way. ``native`` uses lower()
    for every row.
    """
    plain = F.sha2(F.lower(squeeze(text)), 256)
    if native:
        return plain
    folded = squeeze(case_folded(compatible(text))) if compatibility else case_folded(squeeze(text))
    return F.when(is_ascii(text), plain).otherwise(F.sha2(folded, 256))


# Control characters whose JSON escape has a letter in it (written in lower case).
_LETTERED_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def json_string(text: Column) -> Column:
    """The text as a JSON string literal: non-ASCII kept, control escapes in lower-case hex."""
    listed = F.to_json(F.array(text))
    quoted = F.substr(listed, F.lit(2), F.length(listed) - 2)
    lowered = quoted
    for code in _LETTERED_ESCAPES:
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}"
        )
    return F.when(text.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), lowered).otherwise(quoted)


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """A JSON object from already encoded values, in the given order."""
    parts: list[Column] = []
    for i, (key, value) in enumerate(pairs):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{key}": '), value]
    return F.concat(*parts, F.lit("}"))


def json_list(items: Column, encode) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, encode), ", "), F.lit("]"))


def digest_keys(rows: DataFrame, digest: Column, *carried: str) -> DataFrame:
    """Narrow (carried..., digest) rows behind one exchange by task_id.

    Texts are read and hashed once however often the result is used: the explode keeps the digest from being copied
    into filters, and with the NULLs already gone every use has the same plan below the exchange, which Spark then
    runs a single time. task_id is unique, so the exchange is even whatever the texts are.
    """
    return (
        rows.select("task_id", *carried, settled(digest).alias("digest"))
        .where("task_id IS NOT NULL AND digest IS NOT NULL")
        .repartition("task_id")
    )
