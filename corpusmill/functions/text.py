"""Column functions on text: cleaning, pre-tokenisation, the byte alphabet, lengths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split patterns; they differ in how digits are grouped.
CLUSTERED = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
SINGLE = CLUSTERED.replace(r"\p{N}{1,3}", r"\p{N}")
#: What Python's str.strip and str.split take for white space: Unicode space and U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"


def clean_text(text: Column, drop_controls: bool = True, normalize_newlines: bool = True) -> Column:
    """Drops control characters, unifies line ends, folds three or more of them to two, strips; null gives ''.

    The class of control characters and the rule for line ends are fixed values.
    """
    out = F.coalesce(text, F.lit(""))
    if drop_controls:
        out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if normalize_newlines:
        out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def is_valid_document(cleaned: Column, min_chars: int = 50) -> Column:
    return F.length(strip(cleaned)) >= min_chars


def pre_tokenize(text: Column, digit_mode: str = "clustered", pattern: str | None = None) -> Column:
    """The chunks of a text; a pattern of one's own overrides the digit mode."""
    if digit_mode not in ("clustered", "single"):
        raise ValueError(f"unknown digit mode: {digit_mode}")
    chosen = pattern or (CLUSTERED if digit_mode == "clustered" else SINGLE)
    return F.regexp_extract_all(text, F.lit(f"(?U){chosen}"), F.lit(0))


def byte_alphabet() -> list[str]:
    """The letter of each byte: printable Latin-1 stands for itself, the rest is numbered from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _moved() -> tuple[str, str]:
    letters = byte_alphabet()
    moved = [b for b in range(256) if letters[b] != chr(b)]
    return "".join(map(chr, moved)), "".join(letters[b] for b in moved)


def letter_tables() -> tuple[str, str]:
    """(letters, bytes as Latin-1) for translate(): all letters that do not stand for themselves."""
    raw, letters = _moved()
    return letters, raw


def to_byte_letters(text: Column) -> Column:
    """One letter per UTF-8 byte."""
    raw, letters = _moved()
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), raw, letters)


def from_byte_letters(letters_column: Column) -> Column:
    """The text of byte letters; what is no UTF-8 becomes U+FFFD. (translate() would delete NUL, hence the replace.)"""
    raw, letters = _moved()
    back = F.replace(F.translate(letters_column, letters[1:], raw[1:]), F.lit(letters[0]), F.lit("\0"))
    return F.make_valid_utf8(F.encode(back, "ISO-8859-1").cast("string"))


def symbols_of(letters_column: Column) -> Column:
    """Each letter between U+0002 and U+0003, so that a merge is one plain replacement."""
    return F.regexp_replace(letters_column, "(?s)(.)", "\x02$1\x03")


def split_symbols(symbols: Column) -> Column:
    return F.split(F.substring(symbols, F.lit(2), F.length(symbols) - 2), "\x03\x02")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def word_count(text: Column) -> Column:
    """Number of words between runs of white space (Unicode, with U+001C..U+001F)."""
    return F.size(F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")).cast("long")


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first differing character, the shorter length if one begins the other, null if equal."""
    one, two = F.split(a, ""), F.split(b, "")
    at = F.array_position(F.zip_with(one, two, lambda x, y: ~x.eqNullSafe(y)), True) - 1
    least = F.least(F.length(a), F.length(b))
    return F.when(a == b, F.lit(None).cast("long")).otherwise(F.least(F.when(at >= 0, at).otherwise(least), least).cast("long"))


def ratio(a: Column, b: Column, digits: int = 4, scale: float = 1.0) -> Column:
    return F.when(b > 0, F.round(a / b * scale, digits)).otherwise(F.lit(0.0))


def format_bytes(n: Column) -> Column:
    """1536 -> 1.50 KB"""
    out = F.concat(F.format_number(n / 1024.0**4, 2), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.format_number(n / 1024.0**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def vocab_label(size: Column) -> Column:
    """32000 -> 32k"""
    return F.when(size >= 1000, F.concat((F.floor(size / 1000)).cast("string"), F.lit("k"))).otherwise(size.cast("string"))


def run_name(name: Column) -> Column:
    """Lower case, trimmed, spaces and slashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), "[ /]", "_")


def repo_name(run: Column) -> Column:
    """The name a run is published under: without its time stamp (8 and 6 digits), lower case, dashes."""
    return F.lower(F.replace(F.regexp_replace(run, r"^\d{8}_\d{6}_", ""), F.lit("_"), F.lit("-")))


def shown_number(n: Column, whole: bool = True) -> Column:
    """1234567 -> 1,234,567; numbers that are not whole with four decimals."""
    return F.format_number(n, 0 if whole else 4)


def shown_bytes(n: float) -> str:
    """format_bytes() of a number on the driver."""
    unit = next((k for k in range(4) if n < 1024.0 ** (k + 1)), 4)
    return f"{n / 1024.0**unit:.2f} {('B', 'KB', 'MB', 'GB', 'TB')[unit]}"
