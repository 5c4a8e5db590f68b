"""Column functions on text: folding, slugs, cleaning, sizes, passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and the plain letters that stand for them, place by place.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncy"

#: Words that carry no content in titles and queries.
STOP_WORDS = ("a", "al", "ante", "con", "de", "del", "el", "en", "la", "las", "lo", "los", "o", "para", "por", "que", "se", "sin", "su", "un", "una", "y")


def fold(text: Column) -> Column:
    """Lower case without accents, character for character, so that offsets survive; null for null."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, joint: str = "-") -> Column:
    """Folded letters and digits, other runs as one joint, none at the ends; an identifier part."""
    dashed = F.regexp_replace(fold(text), "[^a-z0-9]+", joint)
    return F.regexp_replace(dashed, f"^{joint}|{joint}$", "")


def tokens(text: Column) -> Column:
    """Folded words of letters and digits, in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def content_words(text: Column) -> Column:
    """Tokens longer than one character that are no stop words."""
    return F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def legal_text(text: Column) -> Column:
    """Uniform signs for ordinals and numbers, no soft hyphens, words cut at line ends joined, single blanks."""
    out = F.regexp_replace(text, "[º˚]", "°")
    out = F.regexp_replace(out, "­", "")
    out = F.regexp_replace(out, r"([\p{L}])-[ \t]*\r?\n[ \t]*([\p{Ll}])", "$1$2")
    out = F.regexp_replace(out, r"\b[Nn](?:ro|úm|um)?\.?\s*°?\s*(?=\d)", "N° ")
    return squeeze(out)


def mask_emails(text: Column) -> Column:
    """E-mail addresses replaced by a mark."""
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[correo]")


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Tokens of a language model by rule of thumb: 1.3 for each word, cut to an integer."""
    return F.floor(word_count(text) * 13 / 10).cast("long")


def git_blob_id(text: Column) -> Column:
    """The content id that git gives to the UTF-8 bytes of a text."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0")), "UTF-8"), raw))


def summary(text: Column, most: int) -> Column:
    """Prose without headings, cut at the last blank within ``most`` characters if that keeps half of them."""
    prose = squeeze(F.regexp_replace(text, r"(?m)^#.*$", ""))
    head = F.substring(prose, 1, most)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(prose) <= most, prose).when(F.length(cut) * 2 > most, cut).otherwise(head)


def passage(text: Column, needle: Column | str, around: int) -> Column:
    """The stretch of ``around`` characters on both sides of a needle's first folded occurrence; null without one."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    folded = fold(needle)
    at = F.position(folded, fold(text))
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + F.length(folded) + around))


def heading_like(line: Column) -> Column:
    """Whether a line reads as a heading: 4 to 110 characters, no sentence end, a keyword or number first or mostly capitals."""
    s = F.trim(line)
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    keyed = s.rlike(r"(?iu)^(?:#+ |cap[íi]tulo |t[íi]tulo |secci[óo]n |libro |art[íi]culo |[ivxlc]+\.|\d+[.)])")
    return F.length(s).between(4, 110) & ~s.rlike(r"[.;:,]$") & (keyed | ((F.length(letters) > 0) & (upper * 10 > F.length(letters) * 8)))
