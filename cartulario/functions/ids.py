"""Canonical identifiers of rulings, norms and people, and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulario.functions.text import fold, slug, squeeze

# Letters of a ruling's role and the kind of procedure they stand for.
ROLE_CLASSES = {"C": "civil", "P": "penal", "L": "laboral", "T": "tutela", "R": "reclamacion", "F": "familia"}


def role_class(role: Column) -> Column:
    """The kind of procedure that a role's letter stands for; null if there is none."""
    kinds = F.create_map(*[F.lit(x) for pair in ROLE_CLASSES.items() for x in pair])
    return F.try_element_at(kinds, F.regexp_extract(F.upper(F.trim(role)), r"^([A-Z])-\d+-\d{4}$", 1))


def supreme_id(role: Column) -> Column:
    """``cs:<number>-<year>`` of a role such as "6.647-2019" or "CS 6647-2019"; null for others."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(role), r"^\s*(?:CS|ROL)?\s*(?:N°)?\s*", ""), r"\.", "")
    found = F.regexp_extract(bare, r"^0*(\d{1,7}-\d{4})\s*$", 1)
    return F.when(found != "", F.concat(F.lit("cs:"), found))


def person_id(name: Column, kind: str = "autor") -> Column:
    """``autor:`` and the folded words of a name in order of the alphabet, so that the order in the name is no matter."""
    words = F.filter(F.split(slug(name, "_"), "_"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.concat(F.lit(f"{kind}:"), F.array_join(F.array_sort(F.array_distinct(words)), "_")))


def norm_id(text: Column) -> Column:
    """``norma:<body>[:<article>]`` of one norm as written; null if it names no norm.

    Bodies: codes by name, laws, decrees with force of law, decree laws, supreme decrees,
    court rules and regulations by number or name, ``cpr`` for the constitution.
    """
    s = squeeze(fold(text))
    number = r"\s*n?[°o]?\s*([\d.]+(?:[/-]\d{4})?)"
    article = F.regexp_extract(s, r"\barts?\.?\s*(\d+)", 1)

    def by_number(pattern: str, name: str) -> tuple[Column, Column]:
        found = F.regexp_extract(s, rf"^{pattern}{number}", 1)
        return found != "", F.concat(F.lit(f"{name}-"), F.regexp_replace(F.regexp_replace(found, r"\.", ""), "/", "-"))

    code = F.regexp_extract(s, r"^codigo (?:de[l]? )?(?:la )?([a-z]+(?: de(?: las?)? [a-z]+| [a-z]+(?: de [a-z]+)?)?)(?: arts?\b.*|,.*| \(.*| \|.*|$)", 1)
    rule = F.regexp_extract(s, r"^reglamento (?:de[l]? )?(?:la )?([a-z ]+?)(?: arts?\b.*|,.*| \(.*| \|.*|$)", 1)
    body = F.when(s.rlike(r"^(?:cpr|constitucion)\b"), F.lit("cpr"))
    for pattern, name in (("ley", "ley"), ("d\\.?f\\.?l\\.?", "dfl"), ("d\\.?l\\.?", "dl"), ("(?:decreto supremo|d\\.?s\\.?)", "ds"), ("auto acordado", "aa")):
        there, value = by_number(pattern, name)
        body = body.when(there, value)
    body = body.when(code != "", F.concat(F.lit("codigo-"), F.regexp_replace(code, " ", "-")))
    body = body.when(rule != "", F.concat(F.lit("reglamento-"), F.regexp_replace(rule, " ", "-")))
    return F.when(body.isNotNull(), F.concat(F.lit("norma:"), body, F.when(article != "", F.concat(F.lit(":"), article)).otherwise(F.lit(""))))


def id_kind(identifier: Column) -> Column:
    """What an identifier is of: its part before the first colon."""
    return F.substring_index(identifier, ":", 1)


def parent_id(identifier: Column) -> Column:
    """The identifier of what contains it: without its last part; null at the top."""
    return F.when(F.size(F.split(identifier, ":")) > 2, F.regexp_replace(identifier, ":[^:]*$", ""))


def check_digit(number: Column) -> Column:
    """Modulo-11 check digit: weights 2 to 7 in turn from the right; 11 gives 0 and 10 gives K."""
    figures = F.transform(F.split(F.reverse(F.abs(number).cast("string")), ""), lambda c: c.cast("int"))
    products = F.transform(F.filter(figures, lambda x: x.isNotNull()), lambda x, i: x * (i % 6 + 2))
    rest = F.lit(11) - F.aggregate(products, F.lit(0), lambda a, x: a + x.cast("int")) % 11
    return F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))


def spanish_number(text: Column) -> Column:
    """A number written with dots for thousands and a comma for decimals; null if it is none."""
    bare = F.regexp_replace(text, r"[^0-9.,-]", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")
    return F.when(bare.rlike(r"^-?\d{1,3}(?:\.\d{3})*(?:,\d+)?$|^-?\d+(?:,\d+)?$"), plain.try_cast("double"))
