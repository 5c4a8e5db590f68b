"""Column functions on the fields of a record: labels, codes, identifiers of places and people, choices and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulario.functions.text import fold, slug, squeeze

# Ordinals that name rooms, and the number of each; the feminine form ends in a.
ROOM_NUMBERS = {"primera": 1, "segunda": 2, "tercera": 3, "cuarta": 4, "quinta": 5, "sexta": 6}
# Titles before the name of a judge.
HONOURS = r"(?:don|dona|sr|sra|srta|senor|senora|ministro|ministra|abogado integrante|abogada integrante|fiscal judicial)\.?"
# Words by which a title is taken for Spanish.
SPANISH_SMALL = ("de", "del", "la", "el", "los", "las", "en", "y", "por", "para", "una", "un", "con", "sobre")
# Other names of the collections.
COLLECTIONS = {"suprema": "cs", "corte suprema": "cs", "constitucional": "tc", "tribunal constitucional": "tc", "ambiental": "ta", "ambientales": "ta", "doctrina": "doc", "revistas": "doc", "guias": "guia", "biblioteca": "bib"}
# Spanish ordinals up to nine, tens, and the joined forms of eleven and twelve.
_ONES = ("", "primer", "segund", "tercer", "cuart", "quint", "sext", "septim", "octav", "noven")
_TENS = ("", "decim", "vigesim", "trigesim", "cuadragesim", "quincuagesim", "sexagesim", "septuagesim", "octogesim", "nonagesim")
_JOINED = {"undecim": 11, "duodecim": 12}


def ordinal_number(word: Column) -> Column:
    """The number of a Spanish ordinal from 1 to 99, in one word or two, of either gender; null for anything else.

    Tens are joined with ones by any vowel or a blank: decimoprimero, vigésima segunda.
    """
    w = squeeze(fold(word))
    ones = F.lit(None).cast("int")
    for n, stem in reversed([(n, s) for n, s in enumerate(_ONES) if s]):
        ones = F.when(w.rlike(f"(?:^|[ oa]){stem}(?:o|a)?$"), n).otherwise(ones)
    tens = F.lit(None).cast("int")
    for n, stem in reversed([(n, s) for n, s in enumerate(_TENS) if s]):
        tens = F.when(w.rlike(f"^{stem}(?:o|a)?(?: |$|o?(?:{'|'.join(x for x in _ONES if x)}))"), n * 10).otherwise(tens)
    whole = F.lit(None).cast("int")
    for stem, n in _JOINED.items():
        whole = F.when(w.rlike(f"^{stem}(?:o|a)$"), n).otherwise(whole)
    shape = f"^(?:(?:{'|'.join(x for x in _TENS if x)})(?:o|a)?)?[ ]?(?:(?:{'|'.join(x for x in _ONES if x)})(?:o|a)?)?$"
    both = F.coalesce(tens, F.lit(0)) + F.coalesce(ones, F.lit(0))
    return F.coalesce(whole, F.when(w.rlike(shape) & (both > 0), both))


def room_id(room: Column) -> Column:
    """``sala:cs-<k>`` of a room named by its ordinal, else ``sala:<slug>``; null for a blank name."""
    first = F.split(fold(F.trim(room)), " ")[0]
    number = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROOM_NUMBERS.items() for x in pair]), first)
    return F.when(slug(room) != "", F.concat(F.lit("sala:"), F.coalesce(F.concat(F.lit("cs-"), number.cast("string")), slug(room))))


def court_id(court: Column) -> Column:
    """``tribunal:ca-<city>`` of a court of appeals, else ``tribunal:<slug>``; null for a blank name."""
    city = F.regexp_extract(squeeze(fold(court)), r"^(?:c\.? ?a\.?|corte de apelaciones) de (.+)$", 1)
    return F.when(slug(court) != "", F.concat(F.lit("tribunal:"), F.when(city != "", F.concat(F.lit("ca-"), slug(city))).otherwise(slug(court))))


def judge_id(name: Column) -> Column:
    """``ministro:<slug>`` of a name without titles before it; null for a blank name."""
    bare = F.regexp_replace(squeeze(fold(name)), rf"^(?:{HONOURS} )+", "")
    return F.when(slug(bare) != "", F.concat(F.lit("ministro:"), slug(bare)))


def prefixed_id(prefix: str, text: Column) -> Column:
    """``<prefix>:<slug>``; null for a blank text."""
    return F.when(slug(text) != "", F.concat(F.lit(f"{prefix}:"), slug(text)))


def path_id(prefix: str, path: Column) -> Column:
    """``<prefix>:<path>`` without its first folder and ``.md``, blanks as low lines."""
    return F.concat(F.lit(f"{prefix}:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^[^/]*/", ""), r"\.md$", ""), " ", "_"))


def norm_label(identifier: Column) -> Column:
    """How a norm's identifier is written out: "Artículo 12 bis del Código Civil", "Ley N° 19.300"; null for other identifiers."""
    parts = F.split(identifier, ":")
    body, article, item = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    number = F.regexp_extract(body, r"^(?:ley|dfl|dl|ds)-(\d+)", 1)
    grouped = F.regexp_replace(number, r"(\d)(?=(?:\d{3})+$)", "$1.")
    kinds = F.create_map(*[F.lit(x) for pair in {"ley": "Ley N° ", "dfl": "DFL N° ", "dl": "DL N° ", "ds": "DS N° "}.items() for x in pair])
    code = F.initcap(F.regexp_replace(F.regexp_replace(body, "^codigo-", ""), "-", " "))
    name = (
        F.when(body == "cpr", "Constitución Política de la República")
        .when(body.startswith("codigo-"), F.concat(F.lit("Código "), code))
        .when(number != "", F.concat(F.try_element_at(kinds, F.substring_index(body, "-", 1)), grouped))
    )
    shown = F.regexp_replace(F.regexp_replace(article, "-transitorio$", " transitorio"), r"(\d)-", "$1 ")
    head = F.concat(F.lit("Artículo "), shown, F.when(item.isNotNull(), F.concat(F.lit(" N° "), F.regexp_replace(item, "^n", ""))).otherwise(F.lit("")))
    link = F.when(body.startswith("codigo-"), " del ").when(number != "", F.when(body.startswith("ley-"), " de la ").otherwise(" del ")).otherwise(" de la ")
    return F.when(F.get(parts, F.lit(0)) == "norma", F.when(article.isNotNull(), F.concat(head, link, name)).otherwise(name))


def citation_brackets(source: Column, identifier: Column, date: Column, text: Column, most: int = 350) -> Column:
    """``[source, identifier, dd-mm-yyyy] extract``: parts that are missing are left out, the extract ends at its last period beyond half of ``most``."""
    day = F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "dd-MM-yyyy")
    head = F.concat(F.lit("["), F.concat_ws(", ", source, identifier, day), F.lit("]"))
    start = F.substring(squeeze(text), 1, most)
    whole = F.regexp_replace(start, r"(?s)^(.*\.)[^.]*$", "$1")
    cut = F.when(F.length(squeeze(text)) <= most, squeeze(text)).when(start.contains(".") & (F.length(whole) * 2 > most), whole).otherwise(start)
    return F.concat_ws(" ", head, F.nullif(cut, F.lit("")))


def standard_citations(text: Column) -> Column:
    """Laws, roles and tax numbers in one way of writing: "Ley N° 19.300", "Rol N° 1234-2020", "12.345.678-K"; quotes and ellipses as typography has them."""
    out = F.regexp_replace(text, r"\b[Ll]ey\s+(?:[Nn](?:ro|úm)?\.?\s*[°º]?\s*)?(\d{1,2})\.?(\d{3})\b", "Ley N° $1.$2")
    out = F.regexp_replace(out, r"\b[Rr]ol\s+(?:[Nn](?:ro|úm)?\.?\s*[°º]?\s*)?(\d{1,3})\.(\d{3})-(\d{4})\b", "Rol N° $1$2-$3")
    out = F.regexp_replace(out, r"\b[Rr]ol\s+(?:[Nn](?:ro|úm)?\.?\s*[°º]?\s*)?(\d{1,7}-\d{4})\b", "Rol N° $1")
    out = F.regexp_replace(out, r"\b(\d{1,2})\.?(\d{3})\.?(\d{3})-([0-9Kk])\b", "$1.$2.$3-$4")
    out = F.regexp_replace(out, r"\.{3,}", "…")
    return F.regexp_replace(out, r"\"([^\"\n]+)\"", "«$1»")


def spanish_title(titles: Column) -> Column:
    """Of several titles the one with most small words of Spanish, the first of equals; null of none."""
    small = F.array(*map(F.lit, SPANISH_SMALL))
    scored = F.transform(titles, lambda t, i: F.struct((-F.size(F.array_intersect(F.split(F.lower(t), r"\s+"), small))).alias("s"), i.alias("i"), t.alias("t")))
    return F.get(F.array_sort(scored), F.lit(0))["t"]


def opinion_code(text: Column, as_of: int) -> Column:
    """``<letter><number>N<yy>`` codes of opinions from "Dictamen N° E12.345, de 2021": letter, number, and year of four digits; null if it is none.

    A year of two digits is of this century up to ``as_of``'s own, else of the last.
    """
    bare = F.regexp_replace(F.upper(text), r"[.\s°º]", "")
    found = r"^(?:DICTAMEN)?(?:N(?:RO)?)?([A-Z]?)(\d{1,6})(?:,?DE|[-/N])(\d{4}|\d{2})$"
    letter, number, year = (F.regexp_extract(bare, found, g) for g in (1, 2, 3))
    short = year.try_cast("int")
    full = F.when(F.length(year) == 4, short).when(short <= as_of % 100, 2000 + short).otherwise(1900 + short)
    return F.when(number != "", F.concat(letter, number.cast("long").cast("string"), F.lit("N"), full.cast("string")))


def case_id(text: Column, title: Column, as_of: Column) -> Column:
    """``rol-<letter>-<n>-<yyyy>`` if the text names a role, else the day and the title's slug."""
    role = F.lower(F.regexp_extract(text, r"\b([A-Z]-\d{1,7}-\d{4}|\d{1,7}-\d{4})\b", 1))
    return F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("rol-"), role)).otherwise(F.concat_ws("-", F.date_format(as_of, "yyyyMMdd"), F.substring(slug(title), 1, 40)))


def collection_list(text: Column) -> Column:
    """Collections named in a list parted by commas or semicolons: aliases replaced, what is no name left out, each once in order."""
    aliases = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])
    names = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: squeeze(fold(x)))
    known = F.transform(names, lambda x: F.coalesce(F.try_element_at(aliases, x), x))
    return F.array_distinct(F.filter(known, lambda x: x.rlike("^[a-z][a-z0-9_]*$")))


def ordered_union(*lists: Column) -> Column:
    """The values of several arrays, each once, in the order in which they first stand; null arrays and values add none."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, empty) for x in lists])))


def whole_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of a phrase stand in a text one after another as whole words, case and accents aside."""
    import re

    from cartulario.functions.text import ACCENTED, PLAIN

    words = phrase.lower().translate(str.maketrans(ACCENTED, PLAIN)).split()
    return fold(text).rlike(r"(?:^|[^a-z0-9_])" + r"\s+".join(map(re.escape, words)) + r"(?:$|[^a-z0-9_])") if words else F.lit(False)


def version_parts(version: Column) -> Column:
    """The numbers of a version as an array of integers, which compare in order; what is no number counts 0."""
    return F.transform(F.split(F.regexp_replace(F.trim(version), "^[vV]", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def clamped_date(document: Column, card: Column, first: Column, last: Column, slack: int = 60) -> Column:
    """The document's date if it lies from ``slack`` days before the first signature to the last one, else the card's if it does, else the first signature."""
    low = F.date_sub(first, slack)
    return F.coalesce(F.when(document.between(low, last), document), F.when(card.between(low, last), card), first)


def all_in_text(identifiers: Column, text: Column) -> Column:
    """Whether there are identifiers and every one stands in the text, dots and blanks aside in both."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[.\s]", "")
    return F.coalesce((F.size(identifiers) > 0) & F.forall(identifiers, lambda i: F.contains(bare(text), bare(i))), F.lit(False))


def readable_json(line: Column, most: int = 3) -> Column:
    """``key: value`` of the first ``most`` keys of a JSON object, in their order; null for what is no object."""
    pairs = F.map_entries(F.from_json(line, "map<string,string>"))
    return F.array_join(F.transform(F.slice(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""), 1, most), lambda p: F.concat(p["key"], F.lit(": "), p["value"])), ", ")


def area_score(title: Column, text: Column, areas: dict[str, list[str]], within: int = 5000) -> Column:
    """The area with the highest score, the first of equals: 2 for a keyword in the title, else 1 if it is in the first characters of the text; null if no keyword is held."""
    t, body = F.coalesce(fold(title), F.lit("")), F.coalesce(fold(F.substring(text, 1, within)), F.lit(""))
    scores = [sum((F.when(F.contains(t, F.lit(k)), 2).when(F.contains(body, F.lit(k)), 1).otherwise(0) for k in keys), F.lit(0)) for keys in areas.values()]
    best = F.greatest(*scores, F.lit(0))
    out = F.lit(None).cast("string")
    for name, score in reversed(list(zip(areas, scores))):
        out = F.when(score == best, name).otherwise(out)
    return F.when(best > 0, out)


def domain_list(text: Column, domains: dict[str, list[str]], most: int = 3) -> Column:
    """The first ``most`` domains of which a keyword stands in the text, in the order of the domains."""
    t = fold(text)
    held = [F.when(F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(t, k)), F.lit(name)) for name, keys in domains.items()]
    return F.slice(F.array_compact(F.array(*held)), 1, most)


def weighted_words(text: Column, words: list[str], long: int = 8, phrase: int = 3) -> Column:
    """Points of a text for the words of a query: 2 for those of ``long`` letters and more, else 1, and ``phrase`` for all of them in order; 0 if fewer than two of several stand in it."""
    t = F.coalesce(fold(text), F.lit(""))
    hit = sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    points = sum((F.contains(t, F.lit(w)).cast("int") * (2 if len(w) >= long else 1) for w in words), F.lit(0))
    bonus = F.contains(t, F.lit(" ".join(words))).cast("int") * phrase
    return F.when(hit >= min(2, len(words)), points + bonus).otherwise(0)


def variant_hits(title: Column, text: Column, words: list[str]) -> Column:
    """3 for each word in the title and 1 for each in the text, those at most 4; a word counts in either number."""
    forms = lambda w: [w, f"{w}s", f"{w}es"] + ([w[:-1]] if w.endswith("s") else [])

    def held(x: Column) -> Column:
        return sum((F.coalesce(F.exists(F.array(*map(F.lit, forms(w))), lambda v: F.contains(fold(x), v)), F.lit(False)).cast("int") for w in words), F.lit(0))

    return 3 * held(title) + F.least(F.lit(4), held(text))
