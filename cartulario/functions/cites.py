"""Citations in running text: norms with their articles, and roles of rulings, as canonical identifiers.

The grammar reads context on both sides of a number and keeps what it has used from being read
twice, which column expressions cannot say; it runs on Arrow batches, one text at a time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes by the words that follow "código", connectors left out; and short names of bodies of law.
CODES = (
    "civil", "penal", "procedimiento civil", "procedimiento penal", "procesal penal", "trabajo", "tributario", "comercio", "organico tribunales", "sanitario", "aguas", "mineria",
    "aeronautico", "justicia militar", "derecho internacional privado",
)
SIGLAS = {
    "CC": "codigo-civil", "CP": "codigo-penal", "CPC": "codigo-procedimiento-civil", "CPP": "codigo-procesal-penal", "CT": "codigo-trabajo", "COT": "codigo-organico-tribunales", "CPR": "cpr",
}
#: Short names that stand for too much else to count without an article.
UNSURE = ("CC", "CP", "CT")
# Suffixes of article numbers in their order, and the spelt ordinals of transitory provisions.
SUFFIXES = ("bis", "ter", "quater", "quinquies", "sexies", "septies", "octies")
ORDINALS = ("primera", "segunda", "tercera", "cuarta", "quinta", "sexta", "septima", "octava", "novena", "decima")

_LINK = r"(?:(?:de|del|la|las|el|los)\s+)*"
_ACCENTS = str.maketrans({"a": "[aá]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uú]"})
_CODE = r"c[oó]digo\s+" + _LINK + "(?:" + "|".join(r"\s+".join([w.translate(_ACCENTS) for w in c.split()]).replace(r"\s+", r"\s+" + _LINK) for c in sorted(CODES, key=len, reverse=True)) + ")"
_BODY = re.compile(
    rf"""\b(?:(?P<code>{_CODE})\b|(?P<cpr>constituci[oó]n(?:\s+pol[ií]tica)?(?:\s+de\s+la\s+rep[uú]blica)?|carta\s+fundamental)\b
    |(?P<kind>d\.?\s?f\.?\s?l\.?|decreto\s+con\s+fuerza\s+de\s+ley|d\.?\s?l\.?|decreto\s+ley|leyes|ley)\s*(?P<no>n(?:ro|[uú]m(?:ero)?)?\.?\s*[°º]?|[°º])?\s*(?P<num>\d{{1,3}}(?:\.\d{{3}})+|\d{{1,6}})\b)
    |(?P<sigla>\b(?:{"|".join(sorted(SIGLAS, key=len, reverse=True))})\b)""",
    re.X | re.I,
)
_ONE = rf"\d{{1,3}}(?:\.\d{{3}})+(?!\d)|\d{{1,4}}"
_ARTICLE = rf"(?P<n>{_ONE})\s*[°º]?(?:\s*(?P<s>{'|'.join(SUFFIXES)})\b)?(?:[ -]?(?P<l>(?-i:[A-HJ-MO-Z]))\b(?!\.))?(?:\s+(?P<t>transitori[oa]s?)\b)?(?:,?\s*(?:n(?:[uú]mero|[uú]m|ro)?\.?\s*[°º]?|numeral)\s*(?P<k>\d{{1,2}})\b)?"
_ITEM = re.compile(_ARTICLE, re.I)
_HEAD = re.compile(r"\b(?:art[ií]culos?|arts?\.?)\s*(?:n[°º]\s*)?(?=\d)", re.I)
_NEXT = re.compile(r"\s*(?:,|;|\by\b|\be\b|\bo\b|\bu\b|,\s*y\b)\s*(?=\d)", re.I)
_BETWEEN = re.compile(r"(?:,?\s*(?:incisos?\s+(?:\w+|\d+[°º]?)|letras?\s+\w\)?|inc\.\s*\w+))*\s*,?\s*(?:(?:todos|ambos)\s+)?(?:de\s+la|del|de\s+el|de|,)?\s*$", re.I)
_BACK = re.compile(r"[\s,(:]*(?:en\s+(?:su|sus|el|los)\s+|su\s+|sus\s+|el\s+|los\s+)?$", re.I)
_ON = re.compile(rf"\s*(?:,\s*y\b|,|\by\b|\be\b)\s*(?=(?:{_ONE})[°º]?\s*(?:{'|'.join(SUFFIXES)})?\s*(?:de\s+la|del|de)\s)", re.I)
_TRANSITORY = re.compile(rf"\bdisposici[oó]n\s+({'|'.join(ORDINALS)})\s+transitoria\b", re.I)


@dataclass
class Body:
    start: int
    end: int
    key: str
    alone: bool
    used: bool = False


def normal(text: str) -> str:
    """A text with uniform signs, words cut at line ends joined, and white space as single blanks."""
    text = unicodedata.normalize("NFKC", text.replace("º", "°").replace("ª", "°"))
    text = re.sub(r"(?<=[^\W\d_])[-­]\s*\n\s*(?=[^\W\d_])", "", text)
    return re.sub(r"\s+", " ", text)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _key(m: re.Match) -> tuple[str, bool] | None:
    """The body that a match names, and whether it counts without an article."""
    if m["code"]:
        words = [w for w in _plain(m["code"]).split() if w not in ("de", "del", "la", "las", "el", "los")]
        return "-".join(words), True
    if m["cpr"]:
        return "cpr", not m["cpr"][0].islower() or " " in m["cpr"].strip()
    if m["sigla"]:
        return (SIGLAS[m["sigla"]], m["sigla"] not in UNSURE) if m["sigla"].isupper() else None
    number = m["num"].replace(".", "")
    kind = _plain(m["kind"]).replace(".", "").replace(" ", "")
    name = "dfl" if kind in ("dfl", "decretoconfuerzadeley") else "dl" if kind in ("dl", "decretoley") else "ley"
    if name == "ley" and len(number) < 3 and not m["no"]:
        return None
    return f"{name}-{int(number)}", True


def bodies(text: str) -> list[Body]:
    """Bodies of law in a text, in order, none overlapping another: the earlier and then the longer wins."""
    out: list[Body] = []
    for m in _BODY.finditer(text):
        key = _key(m)
        if key:
            out.append(Body(m.start(), m.end(), *key))
    return out


def _article(m: re.Match) -> str:
    number = m["n"].replace(".", "")
    out = number + (f"-{_plain(m['s'])}" if m["s"] else "") + (f"-{m['l'].lower()}" if m["l"] else "")
    return out + ("-transitorio" if m["t"] else "") + (f":n{m['k']}" if m["k"] else "")


def _listed(text: str, at: int) -> tuple[list[str], int]:
    """The articles of a list that begins at a place, and where it ends."""
    found, end = [], at
    while m := _ITEM.match(text, at):
        found.append(_article(m))
        end = m.end()
        step = _NEXT.match(text, end)
        if not step:
            break
        at = step.end()
    return found, end


def norms_in(text: str | None) -> list[tuple[str, int]]:
    """(norm, times) of the norms that a text cites, sorted; articles with their body, bodies alone only where none of their articles is cited there."""
    if not text:
        return []
    text = normal(text)
    known = bodies(text)
    starts = [b.start for b in known]
    counts: Counter = Counter()

    def attach(articles: list[str], body: Body) -> None:
        body.used = True
        counts.update(f"norma:{body.key}:{a}" for a in articles)

    taken: list[tuple[int, int]] = []
    for head in _HEAD.finditer(text):
        articles, end = _listed(text, head.end())
        if not articles:
            continue
        taken.append((head.start(), end))
        i = bisect_right(starts, end - 1)
        after = known[i] if i < len(known) else None
        before = known[i - 1] if i else None
        if after and after.start - end <= 60 and _BETWEEN.fullmatch(text[end : after.start]):
            attach(articles, after)
        elif before and before.end <= head.start() and head.start() - before.end <= 40 and _BACK.fullmatch(text[before.end : head.start()]):
            attach(articles, before)
    for body in list(known):
        # "artículos 6 de la Constitución y 19 del Código Civil": a number that goes on after a body.
        if body.used and (m := _ON.match(text, body.end)):
            articles, end = _listed(text, m.end())
            i = bisect_right(starts, end - 1)
            if articles and i < len(known) and _BETWEEN.fullmatch(text[end : known[i].start]):
                attach(articles, known[i])
    for m in _TRANSITORY.finditer(text):
        i = bisect_right(starts, m.end() - 1)
        if i < len(known) and _BETWEEN.fullmatch(text[m.end() : known[i].start]):
            attach([f"{ORDINALS.index(_plain(m[1])) + 1}-transitorio"], known[i])
    counts.update(f"norma:{b.key}" for b in known if not b.used and b.alone)
    return sorted(counts.items())


_COURT = re.compile(r"(?P<cs>corte\s+suprema|excma\.?\s+corte|\bcs\b)|(?P<tc>tribunal\s+constitucional|\bstc\b|\btc\b)|(?P<ta>(?P<o>primer|segundo|tercer|[123]\s?[°]?)\s?(?:tribunal\s+ambiental|ta\b))|(?P<other>corte\s+de\s+apelaciones|juzgado|\bca\b)", re.I)
_ROLE = re.compile(r"\brol(?:es)?\s*(?:n[°ºro.]*\s*)?(?P<x>(?:[A-Z]-)?\d{1,3}(?:\.\d{3})+-\d{2,4}|(?:[A-Z]-)?\d{1,7}-\d{2,4}|\d{1,3}(?:\.\d{3})+|\d{2,6})\b", re.I)
_BARE = re.compile(r"\b(?:STC|CS)\s+(?:rol\s+)?(?:n[°ºro.]*\s*)?(?P<x>\d{1,3}(?:\.\d{3})+-\d{4}|\d{1,7}-\d{2,4}|\d{2,6})\b")
_LIST = re.compile(r"\s*(?:,|\by\b|\be\b)\s*(?P<x>(?:[A-Z]-)?\d{1,3}(?:\.\d{3})+-\d{2,4}|(?:[A-Z]-)?\d{1,7}-\d{2,4})\b", re.I)


def last_match(pattern: re.Pattern, text: str) -> re.Match | None:
    """The last match of a pattern in a text: the nearest before what follows the text."""
    found = None
    for m in pattern.finditer(text):
        found = m
    return found


def _role_id(number: str, court: re.Match | None) -> str | None:
    bare = number.replace(".", "")
    letter = re.fullmatch(r"([A-Za-z])-(\d+)-(\d{4})", bare)
    if letter:
        if court is None or not court["ta"]:
            return None
        k = {"p": 1, "s": 2, "t": 3}.get(_plain(court["o"])[0]) or int(court["o"][0])
        return f"ta:{k}ta:{letter[1].lower()}-{int(letter[2])}-{letter[3]}"
    if court is None or court["other"] or court["ta"]:
        return None
    first, _, year = bare.partition("-")
    if court["tc"]:
        return f"tc:{int(first)}"
    return f"cs:{int(first)}-{year}" if len(year) == 4 and 1900 <= int(year) <= 2100 else None


def roles_in(text: str | None, before: int = 120, after: int = 60) -> list[tuple[str, int]]:
    """(role, times) of the rulings that a text cites, sorted: the nearest court before the role decides whose it is, else the first one after it."""
    if not text:
        return []
    text = normal(text)
    counts: Counter = Counter()
    used: list[tuple[int, int]] = []
    for pattern in (_BARE, _ROLE):
        for m in pattern.finditer(text):
            if any(a < m.end("x") and m.start("x") < b for a, b in used):
                continue
            court = last_match(_COURT, text[max(0, m.start() - before) : m.start("x")]) or _COURT.search(text[m.end() : m.end() + after])
            at, numbers = m.end(), [m["x"]]
            while more := _LIST.match(text, at):
                numbers.append(more["x"])
                at = more.end()
            ids = [i for i in (_role_id(n, court) for n in numbers) if i]
            if ids:
                used.append((m.start(), at))
                counts.update(ids)
    return sorted(counts.items())


def cited(df: DataFrame, record: str, text: str, what: str = "normas") -> DataFrame:
    """(id, destino, veces): the norms (or, with "roles", the rulings) that each text cites.

    Null, empty and blank texts cite nothing; repeated rows repeat. Narrow: texts are read where they are.
    """
    find = {"normas": norms_in, "roles": roles_in}[what]
    kind = df.schema[record].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, n) for i, t in zip(frame["id"], frame["t"]) for k, n in find(t)]
            yield pd.DataFrame(rows, columns=["id", "destino", "veces"])

    # Ids travel as text, so that a null one does not turn the others into floating point.
    slim = df.select(F.col(record).cast("string").alias("id"), F.col(text).alias("t")).filter("t IS NOT NULL")
    return slim.mapInPandas(run, "id string, destino string, veces int").withColumn("id", F.col("id").cast(kind))


def query_references(query: str) -> list[str]:
    """The identifiers of a query that says hardly anything but one: norms and rulings whose citation is most of its letters."""
    letters = len(re.sub(r"\W", "", query))
    found = [k for k, _ in [*norms_in(query), *roles_in(query)]]
    spent = sum(len(re.sub(r"\W", "", m[0])) for p in (_BODY, _HEAD, _ROLE, _BARE) for m in p.finditer(normal(query))) + sum(c.isdigit() for c in query)
    return found if found and spent >= 0.6 * letters else []


def _code_articles(text: str | None, reach: int = 120) -> list[str]:
    """``<code>:<article>`` for each article with the last code named in the ``reach`` characters before it, and ``ley-<n>`` for each law; sorted, each once."""
    if not text:
        return []
    text = normal(text)
    known = bodies(text)
    out = {b.key for b in known if b.key.startswith(("ley-", "dl-", "dfl-"))}
    for head in _HEAD.finditer(text):
        codes = [b for b in known if b.end <= head.start() and head.start() - b.end <= reach and not b.key.startswith(("ley-", "dl-", "dfl-"))]
        if codes:
            out.update(f"{codes[-1].key}:{a}" for a in _listed(text, head.end())[0])
    return sorted(out)
