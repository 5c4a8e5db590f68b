"""Mapping free-typed values to the entries of a reference list with a BK-tree."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulario.session import spread

#: Given where no entry is meant.
NONE = "sin_clave"

#: Reference lists up to this many entries go to every worker; larger ones are sharded.
BROADCAST_ENTRIES = 20_000

#: Rows whose values a task looks up together.
TOGETHER = 100_000

#: Distinct values that a task remembers before it begins anew; results do not depend on it.
REMEMBERED = 300_000

# How words of courts, rooms and subjects are shortened.
SHORT = {
    "juzgado": ("juzgado", "juz", "jdo", "j"),
    "tribunal": ("tribunal", "trib", "t"),
    "corte": ("corte", "c"),
    "suprema": ("suprema", "sup"),
    "apelaciones": ("apelaciones", "apelac", "a"),
    "garantia": ("garantia", "gtia"),
    "familia": ("familia", "flia"),
    "trabajo": ("trabajo", "trab"),
    "sala": ("sala", "s"),
    "especial": ("especial", "esp"),
    "constitucional": ("constitucional", "const"),
}
# Initials that stand for a whole kind of court, and words that may be left out.
INITIALS = {
    "corte de apelaciones": ("ca", "ica"),
    "juzgado de letras del trabajo": ("jlt", "juzgado del trabajo", "jdo del trabajo"),
    "juzgado de garantia": ("jg",),
    "juzgado de familia": ("jf",),
    "tribunal ambiental": ("ta",),
    "tribunal de defensa de la libre competencia": ("tdlc", "tribunal libre competencia", "trib libre competencia", "trib de defensa libre competencia", "tribunal de la libre competencia"),
    "tribunal constitucional": ("tc",),
    "tribunal pleno": ("pleno",),
    "sala especial de cuentas": ("sala de cuentas",),
    "corte suprema": ("suprema corte", "corte suprema de justicia"),
}
CONNECTORS = ("de", "del", "la", "las", "los", "por", "y", "con", "no")
HONOUR = ("excma", "excmo", "iltma", "iltmo", "ilustrisima", "excelentisima")
ORDINALS = {
    1: ("primer", "primera", "primero"),
    2: ("segundo", "segunda"),
    3: ("tercer", "tercera", "tercero"),
    4: ("cuarto", "cuarta"),
    5: ("quinto", "quinta"),
    6: ("sexto", "sexta"),
    7: ("septimo", "septima"),
    8: ("octavo", "octava"),
    9: ("noveno", "novena"),
    10: ("decimo", "decima"),
}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
#: Words put before or after a subject that are no part of it.
BEFORE = ("materia", "demanda por", "demanda de", "s", "sobre", "asunto")
AFTER = ("y costas", "otros", "y otros", "con costas")

_WORD_OF = {w: n for n, ws in ORDINALS.items() for w in ws}


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read right; a lost second byte gives the likeliest letter."""
    text = text.replace("Ã\ufffd", "Í")
    if not re.search("[ÃÂ]", text):
        return text

    def one(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m[0].encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m[0]

    return re.sub("[ÃÂ][\u0080-¿Œ-Ÿˆ˜–-™]", one, text)


def folded(text: str) -> str:
    """Lower case without accents; everything but letters and digits becomes one space; numbers stand alone."""
    text = repaired(text).replace("º", "° ").replace("ª", "° ").replace("_", " ")
    text = unicodedata.normalize("NFKD", text.lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"[^a-z0-9]+", " ", text)
    # 1er, 2da, 6la: the letters glued to a number, misspelt or not, say nothing, unless they end the text.
    text = re.sub(r"\b(\d+)[a-z]{1,2}\b(?=\s+[a-z0-9])", r"\1", text)
    return " ".join(text.split())


def digits(text: str) -> str:
    """The numbers of a folded text, Roman ones at its start included."""
    return " ".join(sorted(re.findall(r"\d+", text)))


def numbered(text: str) -> str:
    """Roman numerals at the start as digits."""
    head, _, rest = text.partition(" ")
    return f"{ROMAN[head]} {rest}" if rest and head in ROMAN else text


def readings(value: str) -> list[str]:
    """The folded texts under which a typed value is looked up, the plainest first."""
    whole = numbered(folded(value))
    out = [whole]
    head = re.match(r"^\s*([^,:(\-–]+?)\s*(?:[:,(]|\s[-–])\s*(.+?)\s*\)?\s*[.,\-–]*\s*$", repaired(value).replace("\u00a0", " ").replace("_", " "))
    if head:
        left, right = folded(head[1]), folded(head[2])
        if left and right:
            out += [f"{right} {left}", f"{right} de {left}"]
    for text in list(out):
        first, _, rest = text.partition(" ")
        if rest and (first in ("e", "i") or (len(first) >= 4 and any(plain_distance(first, h) <= 2 for h in HONOUR))):
            out.append(rest)
    return [t for t in dict.fromkeys(out) if t]


def trimmed_readings(value: str) -> list[str]:
    """Further readings without the words that people put around a subject."""
    out = []
    for text in readings(value):
        words = text.split()
        for lead in BEFORE:
            n = len(lead.split())
            if len(words) > n and _near(" ".join(words[:n]), lead):
                out.append(" ".join(words[n:]))
        for base in [text, *out]:
            parts = base.split()
            for tail in AFTER:
                n = len(tail.split())
                if len(parts) > n and _near(" ".join(parts[-n:]), tail):
                    out.append(" ".join(parts[:-n]))
    return [t for t in dict.fromkeys(out) if t]


@lru_cache(maxsize=200_000)
def _near(a: str, b: str) -> bool:
    most = 0 if len(b) < 5 else 2 if len(b) < 7 else 3
    return a == b or (abs(len(a) - len(b)) <= most and plain_distance(a, b) <= most)


def plain_distance(a: str, b: str) -> int:
    """Levenshtein distance, the textbook way; for short strings and as a check of the vectorised one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swap_distance(a: str, b: str) -> int:
    """Edits with adjacent swaps counted once: for ranking candidates, not for the tree. Equal ends change nothing and are cut off."""
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    end = 0
    while end < n - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


#: Ways to shorten the words of one name that are written out; of a name with more, typed short words are written long instead.
MOST_WAYS = 64
_LONG_OF = {short: long for long, shorts in SHORT.items() for short in shorts if short != long}


def _ways(text: str) -> list[tuple[str, ...]]:
    return [SHORT.get(w, (w,)) for w in text.split()]


def _many_ways(text: str) -> bool:
    count = 1
    for options in _ways(text):
        count *= len(options)
    return count > MOST_WAYS


def written_long(text: str) -> str:
    """A reading with every shortened word written long."""
    return " ".join(_LONG_OF.get(w, w) for w in text.split())


def forms(name: str) -> set[str]:
    """The folded ways to write a reference entry: its name, shortened words, initials, other numerals."""
    base = numbered(folded(name))
    out = {base}
    for long, shorts in INITIALS.items():
        if long in base:
            out |= {base.replace(long, s).replace(f"{s} de ", f"{s} ") for s in shorts} | {base.replace(long, s) for s in shorts}
    for text in list(out):
        if not _many_ways(text):
            out |= {" ".join(p) for p in itertools.product(*_ways(text))}
    words = base.split()
    for i, w in enumerate(words):
        if len(w) >= 6 and len(words) > 1 and w not in CONNECTORS and w not in _WORD_OF:
            out |= {" ".join([*words[:i], w[:n], *words[i + 1 :]]) for n in range(4, min(len(w), 9))}
    for text in list(out):
        words = text.split()
        links = [i for i, w in enumerate(words) if w in ("de", "del", "la")]
        for gone in [links, *[[i] for i in links]]:
            out.add(" ".join(w for i, w in enumerate(words) if i not in gone))
    for text in list(out):
        parts = text.split()
        for i, w in enumerate(parts):
            if w in _WORD_OF:
                n = _WORD_OF[w]
                rest = [*parts[:i], *parts[i + 1 :]]
                out |= {" ".join([str(n), *rest])}
                if i == 0 and len(rest) > 1 and rest[0] in ("sala", "s"):
                    out |= {" ".join([rest[0], str(n), *rest[1:]]), " ".join([str(n), *rest[1:]]), " ".join([w, *rest[1:]])}
            elif w.isdigit():
                out |= {" ".join([*parts[:i], o, *parts[i + 1 :]]) for o in ORDINALS.get(int(w), ())}
    for text in list(out):
        m = re.fullmatch(r"(\d+) (ta|tc)", text)
        if m:
            out.add(f"{m[1]}{m[2]}")
    return {t for t in out if len(t.replace(" ", "")) >= 2}


def _packed(texts: list[str], width: int) -> np.ndarray:
    raw = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("ascii"), np.uint8)
    return raw.reshape(len(texts), width)


class Strings:
    """Many strings against which one pattern's distance is computed at once."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        self.width = int(self.sizes.max(initial=1))
        self.columns = np.ascontiguousarray(_packed(texts, self.width).T)

    def distances(self, pattern: str, take: np.ndarray) -> np.ndarray:
        """Levenshtein distance of ``pattern`` to the strings ``take``, bit-parallel, 64 letters of the pattern to a word."""
        m, one = len(pattern), np.uint64(1)
        words = -(-m // 64)
        peq = np.zeros((words, 128), np.uint64)
        for i, c in enumerate(pattern):
            peq[i // 64, ord(c)] |= one << np.uint64(i % 64)
        last = [np.uint64(63)] * (words - 1) + [np.uint64((m - 1) % 64)]
        sizes, order = self.sizes[take], None
        if (sizes[:-1] < sizes[1:]).any():
            order = np.argsort(-sizes, kind="stable")
            sizes, take = sizes[order], take[order]
        width = int(sizes[0]) if len(sizes) else 0
        # Strings are in order of length, so the first so many of them reach the column.
        reach = np.searchsorted(-sizes, -np.arange(width), side="left").tolist()
        pv = np.full((words, len(take)), ~np.uint64(0))
        mv = np.zeros((words, len(take)), np.uint64)
        score = np.full(len(take), m, np.int32)
        for j, n in enumerate(reach):
            column = self.columns[j][take[:n]]
            up, down = one, np.uint64(0)
            for w in range(words):
                eq, p, v = peq[w][column], pv[w, :n], mv[w, :n]
                xv = eq | v
                eq = eq | down
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = v | ~(xh | p), p & xh
                up_out, down_out = (ph >> last[w]) & one, (mh >> last[w]) & one
                ph, mh = (ph << one) | up, (mh << one) | down
                pv[w, :n], mv[w, :n] = mh | ~(xv | ph), ph & xv
                up, down = up_out, down_out
            score[:n] += up.astype(np.int32) - down.astype(np.int32)
        if order is None:
            return score
        out = np.empty(len(take), np.int32)
        out[order] = score
        return out


class Tree:
    """BK-trees of forms under Levenshtein distance, one for each set of numbers in them; queries descend in batches.

    What is meant has the same numbers as what is typed, so a text need not descend among others.
    """

    def __init__(self, entries: Iterable[tuple[str, str]]) -> None:
        entries = list(entries)
        owners: dict[str, set[str]] = {}
        for key, name in entries:
            for form in forms(name):
                owners.setdefault(form, set()).add(key)
        self.full = {(numbered(folded(name)), key) for key, name in entries}
        #: Whether some name has more short ways to write it than its forms hold.
        self.shortened = any(_many_ways(name) for name, _ in self.full)
        # A form that several entries share tells nothing, unless it is the full name of one.
        self.owner: dict[str, list[str]] = {f: sorted(k) for f, k in owners.items()}
        self.nodes: list[str] = sorted(self.owner)
        self.longest = max(map(len, self.nodes), default=0)
        self.children: list[dict[int, int]] = [{} for _ in self.nodes]
        parts: dict[str, list[int]] = {}
        for i, form in enumerate(self.nodes):
            parts.setdefault(digits(form), []).append(i)
        #: The roots of the trees by their numbers.
        self.roots = {numbers: part[0] for numbers, part in parts.items()}
        self._grow([(part[0], np.array(part[1:], np.int64)) for part in parts.values()])

    def _grow(self, stack: list[tuple[int, np.ndarray]]) -> None:
        """The trees that adding the nodes one by one would give: of those at one distance the first is the child, the others go below it."""
        strings = Strings(self.nodes)
        while stack:
            node, below = stack.pop()
            if not len(below):
                continue
            d = strings.distances(self.nodes[node], below)
            for edge in np.unique(d).tolist():
                group = below[d == edge]
                self.children[node][edge] = int(group[0])
                stack.append((int(group[0]), group[1:]))

    def within(self, texts: list[str], radius: np.ndarray, numbers: bool = False) -> list[list[tuple[int, int]]]:
        """For each text every node within its radius, as (distance, node); the triangle inequality prunes.

        With ``numbers`` only nodes that have the numbers of the text. A text that is longer than every node by more than its radius is near to none.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        asked = np.flatnonzero(sizes <= self.longest + radius)
        if not self.nodes or not len(asked):
            return found
        asked = asked[np.argsort(-sizes[asked], kind="stable")]
        strings, most = Strings([texts[i] for i in asked.tolist()]), radius[asked]
        everything = np.arange(len(asked))
        if numbers:
            own = np.array([self.roots.get(digits(texts[i]), -1) for i in asked.tolist()])
            stack = [(root, np.flatnonzero(own == root)) for root in np.unique(own[own >= 0]).tolist()]
        else:
            stack = [(root, everything) for root in self.roots.values()]
        while stack:
            node, take = stack.pop()
            d = strings.distances(self.nodes[node], take)
            near = d <= most[take]
            for i, x in zip(asked[take[near]].tolist(), d[near].tolist()):
                found[i].append((x, node))
            for edge, child in self.children[node].items():
                go = take[np.abs(d - edge) <= most[take]]
                if len(go):
                    stack.append((child, go))
        return found


def allowed(text: str) -> int:
    """How many edits a text of its length may hold."""
    n = len(text)
    return 0 if n <= 3 else 1 if n <= 4 else 2 if n <= 9 else 3 if n <= 14 else 4


def believable(text: str, edits: int) -> bool:
    """Whether so many edits, swaps counted once, may be slips in a text of its length."""
    return edits <= (1 if len(text) <= 5 else 2 if len(text) < 16 else 3)


#: What a tree tells of a value: (whether no reading is written exactly so, edits, whether the form is no full name, smallest and largest key of the best).
Rank = tuple[bool, int, bool, str, str]


def ranked_values(tree: Tree, values: list[str]) -> list[Rank | None]:
    """The best rank that a tree has for each value, with the smallest and largest of the keys that share it; None without a match.

    All readings descend in the tree without any edits first; only values of which no reading is
    found so descend again with the edits that their length allows. Ranks of the parts of a
    list, compared, give the rank in the whole list.
    """
    spoken = [list(dict.fromkeys(readings(v) + trimmed_readings(v))) for v in values]
    if tree.shortened:
        spoken = [list(dict.fromkeys([*ts, *map(written_long, ts)])) for ts in spoken]
    hits: dict[str, list[tuple[int, str]]] = {}

    def descend(texts: set[str], radius) -> None:
        asked = sorted(texts)
        for text, found in zip(asked, tree.within(asked, np.fromiter(map(radius, asked), np.int32, len(asked)), numbers=True)):
            hits[text] = [(d, tree.nodes[node]) for d, node in found]

    descend({t for ts in spoken for t in ts}, lambda _: 0)
    exact = [[t for t in ts if hits[t]] for ts in spoken]
    descend({t for ts, e in zip(spoken, exact) if not e for t in ts}, allowed)
    out: list[Rank | None] = []
    for ts, e in zip(spoken, exact):
        best: dict[str, tuple[int, bool]] = {}
        for text in e or ts:
            for d, form in hits[text]:
                if e and d:
                    continue
                edits = d if d < 2 else swap_distance(text, form)
                if not believable(text, edits):
                    continue
                for key in tree.owner[form]:
                    rank = (edits, (form, key) not in tree.full)
                    if key not in best or rank < best[key]:
                        best[key] = rank
        if not best:
            out.append(None)
            continue
        top = min(best.values())
        keys = [k for k, rank in best.items() if rank == top]
        out.append((not e, *top, min(keys), max(keys)))
    return out


def match_values(tree: Tree, values: list[str]) -> list[tuple[str, int]]:
    """The entry (key, distance) that each value means, or (``sin_clave``, -1)."""
    return [(NONE, -1) if r is None or r[3] != r[4] else (r[3], r[1]) for r in ranked_values(tree, values)]


def map_to_canonical(df: DataFrame, record: str, fields: list[str], reference: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Rows (id, campo, valor, clave, distancia) for every value of ``fields`` that is neither null nor blank.

    ``reference`` has ``clave``, ``campo`` and ``nombre``. Its size is checked: up to
    ``broadcast_entries`` it goes to every worker as BK-trees, so that rows stay where
    they are read; beyond that it is cut into shards, each value visits every shard and
    the best of the shards' ranks is kept, ties across shards being ties as within one. A value within the radius of no entry,
    or as near to two, gives ``sin_clave`` and -1. Null and blank values give no row;
    repeated rows give repeated rows; an empty reference leaves all values unmatched.
    """
    kind = df.schema[record].dataType.simpleString()
    pairs = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("valor")) for f in fields])
    # Ids travel as text, so that a null one does not turn the others into floating point.
    values = df.select(F.col(record).cast("string").alias("id"), F.explode(pairs).alias("__v")).select("id", "__v.*")
    values = values.filter(F.col("valor").isNotNull() & F.col("valor").rlike(r"[^\s\u0085\u00a0\u2007\u202f\u200b\ufeff]"))
    entries = reference.select("clave", "campo", "nombre").filter(F.col("clave").isNotNull() & F.col("nombre").isNotNull() & F.col("campo").isin(*fields))
    schema = "id string, campo string, valor string, clave string, distancia int"
    if entries.limit(broadcast_entries + 1).count() <= broadcast_entries:
        rows = sorted((r.campo, r.clave, r.nombre) for r in entries.collect())
        out = spread(values).mapInPandas(_matcher(rows), schema)
    else:
        out = _sharded(values, entries, broadcast_entries)
    return out.withColumn("id", F.col("id").cast(kind))


@lru_cache(maxsize=8)
def field_tree(entries: tuple[tuple[str, str, str], ...], field: str) -> Tree:
    """One tree per worker process, list and field."""
    return Tree([(k, n) for c, k, n in entries if c == field])


def _matcher(rows: list[tuple[str, str, str]]):
    entries = tuple(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], tuple[str, int]] = {}
        held: list[pd.DataFrame] = []
        for frame in itertools.chain(frames, [None]):
            if frame is not None:
                held.append(frame)
                if sum(map(len, held)) < TOGETHER:
                    continue
            # Many values descend together: a node costs the same for one as for thousands.
            wanted: dict[str, dict[str, None]] = {}
            for part in held:
                for pair in zip(part["campo"], part["valor"]):
                    if pair not in known:
                        wanted.setdefault(pair[0], {})[pair[1]] = None
            for name, values in wanted.items():
                known.update(zip(((name, v) for v in values), match_values(field_tree(entries, name), list(values))))
            for part in held:
                got = [known[x] for x in zip(part["campo"], part["valor"])]
                yield part.assign(clave=[k for k, _ in got], distancia=[d for _, d in got])[["id", "campo", "valor", "clave", "distancia"]]
            held = []
            if len(known) > REMEMBERED:
                known.clear()

    return run


def _sharded(values: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """Distinct values visit every shard of the reference in blocks; the nearest winner goes back to the rows."""
    spark = values.sparkSession
    shards = -(-entries.count() // limit) * 2
    blocks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = values.select("campo", "valor").distinct()
    asked = distinct.select("campo", "valor", F.pmod(F.xxhash64("valor"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = entries.select("campo", "clave", "nombre", F.pmod(F.xxhash64("clave"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for field, group in left.groupby("campo", sort=False):
            own = right[right["campo"] == field]
            tree = Tree(list(zip(own["clave"], own["nombre"])))
            texts = group["valor"].tolist()
            rows = [(field, v, *r) for v, r in zip(texts, ranked_values(tree, texts)) if r is not None]
            out.append(pd.DataFrame(rows, columns=columns))
        return pd.concat(out) if out else pd.DataFrame([], columns=columns)

    columns = ["campo", "valor", "aproximado", "distancia", "parcial", "primera", "ultima"]
    kinds = ("string", "string", "boolean", "int", "boolean", "string", "string")
    ranks = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(run, ", ".join(map(" ".join, zip(columns, kinds))))
    # One rank a shard at most: the best of all, and the outermost of the keys that share it.
    best = ranks.groupBy("campo", "valor").agg(F.min(F.struct(*columns[2:5])).alias("r"), F.collect_list(F.struct(*columns[2:])).alias("all"))
    shared = F.filter("all", lambda x: F.struct(*[x[c].alias(c) for c in columns[2:5]]) == F.col("r"))
    ends = best.select("campo", "valor", F.col("r.distancia").alias("distancia"), F.array_min(F.transform(shared, lambda x: x["primera"])).alias("a"), F.array_max(F.transform(shared, lambda x: x["ultima"])).alias("b"))
    merged = ends.filter("a = b").select("campo", "valor", F.struct("distancia", F.col("a").alias("clave")).alias("w"))
    joined = values.join(merged, ["campo", "valor"], "left")
    return joined.select("id", "campo", "valor", F.coalesce("w.clave", F.lit(NONE)).alias("clave"), F.coalesce("w.distancia", F.lit(-1)).alias("distancia"))
