"""Splitting oversized texts at natural boundaries with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that part words.
WORD_GAP = r" \t\n\r\f"

UNITS = ("palabras", "caracteres")


def unit_count(text: Column, unit: str) -> Column:
    """Length of a text in words (runs without white space) or code points; null for null."""
    if unit == "palabras":
        return F.regexp_count(text, F.lit(f"[^{WORD_GAP}]+"))
    if unit == "caracteres":
        return F.length(text)
    raise ValueError(f"unit must be one of {UNITS}")


def _endings() -> list[str]:
    """Look-behind conditions for the end of a piece, the strongest boundary first."""
    closing = r"[\"'”»)\]]"
    return [
        r"(?:(?<=\n[ \t]{0,8}\r?\n)|(?<=\n\r\n)|(?<=\r\r)|(?<=\f)|\z)",  # paragraph
        r"(?:(?<=[\n\r])|(?<=[;:][ \t]))",  # line or item
        rf"(?<=[.!?…]{closing}{{0,2}}[ \t ]{{1,4}})",  # sentence
        rf"(?<=[{WORD_GAP}])",  # word
    ]


#: Units of a block, the step by which the counts of a pattern grow: the matcher recurses once for each block at most.
BASE = 64


def _counted(unit: str, most: int, end: str) -> str:
    """``most`` units or fewer, the most first, and then ``end``: counts are written in blocks of ``BASE``, so that no run recurses by unit."""
    level = 0
    while BASE ** (level + 1) <= most:
        level += 1
    if level == 0:
        return f"{unit}{{0,{most}}}{end}"
    size = BASE**level
    whole, rest = divmod(most, size)
    lower = "".join(f"(?>{unit}{{{BASE**k}}}){{0,{BASE - 1}}}" for k in range(level - 1, 0, -1)) + f"{unit}{{0,{BASE - 1}}}{end}"
    return f"(?:(?>{unit}{{{whole * size}}}){_counted(unit, rest, end)}|(?>{unit}{{{size}}}){{0,{whole - 1}}}{lower})"


def piece_pattern(unit: str, most: int) -> str:
    """A pattern whose successive matches partition a text into pieces of at most ``most`` units.

    Each alternative consumes up to the limit and ends at one kind of boundary; the
    strong ones must fill at least half of the limit, so that a boundary near the
    start makes no tiny piece. The last alternative takes characters as they come.
    An exact count runs in a loop, and counts that may be given back are written in blocks,
    so the depth of the matcher grows with the logarithm of the limit.
    """
    least = max(1, most // 2)
    if unit == "caracteres":
        body = "[\\s\\S]"
    elif unit == "palabras":
        # The gaps before the first word belong to it; a word is never given back in part.
        body = f"(?>[{WORD_GAP}]*+[^{WORD_GAP}]++[{WORD_GAP}]*+)"
    else:
        raise ValueError(f"unit must be one of {UNITS}")
    strong = [f"{body}{{{least}}}{_counted(body, most - least, end)}" for end in _endings()]
    return "|".join([*strong, f"{body}{_counted(body, most - 1, '')}"])


def tail_of(core: Column, unit: str, overlap: int) -> Column:
    """The end of a core that the next piece repeats, beginning where a word begins if one does."""
    if overlap == 0:
        return F.lit("")
    if unit == "palabras":
        words = F.regexp_extract_all(core, F.lit(f"[^{WORD_GAP}]++[{WORD_GAP}]*+"), F.lit(0))
        return let(words, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - overlap + 1, F.lit(1)), F.lit(overlap)), ""))
    last = F.right(core, F.lit(overlap))
    whole = F.regexp_replace(F.right(core, F.lit(overlap + 1)), f"^[^{WORD_GAP}]*[{WORD_GAP}]+", "")
    return F.when(last.rlike(f"[{WORD_GAP}][^{WORD_GAP}]"), F.right(whole, F.lit(overlap))).otherwise(last)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def split_pieces(text: Column, unit: str, most: int, overlap: int) -> Column:
    """An array of structs (piezas, desde, hasta, solape, texto) that covers a text.

    ``desde`` and ``hasta`` are code points from 0, ``solape`` tells how many code
    points at the start repeat the piece before. Matches of a bounded pattern
    partition the text into cores of at most ``most - overlap`` units; each piece
    but the first is preceded by the tail of up to ``overlap`` units of the core
    before it. So no piece exceeds ``most``, and the cores together are the text.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and less than the limit")
    cores = F.regexp_extract_all(text, F.lit(piece_pattern(unit, most - overlap)), F.lit(0))

    def pieces(found: Column) -> Column:
        def piece(core: Column, i: Column) -> Column:
            back = F.when(i > 0, tail_of(F.get(found["cores"], i - 1), unit, overlap)).otherwise(F.lit(""))
            end = F.get(found["ends"], i)
            return let(
                back,
                lambda before: F.struct(
                    F.size(found["cores"]).alias("piezas"),
                    (end - F.length(core) - F.length(before)).cast("int").alias("desde"),
                    end.alias("hasta"),
                    F.length(before).alias("solape"),
                    F.concat(before, core).alias("texto"),
                ),
            )

        return F.transform(found["cores"], piece)

    both = let(cores, lambda cs: F.struct(cs.alias("cores"), running_sums(F.transform(cs, F.length)).alias("ends")))
    return let(both, pieces)


def running_sums(sizes: Column) -> Column:
    """Sums of an array of integers up to each place: by stretches of about the root of its length, so no long array is copied at each step."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def add(state: Column, size: Column) -> Column:
        return let((state["at"] + size).cast("int"), lambda end: F.struct(end.alias("at"), F.concat(state["ends"], F.array(end)).alias("ends")))

    def summed(values: Column) -> Column:
        return F.aggregate(values, none, add, lambda s: s["ends"])

    def by_stretch(width: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), width), lambda at: at <= F.size(sizes))
        inner = F.transform(starts, lambda at: summed(F.slice(sizes, at, width)))
        before = lambda parts: summed(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = lambda parts: let(
            before(parts), lambda sums: F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(sums, i - 1)).otherwise(F.lit(0))))
        )
        return F.flatten(let(inner, moved))

    return let(F.ceil(F.sqrt(F.greatest(F.size(sizes), F.lit(1)))).cast("int"), by_stretch)


def split_oversized(df: DataFrame, record: str, field: str, unit: str, most: int, overlap: int) -> DataFrame:
    """Pieces (id, pieza, piezas, desde, hasta, solape, texto) of every text larger than ``most``.

    Texts within the limit, empty and null ones give no rows. The size is measured
    on the text as stored. Narrow: each row is split where it is read. ``record``
    may repeat; each row is split on its own.
    """
    slim = df.select(F.col(record).alias("id"), F.col(field).alias("__text"))
    large = slim.filter(unit_count(F.col("__text"), unit) > most)
    pieces = large.select("id", split_pieces(F.col("__text"), unit, most, overlap).alias("__pieces"))
    # The outer form adds no filter on the array, which would compute it twice; every large text has pieces.
    return pieces.select("id", F.posexplode_outer("__pieces").alias("__at", "__piece")).select("id", (F.col("__at") + 1).alias("pieza"), "__piece.*")
