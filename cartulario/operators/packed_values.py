"""Several values packed in one field, one row per value with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words with which a norm begins. A comma parts two values only before one of them.
NORM_STARTS = (
    "código", "codigo", "cód.", "cod.", "ley", "leyes", "dl", "d.l.", "dfl", "d.f.l.", "ds", "d.s.", "decreto",
    "cpr", "constitución", "constitucion", "reglamento", "reglto.", "auto acordado", "autoacordado", "a.a.", "acta",
    "resolución", "resolucion", "ordenanza", "convención", "convencion", "tratado", "circular", "instructivo",
)

#: Opening quotation marks and the mark that closes each.
QUOTES = {'"': '"', "“": "”", "«": "»"}

_BLANK = r"[\s\u0085\u00a0\u2007\u202f\u200b\ufeff]"


def _starts() -> str:
    words = "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in NORM_STARTS)
    return rf"(?:{words})(?![\p{{L}}\p{{N}}])"


def delimiter_pattern() -> str:
    """Separators outside quotes: marks, line ends, a slash not between digits, a comma before a norm or nothing."""
    comma = rf",(?={_BLANK}*(?:{_starts()}|[,;|·•\n\r\t]|/{_BLANK}|$))"
    return rf"(?iu)[;|·•\n\r\t  \u0085\u000b\f\u001e]|(?<!\d)/|/(?!\d)|{comma}"


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{_BLANK}+|{_BLANK}+$", "")


def _unquoted(value: Column) -> Column:
    """Without the quotes that enclose the whole value; doubled quotes inside are halved."""
    straight = value.rlike(r'(?s)^"(?:[^"]|"")*"$') & (F.length(value) >= 2)
    curly = value.rlike(r"(?s)^“[^“”]*”$") | value.rlike(r"(?s)^«[^«»]*»$")
    inner = value.substr(F.lit(2), F.length(value) - 2)
    return F.when(straight | curly, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(value)


def packed_values(field: Column) -> Column:
    """An array of the values of one packed field, in order, without empty ones.

    The field is split at quotation marks. A fold over the pieces keeps the mark
    that is open and the value that it stands in: pieces within quotes are literal and go on
    with that value, the others are split at delimiters, and each part but the first begins
    a value. A doubled mark closes and opens again, so it stays within its literal. Where a
    quotation mark is never closed, marks are taken as ordinary characters.

    A null field gives an empty array, as does an empty or blank one. Repeated
    values are kept. A norm keeps its articles: a comma before "Art." or a number
    is part of the value.
    """
    marks = "".join(dict.fromkeys([*QUOTES, *QUOTES.values()]))
    pieces = F.split(field, f"(?=[{marks}])|(?<=[{marks}])")
    opens = F.create_map(*[F.lit(x) for pair in QUOTES.items() for x in pair])

    def cut(text: Column) -> Column:
        return F.split(text, delimiter_pattern(), -1)

    def step(state: Column, piece: Column) -> Column:
        outside = state["closer"] == ""
        closer = (
            F.when(outside & piece.isin(*QUOTES), F.try_element_at(opens, piece))
            .when(~outside & (piece == state["closer"]), F.lit(""))
            .otherwise(state["closer"])
        )
        # The first part goes on with the value that is open, each other part begins one.
        parts = F.when(outside & ~piece.isin(*QUOTES), cut(piece)).otherwise(F.array(piece))

        def taken(found: Column) -> Column:
            open_, whole = F.concat(state["open"], F.element_at(found, 1)), F.size(found) == 1
            done = F.when(whole, state["done"]).otherwise(F.concat(state["done"], F.array(open_), F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0)))))
            return F.struct(done.alias("done"), F.when(whole, open_).otherwise(F.element_at(found, -1)).alias("open"), closer.alias("closer"))

        # Through a lambda, so that a piece is cut once.
        return F.transform(F.array(parts), taken)[0]

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("closer"))
    quoted = F.aggregate(pieces, start, step, lambda s: F.when(s["closer"] == "", F.concat(s["done"], F.array(s["open"]))))
    broken = F.coalesce(F.when(field.rlike(f"[{marks}]"), quoted), cut(field))
    values = F.transform(broken, lambda v: _bare(_unquoted(_bare(v))))
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))


def unpack(df: DataFrame, record: str, field: str) -> DataFrame:
    """Rows ``id``, ``posicion`` (from 1) and ``valor`` for each value of ``field``.

    Rows whose field is null, empty, blank or only separators give none; other
    columns, whatever their names, are ignored. Narrow: no shuffle.
    """
    slim = df.select(F.col(record).alias("id"), packed_values(F.col(field)).alias("__values"))
    return slim.select("id", F.posexplode("__values").alias("__at", "valor")).select(
        "id", (F.col("__at") + 1).cast("int").alias("posicion"), "valor"
    )
