"""Column functions on whole records: empties, choices, JSON, references and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_empties(df: DataFrame) -> DataFrame:
    """Empty and blank strings, and empty arrays and maps, as null in every column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.trim(c) != "", c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def first_filled(*columns: Column) -> Column:
    """The first string that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def flattened(df: DataFrame, excluded: tuple[str, ...] = ()) -> Column:
    """All values of a record but those excluded as one text, in the order of the columns; nulls left out."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in excluded]
    return F.concat_ws(" ", *[F.array_join(c, " ") if isinstance(df.schema[n].dataType, T.ArrayType) else c.cast("string") for c, n in zip(kept, [x for x in df.columns if x not in excluded])])


def references(df: DataFrame, record: str, prefixes: tuple[str, ...]) -> DataFrame:
    """(origen, campo, destino): every value of a string or array-of-strings column that begins with one of the id prefixes."""
    pattern = f"^(?:{'|'.join(prefixes)}):"
    parts = []
    for f in df.schema.fields:
        if f.name == record:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            values = F.array(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            values = c
        else:
            continue
        parts.append(_tagged(values, pattern, f.name))
    return df.select(F.col(record).alias("origen"), F.inline(F.flatten(F.array(*parts))))


def _tagged(values: Column, pattern: str, name: str) -> Column:
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v.rlike(pattern), F.lit(False)))
    return F.transform(kept, lambda v: F.struct(F.lit(name).alias("campo"), v.alias("destino")))


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``motivo``, the name of the first rule they break, or null; a rule that is null counts as broken."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.withColumn("motivo", reason)


def marks(**flags: Column) -> Column:
    """The sorted names of the flags that hold, as quality marks."""
    given = F.array(*[F.when(c, F.lit(n)) for n, c in sorted(flags.items())])
    return F.filter(given, lambda x: x.isNotNull())


def scored_labels(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The label whose keywords a folded text holds most of; ties to the first label, none if no keyword is held."""
    from cartulario.functions.text import fold

    folded = fold(text)
    scores = [sum((F.contains(folded, F.lit(k)).cast("int") for k in ks), F.lit(0)) for ks in keywords.values()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(None).cast("string")
    for label, score in reversed(list(zip(keywords, scores))):
        out = F.when(score == best, label).otherwise(out)
    return F.when(best > 0, out)


def json_leaves(text: Column, depth: int = 6) -> Column:
    """(ruta, valor) of every leaf of a JSON object: keys joined by dots, objects opened down to ``depth``; what is no object has none.

    Values that are arrays, or objects further down, stay as they are written.
    """
    kind = "array<struct<ruta:string,valor:string>>"

    def entries(value: Column, prefix: Column) -> Column:
        pairs = F.map_entries(F.from_json(value, "map<string,string>"))
        return F.coalesce(F.transform(pairs, lambda p: F.struct(F.concat(prefix, p["key"]).alias("ruta"), F.coalesce(p["value"], F.lit("")).alias("valor"))), F.array().cast(kind))

    out = entries(text, F.lit(""))
    for _ in range(depth - 1):
        out = F.flatten(F.transform(out, lambda x: F.when(F.trim(x["valor"]).startswith("{"), entries(x["valor"], F.concat(x["ruta"], F.lit(".")))).otherwise(F.array(x))))
    return out
