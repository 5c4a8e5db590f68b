"""Full-text, substring, vector and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulario.functions.text import fold, tokens
from cartulario.session import spread

K1, B = 1.2, 0.75


def postings(df: DataFrame, record: str, fields: dict[str, Column]) -> DataFrame:
    """Inverted index: (doc, campo, termino, tf), one row per document, field and folded token."""
    parts = F.array(*[F.struct(F.lit(n).alias("campo"), tokens(c).alias("t")) for n, c in fields.items()])
    words = df.select(F.col(record).alias("doc"), F.inline(parts)).select("doc", "campo", F.explode("t").alias("termino"))
    return words.groupBy("doc", "campo", "termino").agg(F.count(F.lit(1)).alias("tf"))


def _hits(df: DataFrame, record: str, fields: dict[str, Column], terms: list[str]) -> DataFrame:
    """Per document: length of each field and frequency of each term in each, computed where the row is read.

    The counts come out of a generator, through which later filters are not pushed: else a
    text would be cut into tokens once for each of them.
    """
    slim = spread(df.select(F.col(record).alias("doc"), *[c.alias(f"__f_{n}") for n, c in fields.items()]))

    def counted(x: Column) -> Column:
        out = []
        for n in fields:
            size = F.size(x[n])
            out.append(size.alias(f"dl_{n}"))
            out += [(size - F.size(F.array_remove(x[n], F.lit(t)))).alias(f"tf_{n}_{i}") for i, t in enumerate(terms)]
        return F.struct(*out)

    cut = F.array(F.struct(*[tokens(F.col(f"__f_{n}")).alias(n) for n in fields]))
    return slim.select("doc", F.inline_outer(F.transform(cut, counted)))


def bm25(df: DataFrame, record: str, fields: dict[str, Column], weights: dict[str, float], terms: list[str], every: bool = False, inside: bool = True) -> DataFrame:
    """Documents with their BM25 score for folded terms: (doc, puntaje), only those that hold one (or, with ``every``, all).

    Weighted fields follow the common variant that multiplies frequencies by weights before
    saturation; lengths are of all fields together. idf is ln(1 + (N - n + 0.5) / (n + 0.5))
    with ``inside``, else ln((N - n + 0.5) / (n + 0.5)) but at least 1e-6. N counts all
    documents, those with null text too. Statistics are one row, so nothing but it is
    shared between tasks; no index is needed for an ad-hoc query, one pass finds and scores.
    """
    terms = list(dict.fromkeys(terms))
    hits = _hits(df, record, fields, terms)
    length = sum((F.col(f"dl_{n}") for n in fields), F.lit(0))
    holds = [sum((F.col(f"tf_{n}_{i}") for n in fields), F.lit(0)) for i in range(len(terms))]
    stats = hits.agg(F.count(F.lit(1)).alias("__n"), F.avg(length).alias("__avg"), *[F.count_if(h > 0).alias(f"__df{i}") for i, h in enumerate(holds)])
    joined = hits.join(F.broadcast(stats))
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf = sum((F.col(f"tf_{n}_{i}") * F.lit(float(weights.get(n, 1.0))) for n in fields), F.lit(0.0))
        ratio = (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5)
        idf = F.log(1 + ratio) if inside else F.greatest(F.log(ratio), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("__avg")))
    matched = F.lit(every)
    for h in holds:
        matched = (matched & (h > 0)) if every else (matched | (h > 0))
    return joined.filter(matched).select("doc", score.alias("puntaje"))


def all_then_any(df: DataFrame, record: str, fields: dict[str, Column], weights: dict[str, float], terms: list[str], k: int) -> DataFrame:
    """The best ``k`` documents that hold every term; if none does, the best that hold any."""
    scored = bm25(df, record, fields, weights, terms)
    full = bm25(df, record, fields, weights, terms, every=True)
    any_full = full.agg((F.count(F.lit(1)) > 0).alias("__full"))
    marked = scored.join(full.select("doc", F.lit(True).alias("__all")), "doc", "left").join(F.broadcast(any_full))
    return marked.filter(~F.col("__full") | F.col("__all")).select("doc", "puntaje").orderBy(F.desc(F.round("puntaje", 9)), "doc").limit(k)


def trigrams(text: Column) -> Column:
    """The distinct folded three-character pieces of a text."""
    f = fold(text)
    n = F.length(f)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(f, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_index(df: DataFrame, record: str, text: str) -> DataFrame:
    """Rows (trigrama, doc) from which substring searches take candidates."""
    return df.select(F.col(record).alias("doc"), F.explode(trigrams(F.col(text))).alias("trigrama"))


def substring_search(df: DataFrame, record: str, text: str, needles: list[str]) -> DataFrame:
    """Documents that hold one of the needles of at least three characters, folded: (doc, aguja)."""
    wanted = F.array(*[fold(F.lit(n)) for n in needles if len(n) >= 3])
    held = F.filter(wanted, lambda n: F.contains(fold(F.col(text)), n))
    return df.select(F.col(record).alias("doc"), F.explode(held).alias("aguja"))


#: Buckets of a written index: a query reads those of its terms only.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(index: DataFrame, term: str, record: str, folder: str) -> None:
    """An index of terms (postings or trigrams) as Parquet files by bucket of the term, sorted by term within each file.

    A bucket is cut into as many files as tasks hold its rows: rows are spread by term and
    record, so a term of most rows is written by many tasks.
    """
    cut = index.withColumn("cubo", _bucket(F.col(term))).withColumn("__part", F.pmod(F.xxhash64(record), F.lit(8)))
    spread_ = cut.repartition("cubo", "__part").sortWithinPartitions("cubo", term, record).drop("__part")
    spread_.write.mode("overwrite").partitionBy("cubo").parquet(folder)


def indexed_rows(spark: SparkSession, folder: str, term: str, terms: list[str]) -> DataFrame:
    """The rows of a written index for some terms: other buckets are not opened, and of the files' row groups only those whose terms fit."""
    wanted = list(dict.fromkeys(terms))
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(_bucket(F.col("t"))).distinct().collect()] if wanted else []
    return spark.read.parquet(folder).filter(F.col("cubo").isin(*buckets) & F.col(term).isin(*wanted)).drop("cubo")


def indexed_substring(spark: SparkSession, folder: str, texts: DataFrame, record: str, text: str, needle: str) -> DataFrame:
    """(doc) of the texts that hold a needle of at least three letters, folded: candidates hold all of its trigrams by the index, and only they are read and verified."""
    grams = [r.g for r in spark.createDataFrame([(needle,)], "n string").select(F.explode(trigrams(F.col("n"))).alias("g")).collect()]
    if not grams:
        raise ValueError("a needle has at least three letters")
    rows = indexed_rows(spark, folder, "trigrama", grams)
    held = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("doc")
    near = texts.select(F.col(record).alias("doc"), F.col(text).alias("__t")).join(held, "doc")
    return near.filter(F.contains(fold("__t"), fold(F.lit(needle)))).select("doc").distinct()


def dense_top(queries: DataFrame, base: DataFrame, record: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """The ``k`` base vectors of highest cosine for each query: (consulta, doc, coseno, rango), exact.

    Queries and base meet in blocks: each base block finds the best ``k`` for every query
    of a query block by one matrix product, then the winners of all blocks are merged. Zero,
    null and non-finite vectors, those of null ids, and those of another length than a query's, match nothing. A
    query is no neighbour of itself. Ties go to the smaller id.
    """

    def sized(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(record).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        parts = max(1, -(-rows.count() // block))
        return rows.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias(name)), parts

    (q, nq), (b, nb) = sized(queries, "qb"), sized(base, "bb")
    q = q.withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"consulta": [], "doc": [], "coseno": []}
        if len(left) and len(right):
            (qi, qm), (bi, bm) = _unit(left), _unit(right)
            if len(qi) and len(bi):
                score = np.round(qm @ bm.T, 6)
                score[qi[:, None] == bi[None, :]] = -9
                for row, i in zip(score, qi):
                    best = np.lexsort((bi, -row))[:k]
                    best = best[row[best] > -9]
                    out["consulta"] += [i] * len(best)
                    out["doc"] += bi[best].tolist()
                    out["coseno"] += row[best].tolist()
        return pd.DataFrame(out).astype({"consulta": "int64", "doc": "int64", "coseno": "float64"})

    keys = ["qb", "bb", "d"]
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, "consulta long, doc long, coseno double")
    w = Window.partitionBy("consulta").orderBy(F.desc("coseno"), "doc")
    return found.withColumn("rango", F.row_number().over(w)).filter(F.col("rango") <= k)


def _unit(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    m = np.array(rows["v"].tolist(), np.float64)
    norm = np.linalg.norm(m, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows["id"].to_numpy()[good], m[good] / norm[good, None]


def hash_embedding(df: DataFrame, record: str, text: str, width: int = 384) -> DataFrame:
    """Vectors of texts without a model: (doc, vector), words and letter trigrams hashed to signed places, length one.

    Each folded word adds twelve signs of one, each letter trigram four of a half, at places
    drawn from its MD5; an empty or null text gives zeros.
    """

    def places(token: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        import hashlib

        seed = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "little")
        rng = np.random.RandomState(seed)
        return rng.randint(0, width, n), rng.randint(0, 2, n) * 2 - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}

        def part(token: str, n: int, size: float) -> np.ndarray:
            if token not in known:
                if len(known) > 50_000:
                    known.clear()
                v = np.zeros(width)
                at, sign = places(token, n)
                np.add.at(v, at, sign * size)
                known[token] = v
            return known[token]

        for frame in frames:
            out = []
            for words in frame["w"]:
                v = np.zeros(width)
                for w in words:
                    v = v + part("w:" + w, 12, 1.0)
                    for i in range(len(w) - 2):
                        v = v + part("t:" + w[i : i + 3], 4, 0.5)
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.DataFrame({"doc": frame["doc"], "vector": out})

    kind = df.schema[record].dataType.simpleString()
    return df.select(F.col(record).alias("doc"), tokens(F.col(text)).alias("w")).mapInPandas(run, f"doc {kind}, vector array<float>")


def fused(first: DataFrame, second: DataFrame, key: str, rank: str, weights: tuple[float, float] = (0.6, 0.4), constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: (key, rango_a, rango_b, puntaje); what is missing from a list adds nothing."""
    a = first.select(F.col(key).alias("__a"), F.col(rank).alias("rango_a"))
    b = second.select(F.col(key).alias("__b"), F.col(rank).alias("rango_b"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    score = F.coalesce(weights[0] / (constant + F.col("rango_a")), F.lit(0.0)) + F.coalesce(weights[1] / (constant + F.col("rango_b")), F.lit(0.0))
    return both.select(F.coalesce("__a", "__b").alias(key), "rango_a", "rango_b", score.alias("puntaje"))


def word_overlap(df: DataFrame, record: str, text: str, query: str, phrase: float = 5.0) -> DataFrame:
    """Documents by ten times the Jaccard similarity of their words of three letters or more with a query's, plus a bonus for the phrase."""
    long = lambda c: F.array_distinct(F.filter(tokens(c), lambda w: F.length(w) >= 3))
    q, d = long(F.lit(query)), F.col("__w")
    slim = df.select(F.col(record).alias("doc"), F.col(text).alias("__x"), long(F.col(text)).alias("__w"))
    common = F.size(F.array_intersect(d, q))
    score = 10 * common / (F.size(d) + F.size(q) - common) + F.when(F.contains(fold(F.col("__x")), fold(F.lit(query))), phrase).otherwise(0.0)
    return slim.filter(common > 0).select("doc", score.alias("puntaje"))
