"""How demanding each text is to read, by harmonic propagation over a graph of documents and words."""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulario.session import materialize, spread

#: Word nodes: words are hashed to so many, which bounds what is broadcast and what comes back.
BUCKETS = 1 << 18

#: Harmonic rounds after the first spread from the graded texts go on until no share at a word node moves by as much.
TOLERANCE = 1e-3

#: Rounds after which what still moves is told in a warning.
MOST_ROUNDS = 200

#: Graded texts that are clamped at most (those of smallest hash).
MOST_GRADED = 20_000

#: Words that a text must have.
LEAST_WORDS = 60

# Small words that tell three languages apart.
SPANISH = frozenset("el los las y del una con al lo su sus por un en ni ha más fue según sin pero".split())
PORTUGUESE = frozenset("o os não do da em um uma foi já ao das dos à é com sem após pela pelo".split())
ENGLISH = frozenset("the of that was and had by in to under its not a for with did before is".split())

_WORD = re.compile(r"[^\W\d_]+")


def spanish_prose(text: str | None) -> Counter | None:
    """The words of a text in lower case with their counts if it is Spanish prose of at least ``LEAST_WORDS`` words, else None.

    Prose: most of what stands between blanks is words, and small words hold their usual
    part of them; those of Spanish must outnumber those of Portuguese and English.
    """
    if not text:
        return None
    blocks = len(text.split())
    if blocks < LEAST_WORDS:
        return None
    words = Counter(_WORD.findall(text.lower()))
    total = words.total()
    if total < 0.6 * blocks or total < LEAST_WORDS // 2:
        return None
    es, pt, en = (sum(words[w] for w in small) for small in (SPANISH, PORTUGUESE, ENGLISH))
    return words if es >= 0.08 * total and es > pt and es > en else None


#: Bits of a count in a packed entry; larger counts take several entries.
COUNT_BITS = 32 - (BUCKETS - 1).bit_length()


def _bag(words: Counter, nodes: dict[str, int]) -> bytes:
    """Word nodes and counts of one text, one 32-bit number for each."""
    for w in [w for w in words if w not in nodes]:
        nodes[w] = (zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)) << COUNT_BITS
    most = (1 << COUNT_BITS) - 1
    packed = [nodes[w] + n if n <= most else -1 for w, n in words.items()]
    if -1 in packed:
        packed = [nodes[w] + min(most, n - at) for w, n in words.items() for at in range(0, n, most)]
    return np.array(packed, np.uint32).tobytes()


def _bags(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, count) of all words of some texts."""
    packed = np.frombuffer(b"".join(payloads), np.uint32)
    rows = np.repeat(np.arange(len(payloads)), np.array([len(p) // 4 for p in payloads], np.int64))
    return rows, (packed >> COUNT_BITS).astype(np.int64), (packed & ((1 << COUNT_BITS) - 1)).astype(np.int64)


class Scale:
    """Shares of the levels at the word nodes, and how those of texts are evened out.

    A text's raw shares are the mean of those of its known words. Averages shrink toward
    the middle, so a least-squares map, fitted on the graded texts, takes raw shares back
    to whole ones; what a text is made of is then told apart from its mean.
    """

    def __init__(self, levels: list[int]) -> None:
        self.levels = np.array(levels)
        self.value = np.zeros((BUCKETS, len(levels)), np.float32)
        self.known = np.zeros(BUCKETS, bool)
        self.map = np.eye(len(levels) + 1, len(levels))

    def raw(self, payloads: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Mean shares of the known words of each text; even shares where none is known."""
        rows, nodes, counts = bags = _bags(payloads)
        weight = counts * self.known[nodes]
        total = np.bincount(rows, weights=weight, minlength=len(payloads))
        got = np.stack([np.bincount(rows, weights=weight * self.value[nodes, k], minlength=len(payloads)) for k in range(len(self.levels))], 1)
        return np.where(total[:, None] > 0, got / np.maximum(total, 1)[:, None], 1 / len(self.levels)), bags

    def even(self, raw: np.ndarray, grades: np.ndarray) -> None:
        """Fit the map on graded texts, each level weighing the same; a slight ridge keeps it defined for few of them."""
        whole = (grades[:, None] == self.levels).astype(np.float64)
        weight = (whole / np.maximum(whole.sum(0), 1)).sum(1)[:, None]
        x = np.hstack([raw, np.ones((len(raw), 1))])
        spread = max(float(raw.var(0).sum()), 1e-12)
        self.map = np.linalg.solve(x.T @ (weight * x) + 1e-3 * spread * np.eye(x.shape[1]), x.T @ (weight * whole))

    def shares(self, raw: np.ndarray) -> np.ndarray:
        """Shares of the levels in texts, between 0 and 1, adding up to 1."""
        got = np.clip(np.hstack([raw, np.ones((len(raw), 1))]) @ self.map, 1e-6, 1)
        return got / got.sum(1, keepdims=True)


def reading_levels(df: DataFrame, record: str, text: str, graded: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """Rows (doc_id, dificultad, nivel) of every Spanish prose text of at least ``LEAST_WORDS`` words.

    ``graded`` has ``doc_id`` and ``nivel``. Texts and word nodes form a bipartite graph.
    Graded texts are clamped to their grade, as shares of the levels; a word takes the mean of
    the texts that use it, a text the mean of its words, by turns over the whole corpus, and
    each round ends with evening out (see ``Scale``). ``dificultad`` is the mean level by
    shares, ``nivel`` the level with the largest share, the bulk of the text. Other texts (null, empty, short, other
    languages, listings) give no row; repeated rows repeat. Without any graded prose text both
    results are null. Graded rows with null values are not used; of several grades of a
    text the smallest counts. An empty table gives no rows.

    Rounds go on until no share at a word node moves by ``tolerance``; after ``most`` of them a
    warning tells what still moves.

    A round sends one number pair per word node from each task, added up by node; only the
    nodes, bounded by ``BUCKETS``, and the bags of graded texts, bounded by ``MOST_GRADED``,
    reach the driver.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[str, int] = {}
        for batch in batches:
            keep, bags = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = spanish_prose(t)
                if words is not None:
                    keep.append(i)
                    bags.append(_bag(words, nodes))
            if len(nodes) > 500_000:
                nodes.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(bags, pa.binary())], ["doc_id", "bolsa"])

    spark = df.sparkSession
    kind = df.schema[record].dataType.simpleString()
    slim = df.select(F.col(record).alias("doc_id"), F.col(text).alias("__text"))
    bags = materialize(spread(slim).mapInArrow(read, f"doc_id {kind}, bolsa binary"))
    clean = graded.select("doc_id", F.col("nivel").cast("int").alias("nivel")).filter(F.col("doc_id").isNotNull() & F.col("nivel").isNotNull())
    clean = clean.groupBy("doc_id").agg(F.min("nivel").alias("nivel")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_GRADED)
    found = bags.join(F.broadcast(clean), "doc_id").orderBy("doc_id").toArrow()
    if not found.num_rows:
        return bags.select("doc_id", F.lit(None).cast("double").alias("dificultad"), F.lit(None).cast("int").alias("nivel"))
    own, grades = found["bolsa"].to_pylist(), found["nivel"].to_numpy().astype(np.int64)
    levels = sorted(set(grades.tolist()))
    scale = Scale(levels)
    k = len(levels)
    clamps = (grades[:, None] == scale.levels).astype(np.float64)
    rows, nodes, counts = _bags(own)
    weight = np.bincount(nodes, weights=counts, minlength=BUCKETS)
    scale.known = weight > 0
    for j in range(k):
        scale.value[:, j] = np.bincount(nodes, weights=counts * clamps[rows, j], minlength=BUCKETS) / np.maximum(weight, 1)
    scale.even(scale.raw(own)[0], grades)
    clamped = spark.sparkContext.broadcast(dict(zip(found["doc_id"].to_pylist(), clamps)))

    for turn in range(1, most + 1):
        sent = spark.sparkContext.broadcast(scale)

        def add_up(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, fixed = sent.value, clamped.value
            total, sums = np.zeros(BUCKETS), np.zeros((BUCKETS, k))
            for batch in batches:
                raw, (rows, nodes, counts) = now.raw(batch.column(1).to_pylist())
                share = now.shares(raw)
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    if doc in fixed:
                        share[i] = fixed[doc]
                total += np.bincount(nodes, weights=counts, minlength=BUCKETS)
                for j in range(k):
                    sums[:, j] += np.bincount(nodes, weights=counts * share[rows, j], minlength=BUCKETS)
            used = np.flatnonzero(total)
            columns = [pa.array(used), pa.array(total[used]), *[pa.array(sums[used, j]) for j in range(k)]]
            yield pa.RecordBatch.from_arrays(columns, ["nodo", "peso", *[f"s{j}" for j in range(k)]])

        parts = bags.mapInArrow(add_up, "nodo long, peso double, " + ", ".join(f"s{j} double" for j in range(k)))
        sums = parts.groupBy("nodo").agg(F.sum("peso").alias("peso"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()
        at = sums["nodo"].to_numpy()
        before, scale = scale.value, Scale(levels)
        scale.known[at] = True
        for j in range(k):
            # Sums of doubles depend on their order in the last bits only; single precision makes runs agree.
            scale.value[at, j] = sums[f"s{j}"].to_numpy() / sums["peso"].to_numpy()
        scale.even(scale.raw(own)[0], grades)
        sent.unpersist()
        moved = float(np.abs(scale.value - before).max())
        if moved < tolerance:
            break
        if turn == most:
            warnings.warn(f"word nodes still move by {moved:.6f} after {most} rounds", stacklevel=2)
    last = spark.sparkContext.broadcast(scale)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last.value
        for batch in batches:
            share = np.round(now.shares(now.raw(batch.column(1).to_pylist())[0]), 6)
            level = now.levels[share.argmax(1)].astype(np.int32) if len(share) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(share @ now.levels, 5)), pa.array(level)], ["doc_id", "dificultad", "nivel"])

    return bags.mapInArrow(judge, f"doc_id {kind}, dificultad double, nivel int")
