"""Repair of texts that come from scanned pages, by sequence labelling of their lines."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulario.session import materialize, spread

#: The most frequent words and running lines, so many of them, go to every worker; what texts hold of further ones is joined to them.
LEXICON = 200_000
KNOWN_LINES = 50_000

#: Characters of the texts that ask for further words and lines together.
PACK = 1 << 22

#: Rounds of training, each over all texts.
ROUNDS = 4

#: Texts whose lines are labelled together.
TOGETHER = 512

#: Texts in which a short line must stand to be known as a running one.
LINE_TEXTS = 3

#: A word is misread if a confusion away there is one this many times as frequent.
RATIO = 8

# The signs at a cut word's end, and what scanners take one letter group for (misread, true).
CUT_SIGNS = "-‐¬=­–"
SURE_SIGNS = "‐¬=­"
CONFUSIONS = (
    ("c", "e"), ("ri", "n"), ("f", "t"), ("1", "i"), ("1", "l"), ("1", "í"), ("@", "a"), ("0", "o"), ("0", "ó"), ("ii", "u"), ("cl", "d"), ("5", "s"), ("rn", "m"),
    ("d", "ci"), ("d", "cl"), ("h", "li"), ("6", "b"), ("6", "ó"), ("6", "é"), ("6", "o"), ("9", "g"), ("9", "q"), ("y", "v"), ("f", "í"), ("g", "q"), ("fi", "ñ"),
    ("8", "b"), ("3", "e"), ("4", "a"), ("li", "h"), ("in", "m"), ("vv", "w"), ("l", "i"), ("tí", "ti"),
)

BODY, HEADER, FOLIO, BREAK, TITLE = range(5)
LABELS = ("cuerpo", "encabezado", "folio", "corte", "titulo")

_LINE = re.compile(r"\r\n|\r|\n")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+(?:@[^\W_]*)*|(?:@[^\W_]*)+")
_NUMBER = r"(?:[0-9lISOoBZ]{0,3}\d[0-9lISOoBZ]{0,3}|[lISO]{1,2}\d{0,2})"
_ROMAN = r"(?=[ivxlcdm])(?:m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3}))"
_FOLIO = re.compile(
    rf"^[•–\-—(\[·|* ]{{0,3}}(?:(?:p[áa]gs?\.?|p[áa]gina|pag|p\.|fs?\.|fojas?|hoja|folio)\s*)?(?:{_NUMBER}|{_ROMAN})(?:\s*(?:de|/)\s*{_NUMBER})?(?:\s*vta\.?)?[•–\-—)\]·|* ]{{0,3}}$",
    re.I,
)
# The words of a written-out number.
_UNITS = "cero uno una un dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil y"
_ONE_WORD = rf"(?:{'|'.join(_UNITS.split())}|dieci\w+|veinti\w+|\w*cient[oa]s|quinient[oa]s)"
_SPELT = re.compile(rf"^(?:(?:fojas?|página|hoja|folio)\s+)?(?!(?:y|un|una|uno)$){_ONE_WORD}(?:\s+{_ONE_WORD})*(?:\s+(?:vta\.?|vuelta))?$", re.I)
_PART = re.compile(r"^(?:\d+\s{2,})?(?:cap[íi]tulo|t[íi]tulo|libro|secci[óo]n|parte)\s+[IVXLC1l]+\b", re.I)
_RANGE_END = re.compile(r"\d\s*[-–]$")
_BARE = re.compile(r"^\d{1,4}$")
_WITH_NUMBER = re.compile(rf"^(?:(?P<a>{_NUMBER})\s{{2,}}(?P<x>\D.*\S)|(?P<y>\S.*?\D)\s{{2,}}(?P<b>{_NUMBER}))$")
_STRUCTURE = re.compile(r"^(?:#|\||[-*•]\s|\(?[a-z0-9]{1,2}\)\s|[IVXLC]+\.\s*$|\d+\.\s)")
_ASIDE = re.compile(r"(?:^|[\s(])[-–][^\W\d_][^-–]*[-–][ \t]*$")
_LAST_WORD = re.compile(r"[^\W\d_]+$")


def plain(text: str) -> str:
    """Upper case without accents, single spaces."""
    text = unicodedata.normalize("NFKD", text.upper())
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def lines_of(text: str) -> list[str]:
    """The lines of a text; a form feed is a line of its own."""
    return _LINE.split(text.replace("\f", "\n\f\n")) if text else []


# Letter groups that scanners take for each other, in capitals, each with one letter that stands for both.
SKELETON = (
    ("RN", "M"), ("RI", "N"), ("FI", "N"), ("II", "U"), ("CL", "D"), ("CI", "D"), ("LI", "H"), ("0", "O"), ("1", "I"), ("L", "I"), ("5", "S"), ("@", "A"), ("6", "B"),
    ("9", "G"), ("C", "E"), ("F", "T"), ("Y", "V"),
)


def skeleton(text: str) -> str:
    """A text under which readings and misreadings of the same line agree."""
    text = plain(text)
    for group, one in SKELETON:
        text = text.replace(group, one)
    return text


def line_key(line: str) -> str:
    """A line as it runs from page to page: without a number beside it."""
    s = line.strip()
    m = _WITH_NUMBER.match(s)
    return skeleton((m["x"] or m["y"]) if m else s)


def running_key(line: str, width: int) -> str | None:
    """The key of a line that might be a running one: short or in capitals, no sentence end, no digit of its own."""
    s = line.strip()
    if not s or len(s) > 110 or s[-1] in ".,;:!?" + CUT_SIGNS or _STRUCTURE.match(s):
        return None
    if not s[0].isupper() and not s[0].isdigit() or not s.isupper() and len(s) > 0.85 * width:
        return None
    m = _WITH_NUMBER.match(s)
    if re.search(r"\b\d+\b", (m["x"] or m["y"]) if m else s) or _SPELT.match(s):
        return None
    key = line_key(s)
    return None if len(key) < 5 else key


def is_open(line: str | None) -> bool:
    """Whether a sentence goes on after the line."""
    return bool(line) and (line[-1].isalnum() or line[-1] in "," + CUT_SIGNS)


def is_folio(line: str, before: str | None) -> bool:
    """Whether a line is nothing but a page or leaf number, its dashes in balance, and no second half of a range."""
    if before and _RANGE_END.search(before):
        return False
    if _SPELT.match(re.sub(r"^[•–\-—(\[·|* ]+|[•–\-—)\]·|* ]+$", "", line)):
        return True
    return bool(_FOLIO.match(line)) and (line[-1] not in "-–—" or line[0] in "-–—")


def width_of(lines: list[str]) -> int:
    """The width at which a text is wrapped: a high quantile of its lines."""
    sizes = sorted(len(x.strip()) for x in lines if x.strip())
    return sizes[int(len(sizes) * 0.8)] if sizes else 0


@dataclass
class Model:
    """What is counted over all texts and trained on them."""

    words: dict[str, int] = field(default_factory=dict)
    keys: set[str] = field(default_factory=set)
    start: np.ndarray | None = None
    move: np.ndarray | None = None
    emit: list[np.ndarray] = field(default_factory=list)


#: Sizes of the features: shape, interruption, repetition in the text, known in the corpus, words of the work or author.
SIZES = (10, 3, 2, 2, 2)


def features(lines: list[str], work: str, known: set[str]) -> np.ndarray:
    """Layout features of each line, one row of small integers per line."""
    n, width = len(lines), width_of(lines)
    strip = [x.strip() for x in lines]
    bare = [bool(_BARE.match(s)) for s in strip]
    full = [i for i, s in enumerate(strip) if s]
    place = {i: p for p, i in enumerate(full)}
    work_words = set(_WORD.findall(skeleton(work)))

    def owned(key: str) -> bool:
        own = _WORD.findall(key)
        hit = sum(w in work_words for w in own)
        return hit >= 2 and hit >= 0.6 * len(own)

    keys: list[str | None] = []
    for x, s in zip(lines, strip):
        key = running_key(x, width) if s else None
        if s and key is None and len(s) <= 1.5 * width:
            # As long as a line of body, but known, or made of the author and the work.
            key = running_key(x, 1000)
            if key and not (key in known or (" — " in s or " · " in s or s.istitle()) and owned(key)):
                key = None
        keys.append(key)
    counts = Counter(k for k in keys if k)
    cutting: set[str] = set()
    out = np.zeros((n, len(SIZES)), np.int64)
    for i, s in enumerate(strip):
        if not s:
            out[i, 0] = 9
            continue
        p = place[i]
        if bare[i] and ((p and bare[full[p - 1]]) or (p + 1 < len(full) and bare[full[p + 1]])):
            shape = 6
        elif is_folio(s, strip[full[p - 1]] if p else None):
            shape = 5
        elif _STRUCTURE.match(s):
            shape = 8
        elif (m := _WITH_NUMBER.match(s)) and len(s) <= 90 and not re.search(r"[.,;]\s", (m["x"] or m["y"])):
            shape = 7
        elif len(s) > 0.8 * width and not keys[i]:
            shape = 0
        elif s[-1] in ".,;:!?)" or s[-1] in CUT_SIGNS:
            shape = 1
        elif s.isupper() and len(s) >= 4:
            shape = 4
        elif s[0].isupper():
            shape = 3
        else:
            shape = 2
        out[i, 0] = shape
    before, last = {}, None
    for i in full:
        before[i] = last
        if out[i, 0] in (0, 1, 2, 8):
            last = i
    after, last = {}, None
    for i in reversed(full):
        after[i] = last
        if out[i, 0] in (0, 1, 2, 8):
            last = i
    for i in full:
        a, b = before[i], after[i]
        open_end = a is not None and is_open(strip[a])
        goes_on = b is not None and strip[b][0].islower()
        out[i, 1] = int(open_end) + int(goes_on)
        k = keys[i]
        if k:
            if out[i, 1] == 2:
                cutting.add(k)
            out[i, 3] = k in known
            out[i, 4] = owned(k) or bool(_PART.match(strip[i]))
    for i in full:
        # Repeated, and at least once where it cuts a sentence.
        out[i, 2] = keys[i] is not None and counts[keys[i]] > 1 and keys[i] in cutting
        if out[i, 0] == 3 and not out[i, 2:].any():
            out[i, 0] = 2  # a short line of body before a long word, or a paragraph's last
    return out


def first_guess(f: np.ndarray) -> np.ndarray:
    """Labels from which training starts."""
    shape, cut, rep, known, own = f.T
    label = np.full(len(f), BODY)
    label[shape == 9] = BREAK
    label[(shape == 6) | (shape == 8)] = TITLE
    label[shape == 5] = FOLIO
    label[shape == 7] = HEADER
    runs = np.isin(shape, (3, 4))
    label[runs & ((rep + known + own > 0) | (cut == 2))] = HEADER
    label[(shape == 0) & (own + rep * known > 0) & (cut >= 1)] = HEADER
    label[runs & (rep + known + own == 0) & (cut < 2)] = TITLE
    return label


def codes(f: np.ndarray) -> np.ndarray:
    """The features of each line as one number."""
    out = np.zeros(len(f), np.uint8)
    for j, n in enumerate(SIZES):
        out = out * n + f[:, j].astype(np.uint8)
    return out


#: The features of each number that ``codes`` gives, and the label that training starts from.
FEATURES = np.stack(np.unravel_index(np.arange(int(np.prod(SIZES))), SIZES), axis=1)
GUESS = first_guess(FEATURES)


def tallies(texts: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """How often each label begins a text, follows another, and stands with each line number, as one row of numbers."""
    k, n = len(LABELS), len(FEATURES)
    start, move, emit = np.zeros(k, np.int64), np.zeros(k * k, np.int64), np.zeros(k * n, np.int64)
    texts, labels = [t for t in texts if len(t)], [y for y in labels if len(y)]
    if texts:
        y, at = np.concatenate(labels), np.cumsum([0, *map(len, labels)])
        start += np.bincount(y[at[:-1]], minlength=k)
        pairs = y[:-1] * k + y[1:]
        inner = np.ones(max(len(y) - 1, 0), bool)
        inner[at[1:-1] - 1] = False
        move += np.bincount(pairs[inner], minlength=k * k)
        emit += np.bincount(y * n + np.concatenate(texts), minlength=k * n)
    return np.concatenate([start, move, emit])


def estimated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The hidden Markov model of some tallies: logarithms of its start, moves and, for each feature, emissions."""
    k, n = len(LABELS), len(FEATURES)
    start, move, joint = counts[:k] + 0.5, counts[k : k + k * k].reshape(k, k) + 0.5, counts[k + k * k :].reshape(k, *SIZES)
    emit = []
    for j in range(len(SIZES)):
        e = joint.sum(axis=tuple(i + 1 for i in range(len(SIZES)) if i != j)) + 0.05
        emit.append(np.log(e / e.sum(1, keepdims=True)))
    return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), emit


def viterbi(texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest labels of the lines of texts (as numbers of ``codes``), many texts at once, those of like length together."""
    score = sum(e[:, FEATURES[:, j]] for j, e in enumerate(emit)).T
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        sizes = np.array([len(texts[i]) for i in some])
        longest = int(sizes[0])
        lines = np.zeros((longest, len(some)), np.uint8)
        for c, i in enumerate(some):
            lines[: sizes[c], c] = texts[i]
        # Texts are in order of length, so the first so many of them reach the line.
        reach = np.searchsorted(-sizes, -np.arange(longest), side="left")
        best, back = start + score[lines[0]], np.zeros((longest, len(some), len(start)), np.uint8)
        for t in range(1, longest):
            n = int(reach[t])
            ways = best[:n, :, None] + move
            back[t, :n] = ways.argmax(1)
            best[:n] = ways.max(1) + score[lines[t, :n]]
        label = np.zeros((longest, len(some)), np.int64)
        label[sizes - 1, np.arange(len(some))] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            n = int(reach[t])
            label[t - 1, :n] = back[t, np.arange(n), label[t, :n]]
        for c, i in enumerate(some):
            out[i] = label[: sizes[c], c]
    return out


def is_cut(left: str, sign: str, right: str, words: Mapping[str, int]) -> bool:
    """Whether a sign between two line ends parts one word, rather than joining two or closing a remark."""
    a, b = left.lower(), right.lower()
    if not right[0].islower():
        return False
    if sign in SURE_SIGNS or words.get(a + b, 0) >= 2:
        return True
    return not (words.get(a, 0) >= LINE_TEXTS and words.get(b, 0) >= LINE_TEXTS)


def at_cuts(lines: list[str], labels: list[int]) -> set[str]:
    """The words on whose counts the cuts of a text hang, whichever of the cuts before part one word."""
    out: set[str] = set()
    ends: set[str] = set()
    sign = ""
    for line, label in zip(lines, labels):
        s = line.strip()
        if not s or label in (HEADER, FOLIO):
            continue
        n = _WORD.match(s)
        if ends and n and n[0][0].islower() and sign not in SURE_SIGNS:
            b = n[0].lower()
            out |= {b} | {x for a in ends for x in (a.lower(), a.lower() + b)}
        m = _LAST_WORD.search(s[:-1][-200:]) if s[-1] in CUT_SIGNS else None
        # A line of one word may go on with the one before.
        ends = ({m[0]} | ({(a + s[:-1])[-200:] for a in ends} if n and n[0] == s[:-1] else set())) if m else set()
        sign = s[-1]
    return out


#: A word counts as what was meant, one and two confusions away, if it is more frequent than this.
MEANT = (2, 20)


def may_be_misread(low: str) -> bool:
    return len(low) >= 4 and not low.isdigit() and any(c.isalpha() for c in low)


def cased(right: str | None, word: str) -> str | None:
    return right and (right.upper() if word.isupper() else right.capitalize() if word[0].isupper() else right)


def corrected(word: str, words: Mapping[str, int]) -> str | None:
    """The word that was misread, or None if the word stands as it is. Of equally frequent ones the first in order."""
    low = word.lower()
    own = words.get(low, 0)
    if not may_be_misread(low):
        return None
    best, much = None, max(MEANT[0], RATIO * own)
    once = set(_unread(low))
    for v in once:
        n = words.get(v, 0)
        if n > much or best is not None and n == much and v < best:
            best, much = v, n
    if best is None and len(low) >= 6 and own <= 2:
        much = max(much, MEANT[1])
        for u in once:
            for v in _unread(u):
                n = words.get(v, 0)
                if n > much or best is not None and n == much and v < best:
                    best, much = v, n
    return cased(best, word)


def _unread(word: str) -> Iterator[str]:
    for wrong, right in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            yield word[:at] + right + word[at + len(wrong) :]
            at = word.find(wrong, at + 1)


@dataclass
class Repaired:
    text: str
    kinds: set[str]


class Repairer:
    """Applies a model to texts, one at a time.

    ``counts`` and ``rights``, if given, tell of words that the model leaves out how frequent
    they are and which were misread. The readings of words in the model never hang on others:
    these are no more frequent than any in it.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, str | None] = {}
        self.words: Mapping[str, int] = model.words
        self.rights: Mapping[str, str] | None = None
        self.asked: set[str] | None = None

    def told(self, counts: dict[str, int], rights: dict[str, str]) -> None:
        self.words, self.rights = ChainMap(counts, self.model.words), rights

    def correct(self, token: str) -> str | None:
        if self.rights is not None and (low := token.lower()) not in self.model.words:
            if self.asked is not None and may_be_misread(low):
                self.asked.add(low)
            return cased(self.rights.get(low), token)
        if self.asked is not None:
            return None
        if token not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = corrected(token, self.model.words)
        return self.known[token]

    def _read(self, text: str) -> tuple[str, bool]:
        """The text with misread words put right, and whether there were any."""
        changed = False

        def one(m: re.Match) -> str:
            nonlocal changed
            if not m[0] or m.start() and text[m.start() - 1] == "@" or "@" in text[m.end() : m.end() + 1]:
                return m[0]
            right = self.correct(m[0])
            changed |= right is not None
            return m[0] if right is None else right

        safe = text if "@" not in text else re.sub(r"\S+@\S+\.\S+", lambda m: m[0].replace("@", "\ue000"), text)
        # Most texts hold nothing to put right: each of their words is looked up once.
        if all(self.correct(w) is None for w in set(_TOKEN.findall(safe))):
            return text, False
        out = _TOKEN.sub(one, safe).replace("\ue000", "@")
        return out, changed

    def repair(self, text: str | None, work: str = "") -> Repaired | None:
        """The repaired text and the kinds of noise that were in it; None for a null text."""
        return self.repair_all([text], [work])[0]

    def repair_all(self, texts: list[str | None], works: list[str]) -> list[Repaired | None]:
        """The same for many texts, whose lines are labelled together."""
        lines = [lines_of(t) if t is not None else [] for t in texts]
        rows = [features(x, w, self.model.keys) for x, w in zip(lines, works)]
        labels = viterbi([codes(f) for f in rows], self.model.start, self.model.move, self.model.emit)
        return [None if t is None else self._labelled(t, x, f, y) for t, x, f, y in zip(texts, lines, rows, labels)]

    def _labelled(self, text: str, lines: list[str], f: np.ndarray, y: np.ndarray) -> Repaired:
        kinds: set[str] = set()
        out: list[str] = []
        current, broken, removed = "", False, False
        for line, label, row in zip(lines, y.tolist(), f):
            s = line.strip()
            if label in (HEADER, FOLIO):
                kinds.add("encabezado" if label == HEADER else "folio")
                if row[0] == 7:
                    kinds |= {"encabezado", "folio"}
                kinds |= {"ocr"} if self._read(s)[1] else set()
                removed = True
                continue
            if not s:
                broken = True
                continue
            end = len(current.rstrip(" \t")) - 1
            m = _LAST_WORD.search(current[max(0, end - 200) : end]) if end > 0 and current[end] in CUT_SIGNS and not _ASIDE.search(current[-200:]) else None
            n = _WORD.match(s)
            page = removed and current and (current[-1].isalnum() or current[-1] in "," + CUT_SIGNS) and s[0].islower()
            if current and m and n and (not broken or page) and is_cut(m[0], current[end], n[0], self.words):
                kinds.add("guion")
                current = current[:end] + s
            elif not current:
                current = s
            elif broken and not page or label == TITLE or _STRUCTURE.match(s) or _STRUCTURE.match(current) and label == TITLE:
                out.append(current + ("\n\n" if broken and not page else "\n"))
                current = s
            else:
                current = current + ("" if m and n and current[end] in "-‐" else " ") + s
            broken = removed = False
        whole = "".join(out) + current
        whole, misread = self._read(whole)
        if misread:
            kinds.add("ocr")
        wrapped = len(lines) > 3 and np.mean(f[:, 0] == 0) > 0.4
        return Repaired(whole if kinds or wrapped and width_of(lines) < 120 else text, kinds)


def counted_keys(texts: list[str | None]) -> Counter:
    """(kind, key) counts of words (w), short lines (l) and those that cut a sentence (i), lines once per text.

    The halves of cut words are left out.
    """
    out: Counter = Counter()
    halves = re.compile(rf"[^\W\d_]+[{CUT_SIGNS}][ \t]*(?:\r\n|\r|\n)\s*[^\W\d_]*")
    for text in texts:
        if not text:
            continue
        lines = lines_of(text)
        if len(lines) > 3:
            width, seen, before = width_of(lines), {}, None
            for x in lines:
                k = running_key(x, width)
                if k:
                    seen[k] = seen.get(k, False) or is_open(before)
                before = x.strip() or before
            out.update(("l", k) for k in seen)
            out.update(("i", k) for k, cuts in seen.items() if cuts)
        out.update(("w", w) for w in _WORD.findall(halves.sub(" ", text).lower()))
    return out


def counted_model(df: DataFrame, fields: list[str]) -> tuple[Model, DataFrame | None, DataFrame | None]:
    """A model with the counts over all texts; all words (key, n) and all running lines (key), each only if the model leaves some out.

    The counts are added up in map tasks first; only the most frequent words and lines,
    bounded in number, go to the driver and into the model.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            c = counted_keys([t for f in fields for t in frame[f].tolist()])
            yield pd.DataFrame([(k, v, n) for (k, v), n in c.items()], columns=["kind", "key", "n"])

    counted = spread(df.select(*fields)).mapInPandas(count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    totals = materialize(counted)
    words = totals.filter("kind = 'w'").select("key", "n")
    first = words.orderBy(F.desc("n"), "key").limit(LEXICON + 1).toPandas()
    short = totals.filter("kind <> 'w'").groupBy("key").agg(
        F.sum(F.when(F.col("kind") == "l", F.col("n")).otherwise(0)).alias("all"), F.sum(F.when(F.col("kind") == "i", F.col("n")).otherwise(0)).alias("cuts")
    )
    running = short.filter((F.col("all") >= LINE_TEXTS) & (F.col("cuts") >= 2) & (F.col("cuts") >= 0.25 * F.col("all")))
    lines = running.orderBy(F.desc("cuts"), "key").limit(KNOWN_LINES + 1).select("key").toPandas()
    model = Model(dict(zip(first["key"][:LEXICON].tolist(), first["n"][:LEXICON].tolist())), set(lines["key"][:KNOWN_LINES]))
    return model, words if len(first) > LEXICON else None, running.select("key") if len(lines) > KNOWN_LINES else None


def train(model: Model, texts: DataFrame) -> None:
    """Training by hard expectation and maximisation, each round over all texts (``rasgos``, a byte for a line) of several lines.

    A round sends one row of tallies from each task.
    """
    for turn in range(ROUNDS):
        now = None if turn == 0 else (model.start, model.move, model.emit)

        def tally(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = tallies([], [])
            for frame in frames:
                x = [np.frombuffer(r, np.uint8) for r in frame["rasgos"]]
                total = total + tallies(x, [GUESS[c] for c in x] if now is None else viterbi(x, *now))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "n": total[at]})

        # One row of tallies has some hundred numbers, whatever the number of texts.
        found = texts.mapInPandas(tally, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(tallies([], [])))
        counts[found["i"].to_numpy()] = found["n"].to_numpy()
        model.start, model.move, model.emit = estimated(counts)


def fit_model(df: DataFrame, fields: list[str], work: list[str], model: Model) -> None:
    """Trains a model that leaves no line out. The lines of a text are kept in the shared folder."""
    sent = df.sparkSession.sparkContext.broadcast(model.keys)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = [(lines_of(t), w) for f in fields for t, w in zip(frame[f].tolist(), frame["__work"].tolist()) if t]
            yield pd.DataFrame([(codes(features(x, w, sent.value)).tobytes(),) for x, w in lines if len(x) > 3], columns=["rasgos"])

    train(model, materialize(spread(df.select(*fields, F.concat_ws(" ", *work).alias("__work"))).mapInPandas(read, "rasgos binary")))


@dataclass
class Told:
    """What a pack of texts asked for beyond the model: which of its lines are running ones, counts of words, misread words and what they mean."""

    lines: set[str] = field(default_factory=set)
    counts: dict[str, int] = field(default_factory=dict)
    rights: dict[str, str] = field(default_factory=dict)


Work = Callable[[pd.DataFrame, Told], pd.DataFrame]


def met(rows: DataFrame, answers: DataFrame, parts: int, begin: Callable[[], Work], schema: str) -> DataFrame:
    """The work that ``begin`` gives, once a task, over the rows of each pack with its answers (pack, kind, key, n, meant).

    In each partition the answers to a pack come before its rows, which stream; only the answers are held.
    """
    asked = rows.withColumns({"turn": F.lit(1), "kind": F.lit(""), "key": F.lit(""), "n": F.lit(0).cast("long"), "meant": F.lit("")})
    both = asked.unionByName(answers.withColumn("turn", F.lit(0)), allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, pack, told = begin(), None, Told()
        for frame in frames:
            for now, part in frame.groupby("pack", sort=False):
                if now != pack:
                    pack, told = now, Told()
                first = part[part["turn"] == 0]
                for kind, key, n, meant in zip(first["kind"].tolist(), first["key"].tolist(), first["n"].tolist(), first["meant"].tolist()):
                    if kind == "l":
                        told.lines.add(key)
                    elif kind == "w":
                        told.counts[key] = n
                    else:
                        told.rights[key] = meant
                rest = part[part["turn"] == 1]
                if len(rest):
                    yield work(rest, told)

    return both.repartition(parts, "pack").sortWithinPartitions("pack", "turn").mapInPandas(run, schema)


def alone(rows: DataFrame, begin: Callable[[], Work], schema: str) -> DataFrame:
    """The same where nothing was asked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = begin()
        for frame in frames:
            yield work(frame, Told())

    return rows.mapInPandas(run, schema)


def answered(asked: DataFrame, kind: str, table: DataFrame) -> DataFrame:
    """Answers to what packs asked, kept in the shared folder; what the table (key, n or meant, if it has them) lacks gets none."""
    columns = {"kind": F.lit(kind)} | {c: F.lit(empty) for c, empty in (("n", 0), ("meant", "")) if c not in table.columns}
    found = asked.distinct().join(table, "key").withColumns(columns)
    return materialize(found.select("pack", "kind", "key", F.col("n").cast("long").alias("n"), "meant"))


def meanings(misread: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """What each misread word (``key``) means (``meant``), as ``corrected`` has it, from all words; the others have no row."""
    sent = misread.sparkSession.sparkContext.broadcast(model.words)
    # Words that the model leaves out are no more frequent than this.
    rest = min(model.words.values(), default=np.inf)

    def forms(word: str) -> Iterator[tuple[str, str, int]]:
        yield word, word, 0
        once = set(_unread(word))
        yield from ((word, v, 1) for v in once if rest > MEANT[0] or v in sent.value)
        if len(word) >= 6:
            twice = {v for u in once for v in _unread(u) if rest > MEANT[1] or v in sent.value}
            yield from ((word, v, 2) for v in twice - once - {word})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["word", "key", "away"]
        for frame in frames:
            rows = []
            for word in frame["key"].tolist():
                rows += forms(word)
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    def most(away: int) -> Column:
        return F.min(F.when(F.col("away") == away, F.struct((-F.col("n")).alias("less"), "key")))

    found = misread.distinct().mapInPandas(run, "word string, key string, away int").join(words, "key")
    best = found.groupBy("word").agg(F.coalesce(F.max(F.when(F.col("away") == 0, F.col("n"))), F.lit(0)).alias("own"), most(1).alias("one"), most(2).alias("two"))
    much = F.greatest(F.lit(MEANT[0]), RATIO * F.col("own"))
    meant = F.when(-F.col("one.less") > much, F.col("one.key")).when(
        (F.length("word") >= 6) & (F.col("own") <= 2) & (-F.col("two.less") > F.greatest(much, F.lit(MEANT[1]))), F.col("two.key")
    )
    return best.select(F.col("word").alias("key"), meant.alias("meant")).filter("meant is not null")


def repaired_by_packs(slim: DataFrame, fields: list[str], model: Model, words: DataFrame | None, lines: DataFrame | None) -> DataFrame:
    """As ``repair_scans`` where the model leaves words or lines out: packs of texts ask for what they hold of these.

    Questions and answers are joined by word or line, then meet the texts by pack: first the
    running lines, then the words at cuts, then those that may be misread. Texts are kept
    packed in the shared folder, a line's features in a byte beside them.
    """
    context = slim.sparkSession.sparkContext
    wide = context.defaultParallelism
    places = {f"__text{j}": f for j, f in enumerate(fields)}
    rows = slim.select("__id", "__work", *[F.col(f).alias(p) for p, f in places.items()])
    size = rows.agg(sum((F.coalesce(F.sum(F.length(p).cast("long")), F.lit(0)) for p in places), F.lit(0)).alias("n")).first()["n"]
    packs = max(16 * wide, size // PACK)
    parts = max(2 * wide, packs // 8)
    rows = spread(rows).withColumn("pack", F.pmod(F.xxhash64("__id", "__work", *places), F.lit(packs)))
    keys, all_words = context.broadcast(model.keys), words is None

    def ask_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Whatever a text's width is, it makes no other keys than these.
            asked = {(n, k) for p in places for n, t in zip(frame["pack"].tolist(), frame[p].tolist()) if t for x in lines_of(t) if (k := running_key(x, 1000))}
            yield pd.DataFrame([(n, k) for n, k in asked if k not in keys.value], columns=["pack", "key"])

    def code() -> Work:
        def work(frame: pd.DataFrame, told: Told) -> pd.DataFrame:
            known, out = keys.value | told.lines, []
            for p, f in places.items():
                for n, i, w, t in zip(frame["pack"].tolist(), frame["__id"].tolist(), frame["__work"].tolist(), frame[p].tolist()):
                    if t is not None:
                        out.append((n, i, f, zlib.compress(t.encode()), codes(features(lines_of(t), w, known)).tobytes()))
            return pd.DataFrame(out, columns=["pack", "id", "campo", "texto", "rasgos"])

        return work

    schema = "pack long, id string, campo string, texto binary, rasgos binary"
    if lines is None:
        coded = materialize(alone(rows, code, schema))
    else:
        coded = materialize(met(rows, answered(rows.mapInPandas(ask_lines, "pack long, key string"), "l", lines), parts, code, schema))
    train(model, coded.filter("octet_length(rasgos) > 3").select("rasgos"))
    sent = context.broadcast(model)

    def labelled(frame: pd.DataFrame) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
        rasgos = [np.frombuffer(r, np.uint8) for r in frame["rasgos"]]
        labels = viterbi(rasgos, sent.value.start, sent.value.move, sent.value.emit)
        for packed, r, y in zip(frame["texto"].tolist(), rasgos, labels):
            text = zlib.decompress(packed).decode()
            yield text, lines_of(text), FEATURES[r], y

    def ask_cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = {(n, w) for n, (_, x, _, y) in zip(frame["pack"].tolist(), labelled(frame)) for w in at_cuts(x, y.tolist())}
            yield pd.DataFrame([(n, w) for n, w in asked if w not in sent.value.words], columns=["pack", "key"])

    def ask_misread() -> Work:
        repairer = Repairer(sent.value)

        def work(frame: pd.DataFrame, told: Told) -> pd.DataFrame:
            repairer.told(told.counts, {})
            repairer.asked = set()
            for x in labelled(frame):
                repairer._labelled(*x)
            pack = int(frame["pack"].iloc[0])
            return pd.DataFrame([(pack, w) for w in repairer.asked], columns=["pack", "key"])

        return work

    def repair() -> Work:
        repairer = Repairer(sent.value)

        def work(frame: pd.DataFrame, told: Told) -> pd.DataFrame:
            if not all_words:
                repairer.told(told.counts, told.rights)
            got = [repairer._labelled(*x) for x in labelled(frame)]
            return pd.DataFrame({"id": frame["id"].tolist(), "campo": frame["campo"].tolist(), "tipos": [sorted(r.kinds) for r in got], "texto": [r.text for r in got]})

        return work

    schema = "id string, campo string, tipos array<string>, texto string"
    if words is None:
        return alone(coded, repair, schema)
    counts = answered(coded.mapInPandas(ask_cuts, "pack long, key string"), "w", words)
    asked = materialize(met(coded, counts, parts, ask_misread, "pack long, key string").distinct())
    rights = answered(asked, "r", meanings(asked.select("key"), words, model))
    return met(coded, counts.union(rights), parts, repair, schema)


def repair_scans(df: DataFrame, record: str, fields: list[str], work: list[str]) -> DataFrame:
    """Rows (id, campo, tipos, texto) for every text of ``fields`` that is not null.

    Each line is labelled body, header, folio, break or title by a hidden Markov model
    over layout features; running headers and page numbers go, words cut at line ends
    are joined, misread words are put right where a known confusion leads to a much more
    frequent word, and lines become paragraphs. ``tipos`` lists the kinds of noise found,
    sorted; texts without any that are not hard-wrapped stay as they are. ``work`` names
    columns whose words (work, author) headers repeat. Null texts give no row, empty ones
    come out empty; repeated rows repeat; an empty table gives no rows. Every word and
    running line counts, also where there are more than go to every worker.
    """
    counts, words, lines = counted_model(df, fields)
    kind = df.schema[record].dataType.simpleString()
    # Ids travel as text, so that a null one does not turn the others into floating point.
    slim = df.select(F.col(record).cast("string").alias("__id"), F.concat_ws(" ", *work).alias("__work"), *fields)
    if words is not None or lines is not None:
        return repaired_by_packs(slim, fields, counts, words, lines).withColumn("id", F.col("id").cast(kind))
    fit_model(df, fields, work, counts)
    model = df.sparkSession.sparkContext.broadcast(counts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(model.value)
        for frame in frames:
            about = [w or "" for w in frame["__work"].tolist()]
            rows = []
            for name in fields:
                got = repairer.repair_all(frame[name].tolist(), about)
                rows += [(i, name, sorted(r.kinds), r.text) for i, r in zip(frame["__id"].tolist(), got) if r is not None]
            yield pd.DataFrame(rows, columns=["id", "campo", "tipos", "texto"])

    out = spread(slim).mapInPandas(run, "id string, campo string, tipos array<string>, texto string")
    return out.withColumn("id", F.col("id").cast(kind))
