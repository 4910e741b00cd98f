"""Toxicity by noisy-channel deobfuscation.

A disguised word is read as the output of a noisy channel: letters replaced by
look-alike signs, split by spaces or marks, or repeated.  Its characters form a
lattice of readings; Viterbi decoding under a character bigram model, counted
over all documents, finds the likeliest words.  Every token with a doubled
letter, a digit or a sign is decoded; one of other letters alone has a single
reading and needs no search.  Signs at a token's ends are read both as letters
and as punctuation.  Marks within a token, and the blanks of a run of single
characters, are each dropped or read as a word edge: every word of a reading
near the likeliest one counts.  Parts between the marks of a token are decoded
by themselves as well, whatever the token's length.

The restored text is scored by the terms, whole words and word beginnings, that
mark toxicity in labelled rows: a term's weight is its share of toxic rows,
and the score of a text is the noisy-or of its terms' weights over a base rate.
Shares are counted over groups of near copies (by min-hashes of their
shingles), one row of each, so that the words of one copied text do not become
terms; of a word's terms the heaviest counts.

Fitting takes at most ``most`` labelled rows (a parameter); model counts and
scores take every document and its whole text.  Null, empty and blank texts
score the base rate.  Repeated rows are scored each.  Without labelled toxic
rows there are no terms and every text scores the base rate.  An empty table
gives an empty one; columns other than doc_id and text are not read, whatever
their names, and ``reject`` passes them on.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as lb
from . import words as wk
from .memory import tidied

#: Labelled rows to fit on, at most.
FIT_ROWS = 40_000
#: Least share of toxic rows (lower bound at Z) for a term, and least rows that it explains.
LEAST_SHARE, LEAST_ROWS, Z = 0.5, 4, 2.58
#: A term of this share is sure: rows that have one lend nothing to less sure terms.
SURE_SHARE = 0.95
#: Least share (lower bound at Z) of a whole word that counts when it is written apart or masked.
APART_SHARE = 0.9
BEGINNINGS = (4, 5, 6)

#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
EDGE = ".,;:!?%&*#|\"'()[]{}<>~`=_-/\\$^+"
#: Those of them that stand for no letter.
MARKS = "".join(x for x in EDGE if x not in LOOKALIKES)
#: A token of single letters or digits with marks between them.
_SINGLE = re.compile(r"[^\W_](?:[\W_]+[^\W_])*")
_PARTED = re.compile("[^\\w" + re.escape("".join(LOOKALIKES)) + "]+|_+")
_SIGNS = re.compile(r"[^\w@$]+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_REPEATS = re.compile(r"(.)\1+")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs in nats of reading a sign as a letter, dropping a mark, a sign, or a repeated letter.
COST_LOOKALIKE, COST_MARK, COST_SIGN, COST_REPEAT = 1.0, 0.5, 5.0, 0.7
#: Of reading a blank or mark within a spaced run or token as a word edge.
COST_EDGE = 2.0
#: Readings that list decoding keeps, and nats that they may lie below the best.
LISTED, MARGIN = 6, 6.0
#: Tokens that are remembered, up to so many letters.
KNOWN, KNOWN_LETTERS = 200_000, 64
#: Characters of a run that are decoded at a time, and how many two such windows share.
WINDOW, SHARED = 2048, 256
#: Letters of other scripts by the Latin ones that they look like.
HOMOGLYPHS = str.maketrans("\u0430\u0432\u0435\u043a\u043c\u043d\u043e\u0440\u0441\u0442\u0443\u0445\u0455\u0456\u0458\u03b1\u03b2\u03b5\u03b9\u03ba\u03bd\u03bf\u03c1\u03c4\u03c5\u03c7\u0131\u0142\u00f8\u0111", "abekmhopctyxsijabeikvoptuxilod")
#: A token of letters with masked ones between them.
_MASKED = re.compile(r"[a-z]+(?:[*#]+[a-z]+)+")


#: Of one character: (emitted text, next state, cost).
Arcs = tuple[tuple[str, int, float], ...]


class CharModel:
    """Character bigrams over a-z and a word edge (0)."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(27, 27).astype(float) + 0.5
        self.log = np.log(c / c.sum(axis=1, keepdims=True))
        self.rows = self.log.tolist()
        #: Of ending a word; after its start or a letter outside a-z it costs nothing.
        self.ends = [0.0, *self.log[1:, 0].tolist()]
        self.memo: dict[str, tuple[str, ...]] = {}
        #: Words of one reading that were met.
        self.plain: set[str] = set()

    @staticmethod
    def remember(known: set[str], word: str) -> None:
        """Keep a word of bounded size among at most KNOWN ones."""
        if len(word) <= KNOWN_LETTERS:
            if len(known) >= KNOWN:
                known.clear()
            known.add(word)

    def decode(self, run: str) -> str:
        """The likeliest reading of ``run``, its words parted by blanks; a long run is decoded in windows."""
        steps = _arcs(run, True, COST_MARK)
        return " ".join("".join(self._lattice(steps[lo : lo + WINDOW])[1] for lo in range(0, len(steps), WINDOW)).split())

    def words(self, token: str) -> tuple[str, ...]:
        """The words that may stand behind one blank-free token: as it is, as disguised, and those of its parts."""
        if token in self.memo:
            return self.memo[token]
        if len(self.memo) > KNOWN:
            self.memo.clear()
        if token.isalpha():
            out = {token} | self._thinned(token)
        else:
            parts = [x for x in _PARTED.split(token) if x]
            out = self.readings(token, at_edge=COST_SIGN) if len(parts) > 1 else set()
            for x in _kept(token):
                out |= {x} | self._thinned(x) if x.isalpha() else self.readings(x, edges=False, at_edge=COST_SIGN)
            for part in {*parts, *(y for x in parts for y in _SIGNS.split(x) if y)}:
                for x in _kept(part) if len(parts) > 1 else (part,):
                    out |= {x} | self._thinned(x) if x.isalpha() else self.readings(x, edges=False, at_edge=COST_SIGN)
        if len(token) > KNOWN_LETTERS:
            return tuple(out)
        self.memo[token] = tuple(out)
        return self.memo[token]

    def _thinned(self, word: str) -> set[str]:
        """``readings`` of plain letters: each run of one letter gets shorter, whatever the others do."""
        lines: list[tuple[float, tuple | None]] = [(0.0, None)]
        at = 0
        for run in _REPEATS.finditer(word):
            c, n = run[1], len(run[0])
            again = self.rows[ord(c) - 96][ord(c) - 96] if c in _LETTERS else 0.0
            # a copy that stays gains or loses the same each: the LISTED best are at one end
            kept = range(1, min(n, LISTED) + 1) if again + COST_REPEAT <= 0 else range(n, max(0, n - LISTED), -1)
            ways = [(c * m, (m - 1) * again - (n - m) * COST_REPEAT) for m in kept]
            most = ways[0][1]
            step = [(score + own - most, (link, word[at : run.start()] + way)) for score, link in lines for way, own in ways if score + own - most >= -MARGIN]
            lines = sorted(step, key=lambda x: -x[0])[:LISTED]
            at = run.end()
        out = set()
        for _, link in lines:
            parts = [word[at:]]
            while link is not None:
                link, part = link
                parts.append(part)
            out.add("".join(reversed(parts)))
        return out

    def readings(self, run: str, edges: bool = True, at_edge: float = COST_MARK) -> set[str]:
        """Every word of a reading of ``run`` that lies within MARGIN nats of the likeliest one.

        Without ``edges``, all is one word; ``at_edge`` is the cost of dropping a sign at an end of a token.
        A long run is decoded in windows that share SHARED characters, so that a word of as many stands whole in one.
        """
        steps = _arcs(run, edges, at_edge)
        words = self._lattice(steps[:WINDOW])[0]
        for lo in range(WINDOW - SHARED, len(steps) - SHARED, WINDOW - SHARED):
            words |= self._lattice(steps[lo : lo + WINDOW])[0]
        return words

    def _lattice(self, steps: list[Arcs]) -> tuple[set[str], str]:
        """Words within MARGIN nats, by list Viterbi ahead of exact scores from behind, and the likeliest reading.

        States are last letters (0 at a word's start or after a letter outside a-z, which stays as it is).
        """
        log, ends = self.rows, self.ends
        ahead: list[dict[int, tuple[float, int, str]]] = [{0: (0.0, 0, "")}]
        for arcs in steps:
            step: dict[int, tuple[float, int, str]] = {}
            for s, (score, _, _) in ahead[-1].items():
                for emit, k, cost in arcs:
                    if emit == "":
                        if k and not s:
                            continue
                        to, x = s, score - cost
                    elif k:
                        to, x = k, score + log[s][k] - cost
                    else:
                        to, x = 0, score + ends[s] - cost
                    if to not in step or x > step[to][0]:
                        step[to] = (x, s, emit)
            ahead.append(step)
        behind: list[dict[int, float]] = [{s: ends[s] for s in ahead[-1]}]
        for i in range(len(steps) - 1, -1, -1):
            after, back = behind[-1], {}
            for s in ahead[i]:
                most = -1e300
                for emit, k, cost in steps[i]:
                    if emit == "":
                        if k and not s:
                            continue
                        x = after[s] - cost
                    elif k:
                        x = after[k] + log[s][k] - cost
                    else:
                        x = after[0] + ends[s] - cost
                    most = max(most, x)
                back[s] = most
            behind.append(back)
        behind.reverse()
        least = behind[0][0] - MARGIN - 1e-9
        words: set[str] = set()
        lines: dict[tuple[int, str], float] = {(0, ""): 0.0}
        for arcs, after in zip(steps, behind[1:], strict=True):
            step_: dict[tuple[int, str], float] = {}
            for (s, part), score in lines.items():
                for emit, k, cost in arcs:
                    if emit == "":
                        if k and not s:
                            continue
                        key, x = (s, part), score - cost
                    elif k:
                        key, x = (k, part + emit), score + log[s][k] - cost
                    else:
                        key, x = (0, "" if emit == " " else part + emit), score + ends[s] - cost
                    if x + after[key[0]] < least:
                        continue
                    if emit == " " and part:
                        words.add(part)
                    if x > step_.get(key, -1e300):
                        step_[key] = x
            if len(step_) > LISTED:
                kept: Counter[int] = Counter()
                lines = {}
                for key, x in sorted(step_.items(), key=lambda y: (-y[1], y[0])):
                    kept[key[0]] += 1
                    if kept[key[0]] <= LISTED:
                        lines[key] = x
            else:
                lines = step_
        words.update(part for s, part in lines if part)
        s = max(ahead[-1], key=lambda y: (ahead[-1][y][0] + ends[y], -y))
        out = []
        for step in reversed(ahead[1:]):
            _, s, emit = step[s]
            out.append(emit)
        return words, "".join(reversed(out))


def _kept(token: str) -> set[str]:
    """``token`` without its edge signs, with the innermost ones and with all."""
    core = token.strip(EDGE)
    if not core:
        return {token}
    lead, trail = token.split(core, 1)
    return {x + core + y for x in ("", lead[-1:], lead) for y in ("", trail[:1], trail)}


@functools.lru_cache(4096)
def _readings_of(c: str, again: bool, outer: bool, edges: bool, at_edge: float) -> Arcs:
    """Of one character: ``again`` behind itself, ``outer`` at an end of its token."""
    if c in _LETTERS:
        arcs = [(c, ord(c) - 96, 0.0)]
    elif c in LOOKALIKES:
        arcs = [(x, ord(x) - 96, COST_LOOKALIKE) for x in LOOKALIKES[c]]
        arcs.append(("", 0, at_edge if c in EDGE and outer else COST_SIGN))
        if edges and c in EDGE:
            arcs.append((" ", 0, COST_EDGE))
    else:
        arcs = [(c, 0, 0.0)]
    if again:
        arcs.append(("", 1, COST_REPEAT))
    return tuple(arcs)


def _arcs(run: str, edges: bool, at_edge: float) -> list[Arcs]:
    """Per character (emitted text, next state, cost): no text drops the character, a blank ends the word.

    A drop with state 1 needs a letter before it.  Neighbouring blanks and marks are one.
    """
    blank = (("", 0, COST_MARK), (" ", 0, COST_EDGE)) if edges else (("", 0, COST_MARK),)
    out: list[Arcs] = []
    before, parted = "", False
    for at, token in enumerate(run.split()):
        lead, trail = len(token) - len(token.lstrip(EDGE)), len(token.rstrip(EDGE))
        if at and not parted:
            out.append(blank)
            parted = True
        for i, c in enumerate(token):
            if c not in LOOKALIKES and not c.isalpha():
                if not parted:
                    out.append(blank)
                    parted = True
                continue
            out.append(_readings_of(c, c == before, i < lead or i >= trail, edges, at_edge))
            before, parted = c, False
    return out


def char_model(docs: DataFrame) -> CharModel:
    """Bigram counts over all documents: one small histogram per task, summed."""
    kind = np.zeros(256, np.int64)
    kind[np.arange(97, 123)] = np.arange(1, 27)
    kind = kind[wk.LOWER]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(729, np.int64)
        for batch in batches:
            for _, _, _, data in wk.slices(batch.column(0)):
                x = np.append(0, np.append(kind[data], 0))
                total += np.bincount(x[:-1] * 27 + x[1:], minlength=729)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(729)), pa.array(total)], ["pair", "n"])

    counts = np.zeros(729, np.int64)
    for row in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row["pair"]] = row["n"]
    counts[0] = 0
    return CharModel(counts)


def spaced(tokens: list[str], distinct: Iterable[str] | None = None) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two tokens or more that are single characters, three at least, a letter among them."""
    single = {x for x in (tokens if distinct is None else distinct) if (len(x) == 1 or not x.isalnum()) and _single(x)}
    start, last = -1, -2
    for i in [*(i for i, x in enumerate(tokens) if x in single), len(tokens) + 1] if single else ():
        if i != last + 1:
            if last > start >= 0:
                run = "".join(tokens[start : last + 1])
                if sum(c.isalnum() or c in LOOKALIKES for c in run) >= 3 and any(c.isalpha() for c in run):
                    yield start, last + 1
            start = i
        last = i


def _single(token: str) -> bool:
    """Whether no two letters or digits of ``token`` stand side by side."""
    core = token.strip(EDGE)
    return len(core) < 2 or (not core.isalnum() and _SINGLE.fullmatch(core) is not None)


@functools.lru_cache(100_000)
def folded(token: str) -> str:
    """A token without accents, widths and letters that only look like Latin ones."""
    return "".join(c for c in unicodedata.normalize("NFKD", token) if unicodedata.category(c) not in ("Mn", "Cf")).translate(HOMOGLYPHS).lower()


def restored(text: str, model: CharModel, tokens: list[str] | None = None) -> set[str]:
    """The distinct words of the restored text; ``tokens`` are its lower-cased ones where they are known."""
    tokens = text.lower().split() if tokens is None else tokens
    distinct = set(tokens)
    bare = {x.strip(MARKS) for x in distinct}
    if not text.isascii():
        bare |= {folded(x) for x in bare if not x.isascii()}
    out = bare & model.plain
    for token in bare - out:
        if token.isalpha() and not _DOUBLE.search(token):
            out.add(token)
            model.remember(model.plain, token)
        elif token:
            out.update(model.words(token))
    for i, j in spaced(tokens, distinct):
        run = " ".join(tokens[i:j])
        for edges in (True, False):
            out |= model.readings(run, edges) | model.readings(run, edges, COST_SIGN)
    return out


def restore(text: str, model: CharModel) -> str:
    """The text with its disguised words written out."""
    found = list(re.finditer(r"\S+", text))
    tokens = [m[0].lower() for m in found]
    runs = dict(spaced(tokens))
    out, at, i = [], 0, 0
    while i < len(found):
        j = runs.get(i, i + 1)
        token = tokens[i]
        word = token.strip(EDGE)
        out.append(text[at : found[i].start()])
        if j > i + 1:
            out.append(model.decode(" ".join(tokens[i:j])))
        elif not any(c.isalpha() for c in word) or (word.isalpha() and not _DOUBLE.search(word)):
            out.append(found[i][0])
        else:
            read = model.decode(word)
            out.append(found[i][0] if read == word else found[i][0].lower().replace(word, read, 1))
        at = found[j - 1].end()
        i = j
    return "".join(out) + text[at:]


def terms_of(words: Iterable[str]) -> set[str]:
    """Whole words, as they are, and beginnings, marked by a star."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w)
            for n in BEGINNINGS:
                if len(w) > n - 1:
                    out.add(w[:n] + "*")
    return out


def lower_share(pos: float, neg: float, z: float = Z) -> float:
    """Wilson's lower bound of pos / (pos + neg)."""
    n = pos + neg
    if n <= 0:
        return 0.0
    p = pos / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@dataclass
class ToxicityModel:
    chars: CharModel
    base: float
    weights: dict[str, float]
    heads: set[str] = field(default_factory=set)
    #: Whole words that count when they are written apart or masked.
    apart: frozenset[str] = frozenset()

    def __post_init__(self):
        self.heads = {t[:3] for t in self.weights}
        #: Beginnings of the words that count when they are written apart.
        self.starts = {t[:n] for t in self.apart for n in range(1, len(t))}
        #: Words without a term that were met.
        self.bare: set[str] = set()

    def score(self, text: str) -> float:
        clean = 1.0 - self.base
        tokens = text.lower().split()
        found = restored(text, self.chars, tokens)
        for w in sorted(found - self.bare):
            weight = max((self.weights.get(t, 0.0) for t in terms_of([w])), default=0.0) if w[:3] in self.heads else 0.0
            clean *= 1.0 - weight
            if not weight:
                CharModel.remember(self.bare, w)
        if self.apart:
            for w in sorted(self._written_apart(text, tokens) - found):
                clean *= 1.0 - self.weights[w]
        return 1.0 - clean

    def _written_apart(self, text: str, tokens: list[str]) -> set[str]:
        """Words that two neighbouring tokens make, or a token with masked letters may stand for."""
        starts, out = self.starts, set()
        for i in [i for i, x in enumerate(tokens) if x in starts or (x[0] in EDGE and x.lstrip(EDGE) in starts)]:
            if i + 1 < len(tokens) and (w := (tokens[i] + tokens[i + 1]).strip(EDGE)) in self.apart:
                out.add(w)
        for token in {x for x in tokens if "*" in x or "#" in x} if "*" in text or "#" in text else ():
            if _MASKED.fullmatch(token := token.strip(EDGE)):
                shape = re.compile(re.sub("[*#]", ".", token))
                out.update(w for w in self.apart if shape.fullmatch(w))
        return out


def apart(rows: DataFrame, k: int = 5, pairs: int = 4) -> list[int]:
    """The least id of each group of near copies among the fitting rows (bounded in number)."""
    salts = wk.mix(np.arange(1, 2 * pairs + 1, dtype=wk.U))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, pairs), np.int64)
            for lo, _, off, data in wk.slices(batch.column(1)):
                starts, ends, first = wk.spans(off, data, wk.BLANK)
                for i, a in enumerate(wk.grams(wk.hashes(starts, ends, data), first, k)):
                    if len(a):
                        low = np.array([wk.mix(a ^ x).min() for x in salts], wk.U)
                        keys[lo + i] = wk.mix(low[::2] * wk.U(3) + low[1::2]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(keys[:, j]) for j in range(pairs))], ["doc_id", *(f"k{j}" for j in range(pairs))])

    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    least: dict = {}
    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"k{j} long" for j in range(pairs))).collect()
    for r in found:
        for j in range(pairs):
            parent[root(("row", r["doc_id"]))] = root((j, r[f"k{j}"]))
    for r in found:
        x = root(("row", r["doc_id"]))
        least[x] = min(least.get(x, r["doc_id"]), r["doc_id"])
    return sorted(least.values())


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, modulus: int = 5) -> ToxicityModel:
    """Fit on labelled rows whose crc32(doc_id as text) modulo ``modulus`` is not 0."""
    spark = docs.sparkSession
    chars = char_model(docs)
    rows = lb.fitting_rows(docs, labels, "toxic", lb.remainder(modulus) != 0, most, "toxicity-fit")
    kept = spark.createDataFrame([(x,) for x in apart(rows)], "doc_id long")
    rows = rows.join(F.broadcast(kept), "doc_id")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = (size.get(1, 0) + 0.5) / (sum(size.values()) + 1.0)
    shared = spark.sparkContext.broadcast(chars)

    @tidied
    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(terms_of(restored(text, shared.value)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    toxic = rows.filter("y = 1").select("text").mapInArrow(of_toxic, "term string, n long")
    often = toxic.groupBy("term").agg(F.sum("n").alias("pos")).filter(F.col("pos") >= LEAST_ROWS)
    # at most the fitting rows' terms: bounded by ``most``
    pos = {r["term"]: r["pos"] for r in often.collect()}
    wanted = spark.sparkContext.broadcast(frozenset(pos))

    @tidied
    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(terms_of(restored(text, shared.value)) & wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    neg = {r["term"]: r["n"] for r in rows.filter("y = 0").select("text").mapInArrow(of_clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    share = {t: (n + 0.5) / (n + neg.get(t, 0) + 1.0) for t, n in pos.items() if lower_share(n, neg.get(t, 0)) >= LEAST_SHARE}
    weights = {t: x for t, x in share.items() if x >= SURE_SHARE}
    sure = ToxicityModel(chars, base, weights)
    doubtful = spark.sparkContext.broadcast((sure, frozenset(t for t, n in pos.items() if t not in weights and lower_share(n, neg.get(t, 0)) > base)))

    @tidied
    def of_unexplained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        model, wanted_ = doubtful.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if model.score(text) < 0.5:
                    count.update(terms_of(restored(text, model.chars)) & wanted_)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    for r in rows.filter("y = 1").select("text").mapInArrow(of_unexplained, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["n"] >= LEAST_ROWS and lower_share(r["n"], neg.get(r["term"], 0)) >= LEAST_SHARE:
            weights[r["term"]] = share.get(r["term"], LEAST_SHARE)
    known = frozenset(t for t in weights if not t.endswith("*") and lower_share(pos[t], neg.get(t, 0)) >= APART_SHARE)
    return ToxicityModel(chars, base, weights, apart=known)


def scores(docs: DataFrame, model: ToxicityModel, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([shared.value.score(x or "") for x in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), (lb.remainder(modulus) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(x or "") < 0.5 for x in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
