"""URL filters: all glob rules at once by a bit-parallel Shift-And automaton.

A canonical URL is its lower-cased host followed by its path.  A rule is a
glob over it: ``*`` stands for any run of bytes but ``/`` and ``**`` for any
run at all; other bytes stand for themselves.  All rules are laid out one
after another in a bit vector of as many 64-bit words as needed; a step per
byte position shifts the vectors of a whole batch of URLs at once:

    D = (((D << 1) | S) & B[c]) | (D & L[c])

S has the rules' first positions (they are anchored: set before the first byte
only), B[c] the positions that read byte c, L[c] those that loop on c, that
is, that stand before a wildcard.  The cost of a URL is its length times the
words of the vector, whatever the rules are.

Null and empty URLs, and those without ``://``, have an empty host and path.  URLs
of any length are read whole, repeated rows are judged each, an empty table gives
an empty one, and other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import tidied

U = np.uint64


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains with a path that starts with ``path``; or a glob of its own in ``glob``."""

    verdict: str
    host: str = ""
    path: str = ""
    glob: str = ""

    @property
    def name(self) -> str:
        return self.glob or self.host + self.path

    def globs(self) -> list[str]:
        if self.glob:
            return [self.glob]
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


class Automaton:
    """States: a start position per glob, then one per byte; a position with a loop stays on bytes of its wildcard."""

    def __init__(self, globs: Sequence[str]):
        starts, ends, reads, loops, at = [], [], [], [], 0
        for glob in globs:
            starts.append(at)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops.append((at, None))
                    i += 2
                elif raw[i : i + 1] == b"*":
                    loops.append((at, 0x2F))
                    i += 1
                else:
                    at += 1
                    reads.append((at, raw[i]))
                    i += 1
            ends.append(at)
            at += 1
        self.words = at // 64 + 1
        self.start = np.zeros(self.words, U)
        self.read = np.zeros((256, self.words), U)
        self.loop = np.zeros((256, self.words), U)
        self.ends = ends
        bit = lambda p: (p // 64, U(1) << U(p % 64))
        for p in starts:
            w, b = bit(p)
            self.start[w] |= b
        for p, c in reads:
            w, b = bit(p)
            self.read[c, w] |= b
        for p, but in loops:
            w, b = bit(p)
            self.loop[:, w] |= b
            if but is not None:
                self.loop[but, w] &= ~b

    def match(self, texts: list[bytes]) -> np.ndarray:
        """[texts, globs] of booleans.  Texts are taken by descending length, so that finished ones drop out of the steps."""
        n = len(texts)
        length = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(length) - length)[order]
        length = length[order]
        state = np.tile(self.start, (n, 1))
        live = n
        for i in range(int(length[0]) if n else 0):
            while live and length[live - 1] <= i:
                live -= 1
            c = data[begin[:live] + i]
            d = state[:live]
            carry = np.zeros_like(d)
            carry[:, 1:] = d[:, :-1] >> U(63)
            state[:live] = (((d << U(1)) | carry) & self.read[c]) | (d & self.loop[c])
        out = np.empty((n, len(self.ends)), bool)
        for k, p in enumerate(self.ends):
            out[order, k] = (state[:, p // 64] >> U(p % 64)) & U(1) != 0
        return out


def canonical(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the column; both empty without ``://`` or for null."""
    rest = F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) END")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: Sequence[Rule], own: Sequence[Rule] = (), default: str = "allow", batch: int = 4096) -> DataFrame:
    """page_id, host, path, rule (the longest of ``rules`` that fits, else null) and verdict.

    Of rules of one length the first counts.  Where none fits, the first of
    ``own`` that fits gives the verdict, else ``default``.  ``pages`` needs
    page_id and url; null and malformed urls have an empty host and path.
    Repeated rows are judged each.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    every = [*ranked, *own]
    globs, owner = [], []
    for i, rule in enumerate(every):
        for glob in rule.globs():
            globs.append(glob)
            owner.append(i)
    owner_ = np.asarray(owner)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                texts = [((h or "") + (p or "")).encode() for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                hit = machine.match(texts)
                first = np.where(hit.any(axis=1), owner_[hit.argmax(axis=1)], -1)  # globs stand in the rules' order
                rule = [every[i].name if 0 <= i < len(ranked) else None for i in first]
                verdict = [every[i].verdict if i >= 0 else default for i in first]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = canonical("url")
    return pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
