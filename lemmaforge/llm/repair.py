"""Repair of a conversation's structure: the cheapest edits that make its roles a sentence of a role grammar.

The grammar is right-linear with error productions: a row may be deleted, a row
may stand for another role, and a row may be missing.  The parser is Earley's:
a chart column per row boundary, whose items X -> t . Y are merged by what the
dot stands before and keep the minimum (cost, audit); the predictor opens Y's
alternatives, the scanner passes a row by keeping or reroling it, an insertion
passes a terminal without a row, a deletion a row without a terminal.  The
completed chart gives the audit, and the audit the repaired rows.

Two audits of one item at one column have the same rows behind them, so if one
begins with the other, the rest is insertions, which cost: audits of equal cost
part ways at some letter, and the least of what comes before an item stays the
least whatever follows.

A conversation may hold any share of all rows.  Rows are range-partitioned by
conversation and turn and cut into segments of bounded size; a segment's chart
is filled once from each item that a column can have, which gives the minimum
from every item to every item.  A conversation's segments then need one row
each to choose its path, in which an audit so far is told apart by its order
among the few items alone.  Edits, repaired rows and their text are made in the
segments again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .memory import tidied

#: Rows and bytes of text of a segment; a longer row comes alone.
SEGMENT_ROWS, SEGMENT_BYTES = 256, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Grammar:
    """Alternatives of each nonterminal: (terminal, nonterminal) or None for the empty one.

    Terminals are first letters of roles; those of ``roles`` can be inserted or
    be what another role stood for, one for each nonterminal at most, so that an
    audit says which.
    """

    rules: dict[str, list[tuple[str, str] | None]] = field(default_factory=lambda: {"S": [None, ("s", "U"), ("u", "A")], "U": [("u", "A")], "A": [("a", "E")], "E": [None, ("u", "A")]})
    start: str = "S"
    roles: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})
    delete: int = 4
    rerole: int = 3
    insert: int = 3
    truncated: int = 3

    def __post_init__(self) -> None:
        if min(self.insert, self.delete, self.rerole) <= 0:
            raise ValueError("edits have to cost something")
        if any(len({t for t, _ in filter(None, x) if t in self.roles}) > 1 or len({t for t, _ in filter(None, x)}) < len([*filter(None, x)]) for x in self.rules.values()):
            raise ValueError("a nonterminal has two alternatives that an audit cannot tell apart")

    @property
    def items(self) -> list[str]:
        return list(self.rules)

    def opened(self, item: str) -> tuple[str, str] | None:
        """The alternative whose terminal can be inserted or stood for."""
        return next((x for x in self.rules[item] if x and x[0] in self.roles), None)

    def final(self, item: str) -> bool:
        return None in self.rules[item]


Column = dict[str, tuple[int, str]]


def _offer(column: Column, item: str, cost: int, audit: str) -> bool:
    if item not in column or (cost, audit) < column[item]:
        column[item] = (cost, audit)
        return True
    return False


def _with_insertions(column: Column, grammar: Grammar) -> Column:
    """Items that predicted terminals without rows lead to; insertions cost, so this ends."""
    todo = list(column)
    while todo:
        item = todo.pop()
        cost, audit = column[item]
        if (x := grammar.opened(item)) and _offer(column, x[1], cost + grammar.insert, audit + "I"):
            todo.append(x[1])
    return column


def chart(rows: Iterable[tuple[str, bool, bool]], start: str, grammar: Grammar) -> Column:
    """The last column of the chart of rows (first letter of the role, has to go, is truncated) from one item.

    A row without a role has no letter to parse and can be kept anywhere.
    """
    column = _with_insertions({start: (0, "")}, grammar)
    for letter, must_go, truncated in rows:
        after: Column = {}
        more = grammar.truncated * truncated
        for item, (cost, audit) in column.items():
            _offer(after, item, cost + grammar.delete, audit + "D")
            if must_go:
                continue
            if not letter:
                _offer(after, item, cost + more, audit + "K")
            for x in grammar.rules[item]:
                if x and x[0] == letter:
                    _offer(after, x[1], cost + more, audit + "K")
                elif x and x[0] in grammar.roles:
                    _offer(after, x[1], cost + grammar.rerole + more, audit + "R")
        column = _with_insertions(after, grammar)
    return column


def applied(rows: list[tuple[str, str]], audit: str, start: str, grammar: Grammar) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit of (role, text) rows; role and text are None for a deleted one."""
    item, at = start, 0
    for edit in audit:
        if edit == "I":
            letter, item = grammar.opened(item)
            yield edit, grammar.roles[letter], ""
            continue
        role, text = rows[at]
        at += 1
        if edit == "D":
            yield edit, None, None
        elif edit == "R":
            letter, item = grammar.opened(item)
            yield edit, grammar.roles[letter], text
        else:
            item = next((y for t, y in filter(None, grammar.rules[item]) if t == role[:1]), item)
            yield edit, role, text


class Path:
    """The way through a conversation's segments, one after another, in memory of a few numbers for each.

    Of the audits so far only their order and what one has beyond another
    matters; a stand-in of a few letters has both.
    """

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.best: Column = {grammar.start: (0, "")}
        self.back: list[dict[str, str]] = []

    def add(self, table: dict[str, Column]) -> None:
        """The next segment's columns by the item that it starts from."""
        best: Column = {}
        back: dict[str, str] = {}
        for item, (cost, stand_in) in self.best.items():
            for last, (more, audit) in table[item].items():
                if _offer(best, last, cost + more, stand_in + audit):
                    back[last] = item
        self.back.append(back)
        self.best, roots = {}, []
        for item, (cost, audit) in sorted(best.items(), key=lambda x: x[1][1]):
            if not roots or audit.rstrip("I") != roots[-1]:
                roots.append(audit.rstrip("I"))
            # letters below I, so that a root stands before what goes on from it
            self.best[item] = (cost, chr(ord("!") + len(roots)) + audit[len(roots[-1]) :])

    def chosen(self) -> tuple[int, list[tuple[str, str]]]:
        """Cost, and for each segment the items between which it is passed."""
        item = min((x for x in self.best if self.grammar.final(x)), key=self.best.__getitem__)
        cost, out = self.best[item][0], []
        for back in reversed(self.back):
            out.append((back[item], item))
            item = back[item]
        return cost, out[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20; nulls read as one space.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation
    and question marks, 3 repeats it, 4 makes the user say it.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.filter(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


_TABLE = "array<struct<start:string,item:string,cost:long,audit:string>>"
_SEGMENT = f"part int, seq long, roles array<string>, texts array<string>, must_go array<boolean>, n_blank long, n_duplicate long, n_truncated long, n_illegal long, first_letter string, last_letter string, first_turn long, last_turn long, n_turns long, columns {_TABLE}"


def _segments(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """A row for each run of a conversation's rows of one range partition, written to the shared folder."""
    digest = F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    # ids follow the files' splits; which of several equal rows has which does not matter
    base = store.keep(base.withColumn("digest", digest).withColumn("row_id", F.monotonically_increasing_id()), "repair-rows")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"), F.col("row_id"))
    firsts = base.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), F.col("first.row_id").alias("first_id"))
    seen = base.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    seen = seen.select("conv_id", "turn", "role", "text", "digest", "row_id", F.coalesce(F.col("row_id") != F.col("first_id"), F.lit(False)).alias("again"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "row_id"]
    kind = dict(seen.dtypes)["conv_id"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size, out = TaskContext.get().partitionId(), 0, [], 0, []
        schema = None

        def segment() -> dict:
            faults = []
            for _, _, _, text, again in held:
                bare = text.strip(BLANKS)
                faults.append("b" if not bare else "d" if again else "t" if bare[-1] not in ".!?" else "")
            must = [x in ("b", "d") for x in faults]
            letters = [r[2][:1] for r in held]
            turns = [r[1] for r in held if r[1] is not None]
            parsed = [(x, m, f == "t") for x, m, f in zip(letters, must, faults, strict=True)]
            columns = [{"start": s, "item": i, "cost": c, "audit": a} for s in grammar.items for i, (c, a) in chart(parsed, s, grammar).items()]
            return {
                "conv_id": held[0][0], "part": part, "seq": seq, "roles": [r[2] for r in held], "texts": [r[3] for r in held], "must_go": must,
                "n_blank": faults.count("b"), "n_duplicate": faults.count("d"), "n_truncated": faults.count("t"), "n_illegal": sum(x + y not in _LEGAL for x, y in zip(letters, letters[1:], strict=False)),
                "first_letter": letters[0], "last_letter": letters[-1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "n_turns": len(set(turns)), "columns": columns,
            }

        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field("conv_id", batch.schema.field(0).type), *_arrow_fields()])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= SEGMENT_ROWS or size + len(row[3]) > SEGMENT_BYTES):
                    out.append(segment())
                    seq, held, size = seq + 1, [], 0
                    if len(out) >= 100:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                held.append(row)
                size += len(row[3])
        if held:
            out.append(segment())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    table = seen.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "again").mapInArrow(run, f"conv_id {kind}, {_SEGMENT}")
    table = store.keep(table, "repair-segments")
    store.drop(base)
    return table


#: First letters of neighbouring roles that the grammar of a chat has.
_LEGAL = ("su", "ua", "au")


def _arrow_fields() -> list[pa.Field]:
    text, number = pa.string(), pa.int64()
    column = pa.struct([("start", text), ("item", text), ("cost", number), ("audit", text)])
    names = "n_blank n_duplicate n_truncated n_illegal".split()
    return [pa.field("part", pa.int32()), pa.field("seq", number), pa.field("roles", pa.list_(text)), pa.field("texts", pa.list_(text)), pa.field("must_go", pa.list_(pa.bool_())), *(pa.field(n, number) for n in names),
            pa.field("first_letter", text), pa.field("last_letter", text), pa.field("first_turn", number), pa.field("last_turn", number), pa.field("n_turns", number), pa.field("columns", pa.list_(column))]


def _paths(segments: DataFrame, grammar: Grammar) -> DataFrame:
    """part, seq, start, audit of each segment as its conversation is repaired; on a conversation's last one its counts and cost."""
    own = ["n_blank", "n_duplicate", "n_truncated", "n_illegal", "first_letter", "last_letter", "first_turn", "last_turn", "n_turns", "columns"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.string()), ("item", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])
        conv, places, path, sums, last, turns, low, high = None, [], None, [0] * 4, None, 0, None, None

        def done() -> Iterator[pa.RecordBatch]:
            cost, chosen = path.chosen()
            gaps = high - low + 1 - turns if high is not None else 0
            rows = [{"part": p, "seq": s, "start": a, "item": b} for (p, s), (a, b) in zip(places, chosen, strict=True)]
            rows[-1] |= {"gaps": gaps, "blank": sums[0], "duplicate": sums[1], "truncated": sums[2], "illegal": sums[3], "cost": cost}
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 1000], schema)

        for batch in batches:
            for c, part, seq, blank, duplicate, truncated, illegal, first, end, turn_a, turn_b, n, columns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not places or c != conv:
                    if places:
                        yield from done()
                    conv, places, path, sums, last, turns, low, high = c, [], Path(grammar), [0] * 4, None, 0, None, None
                table: dict[str, Column] = {s: {} for s in grammar.items}
                for x in columns:
                    table[x["start"]][x["item"]] = (x["cost"], x["audit"])
                path.add(table)
                places.append((part, seq))
                for i, x in enumerate((blank, duplicate, truncated, illegal + (last is not None and last + first not in _LEGAL))):
                    sums[i] += x
                last = end
                if n:
                    turns += n - (high == turn_a)
                    low, high = turn_a if low is None else low, turn_b
        if places:
            yield from done()

    order = [F.asc_nulls_first("conv_id"), "part", "seq"]
    out = segments.select("conv_id", "part", "seq", *own).repartition("conv_id").sortWithinPartitions(*order)
    return out.mapInArrow(run, "part int, seq long, start string, item string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def _passed(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """Segments with the items between which they are passed, and the audit of that."""
    segments = _segments(rows, grammar)
    paths = store.keep(_paths(segments, grammar), "repair-paths", small=True)
    mine = F.filter("columns", lambda x: (x["start"] == F.col("start")) & (x["item"] == F.col("item")))
    out = segments.join(paths, ["part", "seq"]).withColumn("audit", F.element_at(mine, 1)["audit"])
    out.kept = [segments, paths]
    return out


def repaired(rows: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """conv_id, part, seq, place, edit, role, text: the repaired rows of (conv_id, turn, role, text), in order of part, seq, place.

    Deleted rows are there with null role and text.  Nulls, ties, repeated rows,
    long texts, empty tables and further columns as in ``report``.
    """
    grammar = grammar or Grammar()
    table = _passed(rows, grammar)
    kind = dict(table.dtypes)["conv_id"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            for c, part, seq, roles, texts, start, audit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                edits = applied(list(zip(roles, texts, strict=True)), audit, start, grammar)
                yield pa.RecordBatch.from_pylist([{"conv_id": c, "part": part, "seq": seq, "place": k, "edit": e, "role": r, "text": t} for k, (e, r, t) in enumerate(edits)], schema)

    return table.select("conv_id", "part", "seq", "roles", "texts", "start", "audit").mapInArrow(run, f"conv_id {kind}, part int, seq long, place long, edit string, role string, text string")


def report(rows: DataFrame, everyone: DataFrame | None = None, grammar: Grammar | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows`` (conv_id, turn, role, text).

    Rows go by turn, nulls first; ties by role and the hash of role and text, so
    equal rows stand together.  A null role or text reads as one space, and rows
    with a null conv_id are one conversation.  A row is blank without a
    character other than white space, else a duplicate if its role and text
    stood earlier, else truncated if it ends in none of ``.!?``.  Gaps are the
    turns missing between the least and the largest.  ``everyone`` has conv_id
    of conversations to report even without rows: zeros, an empty audit, the
    hash of nothing.  Texts of any length are whole, an empty table gives an
    empty one, further columns are not read.  The text of a conversation passes
    one task as a stream, as its hash is one.
    """
    grammar = grammar or Grammar()
    table = _passed(rows, grammar)
    kind = dict(table.dtypes)["conv_id"]
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    @tidied
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for roles, texts, start, audit in zip(*(batch.column(k).to_pylist() for k in range(9, 13)), strict=True):
                edits = applied(list(zip(roles, texts, strict=True)), audit, start, grammar)
                lines.append("\n".join(f"{r}:{t}" for _, r, t in edits if r is not None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:9], batch.column(12), pa.array(lines, pa.string()), pa.array([any(x != "D" for x in a) for a in batch.column(12).to_pylist()])], ["conv_id", "part", "seq", *numbers, "audit", "lines", "some"])

    @tidied
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audit, begun = hashlib.sha256(), [], False
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for row in batch.to_pylist():
                if row["some"]:
                    sha.update(("\n" * begun + row["lines"]).encode())
                    begun = True
                audit.append(row["audit"])
                if row["cost"] is not None:  # the conversation's last segment
                    out.append({k: row[k] for k in ("conv_id", *numbers)} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    sha, audit, begun = hashlib.sha256(), [], False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    lines = table.select("conv_id", "part", "seq", *numbers, "roles", "texts", "start", "audit").mapInArrow(write, f"conv_id {kind}, part int, seq long, {', '.join(f'{n} long' for n in numbers)}, audit string, lines string, some boolean")
    lines = lines.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "seq")
    out = lines.mapInArrow(digest, f"conv_id {kind}, {', '.join(f'{n} long' for n in numbers)}, audit string, repaired_sha256 string")
    out = store.keep(out, "repair-report", small=True)
    store.drop(*table.kept)
    if everyone is None:
        return out
    names = everyone.select(F.col("conv_id").alias("of")).distinct()
    out = names.join(out, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("of").alias("conv_id"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
