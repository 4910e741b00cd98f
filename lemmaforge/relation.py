"""Relations, conditional statements and class relations, with their aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import numeric as nf
from .pred import TRUE, Compare, Pred, conj

TIGHT = 1e-12


@dataclass(frozen=True)
class All(Pred):
    """Conjunction of relations; its slack is the least of theirs."""

    parts: tuple[Compare, ...]

    def column(self):
        return conj(self.parts).column()

    def label(self):
        return " ∧ ".join(p.label() for p in self.parts)

    def sql(self):
        return "(" + " AND ".join(p.sql() for p in self.parts) + ")"

    def slack(self):
        s = [p.slack() for p in self.parts]
        return F.least(*s) if len(s) > 1 else s[0]

    def applicable(self):
        out = self.parts[0].applicable()
        for p in self.parts[1:]:
            out = out & p.applicable()
        return out


@dataclass(frozen=True)
class Any_(Pred):
    """Disjunction of relations; its slack is the largest of theirs."""

    parts: tuple[Compare, ...]

    def column(self):
        out = self.parts[0].column()
        for p in self.parts[1:]:
            out = out | p.column()
        return out

    def label(self):
        return " ∨ ".join(p.label() for p in self.parts)

    def sql(self):
        return "(" + " OR ".join(p.sql() for p in self.parts) + ")"

    def slack(self):
        s = [p.slack() for p in self.parts]
        return F.greatest(*s) if len(s) > 1 else s[0]

    def applicable(self):
        out = self.parts[0].applicable()
        for p in self.parts[1:]:
            out = out | p.applicable()
        return out


@dataclass(frozen=True)
class Statement:
    """hypothesis ⇒ conclusion."""

    hypothesis: Pred
    conclusion: Pred
    name: str = ""
    stage: str = field(default="", compare=False)

    def column(self) -> Column:
        return ~self.hypothesis.column() | self.conclusion.column()

    def label(self) -> str:
        return f"({self.hypothesis.label()}) ⇒ {self.conclusion.label()}"

    def contrapositive(self) -> Statement:
        return Statement(~self.conclusion, ~self.hypothesis, self.name, self.stage)

    def violated(self) -> Column:
        return self.hypothesis.column() & ~self.conclusion.column()

    def failures(self, df: DataFrame) -> DataFrame:
        """Rows where the hypothesis holds and the conclusion does not, with ``__slack__``."""
        slack = self.conclusion.slack() if hasattr(self.conclusion, "slack") else F.lit(None).cast("double")
        return df.filter(self.violated()).withColumn("__slack__", slack)

    def pretty(self) -> str:
        from .export.unicode import pretty_statement

        return pretty_statement(self)

    def quantified(self) -> str:
        return f"∀ rows: {self.label()}"


def _measured(df: DataFrame, statements: list[Statement]) -> DataFrame:
    """One row of metrics of all statements: truth values and slacks are columns first, each hypothesis once, so the aggregates stay short.

    Per statement i: support, touch (applicable rows), touch_all (all rows, slack exactly 0), holds, violations, least, mean and largest slack.
    """
    hyps = list(dict.fromkeys(s.hypothesis for s in statements))
    values, out = [h.column().alias(f"h{j}") for j, h in enumerate(hyps)], []
    for i, s in enumerate(statements):
        h, ok, c = F.col(f"h{hyps.index(s.hypothesis)}"), F.col(f"c{i}"), s.conclusion
        values.append(c.column().alias(f"c{i}"))
        out += [F.count_if(h).alias(f"support_{i}"), F.count_if(h & ok).alias(f"holds_{i}"), F.count_if(h & ~ok).alias(f"violations_{i}")]
        if hasattr(c, "slack"):
            slack, on = F.col(f"s{i}"), F.col(f"a{i}")
            values += [nf.only_finite(c.slack()).alias(f"s{i}"), c.applicable().alias(f"a{i}")]
            out += [F.count_if(h & on & (F.abs(slack) <= TIGHT)).alias(f"touch_{i}"), F.count_if(slack == 0).alias(f"touch_all_{i}")]
            out += [f(F.when(h, slack)).alias(f"{n}_slack_{i}") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    return df.select(*values).agg(*out)


METRICS = "conj_id int, support long, holds long, violations long, touch long, touch_all long, min_slack double, avg_slack double, max_slack double"


def evaluate(df: DataFrame, statements: list[Statement], chunk: int = 30) -> dict[int, dict]:
    """Metrics of each statement by position; one aggregate job per ``chunk`` statements, nothing else leaves the executors."""
    out: dict[int, dict] = {}
    names = [c.split()[0] for c in METRICS.split(", ")[1:]]
    for lo in range(0, len(statements), chunk):
        part = statements[lo : lo + chunk]
        row = _measured(df, part).first().asDict()
        for i, s in enumerate(part):
            m = {n: row.get(f"{n}_{i}") for n in names}
            m["accuracy"] = (m["holds"] / m["support"]) if m["support"] else 0.0
            out[lo + i] = m
    return out


def metrics_frame(df: DataFrame, statements: list[Statement]) -> DataFrame:
    """The metrics as a small catalog table."""
    found = evaluate(df, statements)
    rows = [(i, s.hypothesis.label(), s.conclusion.label(), *(found[i][c] for c in ("support", "holds", "violations", "touch", "touch_all", "min_slack", "avg_slack", "max_slack", "accuracy"))) for i, s in enumerate(statements)]
    return df.sparkSession.createDataFrame(rows, "conj_id int, hypothesis string, conclusion string, support long, holds long, violations long, touch long, touch_all long, min_slack double, avg_slack double, max_slack double, accuracy double")


@dataclass(frozen=True)
class Inclusion:
    """A ⊆ B over rows."""

    a: Pred
    b: Pred

    def violated(self) -> Column:
        return self.a.column() & ~self.b.column()

    def label(self):
        return f"{self.a.label()} ⊆ {self.b.label()}"


@dataclass(frozen=True)
class Equivalence:
    """A ≡ B over rows."""

    a: Pred
    b: Pred

    def violated(self) -> Column:
        return self.a.column() != self.b.column()

    def label(self):
        return f"{self.a.label()} ≡ {self.b.label()}"


def class_relation_counts(df: DataFrame, relations: list[Inclusion | Equivalence]) -> DataFrame:
    row = df.agg(F.count("*").alias("n"), *[F.count_if(r.violated()).alias(f"v{i}") for i, r in enumerate(relations)]).first()
    rows = [(r.label(), int(row[f"v{i}"]), row[f"v{i}"] == 0) for i, r in enumerate(relations)]
    return df.sparkSession.createDataFrame(rows, "relation string, violations long, holds_all boolean")


def for_all(df: DataFrame, p: Pred) -> bool:
    """True on an empty table."""
    return bool(df.agg(F.coalesce(F.bool_and(p.column()), F.lit(True))).first()[0])


def exists(df: DataFrame, p: Pred) -> bool:
    return bool(df.agg(F.coalesce(F.bool_or(p.column()), F.lit(False))).first()[0])


def witnesses(df: DataFrame, p: Pred) -> DataFrame:
    return df.filter(p.column())


def base_of(df: DataFrame, flags: list[Pred]) -> Pred:
    """The conjunction of the flags that hold on every row, TRUE if none does."""
    if not flags:
        return TRUE
    row = df.agg(*[F.coalesce(F.bool_and(p.column()), F.lit(False)).alias(f"f{i}") for i, p in enumerate(flags)]).first()
    return conj([p for i, p in enumerate(flags) if row[i]])
