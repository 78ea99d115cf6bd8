"""Rules as data: a table of codes with predicates becomes one column, checked against the schema and evaluated in one scan.

A predicate is a SQL condition over the columns of the frame that it is for;
{f} in it stands for each of the rule's fields in turn.  A predicate that is NULL
doesn't hold.  Rows are never dropped.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AREAS, LEVELS = ("validity", "review", "coverage"), ("error", "warning")


@dataclass(frozen=True)
class Rule:
    """A code, what it is about, how bad it is, and when it holds."""

    code: str
    area: str
    level: str
    holds: str
    fields: tuple[str, ...] = ()

    def cases(self) -> list[tuple[str | None, str]]:
        return [(f, self.holds.replace("{f}", f)) for f in self.fields] or [(None, self.holds)]


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from rows (code, area, level, holds, fields), in order of their codes; a rule table is small by nature."""
    return [Rule(r.code, r.area, r.level, r.holds, tuple(r.fields or ())) for r in table.orderBy("code").collect()]


def rule_faults(df: DataFrame, rules: Iterable[Rule]) -> list[str]:
    """What is wrong with the rules themselves: repeated codes, unknown areas and levels, and predicates that this frame can't decide."""
    rules, faults, seen = list(rules), [], set()
    try:  # all at once, which is one analysis; one by one only to name what fails
        known = iter(df.select(*[F.expr(holds).alias(f"_{i}") for i, holds in enumerate(h for r in rules for _, h in r.cases())]).schema.fields)
    except AnalysisException:
        known = None
    for r in rules:
        if r.code in seen:
            faults.append(f"{r.code}: repeated")
        seen.add(r.code)
        if r.area not in AREAS or r.level not in LEVELS:
            faults.append(f"{r.code}: {r.area}, {r.level}")
        for field, holds in r.cases():
            try:
                kind = (next(known) if known else df.select(F.expr(holds)).schema[0]).dataType.simpleString()
            except AnalysisException as e:
                faults.append(f"{r.code}{f' ({field})' if field else ''}: {e.getCondition()}")
            else:
                if kind != "boolean":
                    faults.append(f"{r.code}: a {kind} is no condition")
    return faults


def compiled(df: DataFrame, rules: Iterable[Rule]) -> Column:
    """All issues of a row, in the rules' order: structs of area, level, code and field; ValueError names every bad rule."""
    rules = list(rules)
    if faults := rule_faults(df, rules):
        raise ValueError("; ".join(faults))
    found = [
        F.when(F.expr(holds), F.struct(F.lit(r.area).alias("area"), F.lit(r.level).alias("level"), F.lit(r.code).alias("code"), F.lit(field).cast("string").alias("field")))
        for r in rules for field, holds in r.cases()
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<area:string,level:string,code:string,field:string>>")


def judged(df: DataFrame, rules: Iterable[Rule], strict: bool = False) -> DataFrame:
    """Df with its issues and whether it is valid: no error, or in strict mode no issue at all."""
    bad = F.size("issues") > 0 if strict else F.exists("issues", lambda i: i["level"] == "error")
    return df.withColumn("issues", compiled(df, rules)).withColumn("valid", ~bad)
