"""Guarded SQL: one statement, read-only unless allowed, on known tables, within a time."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mergelake.operators.schema import EngineError, normalize_table_name


class StatementRefused(EngineError):
    """The statement isn't one that the guard allows."""


class StatementTimeout(EngineError):
    """The statement took too long and was cancelled."""


def logical_plan(spark: SparkSession, text: str):
    """Parsed plan; Spark's parser takes one statement only."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise StatementRefused(str(e).split("\n")[0]) from e


def _nodes(plan):
    yield plan
    for side in ("children", "innerChildren"):
        each = getattr(plan, side)().iterator()
        while each.hasNext():
            node = each.next()
            if hasattr(node, "children") and "QueryPlan" not in str(type(node)):
                yield from _nodes(node)


def is_query(spark: SparkSession, text: str) -> bool:
    """Whether the statement only reads: no command, no write, no change of catalog or settings anywhere in its plan."""
    writes = ("Command", "Insert", "Create", "Drop", "Alter", "Update", "Delete", "Merge", "Truncate", "Set", "Load", "Cache", "Refresh", "Replace", "Overwrite", "Append", "Use", "Add", "Rename", "Recover", "Analyze")
    ok = {"SetOperation"}
    return not any(n in ok or any(n.startswith(w) or n.endswith("Command") for w in writes) for n in (node.nodeName() for node in _nodes(logical_plan(spark, text)))) if text else False


def tables_in(spark: SparkSession, text: str) -> list[str]:
    """Names of the tables that the statement reads (without those that WITH defines), in order of first mention."""
    plan = logical_plan(spark, text)
    found, defined = [], set()
    seen = [plan]
    while seen:
        node = seen.pop(0)
        name = node.nodeName()
        if name == "UnresolvedRelation":
            found.append(node.tableName())
        if name in ("UnresolvedWith", "CTE"):
            each = node.cteRelations().iterator()
            while each.hasNext():
                pair = each.next()
                defined.add(pair._1().lower())
                seen.append(pair._2())
        each = node.children().iterator()
        while each.hasNext():
            seen.append(each.next())
        each = node.subqueries().iterator()
        while each.hasNext():
            seen.append(each.next())
    return [n for n in dict.fromkeys(normalize_table_name(f) for f in found) if n not in defined]


#: Functions that call into the JVM, and table functions that read nothing but their arguments.
CALLS = frozenset({"reflect", "java_method", "try_reflect"})
TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"})


def _iterated(each):
    each = each.iterator()
    while each.hasNext():
        yield each.next()


def reaches_out(spark: SparkSession, text: str) -> str | None:
    """What in the statement reaches beyond the store's tables: code of the JVM, files named as tables, other table functions."""
    plans = [logical_plan(spark, text)]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "UnresolvedRelation" and plan.multipartIdentifier().length() > 1:
            return f"table {plan.tableName()}"
        if name == "UnresolvedTableValuedFunction" and plan.name().mkString(".").lower() not in TABLE_FUNCTIONS:
            return f"table function {plan.name().mkString('.')}"
        if name in ("UnresolvedWith", "CTE"):
            plans += [pair._2() for pair in _iterated(plan.cteRelations())]
        plans += [*_iterated(plan.children()), *_iterated(plan.subqueries())]
        expressions = [*_iterated(plan.expressions())]
        while expressions:
            own = expressions.pop()
            if own.getClass().getSimpleName() in ("UnresolvedFunction", "UnresolvedGenerator") and (called := _called(own).lower()) in CALLS:
                return f"function {called}"
            expressions += [*_iterated(own.children())]
    return None


def _called(function) -> str:
    if function.getClass().getSimpleName() == "UnresolvedGenerator":
        return function.name().funcName()
    return function.nameParts().last()


@dataclass(frozen=True)
class Guard:
    """tables: those that may be read (None: all). seconds: time limit of run()."""

    tables: frozenset[str] | None = None
    seconds: float | None = None

    def check(self, spark: SparkSession, text: str) -> None:
        if not is_query(spark, text):
            raise StatementRefused("only statements that read are allowed")
        if out := reaches_out(spark, text):
            raise StatementRefused(f"{out} isn't open to statements")
        if self.tables is not None and (bad := [t for t in tables_in(spark, text) if t not in self.tables]):
            raise StatementRefused(f"tables {bad} aren't open to this statement")

    def sql(self, spark: SparkSession, text: str) -> DataFrame:
        self.check(spark, text)
        return spark.sql(text)

    def run(self, spark: SparkSession, text: str, most_rows: int) -> list:
        """Rows of the result, most_rows at most; its jobs are cancelled when the time is over."""
        df = self.sql(spark, text)
        tag, late = f"guard-{uuid.uuid4().hex}", threading.Event()
        timer = None
        if self.seconds is not None:

            def stop():
                late.set()
                spark.interruptTag(tag)

            timer = threading.Timer(self.seconds, stop)
        spark.addTag(tag)
        try:
            if timer:
                timer.start()
            return df.limit(most_rows).collect()
        except Exception as e:
            if late.is_set():
                raise StatementTimeout(f"cancelled after {self.seconds} s") from e
            raise
        finally:
            if timer:
                timer.cancel()
            spark.removeTag(tag)
