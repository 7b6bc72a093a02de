"""Formulas given as text: numbers, cells of tables, + - * /, brackets. Nothing is ever evaluated as text.

A text is read to a syntax tree, and what is not one of the closed forms below is refused. What is left
is a program for a stack of numbers and a list of the cells that it reads: rows of a DataFrame, which
are joined with the tables' cells; the program is folded over what was found.

Cells are written as ``get_val(df1, code='60', keyword='profit')`` or as
``float(df1[df1['1'].astype(str).str.strip() == '60']['3'].values[0])``: the table, the column that is
compared, with one text, several (``isin``) or a part of one (``str.contains``), and the column that is
read. Around it may stand ``pd.Series``, ``replace``, ``fillna``; ``.values[0]`` and ``.iloc[0]`` need a
number there, ``.get(0, default)`` and ``safe_get_first(..., default)`` have a default.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .cut import cut
from .lookup import TABLE, get_val

CELL = "struct<variable:string,by:string,codes:array<string>,part:boolean,col:string,code:string,keyword:string,fallback:double>"
PROGRAM = f"struct<program:array<struct<op:string,value:double>>,cells:array<{CELL}>,error:string>"
#: Corrections of a text that are asked for.
ATTEMPTS = 4
_OPS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
_NO = {"by": None, "codes": None, "part": None, "col": None, "code": None, "keyword": None, "fallback": None}


class Refused(ValueError):
    """The text holds something that no formula may hold."""


def _text(node: ast.AST) -> str:
    if isinstance(node, ast.Constant) and isinstance(node.value, (str, int)) and not isinstance(node.value, bool):
        return str(node.value)
    raise Refused(f"a text was expected: {ast.unparse(node)}")


def _number(node: ast.AST) -> float:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return float(node.value)
    raise Refused(f"a number was expected: {ast.unparse(node)}")


def _method(node: ast.AST, *names: str) -> ast.Call | None:
    return node if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in names else None


def _column(node: ast.AST, variable: str) -> str:
    """The column in df['1'].astype(str).str.strip() and the like."""
    while not isinstance(node, ast.Subscript):
        if call := _method(node, "astype", "strip", "lower"):
            node = call.func.value
        elif isinstance(node, ast.Attribute) and node.attr == "str":
            node = node.value
        else:
            raise Refused(f"not a column: {ast.unparse(node)}")
    if not (isinstance(node.value, ast.Name) and node.value.id == variable):
        raise Refused(f"a column of another table: {ast.unparse(node)}")
    return _text(node.slice)


def _rows(test: ast.AST, variable: str) -> dict:
    if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], ast.Eq):
        return {"by": _column(test.left, variable), "codes": [_text(test.comparators[0])], "part": False}
    if (call := _method(test, "isin")) and len(call.args) == 1 and isinstance(call.args[0], (ast.List, ast.Tuple)):
        return {"by": _column(call.func.value, variable), "codes": [_text(e) for e in call.args[0].elts], "part": False}
    if (call := _method(test, "contains")) and call.args:
        return {"by": _column(call.func.value, variable), "codes": [_text(call.args[0])], "part": True}
    raise Refused(f"not a choice of rows: {ast.unparse(test)}")


def _selection(node: ast.AST) -> dict:
    """df[rows][column], with what may stand around it."""
    if (call := _method(node, "replace", "fillna")) is not None:
        return _selection(call.func.value)
    if (call := _method(node, "Series")) is not None and isinstance(call.func.value, ast.Name) and call.func.value.id == "pd" and len(call.args) == 1:
        return _selection(call.args[0])
    if isinstance(node, ast.Attribute) and node.attr in ("values", "iloc"):
        return _selection(node.value)
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Subscript) and isinstance(node.value.value, ast.Name):
        variable = node.value.value.id
        return _NO | {"variable": variable, **_rows(node.value.slice, variable), "col": _text(node.slice)}
    raise Refused(f"not a cell: {ast.unparse(node)}")


def _cell(node: ast.AST) -> dict:
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        name, args = node.func.id, node.args
        if name == "float" and len(args) == 1 and not node.keywords:
            return _cell(args[0])
        if name == "get_val" and args and isinstance(args[0], ast.Name):
            given = dict(zip(("code", "keyword"), args[1:])) | {k.arg: k.value for k in node.keywords}
            if set(given) <= {"code", "keyword"} and len(args) <= 3:
                return _NO | {"variable": args[0].id, **{k: _text(v) for k, v in given.items()}}
        if name == "safe_get_first" and 1 <= len(args) <= 2:
            return _selection(args[0]) | {"fallback": _number(args[1]) if len(args) == 2 else 0.0}
        raise Refused(f"unknown: {name}")
    if (call := _method(node, "get")) is not None and len(call.args) == 2 and _number(call.args[0]) == 0:
        return _selection(call.func.value) | {"fallback": _number(call.args[1])}
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Attribute) and _number(node.slice) == 0:
        return _selection(node.value)
    raise Refused(f"unknown: {ast.unparse(node)[:80]}")


def compiled(text: str | None) -> dict:
    """A text as {program, cells, error}; of a text that is refused only the error."""
    program: list[dict] = []
    cells: list[dict] = []

    def walk(node: ast.AST) -> None:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            walk(node.left)
            walk(node.right)
            program.append({"op": _OPS[type(node.op)], "value": None})
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            program.append({"op": "number", "value": 0.0})
            walk(node.operand)
            program.append({"op": "-", "value": None})
        elif isinstance(node, ast.Constant):
            program.append({"op": "number", "value": _number(node)})
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "float" and len(node.args) == 1 and isinstance(node.args[0], (ast.BinOp, ast.Constant)):
            walk(node.args[0])
        else:
            cells.append(_cell(node))
            program.append({"op": "cell", "value": float(len(cells) - 1)})

    try:
        walk(ast.parse((text or "").strip(), mode="eval").body)
    except Refused as e:
        return {"program": None, "cells": None, "error": f"refused: {e}"}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"program": None, "cells": None, "error": "refused: not an expression"}
    return {"program": program, "cells": cells, "error": None}


def parsed(text: str) -> Column:
    """compiled() of a column of texts."""

    @F.pandas_udf(PROGRAM)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compiled(t) for t in texts], columns=["program", "cells", "error"])

    return parse(F.col(text))


def _result(program: Column, found: Column) -> Column:
    """The number that a program leaves, null where a cell is missing or a divisor is 0."""
    two = lambda s, op: F.concat(F.slice(s, 1, F.size(s) - 2), F.array(op(F.element_at(s, -2), F.element_at(s, -1))))

    def step(s: Column, x: Column) -> Column:
        return (
            F.when(x["op"] == "number", F.concat(s, F.array(x["value"])))
            .when(x["op"] == "cell", F.concat(s, F.array(F.element_at(found, x["value"].cast("int")))))
            .when(x["op"] == "+", two(s, lambda a, b: a + b))
            .when(x["op"] == "-", two(s, lambda a, b: a - b))
            .when(x["op"] == "*", two(s, lambda a, b: a * b))
            .otherwise(two(s, F.try_divide))
        )

    return F.aggregate(program, F.array().cast("array<double>"), step, lambda s: F.element_at(s, -1))


def evaluate(texts: DataFrame, frames: DataFrame, cells: DataFrame) -> DataFrame:
    """texts (id, text) with value and error: a number, or why there is none.

    frames: (id, variable, report_id, table_index), what a text's names stand for; cells: (report_id,
    table_index, row, col, text, num). Of the rows that a cell's test chooses the first counts; a blank
    is no number, but 0 where there is a default. Errors are refused texts, unknown tables, rows
    that aren't there (without a default), blanks, and divisions by 0. Ids stand in texts once.
    """
    read = cut(texts.select("id", "text", parsed("text").alias("p")), "parsed")
    wanted = read.select("id", F.posexplode("p.cells").alias("slot", "c")).select("id", "slot", "c.*").join(frames.select("id", "variable", *TABLE), ["id", "variable"], "left")
    wanted = cut(wanted, "cells-wanted")
    own, named = wanted.where("by is not null and report_id is not null"), wanted.where("by is null and report_id is not null")
    found = []
    # each form meets the cells once, and only where there are such; what follows stays where a table lies
    if own.limit(1).count():
        at = cells.select(*TABLE, "row", F.col("col").cast("string").alias("at"), "num", strip("text").alias("match_text"))
        same = F.when(F.col("part"), F.contains(F.lower("match_text"), F.lower(F.get("codes", F.lit(0))))).otherwise(F.array_contains("codes", F.col("match_text")))
        met = own.select("id", "slot", *TABLE, "by", "codes", "part", "col").join(at, TABLE).where("at = by or at = col")
        rows = met.groupBy("id", "slot", *TABLE, "row").agg(F.max((F.col("at") == F.col("by")) & same).alias("chosen"), F.max(F.when(F.col("at") == F.col("col"), F.col("num"))).alias("num"))
        found.append(rows.where("chosen").groupBy("id", "slot", *TABLE).agg(F.min_by("num", "row").alias("num")).select("id", "slot", F.lit(True).alias("row_found"), "num"))
    if named.limit(1).count():
        by_name = get_val(cells, named.select(*TABLE, "code", "keyword"))
        keys = [named[c].eqNullSafe(by_name[c]) for c in (*TABLE, "code", "keyword")]
        found.append(named.join(by_name, keys[0] & keys[1] & keys[2] & keys[3]).select(named["id"], named["slot"], F.lit(True).alias("row_found"), by_name["value"].alias("num")))
    got = wanted.select("id", "slot", "variable", "report_id", "fallback")
    if found:
        got = got.join(reduce(DataFrame.unionByName, found), ["id", "slot"], "left")
    else:
        got = got.withColumns({"row_found": F.lit(None).cast("boolean"), "num": F.lit(None).cast("double")})
    value = F.coalesce("num", F.when(F.col("row_found") & F.col("fallback").isNotNull(), 0.0), "fallback")
    why = F.when(F.col("report_id").isNull(), F.concat(F.lit("no table "), "variable")).when(value.isNull(), F.when(F.col("row_found"), "blank cell").otherwise("no such row"))
    by_id = got.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.when(why.isNull(), value).alias("value")))).alias("found"), F.min_by(why, F.when(why.isNotNull(), F.col("slot"))).alias("why"))
    both = read.join(by_id, "id", "left")
    number = F.when(F.col("p.error").isNull() & F.col("why").isNull(), _result(F.col("p.program"), F.coalesce("found", F.create_map().cast("map<int,double>"))))
    error = F.coalesce("p.error", "why", F.when(F.col("value").isNull(), "division by zero"))
    return cut(both.withColumn("value", number).select("id", "text", "value", error.alias("error")), "evaluated")


def corrected(texts: DataFrame, frames: DataFrame, cells: DataFrame, correct: Callable[[DataFrame], DataFrame] | None, attempts: int = ATTEMPTS) -> DataFrame:
    """texts (id, text) to (id, text, value, attempt, error): evaluated, and those that fail asked for again, up to ``attempts`` times.

    ``correct`` takes (id, text, error, attempt) of all that have failed so far and gives (id, text) for
    those that it can mend; it is asked once an attempt, for all together. Rows that succeed leave, and only
    mended texts are evaluated again, as any other fails as before. The rest keeps its last error and has no
    value: it is for the cascade. Without ``correct`` nothing is asked.
    """
    open_, stay, done = texts.select("id", "text"), None, []
    for k in range(attempts + 1):
        got = evaluate(open_, frames, cells)
        done.append(got.where("error is null").withColumn("attempt", F.lit(k)))
        failed = got.where("error is not null")
        failed = failed if stay is None else failed.unionByName(stay)
        if k == attempts or correct is None or failed.limit(1).count() == 0:
            done.append(failed.withColumn("attempt", F.lit(k)))
            break
        mended = correct(failed.select("id", "text", "error", F.lit(k + 1).alias("attempt"))).select("id", F.col("text").alias("new_"))
        asked = cut(failed.join(mended.dropDuplicates(["id"]), "id", "left"), "corrected")
        open_ = asked.where("new_ is not null").select("id", F.col("new_").alias("text"))
        stay = asked.where("new_ is null").drop("new_")
    return reduce(DataFrame.unionByName, done).select("id", "text", "value", "attempt", "error")
