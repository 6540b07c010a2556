"""What replies of models hold: JSON, citations, sums."""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def unfenced(text: Column) -> Column:
    """The inside of a reply that is one fenced block, else the reply without white space around it."""
    return F.when(text.rlike(fixed.FENCED), F.regexp_extract(text, fixed.FENCED, 1)).otherwise(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""))


def cited(citation: Column) -> Column:
    """(source, path, page, start, end) of a citation, null for what is none; a single line ends where it starts."""
    part = lambda n: F.regexp_extract(citation, fixed.CITATION, n)
    number = lambda n: F.nullif(part(n), F.lit("")).cast("int")
    return F.when(citation.rlike(fixed.CITATION), F.struct(part(1).alias("source"), part(2).alias("path"), number(3).alias("page"), number(4).alias("start"), F.coalesce(number(5), number(4)).alias("end")))


def names(answer: Column, citation: Column) -> Column:
    """Whether an answer holds a citation as it is written, and not inside a longer one."""
    literal = F.concat(F.lit(r"\Q"), F.replace(citation, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.rlike(answer, F.concat(F.lit(r"(?U)(?<![\w/.-])"), literal, F.lit(r"(?![\d-])")))


class NoSum(ValueError):
    pass


_SIGNS: dict[type, Callable] = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.UAdd: operator.pos, ast.USub: operator.neg,
}


def _fits(x: object) -> int | float:
    if isinstance(x, float) and math.isfinite(x) or isinstance(x, int) and x.bit_length() <= fixed.MOST_BITS:
        return x
    raise NoSum("not a real number" if isinstance(x, complex) else "the result is too large")


def calculate(expression: str) -> str:
    """The exact value of + - * / // % ** over numbers and parentheses; NoSum for anything else, a division by zero or a result that is too large.

    Operands are worked out before what they belong to, on a stack, so depth is no matter.
    """
    if len(expression) > fixed.MOST_EXPRESSION:
        raise NoSum("too long")
    # plain whole numbers stand for places in a form that is read once, however many sums are written so
    numbers = _WHOLE.findall(expression) if _PLAIN.fullmatch(expression) else []
    if numbers:
        return _worked(_form(_WHOLE.sub("1", expression)), [int(x) for x in numbers])
    return _worked(_steps(expression), None)


#: Sums of whole numbers without leading zeros, and those numbers; nothing else that digits may belong to.
_PLAIN, _WHOLE = re.compile(r"(?:[ ()+*/%-]|(?<![0-9])(?:0|[1-9][0-9]{0,17})(?![0-9]))+"), re.compile(r"[0-9]+")


def _steps(expression: str) -> list[object]:
    """The steps of a sum on a stack, the last operand first: a number, an operator and how many operands it takes, or None for what is no sum."""
    try:
        todo: list[tuple[ast.expr, bool]] = [(ast.parse(expression.strip(), mode="eval").body, False)]
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        raise NoSum("no arithmetic expression") from None
    out: list[object] = []
    while todo:
        node, ready = todo.pop()
        operands = [node.operand] if isinstance(node, ast.UnaryOp) else [node.left, node.right] if isinstance(node, ast.BinOp) else []
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            out.append(node.value)
        elif not operands or type(node.op) not in _SIGNS:
            out.append(None)
        elif not ready:
            todo += [(node, True), *[(x, False) for x in operands]]
        else:
            out.append((_SIGNS[type(node.op)], len(operands)))
    return out


@lru_cache(4096)
def _form(expression: str) -> list[object]:
    return _steps(expression)


def _worked(steps: list[object], numbers: list[int] | None) -> str:
    """The value of steps; `numbers`, where given, take the place of theirs."""
    done: list[int | float] = []
    own_numbers = reversed(numbers or [])
    for step in steps:
        if step is None:
            raise NoSum("no arithmetic expression")
        if not isinstance(step, tuple):
            done.append(step if numbers is None else next(own_numbers))
            continue
        sign, size = step
        own = [done.pop() for _ in range(size)]
        if sign is operator.pow and all(isinstance(x, int) for x in own) and own[1] > 0 and (abs(own[0]).bit_length() - 1) * own[1] > fixed.MOST_BITS:
            raise NoSum("the result is too large")
        try:
            done.append(_fits(sign(*own)))
        except ZeroDivisionError:
            raise NoSum("division by zero") from None
        except OverflowError:
            raise NoSum("the result is too large") from None
    return str(_fits(done.pop()))


@F.pandas_udf(T.StructType().add("value", "string").add("error", "string"))
def calculated(expressions: pd.Series) -> pd.DataFrame:
    """calculate() of each text: its value, or why there is none."""

    def one(x: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if x is None else calculate(x)), None
        except NoSum as e:
            return None, str(e)

    return pd.DataFrame([one(x) for x in expressions], columns=["value", "error"])
