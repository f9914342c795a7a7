"""Scoring rules: an expression over features as one boolean Column.

The text is read with Python's own expression grammar; each node of it maps to
a Column. A rule that cannot be typed (bad syntax, unknown feature, mixed
types) never triggers, and neither does one that fails in a row, such as for a
missing feature, whatever the rest of it says. Integer division drops the
fraction, values of different types are never equal, and ``len`` works on lists
and strings.

Conditions joined by ``&&`` or ``||`` become balanced trees, so a rule of
thousands of conditions is no deep expression. Arithmetic keeps its order and
may nest ``MAX_DEPTH`` levels. A rule beyond that, or of more than ``MAX_TERMS``
terms, is refused with a ``RuleError`` and leaves the rules beside it alone.
"""

from __future__ import annotations

import ast
import logging
import re
from collections.abc import Callable, Sequence
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

INT, FLOAT, STRING, BOOL, LIST = "int", "float", "string", "bool", "list"


# A rule beyond these is refused.
MAX_TERMS = 10_000
MAX_DEPTH = 100

_PYTHON_WORDS = re.compile(r"\b(and|or|not|in|is|if|else|for|lambda|await|yield)\b")


class RuleError(ValueError):
    """The rule has no meaning for the given features, or is too large."""


def balanced(join: Callable[[Column, Column], Column], parts: Sequence[Column]) -> Column:
    """All parts joined, in order, as a tree of least height."""
    while len(parts) > 1:
        joined = [join(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = joined + list(parts[len(joined) * 2:])
    return parts[0]


def _check_size(tree: ast.AST) -> None:
    """Refuse what would be too large or too deep an expression."""
    terms, level, depth = 0, [tree], 0
    while level:
        depth += 1
        terms += sum(isinstance(n, (ast.Name, ast.Constant)) for n in level)
        level = [child for n in level for child in ast.iter_child_nodes(n)
                 if isinstance(child, ast.expr)]
    if terms > MAX_TERMS:
        raise RuleError(f"more than {MAX_TERMS} terms")
    if depth > MAX_DEPTH:
        raise RuleError(f"nested more than {MAX_DEPTH} levels deep")


def feature_columns(schema: T.StructType, exclude: tuple[str, ...] = ()) -> dict:
    """Feature name -> (rule type, Column); times count as epoch milliseconds."""
    known = {}
    for f in schema.fields:
        if f.name in exclude:
            continue
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            known[f.name] = (INT, column.cast("long"))
        elif isinstance(f.dataType, T.FractionalType):
            known[f.name] = (FLOAT, column.cast("double"))
        elif isinstance(f.dataType, T.StringType):
            known[f.name] = (STRING, column)
        elif isinstance(f.dataType, T.BooleanType):
            known[f.name] = (BOOL, column)
        elif isinstance(f.dataType, T.TimestampType):
            known[f.name] = (INT, F.unix_millis(column))
        elif isinstance(f.dataType, T.TimestampNTZType):
            known[f.name] = (INT, F.timestamp_diff(
                "MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column))
        elif isinstance(f.dataType, T.ArrayType):
            known[f.name] = (LIST, column)
    return known


def _python_text(rule: str) -> str:
    """``&&``, ``||`` and ``!`` in Python spelling, outside of string literals."""
    bare = re.sub(r'"(\\.|[^"\\])*"', '""', rule)
    if _PYTHON_WORDS.search(bare):
        raise RuleError("unknown operator")
    # What Python allows and the rule language does not: comments, strings side by
    # side or with a prefix, digits with underscores.
    if re.search(r'#|""\s*""|\w""|\b[0-9][0-9.]*_', bare):
        raise RuleError("not part of the rule language")
    out, quoted, i = [], False, 0
    while i < len(rule):
        two, one = rule[i:i + 2], rule[i]
        if quoted and one == "\\":
            out.append(two)
            i += 2
            continue
        if one == '"':
            quoted = not quoted
        if quoted or one == '"':
            out.append(one)
        elif two in ("&&", "||"):
            out.append(" and " if two == "&&" else " or ")
            i += 1
        elif one == "!" and two != "!=":
            out.append("~")
        elif one == "'":
            raise RuleError("single quotes")
        else:
            out.append(one)
        i += 1
    return "".join(out).strip()


_ARITHMETIC = {
    ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply, ast.Mod: F.try_mod,
}
_COMPARE = {
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
}


def _float_quotient(left: Column, right: Column) -> Column:
    """Floating-point division, where dividing by zero is no error."""
    by_zero = F.when(left > 0, F.lit(float("inf"))).when(
        left < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(right == 0, by_zero).otherwise(F.try_divide(left, right))


def _number_test(lk: str, rk: str, left: Column, right: Column, test: Column) -> Column:
    """A comparison that is false when either side is not a number."""
    for kind, side in ((lk, left), (rk, right)):
        if kind == FLOAT:
            test = test & ~F.isnan(side)
    return test


class _Reader(ast.NodeVisitor):
    """Maps an expression to (type, Column).

    ``needed`` are the values without which the rule is an error in a row:
    missing features, integer overflow, integer division by zero. They are
    keyed by the text they come from, so each is checked once.
    """

    def __init__(self, features: dict):
        self.features = features
        self.needed: dict[str, Column] = {}

    def generic_visit(self, node):
        raise RuleError(f"{type(node).__name__} is not part of the rule language")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Name(self, node):
        if node.id in ("true", "false"):
            return BOOL, F.lit(node.id == "true")
        if node.id not in self.features:
            raise RuleError(f"unknown feature {node.id}")
        kind, column = self.features[node.id]
        self.needed[node.id] = column
        return kind, column

    def visit_Constant(self, node):
        kinds = {int: INT, float: FLOAT, str: STRING}
        if type(node.value) not in kinds:
            raise RuleError(f"literal {node.value!r}")
        kind = kinds[type(node.value)]
        return self._integer(node.value) if kind == INT else (kind, F.lit(node.value))

    @staticmethod
    def _integer(value: int):
        """A literal beyond 64 bits counts as a floating-point number."""
        if -(1 << 63) <= value < 1 << 63:
            # The JVM takes its least integer only as text.
            return INT, F.lit(str(value)).cast("long")
        try:
            return FLOAT, F.lit(float(value))
        except OverflowError as error:
            raise RuleError("number too large") from error

    def visit_BoolOp(self, node):
        parts = [self._typed(v, BOOL) for v in node.values]
        return BOOL, balanced(and_ if isinstance(node.op, ast.And) else or_, parts)

    def visit_UnaryOp(self, node):
        if isinstance(node.op, ast.Invert):
            return BOOL, ~self._typed(node.operand, BOOL)
        if isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and (
                type(node.operand.value) is int):
            return self._integer(-node.operand.value)
        kind, value = self.visit(node.operand)
        if isinstance(node.op, ast.USub) and kind in (INT, FLOAT):
            return kind, F.try_subtract(F.lit(0).cast(_SQL[kind]), value)
        raise RuleError("sign of a value that is no number")

    def visit_BinOp(self, node):
        (lk, left), (rk, right) = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and lk == rk == STRING:
            return STRING, F.concat(left, right)
        if not {lk, rk} <= {INT, FLOAT}:
            raise RuleError(f"arithmetic on {lk} and {rk}")
        kind = INT if lk == rk == INT else FLOAT
        left, right = left.cast(_SQL[kind]), right.cast(_SQL[kind])
        if isinstance(node.op, ast.Div):
            result = _float_quotient(left, right) if kind == FLOAT else F.try_divide(
                F.try_subtract(left, F.try_mod(left, right)), right).cast("long")
        elif type(node.op) in _ARITHMETIC:
            result = _ARITHMETIC[type(node.op)](left, right)
        else:
            raise RuleError(f"operator {type(node.op).__name__}")
        if kind == INT:
            self.needed[ast.unparse(node)] = result
        return kind, result

    def visit_Compare(self, node):
        if len(node.ops) != 1:
            raise RuleError("chained comparison")
        (lk, left), (rk, right) = self.visit(node.left), self.visit(node.comparators[0])
        op = node.ops[0]
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = _number_test(lk, rk, left, right, left == right) if lk == rk else F.lit(False)
            return BOOL, same if isinstance(op, ast.Eq) else ~same
        if type(op) not in _COMPARE:
            raise RuleError(f"operator {type(op).__name__}")
        if not (lk == rk == STRING or {lk, rk} <= {INT, FLOAT}):
            raise RuleError(f"comparison of {lk} and {rk}")
        return BOOL, _number_test(lk, rk, left, right, _COMPARE[type(op)](left, right))

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.func.id != "len" or len(node.args) != 1:
            raise RuleError("only len(x) can be called")
        kind, value = self.visit(node.args[0])
        if kind == LIST:
            return INT, F.size(value).cast("long")
        if kind == STRING:
            return INT, F.octet_length(value).cast("long")
        raise RuleError(f"len of {kind}")

    def _typed(self, node, kind):
        found, value = self.visit(node)
        if found != kind:
            raise RuleError(f"{found} where {kind} is needed")
        return value


_SQL = {INT: "long", FLOAT: "double"}


def compile_rule(rule: str, features: dict) -> Column:
    """Boolean Column of a rule; raises ``RuleError`` when it has no meaning."""
    reader = _Reader(features)
    try:
        tree = ast.parse(_python_text(rule), mode="eval")
        _check_size(tree)
        kind, value = reader.visit(tree)
    except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError) as error:
        raise error if isinstance(error, RuleError) else RuleError(str(error)) from error
    if kind != BOOL:
        raise RuleError(f"rule gives {kind}, not a boolean")
    present = [column.isNotNull() for column in reader.needed.values()]
    return balanced(and_, [*present, F.coalesce(value, F.lit(False))])


def rule_column(rule: str, features: dict) -> Column:
    """Like ``compile_rule``, but a rule without meaning is never true."""
    try:
        return compile_rule(rule, features)
    except RuleError as error:
        log.warning("rule %r never triggers: %s", rule, error)
        return F.lit(False)
