"""Decision rules compiled to Columns.

A rule is a boolean expression over a record's fields. It is parsed on the driver and becomes a pair
of Columns: its value, and whether it can be evaluated. Both operands of ``and`` / ``or`` are
always evaluated, so what can't be evaluated anywhere makes the whole rule null;
only a chained comparison stops early. Equality takes null as a value; order and arithmetic don't.

A value is held as one Column for each kind it may have at run time (number, string, flag, date,
time, days), all null for null, so that a text in a numeric field stays a text.
"""

from __future__ import annotations

import ast
import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = ("abs", "min", "max", "round", "coalesce")
ORDERED = ("number", "string", "date", "time", "days")


class RuleError(ValueError):
    """The expression is outside the language: it is null for every record."""


@dataclass
class Value:
    """kinds: Column of each kind that the value may have; ok: whether it could be evaluated; items: of a list."""

    kinds: dict[str, Column] = field(default_factory=dict)
    ok: Column | None = None  # None: always
    items: list[Value] | None = None

    def is_null(self) -> Column:
        return reduce(lambda a, b: a & b, [c.isNull() for c in self.kinds.values()], F.lit(True))

    def number(self) -> Column | None:
        """As a number; flags count as 0 and 1."""
        own = [self.kinds["number"]] if "number" in self.kinds else []
        own += [self.kinds["flag"].cast("double")] if "flag" in self.kinds else []
        return F.coalesce(*own) if own else None

    def part(self, kind: str) -> Column | None:
        return self.number() if kind == "number" else self.kinds.get(kind)

    def truthy(self) -> Column:
        if self.items is not None:
            return F.lit(bool(self.items))
        parts = []
        for kind, c in self.kinds.items():
            test = {"number": lambda c: c != 0, "flag": lambda c: c, "string": lambda c: F.length(c) > 0, "days": lambda c: c != 0}.get(kind, lambda c: c.isNotNull())(c)
            parts.append(test)
        return F.coalesce(*parts, F.lit(False)) if parts else F.lit(False)


def both(*oks: Column | None) -> Column | None:
    own = [o for o in oks if o is not None]
    return reduce(lambda a, b: a & b, own) if own else None


def equal(a: Value, b: Value) -> Column:
    """Two-valued: null equals null, values of different kinds differ."""
    if a.items is not None or b.items is not None:
        raise RuleError("lists are for `in` alone")
    tests = [F.coalesce(a.part(k) == b.part(k), F.lit(False)) for k in ORDERED if a.part(k) is not None and b.part(k) is not None]
    return reduce(lambda x, y: x | y, tests, a.is_null() & b.is_null())


def ordered(a: Value, b: Value, op) -> tuple[Column, Column]:
    """(value, whether both are of one kind that has an order)."""
    tests = [op(a.part(k), b.part(k)) for k in ORDERED if a.part(k) is not None and b.part(k) is not None]
    if not tests:
        return F.lit(False), F.lit(False)
    value = F.coalesce(*tests)
    return F.coalesce(value, F.lit(False)), value.isNotNull()


def literal(v) -> Value:
    if v is None:
        return Value()
    if isinstance(v, bool):
        return Value({"flag": F.lit(v)})
    if isinstance(v, int | float):
        return Value({"number": F.lit(float(v))})
    if isinstance(v, str):
        return Value({"string": F.lit(v)})
    raise RuleError(f"literal: {v!r}")


def context_string(c: Column) -> dict[str, Column]:
    """A text as it counts in rules: what looks like an ISO date or time is one, whatever its field says."""
    t = F.trim(c)
    is_date = F.coalesce(t.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.lit(False))
    date = F.when(is_date, F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))
    is_time = F.coalesce(t.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.lit(False))
    stamp = F.when(is_time, t.try_cast("timestamp_ntz"))
    return {"date": date, "time": stamp, "string": F.when(date.isNull() & stamp.isNull(), c)}


def field_value(c: Column, kind: str, raw: Column | None = None) -> Value:
    """A field of a normalized record. raw: the text that stays where it couldn't be read as its type."""
    if kind in ("number", "integer"):
        own = {"number": c.cast("double")}
        return Value(own | context_string(F.when(c.isNull(), raw)) if raw is not None else own)
    if kind == "boolean":
        own = {"flag": c}
        return Value(own | context_string(F.when(c.isNull(), raw)) if raw is not None else own)
    if kind == "day":
        return Value({"date": c})
    if kind == "time":
        return Value({"time": c})
    return Value(context_string(c))


class Compiler:
    def __init__(self, context: dict[str, Value]):
        self.context = context

    def visit(self, node: ast.AST) -> Value:
        handler = getattr(self, f"on_{type(node).__name__}", None)
        if handler is None:
            raise RuleError(f"not in the language: {type(node).__name__}")
        return handler(node)

    def on_Expression(self, node):
        return self.visit(node.body)

    def on_Constant(self, node):
        return literal(node.value)

    def on_Name(self, node):
        if node.id in self.context:
            return self.context[node.id]
        low = node.id.lower()
        if low in ("true", "false"):
            return literal(low == "true")
        if low in ("null", "none"):
            return literal(None)
        raise RuleError(f"unknown name: {node.id}")

    def on_List(self, node):
        items = [self.visit(e) for e in node.elts]
        return Value(ok=both(*(i.ok for i in items)), items=items)

    on_Tuple = on_List

    def on_Attribute(self, node):
        v = self.visit(node.value)
        if node.attr == "days" and "days" in v.kinds:
            c = v.kinds["days"].cast("double")
        elif node.attr in ("year", "month", "day"):
            part = {"year": F.year, "month": F.month, "day": F.dayofmonth}[node.attr]
            own = [part(v.kinds[k]) for k in ("date", "time") if k in v.kinds]
            if not own:
                raise RuleError("no date")
            c = F.coalesce(*own).cast("double")
        else:
            raise RuleError(f"attribute: {node.attr}")
        return Value({"number": c}, both(v.ok, c.isNotNull()))

    def on_UnaryOp(self, node):
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value({"flag": ~v.truthy()}, v.ok)
        if not isinstance(node.op, ast.UAdd | ast.USub) or v.number() is None:
            raise RuleError("unary operator")
        c = v.number() if isinstance(node.op, ast.UAdd) else -v.number()
        return Value({"number": c}, both(v.ok, c.isNotNull()))

    def on_BoolOp(self, node):
        values = [self.visit(v) for v in node.values]
        combine = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
        return Value({"flag": reduce(combine, [v.truthy() for v in values])}, both(*(v.ok for v in values)))

    def on_BinOp(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        kinds: dict[str, Column] = {}
        x, y = a.number(), b.number()
        if x is not None and y is not None:
            if isinstance(node.op, ast.Add):
                kinds["number"] = x + y
            elif isinstance(node.op, ast.Sub):
                kinds["number"] = x - y
            elif isinstance(node.op, ast.Mult):
                kinds["number"] = x * y
            elif isinstance(node.op, ast.Div):
                kinds["number"] = F.try_divide(x, y)
            elif isinstance(node.op, ast.Mod):
                kinds["number"] = F.when(y != 0, x - y * F.floor(F.try_divide(x, y)))
        if isinstance(node.op, ast.Sub) and "date" in a.kinds and "date" in b.kinds:
            kinds["days"] = F.datediff(a.kinds["date"], b.kinds["date"])
        if isinstance(node.op, ast.Add) and "string" in a.kinds and "string" in b.kinds:
            kinds["string"] = F.concat(a.kinds["string"], b.kinds["string"])
        if not kinds or not isinstance(node.op, ast.Add | ast.Sub | ast.Mult | ast.Div | ast.Mod):
            raise RuleError("arithmetic")
        return Value(kinds, both(a.ok, b.ok, ~Value(kinds).is_null()))

    def on_Compare(self, node):
        left = self.visit(node.left)
        ok, value = left.ok, None
        for op, right in zip(node.ops, map(self.visit, node.comparators), strict=True):
            test, fine = self.compare(op, left, right)
            fine = both(right.ok, fine)
            # once a link is false the rest is not looked at
            ok = both(ok, fine if value is None or fine is None else (~value | fine))
            value = test if value is None else value & test
            left = right
        return Value({"flag": value}, ok)

    def compare(self, op, a: Value, b: Value) -> tuple[Column, Column | None]:
        if isinstance(op, ast.Eq | ast.Is):
            return equal(a, b), None
        if isinstance(op, ast.NotEq | ast.IsNot):
            return ~equal(a, b), None
        if isinstance(op, ast.In | ast.NotIn):
            if b.items is None:
                if "string" not in b.kinds or "string" not in a.kinds:
                    raise RuleError("`in` needs a list")
                test = F.contains(b.kinds["string"], a.kinds["string"])
                value, fine = F.coalesce(test, F.lit(False)), test.isNotNull()
            else:
                value, fine = reduce(lambda x, y: x | y, [equal(a, i) for i in b.items], F.lit(False)), None
            return (~value if isinstance(op, ast.NotIn) else value), fine
        ops = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}
        if type(op) not in ops:
            raise RuleError("comparison")
        return ordered(a, b, ops[type(op)])

    def on_Call(self, node):
        name = node.func.id if isinstance(node.func, ast.Name) else ""
        if name not in FUNCTIONS:
            raise RuleError(f"function: {name}")
        args = [self.visit(a) for a in node.args]
        named = {k.arg: self.visit(k.value) for k in node.keywords}
        ok = both(*(a.ok for a in (*args, *named.values())))
        if name == "coalesce":
            if named:
                raise RuleError("coalesce takes no named arguments")
            kinds: dict[str, Column] = {}
            taken = F.lit(False)
            for a in args:  # the first that is not null, whatever its kind
                for kind, c in a.kinds.items():
                    own = F.when(~taken, c)
                    kinds[kind] = F.coalesce(kinds[kind], own) if kind in kinds else own
                taken = taken | ~a.is_null()
            return Value(kinds, ok)
        if name == "round":
            digits = named.get("ndigits", args[1] if len(args) > 1 else None)
            if not args or args[0].number() is None or len(args) > 2:
                raise RuleError("round")
            places = 0 if digits is None else self.constant(node, "ndigits")
            c = F.bround(args[0].number(), places)
            return Value({"number": c}, both(ok, c.isNotNull()))
        if named and set(named) - {"default"}:
            raise RuleError("named arguments")
        if name == "abs":
            if len(args) != 1 or args[0].number() is None:
                raise RuleError("abs")
            c = F.abs(args[0].number())
            return Value({"number": c}, both(ok, c.isNotNull()))
        items = args[0].items if len(args) == 1 and args[0].items is not None else args
        if not items or len(items) == 1 and items is args:
            raise RuleError(f"{name} needs values")
        kinds = {}
        pick = F.least if name == "min" else F.greatest
        for kind in ("number", "string", "date", "time", "days"):
            own = [i.part(kind) for i in items]
            if all(c is not None for c in own):
                every = reduce(lambda a, b: a & b, [c.isNotNull() for c in own])
                kinds[kind] = F.when(every, pick(*own)) if len(own) > 1 else own[0]
        if not kinds:
            raise RuleError(f"{name} of different kinds")
        return Value(kinds, both(ok, *(i.ok for i in items), ~Value(kinds).is_null()))

    def constant(self, node, keyword: str) -> int:
        given = next((k.value for k in node.keywords if k.arg == keyword), node.args[1] if len(node.args) > 1 else None)
        if isinstance(given, ast.UnaryOp) and isinstance(given.op, ast.USub) and isinstance(given.operand, ast.Constant):
            return -int(given.operand.value)
        if isinstance(given, ast.Constant) and isinstance(given.value, int):
            return given.value
        raise RuleError("digits must be a literal")


def compile_rule(expression: str, context: dict[str, Value]) -> Column:
    """The rule as a nullable boolean Column; null where it can't be evaluated."""
    try:
        value = Compiler(context).visit(ast.parse(expression, mode="eval"))
    except (SyntaxError, RuleError):
        return F.lit(None).cast("boolean")
    truth = value.truthy()
    return truth if value.ok is None else F.when(value.ok, truth)


def with_today(context: dict[str, Value], as_of: datetime.date | None = None) -> dict[str, Value]:
    """Adds fecha_actual and datetime_actual; as_of makes runs repeatable."""
    day = F.lit(as_of) if as_of else F.current_date()
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    return context | {"fecha_actual": Value({"date": day}), "datetime_actual": Value({"time": now})}


def columns_context(df, names: list[str] | None = None) -> dict[str, Value]:
    """Typed columns of any table as a rule context."""
    out = {}
    for f in df.schema.fields:
        if names and f.name not in names:
            continue
        kind = f.dataType.simpleString()
        own = "boolean" if kind == "boolean" else "day" if kind == "date" else "time" if kind.startswith("timestamp") else "string" if kind == "string" else "number"
        c = F.col(f.name).cast("timestamp_ntz") if own == "time" else F.col(f.name)
        out[f.name] = field_value(c, own)
    return out
