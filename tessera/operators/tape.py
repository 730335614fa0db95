"""Expressions over tensors, each known once, compiled to one chain of projections over one scan of what they stand on.

An expression is element-wise, a reduction to one number, or a cut (a leaf, a product, a transpose, a caller's function on shards). All
element-wise expressions that stand on the same cuts become columns of one frame; a column is computed once however many use it.
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import online
from tessera.operators.tensor import ShapeError, Tensor
from tessera.sources.storage import checkpointed

Shape = tuple[int, ...]

#: Element by element; further arguments are the expression's ``given``.
ELEMENT: dict[str, Callable[..., Column]] = {
    "add": S.add, "subtract": S.subtract, "multiply": S.multiply, "divide": S.divide, "negate": S.negate, "absolute": S.absolute, "sign": S.sign,
    "relu": S.relu, "relu_slope": S.relu_slope, "gelu": S.gelu, "gelu_slope": S.gelu_slope, "silu": S.silu, "silu_slope": S.silu_slope, "clamp": S.clamp,
    "within": lambda x, low, high: F.when((x >= low) & (x <= high), 1.0).otherwise(0.0), "exp": F.exp, "log": F.log, "root": F.sqrt,
    "term": lambda x, top, mass, label, least: F.when(online.probability(x, top, mass) > least, -label * online.log_probability(x, top, mass)).otherwise(0.0),
    "same": lambda x: x,
}
#: To one number; ``idx`` is the element's place.
REDUCE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "variance": F.var_pop,
    "argmax": lambda v: F.max_by("idx", F.struct(v, -F.col("idx"))), "argmin": lambda v: F.min_by("idx", F.struct(v, F.col("idx"))),
}
#: Both from one state.
ONLINE = ("top", "mass")


class Expr:
    """An expression; ``expr`` makes them, so that equal ones are one object."""

    def __init__(self, op: str, args: tuple[Expr, ...], shape: Shape, given: tuple):
        self.op, self.args, self.shape, self.given = op, args, shape, given
        self.known: float | None = None  # of a number that has been computed
        self.frame: DataFrame | None = None  # of a cut
        self.used = 0

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def name(self) -> str:
        return f"n{id(self)}"

    @property
    def is_number(self) -> bool:
        return self.shape == ()

    @property
    def is_element(self) -> bool:
        return self.op in ELEMENT or self.op in ("spread", "pick")


_known: weakref.WeakValueDictionary[tuple, Expr] = weakref.WeakValueDictionary()


def expr(op: str, args: Sequence[Expr] = (), shape: Shape | None = None, given: tuple = ()) -> Expr:
    """The expression of this operation on these arguments; element-wise ones have the shape of the first argument that is no number."""
    args = tuple(args)
    if shape is None:
        shape = next((a.shape for a in args if not a.is_number), ())
        if any(not a.is_number and a.shape != shape for a in args):
            raise ShapeError(f"shapes {' and '.join(str(a.shape) for a in args)} differ")
    key = (op, tuple(map(id, args)), shape, tuple((type(g), g) if isinstance(g, (int, float, str)) else id(g) for g in given))
    found = _known.get(key)
    if found is None:
        found = _known[key] = Expr(op, args, shape, given)
    return found


def const(x: float) -> Expr:
    return expr("const", given=(float(x),))


def leaf(df: DataFrame, column: str, shape: Shape) -> Expr:
    """A column of ``df``, which has idx; leaves of the same frame are read together."""
    return expr("leaf", shape=shape, given=(df, column))


def spread(number: Expr, like: Expr) -> Expr:
    """The number at every place of ``like``."""
    return expr("spread", (number, like), like.shape)


def is_const(e: Expr, x: float) -> bool:
    e = e.args[0] if e.op == "spread" else e
    return e.op == "const" and e.given[0] == x


def add(x: Expr, y: Expr) -> Expr:
    return expr("add", (x, y))


def multiply(x: Expr, y: Expr) -> Expr:
    for a, b in ((x, y), (y, x)):
        if is_const(a, 1.0) and (b.shape == a.shape or a.is_number):
            return b
    return expr("multiply", (x, y))


def reduced(op: str, x: Expr) -> Expr:
    if op not in ("sum", "mean", "variance") and not x.size:
        raise ShapeError("no elements to choose from")
    return expr(op, (x,), ())


# -- compiling ------------------------------------------------------------------------------------------------------------------------


def column_of(e: Expr) -> Column:
    if e.known is not None or e.op == "const":
        return F.lit(e.given[0] if e.op == "const" else e.known)
    return F.col(e.name)


def computed(e: Expr) -> Column:
    """An element-wise expression from its arguments' columns."""
    args = [column_of(a) for a in e.args]
    if e.op == "spread":
        return args[0].cast("double")
    if e.op == "pick":  # the second at the place that the first tells
        return F.when(F.col("idx") == args[0], args[1]).otherwise(0.0)
    return ELEMENT[e.op](*args, *e.given)


def region(wanted: Iterable[Expr]) -> tuple[list[Expr], list[Expr], list[Expr]]:
    """What element-wise expressions of one size need: themselves in order, the cuts they stand on, and the numbers they use."""
    steps: list[Expr] = []
    cuts: dict[int, Expr] = {}
    numbers: dict[int, Expr] = {}
    likes: list[Expr] = []
    seen: set[int] = set()
    stack = [(e, False) for e in wanted]
    while stack:
        e, done = stack.pop()
        if done:
            steps.append(e)
        elif id(e) not in seen:
            seen.add(id(e))
            if e.is_number:
                if e.op != "const" and e.known is None:
                    numbers[id(e)] = e
            elif e.is_element:
                stack.append((e, True))
                below = e.args[:-1] if e.op in ("spread", "pick") else e.args
                likes += e.args[len(below):]
                stack += [(a, False) for a in below]
            else:
                cuts[id(e)] = e
    if not cuts:  # only the places matter: those of one cut below
        while likes[0].is_element:
            likes[0] = next(a for a in reversed(likes[0].args) if not a.is_number)
        cuts[id(likes[0])] = likes[0]
    return steps, list(cuts.values()), list(numbers.values())


def cut_frame(e: Expr) -> DataFrame:
    """(idx, v) of a cut that isn't a leaf. The second time it is asked for it is written, so that plans don't double with each product."""
    if e.frame is None:
        e.frame = e.given[0](*[tensor(a) for a in e.args]).df.select("idx", F.col("v").cast("double").alias("v"))
    e.used += 1
    if e.used == 2 and e.op != "transpose":  # nothing is saved by writing an order of columns
        e.frame = checkpointed(e.frame)
    return e.frame


def columns(wanted: Sequence[Expr]) -> DataFrame:
    """idx and a column for each of ``wanted``, which have one size: one scan for each frame below, one projection for each step that
    others build upon more than once, numbers as one row joined by broadcast."""
    steps, cuts, numbers = region(wanted)
    frames: dict[int, list] = {}
    for c in cuts:
        if c.op == "leaf":
            df, name = c.given
            frames.setdefault(id(df), [df, []])[1].append(F.col(f"`{name}`").cast("double").alias(c.name))
        else:
            frames[id(c)] = [cut_frame(c), [F.col("v").alias(c.name)]]
    base, *others = [df.select("idx", *names) for df, names in frames.values()]
    for other in others:
        base = base.join(other, "idx")
    if numbers:
        base = base.crossJoin(F.broadcast(one_row(numbers)))
    level: dict[int, int] = {}
    for e in steps:
        level[id(e)] = 1 + max((level.get(id(a), 0) for a in e.args), default=0)
    for n in range(1, 1 + max(level.values(), default=0)):  # what isn't needed any more is pruned by the optimiser
        base = base.withColumns({e.name: computed(e).cast("double") for e in steps if level[id(e)] == n})
    return base.select("idx", *[column_of(e).alias(e.name) for e in wanted])


def below(numbers: Iterable[Expr]) -> tuple[list[Expr], list[Expr]]:
    """Element-wise steps over numbers, in order, and what they start from: reductions, and leaves of one element."""
    steps: list[Expr] = []
    starts: dict[int, Expr] = {}
    seen: set[int] = set()
    stack = [(e, False) for e in numbers]
    while stack:
        e, done = stack.pop()
        if done:
            steps.append(e)
        elif id(e) not in seen and e.op != "const" and e.known is None:
            seen.add(id(e))
            if e.is_element:
                stack.append((e, True))
                stack += [(a, False) for a in e.args]
            else:
                starts[id(e)] = e
    return steps, list(starts.values())


def settle(numbers: list[Expr]) -> None:
    """Computes numbers now, in one small job, and remembers them."""
    row = one_row(numbers).first()
    for e in numbers:
        e.known = math.nan if row[e.name] is None else float(row[e.name])


def one_row(numbers: list[Expr]) -> DataFrame:
    """One row with a column for each number: one aggregate for all reductions that stand on the same cuts.

    A reduction of something that needs reductions itself has those computed first, one job a level; else plans would double a level.
    """
    steps, starts = below(numbers)
    groups: dict[tuple, list[Expr]] = {}
    inner: dict[int, Expr] = {}
    for e in starts:
        if e.op == "leaf":
            groups[("leaf", id(e))] = [e]
            continue
        _, cuts, needs = region(e.args)
        inner |= {id(n): n for n in needs}
        key = (e.op in ONLINE and id(e.args[0]), *sorted(id(c.given[0]) if c.op == "leaf" else id(c) for c in cuts))
        groups.setdefault(key, []).append(e)
    if inner:
        settle(list(inner.values()))
    rows = []
    for group in groups.values():
        if group[0].op == "leaf":
            df, name = group[0].given
            rows.append(df.select(F.col(f"`{name}`").cast("double").alias(group[0].name)))
            continue
        args = list({id(e.args[0]): e.args[0] for e in group}.values())
        frame = columns(args)
        if group[0].op in ONLINE:
            state = online.states(frame.withColumn("_key", F.lit(0).cast("long")), "_key", args[0].name)
            rows.append(state.select(*[F.col(e.op).alias(e.name) for e in group]))
        else:
            rows.append(frame.agg(*[REDUCE[e.op](F.col(e.args[0].name)).cast("double").alias(e.name) for e in group]))
    out, *others = rows
    for other in others:
        out = out.crossJoin(F.broadcast(other))  # one row each
    for e in steps:
        out = out.withColumn(e.name, computed(e).cast("double"))
    return out.select(*[F.col(e.name) for e in numbers])


def tensor(e: Expr) -> Tensor:
    """An expression as a tensor."""
    if not e.is_number:
        return Tensor(columns([e]).select("idx", F.col(e.name).alias("v")), e.shape)
    if e.op == "const" or e.known is not None:
        return Tensor(SparkSession.active().range(1).select(F.col("id").alias("idx"), column_of(e).alias("v")), ())
    return Tensor(one_row([e]).select(F.lit(0).cast("long").alias("idx"), F.col(e.name).alias("v")), ())
