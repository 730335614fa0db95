"""Reverse-mode gradients. Values and gradients are expressions of one tape, which compiles what is asked for; nothing runs before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame

from tessera.operators import linalg, maps, norms
from tessera.operators import tape as T
from tessera.operators.tape import Expr
from tessera.operators.tensor import ShapeError, Tensor

_enabled = True


@contextmanager
def no_gradients():
    """Nodes made inside keep no graph."""
    global _enabled
    before, _enabled = _enabled, False
    try:
        yield
    finally:
        _enabled = before


def _matmul(a: Tensor, b: Tensor) -> Tensor:
    return linalg.matmul_abt(a, b)


def _transpose(a: Tensor) -> Tensor:
    return a.transpose()


def matmul_abt(a: Expr, b: Expr) -> Expr:
    if len(a.shape) != 2 or len(b.shape) != 2 or a.shape[1] != b.shape[1]:
        raise ShapeError(f"matmul of {a.shape} and {b.shape}")
    return T.expr("matmul", (a, b), (a.shape[0], b.shape[0]), (_matmul,))


def transpose(a: Expr) -> Expr:
    if len(a.shape) != 2:
        raise ShapeError(f"a matrix is asked for, not {a.shape}")
    return a.args[0] if a.op == "transpose" else T.expr("transpose", (a,), a.shape[::-1], (_transpose,))


def like(g: Expr, x: Expr) -> Expr:
    """A gradient in the shape of what it is for: what a number gave to many places comes back as their sum."""
    if g.shape == x.shape:
        return g
    return T.reduced("sum", g) if x.is_number else T.spread(g, x)


class Node:
    """A value with the nodes it was made of, each with the rule that turns this node's gradient into its share."""

    def __init__(self, value: Tensor | Expr, requires_grad: bool = False, parents: Sequence[tuple[Node, Callable[[Expr], Expr]]] = ()):
        self.expr = value if isinstance(value, Expr) else T.leaf(value.df, "v", value.shape)
        self.parents = [(p, rule) for p, rule in parents if p.requires_grad] if _enabled else []
        self.requires_grad = bool(self.parents) or (requires_grad and not parents)
        self._value = None if isinstance(value, Expr) else value
        self._flow: Expr | None = None
        self._grad: Tensor | None = None

    @staticmethod
    def columns(df: DataFrame, size: int, *names: str, requires_grad: bool = True) -> list[Node]:
        """Vectors that are columns of one frame with a dense idx: they are read together, without a join."""
        return [Node(T.leaf(df, n, (size,)), requires_grad) for n in names]

    @property
    def shape(self) -> tuple[int, ...]:
        return self.expr.shape

    @property
    def value(self) -> Tensor:
        if self._value is None:
            self._value = T.tensor(self.expr)
        return self._value

    @property
    def grad(self) -> Tensor | None:
        if self._grad is None and self._flow is not None:
            self._grad = T.tensor(self._flow)
        return self._grad

    # -- element by element ---------------------------------------------------------------------------------------------------------

    def _with(self, other: Node | float) -> Node:
        return other if isinstance(other, Node) else Node(T.const(other))

    def _binary(self, other: Node | float, op: str, left, right) -> Node:
        y = self._with(other)
        a, b = self.expr, y.expr
        return Node(T.expr(op, (a, b)), parents=[(self, lambda g: like(left(g, a, b), a)), (y, lambda g: like(right(g, a, b), b))])

    def __add__(self, y: Node | float) -> Node:
        return self._binary(y, "add", lambda g, a, b: g, lambda g, a, b: g)

    def __sub__(self, y: Node | float) -> Node:
        return self._binary(y, "subtract", lambda g, a, b: g, lambda g, a, b: T.expr("negate", (g,)))

    def __mul__(self, y: Node | float) -> Node:
        return self._binary(y, "multiply", lambda g, a, b: T.multiply(g, b), lambda g, a, b: T.multiply(g, a))

    def __truediv__(self, y: Node | float) -> Node:
        return self._binary(y, "divide", lambda g, a, b: T.expr("divide", (g, b)), lambda g, a, b: T.expr("negate", (T.expr("divide", (T.multiply(g, a), T.multiply(b, b))),)))

    def _unary(self, op: str, slope: str | float, given: tuple = (), slope_given: tuple = ()) -> Node:
        """``slope`` names the slope as a function of the input, or is the slope itself."""
        x = self.expr
        by = T.const(slope) if isinstance(slope, float) else T.expr(slope, (x,), given=slope_given)
        return Node(T.expr(op, (x,), given=given), parents=[(self, lambda g: T.multiply(g, by))])

    def __neg__(self) -> Node:
        return self._unary("negate", -1.0)

    def __abs__(self) -> Node:
        return self._unary("absolute", "sign")

    def relu(self) -> Node:
        return self._unary("relu", "relu_slope")

    def gelu(self) -> Node:
        return self._unary("gelu", "gelu_slope")

    def silu(self) -> Node:
        return self._unary("silu", "silu_slope")

    def exp(self) -> Node:
        return self._unary("exp", "exp")

    def log(self) -> Node:
        x = self.expr
        return Node(T.expr("log", (x,)), parents=[(self, lambda g: T.expr("divide", (g, x)))])

    def clamp(self, low: float, high: float) -> Node:
        if low > high:
            raise ValueError(f"clamp: low {low} is above high {high}")
        return self._unary("clamp", "within", (low, high), (low, high))

    # -- reductions -----------------------------------------------------------------------------------------------------------------

    def sum(self) -> Node:
        return Node(T.reduced("sum", self.expr), parents=[(self, lambda g: T.spread(g, self.expr))])

    def mean(self) -> Node:
        return Node(T.reduced("mean", self.expr), parents=[(self, lambda g: T.multiply(T.spread(g, self.expr), T.const(1.0 / max(1, self.expr.size))))])

    def _pick(self, op: str, at: str) -> Node:
        x = self.expr
        return Node(T.reduced(op, x), parents=[(self, lambda g: T.expr("pick", (T.reduced(at, x), g, x), x.shape))])

    def max(self) -> Node:
        """The gradient goes to the first of the largest elements."""
        return self._pick("max", "argmax")

    def min(self) -> Node:
        return self._pick("min", "argmin")

    def dot(self, y: Node) -> Node:
        if len(self.shape) != 1:
            raise ShapeError(f"dot of shape {self.shape}")
        return (self * y).sum()

    # -- shape and products ---------------------------------------------------------------------------------------------------------

    def reshape(self, *shape: int) -> Node:
        before = self.shape
        as_shape = lambda e, s: T.expr("same", (e,), s)
        if Tensor(None, tuple(shape)).size != self.expr.size:
            raise ShapeError(f"{self.expr.size} elements don't fill {shape}")
        return Node(as_shape(self.expr, tuple(shape)), parents=[(self, lambda g: as_shape(g, before))])

    def transpose(self) -> Node:
        return Node(transpose(self.expr), parents=[(self, transpose)])

    def matmul_abt(self, b: Node) -> Node:
        x, y = self.expr, b.expr
        return Node(matmul_abt(x, y), parents=[(self, lambda g: matmul_abt(g, transpose(y))), (b, lambda g: matmul_abt(transpose(g), transpose(x)))])

    def map_shards(self, op: maps.ShardOp, *others: Node) -> Node:
        """A caller's function on whole aligned shards of this tensor and ``others``, with its own gradient; see ``maps.ShardOp``."""
        inputs = (self, *others)
        args = tuple(n.expr for n in inputs)
        if any(a.shape != args[0].shape for a in args):
            raise ShapeError(f"shapes {' and '.join(str(a.shape) for a in args)} differ")
        y = T.expr("shards", args, args[0].shape, (maps.shard_forward(op),))

        def rule(k: int) -> Callable[[Expr], Expr]:
            return lambda g: T.expr("shards", (g, y, *args), args[0].shape, (maps.shard_slope(op, k),))

        return Node(y, parents=[(n, rule(k)) for k, n in enumerate(inputs)])

    def softmax(self) -> Node:
        """Over all elements; the largest and the sum come from one state (``online``)."""
        x = self.expr
        p = T.expr("divide", (T.expr("exp", (T.expr("subtract", (x, T.reduced("top", x))),)), T.reduced("mass", x)))

        def rule(g: Expr) -> Expr:
            return T.multiply(p, T.expr("subtract", (g, T.reduced("sum", T.multiply(p, g)))))

        return Node(p, parents=[(self, rule)])

    def layer_norm(self, eps: float = 1e-5) -> Node:
        x = self.expr
        root = T.expr("root", (T.add(T.reduced("variance", x), T.const(eps)),))
        y = T.expr("divide", (T.expr("subtract", (x, T.reduced("mean", x))), root))

        def rule(g: Expr) -> Expr:
            centred = T.expr("subtract", (T.expr("subtract", (g, T.reduced("mean", g))), T.multiply(y, T.reduced("mean", T.multiply(g, y)))))
            return T.expr("divide", (centred, root))

        return Node(y, parents=[(self, rule)])

    def cross_entropy(self, labels: Tensor) -> Node:
        """Soft labels, one softmax over all logits: the slope is p times the sum of labels, less the label."""
        x, y = self.expr, T.leaf(labels.df, "v", labels.shape)
        top, mass = T.reduced("top", x), T.reduced("mass", x)
        loss = T.reduced("sum", T.expr("term", (x, top, mass, y), given=(norms.TINY,)))

        def rule(g: Expr) -> Expr:
            p = T.expr("divide", (T.expr("exp", (T.expr("subtract", (x, top)),)), mass))
            return T.multiply(T.expr("subtract", (T.multiply(p, T.reduced("sum", y)), y)), g)

        return Node(loss, parents=[(self, rule)])

    # -- backward -------------------------------------------------------------------------------------------------------------------

    def backward(self, gradient: Tensor | None = None) -> None:
        """Adds to ``grad`` of every node that this one depends on."""
        if not self.requires_grad:
            raise ValueError("backward of a value that needs no gradient")
        if gradient is None and self.expr.size != 1:
            raise ValueError("backward of more than one element needs a gradient")
        if gradient is not None:
            start = T.leaf(gradient.df, "v", gradient.shape)
        else:
            start = T.const(1.0) if self.expr.is_number else T.spread(T.const(1.0), self.expr)
        order: list[Node] = []
        seen: set[int] = set()
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        flow = {id(self): start}
        for node in reversed(order):
            g = flow[id(node)]
            node._flow, node._grad = g if node._flow is None else T.add(node._flow, g), None
            for parent, rule in node.parents:
                part = rule(g)
                flow[id(parent)] = part if id(parent) not in flow else T.add(flow[id(parent)], part)

    def zero_grad(self) -> None:
        self._flow = self._grad = None
