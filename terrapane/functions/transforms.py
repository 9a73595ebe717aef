"""Elementwise functions of a value, all of them Spark columns."""

from __future__ import annotations

import ast
import importlib.util
import operator
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("power", "inter", "spline")
KNOT = 20.0


class PreprocessError(ValueError):
    """A preprocess setting that cannot be used."""


def missing_to_null(v: Column) -> Column:
    """NaN stands for a missing value in files; here NULL does."""
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def exponents(exp) -> list:
    """An int, a list, an array, or one of these in a list."""
    if hasattr(exp, "tolist"):
        exp = exp.tolist()
    if not isinstance(exp, Iterable):
        exp = [exp]
    flat: list = []
    for e in exp:
        e = e.tolist() if hasattr(e, "tolist") else e
        flat += exponents(e) if isinstance(e, (list, tuple)) else [e]
    if not flat or any(isinstance(e, bool) or not isinstance(e, (int, float)) for e in flat):
        raise ValueError(f"exp must be an int or a list of ints, not {exp!r}")
    return flat


def power(v: Column, exp) -> Column:
    """v to the power exp; to the power 0 it is 1, missing or not."""
    return F.lit(1.0) if exp == 0 else F.pow(v, F.lit(float(exp)))


def spline(v: Column, knot: float = KNOT) -> tuple[Column, Column]:
    """The value, and what it exceeds the knot by."""
    return v, F.when(v > knot, v - knot).when(v.isNotNull(), F.lit(0.0))


def interact(v: Column, other: Column) -> Column:
    return v * other


def lon_to_180(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_to_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def cosine(lat: Column) -> Column:
    return F.cos(F.radians(lat))


BUILTINS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "kelvin_to_celsius": lambda x: x - 273.15,
    "celsius_to_kelvin": lambda x: x + 273.15,
    "pa_to_kpa": lambda x: x / 1000.0,
    "m_to_mm": lambda x: x * 1000.0,
}


def _mod(a, b):
    return a - F.floor(_divide(a, b)) * b


def _divide(a, b):
    return F.try_divide(_column(a), _column(b))


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


_BINARY: dict[type, Callable] = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: _divide,
    ast.Pow: lambda a, b: F.pow(_column(a), _column(b)),
    ast.Mod: _mod,
    ast.FloorDiv: lambda a, b: F.floor(_divide(a, b)).cast("double"),
}
_UNARY: dict[type, Callable] = {ast.UAdd: lambda a: a, ast.USub: lambda a: -a}


def compile_expression(text: str) -> Callable[[Column], Column]:
    """A function of a column from an arithmetic expression in x.  Only arithmetic, numbers and x are allowed."""
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise PreprocessError(f"cannot read the expression {text!r}: {e.msg}") from None

    def walk(node: ast.expr) -> Callable[[Column], Column]:
        match node:
            case ast.Name(id="x"):
                return lambda x: x
            case ast.Constant(value=value) if isinstance(value, (int, float)) and not isinstance(value, bool):
                return lambda x: F.lit(float(value))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
                f = walk(a)
                return lambda x: _UNARY[type(op)](f(x))
            case ast.BinOp(op=op, left=a, right=b) if type(op) in _BINARY:
                f, g = walk(a), walk(b)
                return lambda x: _BINARY[type(op)](f(x), g(x))
        raise PreprocessError(f"{ast.unparse(node)!r} is not allowed in {text!r}")

    made = walk(tree)
    if not any(isinstance(n, ast.Name) for n in ast.walk(tree)):
        raise PreprocessError(f"{text!r} does not use x")
    return made


def load_function(spec: str) -> Callable:
    """The function of "file.py:name".  The file is run: it must be trusted."""
    path, _, name = spec.rpartition(":")
    if not path or not Path(path).is_file():
        raise PreprocessError(f"there is no file {path or spec!r} to take a function from")
    found = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    if not callable(getattr(module, name, None)):
        raise PreprocessError(f"{path} defines no function {name!r}")
    return getattr(module, name)


def resolve(preprocess: str | Callable | None = None, preprocess_from: str | None = None) -> Callable[[Column], Column] | None:
    """A function of a column from a built-in's name, an expression, a callable, or "file.py:name"."""
    if preprocess is not None and preprocess_from is not None:
        raise PreprocessError("preprocess and preprocess_from exclude each other")
    if preprocess_from is not None:
        return load_function(preprocess_from)
    if preprocess is None or callable(preprocess):
        return preprocess
    return BUILTINS.get(preprocess) or compile_expression(preprocess)
