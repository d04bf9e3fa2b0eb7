"""Configuration, schedules and scaling expressions."""

from __future__ import annotations

import configparser
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Schedule:
    """``start,interval`` repeats, ``a:b`` are single iterations, both may be joined by colons."""

    text: str

    def __call__(self, iteration: int) -> bool:
        for part in self.text.split(":"):
            numbers = [int(x) for x in part.split(",")]
            if len(numbers) == 1:
                if iteration == numbers[0]:
                    return True
            elif iteration >= numbers[0] and (iteration - numbers[0]) % numbers[1] == 0:
                return True
        return False


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_.]+)|(.))")


def vector(text: str, num_iterations: int) -> list[float]:
    """A vector in R's notation of c(), rep(), seq(a, b, length=n), numbers, num_iterations, + - * / and brackets."""
    tokens = [next(x for x in m.groups() if x) for m in _TOKEN.finditer(text.strip())]
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        t = peek()
        if want is not None and t != want:
            raise ValueError(f"{want} is missing in {text!r}")
        at += 1
        return t

    def both(a: list[float], b: list[float], f: Callable[[float, float], float]) -> list[float]:
        n = max(len(a), len(b))
        return [f(a[i % len(a)], b[i % len(b)]) for i in range(n)]

    def arguments() -> tuple[list[list[float]], dict[str, list[float]]]:
        plain, named = [], {}
        take("(")
        while peek() != ")":
            if at + 1 < len(tokens) and tokens[at + 1] == "=":
                name = take()
                take("=")
                named[name] = total()
            else:
                plain.append(total())
            if peek() == ",":
                take()
        take(")")
        return plain, named

    def factor() -> list[float]:
        t = take()
        if t == "(":
            x = total()
            take(")")
            return x
        if t == "-":
            return [-v for v in factor()]
        if t == "num_iterations":
            return [float(num_iterations)]
        if t in ("c", "rep", "seq"):
            plain, named = arguments()
            if t == "c":
                return [v for x in plain for v in x]
            if t == "rep":
                times = (named.get("times") or plain[1])[0]
                return plain[0] * int(times)
            a, b = plain[0][0], plain[1][0]
            n = int((named.get("length") or named.get("length.out") or [abs(b - a) + 1])[0])
            return [a + (b - a) * i / (n - 1) for i in range(n)] if n > 1 else [a]
        return [float(t)]

    def product() -> list[float]:
        x = factor()
        while peek() in ("*", "/"):
            op, y = take(), factor()
            x = both(x, y, (lambda a, b: a * b) if op == "*" else (lambda a, b: a / b))
        return x

    def total() -> list[float]:
        x = product()
        while peek() in ("+", "-"):
            op, y = take(), product()
            x = both(x, y, (lambda a, b: a + b) if op == "+" else (lambda a, b: a - b))
        return x

    out = total()
    if at != len(tokens):
        raise ValueError(f"{text!r} goes on after a vector")
    return out


def scaling(text: str, num_iterations: int) -> Callable[[int], float]:
    """The value of an iteration, counted from 1; beyond the end the last one."""
    values = vector(text, num_iterations)
    return lambda iteration: values[min(iteration - 1, len(values) - 1)]


def fuzzy_coefficient(iteration: int, num_iterations: int) -> float:
    return 0.75 * math.exp(-iteration / (num_iterations / 4))


def default_clusters(genes: int, conds: int, per_row: int = 2) -> tuple[int, int]:
    """Clusters, and slots of a condition."""
    k = round(genes * per_row / 20)
    return k, round(k / 2) if conds >= 60 else round(2 * k / 3)


@dataclass
class Config:
    num_iterations: int = 2000
    clusters: int = 0
    per_row: int = 2
    per_col: int = 0
    min_rows: int = 3
    max_changes_row: int = 1
    max_changes_col: int = 5
    prob_row_change: float = 0.5
    prob_col_change: float = 1.0
    result_frequency: int = 10
    stats_frequency: int = 10
    postadjust: bool = True
    seed: int = 1
    quantile: bool = False
    add_fuzz: str = "rows"
    mask_sequences: bool = True
    #: Motifs searched in a cluster, by iteration; the largest p-value of a place that is stored with its motif.
    nmotifs: str = "c(rep(1, num_iterations/3), rep(2, num_iterations/3))"
    annotate: float = 0.99
    #: The schedules and scalings that a configuration starts from.
    schedules: dict[str, str] = field(default_factory=lambda: {"Rows": "1,2", "Columns": "1,5", "Networks": "1,7", "Motifs": "2,10", "MEME": "1,100", "SetEnrichment": "1,7"})
    scalings: dict[str, str] = field(
        default_factory=lambda: {
            "Rows": "0.3",
            "Networks": "seq(1e-5, 0.5, length=num_iterations*3/4)",
            "Motifs": "c(rep(1e-5, 100), seq(1e-5, 1, length=num_iterations*3/4))",
            "SetEnrichment": "seq(1e-5, 1.0, length=num_iterations*3/4)",
        }
    )

    @classmethod
    def read(cls, *paths: str, **given: object) -> Config:
        """INI files, later ones over earlier ones, and keywords over all; a section [Rows] has schedule and scaling (or scaling_const, scaling_rvec)."""
        ini = configparser.ConfigParser()
        ini.read(paths)
        own = cls()
        for section in ini.sections():
            for key, value in ini[section].items():
                if key in ("schedule", "scaling", "scaling_const", "scaling_rvec"):
                    (own.schedules if key == "schedule" else own.scalings)[section] = value
                elif key == "nmotifs_rvec":
                    own.nmotifs = value
                elif hasattr(own, key) and not isinstance(getattr(own, key), dict):
                    kind = type(getattr(own, key))
                    setattr(own, key, ini[section].getboolean(key) if kind is bool else kind(value))
        for key, value in given.items():
            setattr(own, key, value)
        return own

    def write(self, path: str) -> None:
        ini = configparser.ConfigParser()
        ini["General"] = {k: str(v) for k, v in vars(self).items() if not isinstance(v, dict)}
        for name in {*self.schedules, *self.scalings}:
            ini[name] = {k: v for k, v in (("schedule", self.schedules.get(name)), ("scaling", self.scalings.get(name))) if v}
        with open(path, "w") as f:
            ini.write(f)
