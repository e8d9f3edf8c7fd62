"""Strings that no regular expression can treat, as Arrow-batched pandas functions."""

import difflib
import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def without_comments(s: str) -> str:
    """Text without comments (* *), which may nest; quotes inside text and comments hide the marks."""
    out, depth, quoted, i = [], 0, False, 0
    while i < len(s):
        two = s[i : i + 2]
        if s[i] == '"':
            quoted = not quoted
        if not quoted and two == "(*":
            depth, i = depth + 1, i + 2
            continue
        if not quoted and two == "*)" and depth:
            depth, i = depth - 1, i + 2
            continue
        if not depth:
            out.append(s[i])
        i += 1
    return "".join(out)


def conclusion(s: str) -> str:
    """What follows the last -> outside brackets; all of it without one."""
    depth, at = 0, 0
    for i, c in enumerate(s):
        depth += (c in "([{") - (c in ")]}")
        if not depth and s.startswith("->", i):
            at = i + 2
    return s[at:].strip()


def renaming(a: str, b: str) -> dict[str, str]:
    """Names of a that stand for other names of b, from aligning their tokens."""
    x, y = (re.findall(r"[A-Za-z_][\w']*|\S", s) for s in (a, b))
    out: dict[str, str] = {}
    for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "replace" and j - i == m - k:
            for p, q in zip(x[i:j], y[k:m], strict=True):
                if p[0].isalpha() and q[0].isalpha():
                    out.setdefault(p, q)
    return out


def renamed(text: str, names: dict[str, str], keep: frozenset[str] = frozenset()) -> str:
    for p in sorted(names, key=lambda n: (-len(n), n)):
        if p not in keep:
            text = re.sub(rf"(?<![\w']){re.escape(p)}(?![\w'])", lambda _, q=names[p]: q, text)
    return text


# Words that bind the names after them, and what ends the names.
BINDERS, ENDS = frozenset({"forall", "exists", "fun"}), frozenset({":", ",", "=>"})


def _tokens(s: str) -> list[str]:
    return re.findall(r"[A-Za-z_][\w']*|[0-9]+|->|=>|<=|>=|<>|\S", s)


def unified(a: list[str], b: list[str], names: dict[str, str], of_a: frozenset[str], of_b: frozenset[str]) -> dict[str, str] | None:
    """names, extended so that expression a becomes b; null if that can't be.

    names maps variables of a to those of b, one to one.  Names bound within the
    expressions may differ; they hold up to the end of their brackets.
    """
    if len(a) != len(b):
        return None
    names, taken = dict(names), set(names.values())
    scopes: list[list[tuple[str, str]]] = [[]]
    binding = False
    for p, q in zip(a, b, strict=True):
        if binding and p not in ENDS:
            scopes[-1].append((p, q))
            continue
        bound = next(((x, y) for scope in reversed(scopes) for x, y in reversed(scope) if p == x or q == y), None)
        if bound:
            if bound != (p, q):
                return None
        elif p in of_a:
            if p not in names and q in of_b and q not in taken:
                names[p] = q
                taken.add(q)
            if names.get(p) != q:
                return None
        elif p != q or q in of_b:
            return None
        binding = p in BINDERS
        if p in ("(", "[", "{"):
            scopes.append([])
        elif p in (")", "]", "}") and len(scopes) > 1:
            scopes.pop()
    return names


def covers(hyps_a: list[str], goal_a: str, hyps_b: list[str], goal_b: str) -> bool:
    """Whether goal a is goal b, and every hypothesis of a one of b, under one renaming of variables.

    A hypothesis is "names: expression".  Where a hypothesis fits several, all of
    them are tried.
    """
    def parts(hyps: list[str]) -> tuple[list[tuple[list[str], list[str]]], frozenset[str]]:
        split = [h.partition(":") for h in hyps]
        rows = [(re.split(r"[,\s]+", n.strip()), _tokens(e)) for n, _, e in split]
        return rows, frozenset(x for n, _ in rows for x in n)

    (rows_a, of_a), (rows_b, of_b) = parts(hyps_a), parts(hyps_b)
    start = unified(_tokens(goal_a), _tokens(goal_b), {}, of_a, of_b)
    kind_a, kind_b = ({x: e for n, e in rows for x in n} for rows in (rows_a, rows_b))
    for x, y in list((start or {}).items()):
        start = start and unified(kind_a[x], kind_b[y], start, of_a, of_b)

    def rest(i: int, names: dict[str, str]) -> bool:
        if i == len(rows_a):
            return True
        tried: list[dict[str, str]] = []
        for _, e in rows_b:
            more = unified(rows_a[i][1], e, names, of_a, of_b)
            if more is not None and more not in tried:
                tried.append(more)
                if rest(i + 1, more):
                    return True
        return False

    return start is not None and rest(0, start)


def first_arrow(s: str) -> int:
    """Where the first -> outside round and square brackets stands, -1 without one."""
    depth = 0
    for i, c in enumerate(s):
        if not depth and s.startswith("->", i):
            return i
        depth += (c in "([") - (c in ")]")
    return -1


def introduced(statement: str) -> tuple[list[str], str]:
    """Binders and premises of a statement, as if introduced, and what is left as the goal."""
    hyps, goal = [], statement.strip().rstrip(".").strip()
    while True:
        bound = re.match(r"forall\s+(.+?)\s*,", goal, re.DOTALL)
        at = -1 if bound else first_arrow(goal)
        if not bound and at < 0:
            return hyps, goal
        hyps.append(bound[1] if bound else goal[:at].strip())
        goal = goal[bound.end() if bound else at + 2 :].strip()


# Constructors of values and the modules that they speak for, both ways.
HINTS = ((("Vint", "Int."), ("Vlong", "Int64.")),)


def module_prefixes(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Prefixes M. and N. of pairs M.x and N.x, and those that value constructors speak for."""
    found: dict[tuple[str, str], None] = {}
    for x, y in pairs:
        (m, dot, rest), (n, dot2, rest2) = x.partition("."), y.partition(".")
        if dot and dot2 and rest and rest == rest2 and m != n and re.fullmatch(r"[\w']+", m + n, re.ASCII):
            found[f"{m}.", f"{n}."] = None
    for one, other in HINTS:
        for (value, module), (value2, module2) in ((one, other), (other, one)):
            if (value, value2) in pairs or any(x.startswith(module) and y.startswith(module2) for x, y in pairs):
                found[module, module2] = None
    return list(found)


def stem_cores(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """What is left of pairs of plain names without their common end and start: 2 to 6 small letters for 1 to 6 characters."""
    found: dict[tuple[str, str], None] = {}
    for x, y in pairs:
        if re.fullmatch(r"[\w']+", x, re.ASCII) and re.fullmatch(r"[\w']+", y, re.ASCII):
            end = len(os.path.commonprefix([x[::-1], y[::-1]]))
            x, y = x[: len(x) - end], y[: len(y) - end]
            start = len(os.path.commonprefix([x, y]))
            x, y = x[start:], y[start:]
            if re.fullmatch("[a-z]{2,6}", x) and 1 <= len(y) <= 6 and x != y:
                found[x, y] = None
    return list(found)


def rename_variants(pairs: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """The renaming itself, and with module prefixes, stem cores and both, longest names first."""
    modules, stems = module_prefixes(pairs), stem_cores(pairs)
    more = {"module": modules, "stem": stems, "both": stems and modules and modules + stems}
    return {"base": pairs} | {k: sorted(pairs + v, key=lambda p: -len(p[0])) for k, v in more.items() if v}


def _kill(s: pd.Series) -> pd.Series:
    return s.map(without_comments, na_action="ignore")


def _conclude(s: pd.Series) -> pd.Series:
    return s.map(conclusion, na_action="ignore")


def _rename(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or x is None or y is None else renamed(t, renaming(x, y)) for t, x, y in zip(text, a, b, strict=True)])


def _covers(ha: pd.Series, ga: pd.Series, hb: pd.Series, gb: pd.Series) -> pd.Series:
    rows = zip(ha, ga, hb, gb, strict=True)
    return pd.Series([None if any(v is None for v in r) else covers(list(r[0]), r[1], list(r[2]), r[3]) for r in rows], dtype=object)


def _introduce(s: pd.Series) -> pd.DataFrame:
    found = [([], None) if t is None else introduced(t) for t in s]
    return pd.DataFrame({"hyps": [h for h, _ in found], "goal": [g for _, g in found]})


def _variants(a: pd.Series, b: pd.Series) -> pd.Series:
    """kind and the pairs old>new, one string for each variant."""
    return pd.Series([None if x is None or y is None else [
        f"{kind}: " + ",".join(f"{p}>{q}" for p, q in pairs) for kind, pairs in rename_variants(list(zip(x, y, strict=True))).items()] for x, y in zip(a, b, strict=True)])


def kill_comments(text: Column) -> Column:
    return F.pandas_udf(_kill, "string")(text)


def top_level_conclusion(text: Column) -> Column:
    return F.pandas_udf(_conclude, "string")(text)


def sigma_renamed(text: Column, a: Column, b: Column) -> Column:
    """text with the names of a that stand for others of b renamed."""
    return F.pandas_udf(_rename, "string")(text, a, b)


def as_hard(hyps_a: Column, goal_a: Column, hyps_b: Column, goal_b: Column) -> Column:
    """Whether a goal with its hypotheses is another up to renaming and order."""
    return F.pandas_udf(_covers, "boolean")(hyps_a, goal_a, hyps_b, goal_b)


def introductions(statement: Column) -> Column:
    """hyps and goal of a statement."""
    return F.pandas_udf(_introduce, "hyps array<string>, goal string")(statement)


def variants(old: Column, new: Column) -> Column:
    """The variants of a renaming of old names to new ones, as arrays of one length."""
    return F.pandas_udf(_variants, "array<string>")(old, new)
