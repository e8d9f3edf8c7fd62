"""String columns: tokens, names, normal forms, similarity and layout.

All are built-in expressions; what is not regular (nested comments, arrows at depth
0, renaming) is in functions/arrow.py.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDS = r"(?U)[^\[\]\{\}\(\):=,\s]+"
# Forms of a statement that give its name, first match wins.
NAME_FORMS = (
    r"^\s*(?:Lemma|Theorem|Definition|Fixpoint|Remark|Corollary|Fact|Proposition)\s+([^\s:({\[]+)",
    r"^\s*(?:Inductive|CoInductive|Record|Class|Structure|Variant)\s+([^\s:({\[]+)",
    r"^\s*(?:Instance|Notation|Ltac|Axiom|Parameter|Variable|Hypothesis)\s+\"?([^\s:({\[\"]+)",
)
# Ordered classes of error messages.
ERRORS = (("unify", r"(?i)unable to unify|cannot unify"), ("not_found", r"(?i)not found|no such"), ("syntax", r"(?i)syntax"), ("empty", r"^\s*$"))


def ids(text: Column) -> Column:
    """Runs of characters that are neither brackets, separators nor white space."""
    return F.regexp_extract_all(text, F.lit(IDS), F.lit(0))


def goal_ids(hyps: Column, goal: Column) -> Column:
    """Ids of the hypotheses' bodies and of the goal, without the hypotheses' names; repeats stay."""
    names = F.flatten(F.transform(hyps, lambda h: F.split(F.split(h, ":")[0], ", ")))
    body = F.flatten(F.transform(hyps, lambda h: ids(F.array_join(F.slice(F.split(h, ":"), F.lit(2), F.greatest(F.size(F.split(h, ":")) - 1, F.lit(0))), ""))))
    return F.struct(
        F.filter(body, lambda x: ~F.array_contains(names, x)).alias("hyp_ids"), F.filter(ids(goal), lambda x: ~F.array_contains(names, x)).alias("goal_ids"))


def theorem_name(text: Column) -> Column:
    """The second word up to a bracket or white space, or 'Anon'."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\S+\s+(\S+?)[\[\]\{\}\(\):=,\s]", 1), F.lit("")), F.lit("Anon"))


def premise_name(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in NAME_FORMS])


def norm_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_flat_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\(\*.*?\*\)", "")


def proof_length(text: Column) -> Column:
    """Number of sentences, without the words that open and close a proof."""
    body = F.trim(F.regexp_replace(text, r"\b(?:Proof|Qed|Defined)\.", ""))
    return F.size(F.filter(F.split(body, r"[.;]\s+|[.;]$"), lambda x: F.trim(x) != ""))


def head(text: Column) -> Column:
    """The leading identifier, else the first character, '<empty>' for none."""
    t = F.trim(text)
    name = F.regexp_extract(t, r"^[A-Za-z_][A-Za-z0-9_']*", 0)
    return F.when(t == "", "<empty>").when(name != "", name).otherwise(F.substring(t, 1, 1))


def head_without_bullets(text: Column) -> Column:
    return head(F.regexp_replace(text, r"^[\s\-+*{}0-9:.]+", ""))


def stop_cut(text: Column, stops: list[str]) -> Column:
    """Text before the first stop string, in list order, that stands in it."""
    out = text
    for s in reversed(stops):
        out = F.when(F.instr(text, s) > 0, F.substring_index(text, s, 1)).otherwise(out)
    return out


def split_steps(text: Column) -> Column:
    """Sentences that end with a full stop before white space or the end; blanks are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=\.)(?=\s|$)"), lambda x: F.trim(x)), lambda x: x != "")


def ansi_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", "")


def tool_path(text: Column) -> Column:
    """The last two parts of a path."""
    return F.array_join(F.slice(F.split(text, "/"), -2, 2), "/")


def data_name(path: Column) -> Column:
    """The part below repos/ with slashes as hyphens; null without one."""
    return F.regexp_replace(F.nullif(F.regexp_extract(path, r"repos/(.*\.v)", 1), F.lit("")), "/", "-")


def strip_parent(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\.\.[/\\])+", "")


def format_goals(goals: Column) -> Column:
    return F.array_join(goals, "\n[GOAL]\n")


def context(prefix: Column, goals: Column) -> Column:
    return F.concat(prefix, F.array_join(F.transform(goals, lambda g, i: F.concat(F.lit("\nGoal "), (i + 1).cast("string"), F.lit(":\n"), g)), ""))


def typed_score(goal: Column, premise: Column, head_weight: float = 3.0, shared: float = 0.1, per_op: float = 1.0, same_shape: float = 0.3) -> Column:
    """Same head, shared operators, shared identifiers and whether both are equalities."""
    ops = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"<->|->|<=|>=|<>|[=+*/<>-]"), F.lit(0)))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z_][A-Za-z0-9_']*"), F.lit(0)))
    eq = lambda c: F.instr(c, "=") > 0
    return (
        F.when(head(goal) == head(premise), head_weight).otherwise(0.0) + per_op * F.size(F.array_intersect(ops(goal), ops(premise)))
        + shared * F.size(F.array_intersect(words(goal), words(premise))) + F.when(eq(goal) == eq(premise), same_shape).otherwise(0.0))


def nearest_hypothesis(goal: Column, hyps: Column, normalised: bool = False) -> Column:
    """Smallest edit distance of the goal to a hypothesis, over the longer length if normalised."""
    d = lambda h: F.levenshtein(goal, h).cast("double")
    return F.array_min(F.transform(hyps, lambda h: d(h) / F.greatest(F.length(goal), F.length(h), F.lit(1)) if normalised else d(h)))


def error_class(text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(ERRORS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


# Operators that features count, as substrings.
LOGIC, COMPARISONS = ("/\\", "\\/", "<->", "~"), ("<=", ">=", "<>", "=", "<", ">")
# Patterns of features.
TOKEN, BRANCHING = r"[A-Za-z_][A-Za-z0-9_']*|[^\sA-Za-z0-9]", r"\bmatch\b|\bfix\b|\blet\b"
COLLECTIONS = r"\b(?:Map|Maps|PTree|PMap|ZMap|Set|list|option|nat|Z|positive)\b"


def features(statement: Column, hyps: Column, goal: Column) -> dict[str, Column]:
    """28 counts of a statement and of the goal and hypotheses that introducing its premises leaves."""
    def found(c: Column, pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    def holds(c: Column, parts: tuple[str, ...]) -> Column:
        return sum((found(c, "\\Q" + p + "\\E") for p in parts[1:]), found(c, "\\Q" + parts[0] + "\\E"))

    def total(f, start=0) -> Column:
        return F.aggregate(hyps, F.lit(start), lambda s, h: s + f(h))

    def most(f) -> Column:
        return F.coalesce(F.array_max(F.transform(hyps, f)), F.lit(0))

    out = {
        "num_goals": F.lit(1), "goal_len": F.length(goal), "goal_tok_count": found(goal, TOKEN), "forall_left": found(goal, "forall"),
        "goal_arrow": found(goal, "->"), "goal_logic_ops": holds(goal, LOGIC), "cmp_ops": holds(goal, COMPARISONS),
        "is_contra_goal": F.trim(goal).isin("False", "False.").cast("int"), "num_hyps": F.size(hyps), "hyp_total_len": total(F.length),
        "hyp_len_avg": F.coalesce(total(F.length) / F.nullif(F.size(hyps), F.lit(0)), F.lit(0.0)), "hyp_len_max": most(F.length),
        "hyp_tok_count_total": total(lambda h: found(h, TOKEN)), "hyp_tok_count_max": most(lambda h: found(h, TOKEN)),
        "hyp_logic_ops_total": total(lambda h: holds(h, LOGIC)), "match_fix_let": found(goal, BRANCHING), "mapset_tokens": found(goal, COLLECTIONS),
        "goal_exists": found(goal, "exists"), "hyp_forall_total": total(lambda h: found(h, "forall")),
        "stmt_len": F.length(statement), "stmt_tok_count": found(statement, TOKEN), "stmt_forall": found(statement, "forall"),
        "stmt_exists": found(statement, "exists"), "stmt_arrow": found(statement, "->"), "stmt_logic_ops": holds(statement, LOGIC),
        "stmt_cmp_ops": holds(statement, COMPARISONS), "stmt_match_fix_let": found(statement, BRANCHING),
        "stmt_is_eq_goal": statement.rlike(r"(?:^|\s)@?eq\b|=").cast("int")}
    return {k: c.cast("double").alias(k) for k, c in out.items()}


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def last_tokens(text: Column, n: int) -> Column:
    parts = F.split(text, " ")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), " ")


def pair_budget(a: Column, b: Column, n: int) -> Column:
    """First half of the budget from the start of a, the rest from the end of b."""
    return F.concat(first_tokens(a, n // 2), F.lit(" [SEP] "), last_tokens(b, n - n // 2))


def blocks(text: Column, tag: str) -> Column:
    """Bodies of <tag> blocks, each once; null if there are none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: F.trim(x)))


def parsed_list(text: Column) -> Column:
    """The first JSON array of strings, else lines without bullets that end in a full stop and have 3 to 79 characters."""
    array = F.from_json(F.regexp_extract(text, r"(?s)\[.*?\]", 0), "array<string>", {"mode": "PERMISSIVE"})
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*]|[0-9]+[.)])\s*", "")))
    return F.coalesce(F.when(F.size(array) > 0, array), F.filter(lines, lambda x: x.endswith(".") & F.length(x).between(3, 79)))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the common suffix of two arrays."""
    same = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def expand(values: Column, counts: Column, total: int) -> Column:
    """Each value repeated by its count, cut or padded with 0 to a total."""
    flat = F.flatten(F.zip_with(values, counts, lambda v, n: F.array_repeat(v, n)))
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0.0), total)), 1, total)
