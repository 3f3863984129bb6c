"""Rule packs as SQL functions: expressions that Spark inlines, not Python functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkveil.functions.rules import Rule, RulePack


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\0", "\\0") + "'"


def _applied(rule: Rule, text: str) -> str:
    name, pattern = ("replace", rule.pattern) if rule.literal else ("regexp_replace", rule.compiled)
    return f"{name}({text}, {literal(pattern)}, {literal(rule.replacement)})"


def expression(pack: RulePack, text: str = "text") -> str:
    """SQL of what RulePack.apply() does."""
    for phrase, token in pack.protected:
        text = f"replace({text}, {literal(phrase)}, {literal(token)})"
    for rule in pack.rules:
        text = _applied(rule, text)
    for phrase, token in reversed(pack.protected):
        text = f"replace({text}, {literal(token)}, {literal(phrase)})"
    for rule in pack.repairs:
        text = _applied(rule, text)
    return text


def register(spark: SparkSession, pack: RulePack, name: str) -> None:
    """Makes name(text), and the table function name_counts(text) with rule_id, category and n, known to the session's SQL."""
    spark.sql(f"create or replace temporary function {name}(text string) returns string return {expression(pack)}")
    rows = [f"struct({literal(r.rule_id)} as rule_id, {literal(r.category)} as category, cast(regexp_count(text, {literal(r.compiled)}) as bigint) as n)" for r in pack.rules if not r.literal]
    spark.sql(f"create or replace temporary function {name}_counts(text string) returns table(rule_id string, category string, n bigint) return select c.* from (select explode(array({', '.join(rows)})) as c) where c.n > 0")


def _spans(rule: Rule) -> str:
    """SQL of an array of struct(rule_id, category, start, end, found) of a rule's matches in `text`: offsets are sums over the texts between the matches and the matches."""
    pattern = literal(rule.compiled)
    upto = lambda xs, n: f"aggregate(slice(v.{xs}, 1, {n}), 0, (a, x) -> a + length(x))"
    start = f"{upto('p', 'i + 1')} + {upto('h', 'i')}"
    made = f"struct({literal(rule.rule_id)} as rule_id, {literal(rule.category)} as category, {start} as start, {start} + length(m) as end, m as found)"
    return f"transform(array(struct(split(text, {pattern}, -1) as p, regexp_extract_all(text, {pattern}, 0) as h)), v -> transform(v.h, (m, i) -> {made}))[0]"


def register_spans(spark: SparkSession, pack: RulePack, name: str) -> None:
    """Makes the table function name(text) with rule_id, category, start, end (code points, end exclusive) and found known to the session's SQL, for LATERAL joins: all matches of every
    rule in the unchanged text."""
    rules = [_spans(r) for r in pack.rules if not r.literal]
    columns = "rule_id string, category string, start int, end int, found string"
    spark.sql(f"create or replace temporary function {name}(text string) returns table({columns}) return select s.* from (select explode(concat({', '.join(rules)})) as s)")
