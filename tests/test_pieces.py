"""Composition of rule traces against a walk over single characters, and what runs keep."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.functions import packs, pieces
from inkveil.functions.lexicon import Lexicon
from inkveil.functions.rules import Rule
from inkveil.plans import config

STEPS = [
    Rule("words", "W", "ab+", "<$0>"), Rule("digits", "D", "[0-9]{2,}", "#"), Rule("pair", "P", "(c)(d?)", "$2x$1"), Rule("gone", "G", "e", ""), Rule("wide", "S", "[<x].", "Y"),
    Rule("plain", "L", "a.c", "long replacement", literal=True), Rule("again", "A", "#|YY", "##"), Rule("back", "B", "long", "a.c", literal=True),
]


def by_characters(text, steps):
    """Each character of the result is one of the source or belongs to a stretch (start, end); steps join what they touch."""
    chars = [(c, (k, k + 1), None) for k, c in enumerate(text)]  # character, source, number of its stretch
    stretches = {}

    def replaced(a, b, new, number):
        lo, hi = a, b
        for k in range(a, b):
            n = chars[k][2]
            while n is not None and lo > 0 and chars[lo - 1][2] == n:
                lo -= 1
            while n is not None and hi < len(chars) and chars[hi][2] == n:
                hi += 1
        inner = chars[lo:hi]
        start = min(stretches[n][0] if n is not None else s[0] for _, s, n in inner)
        end = max(stretches[n][1] if n is not None else s[1] for _, s, n in inner)
        for m in [m for m, (x, y, t) in stretches.items() if not t and start < x and y < end]:  # what was deleted inside
            del stretches[m]
        out = "".join(c for c, _, _ in chars[lo:a]) + new + "".join(c for c, _, _ in chars[b:hi])
        stretches[number] = (start, end, out)
        return lo, hi, [(c, None, number) for c in out]

    number = 0
    for step in steps:
        now = "".join(c for c, _, _ in chars)
        pattern = re.escape(step.pattern) if step.literal else step.pattern
        template = step.replacement.replace("\\", "\\\\") if step.literal else re.sub(r"\$(\d)", r"\\g<\1>", step.replacement)
        for m in reversed(list(re.finditer(pattern, now))):
            number += 1
            lo, hi, new = replaced(m.start(), m.end(), m.expand(template), number)
            chars[lo:hi] = new
    alive = {n for _, _, n in chars if n is not None} | {n for n, (_, _, t) in stretches.items() if not t}
    return "".join(c for c, _, _ in chars), sorted(stretches[n] for n in alive)


def trimmed(old, stretches):
    out = []
    for s, e, t in stretches:
        while s < e and t and old[s] == t[0]:
            s, t = s + 1, t[1:]
        while s < e and t and old[e - 1] == t[-1]:
            e, t = e - 1, t[:-1]
        if s < e or t:
            out.append((s, e, t))
    return out


def placed(old, cuts):
    for s, e, t in reversed(cuts):
        old = old[:s] + t + old[e:]
    return old


def test_traces_against_characters(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice("abcde12 .<x") for _ in range(draw.randint(0, 40))) for _ in range(400)] + ["", "a.c", "plain", "ab12cde"]
    rows = pieces.traced(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), STEPS)
    got = {r.k: r for r in rows.withColumn("cuts", pieces.cuts("text", "new", "traces")).collect()}
    for k, text in enumerate(texts):
        new, stretches = by_characters(text, STEPS)
        found = [tuple(c) for c in got[k].cuts]
        assert got[k].new == new and placed(text, found) == new
        assert found == trimmed(text, stretches) or [(s, e) for s, e, _ in found] == [(s, e) for s, e, _ in trimmed(text, stretches)]


@pytest.mark.parametrize("pack", ["g1", "g2", "g3"])
def test_packs_agree_with_their_expression(spark, pack):
    texts = [
        "联系人：汪晶晶，手机 13812345678 ，邮箱 a@b.cc", "福州分行网点 福州分行支行 自贸区分行 福州分行营业部 中国工商银行", "密码：123456 pwd: abcdef9 应为2024年3月5日", "责任人：王伟；审核人 李静 编制人：张宇轩经理",
        "2024年3月5日10:00-11:00 会议", "清单如下 汪晶晶", "新核心项目建设领导小组 有限公司 王小明", "", None, "plain text only", "地址 福建省福州市鼓楼区东街口路12号 0591-87654321",
    ]
    rows = pieces.traced(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), packs.steps(pack))
    rows = rows.withColumn("want", packs.redact(F.col("text"), pack)).filter("text is not null").withColumn("cuts", pieces.cuts("text", "new", "traces"))
    for r in rows.collect():
        assert r.new == r.want and placed(r.text, [tuple(c) for c in r.cuts]) == r.want


@pytest.mark.parametrize("runs, cuts, want", [
    (["a@b.cc ", "KEEP BOLD ", "c@d.ee end"], [(0, 6, "M"), (17, 23, "N")], [(0, "M "), (2, "N end")]),
    (["ab", "", "cd", "ef"], [(1, 5, "X")], [(0, "aX"), (2, ""), (3, "f")]),
    (["ab", "cd"], [(2, 2, "+")], [(1, "+cd")]), (["ab", "cd"], [(4, 4, "+")], [(1, "cd+")]), (["ab"], [(0, 1, "x"), (1, 2, "y")], [(0, "xy")]), ([""], [(0, 0, "x")], []), (["ab"], [(0, 2, "ab")], []),
])
def test_runs(runs, cuts, want):
    assert pieces.in_runs(runs, cuts) == want


@pytest.mark.parametrize("old, new", [("福州分行网点", "XX网点"), ("福州分行支行", "XX支行"), ("自贸区分行", "自贸区分行"), ("福州分行营业部", "XX分行营业部"), ("福州三山支行", "XX支行"), ("长乐支行", "XX支行"), ("福州自贸区分行营业部", "XX分行营业部")])
def test_branches(spark, old, new):
    rule = packs.branch_rule(Lexicon().bank_names)
    assert spark.createDataFrame([(old,)], "t string").select(rule.apply(F.col("t"))).first()[0] == new


def test_configuration_keys(spark):
    read = config.lexicon({"replacement": {"NAME": "[N]", "BANK": "[B]"}, "bank_branch_suffixes": ["网点"]})
    text = spark.createDataFrame([("经办人：汪晶晶 ，中国工商银行 ，网点 ，分行 ",)], "t string")
    assert text.select(packs.redact(F.col("t"), "g2", read)).first()[0] == "经办人：[N] ，[B] ，XX网点 ，分行 "
    assert config.lexicon({"bank_branch_suffixes": [], "replacement": None}).bare_branches == ("分行", "支行", "营业部")


def test_traces_leave_arrow_as_columns():
    kind = pa.list_(pa.struct([(k, pa.list_(pa.int32())) for k in ("gaps", "sizes", "news")]))
    one, two = {"gaps": [1, 2], "sizes": [3], "news": [4]}, {"gaps": [5, 6, 7], "sizes": [8, 8], "news": [0, 1]}
    traces = pa.array([[], [one, {"gaps": [9], "sizes": [], "news": []}], [two], [], [two, one]], kind)
    for begin, stop in ((0, 5), (1, 3), (2, 4), (4, 5), (3, 3)):
        assert list(pieces._steps(traces[begin:stop])) == traces[begin:stop].to_pylist()
