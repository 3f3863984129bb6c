"""Documented examples, dialect cases and properties of the rule packs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkveil.functions import packs, spans
from inkveil.functions.lexicon import Lexicon
from inkveil.functions.packs import g1, g2, g3_text
from inkveil.sources import files

GOLDEN = [
    ("zhangsan@bank.com", "XXXXX@XXXXX"), ("192.168.1.1", "X.X.X.X"), ("AA:BB:CC:DD:EE:FF", "XX:XX:XX:XX:XX:XX"), ("310101199001011234", "X" * 18), ("13812345678", "X" * 11),
    ("138****5678", "138****5678"), ("6222021234567890", "6222021234567890"), ("010-12345678", "010-12345678"), ("2022年3月31日", "YYYY年MM月DD日"),
    ("应为2022年3月31日前", "应为XXXX年XX月XX日前"), ("报告应为2022年3月31日前", "报告应为YYYY年MM月DD日前"), ("2022-03-31", "YYYY/MM/DD"), ("2022-03-31 会议", "2022-03-31 会议"),
    ("2022年3月", "YYYY/MM/DD月"), ("2022年4月8日至2022年4月10日", "YYYY年MM月DD日至YYYY年MM月DD日"), ("2024/03/15 至 2024/03/20", "YYYY/MM/DD 至 YYYY/MM/DD"),
    ("福建海峡银行", "XX银行"), ("福州三山支行", "XX支行"), ("密码123456", "******"), ("总行支持人员：汪晶晶", "总行支持人员：XXX"), ("张三", "张三"), ("晋江支行", "晋江XXX"),
    ("福州分行营业部", "XX分行营业部"), ("PWD: abc123 x", "****** x"), ("电话13812345678", "电话13812345678"), ("１９２.168.1.1 ", "X.X.X.X "), ("2022-03-31\n", "YYYY/MM/DD\n"), ("2022-03-31\r\n", "2022-03-31\r\n"),
    ("", ""), (None, None),
]


def run(spark, column, rows):
    return [r.out for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", column(F.col("t")).alias("out")).orderBy("k").collect()]


def test_g2_goldens(spark):
    assert run(spark, g2().apply, [t for t, _ in GOLDEN]) == [w for _, w in GOLDEN]


def test_strict_digits(spark):
    assert run(spark, g2(strict_digits=True).apply, ["电话13812345678"]) == ["电话" + "X" * 11]


def test_g1(spark):
    texts = ["总体组 建设领导小组 测试组", "6222021234567890", "010-12345678", "中国建设银行", "张三", "有限公司", "王五：", "2022-03-31 x"]
    assert run(spark, g1().apply, texts) == ["总体组 建设领导小组 XXXX", "X" * 16, "0XX-XXXXXXXX", "中国XX银行", "XXX", "有限公司", "王五：", "YYYY/MM/DDx"]


def test_g3_text_and_names(spark):
    text = lambda c: packs.redact(c, "g3")
    got = run(spark, text, ["2017年4月11日15:30-16:30", "2017年4月11日 15:30-16:30", "2017.4.11", "方案介绍", "方案", "工作方案", "姓名：王伟", "王伟经理", "王志强说", "中国银行"])
    assert got == ["YYYY/MM/DD 15:30-16:30", "YYYY/MM/DD 15:30-16:30", "YYYY/MM/DD", "方案介绍", "XXXX", "工作方案", "姓名：XXX", "王伟经理", "XXX说", "XX银行"]


def test_filename(spark):
    assert run(spark, packs.filename_g3, ["中国银行_2024-01-02_13812345678.docx"]) == ["XX银行_XXXX/XX/XX_XXXXXXXXXXX.docx"]


def test_custom_rules_accumulate(spark):
    pack = g2().with_literal("甲方", "A").with_literal("乙方", "B")
    assert run(spark, pack.apply, ["甲方和乙方"]) == ["A和B"] and len(pack.rules) == len(g2().rules) + 2


def test_lexicon_is_configuration(spark):
    own = Lexicon(bank_names=("某某银行", "东城支行"))
    assert run(spark, g2(own).apply, ["某某银行 东城支行 福建海峡银行"]) == ["XX银行 XX支行 福建海峡银行"]
    assert run(spark, g2(Lexicon(org_suffixes=("研究院",))).apply, ["研究院 事业部"]) == ["XXXX XXXX"]
    assert "bank" not in {r.rule_id for r in g2(Lexicon(bank_names=())).rules}


def test_nothing_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    pack = g2().only("email", "ipv4", "mac", "id18", "mobile")
    once = docs.select(pack.apply(F.col("text")).alias("a"))
    assert once.filter(pack.any_match(F.col("a"))).count() == 0
    assert once.filter(pack.apply(F.col("a")) != F.col("a")).count() == 0


@pytest.mark.parametrize("text,want", [("a@b.cc 2017年4月11日 x", "XXXXX@XXXXX YYYY/MM/DD x"), ("", ""), (None, None), ("plain", "plain"), ("方案", "XXXX")])
def test_one_pass(spark, text, want):
    assert run(spark, lambda c: spans.redact_once(c, g3_text()), [text]) == [want]


def test_positions_map_through_replacements(spark):
    cut = F.expr("array(struct(2 as start, 5 as end, 'xy' as replacement), struct(7 as start, 8 as end, '' as replacement))")
    got = spark.range(10).select(spans.mapped(F.col("id").cast("int"), cut).alias("p")).collect()
    assert [r.p for r in got] == [0, 1, 2, 3, 4, 4, 5, 6, 6, 7]


def test_time_grows_with_the_text(spark):
    """Runs of mail characters without @ and Chinese text without a street, on which every place was tried in many ways."""
    rows = spark.createDataFrame([("x1" * 400_000,), ("中文字，" * 100_000,)], "text string")
    began = time.monotonic()
    got = rows.select(F.col("text"), packs.g1().only("email", "address").apply(F.col("text")).alias("new")).collect()
    assert all(r["text"] == r["new"] for r in got) and time.monotonic() - began < 20


def test_quick_forms_find_what_plain_forms_find(spark):
    plain = {
        ("g2", "email"): r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
        ("g1", "address"): r"[^\x00-\xFF]{2,6}(?:省|自治区|市)?[^\x00-\xFF]{0,10}(?:市|区)?[^\x00-\xFF]{0,10}(?:街|路|道|巷|弄|号|大道|大街|东路|西路|南路|北路)[^\x00-\xFF]{0,30}",
        ("g2", "mobile"): r"(?Ud)\b1[3-9]\d{9}\b",
        ("g2", "month_cn"): r"(?Ud)[〇二三四五六七八九0-9]{4}年(?:(?:0?[1-9]|1[0-2])|(?:[一二三四五六七八九十正]|十一|十二)(?=月))(?![\s\d一-鿿日])",
    }
    draw = random.Random(5)
    words = ["a@b.com", "_", "1", "@", "x.y", "-", "中", "文字", "路", "号", "大道", "自治区", "，", " ", "\n", "13812345678", "2024", "〇二", "年", "3", "十一", "月", "日"]
    rows = spark.createDataFrame([("".join(draw.choices(words, k=draw.randint(1, 60))),) for _ in range(3000)], "text string").repartition(8)
    rules = {(p.name, r.rule_id): r for p in (packs.g1(), packs.g2()) for r in p.rules}
    same = [rules[k].apply(F.col("text")) == F.regexp_replace("text", F.lit(x), F.lit(rules[k].replacement)) for k, x in plain.items()]
    assert rows.filter(~F.forall(F.array(*same), lambda x: x)).count() == 0


def test_no_task_grows_with_the_table(spark, tmp_path):
    spark.range(9 * 100_000 + 1).coalesce(1).write.parquet(str(tmp_path / "t"))
    parts = files.spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id()).count().collect()
    assert sum(p["count"] for p in parts) == 900_001 and max(p["count"] for p in parts) < 110_000
