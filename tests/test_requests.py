"""Model requests in rounds against a plain loop, the grid join against all pairs, spans in SQL, manifests beside documents."""

import io
import json
import random
import zipfile

import pytest

from inkveil.functions import sql
from inkveil.functions.packs import g3_text
from inkveil.operators import boxes, requests
from inkveil.plans import batch
from inkveil.sources import store


def plain_packs(text, limit):
    done, now = [], ""
    for p in (p.strip(" ") for p in text.split("\n")):
        if p and now and len(now) + 1 + len(p) <= limit:
            now += "\n" + p
        elif p:
            done += [now] if now else []
            now = p
    return done + ([now] if now else [])


def test_packing(spark):
    draw = random.Random(2)
    texts = ["\n".join("x" * draw.choice([0, 1, 5, 30, 80]) + draw.choice(["", "é ", " "]) for _ in range(draw.randint(0, 30))) for _ in range(40)] + ["", None, "\n\n"]
    got = requests.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), limit=60).orderBy("doc_id", "place").collect()
    want = [(k, n, q) for k, t in enumerate(texts) for n, q in enumerate(plain_packs(t or "", 60), 1)]
    assert [(r.doc_id, r.place, r.text) for r in got] == want


def schedule(folder):
    """A client that fails as its log of calls says: questions with `late` are refused once, with `twice` fail twice, with `never` always."""

    def client(text):
        calls = len(list(store.listed(folder))) and [p for p, _ in store.listed(folder) if p.rpartition("/")[2].startswith(text[:6])]
        store.write(f"{folder}/{text[:6]}-{random.random()}", b"call")
        n = len(calls or []) + 1
        if "late" in text and n == 1 or "twice" in text and n == 2:
            raise requests.RateLimited("slow down")
        if "never" in text or "twice" in text and n == 1:
            raise OSError("no line")
        return json.dumps({"entities": [{"text": text[:6], "confidence": 0.9}, {"text": ""}]})

    return client


def test_rounds(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    docs = spark.createDataFrame([(1, "aaaaaa"), (2, "bbbbbb late"), (3, "cccccc twice"), (4, "dddddd never"), (5, "aaaaaa"), (6, None)], "doc_id long, text string")
    questions, folder, log = requests.packed(docs), str(tmp_path / "calls"), str(tmp_path / "log")
    ask = lambda: requests.answered(questions, schedule(folder), log=log, now=lambda: 0.0, sleep=lambda s: None)
    got = {r.text: (r.attempts, r.answer is not None, r.error, r.due) for r in ask().collect()}
    assert got == {"aaaaaa": (1, True, None, 0.0), "bbbbbb late": (2, True, None, 0.0), "cccccc twice": (3, True, None, 0.0), "dddddd never": (3, False, "OSError: no line", 0.0)}
    calls = len(list((tmp_path / "calls").iterdir()))
    assert calls == 1 + 2 + 3 + 3
    again = ask()
    assert {r.text: (r.attempts, r.answer is not None, r.error, r.due) for r in again.collect()} == got and len(list((tmp_path / "calls").iterdir())) == calls
    found = sorted((r.doc_id, r.text, r.replacement, r.confidence) for r in requests.entities(questions, again).collect())
    assert found == [(1, "aaaaaa", "XXX", 0.9), (2, "bbbbbb", "XXX", 0.9), (3, "cccccc", "XXX", 0.9), (5, "aaaaaa", "XXX", 0.9)]


def test_pauses_grow(tmp_path):
    import pandas as pd

    slept = []

    def refuse(_):
        raise requests.RateLimited("x")

    frame = pd.DataFrame([("r", "t", 1, 12.0)], columns=["request", "text", "attempts", "due"])
    (out,) = requests._asked(iter([frame]), refuse, str(tmp_path), lambda: 10.0, slept.append)
    assert slept == [2.0] and out.due.tolist() == [20.0] and out.attempts.tolist() == [2]


def test_no_request(spark):
    assert requests.answered(requests.packed(spark.createDataFrame([], "doc_id long, text string")), lambda t: t).count() == 0


@pytest.mark.parametrize("cell", [1, 7, 64, 10_000])
def test_overlaps_against_all_pairs(spark, cell):
    draw = random.Random(cell)
    rows = [[(draw.choice("ab"), k, x := draw.randint(-20, 100), y := draw.randint(0, 100), x + draw.randint(0, 40), y + draw.randint(0, 40)) for k in range(80)] for _ in range(2)]
    left, right = (spark.createDataFrame(r, "pic string, k int, x1 int, y1 int, x2 int, y2 int") for r in rows)
    got = boxes.overlaps(left, right, ["pic"], cell)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = sorted((a[1], b[1]) for a in rows[0] for b in rows[1] if a[0] == b[0] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5]))
    assert sorted((r.left.k, r.right.k) for r in got.collect()) == want and len(want) > 20


def test_spans_in_sql(spark):
    sql.register_spans(spark, g3_text(), "found_in")
    spark.createDataFrame([(1, "a@b.cc é 13812345678"), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("notes")
    got = spark.sql("select id, s.rule_id, s.start, s.end, s.found from notes, lateral found_in(text) s order by id, start").collect()
    assert [tuple(r) for r in got] == [(1, "email", 0, 6, "a@b.cc"), (1, "mobile", 9, 20, "13812345678")]


@pytest.mark.parametrize("form", ["markdown", "json"])
def test_manifests_beside_documents(spark, tmp_path, form):
    (tmp_path / "in").mkdir()
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        archive.writestr("word/document.xml", "<d xmlns:w='w'><w:p><w:t>mail someone@bank.com </w:t></w:p></d>")
    (tmp_path / "in" / "a.docx").write_bytes(made.getvalue())
    batch.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), manifest=form, workers=1)
    ending = {"markdown": "md", "json": "json"}[form]
    text = (tmp_path / "out" / f"a_脱敏.docx_manifest.{ending}").read_text()
    assert "some****" in text and "someone" not in text and "RULE" in text
    assert form == "markdown" or json.loads(text)["stats"] == {"RULE": 1}


def test_overlaps_of_equal_corners_in_many_tasks(spark):
    draw = random.Random(5)
    rows = [[(1, k, x := draw.randint(0, 9), y := draw.randint(0, 9), x + draw.randint(0, 3), y + draw.randint(0, 3)) for k in range(150)] for _ in range(2)]
    left, right = (spark.createDataFrame(r, "pic int, k int, x1 int, y1 int, x2 int, y2 int") for r in rows)
    got = boxes.overlaps(left, right, ["pic"], 8)
    want = sorted((a[1], b[1]) for a in rows[0] for b in rows[1] if max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5]))
    assert sorted((r.left.k, r.right.k) for r in got.collect()) == want and got.columns == ["pic", "left", "right"] and got.schema["left"].dataType.names == ["k", "x1", "y1", "x2", "y2"]
    assert got.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism  # few rows, many pairs: not one task


def test_overlaps_shuffle_each_box_once(spark, monkeypatch):
    draw = random.Random(7)
    rows = [[(draw.choice("ab"), k, x := draw.randint(-20, 100), y := draw.randint(0, 100), x + draw.randint(0, 40), y + draw.randint(0, 40)) for k in range(120)] + [("a", 1000 + k, 5, 5, 9, 9) for k in range(60)] for _ in range(2)]
    left, right = (spark.createDataFrame(r, "pic string, k int, x1 int, y1 int, x2 int, y2 int") for r in rows)
    monkeypatch.setattr(boxes, "INDEX_ROWS", 25)  # the equal boxes do not fit one index
    monkeypatch.setattr(boxes, "BLOCK", 2)
    got = boxes.overlaps(left, right, ["pic"], 16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("REPARTITION_BY_NUM") == 2  # before: two in each of four cases, of boxes that were dealt to fine cells
    want = sorted((a[1], b[1]) for a in rows[0] for b in rows[1] if a[0] == b[0] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5]))
    assert sorted((r.left.k, r.right.k) for r in got.collect()) == want and len(want) > 3600
    assert boxes.overlaps(left, right.filter("k < 0"), ["pic"]).count() == boxes.overlaps(left.filter("k < 0"), right, ["pic"]).count() == 0
