import pytest
from pyspark.sql import functions as F

from tidemark.operators import tables as T
from tidemark.schema import HEADERS

NOW = "| Company | OA / Interview Question | Format | Practice | Updated |"
DIV = "|---|---|---|---|---|"


def parse(spark, text, hint=None, source="a.md"):
    docs = spark.createDataFrame([(source, text)], "source string, text string")
    meta = spark.createDataFrame([(source, 0, hint)], "source string, source_ord int, format_hint string")
    found, rows = T.find_tables(docs)
    chosen = T.question_tables(found, T.registry(spark))
    raw = T.raw_rows(rows, chosen, meta)
    return [r.asDict() for r in raw.orderBy("line_no").collect()], T.issues(raw, chosen, meta).collect(), found.collect(), T.unread_sources(docs, found, T.registry(spark)).collect()


def test_split_row(spark):
    lines = ["| a | b |", r"| a \| b | c |", "a|b", "|  |", r"| x \|"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = [r[0] for r in rows.orderBy("i").select(T.split_row(F.col("line"))).collect()]
    assert got == [["a", "b"], ["a | b", "c"], ["a", "b"], [""], ["x |"]]


def test_current_schema(spark):
    text = f"# t\n\n{NOW}\n{DIV}\n| **Acme / Bolt** | [Two  Sum](https://h/problems/two-sum) | SQL | [![P][p]](https://h) | \U0001f525 Sep 1, 2024 |\n| Acme | no link here |  | x | |\n\nend"
    rows, issues, _, unread = parse(spark, text)
    assert unread == [] and issues == []
    assert [(r["line_no"], r["company_cell"], r["title"], r["url"], r["format"], r["updated"]) for r in rows] == [
        (5, "Acme / Bolt", "Two Sum", "https://h/problems/two-sum", "SQL", "2024-09-01"),
        (6, "Acme", "no link here", None, None, None),
    ]


def test_hint_and_route(spark):
    head = "| Company | OA / Interview Question | Practice | Updated |\n|---|---|---|---|\n| A | [T](https://h/system-design/x) | | |"
    assert parse(spark, head)[0][0]["format"] == "System design"
    assert parse(spark, head, "SQL")[0][0]["format"] == "SQL"
    odd = parse(spark, head, "Chess")
    assert odd[0][0]["format"] == "Chess" and [i["message"] for i in odd[1]] == ["unknown format hint 'Chess' (kept verbatim)"]


def test_largest_known_table_wins(spark):
    small = f"{NOW}\n{DIV}\n| a | [b](https://h/p/b) | SQL | | |"
    big = f"{NOW}\n{DIV}\n" + "\n".join(f"| a | [c{i}](https://h/p/c{i}) | SQL | | |" for i in range(3))
    unknown = "| X |\n|---|\n" + "| y |\n" * 9
    rows, _, found, _ = parse(spark, f"{small}\n\n{unknown}\n{big}")
    assert len(found) == 3 and [r["title"] for r in rows] == ["c0", "c1", "c2"]
    assert [r["title"] for r in parse(spark, f"{small}\n\n{small.replace('b', 'z')}")[0]] == ["b"]


def test_rejected_rows(spark):
    rows, issues, _, _ = parse(spark, f"{NOW}\n{DIV}\n| a | [b](https://h/p/b) | SQL | | |\n| a | [c](htt")
    assert [r["problem"] for r in rows] == [None, "expected 5 cells, got 2"]
    assert [i["message"] for i in issues] == ["a.md:4 expected 5 cells, got 2"]
    legacy = next(iter(HEADERS))
    assert parse(spark, f"{legacy}\n|---|---|\n| a | b |")[0][0]["problem"].startswith("two-column legacy")
    assert parse(spark, f"{NOW}\n{DIV}\n| a | [![P][p]](https://h) | SQL | | |")[0][0]["problem"] == "no question title"


@pytest.mark.parametrize("text", ["no table", "| Odd | Head |\n|---|---|\n| a | b |", "| Company |\nnot a divider"])
def test_unknown_header(spark, text):
    assert [r["source"] for r in parse(spark, text)[3]] == ["a.md"]


def test_every_registered_header(spark):
    for header, roles in HEADERS.items():
        n = header.count("|") - 1
        assert n == len(roles)
        cells = {"company": "Acme", "question": "[T](https://h/problems/t)", "company_and_question": "x", "format": "SQL", "practice": "", "updated": "Jan 1, 2024"}
        row = parse(spark, f"{header}\n|{'---|' * n}\n| {' | '.join(cells[r] for r in roles)} |")[0][0]
        assert (row["problem"] is None) == ("question" in roles)
