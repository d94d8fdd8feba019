"""Tables of Markdown sources, case by case and against a reader row by row."""

from __future__ import annotations

from attestor.operators import facts, tables


def found(spark, body):
    df = spark.createDataFrame([("s", body)], "id string, body string")
    return tables.tables(facts.section_owner(facts.marked_lines(df, "id", "body")))


def names(spark, table, head="# A\nGET /x\n"):
    return [(r.name, r.required) for r in tables.table_parameters(found(spark, head + table)).orderBy("line").collect()]


def codes(spark, body):
    return [(r.code, r.meaning) for r in tables.error_codes(found(spark, body)).orderBy("line").collect()]


RULE = "\n|---|---|\n"


def test_parameters(spark):
    assert names(spark, f"| 請求參數 | T |{RULE}| a | s |\n| b.c (opt) | s |") == [("a", None), ("b.c", None)]
    assert names(spark, f"| request_field | Required |{RULE}| a | yes |\n| b | 否 |\n| c | maybe |") == [("a", "true"), ("b", "false"), ("c", "maybe")]
    assert names(spark, f"| Name | Value |{RULE}| Content-Type | x |") == []
    assert names(spark, f"| Name | T |{RULE}| Accept | s |\n| Header | |\n| X-Token | s |") == [("X-Token", None)]
    assert names(spark, f"| Code | T |{RULE}| a | s |") == []
    assert names(spark, f"| Name | T |{RULE}") == []
    assert names(spark, f"| 欄位 | Field name |{RULE}| 商店 | shop_id |\n| 金額 | amount |") == [("shop_id", None), ("amount", None)]
    assert names(spark, f"| 欄位 | Type |{RULE}| 商店 | string |") == [("商店", None)]
    assert names(spark, f"| Name | T |{RULE}| a | s |\n| Error code: | |\n| 0 | fine |") == [("a", None)]
    assert names(spark, f"| Name | T |{RULE}| a | s |\n| Error Code | string |\n| b | s |") == [("a", None), ("Error", None), ("b", None)]
    assert names(spark, f"| Name | T |{RULE}| a | s |", head="") == []
    assert names(spark, f"```\n| Name | T |{RULE}| a | s |\n```") == []


def test_error_codes(spark):
    assert codes(spark, f"| 錯誤碼 | M |{RULE}| 1001 | bad |\n| `E-2` | worse |") == [("1001", "bad"), ("E-2", "worse")]
    assert codes(spark, f"| 錯誤碼分類 | 錯誤碼 |{RULE}| x | 7 |") == [("7", "x")]
    assert codes(spark, f"| Code | Currency |{RULE}| USD | dollar |") == []
    assert codes(spark, f"# Errors\n## Pay\n| Code | M |{RULE}| 1 | a |\n| 支付類 | |\n| 2 | |") == [("1", "a"), ("2", "")]
    assert codes(spark, f"# Errors\n# Other\n| Code | M |{RULE}| 1 | a |") == []
    assert codes(spark, f"| Error code | M |{RULE}| 1 | a |\n| no code | b |") == []
    assert codes(spark, f"| Error code | M |{RULE}| {'x' * 33} | a |") == []
    assert codes(spark, "| Error code |\n|---|\n| 1 |") == []


def test_headings_around(spark):
    df = spark.createDataFrame([("s", "a\n# One\n### Deep\nx\n## Two\ny\n# Three\n###### Six")], "id string, body string")
    rows = tables.enclosing_headings(facts.marked_lines(df, "id", "body")).orderBy("line").collect()
    assert [r.headings for r in rows] == [[], ["One"], ["One", "Deep"], ["One", "Deep"], ["One", "Two"], ["One", "Two"], ["Three"], ["Three", "Six"]]


def test_underlined_headings_end_sections(spark):
    body = "One\n===\nGET /a\n| Name | T |\n|---|---|\n| own | s |\n\nTwo\n===\n| Name | T |\n|---|---|\n| other | s |\n\n---\nSub\n--\nx"
    df = spark.createDataFrame([("s", body)], "id string, body string")
    marked = facts.marked_lines(df, "id", "body")
    assert [(r.line, r.level, r.heading) for r in marked.where("level > 0").orderBy("line").collect()] == [(2, 1, "One"), (9, 1, "Two"), (16, 2, "Sub")]
    assert [r.parameters for r in facts.endpoint_facts(df, "id", "body").collect()] == [["own"]]
