"""Column functions against the values they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestor.functions import identity, json_text, text, urls


def values(spark, make, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).collect()
    plain = lambda y: y.asDict(recursive=True) if hasattr(y, "asDict") else y
    return [plain(r.y) for r in sorted(rows)]


def test_excerpts_are_composed_and_trimmed(spark):
    assert values(spark, text.normalize_excerpt, ["\n\n é \t\r\nx\r\r\n", "", None, " \n"]) == [" é\nx", "", None, ""]


def test_types(spark):
    got = values(spark, text.normalize_type, ["Int(11)", "string", " VARCHAR(20) ", "list<int>", "weird", "", "Number"])
    assert [g["type"] for g in got] == ["integer", "string", "string", "array", "string", "string", "number"]
    assert [g["description"] for g in got] == ["Int(11)", None, "VARCHAR(20)", "list<int>", "weird", "", None]


def test_media_types_and_status(spark):
    assert values(spark, text.media_type, [" Application/XML; charset=x", "json", "text/*", ""]) == ["application/xml", "application/json", "text/*", "application/json"]
    assert values(spark, text.status_key, ["Default", "200", "4xx", "201 Created", "OK", "999"]) == ["default", "200", "4XX", "201", "default", "default"]


def test_names(spark):
    assert values(spark, lambda c: text.component_base(c, F.lit(3), "schema"), [" A b/c ", "取消", "x.y-z_"]) == ["A_b_c", "schema3", "x.y-z"]
    assert values(spark, text.webhook_label, ["付款通知（綠界）", "push event. Sent when", "a: b", "plain"]) == ["付款通知", "push event", "a", "plain"]
    assert values(spark, text.required_flag, ["Yes", "必填", "N", "maybe"]) == ["true", "true", "false", "maybe"]
    assert values(spark, text.snake, ["userId", "X-Request-ID", "__a b"]) == ["user_id", "x_request_id", "a_b"]
    assert values(spark, text.path_tokens, ["/a/{id}/{x}/{id}", "/b"]) == [["id", "x"], []]
    assert values(spark, text.field_name, ["`a` (optional)", "[b](http://x)", "├ c", "**d**<br>note", "e【x】", "_user_id_", "&nbsp;&nbsp;a.b"]) == ["a", "b", "c", "d", "e", "user_id", "a.b"]


def test_declared_endpoints(spark):
    got = values(spark, text.declared_endpoint, ["## GET /a/{id}`", "| URL | https://h.x/pay | Method | POST |", "see GET /a", "URL: /b HTTP Method: PUT", "get /a", "- `POST /x/y`,", "| GET /in/a/row |", "| URL | <API URL>/Login | Method | GET |", "| URL | see annex | Method | GET |", "curl: /b Method: PUT"])
    assert [g and (g["method"], g["path"]) for g in got] == [("GET", "/a/{id}"), ("POST", "/pay"), None, ("PUT", "/b"), None, ("POST", "/x/y"), None, ("GET", "/Login"), None, None]


def test_entities(spark):
    said = ["error code 1234 and Action 7, action 7", "in 2024 the status 2020 was", "號碼 12345 錯誤", "number 4321 only"]
    assert values(spark, text.entities, said) == [["action:7", "error:1234"], [], ["error:12345"], []]


def test_json_text(spark):
    assert values(spark, json_text.canonical_json, ['{"b": 1.0, "a": "ü"}', "no", None]) == ['{"a":"ü","b":1.0}', None, None]
    assert values(spark, json_text.pointer_unescape, ["a~1b~0c", "plain", "~01"]) == ["a/b~c", "plain", "~1"]
    with pytest.raises(Exception, match="malformed pointer"):
        values(spark, json_text.pointer_unescape, ["a~2"])
    assert values(spark, json_text.pointer_escape, ["a/b~c"]) == ["a~1b~0c"]
    assert values(spark, json_text.json_block, ['so ```json\n{"a": [1, {"b": "}"}]}\n``` end {"c": 1}', 'x { y {"d": 2} z', "none", None]) == ['{"a":[1,{"b":"}"}]}', '{"d":2}', None, None]


def test_locators(spark):
    got = values(spark, json_text.legacy_locator, ["Page 3", "lines 4-9", "line 7", "#/a/b", "css:.x > y", "Section: A > B ", "somewhere", "xpath://a"])
    assert [g["kind"] for g in got] == ["page", "lines", "lines", "pointer", "css", "section", "unresolved", "xpath"]
    assert (got[0]["page"], got[1]["start_line"], got[1]["end_line"], got[2]["end_line"], got[3]["pointer"], got[4]["selector"], got[5]["heading_path"], got[7]["selector"]) == (3, 4, 9, 7, "/a/b", ".x > y", ["A", "B"], "//a")


def test_urls(spark):
    assert values(spark, urls.fetch_target, ["https://hackmd.io/@me/note?x", "https://hackmd.io/abc", "https://else.io/abc"]) == ["https://hackmd.io/@me/note/download", "https://hackmd.io/abc/download", "https://else.io/abc"]
    assert values(spark, urls.is_spec, ['{"openapi": "3.1.0"}', '{"swagger": "2.0"}', '{"openapi": 3}', "[1]", "no", None, '{"a": {"openapi": "3"}}']) == [True, True, False, False, False, False, False]
    pairs = spark.createDataFrame([("https://h.x/a/b", "../c/#f"), ("https://h.x/a", "https://other/x"), ("https://h.x/a", "mailto:x"), (None, "x")], "b string, h string")
    assert [r[0] for r in pairs.select(urls.same_origin_url("b", "h")).collect()] == ["https://h.x/c", None, None, None]


def test_identities(spark):
    assert values(spark, lambda c: identity.operation_identity(F.lit(" post "), c, strict=False), ["/a", "a"]) == ["operation:POST:/a", None]
    for bad in (lambda c: identity.operation_identity(F.lit("FETCH"), c), lambda c: identity.claim_identity(F.lit("a:b"), c, F.lit("x")), lambda c: identity.schema_identity(F.lit(" "))):
        with pytest.raises(Exception, match="needs|must"):
            values(spark, bad, ["/a"])
    assert values(spark, lambda c: identity.endpoint_identity(F.lit("post"), F.lit(None).cast("string"), c), [" a \n b ", ""]) == ["WEBHOOK POST a b", None]
