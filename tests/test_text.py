import json

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X
from ragspark.operators import answers as A
from ragspark.operators import streamlog, templates


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("out")).first()["out"]


def test_strip_is_python_strip(spark):
    for s in ("  a \n", "\x1c\x1da\x85", "　b ", "​c", "", " \t ", "a b"):
        assert one(spark, X.strip(F.col("s")), s=s) == s.strip()


def test_clean_content_quirks(spark):
    def clean(content, name="f.pdf"):
        r = one(spark, X.clean_content(F.col("c"), F.col("n")), c=content, n=name)
        return r["text"], r["is_attachment"]

    assert clean("<FONT a>x</FONT>") == ("x</FONT>", False)
    assert clean("<font a>x") == ("<font a>x", False)
    assert clean("ATTACH://1") == ("[첨부파일: f.pdf]", True)
    assert clean("<FONT>ATTACH://1") == ("[첨부파일: f.pdf]", True)
    assert clean(" ATTACH://1") == ("ATTACH://1", False)
    assert clean("ATTACH://1", "") == ("ATTACH://1", False)
    assert clean(None) == ("", False)


def test_stamp(spark):
    for s, d, t in (("2024-01-01 10:00", "2024-01-01", "10:00"), ("2024-01-01", "2024-01-01", ""), ("", "", ""), ("a  b", "a", "")):
        assert one(spark, X.stamp_date(F.col("s")), s=s) == d
        assert one(spark, X.stamp_time(F.col("s")), s=s) == t


def test_code_fence(spark):
    for raw, want in (
        ("```json\n{}\n```", "{}"), ("```{}```", "```{}"), ("```x\n{}", "{}"), (" {} ", "{}"), ("```\n{} \n``` ", "{}"), ("", ""),
    ):
        assert one(spark, X.strip_code_fence(F.col("s")), s=raw) == want


def test_bullets(spark):
    for raw, want in (("a\n\n- b\n", "- a\n- b"), ("- a\nb", "- a\nb"), ("  \n", "  \n"), (" x\r\ny", "- x\n- y")):
        assert one(spark, X.validate_bullets(F.col("s")), s=raw) == want


def test_placeholders_are_replaced_in_order(spark):
    out = X.fill_placeholders(F.col("t"), [("A", F.col("a")), ("B", F.col("b"))])
    assert one(spark, out, t="{{A}}-{{B}}-{{C}}", a="x{{B}}", b=None) == "x--{{C}}"


def test_replace_block(spark):
    def put(t, marker="{{CONTENT}}"):
        return one(spark, templates.replace_block(F.col("t"), marker, F.lit("NEW")), t=t)

    assert put("<hp:p>a</hp:p><hp:p>{{CONTENT}}</hp:p><hp:p>b</hp:p>") == "<hp:p>a</hp:p>NEW<hp:p>b</hp:p>"
    assert put("<hp:p>a</hp:p>") == "<hp:p>a</hp:p>"
    assert put("{{CONTENT}}</hp:p>") == "{{CONTENT}}</hp:p>"
    assert put("<hp:p>{{CONTENT}}") == "<hp:p>{{CONTENT}}"


def test_file_filter_matches_either_way(spark):
    for source, name, want in (("a.pdf", "a", True), ("a", "a.pdf", True), ("a", "b", False), ("a", None, True), ("a", "", True)):
        assert one(spark, X.file_matches(F.col("s"), F.col("n")), s=source, n=name) is want


def test_transcript_and_empty(spark):
    pick = X.transcript_of(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, pick, a="", b="x", c="y") == "x"
    assert one(spark, pick, a=None, b="", c="y") == "y"
    assert one(spark, pick, a=None, b=None, c=None) == ""


def test_edge_line_shows_none(spark):
    line = X.edge_line(F.col("a"), F.col("r"), F.col("b"), F.col("d"), F.col("s"))
    assert one(spark, line, a="x", r="R", b="y", d=None, s="f") == "(x) -[R]-> (y): None (Source: f)"


def test_stream_lines(spark):
    def decode(s):
        r = one(spark, streamlog.decode_line(F.col("s")), s=s)
        return r and (r["done"], r["delta"], r["answer"])

    assert decode('data: {"choices":[{"delta":{"content":"hi"}}]}') == (False, "hi", None)
    assert decode("data: [DONE] ") == (True, None, None)
    assert decode('data: {"choices"') is None
    assert decode(": ping") is None
    assert decode('data: {"type":"answer","content":"z"}') == (False, None, "z")


def test_analysis_cases(spark):
    def parse(response):
        r = one(spark, A.parse_analysis(F.col("r"), F.col("o")), r=response, o="orig")
        return r["is_clear"], r["questions"], r["clarification"], r["awaiting"]

    assert parse("") == (True, ["orig"], None, None)
    assert parse("{bad") == (True, ["orig"], None, False)
    assert parse('{"rewritten_questions":["a","b"]}') == (True, ["a", "b"], None, False)
    assert parse('{"is_clear":true,"rewritten_questions":[]}') == (True, ["orig"], None, False)
    assert parse('{"is_clear":false,"clarification_message":"which?"}') == (False, ["orig"], "which?", True)
    assert parse('{"is_clear":false,"rewritten_questions":["a"]}') == (False, ["a"], S.PROMPT_CLARIFY, True)
    assert parse('```json\n{"is_clear":false}\n```')[0] is False


def test_payloads(spark):
    chat = json.loads(one(spark, A.chat_payload(F.col("q"), F.col("c"), F.lit(None).cast("array<struct<role:string,content:string>>"), "m"), q="why?", c=""))
    assert [m["role"] for m in chat["messages"]] == ["system", "user"]
    assert chat["messages"][1]["content"].count("why?") == 2
    payload = A.summary_payload(F.col("t"), "m", system=F.col("s"), extra=F.lit(""))
    summary = json.loads(one(spark, payload, t="hello", s="mine"))
    assert summary["messages"][0]["content"] == "mine\n" + S.SUMMARY_FORMAT
    assert summary["messages"][1]["content"].endswith("\n\nhello")
