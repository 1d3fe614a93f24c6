"""Text and record functions on hand-made cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetspark.functions import forms, records, responses, text, times

NOW = "2024-01-31 00:00:00"


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hosts(spark):
    cases = {
        "acme.sites.example": "acme",
        "acme-company.sites.example": "acme-company",
        "localhost:3000": "development",
        "test-client-14.vercel.app": "test-client-14",
        "test-client-14-kszvvxbwu-team-projects.vercel.app": "test-client-14",
        "kszvvxbwu-a-b-c.vercel.app": "kszvvxbwu-a-b-c",  # no project before the hash-like part
        "a-b-c-d.vercel.app": "a-b-c-d",
        "a-longsegment.sites.example": "a-longsegment",
        "example.com": None,
        "Bad_1.sites.example": None,
        "acme\n.sites.example": None,
        "": None,
    }
    assert run(spark, text.host_to_slug, list(cases)) == list(cases.values())


def test_slugs(spark):
    cases = {"  Acme Corp_2 ": "acme-corp-2", "--a---b--": "a-b", "Ünï cödé": "n-cd", "a b": "a-b", "___": "", "o'Brien & co": "obrien-co"}
    assert run(spark, text.sanitize_slug, list(cases)) == list(cases.values())
    assert run(spark, text.form_slug, ["A b_C-"]) == ["abc-"]


def test_titles_follow_letters_not_words(spark):
    cases = ["acme-corp", "o2x-site", "o'neil-x", "ABC", ""]
    assert run(spark, text.display_name, cases) == [c.replace("-", " ").title() for c in cases]


def test_strip_matches_python(spark):
    cases = ["  a b 　\n", "\x1c\x85x\t", "", "   "]
    assert run(spark, text.python_strip, cases) == [c.strip() for c in cases]


def test_paths(spark):
    assert run(spark, text.path_segments, ["/a//b/", "/", "", None]) == [["a", "b"], [], [], None]
    assert run(spark, text.segments_path, [["a", "b"], [], None], "array<string>") == ["/a/b", "/", "/"]


def test_error_help(spark):
    cases = ["GitHub and Vercel", "BuilderIO x", "Builder.io", "GitHub 422", "boom"]
    got = [r["message"] for r in run(spark, text.classify_error, cases)]
    assert got == ["Vercel deployment or API error", "Builder.io API error", "Builder.io API error", "GitHub API error", "Unexpected error during site generation"]


def test_build_log_is_between_first_and_second_marker(spark):
    got = run(spark, text.extract_build_log, ["x Build logs: a Build logs: b", "none", "Build logs:\n\t c \n"])
    assert [(r["build_logs"], r["build_state"]) for r in got] == [("a", "ERROR"), (None, None), ("c", "ERROR")]


@pytest.mark.parametrize("n", [0, 3, 10, 11, 25])
def test_failure_report(spark, n):
    logs = "\n".join(["fine"] + [f"{i} Error" if i % 2 else f"{i} FAILED" for i in range(n)])
    fn = lambda v: text.build_failure_report(F.lit("ERROR"), F.lit("bad"), text.error_lines(v), v != "")
    bad = [line for line in logs.split("\n") if line != "fine"]
    want = ["Vercel build failed (state: ERROR)", "Error: bad", "\nBuild Errors:"] + [f"  {b}" for b in bad[:10]]
    want += [f"  ... and {n - 10} more errors"] if n > 10 else []
    assert run(spark, fn, [logs]) == ["\n".join(want)]
    assert run(spark, fn, [""]) == ["Vercel build failed (state: ERROR)\nError: bad"]


def test_outcomes_and_names(spark):
    got = run(spark, text.build_outcome, ["READY", "ERROR", "CANCELED", "BUILDING", None])
    assert [(r["finished"], r["success"]) for r in got] == [(True, True), (True, False), (True, False), (False, None), (False, None)]
    assert run(spark, text.archived_name, ["a", "ARCHIVED-a"]) == ["ARCHIVED-a", "ARCHIVED-a"]
    assert run(spark, text.key_format, [None, "", "abc", "pub-1"]) == ["missing", "missing", "invalid_format", "candidate"]
    assert run(spark, text.masked_key, ["pub-0123456789abcd", ""]) == ["pub-012345...abcd", "None"]


def _errors(spark, **row):
    base = dict(client_name="Acme", client_slug="acme", contact_email="a@b.co", website_type="blog", tier="entry", builder_public_key="", builder_private_key="")
    base.update(row)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base))
    return df.select(forms.form_errors().alias("e")).first()["e"]


def test_forms(spark):
    assert _errors(spark) == []
    assert _errors(spark, tier=None) == []
    assert _errors(spark, client_slug="-a") == [forms.SLUG_SHORT_ERROR]  # two characters: length only
    assert _errors(spark, client_slug="A" * 31) == [forms.SLUG_FORMAT_ERROR]  # malformed: format only
    assert _errors(spark, client_slug="a" * 31) == [forms.SLUG_LONG_ERROR]
    assert _errors(spark, client_slug="abc\n") == []  # one final line feed passes, as in the form's own check
    assert _errors(spark, client_slug="abc\r") == [forms.SLUG_FORMAT_ERROR]
    assert _errors(spark, client_name="  ", client_slug=None) == ["Client Name is required", "Client Slug is required"]
    assert _errors(spark, contact_email="a@b") == [forms.EMAIL_ERROR]
    assert _errors(spark, website_type="shop") == [forms.TYPE_ERROR]
    keys = ["Builder.io Public Key is required", "Builder.io Private Key is required"]
    assert _errors(spark, tier="premium") == keys
    assert _errors(spark, tier=" entry ") == []
    assert _errors(spark, builder_public_key="short") == [forms.PUBLIC_SHORT_ERROR]
    assert _errors(spark, builder_public_key="x" * 19 + "-") == [forms.PUBLIC_FORMAT_ERROR]
    assert _errors(spark, builder_public_key="pub-" + "-" * 16) == []
    assert _errors(spark, builder_private_key="short") == [forms.PRIVATE_SHORT_ERROR]


def _parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response_text string")
    return responses.parse_response_files(df).orderBy("i").collect()


FILES = '{\n  "files": [\n    {"path":"components/A.tsx","content":"1"},\n    {"path":"package.json","content":"2"}\n  ]\n}'


def test_responses(spark):
    cut = FILES[: FILES.index('"2"')]
    rows = _parse(
        spark, f"Hi\n```json\n{FILES}\n```\nbye", f"```\n{FILES}", f"text {FILES} more", f"```json\n{cut}", "nothing here", "```json\n{broken",
        "``````", f"see ``` and ```json\n{FILES}```",
    )
    assert [r["parse_state"] for r in rows] == ["parsed", "parsed", "parsed", "repaired", "no_json", "malformed", "no_json", "parsed"]
    assert [f["path"] for f in rows[3]["files"]] == ["components/A.tsx"]
    assert rows[4]["files"] is None and len(rows[0]["files"]) == 2


def test_text_after_the_object_is_no_json(spark):
    for tail in (" x", "}", "]", ", 1", ', "b": 2', ', {"files": []}', "] ["):
        assert _parse(spark, f"```json\n{FILES}{tail}```")[0]["parse_state"] != "parsed"
    assert [r["parse_state"] for r in _parse(spark, f"```json\n{FILES} x```", "```{'files': []}```", '```[{"files": []}]```', "```{}```")] == [
        "repaired", "malformed", "malformed", "malformed"]


def test_response_map_shape(spark):
    df = spark.createDataFrame([('```json\n{"files": {"app/page.tsx": "x"}}',)], "response_text string")
    assert responses.parse_response_files(df, shape=responses.MAP_SHAPE).first()["files"] == {"app/page.tsx": "x"}


def test_file_lists(spark):
    files = spark.createDataFrame([([("components/x/B.tsx", "c"), ("components/readme.md", "c"), (None, "c"), ("package.json", "c")],)], "files array<struct<path: string, content: string>>")
    row = files.select(
        responses.component_names(F.col("files")).alias("names"), responses.missing_files(F.col("files")).alias("missing")
    ).first()
    assert row["names"] == ["B"]
    assert row["missing"] == [p for p in responses.REQUIRED_FILES if p != "package.json"]
    assert run(spark, responses.edit_files, ["seo", "odd", None]) == [["app/layout.tsx"], ["app/page.tsx"], ["app/page.tsx"]]


def test_times(spark):
    moments = [datetime(2024, 1, 30, 0, 0), datetime(2024, 1, 29, 23, 59, 59), datetime(2024, 1, 30, 18, 0), datetime(2024, 1, 30, 17, 59), None]
    assert run(spark, lambda c: times.check_freshness(c, NOW), moments, "timestamp_ntz") == ["aging", "stale", "fresh", "aging", "never_checked"]
    rounding = [datetime(2024, 1, 1, 0, 0, 0, 500), datetime(2024, 1, 1, 0, 0, 0, 1499), datetime(2024, 1, 3)]
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert run(spark, lambda c: times.duration_ms(start, c), rounding, "timestamp_ntz") == [1, 1, 172_800_000]
    assert run(spark, lambda c: times.hour_part(times.moment(NOW) - c), [datetime(2024, 1, 28, 22)], "timestamp_ntz") == [2]


def test_records(spark):
    assert run(spark, records.error_count, [["a", "b"], [], None], "array<string>") == [2, None, None]
    assert run(spark, records.platform_success, ['{"success":true}', '{"success":"true"}', '{"success":false}', "{}", None, "{bad"]) == ["success"] * 2 + ["failed"] * 4
    assert run(spark, lambda c: records.json_text(c, "k"), ['{"k":null}', '{"k":{"a":1}}', '{"k":1.5}']) == [None, '{"a":1}', "1.5"]
    assert run(spark, lambda c: records.clamped(c, F.lit(-3)), [5, 2, None], "int") == [2, 0, 0]
    assert run(spark, lambda c: records.changed(c, F.lit("a")), ["a", "b", None]) == [False, True, True]
    assert run(spark, records.gate_recommendation, ["pending_onboarding", "suspended", None]) == ["Complete onboarding first", "Contact support", "Contact support"]
    flags = spark.createDataFrame([(True, None, False, True)], "a boolean, b boolean, c boolean, d boolean")
    assert flags.select(records.deletion_progress(*[F.col(c) for c in "abcd"])).first()[0] == 50.0


def test_overall_health(spark):
    rows = [("healthy",) * 5, ("healthy", "down", "healthy", "healthy", "healthy"), ("down", "healthy", "healthy", "healthy", "healthy"), (None,) * 5, ("healthy", "healthy", None, "healthy", "healthy"), (None, None, None, None, "down")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string, e string")
    got = [r[0] for r in df.orderBy("i").select(records.overall_health(*[F.col(c) for c in "abcde"])).collect()]
    assert got == ["healthy", "down", "degraded", "error", "degraded", "down"]
