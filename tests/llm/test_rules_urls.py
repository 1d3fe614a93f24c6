"""Rule ledger and URL filter against DuckDB and by hand."""

import duckdb
import pytest
from compare import bag, compare, connect
from llm_cases import AWKWARD, SMALL, documents  # noqa: F401

from fleetspark import llm
from fleetspark.llm import rules, urls


@pytest.mark.parametrize("name", ["op9_quality_rules", "op10_url_filter"])
def test_whole_table_as_duckdb(spark, name):
    equal, _, difference = compare(spark, connect(SMALL), llm.QUERIES[name], llm.ORACLES[name], SMALL)
    assert equal, difference


def in_duckdb(df, name, sql):
    con = duckdb.connect()
    con.register(name, df.toArrow())
    cursor = con.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())


def test_rules_on_awkward_texts(documents):
    texts = [t for t in AWKWARD if t is None or "\0" not in t]
    repeats = ["a b c a b c", "x x x x", "one two\none two\n \none two", "p q r s p q r", "t " * 60, "w1 w2 w3 " * 40 + "tail"]
    df = documents(list(enumerate(texts + repeats)) + [(None, "no id"), (1, "same"), (1, "same")])
    out = rules.op9(df)
    assert bag(out.columns, out.collect()) == in_duckdb(df, "documents", rules.ORACLE)


def test_rules_of_no_rows(documents):
    assert rules.op9(documents([(1, "x")]).where("doc_id > 1")).collect() == []


def test_repeat_words_by_hand(documents):
    got = {r.doc_id: r.n_repeat_words for r in rules.op9(documents([(1, "a b c d a b c"), (2, "x x x x"), (3, "a b a b"), (4, "a b c")])).collect()}
    assert got == {1: 6, 2: 4, 3: 0, 4: 0}


def test_policies_and_ablations(documents):
    good = " ".join(f"word{i}" for i in range(60))
    book = rules.ledger(documents([(1, good), (2, "few words"), (3, "t " * 60), (4, good + " ###" * 10)]))
    kept = lambda version: sorted(r.doc_id for r in rules.verdicts(book, version).where("kept").collect())
    assert kept(1) == [1, 4] and kept(2) == [1]
    found = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(book, 2).collect()}
    assert found["symbols"] == (1, 1) and found["too_few_words"] == (1, 1) and found["repeated_words"][0] == 1
    # Without a rule exactly its own rejections come back.
    for name, (_, only) in found.items():
        rest = rules.mask_of([n for n in rules.POLICIES[2] if n != name])
        assert book.where(f"failed & {rest} = 0").count() - 1 == only


def test_ledger_ignores_other_columns(documents):
    df = documents([(1, "a b")]).withColumnRenamed("lang", "_t").withColumnRenamed("source", "failed")
    assert rules.op9(df).first().n_words == 2


URLS = [
    ("https://Blog.X.Example.ORG/en/2?q=1#f", "blog.x.example.org", "/en/2", "org/", "allow"), ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"), ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://x.org", "x.org", "", None, None), ("http://x.org?a=/b", "x.org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("a://ÄÖ.COM/fr/x", "ÄÖ.com", "/fr/x", "com/fr/", "allow"), ("http://u?v://w.org/", "u", "", None, None), ("://", "", "", None, None),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_by_hand(spark):
    got = {r.page_id: r for r in urls.op10(spark, pages(spark, [(i, u[0], None) for i, u in enumerate(URLS)])).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), URLS[i]
        assert verdict is None or got[i].verdict == verdict


def test_urls_as_duckdb(spark):
    rows = [(i, u[0], None) for i, u in enumerate(URLS)] + [(None, "http://n.net/a", None), (3, "http://x.com/fr/", None)] + [(100, "http://very.net/" + "ab" * 4000, None)]
    df = pages(spark, rows)
    out = urls.op10(spark, df)
    assert bag(out.columns, out.collect()) == in_duckdb(df, "pages", urls.ORACLE)


def test_urls_without_models(spark):
    assert urls.op10(spark, pages(spark, [])).collect() == []
    rows = [(1, "http://a.net/x", None), (2, "http://b.org/x", None)]  # nothing is rejected, so nothing is learned
    assert [r.verdict for r in urls.op10(spark, pages(spark, rows)).collect()] == ["allow", "allow"]


def test_characters_decide_where_no_rule_does(spark):
    rows = [(i, f"http://good{i}.org/story/of/days", None) for i in range(40)] + [(100 + i, f"http://shop{i}.com/de/buy-cheap-pills", None) for i in range(40)]
    rows += [(900, "http://other.net/story/of/nights", None), (901, "http://other.net/buy-cheap-pills-now", None)]
    got = {r.page_id: r.verdict for r in urls.op10(spark, pages(spark, rows)).collect()}
    assert got[900] == "allow" and got[901] == "block"


def test_the_whole_url_is_read(spark):
    """Query strings and texts without a scheme are judged by their characters, too."""
    rows = [(i, f"http://good{i}.org/story/of/days", None) for i in range(40)] + [(100 + i, f"http://shop{i}.com/de/buy-cheap-pills", None) for i in range(40)]
    rows += [(900, "http://other.net/?page=buy-cheap-pills", None), (901, "mailto:buy-cheap-pills", None), (902, "http://other.net/#story/of/days", None), (903, None, None), (904, "", None)]
    got = {r.page_id: r for r in urls.op10(spark, pages(spark, rows)).collect()}
    assert [got[i].verdict for i in (900, 901, 902)] == ["block", "block", "allow"] and got[901].ratio != got[903].ratio == got[904].ratio
