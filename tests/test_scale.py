"""Plans that grow with the tables: what is not sent through the driver, and what is not done twice."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.operators import connected, identities
from tallyforge.operators import statement_rows as R
from tallyforge.plans.statement_queries import demo_statements
from tallyforge.sources.statements import Tables, statements, table_of

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dirty_price", "future_flows", "ytm", "ytp", "ytp_put", "current_yield", "yield_compare", "settlement_match", "verify_board", "schedule_payments", "schedule_issues", "schedule_currencies"])
def test_sides_that_grow_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(entry.queries()[name](spark, DIR))


def test_a_filter_on_mapped_rows_does_not_repeat_the_mapping(spark):
    m = R.mapped_rows(R.table_rows(statements(demo_statements(spark, DIR), "report", "content")))
    for x in (R.statement_operations(m), R.unparsed_rows(m)):
        assert "regexp" not in plan(x) and "MapInPandas" not in plan(x)


def test_mentions_without_a_ticker_do_not_meet_in_one_task(spark):
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(k, v)
    try:
        m = spark.range(8000).selectExpr("id AS seq", "if(id % 2 = 0, concat('T', id), null) AS ticker", "if(id % 2 = 1 or id % 4 = 0, concat('I', id), null) AS isin")
        t = m.where("ticker IS NOT NULL AND isin IS NOT NULL").selectExpr("ticker", "isin AS its", "1 AS isins")
        x = identities.with_identity(m, t)
        got = {r.seq: r.ref for r in x.collect()}
        assert all(got[i] == (f"TT{i}" if i % 4 == 2 else f"II{i}") for i in range(8000))
        assert max(r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()) < 3000
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)


class Slow(Tables):
    """The parser by the library's own reading of every tag."""

    parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag


def test_plain_tags_are_read_as_the_library_reads_them():
    r = random.Random(3)
    bits = ["<td>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "<TD>", "<td class='a'>", "</td >", "<p>", "</p>", "<h2>", "</h2>", "<script>", "</script>", "<textarea>", "</textarea>", "<title>", "</title>", "<!-- <td> -->", "<br/>", "<td/>", "text ", "&amp;", "<", "</", "<b>", "</b>", "<th>", "<caption>"]
    for _ in range(3000):
        markup = "".join(r.choices(bits, k=r.randint(1, 40)))
        assert Tables(markup).found == Slow(markup).found, markup


class Library(Slow):
    """The same for whole files."""

    def __init__(self, markup):
        self.markup = markup
        super().__init__(markup)

    def cut(self, parts):
        self.single = False
        self.feed(self.markup)
        self.close()


def test_plain_files_are_read_as_the_library_reads_them():
    r = random.Random(5)
    row = "<tr><td> a  b</td><td></td><th>c\u00a0</th></tr>"
    bits = ["<td>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "<tbody>", "</tbody>", "<p>", "</p>", "<h2>", "<caption>", "</caption>", "<html>", "<body>", "<div>", "</div>", "text ", " x ", "&amp;", "&nbsp;z", "&am", row, row, "<tr></tr>", "<tr><td>x</th></tr>"]
    for i in range(3000):
        markup = "".join(r.choices(bits + ["<script>", "</td >", "<!-- <td> -->", "<br/>", "<"] * (i % 3 == 0), k=r.randint(1, 40)))
        assert [table_of(t) for t in Tables(markup).found] == [table_of(t) for t in Library(markup).found], markup


def test_plain_statements_need_no_reading_of_single_tags(spark, monkeypatch):
    texts = [r.content for r in demo_statements(spark, DIR).limit(50).collect()]
    want = [[table_of(t) for t in Library(x).found] for x in texts]
    monkeypatch.setattr(Tables, "feed", None)
    assert [[table_of(t) for t in Tables(x).found] for x in texts] == want


def test_tables_do_not_meet_by_their_headings(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = R.table_rows(statements(demo_statements(spark, DIR), "report", "content"))
        assert "hashpartitioning" not in plan(x) and x.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_headings_are_joined_by_a_shuffle(spark, monkeypatch):
    parsed = statements(demo_statements(spark, DIR), "report", "content")
    want = sorted(map(str, R.table_rows(parsed).collect()))
    monkeypatch.setattr(R, "LOOKS", 0)
    x = R.table_rows(parsed)
    assert "SortMergeJoin" in plan(x) and sorted(map(str, x.collect())) == want


def test_the_mapping_is_compiled_in_small_methods(spark, monkeypatch):
    sizes = []

    def staged(df, name):
        if name == "mapped":
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
            sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))))
        return rows_staged(df, name)

    rows_staged = R.staged
    monkeypatch.setattr(R, "staged", staged)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        R.mapped_rows(R.table_rows(statements(demo_statements(spark, DIR), "report", "content")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_totals_as_they_are_written(spark):
    totals = [["5", "Итого"], ["ПОДЫТОГ 7", "1"], ["всёго:", "1"], ["1", "в.\u00a0том  числе"], ["", " ", "«»"], [], ["Раздел", "."], ["Обороты"]]
    rows = [["итогов", "1"], ["5"], ["Раздел 5", ""], ["a", "b"], ["не всего", "1"], ["обороты", "1"]]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(totals + rows)], "i int, cells array<string>")
    assert [r.t for r in x.select("i", R.is_total(F.col("cells")).alias("t")).orderBy("i").collect()] == [True] * len(totals) + [False] * len(rows)


def test_finished_components_take_no_part_in_later_rounds(spark, monkeypatch):
    wrote = []

    def staged(df, name):
        out = connected_staged(df, name)
        wrote.append(out.count() if name == "edges" else 0)
        return out

    connected_staged = connected.staged
    monkeypatch.setattr(connected, "staged", staged)
    e = spark.range(16_000).selectExpr("id AS a", "id + 1 AS b").where("b % 16 <> 0")
    got = connected.components(e)
    assert sum(wrote) < 2.5 * 15_000
    assert got.where("label <> node - node % 16").isEmpty() and got.count() == 16_000
