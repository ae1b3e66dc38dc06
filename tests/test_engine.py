from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strata.engine import BELOW_FLOOR, NO_MATCH, Engine
from strata.operators import dense
from strata.settings import Settings
from strata.sources import io


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        (1, "Apple sold many phones and its revenue grew", "AAPL", 2023, "Item 7", 0, 1), (2, "Apple faces risk of supply", "AAPL", 2023, "Item 1A", 0, 2), (3, "Pfizer revenue fell", "PFE", 2022, "Item 7", 0, 3),
        (4, "None.", "AAPL", 2022, "Item 4", 0, 4), (5, None, "PFE", 2022, "Item 8", 1, 5),
    ]
    df = spark.createDataFrame(rows, "key bigint, text string, ticker string, year int, section string, chunk_index int, record_id bigint")
    df = df.withColumn("is_sparse", F.col("key") == 4).withColumn("incorporated_by_reference", F.lit(None).cast("boolean")).withColumn("company", F.col("ticker")).withColumn("period_of_report", F.lit("2023-01-01"))
    df = dense.embed(df, "text", "embedding", dense.hashed_encoder)
    figures = spark.createDataFrame([(1, "AAPL", 2023, "revenue", 100e6, 100.0, 1), (2, "AAPL", 2023, "net_income", None, 5.0, 1)], "figure_id bigint, ticker string, year int, metric string, value double, statement_value double, extracted_at int")
    return Engine(df, figures, Settings(top_k=3))


def ask(spark, *rows):
    df = spark.createDataFrame(rows, "query_id string, query string, ticker string, year string, section string")
    return dense.embed(df, "query", "query_vector", dense.hashed_encoder)


def test_tool_has_three_outcomes(spark, engine):
    got = {r["query_id"]: r for r in engine.search_tool(ask(spark, ("a", "phones revenue", "Apple", "2023", "7"), ("b", "zebra quark lepton", "pfizer", "2022", None), ("c", "anything", "MSFT", "2024", None))).collect()}
    assert got["a"]["status"] == "results" and "[AAPL | FY2023 | Item 7 | chunk 0]" in got["a"]["rendered"] and "Item 1A" not in got["a"]["rendered"]
    assert (got["b"]["status"], got["b"]["rendered"]) == ("below_floor", BELOW_FLOOR)
    assert (got["c"]["status"], got["c"]["rendered"]) == ("none", NO_MATCH)
    assert got["a"]["adjusted"] == "ticker Apple -> AAPL" and got["c"]["adjusted"] == "none"


def test_every_version_answers(spark, engine):
    q = ask(spark, ("a", "What was Apple's revenue in 2023?", None, None, None)).select("query_id", "query", "query_vector")
    for version in ("v1", "v2", "v3", "v4"):
        top = engine.search(q, version).orderBy("rank").first()
        assert top["key"] in ((1, 2, 3) if version in ("v1", "v2") else (1,)), version  # unscoped, the stand-in encoder only counts words


def test_corpus_and_financials(spark, engine):
    held = {(r["ticker"], r["year"]): (r["chunks"], r["sections"]) for r in engine.list_corpus().collect()}
    assert held["AAPL", 2023] == (2, 2) and held["PFE", 2022] == (2, 2) and held["MSFT", None] == (0, 0)
    r = engine.get_financials().first()
    assert r["metrics"] == {"revenue": 100.0} and r["unavailable"] == ["net_income"]
    assert engine.fiscal_notes().where("year = 2023").first()["note"].endswith("fiscal 2022")
    with pytest.raises(ValueError, match="figures"):
        Engine(engine.chunks).get_financials()


def test_evaluation(spark, engine):
    labelled = spark.createDataFrame([("a", "AAPL", 2023, "Item 7", ["phones", "grew"], "factual", "easy"), ("b", "PFE", 2022, "Item 7", ["nothing"], "trend", "hard")], "id string, ticker string, year int, section string, answer_keywords array<string>, question_type string, difficulty string")
    q = ask(spark, ("a", "Apple phones revenue", None, None, None), ("b", "Pfizer", None, None, None)).select("query_id", "query", "query_vector")
    records, report = engine.evaluate(q, labelled)
    assert {r["query_id"]: r["keyword_hit"] for r in records.collect()} == {"a": 1.0, "b": 0.0}
    total = report.where("dimension = 'all'").first()
    assert (total["n"], total["perfect"], total["zero"]) == (2, 0.5, 0.5)
    lines = io.text_table(report.where("dimension = 'difficulty'"), ["value", "n"])
    assert [x.split()[0] for x in lines] == ["value", "easy", "hard"]


def test_runs_and_reports_as_files(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"runs": [{"id": "a", "answer": "x", "year": 2023, "error": None}, {"id": "b"}]}, indent=1))
    assert [(r["id"], r["year"]) for r in io.read_runs(spark, str(tmp_path / "run.json")).collect()] == [("a", 2023), ("b", None)]
    io.write_report(spark.createDataFrame([(1, "x")], "n int, v string"), str(tmp_path / "deep" / "report"))
    assert spark.read.json(str(tmp_path / "deep" / "report")).count() == 1
    with pytest.raises(ValueError, match="identity"):
        io.read_listing(spark, "nowhere", " ")


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "chunks")
    io.write_chunks(spark.createDataFrame([("A", 2022, 1), ("A", 2022, 2), ("B", 2022, 3)], "ticker string, year int, key int"), path)
    io.write_chunks(spark.createDataFrame([("A", 2022, 9)], "ticker string, year int, key int"), path)
    assert sorted(r["key"] for r in io.read_chunks(spark, path, ["key"]).collect()) == [3, 9]


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("STRATA_TOP_K", "7")
    monkeypatch.setenv("STRATA_LEXICAL_WEIGHT", "0.5")
    s = Settings.from_env()
    assert (s.top_k, s.lexical_weight, s.rrf_k) == (7, 0.5, 60)


def test_stored_index_gives_the_same_results(spark, engine, tmp_path):
    from strata.operators import lexical

    q = spark.createDataFrame([("a", "phones revenue phones", "AAPL", 2023), ("b", "revenue", None, None), ("c", "", None, None), ("d", None, None, None), ("e", "absent words", None, None)], "query_id string, query string, q_ticker string, q_year int")
    plain = lexical.search(engine.chunks, q, 5).collect()
    first = engine.chunks.where("key <= 2")
    lexical.write(first, str(tmp_path / "i"))
    index = lexical.append(engine.chunks.where("key > 2"), str(tmp_path / "i"))
    assert sorted(map(tuple, lexical.search(engine.chunks, q, 5, index=index).collect())) == sorted(map(tuple, plain)) and {r["query_id"] for r in plain} == {"a", "b"}
    assert lexical.search(engine.chunks.limit(0), q, 5).count() == 0


def test_command_line(spark, engine, tmp_path, capsys, monkeypatch):
    from strata import __main__ as cli

    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    sections = spark.createDataFrame([("f1", "Item 7", "Sales of phones grew strongly this year. " * 30, "AAPL", 2023), ("f1", "Item 4", "None.", "AAPL", 2023), ("f2", "Item 1A", "Risks of supply remain high. " * 20, "PFE", 2022)], "filing_id string, item string, text string, ticker string, year int")
    at = lambda x: str(tmp_path / x)
    sections.write.parquet(at("sections"))
    labelled = spark.createDataFrame([("q1", "Which sales grew?", "AAPL", 2023, "Item 7", ["phones"], "factual", "easy"), ("q2", "What risks?", "PFE", 2022, "Item 1A", ["supply"], "factual", "hard")], "id string, question string, ticker string, year int, section string, answer_keywords array<string>, question_type string, difficulty string")
    labelled.write.parquet(at("questions"))
    runs = spark.createDataFrame([("q1", "It was $5,000 in all. [AAPL | FY2023 | Item 7 | chunk 0]", None, [5000.0], [("AAPL", 2023, "Item 7", 0)], "factual", "Item 7", "AAPL"), ("q2", None, "failed", [], [], "factual", "Item 1A", "PFE")], "id string, answer string, error string, grounded array<double>, retrieved array<struct<ticker:string,year:int,section:string,chunk:int>>, question_type string, section string, ticker string")
    runs.write.parquet(at("runs"))
    for argv in (["ingest", at("sections"), at("chunks")], ["index", at("chunks"), at("index")], ["search", at("chunks"), "sales of phones", "--retrieval", "v2", "--index", at("index"), "--ticker", "AAPL"],
                 ["evaluate", at("chunks"), at("questions"), "--retrieval", "v2", "--output", at("a")], ["evaluate", at("chunks"), at("questions"), "--use-filters", "--output", at("b")], ["compare", at("a"), at("b")], ["judge", at("runs")], ["list"]):
        assert cli.main(argv) == 0
    said = capsys.readouterr().out
    assert "[AAPL | FY2023 | Item 7]" in said and "50.0%" not in said.split("bucket")[0][-5:] and "search_v3" in said
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", str(tmp_path)])


def test_spans_and_statements(spark, engine, tmp_path):
    from strata.operators import predicates

    q = spark.createDataFrame([("a", "phones"), ("b", "x")], "query_id string, query string")
    hits = spark.createDataFrame([("a", 1, 0.5, "F", "AAPL", 2023, "Item 7", 0, "text")], "query_id string, rank int, score double, filing_id string, ticker string, year int, section string, chunk_index int, text string")
    spans = {r["query_id"]: json.loads(r["span"]) for r in io.span_records(hits, q, "v1", predicates.describe_filters(ticker="AAPL")).collect()}
    assert spans["a"]["retrieval.documents"][0]["document.id"] == "F|Item 7|0" and spans["a"]["retrieval.filter.ticker"] == "AAPL" and spans["b"]["retrieval.result_count"] == 0
    (tmp_path / "F").mkdir()
    (tmp_path / "F" / "income.txt").write_text("Total revenue 5\nx")
    (tmp_path / "F" / "balance.txt").write_text(" ")
    assert [tuple(r) for r in io.read_statements(spark, str(tmp_path)).collect()] == [("F", "income", "Total revenue 5\nx")]
    told = {r["query_id"]: r["rendered"] for r in engine.financials_tool(spark.createDataFrame([("a", "Apple", "2023"), ("b", "zzz", "2023"), ("c", "AAPL", "2022")], "query_id string, ticker string, year string")).collect()}
    assert "revenue" in told["a"] and "100" in told["a"] and told["b"].startswith("Both a company") and told["c"].startswith("No figures of AAPL FY2022")


def test_calls_are_planned(spark, engine):
    rows = [("a", "Compare Apple and Pfizer revenue in 2023"), ("b", "How did Apple's supply risks evolve?"), ("c", "Which companies face risk?"), ("d", None), ("e", "Apple risk")]
    got = {}
    for r in engine.plan(spark.createDataFrame(rows, "query_id string, query string")).orderBy("query_id", "step").collect():
        got.setdefault(r["query_id"], []).append((r["step"], r["tool"], r["ticker"], r["year"]))
    assert got["a"] == [(1, "get_financials", "AAPL", 2023), (2, "search", "AAPL", 2023), (3, "get_financials", "PFE", 2023), (4, "search", "PFE", 2023)]
    assert got["b"] == [(1, "search", "AAPL", 2024), (2, "search", "AAPL", 2023), (3, "search", "AAPL", 2022)]
    assert got["c"] == [(1, "list_corpus", None, None), (2, "search", None, None)] and got["e"] == [(1, "search", "AAPL", 2024)] and "d" not in got


def test_settings_of_a_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nSTRATA_TOP_K=7\nSTRATA_RRF_K = '50'\n")
    monkeypatch.setenv("STRATA_RRF_K", "40")
    got = Settings.from_env(file=str(tmp_path / ".env"))
    assert (got.top_k, got.rrf_k) == (7, 40) and Settings.from_env(file=str(tmp_path / "none")).top_k == 5
