"""The same operators as DataFrames, page sources, the cache, the stream and the command line."""

import datetime as dt
import gzip
import io
import json
import os
import re
import urllib.error

import pytest
from pyspark.sql import functions as F

from stemma import Engine, cli
from stemma.functions import languages as L
from stemma.functions import vocab as V
from stemma.operators import checks as C
from stemma.operators import histories as H
from stemma.operators import sections as S
from stemma.sources import cache as cache_module
from stemma.sources import pages as P
from stemma.sources.cache import PageCache
from stemma.streaming import ingest


def entry(language, etymology):
    return f"=={language}==\n\n===Etymology===\n{etymology}\n\n===Noun===\n{{{{head}}}}\n"


PAGES = {
    "fuoco": entry("Italian", "From {{inh|it|la|focus|t=hearth}}, from {{der|it|ine-pro|*q}}."),
    "focus": entry("Latin", "Possibly {{der|la|grc|fos}}."),
    "fuochi": "==Italian==\n\n===Noun===\n{{head}}\n\n# {{plural of|it|fuoco}}\n",
    "blank": "",
    "gone": None,
    "caposala": entry("Italian", "{{af|it|capo|sala}}"),
    "capo": entry("Italian", "From {{inh|it|la|caput}}."),
    "sala": entry("Italian", "From {{bor|it|lng|sala}}."),
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, PAGES)


def words(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "lemma string")


def test_batch_equals_single(spark, engine):
    got = {r.lemma: r for r in engine.walk(words(spark, *PAGES, "none"), with_views=True).collect()}
    assert set(got) == {*PAGES, "none"}
    for name, row in got.items():
        one = engine.reconstruct(name)
        assert [list(r.path) for r in one.history.rows] == [n.path for n in row.nodes]
        assert row.tree.rpartition(" · ")[0] == one.tree().rpartition(" · ")[0]
    assert got["fuochi"].resolution == "plural of «fuoco»"
    assert got["none"].nodes[0].terminal == got["gone"].nodes[0].terminal == "ENTRY_MISSING"
    assert got["blank"].nodes[0].terminal == "LANGUAGE_MISSING"
    assert json.loads(got["caposala"].json)["tree"]["ancestors"][1]["lemma"] == "sala"


def test_partitions_do_not_matter(spark, engine):
    roots = words(spark, *PAGES)
    base = sorted(map(str, H.nodes(engine.walk(roots)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert sorted(map(str, H.nodes(engine.walk(roots.repartition(7))).collect())) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], P.PAGES)
    assert H.histories(empty, words(spark, "x")).collect()[0].nodes[0].terminal == "ENTRY_MISSING"
    assert H.histories(empty, spark.createDataFrame([], "lemma string")).count() == 0
    odd = spark.createDataFrame([(None, "x"), ("t", None), ("t", entry("Italian", "{{unk|it}}")), ("t", entry("Italian", "{{unk|it}}"))], "title string, wikitext string")
    assert S.read_pages(odd).count() == 1
    twice = spark.createDataFrame([("t", "it"), ("t", "it"), (None, "it")], "lemma string, language string")
    assert [r.nodes[0].terminal for r in H.histories(odd, twice).collect()] == ["UNCERTAIN_ORIGIN"]


def test_source_errors(spark):
    pages = P.from_dict(spark, {"x": entry("Italian", "From {{inh|it|la|y}}, from {{der|it|grc|z}}.")})
    bad = spark.createDataFrame([("y",), ("w",)], "title string")
    got = {r.lemma: r for r in H.histories(pages, words(spark, "x", "w"), errors=bad).collect()}
    assert [n.lemma for n in got["x"].nodes] == ["x", "y", "z"] and got["w"].error == "w" and got["w"].nodes == []


def test_aggregates_and_senses(spark, engine):
    nodes = H.nodes(engine.walk(words(spark, "fuoco", "caposala")))
    assert {r.word_id: (r.steps, r.nodes) for r in H.depths(nodes).collect()} == {"it:fuoco": (2, 3), "it:caposala": (2, 5)}
    assert {r.label: r.n for r in H.terminal_tally(nodes, V.terminals_df(spark)).collect()} == {"no Wiktionary entry": 2, "language not covered by the entry": 1}
    assert [r.lemma for r in H.main_chains(nodes).where("word_id = 'it:caposala'").orderBy("depth").collect()] == ["caposala", "capo", "caput"]
    one = H.coverage(engine.walk(words(spark, "fuoco", "fuochi", "none", "blank"))).collect()[0]
    assert (one.words, one.chain, one.missing) == (4, 2, 1)
    assert engine.senses_of(words(spark, "fuoco")).collect()[0].ancestor == "focus"


def test_invariants_find_what_is_wrong(spark, engine):
    nodes = H.nodes(engine.walk(words(spark, *PAGES)))
    for f in (C.markup_in_lemma, C.colon_in_lemma, C.unread_findings, C.repeated_on_branch):
        assert f(nodes).isEmpty()
    assert C.impossible_links(nodes, V.languages_df(spark)).isEmpty()
    schema = nodes.schema
    base = {f.name: None for f in schema} | {"word_id": "w", "hypotheses": [], "variants": []}
    bad = [
        base | {"path": [], "parent_path": None, "lemma": "a", "language": "lng", "depth": 0},
        base | {"path": [0], "parent_path": [], "lemma": "[[b", "language": "de", "depth": 1},
        base | {"path": [0, 0], "parent_path": [0], "lemma": "x:A", "language": "lng", "depth": 2},
        base | {"path": [0, 0, 0], "parent_path": [0, 0], "lemma": "A", "language": "lng", "depth": 3},
        base | {"path": [1], "parent_path": [], "lemma": "", "language": "la", "depth": 1, "terminal": "IMITATIVE"},
    ]
    broken = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in bad], schema)
    assert C.markup_in_lemma(broken).count() == C.colon_in_lemma(broken).count() == C.unread_findings(broken).count() == C.repeated_on_branch(broken).count() == 1
    assert C.impossible_links(broken, V.languages_df(spark)).count() == 1


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


@pytest.fixture(scope="module")
def written(engine, spark):
    """Nodes in files, which seem small to the planner."""
    return H.materialize(H.nodes(engine.walk(words(spark, *PAGES))), "nodes")


def test_repeats_on_branches_are_not_broadcast(written):
    plan = final_plan(C.repeated_on_branch(written))
    assert "SortMergeJoin [word_id" in plan and "Broadcast" not in plan


def test_links_are_not_broadcast(spark, written):
    plan = final_plan(C.impossible_links(written, V.languages_df(spark)))
    assert "SortMergeJoin [word_id" in plan and "BroadcastHashJoin [word_id" not in plan


def test_proposals_are_not_broadcast(spark, written):
    at = {f.name: [] if f.name in ("hypotheses", "variants") else None for f in written.schema} | {"word_id": "w", "lemma": "a", "language": "it", "path": []}
    rows = [at, at | {"path": [0], "parent_path": [], "lemma": "b", "language": "la"}]
    nodes = H.materialize(spark.createDataFrame([tuple(r[f.name] for f in written.schema) for r in rows], written.schema), "nodes")
    named = spark.createDataFrame([("a", 0, [("b", "la")]), ("a", 1, [("b", "la")]), ("b", 0, [("b", "la")])], "title string, steps int, hypotheses array<struct<lemma: string, language: string>>")
    drawn = C.proposals_drawn(nodes, H.materialize(named, "named"))
    assert [(r.word_id, r.parent, r.lemma) for r in drawn.collect()] == [("w", "a", "b")]
    plan = final_plan(drawn)
    assert plan.count("SortMergeJoin [") == 2 and "Broadcast" not in plan


def test_pages_of_a_walk_are_not_broadcast(spark, engine, monkeypatch):
    plans, write = [], H.materialize

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(H, "materialize", noted)
    walked = engine.walk(words(spark, *PAGES))
    plans.append(walked._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin [title" in p for p in plans) > 2
    assert not any(re.search(r"BroadcastHashJoin \[(word_id#\d+, )?title", p) for p in plans)


CODES = ["it", "la", "la-med", "grc", "de-AT", "qxx", "ine-pro", "ar", "", "roa-oca,oc-pro"]
LEMMAS = ["labōs", "*bʰer-", "ōrātiō", "قَهْوَة", "πλᾰτεῖᾰ", "", "Ǖx", "ăĕ"]


def test_language_columns(spark):
    df = spark.createDataFrame([(c, x) for c in CODES for x in LEMMAS], "code string, lemma string")
    code, lemma = F.col("code"), F.col("lemma")
    for r in df.select("code", "lemma", L.language_name_col(code).alias("n"), L.section_name_col(code).alias("s"), L.page_title_col(lemma, code).alias("t"), L.fallback_col(code).alias("f")).collect():
        assert (r.n, r.s, r.f) == (L.language_name(r.code), L.section_name(r.code), L.fallback(r.code))
        if r.code != "grc" or r.lemma != "πλᾰτεῖᾰ":
            assert r.t == L.page_title(r.lemma, r.code)
    assert L.page_title("*ḱel-", "ine-pro") == "Reconstruction:Proto-Indo-European/ḱel-"
    assert L.page_title("πλᾰτεῖᾰ", "grc") == "πλατεῖα"
    assert L.impossible_order("de", "lng") and not L.impossible_order("la", "it") and not L.impossible_order("de", "vec,it")
    assert L.spelling_keys("*ḱḗr ~ *ḱr̥d-") == {"ker", "krd-"}
    assert V.templates_df(spark).count() > 200 and V.relations_df(spark).count() == 26


# --- sources ---------------------------------------------------------------


def test_answers():
    assert P.read_answer({"parse": {"wikitext": "x"}}) == "x"
    assert P.read_answer({"parse": {"wikitext": 3}}) is None
    assert P.read_answer({"error": {"code": "missingtitle"}}) is None
    for bad in ([], "x", {"error": "busy"}, {"error": {"code": "other"}}, {"warnings": 1}, {"parse": {}}):
        with pytest.raises(P.SourceError):
            P.read_answer(bad)


class Response(io.BytesIO):
    def __init__(self, body, headers=()):
        super().__init__(body)
        self.headers = dict(headers)


def client(*replies, **options):
    waits, replies, now = [], list(replies), [0.0]

    def opener(request, timeout):
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    def sleep(s):
        waits.append(s)
        now[0] += s

    return P.Client("http://wiki.example/api", opener=opener, sleep=sleep, clock=lambda: now[0], **options), waits


def http(code, **headers):
    return urllib.error.HTTPError("u", code, "m", headers, None)


GOOD = json.dumps({"parse": {"wikitext": "è"}}).encode()


def test_client_retries():
    c, waits = client(http(503), http(429, **{"Retry-After": "7"}), Response(gzip.compress(GOOD), {"Content-Encoding": "gzip"}))
    assert c.wikitext("t") == "è" and c.requests_made == 3
    assert [w for w in waits if w >= 1] == [2.0, 7.0]
    c, _ = client(http(404))
    with pytest.raises(P.SourceError):
        c.wikitext("t")
    c, waits = client(*[OSError("x")] * 4)
    with pytest.raises(P.SourceError):
        c.wikitext("t")
    assert [w for w in waits if w >= 1] == [2.0, 4.0, 8.0]
    c, _ = client(Response(b"\xff"), Response(GOOD))
    assert c.wikitext("t") == "è"
    c, waits = client(Response(GOOD), Response(GOOD))
    c.wikitext("a"), c.wikitext("b")
    assert waits == [0.5]


def test_dump_and_files(spark, tmp_path):
    xml = tmp_path / "dump.xml"
    xml.write_text("<mediawiki><page><title>a</title><ns>0</ns><revision><text>==Latin==</text></revision></page><page><title>b</title><ns>0</ns><redirect title=\"a\"/><revision><text>#R</text></revision></page></mediawiki>")
    assert {r.title: r.wikitext for r in P.from_dump(spark, str(xml)).collect()} == {"a": "==Latin==", "b": "==Latin=="}
    P.from_dict(spark, PAGES).write.parquet(str(tmp_path / "p"))
    got = P.from_files(spark, str(tmp_path / "p")).collect()
    assert {r.title: r.found for r in got} == {t: w is not None for t, w in PAGES.items()}


def test_cache(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "c"), ttl_days=30)
    assert cache.stats() == (0, 0.0) and cache.read().count() == 0
    asked = []

    def fetch(titles):
        asked.append(sorted(r.title for r in titles.collect()))
        status = F.when(F.col("title") == "no", "absent").when(F.col("title") == "bad", "error").otherwise("found")
        return titles.select("title", status.alias("status"), F.when(status == "found", F.col("title")).alias("wikitext"))

    titles = spark.createDataFrame([("a",), ("a",), ("no",), ("bad",), (None,)], "title string")
    assert {r.title: r.found for r in cache.get(titles, fetch).collect()} == {"a": True, "no": False}
    cache.get(titles, fetch)
    assert asked == [["a", "bad", "no"], ["bad"]]  # an absence is remembered, an error is not
    old = spark.createDataFrame([("old", "x", True, dt.datetime(2000, 1, 1))], P.PAGES)
    cache.store(old)
    assert cache.stats()[0] == 3 and cache.prune()[0] == 1 and cache.stats()[0] == 2
    newer = spark.createDataFrame([("a", "new", True, dt.datetime(2100, 1, 1))], P.PAGES)
    cache.store(newer)
    assert {r.title: r.wikitext for r in cache.read().collect()}["a"] == "new"
    assert cache.clear()[0] and cache.clear()[0] and cache.stats() == (0, 0.0)
    os.makedirs(tmp_path / "c/v1")
    (tmp_path / "c/v1/part-0.parquet").write_text("not parquet")
    with pytest.warns(UserWarning):
        assert cache.read().count() == 0
    assert cache_module.default_path().endswith("stemma/pages")


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def change(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"title": t, "wikitext": w, "fetched_at": at}) for t, w, at in rows))

    cache = PageCache(spark, str(tmp_path / "c"))

    def run():
        q = ingest.follow(ingest.changes(spark, str(source)), cache, str(tmp_path / "read"), str(tmp_path / "state"))
        q.awaitTermination(120)

    change("a.json", ("x", entry("Italian", "From {{inh|it|la|y}}."), "2024-01-01T00:00:00Z"), ("y", entry("Latin", "{{unk|la}}"), "2024-01-01T00:00:00Z"))
    run()
    change("b.json", ("y", entry("Latin", "From {{der|la|grc|z}}."), "2024-01-02T00:00:00Z"))
    run()
    assert cache.stats()[0] == 2
    read = ingest.current(spark, str(tmp_path / "read"))
    walked = H.histories(cache.read(), words(spark, "x"), read=read).collect()[0]
    assert [n.lemma for n in walked.nodes] == ["x", "y", "z"]
    assert ingest.activity(cache.read().select("title", "fetched_at")).agg(F.sum("changes")).first()[0] == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = str(tmp_path / "p")
    P.from_dict(spark, PAGES).write.parquet(path)

    def run(*argv):
        code = cli.main([*argv, "--pages", path], spark)
        return code, capsys.readouterr()

    code, out = run("fuochi")
    assert code == 0 and out.out.startswith("fuochi (it) — plural of «fuoco»")
    code, out = run("fuoco", "--json")
    assert code == 0 and json.loads(out.out)["steps"] == 2
    code, out = run("none", "-c")
    assert code == 3 and out.out == "" and "«none»" in out.err
    code, out = run("none", "-j")
    assert code == 3 and json.loads(out.out)["tree"]["terminal"]["type"] == "entry_missing"
    assert run("fuoco", "-d", "0")[0] == run("fuoco", "-l", "qxx")[0] == run("fuoco", "--cache-ttl", "-1")[0] == 1
    assert cli.main([], spark) == 1
    assert run("fuoco", "--senses")[0] == 0
    assert cli.main(["--cache-stats", "--cache", str(tmp_path / "c")], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["x", "-c", "-j"], spark)
    monkeypatch.setattr("sys.stdin", io.StringIO("capo\n:l la\nfocus\n:q\nnever\n"))
    code, out = run()
    assert "capo (it)" in out.out and "focus (la)" in out.out and "never" not in out.out


def test_sql_surface(spark, engine):
    engine.register()
    got = spark.sql("SELECT title, parse_etymology('From {{inh|it|la|x}}.', 'it') AS a FROM wiki_pages WHERE title = 'capo'").first()
    assert json.loads(got.a)["steps"][0][0] == "INHERITED"
    with pytest.raises(ValueError):
        Engine(spark, PAGES, max_depth=0)
