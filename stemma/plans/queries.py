"""Queries over the tables, each with the SQL that finds the same by plain joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import vocab as V
from ..operators import checks as C
from ..operators import histories as H
from ..operators import sections as S
from ..sources import cache
from ..sources.pages import answers
from . import corpus as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- sections and templates ------------------------------------------------


@query("""SELECT 'c' || c_custkey AS title, v.ord, v.level, v.heading FROM customer,
(VALUES (0, 2, 'Italian'), (1, 3, 'Etymology'), (2, 3, 'Noun')) v(ord, level, heading)""")
def headings_scan(spark, sf):
    return S.headings(K.customers(spark, sf))


@query("""SELECT 'c' || c_custkey AS title, v.ord, v.level, v.heading, (v.size + v.k * length('' || c_nationkey))::INT AS size FROM customer,
(VALUES (0, 2, 'Italian', 61, 1), (1, 3, 'Etymology', 24, 1), (2, 3, 'Noun', 10, 0)) v(ord, level, heading, size, k)""")
def section_bodies(spark, sf):
    return S.sections(K.customers(spark, sf)).select("title", "ord", "level", "heading", F.length("body").alias("size"))


@query("SELECT 'n' || n_nationkey AS title FROM nation")
def language_section(spark, sf):
    return S.language_sections(K.geography(spark, sf), "la").select("title")


@query("""SELECT 'h' || o_custkey AS title, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1)::INT AS ord,
'Etymology ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS label,
'From {{inh|it|la|' || o_orderstatus || '}}.' AS text
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)""")
def etymology_sections(spark, sf):
    return S.etymology_sections(S.language_sections(K.homographs(spark, sf), "it"))


@query("SELECT 'o' || o_orderkey AS title, 0 AS ord, '{{plural of|it|c' || o_custkey || '}}' AS line FROM orders")
def definition_lines(spark, sf):
    return S.definition_lines(K.orders(spark, sf))


@query("""SELECT 'p' || p_partkey AS title, 'af' AS name, v.key, CASE v.key WHEN '1' THEN 'en' WHEN '2' THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS value
FROM part, (VALUES ('1'), ('2'), ('3')) v(key)""")
def template_extract(spark, sf):
    found = S.extract_templates(K.parts(spark, sf), "wikitext").where("name = 'af'")
    return found.select("title", "name", F.explode("params").alias("p")).select("title", "name", "p.key", "p.value")


@query("SELECT value AS relation, count(*) AS names FROM (VALUES {}) v(name, value) GROUP BY 1".format(", ".join(f"('{n}', '{v}')" for n, v in V.LINEAR.items())))
def template_vocabulary(spark, sf):
    return V.templates_df(spark).where("class = 'linear'").groupBy(F.col("value").alias("relation")).agg(F.count(F.lit(1)).alias("names"))


# --- the parser ------------------------------------------------------------


def _steps(pages: DataFrame, code: str = "it") -> DataFrame:
    return S.steps(S.read_pages(pages), code)


def _analyses(pages: DataFrame, code: str = "it") -> DataFrame:
    return S.analyses(S.read_pages(pages), code)


def _hypotheses(pages: DataFrame) -> DataFrame:
    return _analyses(pages).select("title", "steps", F.posexplode("hypotheses").alias("place", "h")).select("title", "steps", "place", "h.lemma", "h.language", "h.attribution")


@query("SELECT 'c' || c_custkey AS title, 'INHERITED' AS relation, 'n' || c_nationkey AS lemma, 'la' AS language FROM customer")
def linear_relations(spark, sf):
    return _steps(K.customers(spark, sf)).select("title", "relation", "lemma", "language")


@query("""SELECT 'p' || p_partkey AS title, 'AFFIXATION' AS relation, v.place, split_part(p_name, ' ', v.place + 1) AS lemma, 'en' AS language
FROM part, (VALUES (0), (1)) v(place)""")
def word_formation(spark, sf):
    return _steps(K.parts(spark, sf), "en").select("title", "relation", "place", "lemma", "language")


@query("""SELECT 's' || s_suppkey AS title, v.ord, v.relation, CASE v.ord WHEN 0 THEN 'n' || s_nationkey ELSE 'x' || s_suppkey END AS lemma, v.language
FROM supplier, (VALUES (0, 'BORROWED', 'la'), (1, 'DERIVED', 'grc')) v(ord, relation, language)""")
def structured_ety(spark, sf):
    return _steps(K.suppliers(spark, sf, "{{ety|it|:bor|la:n@n@<t:people>|:der|grc:x@s@}}")).select("title", "ord", "relation", "lemma", "language")


@query("SELECT 's' || s_suppkey AS title, 'n' || s_nationkey AS lemma, true AS distant FROM supplier")
def connectives(spark, sf):
    return _steps(K.suppliers(spark, sf, "Ultimately from {{der|it|la|n@n@}}.")).select("title", "lemma", "distant")


@query("""SELECT 's' || s_suppkey AS title, v.ord, CASE v.ord WHEN 0 THEN 'x' || s_suppkey ELSE 'n' || s_nationkey END AS lemma
FROM supplier, (VALUES (0), (1)) v(ord)""")
def via_order(spark, sf):
    return _steps(K.suppliers(spark, sf, "From {{der|it|ar|n@n@}} via {{bor|it|es|x@s@}}.")).select("title", "ord", "lemma")


@query("""SELECT 's' || s_suppkey AS title, 0 AS steps, v.place, CASE v.place WHEN 0 THEN 'n' || s_nationkey ELSE 'x' || s_suppkey END AS lemma, v.language, v.attribution
FROM supplier, (VALUES (0, 'la', 'Possibly'), (1, 'fr', NULL)) v(place, language, attribution)""")
def conditioning(spark, sf):
    return _hypotheses(K.suppliers(spark, sf, "Possibly {{bor|it|la|n@n@}} or {{bor|it|fr|x@s@}}."))


@query("""SELECT 'p' || p_partkey AS title, v.place, CASE v.place WHEN 2 THEN 'p' || p_partkey ELSE split_part(p_name, ' ', v.place + 1) END AS lemma
FROM part, (VALUES (0), (1), (2)) v(place)""")
def alternation_demote(spark, sf):
    return _hypotheses(K.parts(spark, sf, "From {{af|it|@a@|@b@}} or from {{inh|it|la|p@k@}}.", "Italian")).where("steps = 0").select("title", "place", "lemma")


@query("SELECT 'p' || p_partkey AS title, 0 AS ord, v.place, split_part(p_name, ' ', v.place + 1) AS lemma FROM part, (VALUES (0), (1)) v(place)")
def composition_plus(spark, sf):
    return _steps(K.parts(spark, sf, "{{der|it|grc|@a@}} + {{der|it|grc|@b@}}", "Italian")).select("title", "ord", "place", "lemma")


@query("SELECT 's' || s_suppkey AS title, 'n' || s_nationkey AS lemma, 'la' AS language FROM supplier")
def dash_promotion(spark, sf):
    return _steps(K.suppliers(spark, sf, "From the {{der|it|la|-}} name, {{m|la|n@n@}}. Cognate with {{cog|fr|x@s@}}.")).select("title", "lemma", "language")


@query("SELECT 'p' || p_partkey AS title, 1 AS steps, 'synchronically analysable as «' || split_part(p_name, ' ', 1) || '», «' || split_part(p_name, ' ', 2) || '»' AS note FROM part")
def synchronic_notes(spark, sf):
    pages = K.parts(spark, sf, "From {{inh|it|la|p@k@}}. By surface analysis, {{af|it|@a@|@b@}}.", "Italian")
    return _analyses(pages).select("title", "steps", F.explode("notes").alias("note"))


@query("""SELECT 's' || s_suppkey AS title, 'n' || s_nationkey AS lemma, 'Some connect this with' AS attribution FROM supplier""")
def discussion_hypotheses(spark, sf):
    pages = K.suppliers(spark, sf, "Of unknown origin.\n* Some connect this with {{der|it|la|n@n@}}.\n* Compare {{der|it|fr|x@s@}}.")
    return _hypotheses(pages).select("title", "lemma", "attribution")


@query("SELECT 'r' || r_regionkey AS title, true AS uncertain, 0 AS steps FROM region")
def uncertainty(spark, sf):
    return _analyses(K.regions(spark, sf), "grc").select("title", "uncertain", "steps")


@query("""SELECT 's' || s_suppkey AS title, 'n' || s_nationkey AS root, 0 AS steps, 'n' || s_nationkey AS text FROM supplier""")
def ultimate_roots(spark, sf):
    return _analyses(K.suppliers(spark, sf, "{{root|it|ine-pro|n@n@}}")).select("title", "root", "steps", "text")


@query("SELECT 'p' || p_partkey AS title, v.note FROM part, LATERAL (SELECT unnest(['doublet of «' || split_part(p_name, ' ', 1) || '»', 'named after ' || split_part(p_name, ' ', 2)]) AS note) v")
def remark_notes(spark, sf):
    return _analyses(K.parts(spark, sf, "{{doublet|it|@a@}}. {{named after|it|@b@}}", "Italian")).select("title", F.explode("notes").alias("note"))


_MARKED = [("{{unk|it}}", "UNCERTAIN_ORIGIN"), ("{{onom|it}}", "IMITATIVE"), ("{{named-after|it|X}}", "EPONYM"), ("{{rfe|it}}", "ETYMOLOGY_MISSING"), ("{{nonlemma|it}}", "ETYMOLOGY_MISSING"), ("A word of the sea.", "NOT_INTERPRETED")]


@query("SELECT 'p' || p_partkey AS word_id, CASE p_partkey % 6 {} END AS terminal FROM part".format(" ".join(f"WHEN {k} THEN '{t}'" for k, (_, t) in enumerate(_MARKED))))
def marker_terminals(spark, sf):
    df = K.table(spark, sf, "part")
    told = F.element_at(F.array(*[F.lit(x) for x, _ in _MARKED]), (F.col("p_partkey") % 6 + 1).cast("int"))
    pages = K.page(df, K.key("p", "p_partkey"), K.entry("Italian", "@x@", x=told))
    return H.nodes(_walk(pages, pages)).select("word_id", "terminal")


# --- languages -------------------------------------------------------------

_CODES = ["it", "la-med", "de-AT", "qxx", "ine-pro", ""]
_NAMES = ["Italian", "Medieval Latin", "German (de-AT)", "qxx", "Proto-Indo-European", "unspecified language"]


def _code(column: str):
    return F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col(column) % 6 + 1).cast("int"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 {} END AS name FROM nation".format(" ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES))))
def language_dim(spark, sf):
    return K.table(spark, sf, "nation").select("n_nationkey", L.language_name_col(_code("n_nationkey")).alias("name"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ā' || c_custkey WHEN 1 THEN 'a' || c_custkey WHEN 2 THEN 'Reconstruction:Proto-Indo-European/ā' || c_custkey
ELSE 'Reconstruction:Latin/a' || c_custkey END AS title FROM customer""")
def page_title(spark, sf):
    kind = F.col("c_custkey") % 4
    lemma = F.concat(F.when(kind == 3, "*ā").otherwise("ā"), F.col("c_custkey").cast("string"))
    code = F.when(kind == 0, "it").when(kind == 2, "ine-pro").otherwise("la")
    return K.table(spark, sf, "customer").select("c_custkey", L.page_title_col(lemma, code).alias("title"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ē' WHEN 1 THEN 'e' ELSE 'ق' END || c_custkey AS lemma FROM customer")
def normalize_lemma(spark, sf):
    kind = F.col("c_custkey") % 3
    lemma = F.concat(F.when(kind == 2, "قَ").otherwise("ē"), F.col("c_custkey").cast("string"))
    return K.table(spark, sf, "customer").select("c_custkey", L.normalize_lemma_col(lemma, F.when(kind == 0, "it").when(kind == 1, "la").otherwise("ar")).alias("lemma"))


@query("WITH s(code, a, b) AS (VALUES {}) SELECT x.code AS ancestor, y.code AS descendant FROM s x, s y WHERE x.a > y.b".format(", ".join(f"('{c}', {a}, {b})" for c, (a, b) in V.SPANS.items())))
def impossible_order_pairs(spark, sf):
    return L.impossible_pairs(V.languages_df(spark))


@query("SELECT name, label, name NOT IN ('DERIVED', 'ROOT') AS implies_contiguity FROM (VALUES {}) v(name, label)".format(", ".join(f"('{n}', '{r[0]}')" for n, r in V.RELATIONS.items())))
def relation_dim(spark, sf):
    return V.relations_df(spark).select("name", "label", "implies_contiguity")


# --- definition lines ------------------------------------------------------


@query("SELECT 'o' || o_orderkey AS title, 'POINTER' AS kind, 'plural of' AS wording, 'noun' AS part_of_speech, 'c' || o_custkey AS target, 'it' AS target_language FROM orders")
def definition_statements(spark, sf):
    return S.statements(S.read_pages(K.orders(spark, sf)), "it").select("title", "kind", "wording", "part_of_speech", "target", "target_language")


@query("SELECT p_partkey, 'p' || p_partkey AS target FROM part WHERE p_partkey % 3 <> 0")
def target_shape(spark, sf):
    """Of a phrase, a word and a word with variants, the first gives no pointer."""
    df = K.table(spark, sf, "part")
    aim = F.when(F.col("p_partkey") % 3 == 0, F.concat(K.key("p", "p_partkey"), F.lit(" x"))).when(F.col("p_partkey") % 3 == 1, K.key("p", "p_partkey")).otherwise(F.concat(K.key("p", "p_partkey"), F.lit(", y")))
    pages = K.page(df, F.col("p_partkey").cast("string"), K.definition("Italian", "# {{abbreviation of|it|@x@}}", x=aim))
    return S.statements(S.read_pages(pages), "it").select(F.col("title").cast("long").alias("p_partkey"), "target")


@query("SELECT DISTINCT 'u' || o_custkey AS title, o_orderstatus AS target FROM orders")
def distinct_targets(spark, sf):
    found = S.statements(S.read_pages(K.pointers(spark, sf)), "it").where("kind = 'POINTER'")
    return found.groupBy("title", "target", "target_language").agg(F.min("ord").alias("ord")).select("title", "target")


@query("""SELECT 'h' || o_custkey AS word_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)::INT AS sense, 'noun' AS part_of_speech,
'sense ' || o_orderstatus AS definition, o_orderstatus AS ancestor, true AS carries_etymology FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)""")
def senses_list(spark, sf):
    pages = K.homographs(spark, sf)
    words = pages.select(F.col("title").alias("word_id"), F.col("title").alias("lemma"))
    return H.senses(S.read_pages(pages), words).select("word_id", "sense", "part_of_speech", "definition", "ancestor", "carries_etymology")


# --- walks -----------------------------------------------------------------


def _walk(pages: DataFrame, roots: DataFrame, **options) -> DataFrame:
    words = roots.select(F.col("title").alias("word_id"), F.col("title").alias("lemma"))
    return H.histories(pages, words, **options)


def _geography(spark, sf, **options) -> DataFrame:
    return _walk(K.geography(spark, sf), K.customers(spark, sf), **options)


@query("""SELECT 'c' || c_custkey AS word_id, 0 AS depth, 'c' || c_custkey AS lemma, 'it' AS language, NULL AS relation, NULL AS terminal FROM customer
UNION ALL SELECT 'c' || c_custkey, 1, 'n' || c_nationkey, 'la', 'INHERITED', NULL FROM customer
UNION ALL SELECT 'c' || c_custkey, 2, 'r' || n_regionkey, 'grc', 'DERIVED', 'UNCERTAIN_ORIGIN' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def walk_nodes(spark, sf):
    return H.nodes(_geography(spark, sf)).select("word_id", "depth", "lemma", "language", "relation", "terminal")


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
t(word_id, lemma, depth) AS (SELECT child, child, 0 FROM e WHERE child LIKE 'c%' UNION ALL SELECT word_id, parent, depth + 1 FROM t JOIN e ON child = lemma)
SELECT word_id, lemma, depth FROM t""")
def recursive_reachability(spark, sf):
    """All ancestors by a recursive query over the parsed links."""
    read = H.materialize(S.read_pages(K.geography(spark, sf)), "read")
    links = S.steps(read, "it").unionAll(S.steps(read, "la")).where("lemma <> ''")
    return spark.sql(
        """WITH RECURSIVE t(word_id, lemma, depth) MAX RECURSION LEVEL 20 AS (
             SELECT DISTINCT title, title, 0 FROM {links} WHERE title LIKE 'c%'
             UNION ALL SELECT t.word_id, l.lemma, t.depth + 1 FROM t JOIN {links} l ON l.title = t.lemma)
           SELECT * FROM t LIMIT ALL""",
        links=links,
    )


@query("SELECT 'c' || c_custkey AS word_id, 'c' || c_custkey || ' < n' || c_nationkey || ' < r' || n_regionkey AS chain FROM customer JOIN nation ON c_nationkey = n_nationkey")
def main_chain(spark, sf):
    rows = H.main_chains(H.nodes(_geography(spark, sf))).groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("depth", "lemma"))).alias("x"))
    return rows.select("word_id", F.array_join(F.transform("x", lambda y: y["lemma"]), " < ").alias("chain"))


@query("SELECT 'uncertain origin' AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def terminal_tally(spark, sf):
    return H.terminal_tally(H.nodes(_geography(spark, sf)), V.terminals_df(spark))


@query("SELECT 'c' || c_custkey AS word_id, 2 AS steps, 3::BIGINT AS nodes, 1::BIGINT AS skips FROM customer")
def depth_stats(spark, sf):
    return H.depths(H.nodes(_geography(spark, sf)))


@query("SELECT 'c' || c_custkey AS word_id, 'r' || n_regionkey AS lemma, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey")
def skip_links(spark, sf):
    return H.nodes(_geography(spark, sf)).where("skips_stages").select("word_id", "lemma", "depth")


@query("""SELECT 'a' || n_nationkey AS word_id, v.depth, v.p || n_nationkey AS lemma, v.terminal, CASE v.depth WHEN 1 THEN 'the entry points back to «a' || n_nationkey || '», already on this branch' END AS note
FROM nation, (VALUES (0, 'a', NULL), (1, 'b', 'CYCLE')) v(depth, p, terminal)""")
def cycle_detect(spark, sf):
    df = K.table(spark, sf, "nation")
    a = K.page(df, K.key("a", "n_nationkey"), K.entry("Italian", "From {{inh|it|it|b@n@}}.", n="n_nationkey"))
    b = K.page(df, K.key("b", "n_nationkey"), K.entry("Italian", "From {{inh|it|it|a@n@}}.", n="n_nationkey"))
    return H.nodes(_walk(K.union(a, b), a)).select("word_id", "depth", "lemma", "terminal", "note")


@query("""SELECT 'x' || n_nationkey AS word_id, v.place, v.terminal FROM nation,
(VALUES ('', NULL), ('0', NULL), ('0.0', 'ENTRY_MISSING'), ('1', NULL), ('1.0', 'ALREADY_SHOWN')) v(place, terminal)""")
def already_shown(spark, sf):
    df = K.table(spark, sf, "nation")
    x = K.page(df, K.key("x", "n_nationkey"), K.entry("Italian", "{{af|it|a@n@|b@n@}}", n="n_nationkey"))
    rest = [K.page(df, K.key(p, "n_nationkey"), K.entry("Italian", "From {{inh|it|la|t@n@}}.", n="n_nationkey")) for p in "ab"]
    return H.nodes(_walk(K.union(x, *rest), x)).select("word_id", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("place"), "terminal")


@query("""SELECT 'a' || n_nationkey AS word_id, v.depth, v.p || n_nationkey AS lemma, CASE WHEN v.depth = 3 THEN 'DEPTH_LIMIT' END AS terminal
FROM nation, (VALUES (0, 'a'), (1, 'b'), (2, 'd'), (3, 'e')) v(depth, p)""")
def depth_limit(spark, sf):
    df = K.table(spark, sf, "nation")
    pages = [K.page(df, K.key(p, "n_nationkey"), K.entry("Italian", f"From {{{{inh|it|it|{q}@n@}}}}.", n="n_nationkey")) for p, q in ("ab", "bd", "de", "ef", "fg")]
    return H.nodes(_walk(K.union(*pages), pages[0], max_depth=3)).select("word_id", "depth", "lemma", "terminal")


@query("""SELECT 'd' || c_custkey AS word_id, 1 AS depth, 'n' || n_nationkey AS lemma, CASE WHEN n_nationkey % 2 = 1 THEN 'no Wiktionary entry: continuing indirectly' END AS note FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'd' || c_custkey, 2, 'r' || n_regionkey, CASE WHEN n_nationkey % 2 = 1 THEN 'step reported by the entry «d' || c_custkey || '»' END FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def reserve_fallback(spark, sf):
    """Where the nation's page is missing, the customer's own entry names the region."""
    df = K.table(spark, sf, "customer").join(K.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    roots = K.page(df, K.key("d", "c_custkey"), K.entry("Italian", "From {{inh|it|la|n@n@}}, from {{der|it|grc|r@r@}}.", n="c_nationkey", r="n_regionkey"))
    walked = _walk(K.union(roots, K.nations(spark, sf, even_only=True), K.regions(spark, sf)), roots)
    return H.nodes(walked).where("depth > 0").select("word_id", "depth", "lemma", "note")


@query("""SELECT 'd' || c_custkey AS word_id, 'n' || n_nationkey AS lemma, 'the entry «d' || c_custkey || '» places «q' || c_custkey || '» at this point, which this entry does not' AS note
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def reconcile_notes(spark, sf):
    df = K.table(spark, sf, "customer").join(K.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = "From {{inh|it|la|n@n@}}, from {{der|it|grc|q@c@}}, from {{der|it|grc|r@r@}}."
    roots = K.page(df, K.key("d", "c_custkey"), K.entry("Italian", told, n="c_nationkey", r="n_regionkey", c="c_custkey"))
    return H.nodes(_walk(K.union(roots, K.nations(spark, sf), K.regions(spark, sf)), roots)).where("note IS NOT NULL").select("word_id", "lemma", "note")


@query("SELECT 'd' || c_custkey AS word_id, 'r' || (c_custkey % 5) AS lemma, 'the entry «d' || c_custkey || '» also gives «n' || c_nationkey || '», not reached here' AS note FROM customer")
def unspent_notes(spark, sf):
    df = K.table(spark, sf, "customer")
    roots = K.page(df, K.key("d", "c_custkey"), K.entry("Italian", "From {{inh|it|grc|r@r@}}, from {{der|it|grc|n@n@}}.", n="c_nationkey", r=F.col("c_custkey") % 5))
    return H.nodes(_walk(K.union(roots, K.regions(spark, sf)), roots)).where("note IS NOT NULL").select("word_id", "lemma", "note")


@query("SELECT 'c' || c_custkey AS word_id, 'n' || c_nationkey AS lemma, 'the entry does not separate Vulgar Latin: read under Latin' AS note FROM customer JOIN nation ON c_nationkey = n_nationkey")
def section_fallback(spark, sf):
    roots = K.customers(spark, sf, "From {{inh|it|la-vul|n@n@}}.")
    return H.nodes(_walk(K.union(roots, K.nations(spark, sf), K.regions(spark, sf)), roots)).where("language = 'la-vul'").select("word_id", "lemma", "note")


@query("SELECT 'c' || c_custkey AS word_id, 'zz' || c_custkey AS lemma, 'read under the spelling «n' || c_nationkey || '»' AS note FROM customer JOIN nation ON c_nationkey = n_nationkey")
def spelling_variants(spark, sf):
    roots = K.customers(spark, sf, "From {{inh|it|la|zz@c@, n@n@}}.")
    return H.nodes(_walk(K.union(roots, K.nations(spark, sf), K.regions(spark, sf)), roots)).where("language = 'la'").select("word_id", "lemma", "note")


@query("""SELECT 's' || s_suppkey AS word_id, 'k' || s_suppkey AS lemma, 'Bank' || s_suppkey AS proposed,
'the entry gives German as the ancestor of Lombardic, which is later: not drawn as a link' AS attribution FROM supplier""")
def chronology_demotion(spark, sf):
    roots = K.suppliers(spark, sf, "From {{bor|it|lng|k@s@}}.")
    df = K.table(spark, sf, "supplier")
    above = K.page(df, K.key("k", "s_suppkey"), K.entry("Lombardic", "From {{der|lng|de|Bank@s@}}.", s="s_suppkey"))
    rows = H.nodes(_walk(K.union(roots, above), roots)).select("word_id", "lemma", F.explode("hypotheses").alias("h"))
    return rows.select("word_id", "lemma", F.col("h.lemma").alias("proposed"), F.col("h.attribution").alias("attribution"))


@query("SELECT 'o' || o_orderkey AS word_id, 'c' || o_custkey AS start_lemma, 'plural of «c' || o_custkey || '»' AS resolution FROM orders")
def pointer_resolution(spark, sf):
    return _walk(K.union(K.orders(spark, sf), K.geography(spark, sf)), K.orders(spark, sf)).select("word_id", "start_lemma", "resolution")


@query("SELECT 'u' || o_custkey AS word_id, count(DISTINCT o_orderstatus)::INT AS options, min(o_orderstatus) AS start_lemma FROM orders GROUP BY o_custkey")
def pointer_ambiguity(spark, sf):
    pages = K.pointers(spark, sf)
    return _walk(pages, pages).select("word_id", F.size("options").alias("options"), "start_lemma")


@query("SELECT 'p' || p_partkey AS word_id, 'DATA_EXHAUSTED' AS terminal, 'formed with affixes from several elements (not followed)' AS note FROM part")
def no_compounds(spark, sf):
    pages = K.parts(spark, sf, "{{af|it|@a@|@b@}}", "Italian")
    return H.nodes(_walk(pages, pages, follow_compounds=False)).select("word_id", "terminal", "note")


@query("SELECT 'p' || p_partkey AS word_id, 1 AS depth, v.place, split_part(p_name, ' ', v.place + 1) AS lemma FROM part, (VALUES (0), (1)) v(place)")
def compound_branches(spark, sf):
    pages = K.parts(spark, sf, "{{af|it|@a@|@b@}}", "Italian")
    return H.nodes(_walk(pages, pages)).where("depth = 1").select("word_id", "depth", F.element_at("path", 1).alias("place"), "lemma")


@query("""SELECT 'c' || c_custkey AS word_id, 'c' || c_custkey AS word, '2' AS steps, 'n' || c_nationkey AS parent, 'inherited' AS relation, 'uncertain_origin' AS ends
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def json_tree(spark, sf):
    def at(path: str):
        return F.get_json_object("json", path)

    got = _geography(spark, sf, with_views=True)
    return got.select("word_id", at("$.word").alias("word"), at("$.steps").alias("steps"), at("$.tree.ancestors[0].lemma").alias("parent"), at("$.tree.ancestors[0].relation").alias("relation"), at("$.tree.ancestors[0].ancestors[0].terminal.type").alias("ends"))


@query("""SELECT 'c' || c_custkey AS word_id, 'c' || c_custkey || ' (it)' || chr(10) || '└─ inherited from Latin' || chr(10) || '   └─ n' || c_nationkey || ' (la)' || chr(10)
|| '      └─ derived from Ancient Greek' || chr(10) || '         └─ r' || n_regionkey || ' (grc)' || chr(10) || '            └─ ⊗ uncertain origin' || chr(10) || chr(10)
|| '2 steps · 1 link may skip stages · terminal: uncertain origin · 0 requests in 0.0s' AS tree FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def text_tree(spark, sf):
    return _geography(spark, sf, with_views=True).select("word_id", "tree")


@query("""SELECT 'c' || c_custkey AS word_id, 'c' || c_custkey || ' (it)' || chr(10) || '  ← n' || c_nationkey || ' (la)  inherited from Latin' || chr(10)
|| '  ← r' || n_regionkey || ' (grc)  derived from Ancient Greek' || chr(10) || '  ← ⊗ uncertain origin' || chr(10) || chr(10)
|| '2 steps · 1 link may skip stages · terminal: uncertain origin · 0 requests in 0.0s' AS chain FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def text_chain(spark, sf):
    return _geography(spark, sf, with_views=True).select("word_id", "chain")


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'silent' ELSE 'told' END AS kind, count(*) AS words, sum(CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS chain,
sum(CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS told, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS silent FROM customer GROUP BY 1""")
def coverage_metrics(spark, sf):
    df = K.table(spark, sf, "customer")
    kind = F.col("c_custkey") % 3
    text = F.when(kind == 0, K.definition("Italian", "# a thing")).when(kind == 1, K.entry("Italian", "From {{inh|it|la|n@n@}}.", n="c_nationkey")).otherwise(K.entry("Italian", "A word of the sea."))
    pages = K.page(df, K.key("c", "c_custkey"), text)
    walked = _walk(pages, pages).withColumn("kind", F.when(F.substring("word_id", 2, 20).cast("long") % 3 == 0, "silent").otherwise("told"))
    return H.coverage(walked, ["kind"]).where("kind IS NOT NULL").select("kind", "words", "chain", "told", "silent")


# --- invariants ------------------------------------------------------------


def _mixed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read pages, nodes, roots) of a corpus with chains, proposals, reserves and pointers."""
    roots = K.union(K.customers(spark, sf), K.suppliers(spark, sf, "Possibly {{bor|it|la|n@n@}} or {{bor|it|fr|x@s@}}."), K.parts(spark, sf, "{{af|it|@a@|la:n1|@b@}}", "Italian"))
    pages = K.union(roots, K.nations(spark, sf), K.regions(spark, sf))
    read = H.materialize(S.read_pages(pages), "mixed")
    return read, H.materialize(H.nodes(_walk(pages, roots, read=read)), "mixed-nodes"), roots


def _broken(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("broken"))


_NONE = "SELECT 0::BIGINT AS broken"


@query(_NONE)
def c1_markup(spark, sf):
    return _broken(C.markup_in_lemma(_mixed(spark, sf)[1]))


@query(_NONE)
def c2_colon(spark, sf):
    return _broken(C.colon_in_lemma(_mixed(spark, sf)[1]))


@query(_NONE)
def c3_chronology(spark, sf):
    return _broken(C.impossible_links(_mixed(spark, sf)[1], V.languages_df(spark)))


@query(_NONE)
def c4_proposals(spark, sf):
    read, nodes, _ = _mixed(spark, sf)
    return _broken(C.proposals_drawn(nodes, S.analyses(read, "it")))


@query(_NONE)
def c5_forms(spark, sf):
    read, nodes, roots = _mixed(spark, sf)
    named = S.steps(read, "it").where("lemma <> ''").join(roots.select("title"), "title").select(F.col("title").alias("word_id"), "lemma", "language")
    return _broken(C.forms_lost(nodes, named))


@query(_NONE)
def c6_findings(spark, sf):
    return _broken(C.unread_findings(_mixed(spark, sf)[1]))


@query(_NONE)
def c7_branches(spark, sf):
    return _broken(C.repeated_on_branch(_mixed(spark, sf)[1]))


# --- page tables -----------------------------------------------------------

def _fetched(spark, sf) -> DataFrame:
    """Events as fetches: one title per user, absent where the event's type is an error."""
    df = K.table(spark, sf, "events")
    return df.select(K.key("t", "user_id").alias("title"), F.when(F.col("event_id") % 5 > 0, K.key("", "event_id")).alias("wikitext"), (F.col("event_id") % 5 > 0).alias("found"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id")


@query("SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 5 * 86400")
def cache_ttl(spark, sf):
    rows = _fetched(spark, sf)
    now = rows.agg(F.max("fetched_at").alias("now"))  # one row
    return cache.fresh(rows.join(F.broadcast(now)), 5, F.col("now")).select("event_id")


@query("SELECT count(*) AS removed FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) > 5 * 86400")
def cache_prune(spark, sf):
    rows = _fetched(spark, sf)
    now = rows.agg(F.max("fetched_at").alias("now"))
    kept = cache.fresh(rows.join(F.broadcast(now)), 5, F.col("now")).select("event_id")
    return rows.join(kept, "event_id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))


@query("""SELECT title, wikitext FROM (SELECT 't' || user_id AS title, CASE WHEN event_id % 5 > 0 THEN '' || event_id END AS wikitext,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE WHEN event_id % 5 > 0 THEN '' || event_id END DESC NULLS LAST) AS k FROM events) WHERE k = 1""")
def cache_latest(spark, sf):
    return cache.latest(_fetched(spark, sf)).select("title", "wikitext")


@query("SELECT sum(CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END)::BIGINT AS found, sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS absent FROM events")
def negative_cache(spark, sf):
    return _fetched(spark, sf).agg(F.sum(F.col("found").cast("int")).alias("found"), F.sum((~F.col("found")).cast("int")).alias("absent"))


_ANSWERS = [('{"parse": {"wikitext": "x"}}', "found"), ('{"error": {"code": "missingtitle"}}', "absent"), ('{"error": "busy"}', "error"), ('{"warnings": 1}', "error"), ("[1]", "error"), ('{"error": {"code": "ratelimited"}}', "error")]


@query("SELECT 'p' || p_partkey AS title, CASE p_partkey % 6 {} END AS status FROM part".format(" ".join(f"WHEN {k} THEN '{s}'" for k, (_, s) in enumerate(_ANSWERS))))
def api_answers(spark, sf):
    body = F.element_at(F.array(*[F.lit(b) for b, _ in _ANSWERS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return answers(K.table(spark, sf, "part").select(K.key("p", "p_partkey").alias("title"), body.alias("body"))).select("title", "status")
