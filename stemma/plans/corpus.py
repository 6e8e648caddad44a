"""Wiki pages made of the relational tables, so that joins on those tables tell what the engine must find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text(template: str, **columns: Column | str) -> Column:
    """A template with @name@ places filled by columns."""
    parts: list[Column] = []
    for k, piece in enumerate(template.split("@")):
        if k % 2:
            c = columns[piece]
            parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def entry(language: str, etymology: str, **columns: Column | str) -> Column:
    return text(f"=={language}==\n\n===Etymology===\n{etymology}\n\n===Noun===\n{{{{head}}}}\n", **columns)


def definition(language: str, lines: str, **columns: Column | str) -> Column:
    return text(f"=={language}==\n\n===Noun===\n{{{{head}}}}\n\n{lines}\n", **columns)


def page(df: DataFrame, title: Column, wikitext: Column) -> DataFrame:
    return df.select(title.alias("title"), wikitext.alias("wikitext"))


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def union(*pages: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, pages)


def customers(spark: SparkSession, sf_dir: str, etymology: str = "From {{inh|it|la|n@n@}}.", prefix: str = "c") -> DataFrame:
    """A page for each customer that names its nation; ``@c@`` and ``@n@`` are the keys."""
    df = table(spark, sf_dir, "customer")
    return page(df, key(prefix, "c_custkey"), entry("Italian", etymology, c="c_custkey", n="c_nationkey"))


def nations(spark: SparkSession, sf_dir: str, even_only: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    if even_only:
        df = df.where("n_nationkey % 2 = 0")
    return page(df, key("n", "n_nationkey"), entry("Latin", "From {{der|la|grc|r@r@}}.", r="n_regionkey"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "region"), key("r", "r_regionkey"), entry("Ancient Greek", "Of uncertain origin."))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union(customers(spark, sf_dir), nations(spark, sf_dir), regions(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order that only points to its customer's word."""
    df = table(spark, sf_dir, "orders")
    return page(df, key("o", "o_orderkey"), definition("Italian", "# {{plural of|it|c@c@}}", c="o_custkey"))


def parts(spark: SparkSession, sf_dir: str, etymology: str = "{{af|en|@a@|@b@}}", language: str = "English") -> DataFrame:
    df = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return page(df, key("p", "p_partkey"), entry(language, etymology, a=words[0], b=words[1], k="p_partkey"))


def suppliers(spark: SparkSession, sf_dir: str, etymology: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier")
    return page(df, key("s", "s_suppkey"), entry("Italian", etymology, s="s_suppkey", n="s_nationkey"))


def homographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with an etymology for every status that its orders have."""
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    block = F.transform("s", lambda x, i: F.concat(F.lit("===Etymology "), (i + 1).cast("string"), F.lit("===\nFrom {{inh|it|la|"), x, F.lit("}}.\n\n====Noun====\n{{head}}\n\n# sense "), x, F.lit("\n\n")))
    return page(df, key("h", "o_custkey"), F.concat(F.lit("==Italian==\n\n"), F.array_join(block, "")))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer whose definition lines point to the status of every order."""
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderstatus")).alias("s"))
    lines = F.array_join(F.transform("s", lambda x: F.concat(F.lit("# {{plural of|it|"), x, F.lit("}}"))), "\n")
    return page(df, key("u", "o_custkey"), F.concat(F.lit("==Italian==\n\n===Noun===\n{{head}}\n\n"), lines, F.lit("\n")))
