"""A corpus pipeline over ``documents``: five stages, each on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import distilled, forget, numbered, read_table, stage
from waybill.llm.exact_dedup import exact_dedup
from waybill.llm.language_id import identify_documents
from waybill.llm.mixing import mix
from waybill.llm.ngram_join import ngram_join
from waybill.llm.packing import pack
from waybill.llm.queries import word_vocabulary

#: Packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

# In every stage nulls in any column, empty and very long texts are judged as
# the stage's operator says; repeated rows are rows of their own; without rows
# the result is empty; columns of any name pass through.


def _numbered(docs: DataFrame) -> DataFrame:
    """Each document whole in ``doc``, whatever its columns' names, with a key of its own in ``row``."""
    return numbered(docs, F.struct("*").alias("doc"))


def _columns(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("row", *[F.col(f"doc.{n}").alias(n) for n in names])


def _without(rows: DataFrame, name: str, gone) -> DataFrame:
    """The documents whose row isn't in what ``gone`` makes; that is written first, so that its size decides the join."""
    return rows.join(distilled(rows.sparkSession, name, lambda: gone().select("row")), "row", "left_anti").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; see ``language_id``.

    A document without letters goes; a null lang or source is evidence for nothing.
    """
    rows = _numbered(docs)
    return _without(rows, "rejected", lambda: identify_documents(_columns(rows, "doc_id", "text", "lang", "source"), key="row").where("not kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text up to white space, that of the least doc_id; see ``exact_dedup``.

    Of rows with one doc_id and text one stays; a null doc_id ranks last; null and empty texts are equal.
    """
    rows = _numbered(docs)
    return _without(rows, "copies", lambda: exact_dedup(_columns(rows, "doc_id", "text"), key="row").where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies; see ``ngram_join``.

    Documents without words are no one's copies and stay; a null doc_id ranks last.
    """
    rows = _numbered(docs)
    return _without(rows, "near_copies", lambda: ngram_join(_columns(rows, "doc_id", "text"), key="row").where("row <> component_row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; see ``mix``.

    A null source is a source of its own; documents without words have size 0 and go along with their source's fraction.
    """
    rows = _numbered(docs)
    times = distilled(spark, "times", lambda: mix(_columns(rows, "doc_id", "text", "source"), key="row").where("times > 0").select("row", "times"))
    taken = rows.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_time"))
    return taken.select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents in sequences of 4096 tokens; see ``pack``.

    A null or empty text is the end id alone; repeated rows are packed each.
    """
    return pack(_columns(_numbered(docs), "doc_id", "text"), word_vocabulary(), key="row").drop("row")


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        last, docs = docs, stage(function(spark, docs, sf_dir), name)
        if hasattr(last, "_staged"):
            forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
