"""The operators' queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm.chat import SQL as CHAT_SQL
from alertmill.llm.common import table
from alertmill.llm.filteraudit import SQL as AUDIT_SQL


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer_path())


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.suffixes import digest, repeats

    return digest(repeats(table(spark, sf_dir, "documents")))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.linededup import digest, without_lines

    return digest(without_lines(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.maintext import extract

    return extract(table(spark, sf_dir, "pages"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alertmill.llm.filteraudit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_neardup": op2_neardup,
    "op3_packing": op3_packing,
    "op4_ann": op4_ann,
    "op5_chat": op5_chat,
    "op6_decontam": op6_decontam,
    "op7_repeats": op7_repeats,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_html": op12_html,
    "op13_filters": op13_filters,
}

ORACLE_SQL: dict[str, str] = {"op5_chat": CHAT_SQL, "op13_filters": AUDIT_SQL}
