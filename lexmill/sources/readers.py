"""Scans and sinks: folders, JSON lines, question sets, XML reports, dictionaries, pages, keyed tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LINE_END, secret_name
from .markdown import outline

#: Endings of files that are read, with the kind of reader.
KINDS = {"md": "markdown", "py": "python", "txt": "text", "pdf": "pdf"}
MAX_FILE_BYTES = 2 * 1024**2


def folder(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, name, kind, size, mtime, sha256, text, note of the files below root, by path.

    Names that begin with a dot and excluded folders (compared without case)
    are skipped, as are endings without a reader. A file over the size cap, a
    secret's name or bytes that are no strict UTF-8 give a note in place of a
    text; NUL among the first 8,192 bytes means binary.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:(?://[^/]*)?", "")
    base = root.split("://")[-1].rstrip("/") + "/"
    rel = F.substring(path, F.instr(path, base) + len(base), F.length(path))
    named = files.withColumn("path", rel).withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("path").rlike(r"(^|/)\."))
    for x in excluded:
        low = F.lower("path")
        named = named.where(~((low == x.lower()) | low.startswith(x.lower() + "/")))
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv]), ending)
    typed = named.withColumn("kind", kind).where("kind is not null")
    data = F.col("content")
    note = (
        F.when(F.col("length") > MAX_FILE_BYTES, "too large")
        .when((F.col("kind") == "text") & secret_name(F.col("name")), "held back: looks like it holds a secret")
        .when(F.hex(F.substring(data, 1, 8192)).rlike("^(?:..)*?00"), "binary")
        .when(~F.is_valid_utf8(data.cast("string")), "not UTF-8")
    )
    text = F.when(note.isNull(), F.regexp_replace(data.cast("string"), "^﻿", ""))
    return typed.select("path", "name", "kind", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2(data, 256).alias("sha256"), text.alias("text"), note.alias("note"))


TRACE = T.StructType().add("kind", "string").add("session", "string").add("turn", "long").add("at", "timestamp").add("call_id", "string").add("name", "string").add("ok", "boolean").add("_bad", "string")


def trace(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON-lines trace files; malformed lines have only `_bad`, blank ones are skipped."""
    return spark.read.schema(TRACE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def trace_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("session").agg(F.count_if(F.col("kind") == "turn").alias("turns"), F.count_if(F.col("kind") == "tool_began").alias("tool_calls"), F.count_if(F.col("kind") == "restart").alias("restarts"), F.count_if(F.col("_bad").isNotNull()).alias("bad_lines"))


QUESTION_SET = "commit string, questions array<struct<id:string,category:string,question:string,gold:array<struct<path:string,start:int,end:int>>>>"


def question_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions and gold spans of a JSON question set; fails on repeated ids or where a category `none` has gold, or another has none."""
    rows = spark.read.schema(QUESTION_SET).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("questions").alias("q")).select("q.*")
    wrong = rows.groupBy("id").agg(F.count("*").alias("n"), F.bool_or((F.col("category") == "none") != (F.size("gold") == 0)).alias("odd")).where("n > 1 or odd").limit(3).collect()
    if wrong:
        raise ValueError(f"questions that break the rules: {[r['id'] for r in wrong]}")
    gold = rows.select(F.col("id").alias("query_id"), F.posexplode("gold").alias("gold_id", "g")).select("query_id", "gold_id", "g.*", F.lit(None).cast("int").alias("page"))
    return rows.select(F.col("id").alias("query_id"), "category", F.col("question").alias("text")), gold


def failures(spark: SparkSession, path: str) -> DataFrame:
    """name, message of each failed or errored case of JUnit XML reports: the first line, 300 characters at most."""
    schema = "_classname string, _name string, failure struct<_message:string>, error struct<_message:string>"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    message = F.coalesce("failure._message", "error._message")
    return cases.where("failure is not null or error is not null").select(F.concat_ws("::", "_classname", "_name").alias("name"), F.left(F.split(F.coalesce(message, F.lit("")), LINE_END)[0], F.lit(300)).alias("message"))


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """word, phones (variants in order) of a dictionary; `word(2)` is a variant, # begins a comment."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    bare = lines.select("line", F.trim(F.regexp_replace("value", r"#.*$", "")).alias("v")).where("v <> ''")
    word = F.lower(F.regexp_replace(F.split("v", r"\s+", 2)[0], r"\(\d+\)$", ""))
    return bare.select("line", word.alias("word"), F.split(F.split("v", r"\s+", 2)[1], r"\s+").alias("phones")).groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "phones"))), lambda x: x["phones"]).alias("phones"))


def parsed_documents(files: DataFrame, kind: str, parse) -> DataFrame:
    """path, ordinal, start_line, end_line, header from parse(text) for the files of one kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, n, *block) for path, text in zip(b["path"], b["text"], strict=True) for n, block in enumerate(parse(text))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "start_line", "end_line", "header"])

    return files.where((F.col("kind") == kind) & F.col("text").isNotNull()).select("path", "text").mapInPandas(run, "path string, ordinal int, start_line int, end_line int, header string")


def sections(text: str) -> Iterator[tuple[int, int, str]]:
    """outline() as (first line, last line, heading trail)."""
    for b in outline(text):
        yield b.start, b.end, " > ".join(b.trail)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """session, path of the trace files of a folder, oldest name first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.left(name, F.length(name) - 6).alias("session"), "path").orderBy("session")


def strict_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; an error where a line is no object of the schema or a field is missing."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = F.array(*[F.col(c).isNull() for c in rows.columns])
    return rows.where(F.when(F.array_contains(whole, True), F.raise_error(F.concat(F.lit("a field is missing: "), F.to_json(F.struct("*")))).cast("boolean")).otherwise(True))


_PASSAGES = "id string, question string, answer string, passages array<string>"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """id, question, answer, passages, passages_sha256 of answered questions, one row for each id; passages are digested as a JSON list, so where one ends counts."""
    rows = _unrepeated(strict_rows(spark, path, _PASSAGES), "id")
    return rows.withColumn("passages_sha256", F.sha2(_ascii_json(F.col("passages")), 256))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, passages_sha256, supported, claims of judged answers, one row for each of the first three."""
    rows = strict_rows(spark, path, "question string, answer string, passages_sha256 string, supported boolean, claims array<string>")
    odd = F.when(~F.col("passages_sha256").rlike("^[0-9a-f]{64}$"), F.raise_error("a digest is no SHA-256").cast("boolean")).otherwise(True)
    return _unrepeated(rows.where(odd), "question", "answer", "passages_sha256")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """id, origin (natural or perturbed), question, answer, passages, supported of answers with a person's label."""
    rows = strict_rows(spark, path, f"{_PASSAGES}, origin string, supported boolean")
    odd = F.when(~F.col("origin").isin("natural", "perturbed"), F.raise_error(F.concat(F.lit("not an origin: "), "origin")).cast("boolean")).otherwise(True)
    return _unrepeated(rows.where(odd), "id").select("id", "origin", "question", "answer", "passages", "supported")


def _unrepeated(rows: DataFrame, *key: str) -> DataFrame:
    """rows, unless some key comes twice."""
    twice = rows.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"given twice: {[twice[0][k] for k in key]}")
    return rows


@F.pandas_udf(T.StringType())
def _ascii_json(lists: pd.Series) -> pd.Series:
    """Arrays of texts as JSON, in ASCII and with a space after each comma."""
    return lists.map(lambda x: json.dumps(list(x)), na_action="ignore")


def expansions(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """id, question, rewrites (array), passage: one row for each question (id, question), whose text it must repeat."""
    rows = strict_rows(spark, path, "id string, question string, rewrites array<string>, passage string")
    odd = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("question").alias("said")).join(questions.select("id", "question"), "id", "full_outer").where("n is null or n > 1 or question is null or said <> question")
    first = odd.limit(1).collect()
    if first:
        raise ValueError(f"question {first[0]['id']} has no expansion of its own")
    return rows


def write_rows(rows: DataFrame, path: str) -> None:
    """JSON lines that appear whole or not at all: Spark's commit renames finished files, and _SUCCESS comes last."""
    rows.write.mode("overwrite").json(path)
