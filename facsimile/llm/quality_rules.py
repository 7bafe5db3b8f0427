"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule. A policy is a named, versioned mask over these
bits, so changing a policy, comparing two, or asking what a rule costs reads
the ledger alone and never a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import WordHashes, as_bytes, shingle_hashes, text_rows

_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_letters", "n_capitals", "n_stutters"]
_SCHEMA = "doc_id {}, " + ", ".join(f"{c} long" for c in _LONGS)
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition on the measurements holds."""

    name: str
    fails: str


#: A rule's bit is its place here; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("capitals", "n_letters >= 20 AND 10 * n_capitals > 7 * n_letters"),
    Rule("many_capitals", "n_letters >= 20 AND 10 * n_capitals > 3 * n_letters"),
    Rule("stutter", "10 * n_stutters > 3 * n_words"),
)
#: Masks by version; a published version never changes.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "capitals",
           "stutter"),
    "v2-strict": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "capitals",
                  "many_capitals", "stutter"),
}


def mask(policy: str) -> int:
    """The bits a policy looks at."""
    at = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    return sum(at[name] for name in POLICIES[policy])


def _figures(data: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    white = np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    points = len(raw) - np.count_nonzero((raw & 0xC0) == 0x80)
    capitals = np.count_nonzero((raw >= 65) & (raw <= 90))
    letters = capitals + np.count_nonzero((raw >= 97) & (raw <= 122))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    coded = hashes.of(words)
    windows = shingle_hashes(coded, WINDOW)
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            again = np.zeros(len(windows), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            starts = np.flatnonzero(again)
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(steps[:-1]) > 0))
    return (len(words), points - white, sum(data.count(s) for s in SYMBOLS), duplicates, repeated,
            lines, letters, capitals, int(np.count_nonzero(coded[1:] == coded[:-1])))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements per document, in one pass over the texts, without a shuffle."""
    rows = text_rows(docs, id_col, text_col)
    schema = _SCHEMA.format(rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            figures = [_figures(x, hashes) for x in as_bytes(batch.column(1))]
            columns = list(zip(*figures)) or [[]] * len(_LONGS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *_LONGS])

    return rows.mapInArrow(run, schema)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every document and ``fail_bits``, one bit per failed rule.

    A null or empty text has no words and fails ``few_words`` alone. Repeated
    rows and null ids give a row each; an empty table gives an empty ledger.
    """
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def failed(policy: str) -> Column:
    """The failed bits a policy looks at."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """``kept``: no rule of the policy failed; ``base_failed``: one of the base policy did."""
    return rows.withColumn("base_failed", failed("base") != 0).withColumn(
        "kept", (failed("base") == 0) & (failed(policy) == 0))


def ablations(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: documents the rule fails, and those that it alone fails.

    (policy, rule, n_docs, n_kept, n_failed, n_only): leaving the rule out would
    keep ``n_only`` more. One pass over the ledger: documents are first counted
    by their failure bits (at most one row per combination of rules), and the
    policies then read these counts.
    """
    spark = rows.sparkSession
    counted = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame(
        [(p, mask(p), r.name, 1 << i) for p in policies for i, r in enumerate(RULES) if r.name in POLICIES[p]],
        "policy string, mask long, rule string, bit long")
    failing = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return (
        F.broadcast(table).join(counted, F.lit(True), "left").groupBy("policy", "rule").agg(
            count(F.lit(True)).alias("n_docs"), count(failing == 0).alias("n_kept"),
            count(failing.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            count(failing == F.col("bit")).alias("n_only")))


QUERY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents under the present policy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs)).select(*QUERY_COLUMNS, "fail_bits")


_FIGURES_SQL = r"""
    words AS (SELECT doc_id, coalesce(text, '') AS text,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words),
    windows AS (SELECT doc_id, i, w[i:i + 4] AS v FROM starts),
    again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
                FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE n >= 2) GROUP BY doc_id),
    cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
    lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    figures AS (
        SELECT words.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
               length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
               len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
        FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))"""


def oracle() -> str:
    """The query's rows by SQL: measurements counted another way, conditions and masks from the tables above."""
    bits = " + ".join(f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES))
    base, policy = (f"(fail_bits & {mask(p)})" for p in ("base", "v1"))
    return (f"WITH {_FIGURES_SQL}, bits AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM figures)\n"
            f"SELECT {', '.join(c for c in QUERY_COLUMNS if c not in ('base_failed', 'kept'))}, fail_bits,\n"
            f"       {base} <> 0 AS base_failed, {base} = 0 AND {policy} = 0 AS kept FROM bits")
