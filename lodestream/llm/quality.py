"""Quality rules as a bitmask ledger, with DataFrame functions only.

`ledger` evaluates every rule once for each document and keeps the measurements and one bit for each failed rule.
A policy is a version name and a mask over those bits; applying one, or asking what each rule of a policy costs
(`ablation`), reads the stored bits and never the texts.

Words are runs of anything but space, tab, newline, vertical tab, form feed and return. Null texts have no words and
fail ``few_words`` (and no rule that divides by the number of words). Rows with null or repeated doc_ids are rows like
any others; a column of the input that the caller does not pass in `keep` is not carried, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rule name -> failing condition over the measurements. The position is the bit; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}


def mask(*rules: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


BASE = mask("few_words", "repeated_windows")
#: Policies never change once used; a change is a new version.
POLICIES: dict[str, int] = {
    "1": BASE,
    "2": BASE | mask("many_symbols"),
    "3": mask(*RULES),
}
CURRENT = "3"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more; windows are compared by 64-bit hashes."""

    def covered(keys: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["k"] == F.get(pairs, j)["k"]
            twice = F.filter(pairs, lambda p, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda p: p["i"]))
            state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda s, p: F.struct((p + WINDOW).alias("end"), (s["n"] + p + WINDOW - F.greatest(s["end"], p)).alias("n"))
            return F.aggregate(places, state, step)["n"]

        pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(F.array_sort(pairs), of_sorted))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), covered))
    return F.when(F.size(words) > WINDOW, hashed).otherwise(F.lit(0))


def ledger(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, the measurements, and ``fail_bits``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")

    def measured(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
        )

    rows = F.transform(F.array(words), lambda w: _let(lines, lambda ls: measured(w, ls)))
    bits = " | ".join(f"case when {rule} then {1 << i} else 0 end" for i, rule in enumerate(RULES.values()))
    kept = [F.col(c) for c in dict.fromkeys(("doc_id", *keep))]
    return docs.select(*kept, F.inline(rows)).withColumn("fail_bits", F.expr(bits).cast("long"))


def verdict(policy: str = CURRENT) -> Column:
    """Whether a row of the ledger passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row for each rule of the policy: documents that fail it, and those that fail nothing else of the policy."""
    used = [(name, 1 << i) for i, name in enumerate(RULES) if POLICIES[policy] >> i & 1]
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    sums = [F.count_if(bits.bitwiseAND(F.lit(b)) != 0).alias(f"f{b}") for _, b in used] + [F.count_if(bits == b).alias(f"o{b}") for _, b in used]
    packed = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{b}").alias("failed"), F.col(f"o{b}").alias("failed_only")) for n, b in used])
    return rows.agg(*sums).select(F.inline(packed))


def filtered(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass, with their own columns."""
    columns = docs.columns
    rest = tuple(c for c in columns if c != "doc_id")
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("_row"))
    return ledger(packed, keep=("_row",)).where(verdict(policy)).select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`").alias(c) for c in columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict().alias("kept"), "fail_bits"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)
), t AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), c AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM t) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""
