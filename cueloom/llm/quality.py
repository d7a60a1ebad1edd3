"""Quality rules: a ledger of rule failures as bits, and policies over it.

Every rule is evaluated once a document. The ledger keeps the measurements and one bit a rule;
a policy is a mask of the bits that reject. Other policies, and what each rule alone costs,
follow from the ledger by bitwise operations, without the texts.

Defined results: a null text has no words, so it fails ``few_words``; very long texts are measured whole; rules compare
with fixed bounds, so no ties arise; an empty table gives an empty ledger; repeated rows are judged one by one; columns of the input other than the text are
passed on, unless one has the name of a ledger column, which then holds the ledger's value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Name and failure of each rule, from the struct of measurements; a rule's place is its bit.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("many_symbols", lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    ("duplicate_lines", lambda m: (m["n_dup_lines"] > 2) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    ("shouting", lambda m: 100 * m["n_upper"] > 60 * m["word_chars"]),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Rejecting bits of each version of the policy. A published version never changes.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["word_length"] | BIT["shouting"],
}

MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _covered(positions: Column) -> Column:
    """Words under windows of WINDOW words that start at the given ascending positions."""
    gaps = F.transform(
        positions,
        lambda p, i: F.when(i + 1 < F.size(positions), F.least(positions[i + 1] - p, F.lit(WINDOW))).otherwise(WINDOW),
    )
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def repeat_words(tokens: Column) -> Column:
    """Words inside windows of eight words that the text has twice or more, the first included."""

    def starts(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = lambda s: F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
            | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(let(ranked, alike), lambda x: x["i"]))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(starts(hashes), _covered)
        )

    def of_words(hashed: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashed) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]),
        )
        return F.when(F.size(hashed) > WINDOW, let(windows, of_hashes)).otherwise(0)

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of_words).cast("long")


def measure(text: Column) -> Column:
    """All measurements of a text, as a struct."""
    whole = F.coalesce(text, F.lit(""))

    def of(parts: Column) -> Column:
        tokens, lines = parts["tokens"], parts["lines"]
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(tokens).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(whole, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(F.struct(words(text).alias("tokens"), lines.alias("lines")), of)


def fail_bits(measured: Column) -> Column:
    """The bits of all rules that a struct of measurements fails."""
    bits = F.lit(0)
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed(measured), F.lit(1 << i)).otherwise(0))
    return bits.cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the measurements and fail_bits (long)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in (*MEASUREMENTS, "fail_bits")]
    judged = let(measure(F.col(f"`{text}`")), lambda m: F.struct(*[m[x].alias(x) for x in MEASUREMENTS], fail_bits(m).alias("fail_bits")))
    return docs.select(*kept, F.inline(F.array(judged)))


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept."""
    bits = F.col("fail_bits")
    return book.withColumn("base_failed", bits.bitwiseAND(BASE) != 0).withColumn(
        "kept", bits.bitwiseAND(POLICIES[policy] | BASE) == 0
    )


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    Counts of each pattern of bits come first, so that what is shuffled is bounded by the
    number of patterns and not by the number of documents.
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask])
    )
    each = patterns.select("bits", "n", rules.alias("r"))
    total = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("r.bit")).alias("n_only"),
    )


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns as they are."""
    judged = let(measure(F.col(f"`{text}`")), fail_bits)
    return docs.filter(judged.bitwiseAND(POLICIES[policy] | BASE) == 0)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
l AS (SELECT * EXCLUDE (lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
  + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
  + 32 * (100 * n_upper > 60 * word_chars)::INT)::BIGINT AS fail_bits FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, fail_bits,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
