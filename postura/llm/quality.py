"""Quality rules as a bitmask ledger (built-in functions only, no shuffle).

Every rule is evaluated once per document; the ledger keeps one failure bit
per rule and the measurements.  Policies are versioned bit masks applied to
the ledger, and ablations are bitwise aggregations over it, so neither reads
a text again.

Defined results: a null text has no words and fails TOO_SHORT; empty text the
same; repeated rows are judged each by itself, and no row's result depends on
another's (ties); very long texts: whole, their windows take some 10 times their
bytes in one row; an empty table gives an empty ledger; other columns of the
input are ignored, whatever their names.  Two 3-word windows of a text are told
apart by the 64-bit hash of their words: one of n windows has a false copy with
a chance of some n**2 / 2**65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: rule -> bit. New rules get new bits, bits are never given anew.
RULES = {
    "too_short": 0,
    "repeated_words": 1,
    "symbols": 2,
    "repeated_lines": 3,
    "word_length": 4,
    "upper_case": 5,
}

#: version -> rules of which none may fail.
POLICIES = {
    "v1": ("too_short", "repeated_words", "symbols", "repeated_lines", "word_length"),
    "v2": ("too_short", "repeated_words", "symbols", "repeated_lines", "word_length", "upper_case"),
}
BASE = ("too_short", "repeated_words")
BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOLS_PER_100_WORDS = 30
MAX_DUP_LINE_PCT = 30
MIN_DUP_LINES = 4
WORD_LENGTH = (2, 20)
MAX_UPPER_PCT = 60


def mask(rules) -> int:
    """Bit mask of the named rules."""
    return sum(1 << RULES[r] for r in rules)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        id_col,
        F.filter(F.split("_t", BLANK), lambda x: x != "").alias("_w"),
        F.length(F.regexp_replace("_t", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", "[^A-Za-z]+", "")).cast("long").alias("n_letters"),
    )
    # each 3-word window as (hash, place), equal ones brought side by side
    window = lambda i: F.struct(
        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")
    )
    n = F.size("_w")
    rows = rows.select(
        id_col, "word_chars", "n_symbols", "n_upper", "n_letters",
        n.cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).alias("_s"),
    )
    again = F.filter("_s", lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]))
    rows = rows.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    gap = F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3))))
    covered = F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)
    # a filter on the ledger must not be pushed below this point: it would hold the sorted windows once for each of their elements
    stay = F.monotonically_increasing_id() * 0
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        (F.coalesce(covered, F.lit(0)) + stay).cast("long").alias("n_repeat_words"), "n_upper", "n_letters",
    )


def _tests() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "too_short": n < MIN_WORDS,
        "repeated_words": 100 * c("n_repeat_words") > MAX_REPEAT_PCT * n,
        "symbols": 100 * c("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * n,
        "repeated_lines": (c("n_dup_lines") >= MIN_DUP_LINES) & (100 * c("n_dup_lines") > MAX_DUP_LINE_PCT * c("n_lines")),
        "word_length": (c("word_chars") < WORD_LENGTH[0] * n) | (c("word_chars") > WORD_LENGTH[1] * n),
        "upper_case": 100 * c("n_upper") > MAX_UPPER_PCT * c("n_letters"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure bits (column failed) of every document."""
    bits = F.lit(0)
    for rule, test in _tests().items():
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << RULES[rule])).otherwise(0))
    return measured(docs, id_col, text_col).withColumn("failed", bits)


def passes(version: str, failed: Column | str = "failed") -> Column:
    """True where a document fails no rule of the policy."""
    col = F.col(failed) if isinstance(failed, str) else failed
    return col.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def accepted(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that pass a policy."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return ledger(rows, "_row", "_text").filter(passes(version)).select("_row.*")


def ablation(book: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept if it were dropped), one shuffled row a task."""
    whole = mask(POLICIES[version])
    f = F.col("failed").bitwiseAND(F.lit(whole))
    aggs = [F.count("*").alias("n_docs"), F.count_if(f == 0).alias("n_kept")]
    for r in POLICIES[version]:
        bit = 1 << RULES[r]
        aggs += [F.count_if(f.bitwiseAND(F.lit(bit)) != 0).alias(f"fail_{r}"), F.count_if(f == bit).alias(f"only_{r}")]
    sums = book.agg(*aggs)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("n_fail"), F.col(f"only_{r}").alias("n_only")) for r in POLICIES[version]])
    return sums.select("n_docs", "n_kept", F.explode(each).alias("x")).select("x.rule", "n_docs", "n_kept", "x.n_fail", "x.n_only")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents under the current policy."""
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"),
        passes("v2").alias("kept"), F.col("failed").cast("long").alias("failed"),
    )


OP5_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (
  select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g) where c > 1),
n as (
  select rid, sum(least(3, coalesce(nx - i, 3)))::bigint as n_repeat_words
  from (select rid, i, lead(i) over (partition by rid order by i) as nx from r) group by rid),
m as (
  select d.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
         len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n.n_repeat_words, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) as n_letters
  from d join w using (rid) left join n using (rid)),
f as (
  select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 100 * n_symbols > 30 * n_words then 4 else 0 end + case when n_dup_lines >= 4 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end
    + case when 100 * n_upper > 60 * n_letters then 32 else 0 end)::bigint as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed
from f
"""
