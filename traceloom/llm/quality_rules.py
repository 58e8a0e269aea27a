"""Host-level quality rules, with DataFrame functions only.

Each document is measured and held against a few rules. Failures are summed by host, a host's failure rate is shrunk
with a beta prior that is fitted to all hosts (a host of few documents stays near the mean), and the host's verdict
goes back to its documents. Counts are aggregated before they are shuffled; a host with a third of the rows costs no
more than another.

Defined results: null text has no words and fails; a null host is the host ''; an empty table gives no rows; repeated
rows each count; columns of any other name pass untouched through `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, join_sized, table

SYMBOLS = r"[#*$%&|<>]"
_IDX = 2**31 - 1


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat: float = 0.5  # words in repeated 3-word windows, of all words
    max_symbols: float = 0.05  # symbols, of the characters in words
    max_dup_lines: float = 0.5  # repeated lines, of the lines with a word
    max_host_rate: float = 0.5  # a host with a shrunk failure rate above is rejected


def _let(value: Column, body) -> Column:
    """body(value), with value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _gram(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _same(sorted_: Column, x: Column, j: Column, key) -> Column:
    """x's key is also that of its neighbour in a sorted array."""
    before = F.get(sorted_, j - 1)
    after = F.get(sorted_, j + 1)
    return F.coalesce(key(before) == key(x), F.lit(False)) | F.coalesce(key(after) == key(x), F.lit(False))


def _repeated(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    A window's 32-bit hash and its place are packed in one long, so that sorting brings equal hashes together; only
    windows with an equal neighbour are then compared as text, so the count is exact.
    """
    bits = 2**31
    packed = F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.hash(x, F.get(w, i + 1), F.get(w, i + 2)).cast("long") * bits + i))
    place = lambda x: x.bitwiseAND(F.lit(_IDX).cast("long")).cast("int")

    def texts(p: Column) -> Column:
        near = F.filter(p, lambda x, j: _same(p, x, j, lambda y: F.shiftright(y, 31)))
        return F.sort_array(F.transform(near, lambda x: F.struct(_gram(w, place(x)).alias("g"), place(x).alias("i"))))

    def places(n: Column) -> Column:
        return F.sort_array(F.transform(F.filter(n, lambda x, j: _same(n, x, j, lambda y: y["g"])), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(packed, lambda p: _let(texts(p), lambda n: _let(places(n), covered)))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(text, F.lit(""))
    words = _let(F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words"),
    ))
    lines = _let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return _let(F.struct(words.alias("w"), lines.alias("l")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
    ))


def measure(docs: DataFrame, text: str) -> DataFrame:
    """docs without the text, with its measures."""
    return docs.withColumn("_measures", measures(F.col(text))).select(*(c for c in docs.columns if c != text), "_measures.*")


def failures(of, rules: Rules = Rules()) -> dict[str, Column]:
    """base: too short or too repetitive; any: one of all rules. of(name) is a measure."""
    base = (of("n_words") < rules.min_words) | (100 * of("n_repeat_words") > F.lit(round(100 * rules.max_repeat)) * of("n_words"))
    symbols = of("n_symbols") > rules.max_symbols * of("word_chars")
    lines = of("n_dup_lines") > rules.max_dup_lines * of("n_lines")
    return {"base": base, "any": base | symbols | lines}


def host_verdicts(judged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """judged: host, failed. Returns host, docs, fails, rate (shrunk), host_ok; one row a host.

    The prior's two parameters are the moments of the hosts' rates: with mean m and variance v they sum to
    m(1-m)/v - 1, at least 1. Where all rates are equal, the rate stays as it is.
    """
    per = judged.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails"))
    per = cut(per, "hosts")
    raw = F.col("fails") / F.col("docs")
    m, v = per.agg(F.avg(raw), F.var_pop(raw)).first()  # one row
    strength = max(m * (1 - m) / v - 1, 1.0) if v else 1.0
    rate = (F.col("fails") + (m or 0.0) * strength) / (F.col("docs") + strength)
    return per.select("host", "docs", "fails", rate.alias("rate"), (rate <= rules.max_host_rate).alias("host_ok"))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs. Texts are measured twice, first for the verdicts on
    hosts; they are neither shuffled nor written on the way."""
    failed = _let(measures(F.col("row").getField(text)), lambda m: failures(lambda k: m[k], rules)["any"])
    rows = docs.select(F.struct("*").alias("row")).select("row", F.coalesce(F.col("row").getField(host), F.lit("")).alias("q_host"), failed.alias("failed"))
    good = host_verdicts(rows.select(F.col("q_host").alias("host"), "failed"), rules).filter("host_ok").select(F.col("host").alias("q_host"), F.lit(True).alias("q_ok"))
    return join_sized(rows.filter("not failed").select("row", "q_host"), good, ["q_host"], "inner").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    seen = cut(measure(docs, "text"), "measures")
    fails = failures(F.col)
    hosts = host_verdicts(seen.select(F.col("source").alias("host"), fails["any"].alias("failed"))).select(F.col("host").alias("q_host"), "rate", "host_ok")
    out = join_sized(seen.withColumn("q_host", F.coalesce("source", F.lit(""))), hosts, ["q_host"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails["base"].alias("base_failed"),
        (~fails["any"] & F.col("host_ok")).alias("kept"), F.round("rate", 6).alias("host_rate"),
    )
