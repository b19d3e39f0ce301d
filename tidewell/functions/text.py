"""Full-text and hybrid search as DataFrame aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.stages import staged

#: Frequent English words that an index leaves out.
STOP_WORDS = "a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was were will with".split()


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """A light English stem: plurals, -ing and -ed go where a stem of three letters or more stays."""
    out = F.regexp_replace(word, "(?<=[a-z]{2})ies$", "y")
    out = F.regexp_replace(out, "(?<=(?:ss|sh|ch|x|z))es$", "")
    out = F.regexp_replace(out, "(?<=[a-z]{2}[^s])s$", "")
    return F.regexp_replace(out, "(?<=[a-z]{3})(?:ing|ed)$", "")


def index_terms(text: Column, stop_words: list[str] | None = None, stemmed: bool = True) -> Column:
    """Terms as an index keeps them: without stop words, stemmed."""
    kept = F.filter(terms(text), lambda t: ~t.isin(*(STOP_WORDS if stop_words is None else stop_words))) if stop_words is None or stop_words else terms(text)
    return F.transform(kept, stem) if stemmed else kept


def natural_key(name: Column, digits: int = 20) -> Column:
    """A key that sorts names by the numbers within them: the last number padded to so many digits after the text before it."""
    number = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1)
    return F.concat(F.regexp_replace(name, r"\d+(?!.*\d).*$", ""), F.lpad(number, digits, "0"))


def _times(words: Column, word: Column | str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, word))


def tf_idf(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score = sum over the query's terms of tf / length * ln(N / df), over index terms; documents with any of them."""
    wanted = docs.sparkSession.range(1).select(F.array_distinct(index_terms(F.lit(query))).alias("t")).first()["t"]
    counted = docs.select(F.col(key).alias("_k"), index_terms(F.col(text)).alias("_t")).select("_k", F.size("_t").alias("_n"), *[_times(F.col("_t"), w).alias(f"_f{i}") for i, w in enumerate(wanted)])
    stats = counted.agg(F.count("*").alias("_docs"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        score = score + F.when(F.col(f"_f{i}") > 0, F.col(f"_f{i}") / F.col("_n") * F.log(F.col("_docs") / F.col(f"_d{i}"))).otherwise(0.0)
    return counted.crossJoin(F.broadcast(stats)).where(" OR ".join([f"_f{i} > 0" for i in range(len(wanted))] or ["false"])).select(F.col("_k").alias(key), score.alias("score"))  # stats: one row


def rank(text: Column, words: list[str]) -> Column:
    """How often the words stand in the text, damped by its length: sum of times / (1 + ln(length))."""
    own = index_terms(text)
    total = sum((_times(own, stem(F.lit(w.lower()))) for w in words), F.lit(0))
    return total / (1 + F.log(F.greatest(F.size(own), F.lit(1))))


def searched(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """A text search: any of the words, all of the "quoted phrases", none of the -words; words by their stems unless case counts."""
    phrases, rest = re.findall(r'"([^"]+)"', query), re.sub(r'"[^"]*"', " ", query).split()
    own = F.split(text, r"[^\p{L}\p{N}]+") if case_sensitive else index_terms(text, [])
    has = lambda w: F.array_contains(own, F.lit(w) if case_sensitive else stem(F.lit(w.lower())))
    found, words = F.lit(True), [w for w in rest if not w.startswith("-")]
    if words and not phrases:
        found = F.lit(False)
        for w in words:
            found = found | has(w)
    for p in phrases:
        found = found & (text.contains(p) if case_sensitive else phrase(text, p.split()))
    for w in (w[1:] for w in rest if w.startswith("-")):
        found = found & ~has(w)
    return F.coalesce(found, F.lit(False))


def query_matches(text: Column, query: str) -> Column:
    """Text queries of words with & | ! <-> and parentheses; words by their stems."""
    toks = re.findall(r"<->|[&|!()]|[^\s&|!()<]+", query)
    own, at = index_terms(text, []), 0
    line = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))

    def peek() -> str:
        return toks[at] if at < len(toks) else ""

    def some() -> Column:
        nonlocal at
        left = every()
        while peek() == "|":
            at += 1
            left = left | every()
        return left

    def every() -> Column:
        nonlocal at
        left = one()
        while peek() == "&":
            at += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if peek() == "!":
            at += 1
            return ~one()
        if peek() == "(":
            at += 1
            inner = some()
            if peek() != ")":
                raise ValueError("a parenthesis stays open")
            at += 1
            return inner
        if not peek() or peek() in "&|)" or peek() == "<->":
            raise ValueError(f"a word is wanted, not {peek() or 'the end'}")
        words = [peek()]
        at += 1
        while peek() == "<->":
            words.append(toks[at + 1])
            at += 2
        return line.contains(F.concat(F.lit(" "), F.concat_ws(" ", *[stem(F.lit(w.lower())) for w in words]), F.lit(" ")))

    out = some()
    if at < len(toks):
        raise ValueError(f"unexpected {toks[at]}")
    return out


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, bm25 for documents with any query term. idf = ln((N - df + 0.5) / (df + 0.5)), which may be negative.

    Texts are read once: what leaves the scan is a few whole numbers a document, staged for the statistics and the scores.
    """
    wanted = [q.lower() for q in query]
    counted = docs.select(F.col(key).alias("_k"), terms(F.col(text)).alias("_t")).select("_k", F.size("_t").alias("_n"), *[_times(F.col("_t"), w).alias(f"_f{i}") for i, w in enumerate(wanted)])
    counted = staged(counted, "bm25")
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(wanted))])
    both = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        score = score + F.when(f > 0, F.log((F.col("_docs") - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    hit = F.lit(False)
    for i in range(len(wanted)):
        hit = hit | (F.col(f"_f{i}") > 0)
    return both.where(hit).select(F.col("_k").alias(key), score.alias("bm25"))


def alpha_fusion(vector: DataFrame, keyword: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """key, score = alpha * v / max(v) + (1 - alpha) * kw / max(kw); inputs are (key, score)."""
    peaks = vector.agg(F.max("score").alias("_mv")).crossJoin(keyword.agg(F.max("score").alias("_mk")))
    both = vector.withColumnRenamed("score", "_v").join(keyword.withColumnRenamed("score", "_w"), key, "full").crossJoin(F.broadcast(peaks))
    part = lambda c, m: F.coalesce(F.try_divide(F.col(c), F.col(m)), F.lit(0.0))
    return both.select(key, (alpha * part("_v", "_mv") + (1 - alpha) * part("_w", "_mk")).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60, top: int = 1000) -> DataFrame:
    """key, score = sum of 1 / (k + rank) over the lists' first ``top`` (key, score) rows, ranks from 1."""
    ranked = None
    for one in lists:
        best = one.orderBy(F.desc("score"), key).limit(top).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), key)))
        part = best.select(key, (1 / (k + F.col("_r"))).alias("_s"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(key).agg(F.sum("_s").alias("score"))


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words stand side by side."""
    return F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" ")).contains(" " + " ".join(w.lower() for w in words) + " ")


def highlight(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(words) + r")\b", f"{before}$1{after}")
