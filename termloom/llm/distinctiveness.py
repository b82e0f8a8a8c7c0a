"""How distinctive a term is per record: divergence from randomness.

Information content under the geometric (Bose-Einstein) collection model times the Laplace after-effect gain, with
the term frequency normalised by the record's length (normalisation 2):

    tfn = tf * log2(1 + c * mean_length / length)
    score = (log2(1 + m) + tfn * log2((1 + m) / m)) / (tfn + 1),   m = occurrences / records of the collection
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.terms import TermStatistics, frequencies


def dfr_score(tf: Column, length: Column, occurrences: Column, n_records: int, mean_length: float, c: float = 1.0) -> Column:
    mean = occurrences / F.lit(float(max(1, n_records)))
    tfn = tf * F.log2(F.lit(1.0) + F.lit(c * mean_length) / length)
    return (F.log2(F.lit(1.0) + mean) + tfn * F.log2((F.lit(1.0) + mean) / mean)) / (tfn + F.lit(1.0))


def distinctive_terms(
    df: DataFrame,
    record_id: str,
    text: str,
    *,
    min_tf: int = 1,
    max_share: float = 1.0,
    wanted: DataFrame | None = None,
    c: float = 1.0,
) -> DataFrame:
    """record_id, term, tf, records, score for every term of every record.

    ``min_tf`` and ``max_share`` (of the records) and the ``wanted`` terms (a table with the column ``term``) only
    select rows; the statistics always cover the whole collection. Statistics join by term after the selection, so a
    hot term is cut before the exchange when ``max_share`` excludes it and is spread by AQE's skew split otherwise.

    Null and empty texts have no terms but count as records; rows with a null id keep it; a repeated row gives its
    rows again. Other columns are not read.
    """
    stats = TermStatistics(df, text)
    mean_length = stats.n_tokens / max(1, stats.n_records)
    kind = df.schema[record_id].dataType.simpleString()
    terms = stats.table().where(F.col("records") <= F.lit(max_share * stats.n_records))
    if wanted is not None:
        terms = terms.join(wanted.select("term").distinct(), "term", "left_semi")
    rows = df.select(F.col(record_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        frequencies(min_tf, "id"), f"id {kind}, term string, tf long, length long"
    )
    score = dfr_score(F.col("tf"), F.col("length"), F.col("occurrences"), stats.n_records, mean_length, c)
    return rows.join(terms, "term").select(F.col("id").alias(record_id), "term", "tf", "records", score.alias("score"))


#: Words of the query language that are operators, with the numbers some of them take.
OPERATORS = r"(?<![\p{L}\p{N}_])(?:AND|OR|NOT|TO|(?:NEAR|FOLLOW)(?:\s*\d+)?)(?![\p{L}\p{N}_])"
CONTEXT = r"(?:[\p{L}\p{N}_]+\s*,\s*)*[\p{L}\p{N}_]+\s*:"
BOOST = r"\^\s*\d+(?:\.\d+)?"


def query_words(query: Column) -> Column:
    """Whole words of a query, lower-cased: without operators, boosts and the context names before a colon."""
    plain = query
    for pattern in (BOOST, CONTEXT, OPERATORS):
        plain = F.regexp_replace(plain, pattern, " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"([\p{L}\p{N}]+)"))
