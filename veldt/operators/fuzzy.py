"""Fuzzy search of a table of texts with a table of queries: words meet terms over shared forms with letters left out, never all with all."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veldt.functions.text import Term
from veldt.operators.shared import written

WORD = r"([a-z0-9]+)"
#: Pairs of a term and a word that are broadcast at most.
BROADCAST = 500_000


def forms(word: str, most: int) -> set[str]:
    """A word and what is left of it without up to ``most`` of its letters."""
    return {"".join(c for k, c in enumerate(word) if k not in out) for n in range(min(most, len(word)) + 1) for out in map(set, combinations(range(len(word)), n))}


@pandas_udf(T.ArrayType(T.StringType()))
def _term_forms(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: sorted(forms(t, Term(t).most)))


def _word_forms(lengths: list[int]):
    """Forms of a word for terms of these lengths: of its starts, of the whole where it isn't much longer, and its stretches as they are."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def made(words: pd.Series) -> pd.Series:
        def one(word: str) -> list[str]:
            found = set()
            for n in lengths:
                most = (n >= 4) + (n >= 8)
                found.update(word[k : k + n] for k in range(len(word) - n + 1))
                if most and len(word) >= n - most:
                    found |= forms(word[:n], most)
                    if n < len(word) <= n + most:
                        found |= forms(word, most)
            return sorted(found)

        return words.map(one)

    return made


@pandas_udf(T.BooleanType())
def _verified(terms: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[str, Term] = {}
    for term, word in terms:
        out = []
        for t, w in zip(term, word):
            if t not in known:
                if len(known) >= 50_000:
                    known.clear()
                known[t] = Term(t)
            out.append(t in w or known[t].near(w))
        yield pd.Series(out, dtype=bool)


def near_words(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (term, word): each term of one column ``term`` with the words of ``word`` that hold it or are within its typos (see ``Term``).

    Two strings within k edits share a form that each comes to by leaving out at most k letters; so words and terms are joined on forms and only
    what meets is compared. A word of n letters has about n² / 2 forms for two typos. Terms have lengths of 1 to a few dozen, which are gathered.
    """
    asked = written(terms.select("term").where("term <> ''").distinct(), "terms")
    lengths = sorted(r[0] for r in asked.select(F.length("term")).distinct().collect())
    here = words.select("word").where("word IS NOT NULL").distinct().select("word", F.explode(_word_forms(lengths)(F.col("word"))).alias("form"))
    there = asked.select("term", F.explode(_term_forms(F.col("term"))).alias("form"))
    met = here.join(there, "form").select("term", "word").distinct()
    return met.where(_verified("term", "word"))


def fuzzy_join(texts: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str) -> DataFrame:
    """Rows (query, key): texts that have, for every word of the query, a word that holds it or is within its typos.

    Words are runs of a-z and digits in lower case. Queries and texts without words, null ones too, are in no row. Rows that repeat a key add up.
    """
    has, of_key = _sets(texts, key, text, "set")
    asks, of_query = _sets(queries.where(F.col(query).isNotNull()), query, query_text, "asked")
    pairs = written(near_words(has, asks.withColumnRenamed("word", "term")), "near")
    near = F.broadcast(pairs) if pairs.count() < BROADCAST else pairs
    found = written(has.join(near, "word").groupBy("set").agg(F.collect_set("term").alias("found")), "found")
    met = found.select(F.explode("found").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a query looks only at the texts that have the rarest of its words; one with a word that no text has is left out
    rarest = asks.join(met, "word", "left").groupBy("asked").agg(F.collect_set("word").alias("all"), F.min_by("word", F.struct("n", "word")).alias("word"), F.min(F.col("n").isNotNull()).alias("ok"))
    both = found.withColumn("word", F.explode("found")).join(rarest.where("ok"), "word").where(F.size(F.array_except("all", "found")) == 0).select("asked", "set")
    # rows of equal words are met by their set, so that what is joined and counted has no copies
    return both.join(of_query, "asked").join(of_key, "set").select(F.col("key_asked").alias(query), F.col("key_set").alias(key))


def _sets(rows: DataFrame, key: str, text: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows (``name``, word) of each different set of words, rows (key_``name``, ``name``) of the sets of each key); empty sets are left out."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD)))
    own = rows.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    keyed = own.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")).where(F.size("words") > 0)
    keyed = written(keyed, "keyed")
    sets = written(keyed.select("words").distinct().withColumn(name, F.monotonically_increasing_id()), "sets")
    return sets.select(name, F.explode("words").alias("word")), keyed.join(sets, "words").select(F.col("key").alias(f"key_{name}"), name)
