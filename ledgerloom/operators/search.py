"""Full-text search: an inverted index as a table, ranked by BM25.

Terms are runs of letters and digits, lower-cased; ``sources.text_index`` keeps an index with stems in files. Queries are terms (all must
occur), ``OR`` between groups, ``"phrases"`` and ``prefix*``.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): (term, doc_id, tf, places) and (doc_id, length)."""
    split = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col)).alias("words"))
    postings = split.select("doc_id", F.posexplode("words").alias("place", "term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))
    return postings, split.select("doc_id", F.size("words").alias("length"))


def parse(query: str) -> list[list[tuple[str, ...]]]:
    """Alternatives, each a list of phrases that must all occur (a phrase of one word is a term)."""
    out: list[list[tuple[str, ...]]] = [[]]
    for m in re.finditer(r'"([^"]*)"|(\S+)', query):
        if m[2] == "OR":
            out.append([])
        elif m[2] == "AND":
            continue
        else:
            words = re.findall(r"\w+\*?", (m[1] if m[1] is not None else m[2]).lower())
            if words:
                out[-1].append(tuple(words)) if m[1] is not None else out[-1].extend((w,) for w in words)
    return [g for g in out if g]


def words_of(groups: list[list[tuple[str, ...]]]) -> list[str]:
    return sorted({w for g in groups for p in g for w in p})


def matching(postings: DataFrame, word: str) -> DataFrame:
    """The postings of a query's word, or of all terms that begin with it."""
    return postings.where(F.col("term").startswith(word[:-1]) if word.endswith("*") else F.col("term") == word).withColumn("word", F.lit(word))


def search(postings: DataFrame, lengths: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """The best documents (doc_id, score), highest first. Reads the postings of the query's terms only."""
    groups = parse(query)
    words = words_of(groups)
    if not words:
        return lengths.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    total = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    found = reduce(DataFrame.unionByName, [matching(postings, w) for w in words])
    return rank(found.join(lengths, "doc_id"), groups, total["n"], total["mean"], limit)


def rank(found: DataFrame, groups: list[list[tuple[str, ...]]], n: int, mean: float | None, limit: int = 25) -> DataFrame:
    """The best documents of the postings (word, doc_id, tf, places, length) of a query's words, among ``n`` of that mean length."""
    words, mean = words_of(groups), mean or 1.0
    found = found.groupBy("doc_id", "word").agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list("places")).alias("places"), F.max("length").alias("length"))
    df = {r["word"]: r["d"] for r in found.groupBy("word").agg(F.count("*").alias("d")).collect()}
    idf = {w: math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in words}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.col("word"))
    hits = found.withColumn("part", weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)))
    scored = hits.groupBy("doc_id").agg(F.sum("part").alias("score"), F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("at"))
    accept = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for phrase in g:
            starts = F.coalesce(F.try_element_at("at", F.lit(phrase[0])), F.array().cast("array<int>"))
            for k, w in enumerate(phrase[1:], 1):
                nxt = F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>"))
                starts = F.array_intersect(starts, _shifted(nxt, k))
            every = every & (F.size(starts) > 0)
        accept = accept | every
    return scored.where(accept).orderBy(F.desc("score"), "doc_id").limit(max(1, limit)).select("doc_id", "score")


def _shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def snippet(text: str, query: str, size: int = 16) -> str:
    """``size`` words around the first match, matches in <b>."""
    words, wanted = text.split(), {w for g in parse(query) for p in g for w in p}
    hit = lambda w: any(t.startswith(q[:-1]) if q.endswith("*") else t == q for t in re.findall(r"\w+", w.lower()) for q in wanted)
    at = next((i for i, w in enumerate(words) if hit(w)), 0)
    lo = max(0, at - size // 4)
    return ("…" if lo else "") + " ".join(f"<b>{w}</b>" if hit(w) else w for w in words[lo : lo + size]) + ("…" if lo + size < len(words) else "")
