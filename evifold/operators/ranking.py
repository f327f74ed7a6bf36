"""Lexical, dense and fused ranking with complete tie-breaks (RNK)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifold.functions.ordered import running
from evifold.plans.checkpoints import cut_lineage
from evifold.sources.tables import spread

TOKEN = r"[a-z0-9]+|[一-鿿]"
#: Largest query set, in distinct (query, term) rows, that is sent to all tasks; larger ones are joined by term.
BROADCAST_TERMS = 200_000


def tokens(text: Column) -> Column:
    """Retrieval tokens of a text: runs of ASCII letters and digits, or single Han characters, lower case. NULL gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def term_counts(docs: DataFrame, id_col: str, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, len): term frequencies and the length in tokens of each document; documents without tokens give no row.

    ``wanted`` (term), a small table, restricts the terms before anything is shuffled; lengths still count all tokens,
    and the rows of a document stay together, so that later sums per document need no shuffle.
    """
    listed = docs.select(F.col(id_col), tokens(text).alias("_t")).select(id_col, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    if wanted is not None:
        listed = listed.join(F.broadcast(wanted), "term", "left_semi").repartition(id_col)
    return listed.groupBy(id_col, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, query_id: str, query_text: Column, k1: float = 1.5, b: float = 0.75, distinct_query: bool = False) -> DataFrame:
    """(query_id, id, score): BM25 of every document that shares a term with a query, rounded to 6 places.

    Document frequencies and the average length are those of all documents, also of empty ones. Query tokens keep their
    repeats unless ``distinct_query``. Queries or documents without tokens give no row; NULL texts are empty. The query
    side goes to all tasks only while it has at most ``BROADCAST_TERMS`` rows, which is counted first; beyond that the
    counts are joined to it by term. The postings of query terms are written once and read for both uses.
    """
    queries, query_text = queries.select(F.col(query_id), query_text.alias("_q")), F.col("_q")
    docs, text = spread(docs.select(F.col(id_col), text.alias("_text"))), F.col("_text")
    lengths = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN)), F.lit(0))).alias("avg_len"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query_text)).alias("term"))
    asked = cut_lineage(asked.groupBy("query_id", "term").agg(F.lit(1).cast("bigint").alias("qtf") if distinct_query else F.count(F.lit(1)).alias("qtf")))
    wanted = asked.select("term").distinct()
    few = asked.count() <= BROADCAST_TERMS
    hits = cut_lineage(term_counts(docs, id_col, text, wanted) if few else term_counts(docs, id_col, text).join(wanted, "term", "left_semi"))
    frequencies = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(frequencies, "term").crossJoin(F.broadcast(lengths)).select("query_id", "term", "avg_len", (F.col("qtf") * idf).alias("w"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(F.lit(1.0), F.col("avg_len"))))
    scored = hits.join(F.broadcast(weights) if few else weights, "term").select("query_id", id_col, part.alias("part"))
    return scored.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 6).alias("score"))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of highest score of each query among parts of (query, id, score); ties go to the smaller id."""
    q, i, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], i[keep], s[keep]


def bm25_top_k(
    docs: DataFrame, queries: DataFrame, id_col: str, text: Column, query_id: str, query_text: Column, k: int, k1: float = 1.5, b: float = 0.75, distinct_query: bool = False, rank: str = "rank"
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` documents of highest BM25 for each query; as :func:`bm25` and :func:`top_k` give them.

    No pair of query and document is shuffled: a task scores its documents against the queries and passes on its best
    ``k`` per query, so what moves grows with tasks x queries. The queries are taken in blocks of about BROADCAST_TERMS
    (query, term) rows; for each block the documents are read once for the statistics of its terms and once for the scores.
    Ids must be whole numbers; rows with a NULL id give none.
    """
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.explode(tokens(query_text)).alias("term")).where("q is not null")
    asked = cut_lineage(asked.groupBy("q", "term").agg(F.lit(1).cast("bigint").alias("qtf") if distinct_query else F.count(F.lit(1)).alias("qtf")))
    blocks = max(1, -(-asked.count() // BROADCAST_TERMS))
    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("item_id"), text.cast("string").alias("body")))
    out = docs.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, score double")
    for n in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n)).toPandas()
        if len(part):
            out = out.unionByName(_bm25_block(rows, part, k, k1, b))
    return top_k(out, ["query_id"], [F.desc("score"), F.asc("item_id")], k, rank).withColumnRenamed("item_id", id_col)


def _bm25_block(rows: DataFrame, asked: pd.DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, item_id, score): the best ``k`` documents of each task for a block of queries (q, term, qtf)."""
    sc = rows.sparkSession.sparkContext
    terms = {t: n for n, t in enumerate(sorted(set(asked["term"])))}
    held = sc.broadcast(terms)
    find = re.compile(TOKEN).findall

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        df, docs, length = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = find((t or "").lower())
                docs, length = docs + 1, length + len(found)
                df[[number[w] for w in set(found) if w in number]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, length]))], names=["t", "n"])

    counted = {r.t: r.n for r in rows.select("body").mapInArrow(frequencies, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    n_docs, average = counted.get(-1, 0), max(1.0, counted.get(-2, 0) / max(1, counted.get(-1, 0)))
    t = asked["term"].map(terms).to_numpy(np.int64)
    df = np.array([counted.get(x, 0) for x in range(len(terms))], float)[t]
    names, q = np.unique(asked["q"].to_numpy(np.int64), return_inverse=True)
    weight = asked["qtf"].to_numpy(float) * np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * (k1 + 1)
    order = np.argsort(t, kind="stable")
    ends = np.searchsorted(t[order], np.arange(len(terms) + 1))
    shared = sc.broadcast((names, q[order].astype(np.int32), weight[order], ends))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        names, q, weight, ends = shared.value
        least = np.full(len(names), -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        step = max(1, min(256, 4_000_000 // len(names)))
        for batch in batches:
            items, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(items), step):
                ids, scores = [], []
                for item, text in zip(items[lo : lo + step], texts[lo : lo + step]):
                    found = find((text or "").lower())
                    counts = Counter(w for w in found if w in number)
                    if item is None or not counts:
                        continue
                    at = [number[w] for w in counts]
                    tf = np.fromiter(counts.values(), float, len(counts))
                    part = tf / (tf + k1 * (1 - b + b * len(found) / average))
                    spans = [slice(ends[x], ends[x + 1]) for x in at]
                    sizes = [x.stop - x.start for x in spans]
                    scores.append(np.bincount(np.concatenate([q[x] for x in spans]), np.concatenate([weight[x] for x in spans]) * np.repeat(part, sizes), len(names)))
                    ids.append(item)
                if ids:
                    table = np.round(np.array(scores), 6)
                    r, c = np.nonzero((table > 0) & (table >= least))
                    best = _best([best, (c.astype(np.int64), np.array(ids, np.int64)[r], table[r, c])], k)
                    full = np.bincount(best[0], minlength=len(names)) >= k
                    least = np.full(len(names), -np.inf)
                    np.minimum.at(low := np.full(len(names), np.inf), best[0], best[2])
                    least[full] = low[full]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "item_id", "score"])

    return rows.mapInArrow(score, "query_id bigint, item_id bigint, score double")


def top_k(scored: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows of rank 1..k per group, ranked by ``order``; Spark prunes groups before the shuffle (WindowGroupLimit)."""
    ranked = scored.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def max_normalised(score: str, group: list[str], weight: float) -> Column:
    """weight * score / max(score) within the group, 0 where the maximum is not positive or NULL."""
    top = F.max(score).over(Window.partitionBy(*group))
    return F.when(top > 0, weight * F.coalesce(F.col(score), F.lit(0.0)) / top).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_id: str, query_vector: str, k: int, block: int = 4_096) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of highest cosine with each query, scores rounded to 6 places, ties by id.

    Exact: every vector is compared with every query. The queries are read to the driver in blocks of ``block``, each
    block is broadcast, and a task passes on no more than its best ``k`` rows per query, so what is shuffled grows with
    tasks x queries, not with vectors x queries. NULL ids or vectors and vectors of length zero give no row.
    """
    schema = "query_id bigint, item_id bigint, score double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(vector_col).cast("array<double>").alias("v")).where("item_id is not null and size(v) > 0")
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("q is not null and size(v) > 0")

    def normal(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.linalg.norm(m, axis=1)
        return m[length > 0] / length[length > 0, None], length > 0

    def search(ids: list[int], matrix: np.ndarray) -> DataFrame:
        held = vectors.sparkSession.sparkContext.broadcast((np.array(ids), np.ascontiguousarray(matrix.T)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, targets = held.value
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat, sound = normal(np.array(batch.column(1).to_pylist(), float))
                items = batch.column(0).to_numpy()[sound]
                for lo in range(0, len(items), 2_048):
                    scores = np.round(flat[lo : lo + 2_048] @ targets, 6)
                    least = np.partition(scores, max(0, len(scores) - k), axis=0)[max(0, len(scores) - k)]
                    r, c = np.nonzero(scores >= least)
                    found = [_best([*found, (names[c], items[lo : lo + 2_048][r], scores[r, c])], k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["query_id", "item_id", "score"])

        return rows.mapInArrow(scan, schema)

    out, ids, vecs = None, [], []
    pending = asked.toLocalIterator(prefetchPartitions=True)
    for r in pending:
        ids.append(r.q)
        vecs.append(r.v)
        if len(ids) == block:
            matrix, sound = normal(np.array(vecs))
            part = search(np.array(ids)[sound].tolist(), matrix)
            out, ids, vecs = part if out is None else out.unionByName(part), [], []
    if ids:
        matrix, sound = normal(np.array(vecs))
        part = search(np.array(ids)[sound].tolist(), matrix)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return top_k(out, ["query_id"], [F.desc("score"), F.asc("item_id")], k).withColumnRenamed("item_id", id_col)


def unit(v: Column) -> Column:
    """Vector over its length; NULL for the zero vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def reciprocal_rank(*ranks: str, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the lists that hold the row; NULL ranks add nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return total


def round_robin_fuse(lists: DataFrame, group: list[str], id_col: str, list_col: str = "list_idx", rank_col: str = "rank") -> DataFrame:
    """(group, id, first_rank, first_list, position): rank-major, list-minor order, each id once, at its first place."""
    first = lists.groupBy(*group, id_col).agg(F.min(F.struct(F.col(rank_col).alias("first_rank"), F.col(list_col).alias("first_list"))).alias("at"))
    flat = first.select(*group, id_col, "at.first_rank", "at.first_list")
    return flat.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("first_rank", "first_list", id_col)))


def group_diverse(ranked: DataFrame, group: list[str], section: str, order: list[Column], k: int) -> DataFrame:
    """First row of each section in rank order, then the others by rank, at most k per group."""
    by_section = Window.partitionBy(*group, section).orderBy(*order)
    marked = ranked.withColumn("_later", (F.row_number().over(by_section) > 1).cast("int"))
    return top_k(marked, group, [F.col("_later").asc(), *order], k, "selected").drop("_later")


def domain_diverse(scored: DataFrame, group: list[str], domain: str, score: str, title: str, id_col: str, penalty: float = 30.0) -> DataFrame:
    """Rank of greedy selection by score minus ``penalty`` per earlier pick of the same domain; ties by title descending, then id.

    One domain or group may hold most of the rows.
    """
    tie = [F.desc_nulls_last(title), F.asc(id_col)]
    inside = running(scored, [*group, domain], [F.desc(score), *tie], "_in_domain")
    adjusted = inside.withColumn("adjusted", F.col(score) - penalty * (F.col("_in_domain") - 1)).drop("_in_domain")
    return running(adjusted, group, [F.desc("adjusted"), *tie], "rank")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def overlap_share(query: Column, text: Column) -> Column:
    """Share of the distinct query words that stand in the text; 0 for a query without words."""
    return F.size(F.array_intersect(query, text)) / F.greatest(F.lit(1), F.size(query))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words, joined by a blank."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): connected components over string edges; the component is its smallest node.

    Alternates large-star and small-star steps, each one aggregation by key, so that a hub's edges are spread over
    its neighbours; each round is written to the shared folder. Edges with NULL are left out.
    """
    pairs = edges.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    current = cut_lineage(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rows, weight = None, None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        new = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        current = cut_lineage(new)
        # edges only move to smaller nodes: an equal number of them with an equal sum of digests are the same edges
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == (rows, weight):
            break
        rows, weight = now
    roots = current.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
