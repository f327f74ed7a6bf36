"""Held-out passages in a corpus, found by latent semantic retrieval.

Passages are windows of 16 words, one every 4 words, of which at least 13, for paraphrases 10, are words of the held-out
pool; 13 shared words in a row always lie in one of them. Over the damped TF-IDF matrix of all passages of the corpus and the pool a
randomised SVD is computed in a distributed way: each task multiplies its rows with a random matrix and back, and
the products, whose size depends on the pool's vocabulary only, are summed block by block in a shuffle. In the latent
space, every passage of the corpus is compared with all passages of the pool by cosine. For the candidates follow the
longest common subsequence, the longest run of equal words, and the answer check: whether the document also holds
the rarest words of the other side of the question (the accepted answer of a problem, the problem of an answer).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evifold.plans.checkpoints import cut_lineage

RUN, WIDTH, STRIDE = 13, 16, 4
RANK, OVERSAMPLING, ROUNDS, SEED = 128, 16, 3, 20_261_126
#: Exponent of the inverse document frequency; under 1 so that a rare word beside a shared run doesn't hide it.
DAMPING = 0.5
COSINE = 0.62
#: Of a paraphrased passage: pool words in it, words of the common subsequence, passages, rarest words, share of them.
NEAR_WORDS, LCS_LEAST, NEAR_LEAST, KEYS, KEYS_SHARE = 10, 10, 2, 16, 0.5
#: Share of the rarest words of the question's other side with which one passage is enough.
OTHER_SHARE = 0.5
#: Fewest words of a problem or answer under RUN words that is looked for word by word; below, any text may hold it by chance.
SHORT_LEAST = 4
#: Character of words that the pool doesn't have; numbers of words begin at 1.
UNKNOWN = "\0"
#: Most passages of the pool that are broadcast at a time (about 512 bytes each); more are taken in blocks.
BLOCK = 40_000
#: Most rows and words of the pool that are read to the driver at a time; a larger pool is taken in blocks of it.
POOL_ROWS, POOL_WORDS = 100_000, 1_000_000
#: Blocks of rows of a matrix that are summed by themselves.
MATRIX_BLOCKS = 8

_WORD = re.compile(r"[^\W_]+")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^\\W_\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")


def words(text: str, unspaced: bool = False) -> list[str]:
    """Words of a text: runs of letters and digits, case folded in full; with ``unspaced`` each Thai, kana or Han character is one."""
    return (_UNSPACED if unspaced else _WORD).findall(text.casefold())


@dataclass
class Pool:
    """Held-out passages as strings of one character per word, and their windows as arrays of word numbers."""

    vocabulary: dict[str, int]
    passages: list[str]
    questions: list[str]
    fields: list[str]
    windows: np.ndarray
    passage_of: np.ndarray
    short: list[tuple[list[int], str, str]] = field(default_factory=list)
    sides: dict[tuple[str, str], set[int]] = field(default_factory=dict)


def _char(number: int) -> str:
    """One character per word number; surrogates are passed over."""
    return chr(number if number < 0xD800 else number + 0x800)


def _number(char: str) -> int:
    return ord(char) if ord(char) < 0xD800 else ord(char) - 0x800


def _pool(rows: list[Row], unspaced: bool) -> list[Pool]:
    """Rows of the pool in one block or, where their words don't fit, in several."""
    vocabulary: dict[str, int] = {}
    out = Pool(vocabulary, [], [], [], np.zeros((0, WIDTH), np.uint32), np.zeros(0, np.int32))
    windows, owner = [], []
    for q, p, a in sorted((str(r.q), r.p or "", r.a or "") for r in rows if r.q is not None):
        for name, text in (("problem", p), ("accepted_answer", a)):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text, unspaced)]
            out.sides.setdefault((q, name), set()).update(ids)
            if len(ids) < RUN:
                if len(ids) >= SHORT_LEAST:
                    out.short.append((ids, q, name))
                continue
            for s in range(0, len(ids) - RUN + 1, STRIDE):
                x = ids[s : s + WIDTH]
                windows.append(x + [0] * (WIDTH - len(x)))
                owner.append(len(out.passages))
            out.passages.append("".join(map(_char, ids)))
            out.questions.append(q)
            out.fields.append(name)
        if len(vocabulary) > POOL_WORDS and len(rows) > 1:
            return [x for half in (rows[::2], rows[1::2]) for x in _pool(half, unspaced)]
    if windows:
        out.windows, out.passage_of = np.array(windows, np.uint32), np.array(owner, np.int32)
    return [out]


def read_pools(pool: DataFrame, id_col: str = "question_id", problem_col: str = "problem", answer_col: str = "accepted_answer", unspaced: bool = False) -> Iterator[Pool]:
    """The pool, brought to the driver block by block; rows that stand twice are taken once, NULL ids not at all.

    Passages are made of texts of RUN words or more, shorter ones are kept as ``short``.
    """
    rows = pool.select(F.col(id_col).alias("q"), F.col(problem_col).alias("p"), F.col(answer_col).alias("a")).distinct()
    blocks = max(1, -(-rows.count() // POOL_ROWS))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k)
        yield from _pool(part.collect(), unspaced)


def corpus_windows(df: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str, least: int = RUN, unspaced: bool = False) -> DataFrame:
    """(item_id, ids, held): the passages of each text with at least ``least`` pool words, as little-endian 32-bit word numbers.

    ``held`` are all pool words of the text, in the first of its passages only; the passages of a text follow each other.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            at, blobs, held = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = words(text, unspaced)
                n = len(found)
                if n < least:
                    continue
                ids = np.fromiter((number(w, 0) for w in found), np.uint32, n)
                known = np.concatenate(([0], np.cumsum(ids > 0)))
                starts = np.arange(0, n - least + 1, STRIDE)
                starts = starts[known[np.minimum(starts + WIDTH, n)] - known[starts] >= least]
                if len(starts):
                    at += [row] * len(starts)
                    held += [np.unique(ids[ids > 0]).tobytes()] + [None] * (len(starts) - 1)
                    ids = np.concatenate((ids, np.zeros(WIDTH, np.uint32)))
                    blobs += [ids[s : s + WIDTH].tobytes() for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(blobs, pa.binary()), pa.array(held, pa.binary())], names=["item_id", "ids", "held"]
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"))
    shortest = least if unspaced else 2 * least - 1
    return rows.where(f"length(body) >= {shortest} and item_id is not null").mapInArrow(scan, "item_id bigint, ids binary, held binary")


def short_matches(df: DataFrame, pool: Pool, id_col: str, text_col: str, unspaced: bool = False) -> DataFrame:
    """(item_id, question_id, field, run_words): texts that hold a problem or answer of SHORT_LEAST up to RUN words, word by word."""
    by_rarest: dict[str, list[tuple[int, list[str], str, str]]] = {}
    names = {n: w for w, n in pool.vocabulary.items()}
    count: dict[int, int] = {}
    for ids, _, _ in pool.short:
        for i in ids:
            count[i] = count.get(i, 0) + 1
    for ids, q, name in pool.short:
        at = min(range(len(ids)), key=lambda k: (count[ids[k]], -len(names[ids[k]]), k))
        by_rarest.setdefault(names[ids[at]], []).append((at, [names[i] for i in ids], q, name))
    shared = df.sparkSession.sparkContext.broadcast(by_rarest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = shared.value
        for batch in batches:
            out: set[tuple] = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text, unspaced)
                for k, w in enumerate(found):
                    for at, whole, q, name in looked.get(w, ()):
                        if k >= at and found[k - at : k - at + len(whole)] == whole:
                            out.add((item, q, name, len(whole)))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in sorted(out)], schema=arrow)

    arrow = pa.schema([("item_id", pa.int64()), ("question_id", pa.string()), ("field", pa.string()), ("run_words", pa.int32())])
    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body")).where("length(body) > 0 and item_id is not null")
    return rows.mapInArrow(scan, "item_id bigint, question_id string, field string, run_words int")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint32).reshape(-1, WIDTH)


def tree_sum(windows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all batches of ``partial(ids)``, an array of ``shape``: in each task, then by blocks of rows in two shuffles.

    A reducer holds one block at a time, and the driver gets each block once, so what moves to it is one array of
    ``shape``, however many tasks there are.
    """
    ends = np.linspace(0, shape[0], MATRIX_BLOCKS + 1).astype(int)
    tasks = windows.rdd.getNumPartitions()
    lanes = int(np.ceil(np.sqrt(tasks)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0).to_pylist()))
        lane = TaskContext.get().partitionId() % lanes
        parts = [total[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(range(MATRIX_BLOCKS), pa.int32()), pa.array([lane] * MATRIX_BLOCKS, pa.int32()), pa.array(parts, pa.binary())], names=["block", "lane", "part"])

    parts = windows.select("ids").mapInArrow(fold, "block int, lane int, part binary").rdd.map(lambda r: ((r[0], r[1]), np.frombuffer(r[2])))
    if lanes > 8:
        parts = parts.reduceByKey(np.add, min(tasks, MATRIX_BLOCKS * lanes))
    blocks = dict(parts.map(lambda x: (x[0][0], x[1])).reduceByKey(np.add, MATRIX_BLOCKS).collect())
    return np.concatenate([blocks.get(k, np.zeros(0)) for k in range(MATRIX_BLOCKS)]).reshape(shape) if blocks else np.zeros(shape)


def _times(ids: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of the normalised TF-IDF matrix times ``basis`` (terms x columns)."""
    w = _row_weights(ids, weights)
    out = np.zeros((len(ids), basis.shape[1]), basis.dtype)
    for k in range(ids.shape[1]):
        out += w[:, k, None] * basis[ids[:, k]]
    return out


def _row_weights(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of each position: a word that stands c times has sqrt(c) in all, dealt evenly; rows have length one."""
    count = (ids[:, :, None] == ids[:, None, :]).sum(axis=2)
    term = weights[ids]
    norm = np.sqrt((term * term).sum(axis=1, keepdims=True))  # c positions with squares of 1 each: sqrt(c) squared
    return (term / np.sqrt(count) / np.maximum(norm, 1e-12)).astype(np.float32)


def _back(ids: np.ndarray, weights: np.ndarray, product: np.ndarray, terms: int) -> np.ndarray:
    """Transposed matrix times ``product``."""
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
    scaled = product[order // ids.shape[1]] * _row_weights(ids, weights).ravel()[order, None]
    out = np.zeros((terms, product.shape[1]))
    out[flat[order][heads]] = np.add.reduceat(scaled, heads, axis=0)
    return out


def document_frequencies(ids: np.ndarray, terms: int) -> np.ndarray:
    """Number of passages that hold each term; passages are rows."""
    s = np.sort(ids, axis=1)
    first = np.concatenate((np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]), axis=1)
    return np.bincount(s[first], minlength=terms).astype(float)


def latent_space(windows: DataFrame, pool: Pool, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(weights, basis): term weights over all passages, and the leading right singular vectors of their matrix."""
    terms = len(pool.vocabulary) + 1
    counts = tree_sum(windows, lambda ids: np.concatenate((document_frequencies(ids, terms), [len(ids)])), (terms + 1,))
    counts += np.concatenate((document_frequencies(pool.windows, terms), [len(pool.windows)]))
    weights = np.log(1 + counts[-1] / (1 + counts[:-1])) ** DAMPING
    weights[0] = 0
    width = min(rank + OVERSAMPLING, terms)
    basis = np.random.RandomState(SEED).standard_normal((terms, width)).astype(np.float32)

    def product(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
        return sum((_back(x, weights, _times(x, weights, held), terms) for x in np.array_split(ids, -(-len(ids) // 4096))), np.zeros((terms, width)))

    for _ in range(ROUNDS):
        held = basis
        total = tree_sum(windows, lambda ids, held=held: product(ids, held), (terms, width)) + product(pool.windows, held)
        basis = np.linalg.qr(total)[0].astype(np.float32)

    def gram(ids: np.ndarray) -> np.ndarray:
        b = _times(ids, weights, basis).astype(float)
        return b.T @ b

    values, vectors = np.linalg.eigh(tree_sum(windows, gram, (width, width)) + gram(pool.windows))
    lead = vectors[:, np.argsort(-values)[: min(rank, width)]].astype(np.float32)
    return weights, basis @ lead


def _latent(ids: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    x = _times(ids, weights, basis)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lcs_length(a: str, places: dict[str, int]) -> int:
    """Length of the longest common subsequence of ``a`` and a string given as bit sets of the places of each character."""
    full = (1 << places[""]) - 1
    v = full
    for c in a:
        m = places.get(c, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return places[""] - v.bit_count()


def _places(text: str) -> dict[str, int]:
    out: dict[str, int] = {"": len(text)}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


FOUND = "item_id bigint, question_id string, field string, run_words int, lcs_words int, keys int, least_keys int, passages int, other_share double, cosine double"


def find_leaks(
    df: DataFrame, pool_df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paraphrases: bool = True, rank: int = RANK, cosine: float = COSINE
) -> DataFrame:
    """(item_id, question_id, field, kind, run_words, lcs_words, passages, other_share, cosine): held-out passages in the texts.

    ``kind`` is 'verbatim' where a text and the problem or accepted answer share at least 13 words in a row. With
    ``paraphrases`` it is 'short' where a problem or answer of 4 to 12 words stands in the text as it is, and
    'paraphrase' where passages share a subsequence of 10 of their 16 words with it and half of its 16 rarest words
    stand in them: at least two such passages, or one if the answer check holds, that is if the text has half of
    the rarest words of the question's other side (``other_share``). Paraphrases are also looked for in scripts without
    blanks, each character being a word there, and so is 'verbatim' then. ``run_words`` counts at most the 16 words of
    a passage. NULL and empty texts and an empty pool or corpus give no rows; rows that stand twice give one. Names of
    other columns don't matter. The pool comes to the driver in blocks of POOL_ROWS rows.
    """
    found = df.sparkSession.createDataFrame([], FOUND)
    for pool in read_pools(pool_df, unspaced=paraphrases):
        if len(pool.windows):
            windows = cut_lineage(corpus_windows(df, pool.vocabulary, id_col, text_col, NEAR_WORDS if paraphrases else RUN, paraphrases))
            weights, basis = latent_space(windows, pool, rank)
            for lo in range(0, len(pool.windows), BLOCK):
                found = found.unionByName(_candidates(windows, pool, slice(lo, lo + BLOCK), weights, basis, paraphrases, cosine))
        if pool.short and paraphrases:
            found = found.unionByName(short_matches(df, pool, id_col, text_col, paraphrases), allowMissingColumns=True)
    pairs = found.groupBy("item_id", "question_id", "field").agg(
        F.max("run_words").alias("run_words"), F.max("lcs_words").alias("lcs_words"), F.bit_or("keys").alias("keys"), F.max("least_keys").alias("least_keys"),
        F.sum("passages").cast("int").alias("passages"), F.max("other_share").alias("other_share"), F.round(F.max("cosine"), 3).alias("cosine"),
    )
    own = F.bit_count("keys") >= F.col("least_keys")
    near = own & ((F.col("passages") >= NEAR_LEAST) | (F.col("passages") >= 1) & (F.col("other_share") >= OTHER_SHARE))
    kind = F.when(F.col("run_words") >= RUN, "verbatim").when(F.col("cosine").isNull(), "short").when(near, "paraphrase")
    return pairs.withColumn("kind", kind).where("kind is not null").select("item_id", "question_id", "field", "kind", "run_words", "lcs_words", "passages", "other_share", "cosine")


def _rarest(ids: set[int], weights: np.ndarray) -> list[int]:
    return sorted(ids, key=lambda t: (-weights[t], t))[:KEYS]


def _longest_run(window: str, held: str) -> int:
    """Longest stretch of at least RUN words of a window that stands in ``held``; 0 if there is none."""
    for n in range(WIDTH, RUN - 1, -1):
        if any(UNKNOWN not in (g := window[k : k + n]) and g in held for k in range(WIDTH - n + 1)):
            return n
    return 0


def lcs_lengths(windows: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of word numbers, pair by pair; 0 is no word and equals nothing."""
    best = np.zeros((len(windows), passages.shape[1] + 1), np.int16)
    for k in range(windows.shape[1]):
        w = windows[:, k, None]
        step = np.maximum(best[:, 1:], best[:, :-1] + ((passages == w) & (w > 0)))
        np.maximum.accumulate(step, axis=1, out=best[:, 1:])
    return best[:, -1]


#: Bytes of a table of the words of each passage, by which pairs are told apart at once; without it all are compared.
MEMBER_BYTES = 200_000_000
#: Cells of the tables that are filled at a time for the common subsequences; bounds memory, not results.
CELLS = 8_000_000


def _pair_lengths(ids: np.ndarray, rows: np.ndarray, held: np.ndarray, words_of: list[np.ndarray]) -> np.ndarray:
    """Lengths of the common subsequences of windows ``ids[rows]`` and passages ``held``, in slices of CELLS."""
    out = np.zeros(len(rows), np.int16)
    sizes = np.array([len(words_of[p]) for p in held])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // (sizes[order[at]] + 1))
        part = order[at : at + n]
        part = part[: max(1, int(np.searchsorted(sizes[part], 2 * sizes[order[at]], "right")))]
        known, where = np.unique(held[part], return_inverse=True)
        table = np.zeros((len(known), max(len(words_of[p]) for p in known)), np.uint32)
        for r, p in enumerate(known):
            table[r, : len(words_of[p])] = words_of[p]
        out[part] = lcs_lengths(ids[rows[part]], table[where])
        at += len(part)
    return out


def _candidates(windows: DataFrame, pool: Pool, block: slice, weights: np.ndarray, basis: np.ndarray, paraphrases: bool, cosine: float) -> DataFrame:
    """Passages of the corpus with the passages of one block of the pool near them, after the checks, summed up per batch."""
    numbers = [np.fromiter(map(_number, text), np.uint32, len(text)) for text in pool.passages]
    rare = np.zeros((len(numbers), KEYS), np.uint32)
    for p, ids in enumerate(numbers):
        keys = _rarest(set(ids.tolist()), weights)
        rare[p, : len(keys)] = keys
    opposite = {"problem": "accepted_answer", "accepted_answer": "problem"}
    other = [np.array(_rarest(pool.sides[q, opposite[name]], weights), np.uint32) for q, name in zip(pool.questions, pool.fields)]
    targets = np.ascontiguousarray(_latent(pool.windows[block], weights, basis).T)
    shared = windows.sparkSession.sparkContext.broadcast((weights, basis, targets, pool.passage_of[block], pool.passages, numbers, pool.questions, pool.fields, rare, other))
    least = LCS_LEAST if paraphrases else RUN

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis, targets, owner, passages, numbers, questions, fields, rare, other = shared.value
        needed = np.ceil(KEYS_SHARE * (rare > 0).sum(axis=1)).astype(np.int32)
        bit = (1 << np.arange(KEYS)).astype(np.int32)
        member = None
        if len(passages) * len(weights) <= MEMBER_BYTES:
            member = np.zeros((len(passages), len(weights)), bool)
            for p, words_of in enumerate(numbers):
                member[p, words_of] = True
        document = np.zeros(0, np.uint32)
        for batch in batches:
            matrix, items = _matrix(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            opened = [k for k, h in enumerate(batch.column(2).is_valid().to_pylist()) if h]
            texts = [document, *(np.frombuffer(batch.column(2)[k].as_py(), np.uint32) for k in opened)]
            text_of = np.searchsorted(opened, np.arange(len(matrix)), "right")
            parts: list[tuple[np.ndarray, ...]] = []
            for lo in range(0, len(matrix), 256):
                ids = matrix[lo : lo + 256]
                near = _latent(ids, weights, basis) @ targets
                r, c = np.nonzero(near >= cosine)
                keys, where = np.unique(r.astype(np.int64) * len(passages) + owner[c], return_inverse=True)
                if not len(keys):
                    continue
                best = np.zeros(len(keys))
                np.maximum.at(best, where, near[r, c])
                row, held = np.divmod(keys, len(passages))
                if member is not None:  # no common subsequence is longer than the number of words in common
                    enough = member[held[:, None], ids[row]].sum(axis=1) >= least
                    row, held, best = row[enough], held[enough], best[enough]
                lcs = _pair_lengths(ids, row, held, numbers)
                row, held, lcs, best = (x[lcs >= least] for x in (row, held, lcs, best))
                run = np.zeros(len(row), np.int32)
                for n in np.flatnonzero(lcs >= RUN):
                    run[n] = _longest_run("".join(map(_char, ids[row[n]].tolist())), passages[held[n]])
                if not paraphrases:
                    row, held, lcs, best, run = (x[run > 0] for x in (row, held, lcs, best, run))
                bits = ((rare[held][:, :, None] == ids[row][:, None, :]) & (rare[held] > 0)[:, :, None]).any(axis=2) @ bit
                parts.append((text_of[lo + row], held, items[lo + row], run, lcs.astype(np.int32), bits.astype(np.int32), best))
            document = texts[-1]
            text, held, item, run, lcs, bits, best = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 7
            order = np.lexsort((held, text))
            text, held, item, run, lcs, bits, best = (x[order] for x in (text, held, item, run, lcs, bits, best))
            first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (held[1:] != held[:-1])))) if len(text) else np.zeros(0, np.int64)
            over = lambda f, x: f.reduceat(x, first) if len(first) else x[:0]
            owners = held[first]
            share = [float(np.isin(other[p], texts[t]).mean()) if len(other[p]) else 0.0 for t, p in zip(text[first], owners)]
            columns = [
                item[first], [questions[p] for p in owners], [fields[p] for p in owners], over(np.maximum, run), over(np.maximum, lcs), over(np.bitwise_or, bits), needed[owners],
                over(np.add, (lcs >= LCS_LEAST).astype(np.int32)), share, over(np.maximum, best),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in FOUND.split(", "))])
    return windows.mapInArrow(scan, FOUND)
