"""Ranked lexical search over an index of document blocks.

Documents are indexed in blocks: each has a dictionary, and for every term the
documents that hold it with its occurrences.  A query is scored in every block
for itself, and Spark keeps the highest of all blocks.

Within a block, a query's lists are taken from the short end term at a time:
their contributions are summed in accumulators, which from then on are one more
list with an upper bound.  That list and the long lists are then walked document
at a time, stride by stride.  A list's bounds per window of documents tell which
windows can still reach the kth best score; strides without one are skipped in
all lists by their skip pointers, and in the others lists are added from the
highest bound down only while a document can still get there.

Scores are integers, so that any order of addition gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, mix, powers, raw_text, steps

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text bytes and documents of one block of the index.
BLOCK_BYTES, BLOCK_ROWS = 1 << 22, 1 << 15
#: Queries that meet a block of the index together.
QUERY_ROWS = 512
#: Documents of one window of bounds, and of one stride of the walk.
WINDOW, STRIDE = 64, 512
#: Queries whose kth best score a task remembers from block to block.
REMEMBERED = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "terms array<string>, df array<long>, documents long, n_terms long, ids binary, lengths binary, first binary, docs binary, times binary"


def terms_of(text: Column) -> Column:
    """Terms of a text with repeats, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _folded() -> np.ndarray:
    """A byte's lower-cased form, 0 where it parts terms."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    apart = np.ones(128, bool)
    apart[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    fold[:128][apart] = 0
    return fold


def _tokens(data: np.ndarray, bounds: np.ndarray):
    """Term starts and lengths, their hashes, and each text's first term, in texts laid end to end."""
    solid = data != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, bounds)
    if len(starts) == 0:
        return starts, starts, np.zeros(0, np.uint64), first
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], spans)
    inside = solid[starts[0] :]
    lengths = np.add.reduceat(inside.astype(np.int64), starts - starts[0])
    codes = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes[0] = 0
    coded = codes[data[starts[0] :]] * powers(np.uint64(0x9E3779B97F4A7C15), int(spans.max()))[place]
    return starts, lengths, mix(np.add.reduceat(coded, starts - starts[0])), first


def _indexed(column: pa.Array, ids: pa.Array) -> list[pa.Array] | None:
    """One block of the index from texts and ids: documents with a term, by ascending id and null ids last."""
    order = pc.array_sort_indices(ids)
    column, ids = column.take(order), ids.take(order)
    raw, bounds = raw_text(column)
    data = _folded()[raw]
    starts, lengths, hashes, first = _tokens(data, bounds)
    if len(starts) == 0:
        return None
    counts = np.diff(first)
    held = counts > 0
    doc = np.repeat(np.cumsum(held) - 1, counts)
    _, one, term = np.unique(hashes, return_index=True, return_inverse=True)
    n = int(held.sum())
    pairs, times = np.unique(term * n + doc, return_counts=True)
    df = np.bincount(pairs // n, minlength=len(one))
    spelled = data.tobytes()
    terms = [spelled[s : s + k].decode() for s, k in zip(starts[one].tolist(), lengths[one].tolist())]
    whole = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()])
    kept = ids.filter(pa.array(held))
    sink = pa.record_batch([kept], ["id"]).serialize().to_pybytes()
    return [
        pa.array([terms]), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([n]), pa.array([len(starts)]), pa.array([sink]),
        whole(counts[held], np.int64), whole(np.append(0, np.cumsum(df)), np.int64), whole(pairs % n, np.int32), whole(times, np.int32),
    ]


_IDS = pa.schema([("id", pa.int64())])


def index(docs: DataFrame) -> DataFrame:
    """Blocks of the index of ``docs(doc_id, text)``; documents without a term are in none.

    Memory per task is bounded by ``BLOCK_BYTES``, or by the longest text where
    that is longer.  Terms of a block are told apart by 64-bit hashes.
    """

    def run(batches):
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        for step in steps(batches, limit=BLOCK_BYTES, rows=BLOCK_ROWS):
            block = _indexed(step.column(1), step.column(0))
            if block is not None:
                yield pa.RecordBatch.from_arrays(block, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def _weighted(items: DataFrame, blocks: DataFrame, documents: int) -> DataFrame:
    """Queries (q, item_id, terms, weights): each distinct item's terms with repeats times weight."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_sort(terms_of(F.col("text"))).alias("words")).where(F.size("words") > 0).distinct()
    asked = cut(asked.withColumn("q", F.monotonically_increasing_id()))
    each = cut(asked.select("q", F.explode("words").alias("term")).groupBy("q", "term").agg(F.count("*").alias("repeats")))
    known = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    known = known.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    met = each.join(known, "term").select("q", F.struct("term", (weight * F.col("repeats")).alias("weight")).alias("x"))
    lists = met.groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return asked.select("q", "item_id").join(lists, "q").select("q", "item_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))


def _packed(rows: int):
    """Rows as blocks of at most ``rows``, one binary each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                table = pa.Table.from_batches([part]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()])], ["queries"])

    return run


class _Lists:
    """The lists of one block: documents, contributions before weighting, and their bounds, made when first asked for."""

    def __init__(self, row: dict, documents: int, length: int):
        self.first = np.frombuffer(row["first"], np.int64)
        self.docs, self.times = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["times"], np.int32)
        n = np.frombuffer(row["lengths"], np.int64)
        if 25 * int(n.max()) * documents < 2**63:
            share = 25 * n * documents // length
        else:  # beyond 64 bits on the way
            share = np.array([25 * int(x) * documents // length for x in n], np.int64)
        self.m = 75 + share
        self.n = len(n)
        self.made: dict[int, tuple] = {}

    def length(self, term: int) -> int:
        return int(self.first[term + 1] - self.first[term])

    def get(self, term: int):
        """(documents, contributions, first posting of every window, highest contribution of every window)."""
        if term not in self.made:
            a, b = self.first[term], self.first[term + 1]
            docs, tf = self.docs[a:b], self.times[a:b].astype(np.int64)
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * self.m[docs])
            self.made[term] = (docs, part, *_bounds(docs, part, self.n))
        return self.made[term]


def _bounds(docs: np.ndarray, part: np.ndarray, n: int):
    windows = -(-n // WINDOW)
    skip = np.searchsorted(docs, np.arange(windows + 1) * WINDOW)
    highest = np.zeros(windows, np.int64)
    if len(docs):
        full = np.flatnonzero(skip[1:] > skip[:-1])
        highest[full] = np.maximum.reduceat(part, skip[:-1][full])
    return skip, highest


def _accumulated(lists: _Lists, short: list[tuple[int, int]]):
    """The summed contributions of the short lists as one list."""
    docs = np.concatenate([lists.get(t)[0] for t, _ in short])
    part = np.concatenate([lists.get(t)[1] * w for t, w in short])
    order = np.argsort(docs, kind="stable")
    docs, part = docs[order], part[order]
    at = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    docs, part = docs[at], np.add.reduceat(part, at)
    return docs, part, *_bounds(docs, part, lists.n)


def _search(lists: _Lists, query: list[tuple[int, int]], k: int, floor: int, budget: int):
    """Places and scores of the block's documents that can be among the k best; ``floor`` is a score that k documents elsewhere reach.

    ``query`` has (term, weight).  Lists are accumulated from the shortest on while they have ``budget`` postings together.
    """
    query = sorted(query, key=lambda x: (lists.length(x[0]), x[0]))
    total, few = 0, 0
    for t, _ in query:
        total += lists.length(t)
        if total > budget and few:
            break
        few += 1
    walked = [(*_accumulated(lists, query[:few]), 1)] + [(*lists.get(t), w) for t, w in query[few:]]
    walked.sort(key=lambda x: -int(x[3].max()) * x[4])
    window_bound = sum(x[3] * x[4] for x in walked)
    best = np.zeros(0, np.int64)
    places = np.zeros(0, np.int64)
    per = STRIDE // WINDOW
    for s in range(0, len(window_bound), per):
        need = floor if len(best) < k else max(floor, int(best.min()) + 1)  # later documents lose ties
        need = max(need, 1)
        alive = window_bound[s : s + per] >= need
        if not alive.any():
            continue
        base, size = s * WINDOW, min(STRIDE, lists.n - s * WINDOW)
        score = np.zeros(size, np.int64)
        open_docs = np.repeat(alive, WINDOW)[:size]
        highs = [int(x[3][s : s + per].max()) * x[4] for x in walked]
        rest = sum(highs)
        for (docs, part, skip, _, weight), high in zip(walked, highs):
            if high:
                a, b = skip[s], skip[min(s + per, len(skip) - 1)]
                score[docs[a:b] - base] += part[a:b] * weight
                rest -= high
                if rest and not (open_docs & (score + rest >= need)).any():
                    break
        else:
            found = np.flatnonzero(open_docs & (score >= need))
            best, places = np.append(best, score[found]), np.append(places, found + base)
            if len(best) > k:
                kept = np.sort(np.lexsort((places, -best))[:k])
                best, places = best[kept], places[kept]
    return places, best


def _scored(k: int, documents: int, length: int, budget_share: float):
    def run(batches):
        reached: dict[int, np.ndarray] = {}
        last, lists, words = None, None, None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if last != (row["ids"], row["docs"]):  # the same block meets one set of queries after another
                    last, lists, words = (row["ids"], row["docs"]), _Lists(row, documents, length), pa.array(row["terms"], pa.string())
                    ids = pa.ipc.read_record_batch(pa.py_buffer(row["ids"]), _IDS).column(0)
                queries = pa.ipc.open_stream(row["queries"]).read_all().combine_chunks()
                flat = queries["terms"].combine_chunks()
                terms = pc.fill_null(pc.index_in(flat.flatten(), value_set=words), -1).to_numpy()
                weights = queries["weights"].combine_chunks().flatten().to_numpy()
                upto = np.append(0, np.cumsum(pc.list_value_length(flat).to_numpy()))
                for i, q in enumerate(queries["q"].to_pylist()):
                    mine = slice(upto[i], upto[i + 1])
                    query = [(t, w) for t, w in zip(terms[mine].tolist(), weights[mine].tolist()) if t >= 0 and w > 0]
                    if not query:
                        continue
                    known = reached.get(q, np.zeros(0, np.int64))
                    places, scores = _search(lists, query, k, int(known.min()) if len(known) == k else 1, int(budget_share * lists.n))
                    if not len(places):
                        continue
                    if len(reached) >= REMEMBERED and q not in reached:
                        reached.clear()
                    reached[q] = np.sort(np.append(known, scores))[-k:]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), q)), ids.take(pa.array(places)), pa.array(scores)], ["q", "doc_id", "score"])

    return run


def _gathered(run, rows: int = 1 << 14):
    """The same rows in batches of about ``rows``."""

    def gather(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gather


def search(docs: DataFrame, items: DataFrame, k: int = 20, budget_share: float = 0.5) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank (int, from 1), doc_id, score.

    ``docs`` needs doc_id (integer) and text, ``items`` item_id (integer) and
    text; other columns are ignored.  Equal scores go by ascending doc_id, null
    ids last.  Only scores above 0 count; an item without such documents has no
    rows.  Short lists are accumulated while they have ``budget_share`` of a
    block's documents as postings together; any share gives the same result.

    Null and empty texts have no terms: as documents they count nowhere, as
    items they find nothing.  Rows that repeat a doc_id are documents each on its
    own.  Items of the same item_id and the same terms are one; of other terms,
    each has its own ranks.  Empty tables give an empty result.
    """
    blocks = cut(index(docs))
    documents, length = blocks.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    queries = cut(_weighted(items, blocks.select("terms", "df"), documents))
    groups = -(-queries.count() // QUERY_ROWS) or 1
    packed = cut(queries.select("q", "terms", "weights").repartition(groups).mapInArrow(_packed(QUERY_ROWS), "queries binary"))
    met = packed.crossJoin(blocks.drop("df", "documents", "n_terms"))  # blocks with blocks
    found = met.mapInArrow(_gathered(_scored(k, documents, max(length, 1), budget_share)), "q long, doc_id long, score long")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
