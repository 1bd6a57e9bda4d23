"""Exact ranked retrieval by dual-sorted wavelet trees, one a shard of documents.

A shard holds the posting lists of all its terms one after another, each ordered by impact, highest first. A wavelet
tree (in its matrix form) over the documents' places in that sequence keeps this order in each of its nodes, so the same
lists can be walked by document: a node is a range of documents, a term's part of it is an interval, and the first entry of
the interval is the term's largest impact there. The sum of those firsts bounds the score of every document of the node, and
at a leaf it is the score. Nodes are opened best bound first, until no bound reaches the k-th best score: the top k are exact.

``build`` makes the index in two passes over the texts. The first sums up documents and terms, which impacts hang on. The second
counts terms shard by shard, sorts the lists by impact and writes the tree's bits. Texts never cross the network. A shard is some
8 MB and a file of its own: Parquet counts a hundred rows before it looks at their size, and its readers take whole pages, so
files of several shards would be held whole in a task. ``search`` reads the index once for each block of items, and sends only each shard's k best.

Defined cases: a null text, or one without terms, is in no list and isn't counted; each row is a document of its own, and equal
scores go by ascending id, null ids last; items without terms get no rows; equal rows of items count once, and
different texts of one item id are one item with all their terms; an empty corpus or item table gives no rows; other
columns are ignored. A very long text is counted in pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from fathomline.llm.arrowmap import map_text, tidy
from fathomline.llm.textkit import ALNUM_WORDS, SEPARATOR, SEPARATOR_BYTE, slices, text_bytes
from fathomline.scratch import Scratch

#: A shard ends at so many documents or postings; a tree of 2^20 postings is about 100 MB while it is searched.
SHARD_DOCS, SHARD_POSTINGS = 1 << 13, 1 << 20
#: Bytes of a text whose words are held at once.
PIECE_BYTES = 1 << 19
#: Pairs of item and term in one broadcast, about 100 bytes each.
BLOCK_TERMS = 200_000
#: Nodes opened at once at most.
BATCH = 64
#: Constants of the score.
FLAT, SLOPE, SCALE, TF_SCALE, M_SCALE = 25, 75, 1_000_000_000, 1000, 8


def count_terms(text: str | None) -> Counter[bytes]:
    """How often each term is in a text."""
    words = (text or "").encode().translate(bytes(ALNUM_WORDS)).split(SEPARATOR_BYTE)
    return Counter(w for w in words if w)


def _begins(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin, of places that are inside of words; none goes on in the next text."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    return begins


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The row of each word of some texts, and the words."""
    low = ALNUM_WORDS[data]
    inside = low != SEPARATOR
    begins = _begins(inside, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[begins]
    letters = low[inside]
    starts = np.append(np.cumsum(inside)[begins] - 1, len(letters))
    return row, pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(letters))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows in pieces of about PIECE_BYTES: the first row, bytes and offsets. A longer text is cut between words."""
    for a, b in slices(offsets, PIECE_BYTES):
        at, end = int(offsets[a]), int(offsets[b])
        while b - a == 1 and end - at > 2 * PIECE_BYTES:
            gap = np.flatnonzero(ALNUM_WORDS[data[at + PIECE_BYTES : min(end, at + 2 * PIECE_BYTES)]] == SEPARATOR)
            if not len(gap):
                break
            cut = at + PIECE_BYTES + int(gap[0])
            yield a, data[at:cut], np.array([0, cut - at])
            at = cut
        yield a, data[at:end], np.maximum(offsets[a : b + 1], at) - at


class _Lists:
    """The postings of a shard as they grow: by piece, the documents' places, terms and counts."""

    def __init__(self):
        self.ids: list = []
        self.doc: list[np.ndarray] = []
        self.term: list[pa.Array] = []
        self.tf: list[np.ndarray] = []
        self.postings = 0

    def add(self, ids: list, pieces: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Some documents, or all pieces of a long one."""
        for _, data, offsets in pieces:
            row, words = words_of(data, offsets)
            coded = words.dictionary_encode()
            size = max(1, len(coded.dictionary))
            key, tf = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            self.doc.append(key // size + len(self.ids))
            self.term.append(pa.DictionaryArray.from_arrays(pa.array(key % size, pa.int32()), coded.dictionary))
            self.tf.append(tf)
            self.postings += len(key)
        self.ids += ids

    def full(self, docs: int, postings: int) -> bool:
        return len(self.ids) >= docs or self.postings >= postings

    def shard(self, n_docs: int, n_terms: int) -> list | None:
        """The ids of the documents with terms in their order, terms, how many documents have each, and the postings by term, impact downwards and place."""
        doc, tf = np.concatenate(self.doc), np.concatenate(self.tf)
        if not len(doc):
            return None
        coded = pa.chunked_array(self.term).unify_dictionaries()
        terms, term = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        rows = len(self.ids)
        key = term * rows + doc
        order = np.argsort(key, kind="stable")  # a long text has a term in several pieces
        key, first = np.unique(key[order], return_index=True)
        tf = np.add.reduceat(tf[order], first)
        term, doc = np.divmod(key, rows)
        sizes = np.bincount(doc, weights=tf, minlength=rows).astype(np.int64)
        order = sorted(np.flatnonzero(sizes).tolist(), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        place, n = np.empty(rows, np.int64), len(order)
        place[order] = np.arange(n)
        impact = impacts(tf, sizes[doc], n_docs, n_terms)
        # One number orders the postings.
        most = SCALE // TF_SCALE
        key, doc = np.divmod(np.sort((term * (most + 1) + most - impact) * n + place[doc]), n)
        dfs = np.bincount(term, minlength=len(terms))
        return [[self.ids[i] for i in order], terms, dfs, (most - key % (most + 1)).astype(np.int32).tobytes(), tree_bits(doc, depth(n)).tobytes()]


def _row(values: list, arrow: pa.Schema) -> pa.RecordBatch:
    """A batch of one row; a list column's values may be an Arrow or numpy array."""
    columns = []
    for v, f in zip(values, arrow):
        if pa.types.is_list(f.type):
            v = v if isinstance(v, pa.Array) else pa.array(v, f.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(f.type.value_type)))
        else:
            columns.append(pa.array([v], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(arrow, columns)]))


def _sizes(texts: DataFrame) -> DataFrame:
    """(docs, terms) of parts of the texts: how many have terms, and all their terms."""
    schema = StructType([StructField("docs", LongType()), StructField("terms", LongType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            sizes = np.zeros(batch.num_rows, np.int64)
            for a, piece, ends in _pieces(data, offsets):
                words = np.append(0, np.cumsum(_begins(ALNUM_WORDS[piece] != SEPARATOR, ends)))
                sizes[a : a + len(ends) - 1] += np.diff(words[ends])
            yield pa.RecordBatch.from_pylist([{"docs": int((sizes > 0).sum()), "terms": int(sizes.sum())}], to_arrow_schema(schema))

    return texts.mapInArrow(tidy(run), schema)


def _shards(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row a shard of ``rows`` (id, text): see ``_Lists.shard``."""
    id_type = rows.schema["id"].dataType
    schema = StructType([StructField("ids", ArrayType(id_type)), StructField("terms", ArrayType(StringType())), StructField("dfs", ArrayType(IntegerType())), StructField("impacts", BinaryType()), StructField("bits", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        lists = _Lists()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, ends = batch.column(0).to_pylist(), dict(slices(offsets, PIECE_BYTES))
            for a, pieces in groupby(_pieces(data, offsets), key=lambda p: p[0]):
                lists.add(ids[a : ends[a]], pieces)
                if lists.full(SHARD_DOCS, SHARD_POSTINGS):
                    if made := lists.shard(n_docs, n_terms):
                        yield _row(made, arrow)
                    lists = _Lists()
        if lists.ids and (made := lists.shard(n_docs, n_terms)):
            yield _row(made, arrow)

    return rows.mapInArrow(tidy(run), schema)


# --- the tree -----------------------------------------------------------------------------------------------------------


def depth(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def tree_bits(docs: np.ndarray, levels: int) -> np.ndarray:
    """The bits of each level, packed: at level l an entry's bit is bit l of its document's place, from the top; zeros go before ones."""
    out = []
    for level in range(levels):
        ones = (docs >> (levels - 1 - level)) & 1 == 1
        out.append(np.packbits(ones))
        docs = np.concatenate([docs[~ones], docs[ones]])
    return np.array(out, np.uint8).reshape(levels, -1)


class Tree:
    """Wavelet matrix over the places of documents, with the impacts in the order of every level."""

    def __init__(self, packed: np.ndarray, impacts: np.ndarray, n_docs: int):
        n, self.levels, self.n_docs = len(impacts), len(packed), n_docs
        self.width = n + 1
        zeros = np.zeros((self.levels, n + 1), np.int32)
        impact = np.zeros((self.levels + 1, n + 1), np.int32)
        impact[0, :n] = impacts
        for level in range(self.levels):
            ones = np.unpackbits(packed[level], count=n).view(bool)
            np.cumsum(~ones, out=zeros[level, 1:])
            split = zeros[level, n]
            impact[level + 1, :split], impact[level + 1, split:n] = impact[level, :n][~ones], impact[level, :n][ones]
        self.split = zeros[:, n].astype(np.int64)
        self.zeros, self.impact = zeros.ravel(), impact.ravel()

    def top(self, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, place) of the k documents of the highest scores above 0; equal scores by place."""
        level, low, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        interval = np.stack([starts, ends])[None].astype(np.int64)  # node, start or end, term
        best: list[tuple[int, int]] = []
        least, take = 1, 1
        while len(bound):
            rest = np.zeros(len(bound), bool)
            if len(bound) > take:
                rest[np.argpartition(-bound, take)[take:]] = True
            at, wide = level[~rest], interval[~rest]
            left = self.zeros.take(wide + (at * self.width)[:, None, None])
            opened = np.concatenate([left, wide - left + self.split[at][:, None, None]])
            at = np.concatenate([at, at]) + 1
            lows = np.concatenate([low[~rest], low[~rest] + (1 << (self.levels - at[: len(left)]))])
            firsts = self.impact.take(opened[:, 0] + (at * self.width)[:, None])
            bounds = (firsts * (opened[:, 0] < opened[:, 1])) @ weights
            some = bounds >= least
            if (leaf := some & (at == self.levels)).any():
                best = sorted([*best, *zip(bounds[leaf].tolist(), lows[leaf].tolist())], key=lambda b: (-b[0], b[1]))[:k]
                if len(best) == k:
                    least = max(least, best[-1][0])
            go, rest = (at < self.levels) & (bounds >= least), rest & (bound >= least)
            level, low = np.concatenate([level[rest], at[go]]), np.concatenate([low[rest], lows[go]])
            bound, interval = np.concatenate([bound[rest], bounds[go]]), np.concatenate([interval[rest], opened[go]])
            take = min(2 * take, BATCH)
        return best


def impacts(tfs: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of the score that doesn't hang on the term: tf damped by the document's size."""
    m = FLAT + (SLOPE * sizes * n_docs) // n_terms
    return (SCALE * tfs) // (TF_SCALE * tfs + M_SCALE * m)


# --- the index ----------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """Shards of dual-sorted lists, the number of documents with terms, and of all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Indexes every term of every text."""
    store = Scratch(spark, "wavelet")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    n_docs, n_terms = _sizes(rows.select("text")).agg(F.sum("docs"), F.sum("terms")).first()
    return Index(store.save(_shards(rows, n_docs or 0, n_terms or 0), "shards", maxRecordsPerFile=1), n_docs or 0, n_terms or 0)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each row by column name: Arrow arrays of list columns, bytes of others."""
    for i in range(batch.num_rows):
        yield {f.name: c[i].values if pa.types.is_list(f.type) else c[i].as_py() for f, c in zip(batch.schema, batch.columns)}


# --- search -------------------------------------------------------------------------------------------------------------


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term, n): the terms of each item and how often it has them."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct()
    pairs = StructType([StructField("pairs", ArrayType(StructType([StructField("term", StringType()), StructField("n", LongType())])))])

    def make():
        return lambda column: [pa.array([[{"term": w.decode(), "n": n} for w, n in count_terms(t).items()] for t in column.to_pylist()], to_arrow_schema(pairs).field(0).type)]

    each = map_text(rows, "text", make, pairs, ["item_id"]).select("item_id", F.explode("pairs").alias("p"))
    return each.groupBy("item_id", F.col("p.term").alias("term")).agg(F.sum("p.n").alias("n"))


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The k documents of the highest scores of each item: item_id, rank, doc_id, score."""
    store = Scratch(spark, "ranked")
    terms = store.save(item_terms(items, item_id, text), "terms")
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    found = None
    for b in range(blocks):
        some = _search_block(index, terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k)
        found = some if found is None else found.unionAll(some)
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """Each shard's k best for the items of one block, whose terms are few enough to broadcast."""
    lists = index.shards.select(F.arrays_zip("terms", "dfs").alias("z")).select(F.inline("z"))
    df = lists.join(F.broadcast(terms.select(F.col("term").alias("terms")).distinct()), "terms").groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = terms.join(F.broadcast(df), "term").select("item_id", "term", (F.col("n") * weight).alias("w")).filter("w > 0").collect()
    by_item: dict = {}
    for r in weighted:
        by_item.setdefault(r["item_id"], []).append((r["term"], r["w"]))
    schema = StructType([StructField("item_id", terms.schema["item_id"].dataType), StructField("doc_id", index.shards.schema["ids"].dataType.elementType), StructField("score", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, found)) for found in _best(row, by_item, k)], schema=arrow)

    return index.shards.mapInArrow(tidy(run), schema)


def _best(row: dict, by_item: dict, k: int) -> Iterator[tuple]:
    """(item, document, score) of the k best of a shard for each item."""
    wanted = pa.array(sorted({w for pairs in by_item.values() for w, _ in pairs}), row["terms"].type)
    at = pc.index_in(wanted, value_set=row["terms"])
    number = {w: i for w, i in zip(wanted.to_pylist(), at.to_pylist()) if i is not None}
    if not number:
        return
    ids, ends = row["ids"], np.cumsum(row["dfs"].to_numpy())
    starts = ends - row["dfs"].to_numpy()
    tree = Tree(np.frombuffer(row["bits"], np.uint8).reshape(depth(len(ids)), -1), np.frombuffer(row["impacts"], np.int32), len(ids))
    for item, pairs in by_item.items():
        own = [(number[w], x) for w, x in pairs if w in number]
        if own:
            which, weights = (np.array(c, np.int64) for c in zip(*own))
            for score, place in tree.top(starts[which], ends[which], weights, k):
                yield item, ids[place].as_py(), score
