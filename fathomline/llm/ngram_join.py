"""Exact Jaccard join of documents' word shingles by partitioning the universe of shingles.

The universe of shingle hashes is cut into segments by the band of a set's size, and a set signs its
subset of each segment. Sets of sizes r and s with likeness J >= t share at least
c(r, s) = ceil(t / (1 + t) * (r + s)) elements (pigeonhole): they agree in one of any r - c + 1 of the segments of one side.

* The band of up to ``SMALL_MOST`` shingles has one segment, the whole universe: similar sets are equal there or one
  is the other and one element more, so a set signs its subset and all its one-deletion neighbours.
* In the bands above a segment is one hash value and its subset one shingle. Coarser segments can't tell which of the two sides
  differs and need floor((1 - t) / (1 + t) * (r + s)) + 1 signatures: a third more, which met in lists of
  far less similar documents.

Which segments a set signs is allocated by cost. The cost of a signature is its number of documents where that is high
(heavy hitters of all documents' signatures, counted in a first pass), else none. All documents order signatures alike,
cheapest first, and each signs its first n - c + 1, with c for its smallest partner. In which place a document has a
signature says more: the cheaper ones before it are in none of the documents that it first meets there. So a signature
in place p of a set of size n only counts for partners of up to ``reach`` = (1 + t) / t * (n - p) - n elements, and two documents of
a list can be similar by it if each is within the other's reach.

In each list a document is linked to one of the smallest ids that it may be similar to, and its smallest link of all is verified
exactly on the texts; that joins most of a group. Then the lists are read again with the components that the documents are in by now, and in a
list the documents outside of its largest component are held against the others: a pair of two components within each other's reach that
wasn't verified yet is verified now, on the texts, unless bit maps of the two sets rule it out; the bits in which two maps
differ are a lower bound of the elements in which their sets do. So no link between different texts is lost, but for those that join what is joined already,
and pairs inside a component are never listed. A list of more than ``LIST_MOST`` documents is dealt into blocks, and each
two blocks are a list.

Exact copies are one set: a task signs a set once, for the first document that it meets, and its other copies are linked to that one;
tasks' first documents of a set are linked by the hash (128 bits) of the whole set.

Defined cases: a null or empty text, or one without words, has an empty set, links to nothing and
is its own component; fewer than ``k`` words are one shingle; rows with one doc_id are one
document and each row keeps its n_shingles; a null doc_id links to nothing and has a null
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from fathomline.llm.arrowmap import map_text, pack_texts, tidy, unpack_texts
from fathomline.llm.frames import fits_broadcast, partitions
from fathomline.llm.graph import components
from fathomline.llm.textkit import SPACE_WORDS, U64, Words, mix, row_sums, shingle_sets, slices, text_bytes
from fathomline.scratch import Scratch

SHINGLE = 5
#: The threshold as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Sets of up to this size are one segment.
SMALL_MOST = 5
#: Signatures that a task counts or packs at once, and those that a bucket holds on average at most.
HELD = 1 << 21
BUCKET_KEYS = 1 << 21
#: Documents of a list, as counted in the first pass, that are held against one another in one task.
LIST_MOST = 1 << 18
#: Smallest ids of a list to which its documents are linked.
LEADERS = 8
#: Heavy hitters: counted from this many in a task's share on; listed from HOT_LEAST in all; HOT_MOST are kept for ordering.
LOCAL_LEAST, HOT_LEAST, HOT_MOST = 3, 16, 1 << 18
_COLD = 0
#: Sizes and reaches are below this.
_SPAN = 1 << 32


@dataclass(frozen=True)
class Scheme:
    """The threshold, and the hot signatures with their counts."""

    num: int = NUM
    den: int = DEN
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def differ(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The most elements in which similar sets of these sizes differ: U - I with den * I >= num * U."""
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def longest(self, r: np.ndarray) -> np.ndarray:
        """The largest size of a set similar to one of size r."""
        return self.den * r // self.num

    def shortest(self, r: np.ndarray) -> np.ndarray:
        return -(-self.num * r // self.den)

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Signatures that a set of size n emits to meet a similar one of any size."""
        shared = -(-self.num * (n + self.shortest(n)) // (self.num + self.den))
        return n - shared + 1

    def reach(self, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The largest set that one of size n can be similar to if it shares nothing before this place."""
        return np.clip((self.num + self.den) * (n - place) // self.num - n, 0, _SPAN - 1)

    def counts(self, sig: np.ndarray) -> np.ndarray:
        """0 for cold signatures, else the number of documents."""
        if not len(self.hot):
            return np.zeros(len(sig), np.int64)
        at = np.minimum(np.searchsorted(self.hot, sig), len(self.hot) - 1)
        return np.where(self.hot[at] == sig, self.hot_count[at], 0)


def levels(counts: np.ndarray) -> np.ndarray:
    """The cost of signatures in four bits: 0 for cold ones, else 1 to 14."""
    return np.minimum(14, np.log2(np.maximum(counts, 1)).astype(np.int64) + (counts == 1)).astype(U64)


def _expand(offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of these documents one after another: their indexes, and n + 1 offsets."""
    size = (offsets[1:] - offsets[:-1])[docs]
    out = np.zeros(len(docs) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return np.repeat(offsets[:-1][docs] - out[:-1], size) + np.arange(out[-1]), out


def signatures(sets: np.ndarray) -> np.ndarray:
    """The signature of each one-element segment."""
    return mix(sets)


def allocate(sets: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures that each document emits: document, key and place. Keys begin with the cost."""
    sizes = np.diff(offsets)
    small = np.flatnonzero((sizes > 0) & (scheme.shortest(sizes) <= SMALL_MOST))
    doc, key = _whole_sets(sets, offsets, small)
    large = np.flatnonzero(sizes > SMALL_MOST)
    if not len(large):
        return doc, key, np.zeros(len(doc), np.int64)
    values, offs = _take(sets, offsets, large)
    sig = signatures(values)
    counts = scheme.counts(sig)
    keys = (levels(counts) << U64(60)) | (sig >> U64(4))
    many = dict(zip(keys[counts > LIST_MOST].tolist(), counts[counts > LIST_MOST].tolist()))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        keys[a:b].sort()
    owner = np.repeat(np.arange(len(large)), np.diff(offs))
    place = np.arange(len(keys)) - offs[owner]
    chosen = place < scheme.needed(sizes[large])[owner]
    doc, key, place = np.concatenate([doc, large[owner[chosen]]]), np.concatenate([key, keys[chosen]]), np.concatenate([np.zeros(len(doc), np.int64), place[chosen]])
    return _split(doc, key, place, row_sums(mix(sets), offsets), many) if many else (doc, key, place)


def _split(doc: np.ndarray, key: np.ndarray, place: np.ndarray, spread: np.ndarray, many: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of very long lists in place of which there is one for each two blocks of the list's documents, of which one is the document's own."""
    blocks = np.array([-(-many.get(k, 0) // LIST_MOST) for k in key.tolist()], np.int64)
    long = np.flatnonzero(blocks > 1)
    index = np.repeat(long, blocks[long])
    n = blocks[index].astype(U64)
    other = (np.arange(len(index)) - np.repeat(np.cumsum(blocks[long]) - blocks[long], blocks[long])).astype(U64)
    own = spread[doc[index]] % n
    low = U64((1 << 20) - 1)  # the rest of a key stays, and with it the order of signatures
    pair = (key[index] & ~low) | (mix(key[index] ^ mix(np.minimum(own, other) * n + np.maximum(own, other))) & low)
    rest = blocks <= 1
    return np.concatenate([doc[rest], doc[index]]), np.concatenate([key[rest], pair]), np.concatenate([place[rest], place[index]])


def _whole_sets(sets: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and key of each whole set, and of it less one element where it has more than three."""
    if not len(docs):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    values, offs = _take(sets, offsets, docs)
    owner = np.repeat(np.arange(len(docs)), np.diff(offs))
    hashed = mix(values ^ U64(0x5851F42D4C957F2D))
    sums = row_sums(hashed, offs)
    deep = np.diff(offs)[owner] > 3
    who = np.concatenate([np.arange(len(docs)), owner[deep]])
    return docs[who], mix(np.concatenate([sums, sums[owner[deep]] - hashed[deep]])) >> U64(4)


def have_partners(number: np.ndarray, n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which entries of lists, sorted by (list, size), may be similar to another of their list; some others as well.

    Of the entries that begin early enough the one that reaches farthest decides; a later entry may be similar to this one only if the
    next one isn't too large.
    """
    m, own = len(n), np.arange(len(n))
    high = number * _SPAN + reach
    top = np.maximum.accumulate(high)
    last = np.where(reach >= n, own - 1, np.searchsorted(number * _SPAN + n, high, side="right") - 1)
    before = (last >= 0) & (top[np.maximum(last, 0)] >= number * _SPAN + n)
    after = np.zeros(m, bool)
    after[:-1] = (number[1:] == number[:-1]) & (n[1:] <= reach[:-1])
    return before | after


# ---- passes over the documents -----------------------------------------------------


def _sets(column, k: int):
    """Yields (first row, last row, sorted sets, offsets) for slices of a text column."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        base = offsets[a]
        yield a, b, *shingle_sets(Words(data[base : offsets[b]], offsets[a : b + 1] - base, SPACE_WORDS), k)


def _set_hashes(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each whole set."""
    return row_sums(mix(sets), offsets), row_sums(mix(sets + U64(0x9E3779B97F4A7C15)), offsets)


def _fresh(seen: dict, high: np.ndarray, low: np.ndarray, sizes: np.ndarray, ids: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose set the task meets first, and for each row the id that its set was first met with."""
    out, reps = [], ids.copy()
    for i, key in enumerate(zip(high.tolist(), low.tolist())):
        if sizes[i] and usable[i]:
            if key not in seen:
                seen[key] = int(ids[i])
                out.append(i)
            reps[i] = seen[key]
    return np.array(out, np.int64), reps


def _take(sets: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, offs = _expand(offsets, rows)
    return sets[index], offs


PROFILE = StructType([StructField("kind", IntegerType())] + [StructField(c, LongType()) for c in ("doc_id", "n", "high", "low", "rep")])


def _profile(docs: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """kind 0: each row's set size and hash, and its task's first document of that set; 1: counts of signatures that a task met often (high); 2: signatures that a task will emit (n)."""
    arrow = to_arrow_schema(PROFILE)

    def run(batches):
        seen: dict = {}
        held, size, total = [], 0, 0

        def batch_of(kind, n, high, low=None, ids=None, reps=None):
            as_long = lambda x: pa.nulls(len(n), pa.int64()) if x is None else pa.array(x.view(np.int64))
            missing = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), missing if ids is None else ids, pa.array(np.asarray(n, np.int64)), as_long(high), as_long(low), missing if reps is None else reps], schema=arrow)

        def flush():
            sig, n = np.unique(np.concatenate(held), return_counts=True)
            return batch_of(1, n[n >= LOCAL_LEAST], sig[n >= LOCAL_LEAST])

        for batch in batches:
            ids = batch.column(0)
            valid = np.asarray(ids.is_valid())
            plain = np.asarray(ids.fill_null(0))
            for a, b, sets, offsets in _sets(batch.column(1), k):
                sizes = np.diff(offsets)
                high, low = _set_hashes(sets, offsets)
                rows, reps = _fresh(seen, high, low, sizes, plain[a:b], valid[a:b])
                yield batch_of(0, sizes, high, low, ids.slice(a, b - a), pa.array(reps, mask=~valid[a:b]))
                large = rows[sizes[rows] > SMALL_MOST]
                total += int(scheme.needed(sizes[large]).sum()) + (SMALL_MOST + 2) * (len(rows) - len(large))
                held.append(signatures(_take(sets, offsets, large)[0]))
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        yield batch_of(2, [total], None)

    return docs.mapInArrow(tidy(run), PROFILE)


PACKED = StructType([StructField("bucket", IntegerType())] + [StructField(c, BinaryType()) for c in ("keys", "ids", "sizes", "places")])


def _thin(values: np.ndarray) -> bytes:
    """Whole numbers as differences to the smallest, in as few bytes each as hold the largest."""
    low = int(values.min()) if len(values) else 0
    spread = int(values.max()) - low if len(values) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if spread <= np.iinfo(t).max)
    return np.array([low, np.dtype(kind).itemsize], np.int64).tobytes() + (values - low).astype(kind).tobytes()


def _thick(raw: pa.Buffer) -> np.ndarray:
    low, width = np.frombuffer(raw, np.int64, 2)
    return np.frombuffer(raw, f"u{width}", -1, 16).astype(np.int64) + low


def _packed(docs: DataFrame, k: int, scheme: Scheme, buckets: int) -> DataFrame:
    """Signatures of each task by bucket: keys, documents, their set sizes, places."""
    arrow = to_arrow_schema(PACKED)

    def run(batches):
        seen: dict = {}
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = 0

        def flush():
            keys, ids, sizes, places = (np.concatenate(x) for x in held)
            bucket = ((keys & U64(0xFFFFFFFF)) * U64(buckets) >> U64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            names, begin = np.unique(bucket[order], return_index=True)
            ends = np.append(begin[1:], len(order)).tolist()
            cuts = [order[s:e] for s, e in zip(begin.tolist(), ends)]
            cut = [pa.array([keys[c].tobytes() for c in cuts], pa.binary())] + [pa.array([_thin(x[c]) for c in cuts], pa.binary()) for x in (ids, sizes, places)]
            return pa.RecordBatch.from_arrays([pa.array(names), *cut], schema=arrow)

        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0).fill_null(0))
            for a, b, sets, offsets in _sets(batch.column(1), k):
                sizes = np.diff(offsets)
                rows, _ = _fresh(seen, *_set_hashes(sets, offsets), sizes, ids[a:b], valid[a:b])
                if not len(rows):
                    continue
                doc, key, place = allocate(*_take(sets, offsets, rows), scheme)
                for to, x in zip(held, (key, ids[a:b][rows][doc], sizes[rows][doc], place)):
                    to.append(x)
                size += len(key)
                if size >= HELD:
                    yield flush()
                    held, size = [[], [], [], []], 0
        if size:
            yield flush()

    return docs.mapInArrow(tidy(run), PACKED)


PAIR = "a long, b long"
MET = StructType([StructField(c, LongType()) for c in ("key", "a", "b", "size", "reach")])


def links_of(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs (smaller id, larger id) that may be similar, one for each document of a list with one of its smallest ids; and the lists of three or more documents: key, id, size, reach.

    Of lists with the same documents that of the smallest key is returned, where all reach farthest.
    """
    order = np.lexsort((ids, sizes, keys))
    keys, ids, n, places = keys[order], ids[order], sizes[order], places[order]
    reach = scheme.reach(n, places)
    for _ in range(2):  # entries without partners go, then lists of one entry
        number = np.cumsum(np.concatenate((np.zeros(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        count = np.bincount(number)[number] if len(keys) else number
        keep = (count > 1) & have_partners(number, n, reach)
        keys, ids, n, reach = keys[keep], ids[keep], n[keep], reach[keep]
    if not len(keys):
        return np.zeros((0, 2), np.int64), [x[:0] for x in (keys, ids, n, reach)]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(begin, len(keys)))
    number = np.repeat(np.arange(len(count)), count)
    by_id = np.lexsort((ids, number))
    to = np.full(len(keys), -1)
    for i in range(LEADERS):
        leader = by_id[(begin + np.minimum(i, count - 1))][number]
        near = (to < 0) & (n <= reach[leader]) & (n[leader] <= reach) & (ids != ids[leader])
        to[near] = leader[near]
    linked = np.flatnonzero(to >= 0)
    x, y = ids[linked], ids[to[linked]]
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    name = np.add.reduceat(mix(ids.astype(U64)), begin)
    _, once = np.unique(np.where(count > 2, name, U64(0)), return_index=True)  # keys ascend, so the first is the smallest
    kept = np.zeros(len(count), bool)
    kept[once] = True
    member = (kept & (count > 2))[number]
    return pairs, [x[member] for x in (keys, ids, n, reach)]


def _met(packed: DataFrame, scheme: Scheme, parts: int) -> DataFrame:
    """The links of each bucket (key null), and its lists (b null)."""
    arrow = to_arrow_schema(MET)

    def meet(rows):
        columns = [np.concatenate([np.frombuffer(r[0], U64) for r in rows])] + [np.concatenate([_thick(r[i]) for r in rows]) for i in (1, 2, 3)]
        pairs, (keys, ids, n, reach) = links_of(*columns, scheme)
        p, m = len(pairs), len(keys)
        none = lambda k: pa.nulls(k, pa.int64())
        body = [(none(p), keys.view(np.int64)), (pairs[:, 0], ids), (pairs[:, 1], none(m)), (none(p), n), (none(p), reach)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in c]) for c in body], schema=arrow)

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(i) for i in range(5))):
                if rows and r[0].as_py() != bucket:
                    yield meet(rows)
                    rows = []
                bucket = r[0].as_py()
                rows.append([x.as_buffer() for x in r[1:]])
        if rows:
            yield meet(rows)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), MET)


#: Bits for each shingle of a set's bit map, of a power of two in all.
SIEVE_BITS = 4
#: The most 64-bit words of a map that goes with each entry of a list; those of larger sets are fuller there and rule out less.
MAP_WORDS = 32


def _set_maps(texts: DataFrame, k: int, most: int = 1 << 40) -> DataFrame:
    """doc_id and payload: the size of the set and a bit map in which each shingle is hashed to one bit."""

    def make():
        def apply(column):
            out = []
            for _, _, sets, offsets in _sets(unpack_texts(column), k):
                spread = mix(sets)
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    bits = np.zeros(min(64 * most, 1 << max(6, (SIEVE_BITS * int(e - s) - 1).bit_length())), np.uint8)
                    bits[(spread[s:e] & U64(len(bits) - 1)).astype(np.int64)] = 1
                    out.append(np.int64(e - s).tobytes() + np.packbits(bits).tobytes())
            return [pa.array(out, pa.binary())]

        return apply

    return map_text(texts, "packed", make, StructType([StructField("payload", BinaryType())]), ["doc_id"])


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A map as one of fewer words: bits that fall together are joined."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_be_similar(i: np.ndarray, j: np.ndarray, n: np.ndarray, maps: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """Which pairs (i, j) of sets their maps don't rule out: every bit in which two maps differ is an element in which the sets do."""
    width = np.array([len(m) for m in maps])
    common = np.minimum(width[i], width[j])
    ok = np.zeros(len(i), bool)
    for w in np.unique(common).tolist():
        pairs = np.flatnonzero(common == w)
        members = np.unique(np.concatenate([i[pairs], j[pairs]]))
        table = np.stack([_folded(maps[m], w) for m in members.tolist()])
        for at in range(0, len(pairs), 1 << 15):
            p = pairs[at : at + (1 << 15)]
            x, y = np.searchsorted(members, i[p]), np.searchsorted(members, j[p])
            ok[p] = np.bitwise_count(table[x] ^ table[y]).sum(axis=1, dtype=np.int64) <= scheme.differ(n[i[p]], n[j[p]])
    return ok


def pairs_across(ids: np.ndarray, n: np.ndarray, reach: np.ndarray, labels: np.ndarray, maps: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """Pairs (smaller id, larger id) of one list that are of different components, within each other's reach and not ruled out by their maps."""
    names, of, count = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(n, kind="stable")
    ids, n, reach, of, maps = ids[order], n[order], reach[order], of[order], [maps[i] for i in order.tolist()]
    asks = np.flatnonzero(of != count.argmax())
    out, step = [], max(1, (1 << 21) // len(ids))
    for at in range(0, len(asks), step):
        y = asks[at : at + step, None]
        end = int(np.searchsorted(n, reach[y].max(), side="right"))
        near = (n[None, :end] <= reach[y]) & (reach[None, :end] >= n[y]) & (of[None, :end] != of[y]) & (ids[None, :end] != ids[y])
        i, j = np.nonzero(near)
        i = y[i, 0]
        ok = may_be_similar(i, j, n, maps, scheme)
        out.append(np.stack([ids[i[ok]], ids[j[ok]]], axis=1))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def _across(marked: DataFrame, scheme: Scheme, parts: int) -> DataFrame:
    """``pairs_across`` of every list of ``marked`` (key, id, size, reach, label, map)."""

    def run(batches):
        key, held, found, size = None, [], [], 0

        def flush():
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])

        def close():
            *columns, maps = zip(*held)
            found.append(pairs_across(*(np.concatenate(x) for x in columns), [m for part in maps for m in part], scheme))
            return len(found[-1])

        for batch in batches:
            keys, *columns = (np.asarray(batch.column(i)) for i in range(5))
            maps = [_read_map(raw)[1] for raw in batch.column(5)]
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist() if len(keys) else []
            for s, e in zip(cuts, [*cuts[1:], len(keys)]):
                if held and keys[s] != key:
                    size += close()
                    held = []
                    if size >= HELD:
                        yield flush()
                        found, size = [], 0
                key = keys[s]
                held.append([*(c[s:e] for c in columns), maps[s:e]])
        if held:
            close()
        if found:
            yield flush()

    return marked.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(run), PAIR).distinct()


def _read_map(raw: pa.Scalar) -> tuple[int, np.ndarray]:
    return int(np.frombuffer(raw.as_buffer(), np.int64, 1)[0]), np.frombuffer(raw.as_buffer(), U64, -1, 8)


#: Documents of one block of a group of pairs.
BLOCK_DOCS = 256
#: Rows of texts that are unpacked at once.
READ_ROWS = 64


#: Ids of up to so many bytes are sent to the texts, which then stay where they are.
BROADCAST_BYTES = 8 << 20


def _small(ids: DataFrame, row_bytes: int) -> DataFrame:
    """``ids``, to be broadcast if a count says that they fit."""
    return F.broadcast(ids) if fits_broadcast(ids, BROADCAST_BYTES, row_bytes) else ids


def _in_blocks(pairs: DataFrame, payloads: DataFrame, read, holds) -> DataFrame:
    """The pairs (a, b) for which ``holds`` of what ``read`` makes of their payloads.

    Pairs that met crowd in groups: most documents of a list have the list's smallest one as their smallest
    partner. Documents of one smallest partner are dealt into blocks, and a payload
    crosses the network once for each block that its own is paired with, not once a pair.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    docs = both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("group"))
    sizes = docs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    blocks = docs.join(sizes, "group").select("doc_id", F.xxhash64("group", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK_DOCS))).alias("block"))
    side = lambda c: blocks.select(F.col("doc_id").alias(c), F.col("block").alias(f"b{c}"))
    keyed = pairs.join(side("b"), "b").join(side("a"), "a").select(F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("key"), "a", "b")
    members = _small(keyed.select("key", "a").union(keyed.select("key", "b")).distinct(), 24).join(payloads.select(F.col("doc_id").alias("a"), "payload"), "a")
    rows = members.select("key", "a", F.lit(None).cast("long").alias("b"), "payload").union(keyed.select("key", "a", "b", F.lit(None).cast("binary")))
    dealt = rows.repartition(partitions(pairs.sparkSession), "key").sortWithinPartitions("key", F.col("b").asc_nulls_first())

    def run(batches):
        now, held = None, {}
        for whole in batches:
            for at in range(0, whole.num_rows, READ_ROWS):
                batch = whole.slice(at, READ_ROWS)
                u, v = [], []
                for key, a, b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), read(batch.column(3))):
                    if key != now:
                        now, held = key, {}
                    if b is None:  # an id may have two texts
                        held.setdefault(a, []).append(own)
                    elif any(holds(x, y) for x in held.get(a, ()) for y in held.get(b, ())):
                        u.append(a)
                        v.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), PAIR).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """The pairs whose texts' sets are similar, compared element by element."""
    return _in_blocks(pairs, texts.withColumnRenamed("packed", "payload"), lambda c: _read_sets(c, k), lambda x, y: _similar(x, y, scheme.num, scheme.den))


def _sieved(pairs: DataFrame, maps: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose maps don't rule them out."""
    read = lambda column: [_read_map(raw) if raw.is_valid else None for raw in column]
    zero, one = np.array([0]), np.array([1])
    return _in_blocks(pairs, maps, read, lambda x, y: bool(may_be_similar(zero, one, np.array([x[0], y[0]]), [x[1], y[1]], scheme)[0]))


def _read_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    return [s[o[i] : o[i + 1]] for f, t, s, o in _sets(unpack_texts(column), k) for i in range(t - f)]


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return den * shared >= num * (len(x) + len(y) - shared)


def join(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    store, plain = Scratch(spark, "ngram-join"), Scheme(num, den)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if plain.differ(SMALL_MOST, plain.longest(SMALL_MOST)) > 1:
        raise ValueError("the smallest band holds sets that differ in one element at most; lower thresholds need a smaller one")
    profile = store.save(_profile(rows, k, plain), "profile")
    counted = profile.filter("kind = 1").groupBy(F.col("high").alias("sig")).agg(F.sum("n").alias("n"))
    hot = counted.filter(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "sig").limit(HOT_MOST).toArrow()  # a fixed bound
    sig, n = np.asarray(hot["sig"]).view(U64), np.asarray(hot["n"])
    order = np.argsort(sig)
    scheme = Scheme(num, den, sig[order], n[order])
    emitted = profile.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(spark), -(-emitted // (4 * BUCKET_KEYS)))
    met = store.settle(_met(_packed(rows, k, scheme, 4 * parts), scheme, parts), "met")

    # equal sets of several tasks: the smallest of their first documents stands for them
    meta = profile.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "high", "low", "rep")
    firsts = meta.filter("doc_id = rep AND n_shingles > 0").select("high", "low", "n_shingles", "rep").distinct()
    equal = firsts.groupBy("high", "low", "n_shingles").agg(F.min("rep").alias("least"), F.max("rep").alias("last")).filter("least < last")
    stand_in = store.save(firsts.join(equal, ["high", "low", "n_shingles"]).filter("rep <> least").select(F.col("rep").alias("doc_id"), "least").distinct(), "equal")
    standing = lambda df, c: df.join(stand_in.select(F.col("doc_id").alias(c), "least"), c, "left").withColumn(c, F.coalesce("least", c)).drop("least")
    links = standing(standing(met.filter("key IS NULL").select("a", "b"), "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = store.save(links, "links")
    lists = store.save(standing(met.filter("key IS NOT NULL").select("key", F.col("a").alias("doc_id"), "size", "reach"), "doc_id").distinct(), "lists")
    store.drop("met")
    involved = links.select("a").union(links.select("b")).union(lists.select("doc_id")).distinct().toDF("doc_id")
    texts = store.settle(pack_texts(rows).join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "packed"]), "texts")
    first = links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    similar = store.settle(_verified(first, texts, k, plain), "similar")

    # what these left apart: pairs of different components, by the components so far
    labels = components(spark, similar)
    label = lambda df, c, to: df.join(labels.select(F.col("node").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    rest = label(label(links, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    marked = store.save(label(lists, "doc_id", "label").select("key", "doc_id", "size", "reach", "label"), "marked")
    mixed = marked.groupBy("key").agg(F.min("label").alias("c1"), F.max("label").alias("c2")).filter("c1 <> c2").select("key")
    open_ = marked.join(mixed, "key", "left_semi").join(_set_maps(texts, k, MAP_WORDS), "doc_id").select("key", "doc_id", "size", "reach", "label", "payload")
    across = store.settle(_across(open_, plain, parts), "across")
    apart = store.save(rest.union(across).distinct().join(first, ["a", "b"], "left_anti"), "apart")
    asked = apart.select("a").union(apart.select("b")).distinct().toDF("doc_id")
    more = store.settle(_sieved(apart, _set_maps(texts.join(_small(asked, 8), "doc_id", "left_semi"), k), plain), "more")
    late = store.settle(_verified(more, texts, k, plain), "late")

    copies = meta.filter("doc_id <> rep AND n_shingles > 0").select("doc_id", "rep")
    final = components(spark, similar.union(late).union(stand_in).union(copies))
    store.drop("links", "lists", "texts", "marked", "across", "apart", "more")
    return meta.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; rows without an id stay."""
    grouped = join(spark, docs, doc_id=doc_id, **options)
    gone = grouped.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col("__gone"), "left_anti")
