"""Problem 1: near-duplicate records with small edits, by meet-in-the-middle ball hashing.

*Fingerprint.*  A record's fingerprint is the set of its ``SIZE`` = 8 smallest shingle hashes
(a bottom-k sketch).  The metric is the symmetric difference: an edit removes some elements and
adds others.  Two fingerprints within radius 2r (r = ``HALF`` = 6) have r removals on either
side, so each side walks half the way: it emits *all* variants that lie r removals away (the
C(8, 2) = 28 pairs of its elements) and fingerprints within the radius meet in a common
variant, their shared core.  At a Jaccard similarity of 0.5 an element of one fingerprint is in
the other with probability about 2/3, so fewer than two of eight are shared in about 0.3 % of such pairs.

*Crowded variants.*  A phrase that thousands of records use makes variants that thousands of records
emit, and so does a family of many edited copies.  Nothing is counted over the corpus or demoted
for that: a variant that more than ``CROWDED`` records emit is split.  Its records emit the variant
extended by each of ``FAN`` further elements, taken from a second sketch of ``SKETCH`` elements in an
order of the variant's own, so records that are alike meet again and records with a phrase in common
part; what is still crowded is split once more.  How far a crowded variant's records agree in these elements
estimates how alike they are: where they agree in half of them they are a family, and its pairs are
the result itself, so it is not split.

*Meeting.*  Variants are shuffled once, as rows of a key, an id, a size and the number of the variant, and sorted in their partition.
A task reads them in order, drops those that are alone, pairs those of a key that is not crowded at once and passes the others on; it
holds a batch and ``CROWDED`` rows, whatever the keys.  Pairs whose sizes differ by more than the threshold allows are not written.

*Small sets.*  Records of so few different shingles that a case need not share more than the elements of a
crowded variant are paired in it, whether it is split or not: sharing these, they are alike anyway.  Where one
element can make a case, each element is a variant too.

*Copies* are folded first: records with the same word sequence form a class and only its
representative emits variants.  *Verification* is exact: colliding pairs are deduplicated, those whose
bitmaps prove too many differences are left out, and the texts of the others compared by their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Hasher, flat, hashed_counts, mix, shingles, words
from weft.runtime import cut, drop

SIZE, HALF = 8, 6
#: Most records of a variant that is not split; elements a split extends it by; elements of the sketch they come from.
CROWDED, FAN, SKETCH = 32, 8, 24
#: Splits of a variant at most; after the last one its pairs are compared however many they are.
SPLITS = 5
#: Agreement in the further elements from which the records of a crowded variant are a family.
FAMILY = 0.5
#: Variants are shuffled as hashes of so many bits more than it takes to number them: the zero bytes compress, and one in
#: 4,096 meets another one by chance, which costs a comparison.
SPARE_BITS = 12
#: Records of a group that one task pairs with the whole group.
BLOCK = 2048
#: Longs of a record's bitmap of shingles, and bins of the bitmap of record ids (bins / 8 bytes).
BITS, BINS = 4, 1 << 23
#: A variant is two elements of the fingerprint in ascending order: their places, by number of the variant.
FIRST, SECOND = np.triu_indices(SIZE, 1)


_BITS = [f"bits{i}" for i in range(BITS)]


def _texts(b: pa.RecordBatch) -> list[list[bytes]]:
    return [words(t) if t else [] for t in b.column("text").to_pylist()]


def _order(rank: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The order of elements by owner, then by the upper 40 bits of the rank: one sort of integers."""
    return np.argsort((own.astype(np.uint64) << np.uint64(40)) | (rank >> np.uint64(24)))


def _lowest(rank: np.ndarray, own: np.ndarray, value: np.ndarray, n: int, size: int) -> pa.Array:
    """Per owner (of ``n``, in order) the values of its ``size`` lowest ranks, as bytes."""
    begin = np.searchsorted(own, np.arange(n + 1))
    low = _order(rank, own)[np.arange(len(own)) - begin[own] < size]
    offs = np.zeros(n + 1, np.int32)
    np.cumsum(np.minimum(np.diff(begin), size) * 4, out=offs[1:])
    return _binary(offs, value[low])


def _binary(offs: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _elements(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements of :func:`_lowest` as a matrix of ``width`` columns, and which of it are there."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    there = np.arange(width) < (np.diff(offs) // 4)[:, None]
    out = np.zeros(there.shape, np.int64)
    if offs[-1] > offs[0]:
        out[there] = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.int32)
    return out, there


def _print(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of fingerprints in ascending order, and which of the matrix are there."""
    e, there = _elements(col, SIZE)
    return np.sort(np.where(there, e, 1 << 32), axis=1), there


def fingerprints(df: DataFrame, k: int, least_words: int) -> DataFrame:
    """``(id, cls, size, print, sketch, bits0, ...)`` of each record of ``df(id, text)`` with at least ``least_words`` words.

    ``cls`` is a 128-bit hash of the word sequence, ``size`` the number of different shingles, ``print``
    the fingerprint, ``sketch`` the elements that split crowded variants (both as bytes), ``bits0`` and so on a bitmap of all shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            lists = _texts(b)
            keep = [i for i, x in enumerate(lists) if len(x) >= max(k, least_words)]
            lists = [lists[i] for i in keep]
            n = len(lists)
            h, off = flat(lists, hasher)
            g, own = shingles(h, off, k)
            g = g[_order(g, own)]
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
            g, own = g[first], own[first]
            size = np.bincount(own, minlength=n)
            value = (g & np.uint64(0x7FFFFFFF)).astype(np.int32)
            bits = np.zeros(n * BITS * 64, bool)
            bits[own * (BITS * 64) + ((g >> np.uint64(32)) % np.uint64(BITS * 64)).astype(np.int64)] = True
            bits = np.packbits(bits).view(np.int64).reshape(n, BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[keep], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(b" ".join(x)) for x in lists], pa.binary()),
                    pa.array(size, pa.int32()),
                    _lowest(mix(g + np.uint64(1)), own, value, n, SIZE),
                    _lowest(mix(g + np.uint64(2)), own, value, n, SKETCH),
                    *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITS)),
                ],
                ["id", "cls", "size", "print", "sketch", *_BITS],
            )

    return df.select("id", "text").mapInArrow(run, "id long, cls binary, size int, print binary, sketch binary, " + ", ".join(f"{c} long" for c in _BITS))


def variants(prints: DataFrame, least: float, mask: int) -> DataFrame:
    """``(key, id, size, which)`` of all variants half the radius away of ``prints(id, size, print)``; ``which`` numbers a record's variants.

    From ``len(FIRST)`` on these are single elements, of records in which one element can make a case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "size"))
            e, there = _print(b.column("print"))
            e = e.astype(np.uint64)
            key = np.concatenate([(e[:, FIRST] << np.uint64(32)) | e[:, SECOND], e | np.uint64(1 << 63)], axis=1)
            emitted = np.concatenate([there[:, SECOND], there & (size * least <= 1)[:, None]], axis=1)
            row, which = np.nonzero(emitted)
            key = (mix(key[row, which]) & np.uint64(mask)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row], pa.int64()), pa.array(size[row], pa.int32()), pa.array(which.astype(np.int8))], ["key", "id", "size", "which"])

    return prints.select("id", "size", "print").mapInArrow(run, "key long, id long, size int, which byte")


def extended(sets: DataFrame, split: int) -> DataFrame:
    """``(key, id, size, used, of, n)``: the variants ``sets(key, id, size, n, which or used, print, sketch)`` by ``FAN`` further elements each.

    ``of`` is the variant that was extended, ``n`` how many rows have that, ``used`` the elements of the new one as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            if split:
                used = _elements(b.column("used"), 2 + split)[0]
            else:
                e, which = _print(b.column("print"))[0], b.column("which").to_numpy(zero_copy_only=False)
                used = np.stack([np.take_along_axis(e, x[which][:, None], axis=1)[:, 0] for x in (FIRST, SECOND)], axis=1)
            x, there = _elements(b.column("sketch"), SKETCH)
            for i in range(2 + split):
                there &= x != used[:, i : i + 1]
            h = mix(mix(key.view(np.uint64) + np.uint64(3))[:, None] + x.astype(np.uint64))
            h[~there] = np.uint64(0xFFFFFFFFFFFFFFFF)
            lowest = np.argsort(h, axis=1)[:, :FAN]
            row, at = np.nonzero(np.take_along_axis(there, lowest, axis=1))
            at = lowest[row, at]
            longer = np.concatenate([used[row], x[row, at][:, None]], axis=1).astype(np.int32)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[row, at].view(np.int64)), b.column("id").take(taken), b.column("size").take(taken), _binary(np.arange(len(row) + 1) * 4 * (3 + split), longer), pa.array(key[row]), b.column("n").take(taken)],
                ["key", "id", "size", "used", "of", "n"],
            )

    return sets.select("key", "id", "size", "n", *(["used"] if split else ["which", "print"]), "sketch").mapInArrow(run, "key long, id long, size int, used binary, of long, n long")


def met_rows(rows: DataFrame, least: float, crowded: int) -> DataFrame:
    """What ``rows(key, id, size, ...)`` of a key meet in: the pairs of keys of at most ``crowded`` rows and the rows of the others.

    The rows come out as they are; a pair (``id``, ``b``), id < b, without a key.  Rows with ``of`` and ``n`` are also counted by ``of``: ``total`` of
    them have the number ``same`` of rows with the same key besides them, in parts that are to be summed.
    """
    further = {f.name: f.dataType.simpleString() for f in rows.schema.fields[3:]}
    names = ["key", "id", "size", *further, "b", "same", "total"]
    schema = "key long, id long, size int, " + "".join(f"{c} {kind}, " for c, kind in further.items()) + "b long, same double, total long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, counted = None, None, 0  # rows of a key that may go on; the crowded key that may go on, and what is known of it
        types: dict[str, pa.DataType] = {"b": pa.int64(), "same": pa.float64(), "total": pa.int64()}

        def of_kind(length: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(length, types[c]) for c in names], names)

        for b in chain(batches, [None]):
            if b is not None:
                types |= {f.name: f.type for f in b.schema}
            t = held if b is None else b if held is None else pa.concat_batches([held, b])
            if t is None or not t.num_rows:
                continue
            held, key = None, t.column("key").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(begin, append=len(key))
            crowd = n > crowded
            total = n.astype(np.int64)
            if key[0] == hot:
                crowd[0] = True
                total[0] += counted
            before = total[0] - n[0]
            goes_on = None
            if b is not None and crowd[-1]:
                goes_on, counted = key[-1], total[-1]
            elif b is not None:
                held = t.slice(begin[-1])
                t, begin, n, crowd, total = t.slice(0, begin[-1]), begin[:-1], n[:-1], crowd[:-1], total[:-1]
            hot = goes_on
            if not len(n):
                continue
            if "of" in further:  # a key that goes on counts by what is new: c (c - 1) is a sum of such parts
                same = total * (total - 1.0)
                if before:
                    same[0] -= before * (before - 1.0)
                ofs, first, inverse = np.unique(t.column("of").to_numpy(zero_copy_only=False)[begin], return_index=True, return_inverse=True)
                yield of_kind(len(ofs), of=pa.array(ofs), n=t.column("n").take(pa.array(begin[first])), same=pa.array(np.bincount(inverse, same)), total=pa.array(np.bincount(inverse, n).astype(np.int64)))
            if crowd.any():
                rest = t.filter(pa.array(np.repeat(crowd, n)))
                yield of_kind(rest.num_rows, **{c: rest.column(c) for c in rest.schema.names})
            few = ~crowd & (n > 1)
            chosen = np.repeat(few, n)
            group = np.repeat(np.flatnonzero(few), n[few])
            ids, size = (t.column(c).to_numpy(zero_copy_only=False)[chosen] for c in ("id", "size"))
            pairs = []
            for d in range(1, int(n[few].max(initial=1))):
                x = np.flatnonzero(group[d:] == group[:-d])
                y = x + d
                x, y = (z[(ids[x] != ids[y]) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]) - 1e-6)] for z in (x, y))
                pairs.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
            if pairs:
                x, y = np.concatenate(pairs, axis=1)
                yield of_kind(len(x), id=pa.array(x), b=pa.array(y))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def paired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b, of all pairs of ids with a key in common, of ``rows(key, id, n)`` where ``n`` rows have the key.

    A key of more than ``block`` rows is split: each task pairs one block of its rows with all of them.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    x = rows.select("key", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("part"), F.col("id").alias("a"))
    y = rows.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.col("id").alias("b"))
    return x.join(y, ["key", "part"]).where("a < b").select("a", "b")


def _counted(rows: DataFrame) -> DataFrame:
    """``rows(key, id, ...)`` with ``n``, how many rows have the key, where it is at least 2."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def meeting_pairs(prints: DataFrame, least: float, crowded: int = CROWDED) -> DataFrame:
    """``(a, b)``, a < b, of all ``prints(id, size, print, sketch)`` that meet in a variant half the radius away."""
    core = SIZE - HALF
    assert core == 2
    mask = (1 << min(63, (prints.count() * len(FIRST)).bit_length() + SPARE_BITS)) - 1
    rows, many, sketches = variants(prints, least, mask), None, prints.select("id", "print", "sketch")
    pairs, groups = [], []
    for split in range(SPLITS + 1):
        met = cut(met_rows(rows, least, crowded), "met")
        pairs.append(met.where("b IS NOT NULL").select(F.col("id").alias("a"), "b"))
        rest = met.where("b IS NULL AND total IS NULL")
        if split:
            agree = met.where("total IS NOT NULL").groupBy("of").agg((F.sum("same") / F.sum("total") / (F.max("n") - 1)).alias("agree"))
            family = cut(agree.where(F.col("agree") >= FAMILY).select(F.col("of").alias("key")), "family")
            if family.take(1):
                groups.append(many.join(family, "key", "left_semi").select("key", "id", "n"))
                rest = rest.join(family.withColumnRenamed("key", "of"), "of", "left_anti")
        many = cut(_counted(rest.select("key", "id", "size", "used" if split else "which")), "many")
        if not many.take(1):
            break
        if split == SPLITS:
            groups.append(many.select("key", "id", "n"))
            break
        groups.append(many.where(F.col("size") * least <= core + split).select(F.xxhash64("key", F.lit(split)).alias("key"), "id", "n"))
        if split == 1:  # from here on only the records of variants that are still crowded
            sketches = cut(sketches.join(many.select("id").distinct(), "id", "left_semi").select("id", "sketch"), "sketches")
        rows = extended((many if split else many.where(F.col("which") < len(FIRST))).join(sketches, "id"), split)
    if groups:
        pairs.append(paired(reduce(DataFrame.unionByName, groups)))
    # by one of the two ids, as the next join needs it; equal pairs meet there too
    return reduce(DataFrame.unionByName, pairs).repartition("a").distinct()


def possible(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``prints(id, size, bits0, ...)`` allow a similarity of ``least``: a necessary condition, so no case is left out.

    A bit set in one bitmap only stands for at least one shingle that the other record has not.
    """
    x, y = (prints.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), *(F.col(c).alias(f"{s}{i}") for i, c in enumerate(_BITS))) for s in "ab")

    def only(p: str, q: str) -> Column:
        return reduce(Column.__add__, (F.bit_count(F.col(f"{p}{i}").bitwiseAND(F.bitwise_not(F.col(f"{q}{i}")))) for i in range(BITS)))

    both = F.least(F.col("size_a") - only("a", "b"), F.col("size_b") - only("b", "a"))
    return pairs.join(x, "a").join(y, "b").where(both * (1 + least) >= least * (F.col("size_a") + F.col("size_b")) - 1e-6).select("a", "b")


def among(rows: DataFrame, ids: DataFrame, bins: int = BINS) -> DataFrame:
    """The rows of ``rows(id, text)`` whose id may occur in ``ids(id)``: a filter before a shuffle, never one that loses a row.

    The ids are marked in a bitmap of a fixed size (bins / 8 bytes), which is what the executors get.
    """

    def places(b: pa.RecordBatch) -> np.ndarray:
        return (mix(b.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bins - 1)).astype(np.int64)

    seen = rows.sparkSession.sparkContext.broadcast(np.packbits(hashed_counts(ids.select("id"), bins, places) > 0).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(seen.value, np.uint8)
        for b in batches:
            at = places(b)
            yield b.filter(pa.array(((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))

    return rows.select("id", "text").mapInArrow(run, "id long, text string")


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs whose sets of k-word sequences have a Jaccard similarity of at least ``least``."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def sets(text: str) -> set:
        w = words(text)
        return set(zip(*(w[i:] for i in range(k))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        for x in batches:
            out = []
            for i, j, s, t in zip(*(c.to_pylist() for c in x.columns)):
                if len(seen) > 2000:
                    seen.clear()
                p = seen.get(i)
                if p is None:
                    p = seen[i] = sets(s)
                q = seen.get(j)
                if q is None:
                    q = seen[j] = sets(t)
                n = len(p & q)
                u = len(p) + len(q) - n
                if u and n >= least * u:
                    out.append((i, j, n / u))
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array([o[c] for o in out], t) for c, (n, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, k: int = 5, least: float = 0.8, least_words: int = 12, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Classes and links of ``df(id, text)``: ``members(id, cls_id)`` and ``links(a, b, similarity)``.

    ``cls_id`` is the least id with the same word sequence.  ``links`` holds pairs of class ids,
    a < b, whose k-word sets reach the similarity ``least``.  Null and empty texts, and texts of
    fewer than ``least_words`` words or with a null id, are in neither.  Rows repeated under one id count
    once if equal.  Variants that more than ``crowded`` classes emit are split.
    """
    df = df.select("id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    prints = cut(fingerprints(df, k, least_words).withColumn("row", F.monotonically_increasing_id()), "prints")
    classes = prints.groupBy("cls").agg(F.min("id").alias("cls_id"), F.min_by("row", "id").alias("first"))
    classed = cut(prints.select("id", "cls", "row").join(classes, "cls").select("id", "cls_id", "row", (F.col("row") == F.col("first")).alias("chosen")), "classed")
    copies = cut(classed.where("NOT chosen").select("id", "cls_id", "row"), "copies")
    members = classed.where("chosen").select("id", "cls_id").unionByName(copies.where("id <> cls_id").select("id", "cls_id").distinct())
    once = cut(prints.join(copies.select("row"), "row", "left_anti").select("id", "size", "print", "sketch", *_BITS), "once")
    drop(prints)
    pairs = cut(possible(meeting_pairs(once, least, crowded), once, least), "pairs")
    texts = among(df, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    return members, verified(pairs, texts, k, least)


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` over records, a < b: every link and all copies, multiplied out in full.

    The result of m copies is m (m - 1) / 2 rows whatever m is (``members`` holds the same as m rows); a large class is
    paired in blocks by many tasks.
    """
    n = members.groupBy("cls_id").agg(F.count("*").alias("n"))
    sized = members.select(F.col("cls_id").alias("key"), "id").join(n.withColumnRenamed("cls_id", "key"), "key")
    x, y = members.select(F.col("cls_id").alias("a"), F.col("id").alias("ia")), members.select(F.col("cls_id").alias("b"), F.col("id").alias("ib"))
    between = links.join(x, "a").join(y, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
    return between.unionByName(paired(sized.where("n > 1")).withColumn("similarity", F.lit(1.0)))


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``(id, group_id)``: the least id reachable over ``links(a, b)`` for every ``nodes(id)``.

    Alternates large-star and small-star steps on the edge list; each round is a group-by on the
    edges and halves paths, and is written to the shared folder.  Groups that aren't settled after
    ``most_rounds`` are an error.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == now:
            break
        last = now
    else:
        raise RuntimeError(f"the groups are not settled after {most_rounds} rounds")
    group = edges.groupBy("u").agg(F.min("v").alias("group_id"))
    return nodes.join(group, nodes["id"] == group["u"], "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
