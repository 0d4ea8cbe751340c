"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document is the set of its distinct word n-grams (with fewer words, the whole sequence as one). Two documents link
when 100 * intersection >= PERCENT * union. Steps:

1. Documents with equal sets are one class, known by a 128-bit fingerprint.
2. Small sets (size up to the boundary) enumerate the subsets of the size that they must share with a partner. Large
   sets, and the small ones that could link with them, go into inverted lists. A list belongs to a part of the set, not
   to a single n-gram: linked sets differ in at most d = 2 n (100 - PERCENT) / (100 + PERCENT) elements. The hash range
   is cut into d + 1 parts and half as many again, so that more parts than the spare ones are the same in both, and
   each set lists the d + 1 parts of the most elements (ties by hash). The order of parts follows from what they hold,
   so the first of those that both have in common is listed by both. Empty parts and parts of one common n-gram, which
   unlike documents share by chance, come last and are left out. The boundary is the size up to which enumerating costs
   less than scanning.
3. The members of each list are joined to the least one: possible links. A task first joins the members it holds
   itself, so that a list that a third of all documents share brings one entry per task.
4. Components of possible links hold all real ones, and unlike sets that share a passage. Their sizes and bit
   signatures are compared first: a signature is the parity of the elements in each of at least as many cells as the set
   has elements, and its Hamming distance can't exceed the sets' difference. What is left falls into smaller components.
   Only the sets of those are read once more and counted exactly. Components are compared in blocks (``BLOCK`` sets, or
   ``SIGNED_BLOCKS`` times as many signatures), and each block returns a spanning forest of its links, never the pairs.
   The components of the verified links are the result.

Bounds: packed lists of about ``SHARD_ENTRIES`` entries, a bit table of fixed size, blocks of BLOCK members. A component
of m classes makes m * m / BLOCK rows for its blocks, so a group of very many *different* texts costs its square: with
sets (64 bits an element) where texts are alike, with signatures (a bit or two an element) where they share passages;
copies cost nothing, being one class (of rows that repeat an id and a text a task reads one again). Nulls and texts without words have an empty set, link with nothing and are their
own component. Repeated rows and ids are kept; equal texts are one vertex whatever their ids. A null id gets a null
component unless it is linked with others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamspark.llm.bytewords import SPACED, mix, signed, word_slices
from beamspark.llm.graph import components
from beamspark.llm.shared import written

GRAM = 3
PERCENT = 90
SHARD_ENTRIES = 1 << 19
TABLE_BITS = 24  # bit table of the documents that are read once more
SIGNATURE = 512  # least bits
SMALL = 24  # largest set that may enumerate subsets
BLOCK = 512
SIGNED_BLOCKS = 8  # blocks of sets in one of signatures
SPARE = 0.5  # parts beyond those needed, as a share of the elements that linked sets may not share

_U = np.uint64


def need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """Size of the smallest set that a set of n elements can link with."""
    return -(-percent * n // 100)


def gram_sets(column: pa.Array, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct n-gram hashes of each text of a slice, end to end, and the offsets between texts."""
    for w in word_slices(column, SPACED):
        h = w.hashes()
        g, whole = w.grams(h, gram)
        row = w.row
        parts, rows = [g[whole]], [row[whole]]
        n = np.diff(w.offsets)
        for k in range(1, gram):  # texts of k words only
            short = np.flatnonzero(n == k)
            if len(short):
                parts.append(w.grams(h, k)[0][w.offsets[short]])
                rows.append(short)
        h, r = np.concatenate(parts), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[first], r[first]
        yield h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=w.rows))])


def _fingerprint(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set: two sums of differently mixed elements, and the size."""
    n = np.diff(offsets).astype(_U)
    out = []
    with np.errstate(over="ignore"):
        for seed in (_U(0x51ED270B9F1D2C45), _U(0xA24BAED4963EE407)):
            total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ seed))])
            out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + n * seed))
    return [signed(x) for x in out]


def _signature(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Parity of the elements in each cell; a power of two of cells, as many as elements and SIGNATURE at least."""
    n = np.diff(offsets)
    cells = np.maximum(SIGNATURE, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(cells)])
    cell = np.repeat(start[:-1], n) + (h & np.repeat(cells - 1, n).astype(_U)).astype(np.int64)
    odd = np.bincount(cell, minlength=start[-1]) & 1
    packed, ends = np.packbits(odd.astype(np.uint8)).tobytes(), (start // 8).tolist()
    return [packed[i:j] for i, j in itertools.pairwise(ends)]


def signatures(docs: DataFrame, gram: int) -> DataFrame:
    """Per document row: size, fingerprint and bit signature of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for h, offsets in gram_sets(b.column("text"), gram):
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(n)), pa.array(n.astype(np.int32)), *map(pa.array, _fingerprint(h, offsets)),
                     pa.array(_signature(h, offsets), pa.binary())], names=["doc_id", "n", "f1", "f2", "bits"])
                at += len(n)

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n int, f1 long, f2 long, bits binary").fields])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n elements enumerates: what it must share with a partner of any size."""
    partners = np.arange(least_partner(np.int64(n), percent), 100 * n // percent + 1)
    shared = need(partners, np.int64(n), percent)
    # All of n with a partner of n would be an equal set, which is the same class.
    possible = (shared <= np.minimum(partners, n)) & ~((partners == n) & (shared == n))
    return sorted(set(shared[possible].tolist()))


def subsets(n: int, percent: int) -> int:
    """How many subsets that is."""
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def levels(n: np.ndarray, percent: int) -> np.ndarray:
    """Level of each size: linked sets are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def parts_of(level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that the hash range is cut into for pairs whose larger set is in the level, and how many are spare."""
    largest = np.floor((100 / percent) ** (level + 1.0) + 1e-6).astype(np.int64)
    apart = 2 * largest * (100 - percent) // (100 + percent)  # most elements that linked sets don't share
    spare = np.ceil(SPARE * apart).astype(np.int64)
    return apart + 1 + spare, spare


def part_keys(h: np.ndarray, offsets: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the listed parts of the given sets, for the level of each as the larger set and for the next as the smaller."""
    n = np.diff(offsets)[rows]
    keys, owners = [], []
    # Elements of these sets end to end; they are sorted, and so are their parts.
    flat = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(rows) else np.zeros(0, np.int64)
    e = h[flat]
    own = np.repeat(np.arange(len(rows)), n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(e))])
        for up in (0, 1):
            level = levels(n, percent) + up
            parts, spare = parts_of(level, percent)
            listed = parts - spare
            part = (((e >> _U(32)) * parts[own].astype(_U)) >> _U(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (own[1:] != own[:-1])])) if len(e) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(e))
            who, which = own[first], part[first]
            key = mix((total[last] - total[first]) ^ mix((level[who] << 40 | which).astype(_U)))
            used = np.bincount(who, minlength=len(rows))
            start = np.cumsum(used) - used
            order = np.lexsort((key, first - last, who))  # most elements first
            kept = order[np.arange(len(who)) - start[who] < listed[who]]
            keys.append(key[kept])
            owners.append(who[kept])
            for r in np.flatnonzero(used < listed):  # empty parts come last, in the order of their keys
                empty = np.setdiff1d(np.arange(parts[r]), which[start[r]:start[r] + used[r]])
                empty = np.sort(mix(mix((level[r] << 40 | empty).astype(_U)) + _U(1)))[:listed[r] - used[r]]
                keys.append(empty)
                owners.append(np.full(len(empty), r))
    return np.concatenate(keys), rows[np.concatenate(owners)]


def subset_keys(h: np.ndarray, offsets: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all the subsets that the given small sets enumerate."""
    keys, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for r in rows:
            e = mix(h[offsets[r]:offsets[r + 1]])
            for c in subset_sizes(len(e), percent):
                out = len(e) - c
                left_out = np.array(list(itertools.combinations(range(len(e)), out)), np.int64).reshape(math.comb(len(e), out), out)
                keys.append(mix((e.sum(dtype=_U) - e[left_out].sum(1, dtype=_U)) ^ _U(c << 32)))
                owners.append(np.full(len(keys[-1]), r))
    return np.concatenate(keys), np.concatenate(owners)


def boundary(classes: DataFrame, percent: int) -> int:
    """Largest size up to which enumerating subsets touches less than scanning lists does, for the sizes counted.

    Enumerating costs the subsets, scanning the parts of both levels and the set itself, which is read once more.
    """
    rows = classes.where(F.col("n") <= SMALL).groupBy("n").count().collect()  # at most SMALL rows
    best = 0
    sets = {r["n"]: r["count"] for r in rows}
    for n in range(1, SMALL + 1):
        parts, spare = parts_of(levels(np.array([n]), percent) + np.array([0, 1]), percent)
        if sets.get(n, 0) * subsets(n, percent) > sets.get(n, 0) * (int((parts - spare).sum()) + n):
            break
        best = n
    return best


def starred(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least owner, and edges from the other owners of a key to that one."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = owners[np.flatnonzero(first)][np.cumsum(first) - 1] if len(keys) else owners
    other = np.flatnonzero(owners != least)
    return keys[first], owners[first], *distinct(owners[other], least[other])


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def possible_links(docs: DataFrame, largest: int, gram: int, percent: int, shards: int) -> DataFrame:
    """Edges (a, b) of fingerprints whose sets share a list, each to the least one of the list."""
    smallest = int(least_partner(np.int64(largest + 1), percent))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0

        def flush() -> pa.RecordBatch:
            keys, owners, a, b = starred(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = np.searchsorted(keys >> _U(32), (np.arange(shards + 1, dtype=_U) << _U(32)) // _U(shards))
            rows = [(s, keys[lo:hi].tobytes(), owners[lo:hi].tobytes(), b"", b"") for s, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if lo < hi]
            rows += [(int(x) % shards, b"", b"", a[i:i + 65536].tobytes(), b[i:i + 65536].tobytes()) for x, i in enumerate(range(0, len(a), 65536))]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "keys", "owners", "a", "b"])

        for batch in batches:
            for h, offsets in gram_sets(batch.column("text"), gram):
                n = np.diff(offsets)
                f1 = _fingerprint(h, offsets)[0]
                for keys, rows in (part_keys(h, offsets, np.flatnonzero((n >= smallest) & (n > 0)), percent),
                                   subset_keys(h, offsets, np.flatnonzero((n <= largest) & (n > 0)), percent)):
                    held.append((keys, f1[rows]))
                    pending += len(keys)
                if pending > SHARD_ENTRIES:
                    yield flush()
                    held, pending = [], 0
        if pending:
            yield flush()

    def lists(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, a, b = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for out, name, kind in ((keys, "keys", _U), (owners, "owners", np.int64), (a, "a", np.int64), (b, "b", np.int64)):
                out += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)]
        _, _, ea, eb = starred(np.concatenate(keys), np.concatenate(owners))
        left, right = distinct(np.concatenate([*a, ea]), np.concatenate([*b, eb]))
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    packed = docs.select("text").mapInArrow(entries, "shard int, keys binary, owners binary, a binary, b binary")
    return packed.groupBy("shard").applyInArrow(lists, "a long, b long")


def in_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that its own block of the key is in."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    rows = rows.withColumns({"_blocks": blocks, "_own": own})
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"b1": F.least("_own", "_other"), "b2": F.greatest("_own", "_other")}).drop("_blocks", "_other", size)
    return rows.repartition(key, "b1", "b2").sortWithinPartitions(key, "b1", "b2", "cid")


def by_group(keys: list[str], work: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable:
    """Streams sorted rows and hands ``work`` whole groups, many small ones at a time; yields edge batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in work(t):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                v = b.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
                if len(held) > 1:
                    change[0] |= held[-2].column(k)[-1].as_py() != v[0]
            cut = np.flatnonzero(change)
            if len(cut):  # all but the last group are whole
                last = int(cut[-1])
                yield from out(pa.Table.from_batches([*held[:-1], b.slice(0, last)]))
                held = [b.slice(last)]
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


class Forest:
    """Union-find over positions 0..n-1; keeps the joins that made it."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Signatures as rows of so many words: halves of a wider one are added up, as its cells would be."""
    rows = np.frombuffer(b"".join(bits), _U).reshape(len(bits), -1, words)
    return np.bitwise_xor.reduce(rows, axis=1)


def possible_pairs(n: np.ndarray, bits: list[bytes], own: np.ndarray, across: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member those at least as large that sizes and signatures don't rule out; ``across``: only of the other block."""
    order = np.argsort(n, kind="stable")
    n, own, bits = n[order], own[order], [bits[i] for i in order]
    words = np.array([len(b) // 8 for b in bits])  # grow with n
    top = np.searchsorted(n, 100 * n // percent, "right")
    kinds = np.unique(words)
    for w in kinds:
        lo, hi = np.searchsorted(words, [w, w + 1])
        at = np.searchsorted(words, [*kinds[kinds >= w], kinds[-1] + 1]).clip(max=top[hi - 1])
        table = np.concatenate([_folded(bits[i:j], w) for i, j in itertools.pairwise(at) if i < j])
        for i in range(lo, hi):
            j = np.arange(i + 1, top[i])
            if across:
                j = j[own[j] != own[i]]
            if len(j):
                apart = np.bitwise_count((table[j - lo] if across else table[i + 1 - lo:top[i] - lo]) ^ table[i - lo]).sum(1, dtype=np.int64)
                j = j[apart <= n[j] + n[i] - 2 * need(n[j], n[i], percent)]
                if len(j):
                    yield order[i], order[j]


def _columns(t: pa.Table) -> tuple:
    return (t.column("cid").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("bits").to_pylist(), t.column("_own").to_numpy(),
            t.column("b1").to_numpy() != t.column("b2").to_numpy())


def _bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [t.num_rows]])


def _in_pieces(members: DataFrame, block: int, compared: Callable[[pa.Table, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Distinct edges (a, b) that ``compared`` finds in the pairs of blocks; it gets rows of whole pairs and their bounds."""
    keys = ["group", "b1", "b2"]

    def work(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Rows are copied a few groups at a time, never all that arrived in one batch.
        start, ends = 0, _bounds(t, keys)[1:]
        for end, after in zip(ends, [*ends[1:], None], strict=True):
            if after is None or after - start > 2 * block:
                piece = t.slice(start, end - start)
                piece = piece.take(_bounds(piece, [*keys, "cid"])[:-1])  # a class that several tasks read stands once
                yield from compared(piece, _bounds(piece, keys))
                start = end

    return in_blocks(members, "group", "members", block).mapInArrow(by_group(keys, work), "a long, b long").distinct()


def likely_links(members: DataFrame, percent: int) -> DataFrame:
    """Spanning forests of the pairs of each group that sizes and signatures don't rule out."""

    def compared(t: pa.Table, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cid, n, bits, own, across = _columns(t)
        a, b = [], []
        for lo, hi in itertools.pairwise(at):
            tree = np.arange(hi - lo)
            for i, js in possible_pairs(n[lo:hi], bits[lo:hi], own[lo:hi], bool(across[lo]), percent):
                js = js[tree[js] != tree[i]]
                if len(js):
                    trees, first = np.unique(tree[js], return_index=True)
                    a.append(np.full(len(first), cid[lo + i]))
                    b.append(cid[lo + js[first]])
                    tree[np.isin(tree, trees)] = tree[i]
        if a:
            yield np.concatenate(a), np.concatenate(b)

    return _in_pieces(members, SIGNED_BLOCKS * BLOCK, compared)


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """Spanning forests of the pairs of each group whose sets do link."""

    def compared(t: pa.Table, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cid, n, bits, own, across = _columns(t)
        lists = t.column("elements").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(_U)  # sorted as unsigned
        a, b = [], []
        for lo, hi in itertools.pairwise(at):
            f = Forest(hi - lo)
            for i, js in possible_pairs(n[lo:hi], bits[lo:hi], own[lo:hi], bool(across[lo]), percent):
                mine = flat[ends[lo + i]:ends[lo + i + 1]]
                for j in js:
                    if f.root(int(i)) != f.root(int(j)):
                        theirs = flat[ends[lo + j]:ends[lo + j + 1]]
                        spot = np.searchsorted(mine, theirs)
                        spot[spot == len(mine)] = 0
                        shared = int(np.count_nonzero(mine[spot] == theirs))
                        if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                            f.join(int(i), int(j))
            a += [cid[lo + i] for i, _ in f.edges]
            b += [cid[lo + j] for _, j in f.edges]
        yield np.array(a, np.int64), np.array(b, np.int64)

    return _in_pieces(members, BLOCK, compared)


def elements_of(docs: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """Sets of the documents whose id and fingerprint pass the bit table of ``wanted``, a superset of those wanted."""
    slot = F.shiftrightunsigned(F.col("f1").bitwiseXOR(F.xxhash64("rep")), 64 - TABLE_BITS).cast("int")
    slots = wanted.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()  # at most 2**TABLE_BITS
    on = np.zeros(1 << TABLE_BITS, bool)
    on[slots] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(on))
    rows = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("doc_id").alias("id_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        seen: set[tuple[int, int, int]] = set()
        for b in batches:
            at, ids = 0, b.column("id_hash").to_numpy()
            for h, offsets in gram_sets(b.column("text"), gram):
                f1, f2 = _fingerprint(h, offsets)
                n = len(f1)
                slot = ((f1 ^ ids[at:at + n]).view(_U) >> _U(64 - TABLE_BITS)).astype(np.int64)
                keep = np.flatnonzero((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
                once = []
                for i, name in zip(keep, zip(ids[at:at + n][keep].tolist(), f1[keep].tolist(), f2[keep].tolist(), strict=True), strict=True):
                    if name not in seen:
                        seen.add(name)
                        once.append(i)
                keep = np.array(once, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").slice(at, n).take(pa.array(keep)), pa.array(f1[keep]), pa.array(f2[keep]), lists.take(pa.array(keep))],
                    names=["rep", "f1", "f2", "elements"])
                at += n

    schema = T.StructType([rows.schema["rep"], *T._parse_datatype_string("f1 long, f2 long, elements array<long>").fields])
    return rows.mapInArrow(run, schema)


def sized(groups: DataFrame) -> DataFrame:
    """Members of groups with how many their group has."""
    return groups.join(groups.groupBy("group").agg(F.count("*").cast("int").alias("members")), "group")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id, the smallest doc_id that links lead to."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = written(signatures(rows, gram), "signatures")
    classes = sig.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    elements = sig.agg(F.sum("n")).first()[0] or 0
    # An entry for each part of both levels: about a quarter as many as elements at 90 percent, over half as many at 80.
    shards = max(1, math.ceil(elements * 9 * (100 - percent) / (4 * percent) / SHARD_ENTRIES))
    groups = components(possible_links(rows, boundary(classes, percent), gram, percent, shards))
    groups = groups.select(F.col("vertex").alias("f1"), F.col("component").alias("group"))
    # Two sets may have half of their fingerprints in common by chance: that only makes a group larger.
    groups = sized(groups.join(classes, "f1").select("cid", "n", "bits", "group"))
    likely = components(likely_links(groups, percent)).select(F.col("vertex").alias("cid"), F.col("component").alias("group"))
    wanted = written(sized(likely).join(classes, "cid"), "groups")
    sets = elements_of(rows, wanted, gram)
    same = (wanted["f1"] == sets["f1"]) & (wanted["f2"] == sets["f2"]) & wanted["rep"].eqNullSafe(sets["rep"])
    members = wanted.join(sets, same).select(wanted["cid"], wanted["n"], wanted["bits"], wanted["group"], wanted["members"], sets["elements"])
    linked = components(verified_links(members, percent))
    named = linked.join(classes.select(F.col("cid").alias("vertex"), "rep"), "vertex")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "component").select("vertex", "component_id")
    labels = classes.join(of_class, classes["cid"] == of_class["vertex"], "left").select(
        "f1", "f2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    n = F.col("n").cast("long").alias("n_shingles")
    whole = sig.where("n > 0").join(labels, ["f1", "f2", "n"]).select("doc_id", n, "component_id")
    return whole.union(sig.where("n = 0").select("doc_id", n, F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those linked, over any number of links, with one of a smaller id. Null ids stay."""
    doc_id = options.get("doc_id", "doc_id")
    found = jaccard_components(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(found, docs[doc_id] == found["copy_id"], "left_anti")
