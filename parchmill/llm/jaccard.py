"""Exact Jaccard join of word n-gram sets, size-aware: light sets and heavy sets (operator 3).

Sizes fall into bands, so that a set and a larger one it may link with lie in one band or in two that
adjoin. Each band of the smaller set has a scheme of keys, and two sets that link under it share a key:

* light bands: every link shares c elements or more, so a set emits each of its subsets of that fixed size;
* heavy bands: two linked sets differ in H elements at most. The universe is dealt into H + 2 blocks, so at
  least two blocks are equal; each set is entered into the inverted lists of its blocks' contents. Lists of
  single elements would hold a third of all documents for a common phrase; a list of a whole block holds
  sets that agree in about ten elements. A set without elements in a block leaves that list out, unless it
  has two such blocks (one equal block with elements is left in any case).

The boundary between the two is chosen by cost: of the keys that every set of a small band would have either way, one in PROBED lists is
kept whole and measured, how many members it has and how many pairs that makes; the boundary is where the sum of both sides is
least. It changes no result.

Lists are read in order by one task each. Every set has a parity sketch per scheme, a bit for each hash class of
elements; two sketches differ in at most as many bits as the sets differ in elements, so a pair over its bound
can't link and is never made. Of the pairs within their bound a list first gives only a spanning forest, which is
confirmed on the texts' sets. Lists that gave a pair and whose members have then not met in one component are read a second time, and give
every pair within its bound of members that are apart and weren't confirmed before; a list that gave none has none. So a group of
thousands of copies costs about a confirmation for each, and no link between components is lost. Lists with equal members are
one list; those of over MOST_IN_LIST members are read in pairs of blocks.

Null text and text without words: an empty set, linked with nothing, not even with another empty one. Rows
that share a doc_id are one node. Equal sets are one class, found by 128 bits of an additive hash. A row of null doc_id
is no node and links with nothing, but has the component of rows of an equal set, or null where none has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.common import SPACED, blocks, grams, mix, partitions, sized, stored, within, words
from parchmill.llm.components import components

#: What it costs to emit a key, and to move a member of a list with its sketch, in comparisons of two sketches.
EMIT, MOVE = 4, 32
#: One list in this many is measured to choose the boundary; subsets of a set beyond which it can't be light.
PROBED, MOST_SUBSETS = 64, 512
#: Ids that may be broadcast to choose texts by (8 bytes each); beyond, they are joined.
MOST_IDS = 500_000
#: Digests by which a task knows that it has emitted a set's keys.
KNOWN = 200_000
#: Members that a task reads of one list at once; lists up to FEW are compared without arrays.
MOST_IN_LIST, FEW = 50_000, 24
#: Bits of a sketch for each element in which linked sets may differ.
SPARE = 4
#: Low bits of a key that name its scheme.
SCHEMES = 1024
S1, S2, S3, S4 = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block, and each document's first one."""
    h, _, _, woff = words(data, off, SPACED)
    g = grams(h, k)
    values = g[within(woff, k, len(g))]
    n_words = np.diff(woff)
    n = np.maximum(n_words - k + 1, 0)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(n)])[short]
        values = np.insert(values, at, [grams(h[woff[d] : woff[d + 1]], int(n_words[d]))[0] ^ S3 for d in short.tolist()])
        n[short] = 1
    first = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[first[:-1][first[:-1] < len(values)]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (S1, S2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ seed))])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


class Schemes:
    """Bands of sizes and their keys for one threshold num / den."""

    def __init__(self, num: int, den: int, boundary: int = 0) -> None:
        self.num, self.den, self.boundary = num, den, boundary  # bands under the boundary are light
        self.low = [1]

    def up(self, n: int) -> int:
        """The largest size that a set of n elements may link with."""
        return n * self.den // self.num

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.up(self.low[-1]) + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    @lru_cache(maxsize=None)
    def of(self, i: int) -> tuple[int, int, int]:
        """(largest size under scheme i, blocks or 0 if the scheme is light, size of subsets)."""
        most = self.up(self.low[i])
        top = self.up(most)
        shared = -(-self.num * 2 * self.low[i] // (self.num + self.den))
        parts = (most + top) * (self.den - self.num) // (self.den + self.num) + 2
        return top, 0 if i < self.boundary and self.may_be_light(i) else parts, shared

    @lru_cache(maxsize=None)
    def may_be_light(self, i: int) -> bool:
        most = self.up(self.low[i])
        return self.low[i] < 64 and math.comb(self.up(most), -(-self.num * 2 * self.low[i] // (self.num + self.den))) <= MOST_SUBSETS

    def keys(self, values: np.ndarray, first: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the sets chosen by `emit`, and for each key its set."""
        sizes = np.diff(first)
        plans = [(d, i, *self.of(i)) for d in np.flatnonzero(emit & (sizes > 0)).tolist() for n in [int(sizes[d])] for i in [self.band(n), self.band(n) - 1] if i >= 0 and n <= self.of(i)[0]]
        out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        element = mix(values ^ S3)
        heavy = [(d, i, parts) for d, i, _, parts, _ in plans if parts]
        for at in range(0, len(heavy), 512):
            d, i, parts = (np.array(x) for x in zip(*heavy[at : at + 512], strict=True))
            n = sizes[d]
            which = np.repeat(np.arange(len(d)), n)
            e = element[np.arange(len(which)) + np.repeat(first[d] - (np.cumsum(n) - n), n)]
            base = np.cumsum(parts) - parts
            block = base[which] + ((e >> np.uint64(33)) % parts[which].astype(np.uint64)).astype(np.int64)
            total = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(total, block, e)
            of = np.repeat(np.arange(len(d)), parts)
            empty = np.bincount(block, minlength=len(total)) == 0
            some = np.bincount(of, empty, len(d)) >= 2
            place = np.arange(len(total)) - base[of]
            key = mix(total + mix((i[of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + S1)) & ~np.uint64(SCHEMES - 1) | (i[of] % SCHEMES).astype(np.uint64)
            use = ~empty | some[of]
            out.append(key[use])
            owner.append(d[of][use])
        for d, i, _, parts, shared in plans:
            if not parts:
                e = element[first[d] : first[d + 1]]
                total = np.full(1, e.sum(dtype=np.uint64))
                left = total - np.array([e[list(c)].sum(dtype=np.uint64) for c in combinations(range(len(e)), len(e) - shared)], np.uint64)
                out.append(mix(left + mix(np.array([i], np.uint64) + S2)) & ~np.uint64(SCHEMES - 1) | np.uint64(i % SCHEMES))
                owner.append(np.full(len(left), d))
        return np.concatenate(out), np.concatenate(owner)

    def differ(self, a: int | np.ndarray, b: int) -> int | np.ndarray:
        """The most elements in which linked sets of these sizes differ."""
        n = a + b
        return n - 2 * -(-self.num * n // (self.num + self.den))

    def sketches(self, values: np.ndarray, first: np.ndarray) -> list[list[dict]]:
        """For each set and each scheme of it, the parity of each hash class of its elements."""
        out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
        element = mix(values ^ S4)
        for d, n in enumerate(np.diff(first).tolist()):
            for i in (self.band(n), self.band(n) - 1) if n else ():
                if i >= 0 and n <= self.of(i)[0]:
                    width = 1 << max(7, (SPARE * self.differ(self.of(i)[0], self.of(i)[0]) - 1).bit_length())
                    odd = np.bincount((element[first[d] : first[d + 1]] & np.uint64(width - 1)).view(np.int64), minlength=width) & 1
                    out[d].append({"scheme": i % SCHEMES, "sketch": np.packbits(odd.astype(np.uint8)).tobytes()})
        return out


def probes(values: np.ndarray, first: np.ndarray, num: int, den: int) -> list[list[dict]]:
    """For each set that might be light the keys that it would have as a heavy and as a light one (kind 0, 1), in the lists that are measured."""
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    schemes = Schemes(num, den), Schemes(num, den, 1 << 30)
    sizes = np.diff(first).tolist()
    small = np.array([0 < n < 128 and (schemes[1].may_be_light(schemes[1].band(n)) or schemes[1].may_be_light(max(0, schemes[1].band(n) - 1))) for n in sizes], bool)
    for kind, one in enumerate(schemes):
        key, owner = one.keys(values, first, small)
        use = (key >> np.uint64(10)) % np.uint64(PROBED) == 0
        for k, d in zip(key[use].view(np.int64).tolist(), owner[use].tolist(), strict=True):
            if schemes[1].may_be_light(k & SCHEMES - 1):
                out[d].append({"kind": kind, "key": k})
    return out


def boundary(plain: DataFrame) -> int:
    """The band from which on sets are heavy, by the measured lists (two numbers a band and kind) of rows (d1, d2, probes)."""
    lists = plain.select("d1", "d2", F.inline("probes")).distinct().groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    cost = F.col("n") * EMIT + F.when(F.col("n") > 1, F.col("n") * MOVE + F.col("n") * (F.col("n") - 1) / 2).otherwise(0)
    sums = lists.groupBy("kind", F.col("key").bitwiseAND(F.lit(SCHEMES - 1)).alias("band")).agg(F.sum(cost).alias("cost")).collect()
    of = {(r["kind"], r["band"]): float(r["cost"]) for r in sums}
    bands = sorted({b for _, b in of})
    total = {b: sum(of.get((1, x), 0.0) for x in bands if x < b) + sum(of.get((0, x), 0.0) for x in bands if x >= b) for b in [0, *(x + 1 for x in bands)]}
    return min(total, key=lambda b: (total[b], b))


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def sets_of(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketches, probes): size, digest, sketches and measured keys of each row's set."""
    kind = pa.list_(pa.struct([("scheme", pa.int32()), ("sketch", pa.binary())]))
    probed = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(num, den)
        for batch, data, off in blocks(batches):
            values, first = shingles(data, off, k)
            d1, d2 = digests(values, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(schemes.sketches(values, first), kind), pa.array(probes(values, first, num, den), probed)], ["doc_id", "n_shingles", "d1", "d2", "sketches", "probes"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketches array<struct<scheme:int,sketch:binary>>, probes array<struct<kind:int,key:long>>")


def keys_of(docs: DataFrame, k: int, num: int, den: int, boundary: int) -> DataFrame:
    """(key, doc_id): the keys of each set; a task emits equal sets once, for the first row that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, known = Schemes(num, den, boundary), set()
        for batch, data, off in blocks(batches):
            values, first = shingles(data, off, k)
            emit = np.zeros(len(off) - 1, bool)
            named = batch.column("doc_id").is_valid().to_pylist()
            for d, x in enumerate(zip(*(y.tolist() for y in digests(values, first)), strict=True)):
                if named[d] and x not in known:
                    emit[d] = True
                    known.add(x)
            if len(known) > KNOWN:
                known.clear()
            key, owner = schemes.keys(values, first, emit)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(off)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key[order].view(np.int64)))], ["doc_id", "keys"])

    return docs.mapInArrow(run, "doc_id long, keys array<long>").select(F.explode("keys").alias("key"), "doc_id")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose texts' sets link."""
    ids = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct())
    few = ids.count() <= MOST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    texts = stored(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            ok = []
            for i, (u, v) in enumerate(zip(us, vs, strict=True)):
                if (v, text := batch.column("tv")[i].as_buffer()) != last:
                    data = np.frombuffer(text, np.uint8) if text is not None else np.zeros(0, np.uint8)
                    last, y = (v, text), shingles(data, np.array([0, len(data)]), k)[0]
                text = batch.column("tu")[i].as_buffer()
                data = np.frombuffer(text, np.uint8) if text is not None else np.zeros(0, np.uint8)
                ok.append(linked(shingles(data, np.array([0, len(data)]), k)[0], y, num, den))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
    return stored(both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long").distinct())


def forest(x: list[int], n: list[int], root: list[int], sketch: list[bytes], failed: list[frozenset], schemes: Schemes, every: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of one list, within their bounds and not failed, that span what its members' components can be joined to; or every such pair."""
    classes: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        classes.setdefault(r, []).append(i)
    if len(classes) < 2:
        return
    few = len(x) <= FEW
    if few:
        bits = [int.from_bytes(b, "little") for b in sketch]
    else:
        bits = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(x), -1)
        sizes, roots = np.array(n), np.array(root)
    if every:
        for i in range(len(x)):
            if few:
                near = [j for j in range(i) if root[i] != root[j] and (bits[i] ^ bits[j]).bit_count() <= schemes.differ(n[i], n[j])]
            else:
                far = np.flatnonzero(roots[:i] != root[i])
                near = far[np.bitwise_count(bits[far] ^ bits[i]).sum(1) <= schemes.differ(sizes[far], n[i])].tolist()
            yield from ((x[i], x[j]) for j in near if x[j] not in failed[i])
        return
    waiting = dict.fromkeys(classes)
    while waiting:
        r = next(iter(waiting))
        del waiting[r]
        reached = list(classes[r])
        far = None if few else np.flatnonzero(np.isin(roots, np.fromiter(waiting, np.int64, len(waiting))))
        for i in reached:
            if not waiting:
                break
            if few:
                near = [j for w in waiting for j in classes[w] if (bits[i] ^ bits[j]).bit_count() <= schemes.differ(n[i], n[j])]
            else:
                near = far[np.bitwise_count(bits[far] ^ bits[i]).sum(1) <= schemes.differ(sizes[far], n[i])].tolist()
            some = False
            for j in near:
                if root[j] in waiting and x[j] not in failed[i]:
                    yield x[i], x[j]
                    del waiting[root[j]]
                    reached += classes[root[j]]
                    some = True
            if some and not few:
                far = far[np.isin(roots[far], np.fromiter(waiting, np.int64, len(waiting)))]


def candidates(rows: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """(u, v, key): the pairs to confirm of (key, a, b, x, n, root, sketch, failed), and the list of each; one (key, a, b) is one list or
    a pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, now, held = Schemes(num, den), None, []
        out: list[tuple[int, int, int]] = []

        def of_list() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                for pair in forest(*zip(*held, strict=True), schemes, every):
                    out.append((*pair, now[0]))
                    if len(out) >= 10_000:
                        yield pairs(out)
                        out.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "x", "n", "root", "sketch", "failed")), strict=True):
                if row[:3] != now:
                    yield from of_list()
                    now, held = row[:3], []
                held.append((*row[3:7], frozenset(row[7] or ())))
        yield from of_list()
        yield pairs(out)

    def pairs(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        u, v, key = np.array([(max(p[:2]), min(p[:2]), p[2]) for p in out], np.int64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(key)], ["u", "v", "key"])

    dealt = rows.repartition(partitions(rows.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b", "x")
    return dealt.select("key", "a", "b", "x", "n", "root", "sketch", "failed").mapInArrow(run, "u long, v long, key long").filter("u > v")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles and component_id, the least doc_id reachable by
    links of sets of k-word shingles with Jaccard similarity num / den or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = stored(sets_of(docs, k, num, den))
    classes = plain.filter("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    rows = plain.count()
    sets = stored(sized(plain.drop("sketches", "probes").join(classes, ["n_shingles", "d1", "d2"], "left"), rows))
    key = Window.partitionBy("key")
    shared = keys_of(docs, k, num, den, boundary(plain)).withColumn("lo", F.min("doc_id").over(key)).withColumn("hi", F.max("doc_id").over(key)).filter("lo < hi").select("key", "doc_id")
    members = stored(shared).join(sets.select("doc_id", "rep", "n_shingles").distinct(), "doc_id").select("key", F.col("rep").alias("x"), F.col("n_shingles").alias("n")).distinct()
    # Lists of equal members are one: its key is a hash of them. Its scheme is told by the old key.
    members = members.withColumn("of", F.sum(F.xxhash64("x", "n").cast("decimal(20,0)")).over(key)).withColumn("many", F.count(F.lit(1)).over(key)).filter("many > 1")
    members = members.withColumn("scheme", F.col("key").bitwiseAND(F.lit(SCHEMES - 1)).cast("int")).select(F.xxhash64("of", "many", "scheme").alias("key"), "scheme", "x", "n").distinct()
    lists = stored(members.withColumn("block", F.floor((F.row_number().over(key.orderBy("x", "n")) - 1) / MOST_IN_LIST).cast("int")).withColumn("last", F.max("block").over(key)))
    reps = sets.filter("doc_id = rep").select("doc_id", "n_shingles", "d1", "d2").distinct()
    sketch = plain.join(reps, ["doc_id", "n_shingles", "d1", "d2"], "left_semi").select(F.col("doc_id").alias("x"), F.inline("sketches")).distinct()
    sketch = stored(sized(sketch, 2 * rows))
    found = failed = roots = some = None
    for every in (False, True):
        members = lists.withColumn("root", F.col("x"))
        if every:
            members = members.filter("last > 0").union(members.filter("last = 0").join(some.select("key").distinct(), "key", "left_semi").select(members.columns))
        if roots is not None:
            members = members.drop("root").join(roots.select(F.col("u").alias("x"), F.col("v").alias("root")), "x", "left").withColumn("root", F.coalesce("root", "x"))
            members = members.withColumn("lo", F.min("root").over(key)).withColumn("hi", F.max("root").over(key)).filter("lo < hi").drop("lo", "hi")
        # A long list begins with its blocks by themselves and with the first one; only what is then apart meets block by block.
        other = F.sequence(F.lit(0), F.col("last")) if every else F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array(F.lit(0), F.col("block")))
        members = members.withColumn("other", F.explode(other)).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
        members = members.join(sketch, ["x", "scheme"])
        if failed is None:
            members = members.withColumn("failed", F.array().cast("array<long>"))
        else:
            each = failed.union(failed.select(F.col("v").alias("u"), F.col("u").alias("v")))
            members = members.join(each.groupBy(F.col("u").alias("x")).agg(F.collect_list("v").alias("failed")), "x", "left")
        some = stored(candidates(members, num, den, every))
        if some.isEmpty():
            continue  # the blocks of a long list have not all met in the first reading
        pairs = stored(some.select("u", "v").distinct())
        ok = confirm(pairs, docs, k, num, den)
        failed = stored(pairs.join(ok, ["u", "v"], "left_anti"))
        found = ok if found is None else stored(found.union(ok))
        roots = components(found)
    twins = _twins(sets)
    if not twins.isEmpty():
        roots = components(twins if found is None else found.union(twins))
    if roots is None:
        return sets.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))
    by = roots.withColumnRenamed("u", "rep").withColumnRenamed("v", "root")
    return sized(sets.join(by, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id")), rows)


def _twins(sets: DataFrame) -> DataFrame:
    """Links of the classes of rows that share a doc_id."""
    own = Window.partitionBy("doc_id")
    classes = sets.filter("rep is not null").select("doc_id", "rep").distinct()
    return classes.withColumn("least", F.min("rep").over(own)).filter("rep > least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
