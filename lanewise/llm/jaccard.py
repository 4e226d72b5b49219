"""N-gram Jaccard join by PartEnum signatures: the feature domain is cut into partitions, subsets of partitions are
enumerated, and sets of one band of sizes that are similar enough share a signature. Candidates are verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, LAST_ID, Rolling, Staged, batch, chunks, heads, hot_join, keyed, mix, release, stage, text_bytes, unstage, word_table
from .components import components as components_of

#: Words in a shingle; similarity, in hundredths.
SHINGLE, PERCENT = 5, 75
#: PartEnum: each first-level partition is cut into SECOND parts, of which K2 may differ: every choice of SECOND - K2
#: parts is a signature. There are SLACK times as many first-level partitions as full ones would need. Two of three parts
#: give 1.5 signatures for each difference that is allowed (two of five 2.5), and more sets are safe with the first seed.
SECOND, K2, SLACK = 3, 1, 1.15
#: Bands of sets up to this size use the prefix filter, and so do sets that are too sparse for every seed.
SMALL, SEEDS = 32, 2
#: Features or signatures that one task of the exchange gets, about.
BUCKET = 1_000_000
#: Nodes on either side of a cell of pairs at most, and bytes of their sketches; words of sketches compared at once.
CELL, CELL_BYTES, BLOCK = 2048, 8 << 20, 1 << 20
#: Groups of one lead become one where that has no more than so many times their pairs.
LOOSE = 4


class Shingles:
    """Distinct shingle hashes of the texts of a chunk: `hash`, sorted in each text, and `text`, its number."""

    def __init__(self, texts: pa.ChunkedArray, rolling: Rolling, size: int = SHINGLE):
        raw, at = text_bytes(texts)
        _, _, words, first = word_table(raw, at, lower=True)
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(words)) - first[text] if len(words) else np.zeros(0, np.int64)
        length = np.minimum(size, n)[text] if len(words) else np.zeros(0, np.int64)
        start = np.flatnonzero(place + length <= n[text]) if len(words) else np.zeros(0, np.int64)
        hashed = rolling.windows(rolling.prefix(words), start, start + length[start]) + mix(length[start])
        text = text[start]
        order = np.lexsort((hashed, text))
        hashed, text = hashed[order], text[order]
        own = heads(text, hashed)
        self.hash, self.text = hashed[own], text[own]
        self.size = np.bincount(self.text, minlength=len(n))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def place(self) -> np.ndarray:
        return np.arange(len(self.hash)) - self.first[self.text]

    def only(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and texts of the features of some texts."""
        at = keep[self.text]
        return self.hash[at], self.text[at]


def _names(found: Shingles, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that name the set of each of n texts."""
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(one, found.text, mix(found.hash + np.uint64(BASES[1])))
    np.add.at(two, found.text, mix(found.hash ^ np.uint64(BASES[2])))
    return one.view(np.int64), two.view(np.int64)


#: Rows of an exchange, in packed numbers: in a bucket the values that one node of a chunk has (asks, with the node),
#: those that several have (tells), and, dealt by node, what is decided already (done: a value's whole name and a node).
PARCELS = "bucket int, values binary, nodes binary, tells binary, done binary, owners binary"


def levels(size: np.ndarray) -> np.ndarray:
    """log2 of the words of 64 bits in a set's sketch: the least power of two with four bits for each feature."""
    return np.ceil(np.log2(np.maximum(size, 16) / 16)).astype(np.int64)


class Sketches:
    """Parity sketches: bit h modulo the sketch's length tells whether an odd number of features falls on it. A feature
    in which two sets differ flips one bit, so the bits that differ are no more than the features that do."""

    def __init__(self, found: "Shingles"):
        self.words = 1 << levels(found.size)
        self.first = np.concatenate([[0], np.cumsum(self.words)])
        self.bits = np.zeros(self.first[-1], np.uint64)
        bit = mix(found.hash ^ np.uint64(BASES[0])) & (self.words[found.text].astype(np.uint64) * np.uint64(64) - np.uint64(1))
        np.bitwise_xor.at(self.bits, self.first[found.text] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))

    def of(self, text: int) -> bytes:
        return self.bits[self.first[text] : self.first[text + 1]].tobytes()


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of the shortest one's length: halves of a longer one are joined by exclusive or."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])


def _spans(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and the buckets' edges in it."""
    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _packed(numbers: np.ndarray) -> bytes:
    """Nodes as differences, which compress."""
    return np.diff(numbers, prepend=0).tobytes()


def _unpacked(column: pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    cut = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([np.zeros(0, kind), *([np.cumsum(x) for x in cut] if kind is np.int64 else cut)])


def _parcels(key: np.ndarray, node: np.ndarray, buckets: int, local: bool = True, most: int = 1) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows for the exchange, and which of the (key, node) more than `most` nodes of the chunk share. Those are decided
    here: the key's bucket is told once. With `local` they travel on as decided, dealt by node, so a key of any share of all nodes
    costs its bucket one number for each chunk. Keys go by 32 bits and their bucket; those that agree by chance only make
    more candidates."""
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    value = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    name = (bucket << 32) | value.astype(np.int64)
    at = np.lexsort((node, name))
    one = at[heads(name[at], node[at])]
    head = heads(name[one])
    count = np.diff(np.append(np.flatnonzero(head), len(one)))
    several = np.zeros(len(key), bool)
    several[one] = np.repeat(count > most, count)
    asks, tells = one[~several[one]], one[head & several[one]]
    asks.sort()
    done = np.sort(one[several[one]]) if local else one[:0]
    to = (mix(node[done].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    columns: list[list] = [[], [], [], [], [], []]
    (a, ae), (t, te), (d, de) = _spans(bucket[asks], buckets), _spans(bucket[tells], buckets), _spans(to, buckets)
    for b in range(buckets):
        x, y, z = asks[a[ae[b] : ae[b + 1]]], tells[t[te[b] : te[b + 1]]], done[d[de[b] : de[b + 1]]]
        if len(x) or len(y) or len(z):
            for column, cell in zip(columns, (b, value[x].tobytes(), _packed(node[x]), value[y].tobytes(), name[z].tobytes(), _packed(node[z])), strict=True):
                column.append(cell)
    return batch([c.split()[0] for c in PARCELS.split(", ")], pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])), several


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and nodes of a bucket whose value another node has too."""
    value, node, tell = _unpacked(table["values"], np.uint32), _unpacked(table["nodes"]), np.unique(_unpacked(table["tells"], np.uint32))
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    one = heads(value, node)
    value, node = value[one], node[one]
    count = np.diff(np.append(np.flatnonzero(heads(value)), len(value)))
    many = np.repeat(count > 1, count) | np.isin(value, tell)
    return value[many], node[many]


#: Features with a hash under this are half of the domain.
HALF = np.uint64(1 << 63)

#: Rows of the first pass: a set's names and sizes for each document, with the features that were met in its own chunk,
#: and parcels of the features in half of the domain.
KNOWN = "_doc bigint, _text bigint, n bigint, half bigint, s1 bigint, s2 bigint, met bigint"


def _sets(size: int, buckets: int):
    """n, the features in half of the domain, and two sums that name the set, for each row; and parcels of those
    features, once for each set in a chunk."""
    names = [c.split()[0] for c in f"{KNOWN}, {PARCELS}".split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * 5

    def full(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return batch(names, *(pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for table in chunks(batches, "text"):
            found = Shingles(table["text"], rolling, size)
            one, two = _names(found, table.num_rows)
            inside = found.hash < HALF
            counts = np.bincount(found.text[inside], minlength=table.num_rows)
            first = np.zeros(table.num_rows, bool)
            first[np.unique(one, return_index=True)[1]] = True
            inside &= first[found.text]
            text = found.text[inside]
            parcels, several = _parcels(mix(found.hash[inside]), one[text], buckets, False)
            met = np.bincount(text[several], minlength=table.num_rows)
            yield full(_doc=table["_doc"].to_numpy(), _text=table["_text"].to_numpy(), n=found.size, half=counts, s1=one, s2=two, met=met)
            yield full(**{c: parcels.column(c) for c in parcels.schema.names})

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of each set in the bucket, how many features some other set has too."""
    own, times = np.unique(_met(table)[1], return_counts=True)
    return pa.table({"s1": own, "shared": times.astype(np.int64)})


def bands(most: int) -> np.ndarray:
    """Upper ends of the bands of sizes: band i and i - 1 hold all partners of a set in band i."""
    out, low = [], 1
    while not out or out[-1] < most:
        out.append(low * 100 // PERCENT)
        low = out[-1] + 1
    return np.array([*out, low * 100 // PERCENT])


def signatures(found: Shingles, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the texts they stand for.

    In an instance for sets up to size r, two sets of similarity >= 3/4 differ in at most k = 2r/7 features. A difference
    spoils the signatures of one second-level part. To spoil every signature with a feature in it, a first-level
    partition with c parts that hold anything needs min(c, K2 + 1) differences. A set whose sum of these is over k is
    safe: it shares a signature with each of its partners. A set that isn't goes on to the next seed, and at last to the
    prefix filter; so of two partners the one that stops first finds the other."""
    top = bands(most)
    own = np.searchsorted(top, found.size)
    keys, texts = [], []

    def emit(key: np.ndarray, text: np.ndarray) -> None:
        keys.append(key)
        texts.append(text)

    place = found.place()
    for role in (0, 1):
        band = own + role
        r = top[np.minimum(band, len(top) - 1)]
        k = 2 * r // 7
        left = (found.size > 0) & (k > 0)
        for seed in range(SEEDS):
            big = left & (r > SMALL)
            if not big.any():
                break
            at = np.flatnonzero(big)
            n1 = np.ceil(SLACK * (k[at] + 1) / (K2 + 1)).astype(np.int64) + 1
            base = np.zeros(len(found.size), np.int64)
            base[at] = np.concatenate([[0], np.cumsum(n1 * SECOND)[:-1]])
            width = np.zeros(len(found.size), np.uint64)
            width[at] = n1 * SECOND
            feature, text = found.only(big)
            slot = mix(feature + np.uint64(BASES[seed]))
            part = base[text] + (((slot >> np.uint64(32)) * width[text]) >> np.uint64(32)).astype(np.int64)
            total = int(n1.sum()) * SECOND
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, part, mix(slot + np.uint64(BASES[2])))
            held = np.bincount(part, minlength=total).reshape(-1, SECOND) > 0
            sums = sums.reshape(-1, SECOND)
            cost = np.minimum(held.sum(1), K2 + 1)
            starts = np.concatenate([[0], np.cumsum(n1)[:-1]])
            safe = np.add.reduceat(cost, starts) > k[at]
            first = np.repeat(at, n1)
            name = mix(((np.arange(len(first)) - np.repeat(starts, n1)) * 64 + seed).astype(np.uint64) + (band[first].astype(np.uint64) << np.uint64(40)))
            for i, chosen in enumerate(combinations(range(SECOND), SECOND - K2)):
                some = held[:, chosen].any(1)
                key = name[some] + np.uint64(i)
                for c in chosen:
                    key = mix(key * np.uint64(BASES[1]) + sums[some, c])
                emit(key, first[some])
            done = np.zeros(len(found.size), bool)
            done[at[safe]] = True
            left &= ~done
        # two sets of similarity >= 3/4 share one of the first s - ceil(3s / 4) + 1 features of each
        rest = left[found.text] & (place < found.size[found.text] - (found.size[found.text] * PERCENT + 99) // 100 + 1)
        emit(mix(found.hash[rest] + (band[found.text[rest]].astype(np.uint64) << np.uint64(40))), found.text[rest])
    return np.concatenate(keys), np.concatenate(texts)


def _signed(size: int, buckets: int, most: int, nodes: int):
    """Parcels of the signatures. A signature goes to its bucket with all its nodes, unless its share of the chunk's nodes
    makes more than BUCKET in all: such are decided in their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for table in chunks(batches, "text"):
            found = Shingles(table["text"], rolling, size)
            key, text = signatures(found, most)
            yield _parcels(key, table["node"].to_numpy()[text], buckets, most=max(1, BUCKET * table.num_rows // nodes))[0]

    return run


def _groups(table: pa.Table) -> pa.Table:
    """Signatures that several nodes have (`met`, as numbers) and these nodes. Of a bucket's own groups, each set of nodes
    stays once; those that other chunks decided are passed on."""
    value, node = _met(table)
    bucket = int(table["bucket"][0].as_py())
    first = np.flatnonzero(heads(value))
    if len(first):
        size = np.diff(np.append(first, len(value)))
        named = np.add.reduceat(mix(node.view(np.uint64) + np.uint64(BASES[0])), first)
        told = np.isin(value[first], np.unique(_unpacked(table["tells"], np.uint32)))
        own = np.zeros(len(first), bool)
        own[np.unique(np.stack([named, size.astype(np.uint64)], 1), axis=0, return_index=True)[1]] = True
        keep = np.repeat(own | told, size)
        value, node = value[keep], node[keep]
    done = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in table["done"])])
    return pa.table({"met": np.concatenate([(bucket << 32) | value.astype(np.int64), done]), "node": np.concatenate([node, _unpacked(table["owners"])])})


#: Members of groups: `pairs` is the square of the group's size, on one row of it.
LED = "lead bigint, met bigint, node bigint, pairs double"


def _led(table: pa.Table) -> pa.Table:
    """_groups with each group's least node, its lead. Of what chunks decided no task has a whole group, so such a group
    has a lead of its own, below zero."""
    groups = _groups(table)
    met, node = groups["met"].to_numpy(), groups["node"].to_numpy()
    order = np.lexsort((node, met))
    met, node = met[order], node[order]
    first = np.flatnonzero(heads(met))
    size = np.diff(np.append(first, len(met)))
    bucket = int(table["bucket"][0].as_py())
    told = (bucket << 32) | np.unique(_unpacked(table["tells"], np.uint32)).astype(np.int64)
    done = [np.frombuffer(x.as_buffer(), np.int64) for x in table["done"]]
    part = np.isin(met[first], np.concatenate([told, *done]))
    pairs = np.zeros(len(met))
    pairs[first] = np.where(part, 0.0, size.astype(float) ** 2)
    return pa.table({"lead": np.repeat(np.where(part, -1 - met[first], node[first]), size), "met": met, "node": node, "pairs": pairs})


def united(led: DataFrame) -> DataFrame:
    """Groups (met, node) in which each pair of a group of `led` (lead, node, mets, pairs) is in some group.

    Near copies make a group for each of their signatures, of much the same nodes. Groups of one lead become one of all
    their nodes where that has no more than LOOSE times the pairs that they have together. Then a lead of which all nodes have the same group
    as the largest that they are in is left out with its groups: they are inside that one."""
    leads = led.groupBy("lead").agg(F.count("*").alias("nodes"), F.sum("pairs").alias("pairs"))
    leads = stage(leads.select("lead", "nodes", F.col("nodes").alias("size"), (F.col("nodes").cast("double") * F.col("nodes") > LOOSE * F.col("pairs")).alias("apart")), "jaccard-leads")
    total = leads.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    rows = hot_join(led.select("lead", "node", "mets"), leads, "lead", "nodes", total)
    top = F.max(F.when(~F.col("apart"), F.struct("size", "lead"))).over(Window.partitionBy("node"))
    rows = stage(rows.withColumn("top", top["lead"]), "jaccard-tops")
    lo, hi = F.min("top"), F.max("top")
    inside = (F.count("top") == F.count("*")) & (lo == hi) & (lo != F.col("lead"))
    kept = rows.groupBy("lead").agg(F.count("*").alias("nodes"), F.coalesce(inside, F.lit(False)).alias("inside")).filter("not inside")
    own = F.transform("mets", lambda m: F.xxhash64("lead", m))
    return hot_join(rows, stage(kept, "jaccard-outer"), "lead", "nodes", total).select(F.explode(F.when(F.col("apart"), own).otherwise(F.array(F.xxhash64("lead")))).alias("met"), "node")


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for table in chunks(batches, "text"):
            found = Shingles(table["text"], rolling, size)
            sketches = Sketches(found)
            yield batch(["node", "size", "sketch"], table["node"].combine_chunks(), found.size.astype(np.int64), pa.array([sketches.of(i) for i in range(table.num_rows)], pa.binary()))

    return run


def _cell(table: pa.Table) -> pa.Table:
    """Pairs of other roots in one cell, but for those whose sketches differ in more bits than a seventh of both sizes,
    which is the most that linked sets differ in. A cell has a left and a right side of bounded size; with one side alone
    it stands for that side's own pairs."""
    node, root, size, side = (table[c].to_numpy() for c in ("node", "root", "size", "side"))
    bits = folded([np.frombuffer(x.as_buffer(), np.uint64) for x in table["sketch"]])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    found = [np.zeros((0, 2), np.int64)]
    step = max(1, BLOCK // (len(right) * bits.shape[1]) if len(right) else 1)
    for lo in range(0, len(left), step):
        rows = left[lo : lo + step]
        open_ = root[rows][:, None] != root[right][None, :]
        if alone:
            open_ &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(right))[None, :]
        if not open_.any():
            continue
        differ = np.bitwise_count(bits[rows][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype=np.int64)
        x, y = np.nonzero(open_ & (differ <= (size[rows][:, None] + size[right][None, :]) // 7))
        found.append(np.sort(np.stack([node[rows[x]], node[right[y]]], 1), 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in no more bits than a seventh of both sizes."""
    for one in batches:
        differ = np.zeros(one.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(one.column(4), one.column(5), strict=True)):
            two = folded([np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)])
            differ[i] = np.bitwise_count(two[0] ^ two[1]).sum(dtype=np.int64)
        keep = np.flatnonzero(differ <= (one.column(2).to_numpy() + one.column(3).to_numpy()) // 7)
        yield batch(["a", "b"], one.column(0).take(pa.array(keep)), one.column(1).take(pa.array(keep)))


def gathered(rooted: DataFrame, mixed: DataFrame, total: int) -> DataFrame:
    """Members (met, node, root) to pair: rooted has these of all groups, `total` in all, and mixed the groups (met, n, lead)
    that have several roots, with their size and centre.

    Near copies make many groups of nearly the same nodes. Groups with one centre are joined to one of all their nodes
    where that has no more pairs than they have together; where it has more, they stay apart. Either way each pair of a
    group is in some group of the result."""
    rows = hot_join(rooted, mixed.withColumn("_n", F.col("n")), "met", "_n", total)
    distinct = rows.select("lead", "node", "root").distinct()
    groups = mixed.groupBy("lead").agg(F.count("*").alias("groups"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    leads = distinct.groupBy("lead").agg(F.count("*").alias("nodes")).join(groups, "lead")
    leads = stage(leads.select("lead", "nodes", "groups", (F.col("nodes").cast("double") * F.col("nodes") > F.col("pairs")).alias("apart")), "jaccard-leads")
    nodes, n_groups = leads.agg(F.coalesce(F.sum("nodes"), F.lit(0)), F.coalesce(F.sum("groups"), F.lit(0))).first()
    joined = hot_join(distinct, leads.filter("not apart").select("lead", "nodes", "apart"), "lead", "nodes", nodes).select(F.xxhash64("lead").alias("met"), "node", "root")
    apart = stage(hot_join(mixed, leads.filter("apart").select("lead", "groups", "apart"), "lead", "groups", n_groups).select("met", "n", "lead"), "jaccard-apart")
    single = hot_join(rooted, apart, "met", "n", total).select(F.xxhash64("lead", "met").alias("met"), "node", "root")
    return joined.unionByName(single)


def cells(members: DataFrame) -> DataFrame:
    """Cells of pairs, from members (met, node, root, size, sketch) of groups with several roots.

    A group's largest root is its main one; nodes of it never meet each other. The others are dealt to blocks by their
    hash, and so are the main root's nodes; each pair of blocks with others on one side is a cell. So a group of any size
    falls into cells of bounded size, and one with few others costs about a row for each node."""
    of_root = members.groupBy("met", "root").agg(F.count("*").alias("n"), F.max(F.octet_length("sketch")).alias("wide"))
    # the most nodes, of equals the least root
    per = of_root.groupBy("met").agg(F.sum("n").alias("n"), F.max("wide").alias("wide"), F.max(F.struct("n", (-F.col("root")).alias("root"))).alias("main"))
    room = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / F.greatest(F.col("wide"), F.lit(1)))))
    plan = stage(per.select("met", "n", (-F.col("main.root")).alias("main"), F.ceil((F.col("n") - F.col("main.n")) / room).cast("int").alias("few"), F.ceil(F.col("main.n") / room).cast("int").alias("many")), "jaccard-plan")
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = hot_join(members, plan, "met", "n", total, by=["node"])
    other, seat = F.col("root") != F.col("main"), F.xxhash64("node")
    few, many = F.pmod(seat, F.col("few")).cast("int"), F.pmod(seat, F.col("many")).cast("int")
    to = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    blocks = F.sequence(F.lit(0), F.col("few") - 1)
    # among the others: block i on the left of later blocks; against the main root: column -1 - j
    own = F.transform(blocks, lambda j: F.struct(F.least(few, j).alias("x"), F.greatest(few, j).alias("y"), (few > j).cast("int").alias("side")))
    against = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: to(few, -1 - j, 0))
    main = F.transform(blocks, lambda i: to(i, -1 - many, 1))
    dealt = rows.select("met", "node", "root", "size", "sketch", F.explode(F.when(other, F.concat(own, against)).otherwise(main)).alias("to"))
    return dealt.select("met", "to.*", "node", "root", "size", "sketch").groupBy("met", "x", "y").applyInArrow(_cell, "a bigint, b bigint").distinct()


def _linked(size: int):
    """Pairs of which the texts' sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for table in chunks(batches, "_ta"):
            one, two = Shingles(table["_ta"], rolling, size), Shingles(table["_tb"], rolling, size)
            row, hashed = np.concatenate([one.text, two.text]), np.concatenate([one.hash, two.hash])
            order = np.lexsort((hashed, row))
            twice = ~heads(row[order], hashed[order])
            common = np.bincount(row[order][twice], minlength=table.num_rows)
            good = np.flatnonzero(100 * common >= PERCENT * (one.size + two.size - common))
            yield batch(["a", "b"], table["a"].combine_chunks().take(good), table["b"].combine_chunks().take(good))

    return run


class JaccardJoin:
    """The join's tables: `known` (a row for each document), `classes` (documents of equal sets) and `links`."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE):
        release(docs.sparkSession)
        self.size, self.rows = size, keyed(docs)
        # a feature for each six bytes or so, half of them in the parcels
        chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        both = stage(self.rows.mapInArrow(_sets(size, int(max(64, -(-chars // (12 * BUCKET))))), f"{KNOWN}, {PARCELS}"), "jaccard-known")
        self.known = stage(both.filter("bucket is null").select(*[c.split()[0] for c in KNOWN.split(", ")]), "jaccard-rows")
        least = F.min(F.struct("_doc", "_text"))
        grouped = self.known.filter("n > 0").groupBy("n", "half", "s1", "s2").agg(F.count("*").alias("copies"), least.alias("one"), F.max("met").alias("met"))
        self.classes = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "n", "half", "s1", "s2", "copies", "met", "one._doc", "one._text"), "jaccard-classes")
        self.count, self.most = self.classes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
        near = self._survivors(both.filter("bucket is not null"))
        unstage(both)
        release(docs.sparkSession)
        with Staged() as own:
            self.links = own.keep(stage(self._candidates(near), "jaccard-links"))
        unstage(near)
        release(docs.sparkSession)

    def _survivors(self, halves: DataFrame) -> DataFrame:
        """Nodes that may have a partner, with their texts. A partner has three quarters of the set, so of the features
        in half of the domain at most n / 4 are the set's alone; features are counted by 32 bits and a bucket, which
        only lets more nodes pass, and so does counting what was met in a chunk besides."""
        shared = halves.groupBy("bucket").applyInArrow(_shared, "s1 bigint, shared bigint").groupBy("s1").agg(F.sum("shared").alias("shared"))
        near = self.classes.join(shared, "s1", "left").filter("coalesce(shared, 0) + met >= half - n div 4").select("node", "_doc", "_text", "n")
        # rows equal in id and text give the same set; the join has dealt them by both already
        return stage(self.rows.join(near.hint("merge"), ["_doc", "_text"]).dropDuplicates(["_doc", "_text"]).select("node", "n", "text"), "jaccard-survivors")

    def _candidates(self, nodes: DataFrame) -> DataFrame:
        """Verified links: stars of each signature's group around the node that is in most groups (what copies were made
        from is), then all pairs of a group whose nodes aren't connected yet."""
        spark = nodes.sparkSession
        features, count = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        buckets = int(max(64, -(-4 * features // BUCKET)))
        parcels = nodes.select("node", "text").mapInArrow(_signed(self.size, buckets, self.most, max(1, count)), PARCELS)
        with Staged() as own:
            led = parcels.groupBy("bucket").applyInArrow(_led, LED).groupBy("lead", "node")
            led = own.keep(stage(led.agg(F.collect_list("met").alias("mets"), F.sum("pairs").alias("pairs")), "jaccard-led"))
            weights = own.keep(stage(led.groupBy("node").agg(F.sum(F.size("mets")).alias("weight")), "jaccard-weights"))
            met = own.keep(stage(united(led), "jaccard-groups"))
        # shuffle files stay as long as a plan that reads them is held
        del parcels
        release(spark)
        total = met.count()
        weighed = met.join(weights, "node")
        centres = weighed.groupBy("met").agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("n"))
        centres = stage(centres.select("met", "n", F.col("top.node").alias("centre")), "jaccard-centres")
        # and around each signature's least node: what is linked already makes no pairs later
        stars = hot_join(met, centres, "met", "n", total).select("node", "centre").unionByName(led.filter("lead >= 0").select("node", F.col("lead").alias("centre")))
        tried = stage(stars.filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "jaccard-stars")
        unstage(led, weights)
        sketches = stage(nodes.select("node", "text").mapInArrow(_sketched(self.size), "node bigint, size bigint, sketch binary"), "jaccard-sketches")
        with Staged() as own:
            links = own.keep(self._verified(self._alike(tried, sketches), nodes))
        del weighed, stars
        release(spark)
        rooted = met.join(components_of(links), "node", "left").select("met", "node", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("met").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        with Staged() as own:
            mixed = stage(mixed.select("met", "n").join(centres.select("met", F.col("centre").alias("lead")).hint("merge"), "met"), "jaccard-mixed")
            members = own.keep(stage(gathered(rooted, mixed, total), "jaccard-members"))
        unstage(met, centres)
        drawn = stage(members.join(sketches.hint("merge"), "node"), "jaccard-drawn")
        unstage(members, sketches)
        rest = stage(cells(drawn).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
        unstage(drawn, tried)
        release(spark)
        return links.unionByName(self._verified(rest, nodes)).distinct()

    def _alike(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs that their sketches don't rule out."""
        total, out = pairs.count(), pairs
        for c in ("a", "b"):
            out = hot_join(out, sketches.select(F.col("node").alias(c), F.col("size").alias(f"_n{c}"), F.col("sketch").alias(f"_s{c}")), c, "_n", total, by=["a", "b"], counts=pairs.groupBy(c).agg(F.count("*").alias("_n")))
        return stage(out.select("a", "b", "_na", "_nb", "_sa", "_sb").mapInArrow(_near, "a bigint, b bigint"), "jaccard-alike")

    def _verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs of which 100 * intersection >= 75 * union, from their texts. A node may be in any share of them."""
        total, out = pairs.count(), pairs
        for c in ("a", "b"):
            side = nodes.select(F.col("node").alias(c), F.col("text").alias(f"_t{c}"))
            out = hot_join(out, side, c, "_n", total, by=["a", "b"], counts=pairs.groupBy(c).agg(F.count("*").alias("_n")))
        return stage(out.mapInArrow(_linked(self.size), "a bigint, b bigint"), "jaccard-verified")

    def _rooted(self) -> DataFrame:
        return self.classes.join(components_of(self.links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def firsts(self) -> DataFrame:
        """_doc and _text of one document of each component, the least by these."""
        return self._rooted().groupBy("root").agg(F.min(F.struct("_doc", "_text")).alias("one")).select("one.*")

    def result(self) -> DataFrame:
        """_doc, _text, n_shingles, component (the least _doc of the component) of every row."""
        rooted = self._rooted()
        least = rooted.groupBy("root").agg(F.min("_doc").alias("component"), F.count("*").alias("_n"))
        named = stage(hot_join(rooted, stage(least, "jaccard-least"), "root", "_n", self.count).select(F.struct("n", "s1", "s2").alias("set"), "copies", "component"), "jaccard-components")
        rows = self.known.withColumn("set", F.struct("n", "s1", "s2"))
        found = hot_join(rows, named, "set", "copies", self.known.count(), "left")
        return found.select("_doc", "_text", F.col("n").alias("n_shingles"), F.coalesce("component", "_doc").alias("component"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document.

    A document's set holds its distinct `size`-word shingles, A-Z lowered; with fewer words, its whole sequence. Two
    documents link when their sets' Jaccard similarity is 0.75 or more. Null and empty texts, or texts without words,
    have an empty set and link with nothing. A null doc_id counts as larger than all others and is given as null. Rows of
    equal doc_id are rows of their own. Shingles are compared by 64-bit hashes. Other columns are not read.
    """
    out = JaccardJoin(docs, size).result()
    id_of = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(id_of("_doc").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"))


def op4_part_enum(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM d, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON d.doc_id = least.a
"""
