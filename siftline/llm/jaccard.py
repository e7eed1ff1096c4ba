"""N-gram Jaccard join: exact links between documents' shingle sets, found through signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, field, materialize, only_columns, packed, unpacked
from .components import components
from .tokens import U, mix, shingles, text_pieces, word_hashes


@dataclass(frozen=True)
class JaccardJoin:
    """Sets of words_per_shingle-word shingles link at percent of their union. A share order_sample of the documents is
    read to learn which of the first order_tokens of shingle hashes are frequent (a matter of speed only: at most
    order_limit of them stand last in the order of prefixes). A piece of a block, which a task searches at once, has
    about block_rows sets or block_shingles shingles at most. first_blocks: in how many of its blocks a set is searched
    before the rest, which is for sets that are still apart then."""

    words_per_shingle: int = 5
    percent: int = 80
    order_sample: float = 0.2
    order_tokens: float = 0.4
    order_limit: int = 1_000_000
    leaf: int = 16
    fanout: int = 4
    block_rows: int = 2048
    block_shingles: int = 1 << 20
    first_blocks: int = 3


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the text column."""
    for first, raw, offsets in text_pieces(batch.column("text")):
        words, _, _, rows = word_hashes(raw, offsets)
        for i in range(len(offsets) - 1):
            yield first + i, np.unique(shingles(words[rows[i] : rows[i + 1]], k))


LEAST_WIDTH = 256


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, over a power of two of at least 1.25 bits a token: two sets that link differ by a fourth in
    size at most, so their bitmaps by a factor of two, and the wider one folds onto the other."""
    width = max(LEAST_WIDTH, 1 << int(np.ceil(np.log2(1.25 * len(tokens)))))
    b = np.zeros(width, bool)
    b[(mix(tokens, 3) & U(width - 1)).astype(np.int64)] = True
    return np.packbits(b).tobytes()


def _needed(n: np.ndarray, percent: int):
    """Least overlap that a set of n needs with any set that it links with."""
    return (percent * n + 99) // 100


def _signatures(docs: DataFrame, join: JaccardJoin, frequent: np.ndarray) -> DataFrame:
    """(doc_id, th, n, c, row, prefix, bits): set size, 64-bit set id, a row id, the prefix of the set and the bitmap of
    all of it, both empty for sets seen before in this partition. Equal sets have equal c; different ones collide with a chance of pairs / 2^64."""
    k, percent, shared = join.words_per_shingle, join.percent, docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        seen, often, row = set(), shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            ns, cs, prefixes, maps = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for i, s in _sets(batch, k):
                n = len(s)
                ns[i] = n
                c = int(mix(np.array([(int(mix(s, 7).sum(dtype=U)) + n) & (2**64 - 1)], U))[0].astype(np.int64)) if n else 0
                cs[i] = c
                if n and c not in seen:
                    seen.add(c)
                    maps[i] = _bitmap(s)
                    p = n - int(_needed(n, percent)) + 1
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        hot = often[at] == s
                        s = np.concatenate((s[~hot], s[hot]))
                    prefixes[i] = s[:p].astype(np.int64)
            lengths = np.array([0 if p is None else len(p) for p in prefixes], np.int64)
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(ns), pa.array(cs), pa.array(ids), lists, pa.array(maps, pa.binary())], ["doc_id", "th", "n", "c", "row", "prefix", "bits"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, c long, row long, prefix array<long>, bits binary")


def _frequent(docs: DataFrame, join: JaccardJoin) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of a sample. Any set of them gives the same links."""
    k, top = join.words_per_shingle, U(int(join.order_tokens * 2**64))

    def run(batches):
        for batch in batches:
            for _, s in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(s[: np.searchsorted(s, top)].astype(np.int64))], ["s"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1 << 20)) < int(join.order_sample * (1 << 20))).select("text")
    counts = picked.mapInArrow(run, "s long").groupBy("s").count().where("count >= 3")
    rows = counts.orderBy(F.desc("count"), "s").limit(join.order_limit).select("s").toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).astype(U))


def _live(signatures: DataFrame) -> DataFrame:
    """(t, c, n): rows of prefix shingles that more than one set has. One shuffle; blocks are streamed, never held."""
    rows = signatures.where("size(prefix) > 0").select(F.explode("prefix").alias("t"), "n", "c")
    rows = rows.repartition(F.col("t")).sortWithinPartitions("t", "n", "c")

    def run(batches):
        last = None  # the row before, and whether it waits for a second set of its block
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n, c = (batch.column(x).to_numpy() for x in ("t", "n", "c"))
            if last is not None:
                t, n, c = np.concatenate(([last[0]], t)), np.concatenate(([last[1]], n)), np.concatenate(([last[2]], c))
            waits = last[3] if last is not None else True
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, n, c = t[new], n[new], c[new]
            same = np.zeros(len(t), bool)
            same[1:] = t[1:] == t[:-1]
            out = same.copy()
            out[:-1] |= same[1:]
            if last is not None and not waits:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(c[out]), pa.array(n[out])], ["t", "c", "n"])
            last = (t[-1], n[-1], c[-1], not same[-1] if len(t) > 1 or last is None else waits)

    return rows.mapInArrow(run, "t long, c long, n long")


class SignatureTree:
    """Sets of a block, ordered by component and size. Each node has the OR of its bitmaps, its range of sizes and the
    most tokens of a set that share bits (slack). Slack plus common bits bounds the overlap of any pair below two nodes."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, leaf: int, fanout: int, build: bool = True):
        self.levels = [(n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), bits, comp, comp)]
        step = leaf
        while build and len(self.levels[-1][0]) > 1:
            lo, hi, slack, b, c0, c1 = self.levels[-1]
            at = np.arange(0, len(lo), step)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at), np.bitwise_or.reduceat(b, at, 0), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
            step = fanout
        self.steps = [leaf] + [fanout] * max(0, len(self.levels) - 2)

    def _may(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        lo, hi, slack, bits, c0, c1 = self.levels[level]
        ok = ~((c0[x] == c1[x]) & (c0[y] == c1[y]) & (c0[x] == c0[y]))
        ok &= (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])
        x, y, at = x[ok], y[ok], np.flatnonzero(ok)
        keep = np.zeros(len(ok), bool)
        step = max(256, (1 << 22) // bits.shape[1] // 8)
        for i in range(0, len(x), step):  # a bounded stretch of bitmaps at a time
            p, q = x[i : i + step], y[i : i + step]
            most = np.minimum(slack[p], slack[q]) + np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64)
            keep[at[i : i + step]] = (100 + percent) * np.minimum(most, np.minimum(hi[p], hi[q])) >= percent * (lo[p] + lo[q])
        return keep

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of different components that may link: both sides are descended together from the root."""
        x = y = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._may(level, x, y, percent) if level else (x < y) & self._may(0, x, y, percent)
            x, y = x[keep], y[keep]
            if level == 0 or not len(x):
                return x, y
            step, below = self.steps[level - 1], len(self.levels[level - 1][0])
            dx, dy = np.divmod(np.arange(step * step), step)
            nx, ny = (x[:, None] * step + dx).ravel(), (y[:, None] * step + dy).ravel()
            ok = (nx < below) & (ny < below) & (nx <= ny)
            x, y = nx[ok], ny[ok]
        return x, y


def _search(block: np.ndarray, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, join: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs x < y that may link within each run of equal block. Blocks that fit one leaf are searched all at once, a
    larger one through its tree."""
    edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
    sizes = np.diff(edges)
    small = np.repeat(sizes, sizes) <= join.leaf
    flat = SignatureTree(n, bits, comp, join.leaf, join.fanout, build=False)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, join.leaf):
        x = np.flatnonzero(small[d:] & (block[d:] == block[:-d]))
        if not len(x):
            break
        keep = flat._may(0, x, x + d, join.percent)
        xs.append(x[keep])
        ys.append(x[keep] + d)
    for i in np.flatnonzero(sizes > join.leaf):
        at = slice(edges[i], edges[i + 1])
        x, y = SignatureTree(n[at], bits[at], comp[at], join.leaf, join.fanout).pairs(join.percent)
        xs.append(x + edges[i])
        ys.append(y + edges[i])
    return np.concatenate(xs), np.concatenate(ys)


def candidates(block: np.ndarray, n: np.ndarray, maps: list[bytes], comp: np.ndarray, join: JaccardJoin) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, common bits by set size): pairs of rows of one block and of different components that bitmaps can't
    exclude. Sets are searched among those of their own width of bitmaps and of the next one, folded onto it."""
    width = np.array([len(m) for m in maps])
    xs, ys, es = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for w in np.unique(width):
        own = width == w
        rows = np.flatnonzero(own | ((width == 2 * w) & (join.percent * n <= 100 * n[own].max())))
        bits = np.zeros((len(rows), w // 8), np.uint64)
        for k, r in enumerate(rows.tolist()):
            m = np.frombuffer(maps[r], np.uint64)
            bits[k] = m if own[r] else m[: w // 8] | m[w // 8 :]
        x, y = _search(block[rows], n[rows], bits, comp[rows], join)
        some = own[rows[x]] | own[rows[y]]
        x, y = x[some], y[some]
        e = np.zeros(len(x))
        for i in range(0, len(x), 4096):
            p, q = x[i : i + 4096], y[i : i + 4096]
            e[i : i + 4096] = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64) / np.maximum(n[rows[p]], n[rows[q]])
        xs.append(rows[x])
        ys.append(rows[y])
        es.append(e)
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(es)


def forest(x: np.ndarray, y: np.ndarray, likely: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Of the pairs (x, y) linking ones that join all components that they join, each pair one more: at most as many as
    there are components less one. The likeliest pair of each row first; pairs within a component meanwhile are dropped
    unseen."""
    _, local = np.unique(comp, return_inverse=True)
    root = np.arange(local.max() + 1 if len(local) else 0)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    order = np.lexsort((y, x, -likely))
    x, y, out = x[order], y[order], []
    while len(x):
        while (root[root] != root).any():
            root = root[root]
        apart = root[local[x]] != root[local[y]]
        x, y = x[apart], y[apart]
        tried = np.zeros(len(x), bool)
        tried[np.unique(x, return_index=True)[1]] = True
        for a, b in zip(x[tried].tolist(), y[tried].tolist(), strict=True):
            p, q = find(local[a]), find(local[b])
            if p != q:
                s, r = sets[a], sets[b]
                at = np.minimum(np.searchsorted(s, r), len(s) - 1)
                if (100 + percent) * int((s[at] == r).sum()) >= percent * (len(s) + len(r)):
                    root[max(p, q)] = min(p, q)
                    out.append((a, b))
        x, y = x[~tried], y[~tried]
    return out


def _map_table(signatures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bc, bits) of the sets in wanted(c)."""
    one = signatures.where("bits is not null").groupBy("c").agg(F.min("row").alias("row")).join(wanted, "c", "left_semi").select("row")
    return signatures.where("bits is not null").join(bounded(one), "row").select(F.col("c").alias("bc"), "bits")


def _n_pieces(join: JaccardJoin) -> Column:
    return F.ceil(F.greatest(F.count("*") / join.block_rows, F.sum("n") / join.block_shingles)).cast("int")


def _piece_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Each row of piece k of q with each piece of its key."""
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    return rows.select(key, F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), "k", "n", "c", "comp")


def _pieces(live: DataFrame, labels: DataFrame | None, join: JaccardJoin, first: bool) -> DataFrame:
    """(t, i, j, k, n, c, comp): rows of blocks that hold several components, one block for each family of sets. A large
    block is cut into pieces k by hash, which are searched piece against piece, i <= j.

    first: each set's first blocks only, and each piece only by itself. Pieces are cut anew in each block, so that a
    group of copies, however large, meets through its sets' other blocks, without a row for each pair of pieces.
    """
    rows = live.select("t", "c", "n")
    if labels is not None:
        rows = rows.join(labels, rows["c"] == labels["v"], "left").select("t", "c", "n", F.coalesce("component", "c").alias("comp"))
    else:
        rows = rows.withColumn("comp", F.col("c"))
    about = rows.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), _n_pieces(join).alias("q"), F.sum(F.shiftright(F.xxhash64("c"), 32)).alias("x1"), F.bit_xor(F.xxhash64("c")).alias("x2"))
    blocks = about.where("lo < hi").groupBy("m", "x1", "x2").agg(F.min("t").alias("bt"), F.min("q").alias("q"))
    rows = rows.join(blocks, rows["t"] == blocks["bt"])
    rows = rows.withColumn("k", F.pmod(F.xxhash64("c", "t"), F.col("q")).cast("int"))
    if first:
        rank = F.row_number().over(Window.partitionBy("c").orderBy("t"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= join.first_blocks)
        return rows.select("t", F.col("k").alias("i"), F.col("k").alias("j"), "k", "n", "c", "comp")
    return _piece_pairs(rows, "t")


def _by_piece(rows: DataFrame, keys: list[str], found, schema: str) -> DataFrame:
    """found(table, piece of each row) over whole pieces (rows of equal keys), several at a time, sorted by component, size and set."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "comp", "n", "c")

    def run(batches):
        held = None
        for batch in _with_end(batches):
            table = batch if held is None else (held if batch is None else pa.concat_tables([held, batch]))
            if table is None or not table.num_rows:
                continue
            new = np.any([k[1:] != k[:-1] for k in _numbers(table, *keys)], axis=0)
            block, held = np.concatenate(([0], np.cumsum(new))), None
            if batch is not None:  # the last piece may go on in the next batch
                at = int(np.searchsorted(block, block[-1]))
                held, table, block = table.slice(at), table.slice(0, at), block[:at]
            if table.num_rows:
                yield from found(table, block)

    return rows.mapInArrow(run, schema)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(x).to_numpy() for x in names]


def clusters(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of n rows each one's least row reachable by the pairs (x, y)."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


def _members(rows: DataFrame, maps: DataFrame, join: JaccardJoin) -> DataFrame:
    """(g, h, n, c, comp): the sets of a block that are joined by pairs that bitmaps can't exclude, as a group g with a head
    h. No more rows than sets in blocks, whatever the pairs; a group that several blocks have counts once."""

    def found(table, block):
        n, comp, i, j, k, c = _numbers(table, "n", "comp", "i", "j", "k", "c")
        x, y, _ = candidates(block, n, table.column("bits").to_pylist(), comp, join)
        ok = (i[x] == j[x]) | (k[x] != k[y])
        label = clusters(x[ok], y[ok], len(n))
        at = np.unique(np.concatenate((x[ok], y[ok])))
        sums = np.zeros(len(n), U)
        np.add.at(sums, label[at], mix(c[at].astype(U), 5))
        yield pa.RecordBatch.from_arrays([pa.array(mix(sums[label[at]], 6).astype(np.int64)), pa.array(c[label[at]]), pa.array(n[at]), pa.array(c[at]), pa.array(comp[at])], ["g", "h", "n", "c", "comp"])

    rows = rows.join(maps, rows["c"] == maps["bc"]).drop("bc")
    return _by_piece(rows, ["t", "i", "j"], found, "g long, h long, n long, c long, comp long").distinct()


def _grouped(members: DataFrame, join: JaccardJoin) -> DataFrame:
    """(g, i, j, k, n, c, comp): groups that share a set become one, so each set is brought to one group only, and with
    each piece of a large group to all its pieces."""
    joined = components(members.select(F.col("h").alias("a"), F.col("c").alias("b")))
    rows = members.select("n", "c", "comp").distinct()
    rows = materialize(rows.join(joined, rows["c"] == joined["v"]).select(F.col("component").alias("g"), "n", "c", "comp"))
    sizes = rows.groupBy(F.col("g").alias("s_g")).agg(_n_pieces(join).alias("q"))
    rows = rows.join(sizes, rows["g"] == sizes["s_g"]).withColumn("k", F.pmod(F.xxhash64("c"), F.col("q")).cast("int"))
    return _piece_pairs(rows, "g")


def _links(members: DataFrame, sets: DataFrame, join: JaccardJoin) -> DataFrame:
    """(a, b): linked sets, of each group those that join its components, by the sets themselves."""

    def found(table, block):
        n, comp, i, j, k, c = _numbers(table, "n", "comp", "i", "j", "k", "c")
        lists = table.column("s").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        s = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        x, y, likely = candidates(block, n, [_bitmap(r.astype(U)) for r in s], comp, join)
        ok = (i[x] == j[x]) | (k[x] != k[y])
        x, y, likely = x[ok], y[ok], likely[ok]
        order = np.argsort(block[x], kind="stable")
        x, y, likely = x[order], y[order], likely[order]
        out: list[tuple[int, int]] = []
        edges = [*np.flatnonzero(np.diff(block[x], prepend=-1)).tolist(), len(x)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            first = int(np.searchsorted(block, block[x[lo]]))
            last = int(np.searchsorted(block, block[x[lo]], "right"))
            out += [(a + first, b + first) for a, b in forest(x[lo:hi] - first, y[lo:hi] - first, likely[lo:hi], comp[first:last], s[first:last], join.percent)]
        a, b = (c[np.array([p[z] for p in out], np.int64)] for z in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = members.join(sets, members["c"] == sets["sc"]).drop("sc")
    return _by_piece(rows, ["g", "i", "j"], found, "a long, b long").distinct()


STEP = 2048


def _with_end(batches) -> Iterator[pa.Table | None]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):  # what is worked on at once is copied
            yield pa.Table.from_batches([batch.slice(at, STEP)])
    yield None


def _set_table(docs: DataFrame, signatures: DataFrame, wanted: DataFrame, join: JaccardJoin) -> DataFrame:
    """(sc, s): the sets in wanted(c), sorted, made again from the text of one document each."""
    k = join.words_per_shingle

    def run(batches):
        seen = set()  # repeated rows of this partition
        for batch in batches:
            ids, new = batch.column("c").to_pylist(), []
            for i, c in enumerate(ids):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            part = batch.take(pa.array(new, pa.int32()))
            lists = pa.array([np.sort(s.astype(np.int64)) for _, s in _sets(part, k)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("c"), lists], ["sc", "s"])

    one = signatures.where("n > 0").join(wanted, "c", "left_semi").groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    h = bounded(one.select("c", F.col("x.doc_id").alias("h_id"), F.col("x.th").alias("h_th")))
    texts = docs.join(h, docs["doc_id"].eqNullSafe(h["h_id"]) & (docs["th"] == h["h_th"])).select("c", "text")
    return texts.mapInArrow(run, "sc long, s array<long>")


def _labelled(docs: DataFrame, join: JaccardJoin) -> DataFrame:
    """(doc_id, th, n, comp, least_id, least_th): comp is null for empty sets; least: the first row of the component."""
    d = only_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    signed = materialize(_signatures(d, join, _frequent(d, join)))
    live = materialize(_live(signed))
    links = labels = None
    for first in (True, False):
        rows = materialize(_pieces(live, labels, join, first))
        members = materialize(_members(rows, _map_table(signed, rows.select("c").distinct()), join))
        if members.isEmpty():
            continue
        sets = _set_table(d, signed, members.select("c").distinct(), join)
        at = [F.lit(0).alias(x) for x in "ijk"]
        more = materialize(_links(members.select("g", *at, "n", "c", "comp") if first else _grouped(members, join), sets, join))
        if not more.isEmpty():
            links = more if links is None else links.union(more)
            labels = components(links)
    each = signed.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least"))
    if labels is not None:
        each = each.join(labels, each["c"] == labels["v"], "left").select("c", F.coalesce("component", "c").alias("comp"), "least")
    else:
        each = each.select("c", F.col("c").alias("comp"), "least")
    low = each.groupBy("comp").agg(F.min("least").alias("low"))
    each = each.select("c", "comp").join(low, "comp").select(F.col("c").alias("k"), "comp", F.col("low.doc_id").alias("least_id"), F.col("low.th").alias("least_th"))
    out = signed.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("c")).alias("c"))
    return out.join(each, out["c"] == each["k"], "left").drop("c", "k")


def linked_components(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents(doc_id, text).

    1. Equal sets collapse into one (c). 2. Two sets that link share a shingle of their prefixes, whatever the order of
    shingles; frequent ones stand last, so unrelated documents with a common passage rarely meet. 3. Each prefix
    shingle's block is searched by signature trees; sets with any pair that bounds can't exclude are brought to their
    group, and pairs are compared by the sets until the group's components are known: a group gives fewer links than it
    has sets. First a few blocks of each set, then all that still hold several components. Links are exact.

    Null, empty or blank texts have the empty set: n_shingles 0, linked with nothing, their own id. A null doc_id counts
    as above all ids: it is the component's only if no other is. Repeated rows each return a row; an empty table none;
    other columns are ignored, whatever their names.
    """
    return _labelled(docs, join).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the least doc_id (null last, then by a hash of
    the text), with all its columns; of equal rows of id and text one. Documents without words stay, each row of them.
    Columns of any names pass through; an empty table stays empty."""
    found = materialize(_labelled(docs, join))
    first = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("th") == F.col("least_th"))
    worded = found.where("n > 0").groupBy("doc_id", "th").agg(F.min(first).alias("stays"), F.count("*").alias("times"))
    marked = bounded(worded.where("not stays or times > 1").select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "stays"))
    d = packed(docs).select("row", field(docs, "doc_id").cast("long").alias("doc_id"), F.xxhash64(field(docs, "text")).alias("th"))
    d = d.join(marked, d["doc_id"].eqNullSafe(marked["g_id"]) & (d["th"] == marked["g_th"]), "left")
    once = d.where("stays is null").select("row")
    again = d.where("stays").dropDuplicates(["doc_id", "th"]).select("row")
    return unpacked(once.unionByName(again), docs)
