"""Near duplicates by SimHash, found with navigable small-world graphs over Hamming distance.

A text's signature has ``BITS`` bits: each is the majority vote of one bit of the hashes of its different words. Texts of one
signature are one node. Nodes are cut into shards of about ``SHARD_NODES`` by some bits of the signature, several times
over: in each band by other bits, and a node is a query in the one shard of every band that agrees with it there. Sending
every query to every shard would cost the square of the corpus. The number of bits follows from the number of nodes, and that of
bands from the bits, so that two signatures within ``MAX_DISTANCE`` share a shard with a probability of ``SHARE`` at least.

Within a shard of up to ``COMPLETE_NODES`` nodes all pairs are compared, half of their words first and the others where
those differ in no more than ``MAX_DISTANCE`` bits: that misses none, and at 10,800 nodes, where both were measured, it costs a thirteenth of a graph. The nodes of a
larger shard, as skewed bits may make, are put into small-world graphs, in blocks of ``GRAPH_NODES`` that each serve all queries of
the shard. The beam of a query expands until its worst member is farther than ``MAX_DISTANCE``, so that partners aren't
capped; a query with so many partners that its beam would pass ``WIDE_BEAM`` is compared with the whole block, which is
then cheaper and misses none. Each edge is verified by its exact distance, and a shard sends on a spanning forest of its
edges. The forests are united by label propagation. :func:`audit` measures recall against exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import TOKEN, LowerHashCache, cut, fresh, mix, rank_of, row_key, table, text_slices, tidy

#: Bits of a signature, in words of 64.
BITS = 256
WORDS = BITS // 64
#: Differing bits of two near duplicates at most.
MAX_DISTANCE = 48
#: Nodes of a shard, about; bands cut into shards at least.
SHARD_NODES, BANDS = 16_384, 6
#: Probability at least that two nodes at MAX_DISTANCE share a shard.
SHARE = 0.95
#: A shard of so many nodes is compared pair by pair; of so many, together with others of its size.
COMPLETE_NODES, TINY_NODES = 200_000, 64
#: Nodes of one graph at most.
GRAPH_NODES = 200_000
#: Rows of a task that searches shards.
TASK_ROWS = 65_536
#: Links that a node makes, the least beam of a search, and the widest one.
LINKS, BEAM, WIDE_BEAM = 12, 24, 96
#: Cells of the arrays that walks and comparisons make at once, so that memory doesn't follow the size of a shard; those of a tile stay in a core's cache.
WALK_CELLS, PAIR_CELLS, TILE_CELLS = 250_000, 1_000_000, 131_072
SALTS = [np.uint64(i * 0x9E3779B97F4A7C15 % 2**64) for i in range(1, WORDS + 1)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The words of the majority of the bits of different word hashes; a tie is 0."""
    words = np.stack([mix(hashes ^ s) for s in SALTS], 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(words), 255):
        votes += np.unpackbits(words[at : at + 255].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(words), bitorder="little").view(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of signatures along the last axis, the others broadcast."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


class SmallWorld:
    """A navigable small-world graph; nodes are linked to the nearest that a search finds among those before them."""

    def __init__(self, codes: np.ndarray, links: int = LINKS, beam: int = BEAM):
        self.codes, self.n, self.width = codes, len(codes), 3 * links
        self.near = np.full((self.n, self.width), -1, np.int32)
        self.degree = np.zeros(self.n, np.int32)
        self.entries = np.zeros(1, np.int64)
        done = min(self.n, 4 * links)
        self._link(np.arange(done), *self._nearest(np.arange(done), np.arange(done), links))
        while done < self.n:
            self.entries = np.unique(np.linspace(0, done - 1, min(done, 8)).astype(np.int64))
            batch = np.arange(done, min(self.n, 2 * done))
            found, far = self.search(codes[batch], beam, done)
            # those of a batch don't see one another in the search: near ones are sought next to where they would stand
            order = batch[np.argsort(found[:, 0], kind="stable")]
            self._link(batch, found[:, :links], far[:, :links])
            for shift in (1, 2, 3):
                a, b = order[:-shift], order[shift:]
                if len(a):
                    self._link(a, b[:, None], distance(codes[a], codes[b])[:, None])
            done = int(batch[-1]) + 1
        self.entries = np.unique(np.linspace(0, self.n - 1, min(self.n, 8)).astype(np.int64))

    def _nearest(self, rows: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        d = distance(self.codes[rows][:, None], self.codes[among][None])
        d[rows[:, None] == among[None]] = BITS + 1
        pick = np.argsort(d, 1, kind="stable")[:, : min(k, max(0, len(among) - 1))]
        return among[pick], np.take_along_axis(d, pick, 1)

    def _link(self, rows: np.ndarray, to: np.ndarray, far: np.ndarray) -> None:
        """Links both ways; a node whose places are full keeps the older ones, which are the long links, and its nearest."""
        ok = (to >= 0) & (far <= BITS)
        a, b = np.broadcast_to(rows[:, None], to.shape)[ok], to[ok]
        a, b = np.r_[a, b], np.r_[b, a]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        slot = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) + self.degree[a]
        fits = slot < self.width
        self.near[a[fits], slot[fits]] = b[fits]
        # beyond the room: the last places, by turns, so that new near ones are reachable
        over = ~fits
        self.near[a[over], self.width // 2 + slot[over] % (self.width - self.width // 2)] = b[over]
        np.maximum.at(self.degree, a, np.minimum(slot + 1, self.width).astype(np.int32))

    def search(self, queries: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes (-1: none) below ``limit`` that a best-first walk finds, nearest first; distances."""
        step = max(1, WALK_CELLS // (beam + self.width))
        parts = [self._walk(queries[at : at + step], beam, self.n if limit is None else limit) for at in range(0, max(1, len(queries)), step)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _walk(self, queries: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        q, far = len(queries), BITS + 1
        ids, d = np.full((q, beam), -1, np.int32), np.full((q, beam), far, np.int16)
        seen = np.ones((q, beam), bool)
        start = self.entries[self.entries < limit][:beam]
        ids[:, : len(start)], d[:, : len(start)] = start, distance(queries[:, None], self.codes[start][None])
        seen[:, : len(start)] = False
        order = np.argsort(d, 1, kind="stable")
        ids, d, seen = (np.take_along_axis(x, order, 1) for x in (ids, d, seen))
        active = np.arange(q)
        while len(active):
            open_ = ~seen[active]
            active, open_ = active[open_.any(1)], open_[open_.any(1)]
            if not len(active):
                break
            pick = open_.argmax(1)
            seen[active, pick] = True
            cand = self.near[ids[active, pick]]
            there = (cand >= 0) & (cand < limit)
            # known ones and repeats drop out
            mine = ids[active]
            for k in range(beam):
                there &= cand != mine[:, k : k + 1]
            order = np.argsort(cand, 1, kind="stable")
            by = np.take_along_axis(cand, order, 1)
            again = np.zeros(cand.shape, bool)
            np.put_along_axis(again, order[:, 1:], by[:, 1:] == by[:, :-1], 1)
            there &= ~again
            cd = np.where(there, distance(queries[active][:, None], self.codes[np.maximum(cand, 0)]), far)
            all_d = np.concatenate([d[active], cd], 1)
            all_i = np.concatenate([mine, np.where(there, cand, -1)], 1)
            all_s = np.concatenate([seen[active], ~there], 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :beam]
            d[active], ids[active], seen[active] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_s))
        return ids, d

    def within(self, queries: np.ndarray, most: int, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within ``most``; a beam that is full of such nodes is doubled, and one too wide is all nodes."""
        todo = np.arange(len(queries))
        while len(todo):
            if beam > WIDE_BEAM:
                for at in range(0, len(todo), step := max(1, PAIR_CELLS // self.n)):
                    i, j = np.nonzero(distance(queries[todo[at : at + step], None], self.codes[None]) <= most)
                    yield todo[at + i], j
                return
            full = []
            step = 65_536
            for at in range(0, len(todo), step):
                rows = todo[at : at + step]
                ids, d = self.search(queries[rows], beam)
                more = (d[:, -1] <= most) & (beam < self.n)
                full.append(rows[more])
                i, j = np.nonzero((d <= most) & (ids >= 0) & ~more[:, None])
                yield rows[i], ids[i, j]
            todo, beam = np.concatenate(full), min(2 * beam, self.n)


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def close_pairs(codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``most``, the lesser number first, each once: only those within it by half of the words are compared whole."""
    n, words = len(codes), np.ascontiguousarray(codes.T)
    half, room = len(words) // 2, max(n, TILE_CELLS)
    differ, bits = np.empty(room, np.uint64), np.empty((2, room), np.uint8)
    at = 0
    while at < n:
        shape = min(n - at, max(1, TILE_CELLS // (n - at))), n - at
        size = shape[0] * shape[1]
        x, far, more = (a[:size].reshape(shape) for a in (differ, *bits))
        for k in range(half):
            np.bitwise_xor(words[k, at : at + shape[0], None], words[k, None, at:], out=x)
            np.bitwise_count(x, out=more if k else far)
            if k:
                np.add(far, more, out=far)
        cell = np.flatnonzero(bits[0, :size] <= most)
        i = cell // shape[1]
        j = cell - i * shape[1]
        sum_ = bits[0, cell].astype(np.int16)
        for k in range(half, len(words)):
            sum_ += np.bitwise_count(words[k, i + at] ^ words[k, j + at])
            near = (sum_ <= most) & (j > i)
            i, j, sum_ = i[near], j[near], sum_[near]
        if len(i):
            yield i + at, j + at
        at += shape[0]


def shard_pairs(codes: np.ndarray, most: int, complete_nodes: int = COMPLETE_NODES, graph_nodes: int = GRAPH_NODES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a shard's nodes within ``most``."""
    n = len(codes)
    if n <= complete_nodes:
        yield from close_pairs(codes, most)
        return
    for at in range(0, n, graph_nodes):
        graph = SmallWorld(codes[at : at + graph_nodes])
        for i, j in graph.within(codes[at:], most):
            yield i + at, j + at


def band_bits(n: int, shard_nodes: int = SHARD_NODES, max_distance: int = MAX_DISTANCE) -> np.ndarray:
    """The bits that name a shard in each band, a row for each; none if all ``n`` nodes are one shard."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / shard_nodes))))
    if not bits:
        return np.zeros((1, 0), np.int64)
    agree = np.prod([(BITS - max_distance - i) / (BITS - i) for i in range(bits)])
    bands = max(BANDS, int(np.ceil(np.log(1 - SHARE) / np.log(1 - agree))))
    each, rng, rows = BITS // bits, np.random.default_rng(BITS), []
    while len(rows) < bands:
        rows += list(rng.permutation(BITS)[: each * bits].reshape(each, bits))
    return np.array(rows[:bands])


def shards_of(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The shard of each node in each band, all numbers unlike between bands."""
    out = np.zeros((len(codes), len(bits)), np.int64)
    for band, chosen in enumerate(bits):
        for bit in chosen.tolist():
            out[:, band] = out[:, band] << 1 | (codes[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64)
    return out + (np.arange(len(bits)) << bits.shape[1])


def _shard_edges(max_distance: int, complete_nodes: int, graph_nodes: int):
    """(a, b) of the spanning forest of each shard; rows come ordered by shard."""

    def forest(ids: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin = np.cumsum(sizes) - sizes
        small = sizes <= min(complete_nodes, TINY_NODES)
        # tiny shards of one size together
        for size in np.unique(sizes[small]):
            rows = begin[small & (sizes == size)]
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(rows), step := max(1, PAIR_CELLS // max(1, len(i)))):
                a, b = rows[at : at + step, None] + i[None], rows[at : at + step, None] + j[None]
                hit = distance(codes[a], codes[b]) <= max_distance
                yield a[hit], b[hit]
        for start, size in zip(begin[~small], sizes[~small]):
            for a, b in shard_pairs(codes[start : start + size], max_distance, complete_nodes, graph_nodes):
                yield a + start, b + start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def give(parts: list[list[np.ndarray]], last: bool) -> tuple[pa.RecordBatch | None, list[list[np.ndarray]]]:
            shard, node, *words = (np.concatenate(x) for x in zip(*parts))
            end = len(shard) if last else int(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[-1])
            rest = [[x[end:] for x in (shard, node, *words)]]
            if not end:
                return None, rest
            shard, node = shard[:end], node[:end]
            codes = np.stack([w[:end] for w in words], 1).view(np.uint64)
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            root = _roots(end, forest(node, codes, np.diff(np.r_[first, end])))
            child = np.flatnonzero(root != np.arange(end))
            return pa.RecordBatch.from_arrays([pa.array(node[root[child]]), pa.array(node[child])], names=["a", "b"]), rest

        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            rows += batch.num_rows
            if rows >= 200_000:
                out, held = give(held, False)
                # a shard larger than this is waited for, and tried again when as much has come again
                rows = 0
                if out is not None and out.num_rows:
                    yield out
        if held:
            out, _ = give(held, True)
            if out is not None and out.num_rows:
                yield out

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hash_of = LowerHashCache()
    for batch in batches:
        for start, part in text_slices(batch, 2):
            rows, codes = [], []
            for i, text in enumerate(part):
                words = set(TOKEN.findall(text)) if text else ()
                if words:
                    rows.append(start + i)
                    codes.append(signature(np.unique(np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words)))))
            if rows:
                at, words = pa.array(rows), np.stack(codes).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(words[:, k]) for k in range(WORDS))], names=["id", "key", *_WORDS])


_WORDS = [f"w{k}" for k in range(WORDS)]


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, w0..) of each row whose text has a word."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, key binary, " + ", ".join(f"{w} long" for w in _WORDS)
    return source.mapInArrow(tidy(_signatures), schema)


def candidate_edges(nodes: DataFrame, *, max_distance: int = MAX_DISTANCE, shard_nodes: int = SHARD_NODES, complete_nodes: int = COMPLETE_NODES, graph_nodes: int = GRAPH_NODES) -> DataFrame:
    """(a, b) pairs of the ``nodes`` (node, w0..) within ``max_distance``, a spanning forest of each shard's."""
    n = nodes.count()
    bits = band_bits(n, shard_nodes, max_distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(k).to_numpy() for k in range(1, WORDS + 1)]
            shards = shards_of(np.stack(words, 1).view(np.uint64), bits)
            each = pa.array(np.repeat(np.arange(batch.num_rows), len(bits)))
            yield pa.RecordBatch.from_arrays([pa.array(shards.ravel()), *(c.take(each) for c in batch.columns)], names=["shard", "node", *_WORDS])

    rows = nodes.select("node", *_WORDS).mapInArrow(tidy(spread), "shard long, node long, " + ", ".join(f"{w} long" for w in _WORDS))
    tasks = max(1, min(len(bits) << bits.shape[1], -(-n * len(bits) // TASK_ROWS)))
    placed = rows.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard")
    return placed.mapInArrow(tidy(_shard_edges(max_distance, complete_nodes, graph_nodes)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes with an edge; the label is the least node of the component.

    Rounds of the least label among neighbours, followed by a jump to the label's own label; each is written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        after = cut(step.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next")))
        changed = after.where(F.col("label") != F.col("next")).limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, DataFrame]:
    """(key, id, group) of the rows with a signature; of each group that has several keys, its first (group, at)."""
    rows = cut(signatures(docs, id_col=id_col, text_col=text_col))
    # numbers of the signatures, fixed by being written: a hash would merge unlike ones now and then
    nodes = cut(rows.select(*_WORDS).distinct().withColumn("node", F.monotonically_increasing_id()))
    labels = components(candidate_edges(nodes, **options))
    grouped = rows.join(nodes, _WORDS).select("id", "key", "node").join(labels, "node", "left").select("id", "key", F.coalesce("label", "node").alias("group"))
    grouped = cut(grouped)
    place = F.struct(rank_of("id")["no_id"].alias("no_id"), F.col("id").alias("id"), F.col("key").alias("key"))
    firsts = grouped.groupBy("group").agg(F.count("*").alias("n_docs"), F.min(place).alias("at")).where("n_docs > 1")
    return grouped, firsts


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that have near duplicates: (doc_id, group_id, n_docs, kept).

    Two texts are near duplicates if their signatures differ in at most ``max_distance`` bits; groups are closed under
    this. ``group_id`` is the least id of the group (a null id comes last), ``n_docs`` the number of its rows, and
    ``kept`` marks the one that stays. Texts that are null or without a word belong to no group. Repeated rows are
    members each; of rows equal in id and text all have the same ``kept``. Other columns aren't read. ``options`` are
    those of :func:`candidate_edges`.
    """
    grouped, firsts = _grouped(docs, id_col, text_col, options)
    return grouped.join(firsts, "group").select(F.col("id").alias("doc_id"), F.col("at.id").alias("group_id"), "n_docs", ((F.col("key") == F.col("at.key")) & F.col("id").eqNullSafe(F.col("at.id"))).alias("kept"))


def remove_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`; all columns and all other rows stay.

    Of rows that are equal in id and text one stays, whichever comes first. Texts that are null or without a word stay.
    """
    (key,) = fresh(docs, "dup_key")
    grouped, firsts = _grouped(docs, id_col, text_col, options)
    flagged = cut(grouped.join(firsts, "group").groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("key") != F.col("at.key")).alias("gone")))
    gone = flagged.where("gone").select(F.col("key").alias(key))
    rest = docs.withColumn(key, row_key(id_col, text_col)).join(gone.hint("shuffle_hash"), key, "left_anti")
    if flagged.where("n > 1 and not gone").limit(1).count():
        twice = flagged.where("n > 1 and not gone").select(F.col("key").alias(key))
        rest = rest.join(twice.hint("shuffle_hash"), key, "left_anti").unionByName(rest.join(twice.hint("shuffle_hash"), key, "left_semi").dropDuplicates([key]))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_pairs(codes: np.ndarray, max_distance: int = MAX_DISTANCE) -> set[tuple[int, int]]:
    """All pairs of signatures within ``max_distance``, by comparing all with all."""
    return {(int(a), int(b)) for i, j in shard_pairs(codes, max_distance, len(codes)) for a, b in zip(i, j)}


def audit(codes: np.ndarray, max_distance: int = MAX_DISTANCE, shard_nodes: int = SHARD_NODES, complete_nodes: int = COMPLETE_NODES) -> float:
    """Of the pairs that exact search finds among the signatures, the share that the graphs of the shards find."""
    every, found = exact_pairs(codes, max_distance), set()
    for shards in shards_of(codes, band_bits(len(codes), shard_nodes, max_distance)).T:
        order = np.argsort(shards, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
            for i, j in shard_pairs(codes[rows], max_distance, complete_nodes):
                found |= {(min(int(a), int(b)), max(int(a), int(b))) for a, b in zip(rows[i], rows[j]) if a != b}
    return len(found & every) / len(every) if every else 1.0


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near duplicates among all ``documents``; texts that are null or without a word belong to none."""
    return near_duplicates(table(spark, sf_dir, "documents"))
