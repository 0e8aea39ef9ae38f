"""Embedding near-duplicates: a navigable small-world graph per shard, queried by every vector.

Equal vectors are one node. Nodes are dealt to shards by hash; a task builds a shard's hierarchical
graph and writes it to the shared folder. Each pair of shards (and each shard with itself) is one turn of a
task that reads both files: no vector is shuffled again. Every vector of either queries the other's graph: a
search follows a beam to the nearest nodes and from there opens every node that is near enough. A pair that
either end finds counts at both. Before a shard's vectors query a graph, a fixed number of them is compared
with all of its nodes and must find its own links, and as many queries placed at a known node, at cosines
between the threshold and 1, must find it, so that a search is measured where links are rare too; beams
double until both hold, and a beam as wide as the shard is a comparison with all of it. Cosines are verified
in double precision. What a turn has found is a bit per pair while it runs; what leaves it is a count for each
node and a forest: no table holds a row per pair.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links
with nothing; vectors link only with vectors of their length; null and repeated ids are rows of
their own (a component's id is the smallest id that isn't null); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import io
import uuid

import numpy as np
from pyarrow import fs
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.graph import components
from strataforge.llm.store import RID, fresh_dir, identified, is_scan, materialize, with_group
from strataforge.llm.textcore import mix, ragged

#: Neighbours of a node at level 0 (half above), beam while building, first beam while searching.
DEGREE, BUILD_BEAM, BEAM = 32, 48, 32
#: Bytes of a shard (eight for a component and ``NODE_BYTES`` more for a node) and its nodes at most, shards that a small
#: table of ``SMALL`` nodes a shard is dealt to, and search tasks at most (then a task has several turns).
SHARD_BYTES, NODE_BYTES, SHARD_NODES, SPREAD, SMALL, TASKS = 16 << 20, 512, 1 << 14, 3, 1 << 11, 100_000
#: Queries that an audit compares with the whole shard, queries that it places itself; recall of each audited query, and of the placed ones.
AUDITED, PLACED, RECALL = 64, 128, 0.99
#: Nodes this much below the threshold are opened too: groups hang together by them.
_AROUND = 0.02
_BATCH, _EXPAND, _SLACK, _VERIFIED, _ROWS = 256, 4, 1e-5, 1 << 16, 128


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors; batches move in lock step."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray) -> None:
        self.unit = unit_vectors(vectors)
        uniform = ((mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) + 1) / 2**53
        level = np.floor(-np.log(uniform) / np.log(DEGREE / 2)).astype(int)
        top = int(level.max(initial=0))
        while top and (level >= top).sum() < 2:
            top -= 1
        order = np.argsort(-np.minimum(level, top), kind="stable")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # of each level, top first: nodes by insertion, neighbours
        for height in range(top, -1, -1):
            members = order[level[order] >= height] if height else order
            self.levels.append((members, np.zeros((0, 0), np.int32)))
            self._build(DEGREE if height == 0 else DEGREE // 2)

    def _similar(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.matmul(self.unit[nodes], queries[:, :, None])[:, :, 0]

    def _enter(self, queries: np.ndarray, levels: int) -> np.ndarray:
        """Greedy descent through the first ``levels`` levels: a node of the next level down for each query."""
        at = np.full(len(queries), self.levels[0][0][0])
        for members, near in self.levels[:levels]:
            row = np.full(len(self.unit), -1)
            row[members] = np.arange(len(members))
            best = (self.unit[at] * queries).sum(axis=1)
            moving = np.arange(len(queries))
            while len(moving):
                options = near[row[at[moving]]]
                sims = np.where(options >= 0, self._similar(queries[moving], np.maximum(options, 0)), -9)
                pick = sims.argmax(axis=1)
                better = sims[np.arange(len(moving)), pick] > best[moving] + 1e-7
                moving, pick, sims, options = moving[better], pick[better], sims[better], options[better]
                at[moving] = options[np.arange(len(moving)), pick]
                best[moving] = sims[np.arange(len(moving)), pick]
        return at

    def _beam(self, queries: np.ndarray, start: np.ndarray, near: np.ndarray, row: np.ndarray | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query (-1: none) and their similarities, best first."""
        n, b = len(self.unit), len(queries)
        seen = np.zeros((b, n), bool)
        nodes, sims, fresh = np.full((b, beam), -1), np.full((b, beam), -9.0, np.float32), np.zeros((b, beam), bool)
        nodes[:, 0], sims[:, 0], fresh[:, 0] = start, (self.unit[start] * queries).sum(axis=1), True
        seen[np.arange(b), start] = True
        live = np.arange(b)
        while len(live):
            rank = np.where(fresh[live], sims[live], -9)
            take = min(_EXPAND, beam)
            pick = np.argpartition(-rank, take - 1, axis=1)[:, :take]
            open_ = np.take_along_axis(rank, pick, 1) > -9
            some = open_.any(axis=1)
            live, pick, open_ = live[some], pick[some], open_[some]
            if not len(live):
                break
            fresh[live[:, None], pick] = False
            chosen = np.where(open_, nodes[live[:, None], pick], -1)
            around = near[np.maximum(chosen if row is None else row[np.maximum(chosen, 0)], 0)]
            around = np.where(chosen[:, :, None] >= 0, around, -1).reshape(len(live), -1)
            around = np.sort(around, axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            valid = (around >= 0) & ~seen[live[:, None], np.maximum(around, 0)]
            width = int(valid.sum(axis=1).max(initial=0))
            if not width:
                continue
            keep = np.argsort(~valid, axis=1, kind="stable")[:, :width]
            around, valid = np.take_along_axis(around, keep, 1), np.take_along_axis(valid, keep, 1)
            a, k = np.nonzero(valid)
            seen[live[a], around[a, k]] = True
            found = np.where(valid, self._similar(queries[live], np.maximum(around, 0)), -9).astype(np.float32)
            all_nodes = np.concatenate((nodes[live], np.where(valid, around, -1)), axis=1)
            all_sims = np.concatenate((sims[live], found), axis=1)
            all_fresh = np.concatenate((fresh[live], valid), axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes[live], sims[live], fresh[live] = (np.take_along_axis(x, best, 1) for x in (all_nodes, all_sims, all_fresh))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)

    def _choose(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates (best first) those nearer to the point than to one chosen before; then the nearest."""
        order = np.argsort(-np.where(nodes >= 0, sims, -9), axis=1, kind="stable")
        nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
        width = nodes.shape[1]
        vectors = self.unit[np.maximum(nodes, 0)]
        mutual = np.matmul(vectors, vectors.transpose(0, 2, 1))
        kept = np.zeros(nodes.shape, bool)
        for c in range(width):
            close = np.where(kept[:, :c], mutual[:, c, :c], -9).max(axis=1, initial=-9)
            kept[:, c] = (nodes[:, c] >= 0) & (sims[:, c] > close) & (kept[:, :c].sum(axis=1) < most // 2 + most // 4)
        rank = np.where(nodes >= 0, np.where(kept, 4, 0) + sims, -9)
        best = np.argsort(-rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(nodes, best, 1)
        out[np.take_along_axis(rank, best, 1) <= -9 + 1e-6] = -1
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _build(self, degree: int) -> None:
        members, _ = self.levels[-1]
        bottom = len(members) == len(self.unit)
        row = np.full(len(self.unit), -1)
        row[members] = np.arange(len(members))
        near = np.full((len(members), degree), -1, np.int32)
        done, edges = 0, [(members[:0], members[:0])]
        while done < len(members):
            size = min(_BATCH, max(32, done), len(members) - done)
            batch = members[done : done + size]
            queries = self.unit[batch]
            own = queries @ queries.T
            np.fill_diagonal(own, -9)
            mine = np.argsort(-own, axis=1)[:, : BUILD_BEAM // 3]
            nodes, sims = batch[mine], np.take_along_axis(own, mine, 1)
            nodes = np.where(sims > -9, nodes, -1)
            edges.append((batch[sims[:, 0] > -9], nodes[sims[:, 0] > -9, 0]))
            if done:
                start = self._enter(queries, len(self.levels) - 1) if len(self.levels) > 1 else np.full(size, members[0])
                outside = row[start] >= done  # not inserted yet: begin at the first node
                start[outside] = members[0]
                more, more_sims = self._beam(queries, start, near, row, BUILD_BEAM)
                edges.append((batch, more[:, 0]))
                nodes, sims = np.concatenate((nodes, more), axis=1), np.concatenate((sims, more_sims), axis=1)
            links = self._choose(nodes, sims, degree)
            near[done : done + size] = links
            # the other way round: the linked nodes choose anew among what they had and the new ones
            a, k = np.nonzero(links >= 0)
            target, source = links[a, k], batch[a]
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            names, first, count = np.unique(target, return_index=True, return_counts=True)
            slot = np.arange(len(target)) - np.repeat(first, count)
            for low in range(0, int(count.max(initial=0)), degree):
                here = (slot >= low) & (slot < low + degree)
                who = np.unique(target[here])
                extra = np.full((len(who), degree), -1)
                extra[np.searchsorted(who, target[here]), slot[here] - low] = source[here]
                for c in range(0, len(who), _BATCH):
                    some = who[c : c + _BATCH]
                    had = near[row[some]]
                    joined = np.concatenate((had, np.where((extra[c : c + _BATCH, :, None] == had[:, None, :]).any(axis=2), -1, extra[c : c + _BATCH])), axis=1)
                    similar = np.where(joined >= 0, self._similar(self.unit[some], np.maximum(joined, 0)), -9)
                    near[row[some]] = self._choose(joined, similar, degree)
            done += size
        if bottom:  # rows in node order, so that searching needs no map
            flat = np.full_like(near, -1)
            flat[members] = near
            near, members = flat, np.arange(len(members))
            # the nearest nodes of its batch and before it that each node met, both ways: pruned by nobody
            a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
            order = np.argsort(np.concatenate((a, b)), kind="stable")
            self.kin, self.kin_at = np.concatenate((b, a))[order].astype(np.int32), np.searchsorted(np.concatenate((a, b))[order], np.arange(len(members) + 1))
        self.levels[-1] = (members, near)

    def near(self, unit: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs of at least ``least`` that searches with beams of ``beam`` find, some queries at a time.

        A beam leads to the nearest nodes; from there every node that is near enough is opened, whatever
        the beam's width, so that the work follows the links and a group isn't cut off by a full beam.
        """
        n, bottom = len(self.unit), self.levels[-1][1]
        step, least = max(8, min(_BATCH * 2, (16 << 20) // n)), least - self._slack()
        for c in range(0, len(unit), step):
            some = unit[c : c + step]
            nodes, sims = self._beam(some, self._enter(some, len(self.levels) - 1), bottom, None, min(beam, n))
            seen = np.zeros((len(some), n), bool)
            a, k = np.nonzero((sims >= least - _AROUND) & (nodes >= 0))
            query, node, good, found = a, nodes[a, k], sims[a, k] >= least, []
            seen[query, node] = True
            while len(query):
                found.append((c + query[good], node[good]))
                fresh = []
                for low in range(0, len(query), 1 << 14):
                    opened, asking = node[low : low + (1 << 14)], query[low : low + (1 << 14)]
                    around, kin = bottom[opened], self.kin_at[opened + 1] - self.kin_at[opened]
                    who = np.broadcast_to(asking[:, None], around.shape)[around >= 0]
                    key = np.concatenate((who * n + around[around >= 0], np.repeat(asking, kin) * n + self.kin[ragged(self.kin_at[opened], kin)]))
                    key = np.unique(key[~seen.ravel()[key]])
                    seen.ravel()[key] = True
                    who, there = key // n, key % n
                    sims = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", some[who[d : d + _VERIFIED]], self.unit[there[d : d + _VERIFIED]]) for d in range(0, len(key), _VERIFIED))])
                    close = sims >= least - _AROUND
                    fresh.append((who[close], there[close], sims[close] >= least))
                query, node, good = (np.concatenate(x) for x in zip(*fresh, strict=True))
            yield joined(found)

    def exact(self, unit: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query, node) pairs of at least ``least``: beams as wide as the shard, by slices of queries."""
        step = max(8, (4 << 20) // len(self.unit))
        for c in range(0, len(unit), step):
            a, node = np.nonzero(unit[c : c + step] @ self.unit.T >= least - self._slack())
            yield c + a, node

    def links(self, queries: np.ndarray, least: float, beam: int, keys: np.ndarray, names: np.ndarray) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], int]:
        """(query, node) pairs of at least ``least``, and the beam that an audit let pass (0: wider than the shard).

        ``keys`` and ``names`` name queries and nodes. The audit's work is bounded: the ``AUDITED`` queries of least
        hash are compared with every node, and ``PLACED`` queries are made at nodes of least hash. If one of the audited
        misses more than its share of its own links (a node to itself isn't one), or too many of the placed ones their
        node, beams double. A beam as wide as the shard sees every node, those without a way to them too.
        """
        unit, n = unit_vectors(queries), len(self.unit)
        least_hash = lambda x, count: np.argsort(mix(x.astype(np.int64).view(np.uint64)), kind="stable")[:count]
        audit, places = least_hash(keys, AUDITED), least_hash(names, PLACED)
        sample, node = joined(list(self.exact(unit[audit], least)))
        other = keys[audit[sample]] != names[node]
        sample, node = sample[other], node[other]
        true, wanted = np.bincount(sample, minlength=len(audit)), sample * n + node
        placed = self._placed(places, least)
        while beam < n:
            query, found = joined(list(self.near(unit[audit], least, beam)))
            missed = np.bincount(sample[~np.isin(wanted, query * n + found)], minlength=len(audit))
            query, found = joined(list(self.near(placed, least, beam)))
            lost = len(places) - int((found == places[query]).sum())
            if (missed <= (1 - RECALL) * true).all() and lost <= (1 - RECALL) * len(places):
                return self.near(unit, least, beam), beam
            beam *= 2
        return self.exact(unit, least), 0

    def _placed(self, places: np.ndarray, least: float) -> np.ndarray:
        """A unit vector for each of some nodes, at a cosine to it between ``least`` and 1 (evenly spread), in a direction of its own."""
        rng, at = np.random.default_rng(len(self.unit)), self.unit[places].astype(float)
        aside = rng.normal(size=at.shape)
        aside -= (aside * at).sum(axis=1, keepdims=True) * at
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = (least + (1 - least) * (np.arange(len(places)) + 1) / (len(places) + 1))[:, None]
        return np.where(size > 1e-9, cosine * at + np.sqrt(np.maximum(1 - cosine**2, 0)) * aside / np.maximum(size, 1e-9), at).astype(np.float32)

    def found(self, queries: np.ndarray, least: float, keys: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The pairs of ``links`` as bits: a row per query, eight nodes a byte."""
        out = np.zeros((len(queries), -(-len(self.unit) // 8)), np.uint8)
        for query, node in self.links(queries, least, BEAM, keys, names)[0]:
            if len(query):
                low, high = int(query.min()), int(query.max()) + 1
                block = np.zeros((high - low, len(self.unit)), bool)
                block[query - low, node] = True
                out[low:high] |= np.packbits(block, axis=1, bitorder="little")
        return out

    def _slack(self) -> float:
        return max(_SLACK, self.unit.shape[1] * 2.0**-23)

    def dump(self, **more: np.ndarray) -> bytes:
        file = io.BytesIO()
        np.savez(file, unit=self.unit, kin=self.kin, kin_at=self.kin_at, depth=len(self.levels), **{f"{'mn'[k]}{i}": x for i, level in enumerate(self.levels) for k, x in enumerate(level)}, **more)
        return file.getvalue()

    @classmethod
    def load(cls, held: np.lib.npyio.NpzFile) -> SmallWorld:
        self = cls.__new__(cls)
        self.unit, self.kin, self.kin_at = (held[x] for x in ("unit", "kin", "kin_at"))
        self.levels = [(held[f"m{i}"], held[f"n{i}"]) for i in range(int(held["depth"]))]
        return self


def joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 0))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors as doubles, each divided by a power of two (exactly), so that no product overflows."""
    x = vectors.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a`` and ``b``, pair by pair; ``labels`` (in place) names each class by its least member."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _read(uri: str) -> np.lib.npyio.NpzFile:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return np.load(io.BytesIO(file.read()))


@lru_cache(maxsize=2)
def _shelf(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, SmallWorld]:
    """Names, copies, vectors and graph of a shard's file."""
    held = _read(uri)
    return held["names"], held["copies"], held["vectors"], SmallWorld.load(held)


def search_pair(one: tuple, other: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two shelves (or one with itself): copies of all nodes linked to each node of either, and a forest (a, b) of the links.

    Both query each other's graph, and a pair that either search has found is verified once and counts at both ends.
    """
    (mine, copies, held, graph), (names, others, vectors, across) = one, other
    same, n, m = one is other, len(mine), len(names)
    there = across.found(held, least, mine, names)
    back = there if same else graph.found(vectors, least, names, mine)
    outside, beyond, labels = np.zeros(n, np.int64), np.zeros(m, np.int64), np.arange(n if same else n + m)
    for low in range(0, n, _ROWS):
        high = min(low + _ROWS, n)
        linked = np.unpackbits(there[low:high], axis=1, count=m, bitorder="little").view(bool)
        linked |= np.unpackbits(back[:, low // 8 : -(-high // 8)], axis=1, count=high - low, bitorder="little").view(bool).T
        if same:
            linked[np.arange(high - low), np.arange(low, high)] = False
        query, node = np.nonzero(linked)
        query += low
        good = np.concatenate([np.zeros(0, bool), *(_cosines(held[query[c : c + _VERIFIED]], vectors[node[c : c + _VERIFIED]]) >= least for c in range(0, len(query), _VERIFIED))])
        query, node = query[good], node[good]
        outside += np.bincount(query, weights=others[node], minlength=n).astype(np.int64)
        if not same:
            beyond += np.bincount(node, weights=copies[query], minlength=m).astype(np.int64)
        unite(labels, query, node if same else n + node)
    every, child = mine if same else np.concatenate((mine, names)), np.flatnonzero(labels != np.arange(len(labels)))
    return outside, beyond, every[child], every[labels[child]]


def _search(least: float):  # noqa: ANN202
    """Each row names two shards (or one twice) of which every vector queries the other's graph."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                mine, theirs = _shelf(one), _shelf(other)
                outside, beyond, a, b = search_pair(mine, theirs, least)
                names, number = np.concatenate((mine[0], theirs[0])), np.concatenate((outside, beyond))
                linked = np.flatnonzero(number)
                count = np.concatenate((np.ones(len(linked), bool), np.zeros(len(a), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((names[linked], a))), pa.array(np.concatenate((0 * linked, b)), mask=count), pa.array(np.concatenate((number[linked], 0 * a)))], ["a", "b", "outside"])

    return search


def _build_graphs(folder: str):  # noqa: ANN202
    def build(table: pa.Table) -> pa.Table:
        names, vectors = table["node"].to_numpy(), _vectors(table["vector"])
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.npz"  # a repeated attempt writes a file of its own
        with store.open_output_stream(f"{root}/{name}") as file:
            file.write(SmallWorld(vectors, names).dump(names=names, copies=table["copies"].to_numpy(), vectors=vectors))
        return table.select(["length", "shard"]).slice(0, 1).append_column("uri", pa.array([f"{folder}/{name}"]))

    return build


def embedding_links(embeddings: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", *, scan: bool | None = None) -> DataFrame:
    """One row per row of ``embeddings``: identity, vec_id, n_links, component_id and kept."""
    spark = embeddings.sparkSession
    scan = is_scan(embeddings) if scan is None else scan
    rows = identified(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), *(["_metadata"] if scan else [])), "vec_id", "vector", scan=scan)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good, bad = rows.where(usable).select(*RID, "vec_id", "vector"), rows.where(~usable).select(*RID, "vec_id")
    distinct = good.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "nodes")
    count, values = nodes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    size = 8 * values + NODE_BYTES * count
    shards = max(size // SHARD_BYTES + 1, count // SHARD_NODES + 1, min(SPREAD, count // SMALL + 1))
    shard = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(shards)).cast("int").alias("shard")
    shelves = materialize(nodes.select("length", shard, "node", "vector", "copies").repartition(shards, "length", "shard").groupBy("length", "shard").applyInArrow(_build_graphs(fresh_dir(spark, "graphs")), "length int, shard int, uri string"), "shelves")
    # every pair of shards is one turn; files are read where they are needed, and only their names are dealt
    other = shelves.select("length", F.col("shard").alias("other"), F.col("uri").alias("against"))
    every = shelves.withColumn("other", F.explode(F.sequence(F.col("shard"), F.lit(shards - 1)))).join(other, ["length", "other"])
    turns = materialize(every.select("uri", "against"), "turns")
    count = max(turns.count(), 1)
    # a task for each turn, or neighbouring turns, which share a file, in one task
    dealt = turns.repartition(count) if count <= TASKS else turns.repartitionByRange(TASKS, "uri", "against")
    found = materialize(dealt.mapInArrow(_search(least), "a long, b long, outside long"), "found")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("outside").alias("outside"))
    united = components(found.where("b is not null").select("a", "b"))
    classes = materialize(nodes.join(degree, "node", "left").join(united, "node", "left").select("vector", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"), "least_id", "copies"), "classes")
    least_ids = materialize(classes.groupBy("component").agg(F.min("least_id").alias("component_id")), "named")
    classes = materialize(classes.drop("least_id").join(least_ids, "component"), "classes")
    own = F.coalesce("component_id", "vec_id")
    out = with_group(good, classes, "vector", "copies").select(*RID, "vec_id", "n_links", own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
    return out.union(bad.select(*RID, "vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors whose cosine reaches 0.9."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scan=True).select("vec_id", "n_links", "component_id", "kept")
