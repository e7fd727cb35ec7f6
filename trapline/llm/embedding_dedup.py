"""Embedding near-dedup with a navigable small-world graph over a bounded sample of the vectors.

Equal vectors are one class first, so a group of copies is one node of whatever size. A hashed
sample of the classes (one in `SHARE`, `shard_rows` at most) are leaders; one graph over them is
built by one task and sent to all executors. Every class searches that graph once: the nearest
leader is its home, and the leaders in its beam are the homes that it visits. So all rows are
indexed, and a row costs one search whatever the number of rows. Classes lie in blocks dealt by a
hash; some blocks at a time (up to `HELD` bytes of vectors) are sent to all executors, put in order
of home there, and the blocks of queries are read past them, so vectors are not shuffled: a query is
compared with the members of the homes that it visits. Cosines of all hits are verified in double
precision.

The beam is fitted before: a sample of up to `AUDIT` queries is compared with all classes, and while
fewer than `RECALL` of their true links have a home in the beam, the beam is doubled, at last to all
leaders. Where a beam is full of leaders within twice the threshold's angle (a dense group), the
query visits all such leaders. A task gives the number of links of each query and a spanning forest
of the links, never all pairs of a group; components are united from the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths don't link; null ids stay null and never name a
component that has another id; rows repeated with one id are vectors of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from . import vec
from .components import components, local_roots
from .hnsw import GROUND, LINKS, Graph

#: First beam, classes of a block, share of true links that an audit must find, and queries it samples.
BEAM, BLOCK, RECALL, AUDIT = 96, 4096, 0.995, 2048
#: One leader for so many classes, and leaders that there are at least (if there are as many classes).
SHARE, FEW = 128, 256
#: Bytes of vectors that are sent together.
HELD = 96 << 20
#: Members that are compared at once, and hits that are held before they are reduced.
MEMBERS, HITS = 4096, 1 << 20


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    most = np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x / most, axis=1, keepdims=True) / most


def matrix(column, rows: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy().reshape(rows, -1)


def _index(table: pa.Table) -> pa.Table:
    """The leaders' graph: nodes in its own order, links of all layers."""
    ids, x = table["cid"].to_numpy(), matrix(table["e"], table.num_rows)
    o, sizes = Graph.order(vec.mix(ids.view(np.uint64)))
    unit = units(x[o]).astype(np.float32)
    g = Graph.build(unit, sizes)
    return pa.table({"sizes": pa.array([sizes], pa.list_(pa.int32())), "unit": pa.array([unit.tobytes()]), "links": pa.array([b"".join(x.tobytes() for x in g.layers)])})


INDEX = "sizes array<int>, unit binary, links binary"


def _load(row: dict) -> Graph:
    n = row["sizes"][-1]
    flat, layers, a = np.frombuffer(row["links"], np.int32), [], 0
    for k in row["sizes"]:
        w = GROUND if k == n else LINKS
        layers.append(flat[a : a + k * w].reshape(k, w))
        a += k * w
    return Graph(np.frombuffer(row["unit"], np.float32).reshape(n, -1), layers)


def visits(g: Graph, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries (unit vectors, float32): the nearest leader, the number of leaders that each visits, and these."""
    n = len(g.x)
    beam = min(beam, n)
    ids, sims = g.search(q, beam)
    home = np.where(ids[:, 0] < 0, 0, ids[:, 0]).astype(np.int64)
    reach = np.float32(2 * threshold**2 - 1 if threshold > 0 else -1)  # the cosine of twice the angle
    ok = ids >= 0
    dense = np.flatnonzero((sims[:, -1] >= reach) | ~ok.all(1)) if beam < n else np.zeros(0, np.int64)
    ok[dense] = False
    count, flat = ok.sum(1), ids[ok]
    if dense.size:
        found = []
        for a in range(0, len(dense), 512):
            s = q[dense[a : a + 512]] @ g.x.T
            home[dense[a : a + 512]] = s.argmax(1)
            least = np.minimum(np.partition(s, n - beam, axis=1)[:, n - beam], reach)
            r, k = np.nonzero(s >= least[:, None])
            found.append((dense[a + r], k))
        r, k = (np.concatenate(x) for x in zip(*found, strict=True))
        who = np.concatenate((np.repeat(np.arange(len(q)), count), r))
        flat = np.concatenate((flat, k))[np.argsort(who, kind="stable")]
        count = np.bincount(who, minlength=len(q))
    return home, count, flat


def _pack(sent, threshold: float, beam: int):
    """Classes to blocks, with the home of each and the leaders that it visits."""

    def f(batches):
        g, held, rows = _load(sent.value), [], 0

        def packed():
            t = pa.Table.from_batches(held)
            x = matrix(t["e"], t.num_rows)
            home, count, flat = visits(g, units(x).astype(np.float32), threshold, beam)
            size = np.uint16 if len(g.x) <= 1 << 16 else np.uint32
            put = (t["cid"].to_numpy(), t["n"].to_numpy(), np.ascontiguousarray(x), home.astype(size), count.astype(np.uint32), flat.astype(size))
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in put], BLOB)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == BLOCK:
                    yield packed()
                    held, rows = [], 0
        if rows:
            yield packed()
        R.trim()

    return f


BLOB = ["ids", "copies", "e", "home", "count", "visits"]


def _truth(sent, threshold: float):
    """(query, home) of all true links of the sample, and how many there are."""

    def f(batches):
        own, q, size, kind = sent.value
        for batch in batches:
            for ids, e, home in zip(batch["ids"], batch["e"], batch["home"], strict=True):
                ids, home = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(home.as_buffer(), size)
                unit, code = units(np.frombuffer(e.as_buffer(), kind).reshape(len(ids), -1)), []
                q32 = q.astype(np.float32)
                for a in range(0, len(ids), 512):
                    r, k = np.nonzero(q32 @ unit[a : a + 512].astype(np.float32).T >= np.float32(threshold - 1e-4))
                    ok = (np.einsum("nd,nd->n", q[r], unit[a + k]) >= threshold) & (own[r] != ids[a + k])
                    code.append(r[ok] << 32 | home[a + k[ok]].astype(np.int64))
                code, n = np.unique(np.concatenate(code), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(n)], ["q", "home", "n"])

    return f


def hits(g: Graph, unit: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(query, node) of cosine `threshold` or more, and of the audit that was passed: true links, and how many were found."""
    n, low = len(unit), np.float32(threshold - 1e-4)
    q32 = q.astype(np.float32)
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = [np.flatnonzero(unit @ q[k] >= threshold) for k in sample]
    while True:
        beam = min(beam, n)
        rows, nodes, todo, width = [], [], np.arange(len(q)), beam
        while todo.size:
            ids, sims = g.search(q32[todo], width)
            full = (sims[:, -1] >= low) & (width < n)
            i, j = np.nonzero((sims >= low) & (ids >= 0) & ~full[:, None])
            rows.append(todo[i])
            nodes.append(ids[i, j])
            todo, width = todo[full], min(n, 4 * width)
        r, k = np.concatenate(rows), np.concatenate(nodes)
        ok = np.concatenate([np.einsum("nd,nd->n", q[r[a : a + 65536]], unit[k[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.zeros(0)]) >= threshold
        r, k = r[ok], k[ok]
        code = r.astype(np.int64) * n + k
        want = np.concatenate([s * n + t for s, t in zip(sample.tolist(), truth, strict=True)])
        found = int(np.isin(want, code).sum())
        if beam >= n or found >= RECALL * len(want):
            return r, k, len(want), found
        beam *= 2


#: Rows of what a block finds: links of a class (count), edges of the forest.
COUNT, EDGE = range(2)
FOUND = "a long, b long, kind int"


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
    edge = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[edge], nodes[root[edge]]


def _query(sent, threshold: float, size, kind):
    def f(batches):
        nodes, copies, home = (np.concatenate([np.frombuffer(x[c], t) for x in sent.value]) for c, t in (("ids", np.int64), ("copies", np.int64), ("home", size)))
        x = np.concatenate([np.frombuffer(x["e"], kind) for x in sent.value]).reshape(len(nodes), -1)
        o = np.argsort(home, kind="stable")
        nodes, copies, home, x = nodes[o], copies[o], home[o], x[o]
        x32 = np.concatenate([units(x[a : a + 65536]).astype(np.float32) for a in range(0, len(x), 65536)])
        cells, start = np.unique(home, return_index=True)
        end = np.append(start[1:], len(home))
        low = np.float32(threshold - 1e-4)
        for batch in batches:
            for ids, e, count, flat in zip(batch["ids"], batch["e"], batch["count"], batch["visits"], strict=True):
                own = np.frombuffer(ids.as_buffer(), np.int64)
                q = units(np.frombuffer(e.as_buffer(), kind).reshape(len(own), -1))
                q32, flat = q.astype(np.float32), np.frombuffer(flat.as_buffer(), size)
                o = np.argsort(flat, kind="stable")
                who = np.repeat(np.arange(len(own)), np.frombuffer(count.as_buffer(), np.uint32))[o]
                cut = np.stack([np.searchsorted(flat[o], cells, side) for side in ("left", "right")])
                links, ends, held, some = np.zeros(len(own)), [], [], 0

                def settle():
                    r, k = (np.concatenate(v) for v in zip(*held, strict=True))
                    for a in range(0, len(r), 65536):
                        i, j = r[a : a + 65536], k[a : a + 65536]
                        ok = (np.einsum("nd,nd->n", q[i], units(x[j])) >= threshold) & (own[i] != nodes[j])
                        i, j = i[ok], j[ok]
                        np.add(links, np.bincount(i, weights=copies[j], minlength=len(own)), out=links)
                        ends.append(forest_of(own[i], nodes[j]))

                for c in np.flatnonzero(cut[1] > cut[0]).tolist():
                    i = who[cut[0, c] : cut[1, c]]
                    for a in range(start[c], end[c], MEMBERS):
                        r, k = np.nonzero(q32[i] @ x32[a : min(end[c], a + MEMBERS)].T >= low)
                        held.append((i[r], a + k))
                        some += len(r)
                    if some > HITS:
                        settle()
                        held, some = [], 0
                if some:
                    settle()
                a, b = forest_of(*(np.concatenate(v) for v in zip(*ends, strict=True))) if ends else (np.zeros(0, np.int64),) * 2
                has = np.flatnonzero(links)
                kinds = np.repeat(np.array([COUNT, EDGE], np.int32), [len(has), len(a)])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.concatenate((own[has], a)), np.concatenate((links[has].astype(np.int64), b)), kinds)], ["a", "b", "kind"])
        R.trim()

    return f


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, shard_rows: int = 65_536, least_shards: int = 8, audit: list | None = None) -> DataFrame:
    """Per vector: id, n_links (other vectors of cosine `threshold` or more) and component (least id reachable).
    shard_rows: nodes of a graph at most; least_shards: blocks that the classes are dealt to at least.
    audit: gets the true links of the sample's queries and how many of them have a home that their query visits."""
    single = rows.schema[vector_col].dataType == T.ArrayType(T.FloatType(), rows.schema[vector_col].dataType.containsNull)
    e = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + F.lit(0.0))
    base = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), e.alias("e"))
    fine = F.coalesce((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    keys = [F.when(fine, F.xxhash64("e")).alias("cid"), F.when(fine, F.xxhash64(F.reverse("e"), F.lit(1))).alias("key")]
    classes = R.cut(base.select("id", "e", *keys).where("cid is not null").groupBy("cid", "key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("e").cast("array<float>" if single else "array<double>").alias("e")))
    found = None
    for (width,) in classes.select(F.size("e")).distinct().collect():
        found_here = _links(classes.where(F.size("e") == width), threshold, shard_rows, least_shards, np.float32 if single else np.float64, audit)
        found = found_here if found is None else found.unionByName(found_here)
    if found is None:
        return base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    linked = components(found.where(F.col("kind") == EDGE).select("a", "b"))
    counts = found.where(F.col("kind") == COUNT).groupBy("a").agg(F.sum("b").alias("links"))
    of = R.cut(classes.drop("e").join(counts.withColumnRenamed("a", "cid"), "cid", "left").join(linked.withColumnRenamed("node", "cid"), "cid", "left").where("n > 1 or links is not null or component is not null").withColumn("c", F.coalesce("component", "cid")))
    least = of.groupBy("c").agg(F.min("least").alias("component_id"))
    known = of.join(least, "c").select("cid", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = base.select("id", *keys).join(known, ["cid", "key"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component"))


def _links(classes: DataFrame, threshold: float, shard_rows: int, least_shards: int, kind, audit: list | None) -> DataFrame:
    """What the queries of all classes find (FOUND)."""
    sc, n = classes.sparkSession.sparkContext, classes.count()
    blocks = max(least_shards, -(-n // BLOCK))
    few = min(n, shard_rows, max(FEW, n // SHARE))
    sample = classes.select("cid", "e").orderBy(F.xxhash64("cid", F.lit(3)), "cid").limit(few)
    graph = sample.groupBy().applyInArrow(_index, INDEX).first().asDict()
    graph = {c: bytes(v) if isinstance(v, bytearray) else v for c, v in graph.items()}
    size = np.uint16 if few <= 1 << 16 else np.uint32
    asked = classes.select("cid", "e").orderBy(F.xxhash64("cid", F.lit(5)), "cid").limit(AUDIT).toArrow()
    q = units(matrix(asked["e"], asked.num_rows))
    leaders, sent = sc.broadcast(graph), sc.broadcast((asked["cid"].to_numpy(), q, size, kind))
    dealt = classes.select("cid", "n", "e").repartition(blocks, "cid")
    beam, packed, true = BEAM, None, None
    while True:
        # a file for a block: tasks then get as many blocks each
        packed = R.cut(dealt.mapInArrow(_pack(leaders, threshold, beam), ", ".join(f"{c} binary" for c in BLOB)))
        # homes can move with the beam, so the true links are looked for again
        true = packed.select("ids", "e", "home").mapInArrow(_truth(sent, threshold), "q long, home long, n long").groupBy("q", "home").agg(F.sum("n").alias("n")).toArrow()
        _, count, flat = visits(_load(graph), q.astype(np.float32), threshold, beam)
        found = np.isin(true["q"].to_numpy() << 32 | true["home"].to_numpy(), np.repeat(np.arange(len(q)), count) << 32 | flat.astype(np.int64))
        want, right = int(true["n"].to_numpy().sum()), int(true["n"].to_numpy()[found].sum())
        if beam >= few or right >= RECALL * want:
            break
        beam *= 2
    if audit is not None:
        audit[:] = [a + b for a, b in zip(audit or (0, 0), (want, right), strict=True)]
    leaders.unpersist()
    sent.unpersist()
    each = packed.select(F.input_file_name().alias("file"), F.octet_length("e").cast("long").alias("bytes")).groupBy("file").agg(F.sum("bytes").alias("bytes")).orderBy("file").collect()
    groups: dict[int, list[str]] = {}
    for x, upto in zip(each, accumulate(x.bytes for x in each), strict=True):
        groups.setdefault((upto - 1) // HELD, []).append(x.file)
    found = None
    for own in groups.values():
        sent = sc.broadcast([{c: bytes(v) for c, v in x.asDict().items()} for x in packed.where(F.input_file_name().isin(own)).select("ids", "copies", "e", "home").collect()])
        now = R.cut(packed.select("ids", "e", "count", "visits").mapInArrow(_query(sent, threshold, size, kind), FOUND))
        sent.unpersist()
        found = now if found is None else found.unionByName(now)
    return found


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
