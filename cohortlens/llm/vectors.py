"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors are one node. A bounded sample gives centroids; centroids close to each other are merged, so that a
   dense ball of vectors has one. Every node is indexed in its two nearest shards (overlap), in blocks of bounded size.
2. Each block builds a graph: near candidates and some random ones, robust-pruned. A node's adjacency lists from its
   shards are united.
3. Every node is also a query. It visits its nearest shards and searches each block greedily from the block's medoids
   (and from its own place, where it is a member), expanding every node within range until none is left.
   A shard or block that cannot hold a node within range, by angles to centroid and medoids, is passed over.
4. Links are verified by cosine in double precision. A block hands on counts and its local components, never pairs.
5. Recall is audited against brute force for a sample of queries after every round; if it is too low, the search is
   repeated with twice the shards a query and longer lists, up to all shards and whole blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import connected_components, hash_fraction, map_columns, materialise, per_task

MIN_COSINE = 0.9
SHARD_NODES = 2000
BLOCK_NODES = 2000
BLOCK_QUERIES = 4000
SAMPLE_NODES = 20_000
PROBES = 4
DEGREE = 24
BEAM = 8
AUDIT_QUERIES = 200
MIN_RECALL = 0.99
MERGE_COSINE = 0.75


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, vec): rows whose vector can link; vec holds little-endian doubles of length one."""

    @per_task
    def make():
        from hashlib import md5

        import numpy as np

        def step(rows):
            out = {"vec_id": [], "key": [], "dim": [], "vec": []}
            for vec_id, v in zip(rows["vec_id"], rows["embedding"]):
                if vec_id is None or not v or None in v:
                    continue
                a = np.array(v, np.float64)
                norm = np.linalg.norm(a / np.abs(a).max()) * np.abs(a).max() if np.isfinite(a).all() and a.any() else 0.0
                if norm and np.isfinite(norm):
                    out["vec_id"].append(vec_id)
                    out["key"].append(md5(a.tobytes()).hexdigest())
                    out["dim"].append(len(a))
                    out["vec"].append((a / norm).astype("<f8").tobytes())
            return out

        return step

    return map_columns(vectors.select("vec_id", "embedding"), make, "vec_id long, key string, dim int, vec binary")


def matrix(vecs: list):
    import numpy as np

    return np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1) if vecs else np.zeros((0, 0))


def centroids(sample, k: int, merge_cosine: float = MERGE_COSINE):
    """About ``k`` unit centroids of ``sample`` by Lloyd's iterations; those nearer than ``merge_cosine`` become one."""
    import numpy as np

    at = np.random.Generator(np.random.PCG64(11)).permutation(len(sample))[:k]
    c = sample[np.sort(at)]
    for _ in range(6):
        near = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < merge_cosine:
            kept.append(i)
    return c[kept]


def robust_prune(x, degree: int = DEGREE, near: int = 80, distant: int = 16, alpha: float = 1.2):
    """Neighbour lists of each row of ``x``: a candidate stays if no kept one is ``alpha`` times nearer to it.

    Each list also gets the rows that chose it, up to three times ``degree`` in all.
    """
    import numpy as np

    n = len(x)
    if n < 2:
        return [[] for _ in range(n)]
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ x.T))).astype(np.float32)
    np.fill_diagonal(dist, np.inf)
    m = min(near, n - 1)
    cand = np.argpartition(dist, m - 1, axis=1)[:, :m]
    extra = np.random.Generator(np.random.PCG64(13)).integers(0, n, (n, distant))
    cand = np.concatenate([cand, extra], axis=1)
    rows = np.arange(n)
    d = dist[rows[:, None], cand]
    kept = np.full((n, degree), -1)
    for r in range(degree):
        best = d.argmin(axis=1)
        star = cand[rows, best]
        alive = np.isfinite(d[rows, best])
        if not alive.any():
            break
        kept[alive, r] = star[alive]
        between = dist[star[:, None], cand]
        between[cand == star[:, None]] = 0
        d[(alpha * between <= d) & alive[:, None]] = np.inf
    lists = [{int(j) for j in row if j >= 0} for row in kept]
    for i, row in enumerate(kept.tolist()):  # the way back, so that a node can be reached from those it chose
        for j in row:
            if j >= 0 and len(lists[j]) < 3 * degree:
                lists[j].add(i)
    return [sorted(a) for a in lists]


def medoids_of(x, starts: int):
    """Places of up to ``starts`` medoids and the widest angle of each one's group."""
    import numpy as np

    seeds = np.linspace(0, len(x) - 1, min(starts, len(x))).astype(int)
    groups = (x @ x[seeds].T).argmax(axis=1)
    places, widest = [], []
    for g in range(len(seeds)):
        at = np.flatnonzero(groups == g)
        if len(at):
            places.append(at[(x[at] @ x[at].sum(axis=0)).argmax()])
            widest.append(np.arccos(np.clip(x[at] @ x[places[-1]], -1, 1).min()))
    return np.array(places), np.array(widest)


def range_search(queries, own, x, adjacency, min_cosine: float, starts: int = 16, beam: int = BEAM, width: int = 4, slack: float = 0.03,
                 share: int = 512):
    """(query, node, distances): the pairs within range that the search finds, and the number of distances it computed.

    A query starts from ``own``, its place in ``x``, or where that is -1 from the medoids; if no medoid's group can
    hold a node within range, by the triangle inequality, it is done. Otherwise every node within range is expanded,
    and of the others the ``beam`` best (a quarter of that from a query's own place), ``width`` at a time. A query that
    has followed as many edges as there are nodes (in a dense ball) is compared with the rest at once. So the work
    follows the nodes visited and is bounded by comparing all; the state is a list a query and five bytes a node for
    ``share`` queries at a time. With ``beam`` of all nodes or more everything is compared.
    """
    import numpy as np

    n, q = len(x), len(queries)
    table = np.full((n, max(1, max(map(len, adjacency)))), -1, np.int32)
    for i, a in enumerate(adjacency):
        table[i, :len(a)] = a
    full = np.array([len(a) for a in adjacency])
    medoids, widest = medoids_of(x, starts)
    small = x.astype(np.float32)
    stamp = np.empty(min(share, q) * n, np.int32)
    found_q, found_n, computed = [np.zeros(0, int)], [np.zeros(0, int)], 0
    for lo in range(0, q, share):
        part, mine = queries[lo:lo + share].astype(np.float32), own[lo:lo + share]
        m = len(part)
        seen = np.zeros(m * n, bool)
        best, value = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf, np.float32)
        fresh = np.zeros((m, beam), bool)  # not expanded yet
        places = np.where(mine >= 0, max(1, beam // 4), beam)
        spent = np.zeros(m, np.int64)
        near = part @ small[medoids].T
        hope = (np.arccos(np.clip(near, -1, 1)) - widest <= np.arccos(min_cosine) + 1e-3).any(axis=1) & (mine < 0)
        computed += near.size
        inside, outside = np.flatnonzero(mine >= 0), np.flatnonzero(hope)
        who = np.concatenate([inside, np.repeat(outside, len(medoids))])
        node = np.concatenate([mine[inside], np.tile(medoids, len(outside))])
        near = np.concatenate([np.ones(len(inside), np.float32), near[outside].ravel()])
        if beam >= n:
            spent[:] = n + 1
        while True:
            seen[who * n + node] = True
            hit = near >= min_cosine - slack
            found_q.append(lo + who[hit])
            found_n.append(node[hit])
            # The others compete for places in their query's list.
            other = np.flatnonzero(~hit & (near > value[who, places[who] - 1]))
            w, v, d = who[other], node[other], near[other]
            order = np.lexsort((v, -d, w))
            w, v, d = w[order], v[order], d[order]
            rank = np.arange(len(w)) - np.searchsorted(w, w)
            keep = rank < places[w]
            rows, at = np.unique(w[keep], return_inverse=True)
            if len(rows):
                more, close = np.full((len(rows), beam), -1, np.int32), np.full((len(rows), beam), -np.inf, np.float32)
                more[at, rank[keep]], close[at, rank[keep]] = v[keep], d[keep]
                close = np.concatenate([value[rows], close], axis=1)
                top = np.argsort(-close, axis=1, kind="stable")[:, :beam]
                value[rows] = np.take_along_axis(close, top, axis=1)
                best[rows] = np.take_along_axis(np.concatenate([best[rows], more], axis=1), top, axis=1)
                fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], more >= 0], axis=1), top, axis=1)
                fresh[rows] &= np.arange(beam) < places[rows, None]
            chosen = fresh & (np.cumsum(fresh, axis=1) <= width)
            fresh &= ~chosen
            w, at = np.nonzero(chosen)
            who, v = np.concatenate([who[hit], w]), np.concatenate([node[hit], best[w, at]])
            spent += np.bincount(who, full[v], m).astype(np.int64)
            dense = np.flatnonzero((spent > n) & (spent >= 0))
            if len(dense):
                rest = (part[dense] @ small.T >= min_cosine - slack) & ~seen.reshape(m, n)[dense]
                computed += rest.size
                w, at = np.nonzero(rest)
                found_q.append(lo + dense[w])
                found_n.append(at)
                spent[dense] = np.iinfo(np.int64).min // 2  # done
                fresh[dense] = False
            go = spent[who] >= 0
            who, v = who[go], v[go]
            if not len(who):
                break
            near_of = table[v]
            who, node = np.repeat(who, full[v]), near_of[near_of >= 0]
            pair = who * n + node
            pair = pair[~seen[pair]]
            stamp[pair] = np.arange(len(pair))  # of equal pairs one stays
            pair = pair[stamp[pair] == np.arange(len(pair))]
            who, node = pair // n, pair % n
            near = np.empty(len(pair), np.float32)
            for i in range(0, len(pair), 16_384):
                near[i:i + 16_384] = np.einsum("ij,ij->i", part[who[i:i + 16_384]], small[node[i:i + 16_384]])
            computed += len(pair)
    a, b = np.concatenate(found_q), np.concatenate(found_n)
    true = np.zeros(len(a), bool)
    for i in range(0, len(a), 65_536):  # verify in double precision
        true[i:i + 65_536] = np.einsum("ij,ij->i", queries[a[i:i + 65_536]], x[b[i:i + 65_536]]) >= min_cosine
    return a[true], b[true], computed


def local_roots(a, b, query_rep, node_rep):
    """The smallest representative that the links ``a[i]`` to ``b[i]`` reach, for the queries and for the nodes."""
    import numpy as np

    ql, nl = query_rep.copy(), node_rep.copy()
    while True:
        q2, n2 = ql.copy(), nl.copy()
        np.minimum.at(q2, a, nl[b])
        np.minimum.at(n2, b, q2[a])
        if (q2 == ql).all() and (n2 == nl).all():
            return ql, nl
        ql, nl = q2, n2


def nearest_shards(model: dict, dims: list, vecs: list, count: int) -> list[list[tuple[int, float]]]:
    """(shard, angle to its centroid) of each vector, the nearest first, ``count`` at most; model: dim -> (first number, centroids)."""
    import numpy as np

    out: list = [None] * len(vecs)
    for dim in set(dims):
        at = [i for i, d in enumerate(dims) if d == dim]
        first, c = model[dim]
        cosine = matrix([vecs[i] for i in at]) @ c.T
        close = np.argsort(-cosine, axis=1, kind="stable")[:, :count]
        angle = np.arccos(np.clip(np.take_along_axis(cosine, close, axis=1), -1, 1))
        for i, row, far in zip(at, (close + first).tolist(), angle.tolist()):
            out[i] = list(zip(row, far))
    return out


def shard_model(nodes: DataFrame, n: int, shard_nodes: int, sample_nodes: int) -> dict:
    """dim -> (number of its first shard, centroids), from about ``sample_nodes`` nodes picked by a hash of the key."""
    import numpy as np

    share = 1.0 if n <= sample_nodes else sample_nodes / n
    sample = nodes.select("key", "dim", "vec")
    sample = sample.where(hash_fraction(F.col("key"), share)) if share < 1 else sample
    rows = sorted((r["dim"], r["key"], bytes(r["vec"])) for r in sample.collect())
    model, first = {}, 0
    # Lengths outside the sample get a shard of their own.
    for dim in sorted(r["dim"] for r in nodes.select("dim").distinct().collect()):
        own = matrix([v for d, _, v in rows if d == dim])
        k = max(1, min(len(own) // 4, round(len(own) / share / shard_nodes)))
        model[dim] = (first, centroids(own, k) if len(own) else np.ones((1, dim)) / dim ** 0.5)
        first += len(model[dim][1])
    return model


def build_graph(nodes: DataFrame, model, block_nodes: int, degree: int) -> tuple[DataFrame, DataFrame]:
    """(shard, block, key, vec, rep, copies, homes, near) with united adjacency lists, and (shard, blocks, radius)."""
    shared = nodes.sparkSession.sparkContext.broadcast(model)

    @per_task
    def homes():
        def step(rows):
            near = nearest_shards(shared.value, rows["dim"], rows["vec"], 2)
            return rows | {"homes": [[s for s, _ in n] for n in near], "angles": [[a for _, a in n] for n in near]}

        return step

    placed = map_columns(nodes, homes, "key string, dim int, vec binary, rep long, copies long, homes array<int>, angles array<double>")
    spread = (placed.select("*", F.posexplode("homes").alias("at", "shard")).withColumn("angle", F.element_at("angles", F.col("at") + 1))
              .drop("at", "angles"))
    sizes = materialise(spread.groupBy("shard").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("blocks"), F.max("angle").alias("radius")),
                        "shards")
    # One row a shard: at most a quarter of the sample.
    members = materialise(spread.drop("angle").join(F.broadcast(sizes.drop("radius")), "shard").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "members")

    def build(table):
        import pyarrow as pa

        table = table.sort_by([("key", "ascending")])  # the same graph in whatever order the rows arrive
        keys = table.column("key").to_pylist()
        lists = robust_prune(matrix(table.column("vec").to_pylist()), degree)
        return pa.table({"key": pa.array(keys, pa.string()), "near": pa.array([[keys[j] for j in a] for a in lists], pa.list_(pa.string()))})

    lists = members.select("shard", "block", "key", "vec").groupBy("shard", "block").applyInArrow(build, "key string, near array<string>")
    near = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return materialise(members.join(near, "key"), "graph"), sizes


def search_graph(graph: DataFrame, sizes: DataFrame, nodes: DataFrame, model, probes: int, min_cosine: float,
                 block_queries: int, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """(key, links) of each node and (src, dst) edges of the components, as far as found."""
    # One row a shard, as in the model itself.
    radius = {r["shard"]: r["radius"] for r in sizes.select("shard", "radius").collect()}
    shared = nodes.sparkSession.sparkContext.broadcast((model, radius))

    @per_task
    def visit():
        from math import acos

        model, radius = shared.value
        reach = acos(min_cosine) + 1e-6

        def step(rows):
            # By the triangle inequality a shard whose members all lie too far off holds no link.
            return rows | {"visits": [[s for s, a in near if s in radius and a - radius[s] <= reach]
                                      for near in nearest_shards(model, rows["dim"], rows["vec"], probes)]}

        return step

    visits = map_columns(nodes, visit, "key string, dim int, vec binary, rep long, copies long, visits array<int>")
    spread = visits.select("key", "vec", "rep", "visits", F.posexplode("visits").alias("rank", "shard"))
    loads = spread.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("shares"))
    plan = F.broadcast(materialise(sizes.drop("radius").join(loads, "shard"), "loads"))
    q = (spread.join(plan, "shard").withColumn("share", F.pmod(F.xxhash64("key", F.lit(3)), F.col("shares")).cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select("shard", "block", "share", "key", "vec", "rep", "visits", "rank"))
    index = (graph.join(plan, "shard").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
             .select("shard", "block", "share", "key", "vec", "rep", "copies", "homes", "near"))

    def search(left, right):
        import numpy as np
        import pyarrow as pa

        found_rows = {"key": [], "links": [], "src": [], "dst": []}
        left, right = left.sort_by([("key", "ascending")]), right.sort_by([("key", "ascending")])
        if left.num_rows and right.num_rows:
            keys = left.column("key").to_pylist()
            place = {k: i for i, k in enumerate(keys)}
            x, qx = matrix(left.column("vec").to_pylist()), matrix(right.column("vec").to_pylist())
            adjacency = [[place[k] for k in a if k in place] for a in left.column("near").to_pylist()]
            qkeys = right.column("key").to_pylist()
            own = np.array([place.get(k, -1) for k in qkeys])
            a, b, _ = range_search(qx, own, x, adjacency, min_cosine, beam=beam)
            other = own[a] != b
            a, b = a[other], b[other]
            rep, qrep = np.array(left.column("rep").to_pylist()), np.array(right.column("rep").to_pylist())
            ql, nl = local_roots(a, b, qrep, rep)
            for r, low in ((qrep, ql), (rep, nl)):
                moved = np.flatnonzero(low < r)
                found_rows["src"] += r[moved].tolist()
                found_rows["dst"] += low[moved].tolist()
            # A link counts in the first shard, in the query's order, that holds the node.
            homes = np.array([(h + h)[:2] for h in left.column("homes").to_pylist()])
            visits, rank = right.column("visits").to_pylist(), np.array(right.column("rank").to_pylist())
            before = np.full((len(qkeys), max(map(len, visits))), -1)
            for i, v in enumerate(visits):
                before[i, :rank[i]] = v[:rank[i]]
            for j in range(rank.max()):
                first = (before[a, j] != homes[b, 0]) & (before[a, j] != homes[b, 1])
                a, b = a[first], b[first]
            links = np.zeros(len(qkeys), np.int64)
            np.add.at(links, a, np.array(left.column("copies").to_pylist())[b])
            some = np.flatnonzero(links)
            found_rows["key"] += [qkeys[i] for i in some]
            found_rows["links"] += links[some].tolist()
        n, m = len(found_rows["key"]), len(found_rows["src"])
        return pa.table({c: pa.array(v + [None] * m if c in ("key", "links") else [None] * n + v, pa.string() if c == "key" else pa.int64())
                         for c, v in found_rows.items()})

    out = materialise(index.groupBy("shard", "block", "share").cogroup(q.groupBy("shard", "block", "share"))
                      .applyInArrow(search, "key string, links long, src long, dst long"), "found")
    links = out.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    return links, out.where("src is not null").select("src", "dst").distinct()


def audit_recall(nodes: DataFrame, links: DataFrame, n: int, min_cosine: float, queries: int = AUDIT_QUERIES) -> float:
    """Recall for about ``queries`` nodes picked by a hash, each compared with every node: found links over true ones,
    or the mean of that over the queries with a link, whichever is less (a dense ball weighs little in the second)."""
    share = min(1.0, queries / max(1, n))
    picked = nodes.where(hash_fraction(F.concat("key", F.lit("+")), share)) if share < 1 else nodes
    asked = [(r["key"], r["dim"], bytes(r["vec"])) for r in picked.select("key", "dim", "vec").collect()]
    if not asked:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    @per_task
    def make():
        import numpy as np

        by_dim = {d: ([k for k, e, _ in shared.value if e == d], matrix([v for _, e, v in shared.value if e == d]))
                  for d in {e for _, e, _ in shared.value}}

        def step(rows):
            out = {"key": [], "n": []}
            for d in set(rows["dim"]) & set(by_dim):
                at = [i for i, e in enumerate(rows["dim"]) if e == d]
                keys, qx = by_dim[d]
                near = qx @ matrix([rows["vec"][i] for i in at]).T >= min_cosine
                near &= np.array(keys)[:, None] != np.array([rows["key"][i] for i in at])[None, :]
                n = near @ np.array([rows["copies"][i] for i in at])
                out["key"] += keys
                out["n"] += n.tolist()
            return out

        return step

    true = (map_columns(nodes.select("key", "dim", "vec", "copies"), make, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")))
    found = F.least(F.col("n"), F.coalesce("links", F.lit(0)))
    got = (true.where("n > 0").join(links, "key", "left")
           .agg(F.count("*").alias("asked"), (F.sum(found) / F.sum("n")).alias("by_link"), F.avg(found / F.col("n")).alias("by_query")).first())
    return min(got["by_link"], got["by_query"]) if got["asked"] else 1.0


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, shard_nodes: int = SHARD_NODES,
                           block_nodes: int = BLOCK_NODES, block_queries: int = BLOCK_QUERIES, probes: int = PROBES,
                           degree: int = DEGREE, sample_nodes: int = SAMPLE_NODES, min_recall: float = MIN_RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding)``.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, and neither do
    vectors of different lengths. Equal vectors link; a cosine of exactly ``min_cosine`` does too. A row without an id
    has no links, a null component and is kept. Rows that share an id are one vector, whose links are added up. Other
    columns are ignored.
    """
    vectors = vectors.select("vec_id", "embedding")
    rows = materialise(nodes_of(vectors).dropDuplicates(["vec_id", "key"]), "vectors")
    nodes = materialise(rows.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.min("vec_id").alias("rep"),
                                                F.count("*").alias("copies")), "nodes").select("key", "dim", "vec", "rep", "copies")
    ids = vectors.select("vec_id")
    n = nodes.count()
    if n:
        model = shard_model(nodes, n, shard_nodes, sample_nodes)
        shards = sum(len(c) for _, c in model.values())
        graph, sizes = build_graph(nodes, model, block_nodes, degree)
        beam = BEAM
        while True:
            links, edges = search_graph(graph, sizes, nodes, model, probes, min_cosine, block_queries, beam)
            # Every round is audited; one that visits every shard and compares whole blocks leaves nothing to repeat.
            if audit_recall(nodes, links, n, min_cosine) >= min_recall or probes >= shards and beam >= 2 * block_nodes:
                break
            probes, beam = 2 * probes, 4 * beam
        several = rows.select("vec_id", "key").join(nodes.select("key", "rep"), "key")
        ties = several.select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"))
        components = connected_components(edges.union(ties), "vectors")
        own = (rows.select("vec_id", "key").join(nodes.select("key", "copies"), "key").join(links, "key", "left")
               .groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        found = own.join(components, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", "component")
    else:
        found = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return (ids.join(found, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
