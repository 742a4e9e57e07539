"""Exact Jaccard self-join of shingle sets by token-group matrices.

1. Each text becomes its set of shingle hashes. Texts with equal sets are one
   node from here on, so copies cost nothing further.
2. Blocking by prefix: two sets with J >= 0.8 share one of the first
   n - ceil(0.8 n) + 1 tokens of each in any fixed order of tokens. The order used
   puts tokens with hashes in a fixed quarter of the range first, by how many
   nodes hold them. Only those tokens are shuffled, and their counts are exact; a
   node whose prefix is filled by tokens that no other node has leaves at once.
   So common passages do not pair unlike documents.
3. Nodes that share prefix tokens form components (labels, not pairs, travel).
   A component of several groups is formed again from the prefixes of whole sets, with
   the counts of all tokens among such nodes: most nodes of a text of their own
   leave, as a quarter of it may be little more than its passages that others hold too.
   A component is dealt to groups of bounded token count: nodes of equal least token
   (a minhash, equal with the sets' similarity) go to one group, or to several where
   they are too many. A group of a component with several is stored once, its token
   union in a file of its own; each pair of such groups whose set sizes allow a
   link is one task that reads the unions first and opens the groups only if they
   can match. So a large family is many tasks, never one, and its sets are shuffled once.
4. In a task similar nodes are sorted into small groups, again with their unions.
   A matrix product bounds every node's overlap with every group, and only groups
   that can hold a match are opened and scored exactly.

Equality of sets and tokens is that of 64-bit hashes.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AtomicFile, claim, open_fs, persist, prepare, read_table, shared_dir, table
from .shingles import shingle_hashes

#: A link: 100 * intersection >= LINK * union.
LINK = 80
#: Hashes below this are counted over all nodes (a quarter of the range).
COUNTED = np.uint64(1 << 62)
#: Tokens of a group of a component; members of a group inside a block.
GROUP_TOKENS, MEMBERS, CHUNK = 400_000, 32, 2048

SIGNS = pa.schema([("pid", pa.int32()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("slack", pa.int32()), ("low", pa.int64()), ("tokens", pa.list_(pa.int64()))])
SIGNS_DDL = "pid int, idx int, doc_id long, n int, node long, slack int, low long, tokens array<long>"


def prefix_length(n: int, link: int = LINK) -> int:
    return n - -(-link * n // 100) + 1


def sign(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its place, set size, node and counted tokens.

    ``tokens`` is null where an earlier row of the same task has the same node.
    """

    def run(batches):
        claim()
        pid, idx, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            rows = {f.name: [] for f in SIGNS}
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_hashes(cell.as_py())
                n, node, slack, low, tokens = len(s), None, 0, None, None
                if n:
                    low = int(s[0].view(np.int64))
                    node = int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)))
                    least = prefix_length(n)
                    most = max(least, int(np.searchsorted(s, COUNTED)))
                    slack = most - least
                    if node not in seen:
                        seen.add(node)
                        tokens = s[:most].view(np.int64)
                for name, value in zip(rows, (pid, idx, doc_id, n, node, slack, low, tokens)):
                    rows[name].append(value)
                idx += 1
            yield table(SIGNS, **rows)

    return docs.mapInArrow(run, SIGNS_DDL)


def postings(signs: DataFrame) -> DataFrame:
    """(node, h): the prefix tokens of nodes that at least two nodes hold.

    The counts that order tokens are those of rows, combined map-side, so a token that a third of
    all rows hold is a row per task; rows then meet their counts in a join, whose skewed
    partitions the engine can split.
    """
    tokens = signs.filter("tokens is not null").select("node", "slack", F.explode("tokens").alias("h"))
    counts = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("h", "df")
    mine = tokens.join(counts, "h").groupBy("node").agg(F.max("slack").alias("slack"), F.collect_set(F.struct("df", "h")).alias("l"))
    first = mine.filter("size(l) > slack").select("node", F.explode(F.expr("slice(sort_array(l), 1, size(l) - slack)")).alias("t"))
    return first.select("node", F.col("t.h").alias("h"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of undirected edges (a, b): the least node of each component.

    Labels spread to neighbours and jump to their label's label, so rounds grow
    with the logarithm of the longest path. Each round is written, which cuts
    lineage; only a count comes back to the driver.
    """
    both = persist(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = persist(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        heads = labels.select(F.col("node").alias("head"), F.col("comp").alias("up"))
        jumped = step.join(heads, F.col("comp") == F.col("head"), "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        new = persist(jumped, f"{name}-labels")
        changed = new.filter("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def candidate_components(posts: DataFrame) -> DataFrame:
    """(node, comp) of nodes that share prefix tokens, by stars on the tokens."""
    heads = posts.groupBy("h").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "b")
    edges = posts.join(heads, "h").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return components(edges, "jaccard-candidates")


BLOCKS = pa.schema([("comp", pa.int64()), ("g", pa.int32()), ("k", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("tokens", pa.binary())])
BLOCKS_DDL = "comp long, g int, k int, node long, copies long, tokens binary"


def fetch(docs: DataFrame, folder: str) -> DataFrame:
    """The token sets of the wanted rows, each once.

    ``folder`` holds the wanted places by partition; the second scan meets them by
    position, so no text is shuffled. A node that isn't found there again fails.
    """

    def run(batches):
        claim()
        pid, idx = TaskContext.get().partitionId(), 0
        fs, path = open_fs(f"{folder}/pid={pid}")
        from pyarrow.fs import FileSelector

        want: dict[int, tuple] = {}
        for info in fs.get_file_info(FileSelector(path, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for r in pq.ParquetFile(f).read().to_pylist():
                        want[r["idx"]] = (r["node"], r["comp"], r["g"], r["k"], r["copies"])
        for batch in batches:
            rows, size = {f.name: [] for f in BLOCKS}, 0
            for i in range(batch.num_rows):
                if idx in want:
                    node, comp, g, k, copies = want.pop(idx)
                    s = shingle_hashes(batch.column(1)[i].as_py())
                    data = s.tobytes()
                    if node != int(np.uint64(xxhash.xxh64_intdigest(data)).view(np.int64)):
                        raise RuntimeError("the input changed between two scans")
                    for name, value in zip(rows, (comp, g, k, node, copies, data)):
                        rows[name].append(value)
                    size += len(data)
                    if size > 8 << 20:
                        yield table(BLOCKS, **rows)
                        rows, size = {f.name: [] for f in BLOCKS}, 0
                idx += 1
            yield table(BLOCKS, **rows)
        if want:
            raise RuntimeError("the input changed between two scans")

    return docs.mapInArrow(run, BLOCKS_DDL)


def wanted_places(nodes: DataFrame, name: str) -> str:
    """The folder that ``fetch`` reads, of (node, comp, g, k, copies, place)."""
    folder = shared_dir(nodes.sparkSession, name)
    places = nodes.select("node", "comp", "copies", "k", "g", F.col("place.idx").alias("idx"), F.col("place.pid").alias("pid"))
    places.repartition("pid").write.partitionBy("pid").parquet(folder)
    return folder


def whole_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp) among ``nodes`` by the prefixes of their whole sets, any token counted."""
    schema = pa.schema([("node", pa.int64()), ("slack", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(5)]
            yield table(schema, node=batch.column(3), slack=[len(s) - prefix_length(len(s)) for s in sets], tokens=sets)

    places = nodes.select("node", "comp", "copies", F.lit(1).alias("k"), F.lit(0).alias("g"), "place")
    sets = fetch(docs, wanted_places(places, "jaccard-large"))
    whole = persist(sets.mapInArrow(run, "node long, slack int, tokens array<long>"), "jaccard-whole")
    return candidate_components(persist(postings(whole), "jaccard-postings"))


def _dense(rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    out[rows, cols] = 1
    return out


def block_links(sets: list[np.ndarray], link: int = LINK, members: int = MEMBERS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of sorted token sets with 100 |i & j| >= link |i or j|."""
    none = np.zeros(0, np.int64)
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return none, none
    if len(sets) <= 6:
        found = []
        for i in range(len(sets)):
            for j in range(i):
                least, most = sorted((n[i], n[j]))
                if 100 * least >= link * most:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= link * (n[i] + n[j] - common):
                        found.append((i, j))
        a, b = zip(*found) if found else ((), ())
        return np.array(a, np.int64), np.array(b, np.int64)
    # tokens that two sets hold, numbered; the others overlap with nothing
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, token, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    on = shared[token]
    token, owner = number[token[on]], owner[on]
    width = int(shared.sum())
    # similar sets next to each other: by their least shared token, then by size
    least = np.full(len(sets), width)
    np.minimum.at(least, owner, token)
    order = np.lexsort((n, least))
    place = np.empty(len(sets), np.int64)
    place[order] = np.arange(len(sets))
    owner, size = place[owner], n[order]
    groups = -(-len(sets) // members)
    of = np.arange(len(sets)) // members
    pairs = np.unique(of[owner] * width + token)
    group_of, group_token = pairs // width, pairs % width
    bound = np.zeros((len(sets), groups), np.float32)
    by, gby = np.argsort(token, kind="stable"), np.argsort(group_token, kind="stable")
    t, o, gt, go = token[by], owner[by], group_token[gby], group_of[gby]
    for at in range(0, width, CHUNK):
        lo, hi = np.searchsorted(t, [at, at + CHUNK])
        glo, ghi = np.searchsorted(gt, [at, at + CHUNK])
        wide = min(CHUNK, width - at)
        bound += _dense(o[lo:hi], t[lo:hi] - at, (len(sets), wide)) @ _dense(gt[glo:ghi] - at, go[glo:ghi], (wide, groups))
    starts = np.arange(groups) * members
    low, high = np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
    open_ = (100 * bound >= link * size[:, None]) & (100 * high[None, :] >= link * size[:, None]) & (100 * size[:, None] >= link * low[None, :])
    by_owner = np.argsort(owner, kind="stable")
    token, owner = token[by_owner], owner[by_owner]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    own_groups = np.searchsorted(group_of, np.arange(groups + 1))
    out_i, out_j = [], []
    for g in range(groups):
        start, end = g * members, min(len(sets), (g + 1) * members)
        asked = np.flatnonzero(open_[:, g])
        asked = asked[asked > start]  # each pair from its later set
        if not len(asked):
            continue
        union = group_token[own_groups[g] : own_groups[g + 1]]
        lengths = first[asked + 1] - first[asked]
        where = np.repeat(first[asked] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        cols = np.searchsorted(union, token[where])
        cols[cols == len(union)] = 0
        hit = union[cols] == token[where] if len(union) else np.zeros(0, bool)
        left = _dense(np.repeat(np.arange(len(asked)), lengths)[hit], cols[hit], (len(asked), len(union)))
        span = slice(first[start], first[end])
        right = _dense(owner[span] - start, np.searchsorted(union, token[span]), (end - start, len(union)))
        common = left @ right.T
        ok = 100 * common >= link * (size[asked][:, None] + size[None, start:end] - common)
        ok &= asked[:, None] > np.arange(start, end)[None, :]
        i, j = np.nonzero(ok)
        out_i.append(asked[i])
        out_j.append(j + start)
    if not out_i:
        return none, none
    return order[np.concatenate(out_i)], order[np.concatenate(out_j)]


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    parent = list(range(count))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(count)]


LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _linked(nodes: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Nodes with links: the first node they reach here, and how many other
    documents they link to here."""
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    roots = np.array(_roots(len(nodes), i, j))
    on = np.flatnonzero(links)
    return table_of(LINKS, nodes[on], nodes[roots[on]], links[on])


GROUPS_DDL = "node long, root long, links long, comp long, g int, least long, most long, file string"


def score_group(folder: str):
    """Links inside a group; a group of several is stored, its token union apart, and
    named in a row without a node. Names are unique to the attempt."""

    def score(block: pa.Table) -> pa.Table:
        claim()
        block = block.sort_by("node")
        nodes, copies = block["node"].to_numpy(), block["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in block["tokens"].to_pylist()]
        found = _linked(nodes, copies, *block_links(sets))
        comp, g, file, n = block["comp"][0].as_py(), block["g"][0].as_py(), None, np.array([len(x) for x in sets])
        if block["k"][0].as_py() > 1:
            file, flat = f"{folder}/{uuid.uuid4().hex}", np.concatenate(sets)
            for kind, arrays in (("union", {"union": np.unique(flat)}), ("sets", {"nodes": nodes, "copies": copies, "n": n, "flat": flat})):
                data = io.BytesIO()
                np.savez(data, **arrays)
                out = AtomicFile(f"{file}.{kind}.npz")
                out.write(data.getvalue())
                out.close()
        rows = found.num_rows
        none = pa.nulls(rows + 1, pa.int64())
        where = [pa.array([None] * rows + [x], t) for x, t in ((comp, pa.int64()), (g, pa.int32()), (int(n.min()), pa.int64()), (int(n.max()), pa.int64()), (file, pa.string()))]
        own = [pa.concat_arrays([found[c].combine_chunks(), none[:1]]) for c in LINKS.names]
        return pa.table([*own, *where], names=[*LINKS.names, "comp", "g", "least", "most", "file"])

    return score


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Links across two stored groups of a component, for rows (a, b, need): their files,
    and the least size of a set in them, of which a link needs LINK hundredths in common."""

    def read(file: str, kind: str):
        fs, path = open_fs(f"{file}.{kind}.npz")
        with fs.open_input_file(path) as f:
            return np.load(io.BytesIO(f.read()))

    def run(batches):
        claim()
        for batch in batches:
            for a, b, need in zip(*(c.to_pylist() for c in batch.columns)):
                if 100 * len(np.intersect1d(read(a, "union")["union"], read(b, "union")["union"], assume_unique=True)) < LINK * need:
                    continue
                left, right = read(a, "sets"), read(b, "sets")
                nodes, copies = np.concatenate([left["nodes"], right["nodes"]]), np.concatenate([left["copies"], right["copies"]])
                sets = [s for x in (left, right) for s in np.split(x["flat"], np.cumsum(x["n"])[:-1])]
                i, j = block_links(sets)
                cross = (i < len(left["n"])) != (j < len(left["n"]))
                yield from _linked(nodes, copies, i[cross], j[cross]).to_batches()

    return pairs.select("a", "b", "need").mapInArrow(run, "node long, root long, links long")


def table_of(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def jaccard_components(docs: DataFrame, places: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of ``docs``.

    ``component_id`` is the least doc_id reachable over links, ``n_links`` the
    number of other rows a row links to. Null or blank texts have empty sets and
    link with nothing. A null doc_id keeps its row and takes part, but never names
    a component. Rows with equal ids stay apart. Other columns are ignored.
    ``places`` adds each row's place in the scan (pid, idx) and class_id, the
    component's own key.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signs = persist(sign(rows), "jaccard-signs")
    narrow = signs.select("pid", "idx", "doc_id", "n", "node", "low")
    posts = persist(postings(signs), "jaccard-postings")
    found = candidate_components(posts)

    classes = persist(narrow.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("pid", "idx")).alias("place"), F.max("n").alias("n"), F.max("low").alias("low")), "jaccard-classes")
    wanted = persist(classes.join(found, "node").select("node", "comp", "copies", "n", "low", "place"), "jaccard-wanted-nodes")
    large = persist(wanted.groupBy("comp").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP_TOKENS).select("comp"), "jaccard-large-components")
    if not large.isEmpty():
        again = whole_components(rows, wanted.join(large, "comp", "left_semi"))
        parts = wanted.drop("comp").join(again, "node").select(*wanted.columns)
        wanted = persist(wanted.join(large, "comp", "left_anti").unionByName(parts), "jaccard-wanted-nodes")
    cells = wanted.groupBy("comp", "low").agg(F.sum("n").alias("n"))
    sizes = cells.groupBy("comp").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("int").alias("k"))
    # where one least token is held by too many, its nodes are dealt on to groups of their own
    crowded = cells.filter(F.col("n") > GROUP_TOKENS).select("comp", "low", F.ceil(F.col("n") / GROUP_TOKENS).cast("int").alias("parts"))
    met = wanted.join(sizes.filter("k > 1"), "comp", "left").join(crowded, ["comp", "low"], "left")
    k = F.coalesce("k", F.lit(1))
    g = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("low"), k)).otherwise(F.pmod(F.xxhash64("low", F.pmod(F.xxhash64("node"), F.col("parts"))), F.lit(1 << 30)) + k)
    folder = wanted_places(met.select("node", "comp", "copies", k.alias("k"), g.cast("int").alias("g"), "place"), "jaccard-wanted")

    groups = shared_dir(spark, "jaccard-groups")
    scored = persist(fetch(rows, folder).groupBy("comp", "g").applyInArrow(score_group(groups), GROUPS_DDL), "jaccard-links")
    inside = scored.filter("node is not null").select("node", "root", "links")
    stored = scored.filter("file is not null")
    side = lambda x: stored.select("comp", *[F.col(c).alias(f"{c}_{x}") for c in ("g", "least", "most", "file")])
    # pairs of stored groups, never of documents; a set of one must be within LINK hundredths of one of the other
    fits = (F.col("g_a") < F.col("g_b")) & (100 * F.col("most_a") >= LINK * F.col("least_b")) & (100 * F.col("most_b") >= LINK * F.col("least_a"))
    pairs = side("a").join(side("b"), "comp").filter(fits).select(F.col("file_a").alias("a"), F.col("file_b").alias("b"), F.greatest("least_a", "least_b").alias("need"))
    pairs = persist(pairs, "jaccard-pairs")
    tasks = max(1, min(pairs.count(), 10_000))  # few rows, much work: as many tasks as pairs
    across = persist(score_pairs(pairs.repartition(tasks, "a", "b")), "jaccard-links")
    links = inside.unionByName(across)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-links")

    linked = classes.join(reached, "node").select("node", "comp", "first")
    least = linked.groupBy("comp").agg(F.min("first").alias("least"))
    named = linked.join(least, "comp").select("node", "comp", "least").join(degree, "node", "left")
    known = classes.join(named, "node", "left").select("node", F.coalesce("comp", "node").alias("class_id"), F.coalesce("least", "first").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = narrow.join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    return out.select(*columns, *(["pid", "idx", "class_id"] if places else []))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: that of least doc_id, with its own
    columns. Of repeated least ids the row that is scanned first stays; rows with
    null ids stay only where their component has no other; empty texts all stay.
    The rows are met by their place in a second scan, which fails if the ids found there
    differ: ``docs`` must be a table or another frame that reads the same twice.
    """
    spark = docs.sparkSession
    found = jaccard_components(docs, places=True)
    # the place of each component's first row; texts without words are their own
    grouped = found.filter("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pid", "idx")).alias("best"))
    kept = grouped.select("best.pid", "best.idx", "best.doc_id").union(found.filter("n_shingles = 0").select("pid", "idx", "doc_id"))
    folder = shared_dir(spark, "jaccard-kept")
    kept.repartition("pid").write.partitionBy("pid").parquet(folder)
    where = docs.columns.index("doc_id")

    def run(batches):
        claim()
        fs, path = open_fs(f"{folder}/pid={TaskContext.get().partitionId()}")
        from pyarrow.fs import FileSelector

        keep, at = {}, 0
        for info in fs.get_file_info(FileSelector(path, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    kept_here = pq.ParquetFile(f).read()
                    keep.update(zip(kept_here["idx"].to_pylist(), kept_here["doc_id"].to_pylist()))
        for batch in batches:
            ids = batch.column(where).cast(pa.int64()).to_pylist()
            mask = [at + i in keep for i in range(batch.num_rows)]
            if any(m and keep.pop(at + i) != ids[i] for i, m in enumerate(mask)):
                raise RuntimeError("the input changed between two scans")
            at += batch.num_rows
            yield batch.filter(pa.array(mask, pa.bool_()))
        if keep:
            raise RuntimeError("the input changed between two scans")

    return docs.mapInArrow(run, docs.schema)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, over all whole texts."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))
