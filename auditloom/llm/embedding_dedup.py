"""Near-duplicate vectors by cross-polytope hashing."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import connected_components, stash

#: Vectors of a bucket that one task compares at once; larger buckets are dealt out in pairs of such blocks.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def cross_polytope(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """(n, 1 + probes): the nearest vertices of a cross-polytope after three rounds of random signs and a Hadamard
    transform, nearest first. Vertex 2i or 2i + 1 is the i-th axis, in its direction or against it."""
    rng = np.random.default_rng(seed)
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    size = np.abs(y)
    k = min(1 + probes, d)
    near = np.argsort(-size, axis=1, kind="stable")[:, :k]
    return 2 * near + (np.take_along_axis(y, near, 1) < 0)


def bucket_keys(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(n, 1 + probes): the bucket of a table, from `hashes` vertices, then those reached by giving one of them
    its second nearest vertex, in the order of what that costs least; distinct by construction."""
    vertices = np.stack([cross_polytope(x, 1000 * table + k, 1) for k in range(hashes)], axis=1)
    width = 2 << max(1, (x.shape[1] - 1).bit_length())
    powers = width ** np.arange(hashes, dtype=np.int64)
    own = (vertices[:, :, 0] * powers).sum(1)
    keys = [own] + [own + (vertices[:, k, 1] - vertices[:, k, 0]) * powers[k] for k in range(min(probes, hashes))]
    return np.stack(keys, axis=1)


def _lists(column: pa.Array, kind: type) -> np.ndarray:
    """A list column whose lists are of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither huge nor tiny numbers over- or underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash_rows(tables: int, hashes: int, probes: int):
    """For each vector one row per bucket that it enters, with all of its buckets, for later comparison."""
    schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("d", pa.int32()), ("keys", pa.list_(pa.int64())), ("tab", pa.int32()), ("bucket", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                x = unit(_lists(part.column(2), np.float64))
                keys = np.stack([bucket_keys(x, t, hashes, probes) for t in range(tables)], axis=1)
                n, t, p = keys.shape
                take = pa.array(np.repeat(np.arange(n), t * p))
                whole = pa.array(list(keys.reshape(n, t * p)), pa.list_(pa.int64()))
                dim = pa.array(np.full(len(take), d, np.int32))
                tab = pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), dim, whole.take(take), tab, pa.array(keys.reshape(-1))], schema=schema)

    return run, "node bigint, label string, d int, keys array<bigint>, tab int, bucket bigint"


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of keys (m, tables, 1 + probes): the first table in which one's own bucket is among the
    other's, and the least such bucket there. A pair is counted in that bucket alone."""
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    top = np.iinfo(np.int64).max
    in_b = np.where((b == own_a[:, :, None]).any(2), own_a, top)
    in_a = np.where((a == own_b[:, :, None]).any(2), own_b, top)
    least = np.minimum(in_a, in_b)
    table = (least < top).argmax(1)
    return table, least[np.arange(len(a)), table]


class _Links:
    """Counts and a forest of the links of one run of groups."""

    def __init__(self, node: np.ndarray, copies: np.ndarray):
        self.node, self.copies = node, copies
        self.counts, self.root, self.edges = np.zeros(len(node), np.int64), list(range(len(node))), []

    def _top(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.counts, p, self.copies[q])
        np.add.at(self.counts, q, self.copies[p])
        for m, n in zip(p.tolist(), q.tolist(), strict=True):
            m, n = self._top(m), self._top(n)
            if m != n:
                self.root[max(m, n)] = min(m, n)
                self.edges.append((self.node[m], self.node[n]))

    def batch(self) -> pa.RecordBatch:
        hit = np.flatnonzero(self.counts)
        ends = np.array(self.edges, np.int64).reshape(-1, 2)
        own = self.node[hit]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, ends[:, 0]])), pa.array(np.concatenate([own, ends[:, 1]])), pa.array(np.concatenate([self.counts[hit], np.zeros(len(ends), np.int64)]))], ["a", "b", "n"])


def _candidates(starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within each group [start, end): one member of its first block, one of its second (of
    the same block: each pair once). At most some 100,000 at a time."""
    left, right, size = [], [], 0
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        rows, cols = np.flatnonzero(one[lo:hi]) + lo, np.flatnonzero(two[lo:hi]) + lo
        same = len(rows) == len(cols) and (rows == cols).all()
        for k, row in enumerate(rows.tolist()):
            partners = cols[k + 1 :] if same else cols
            left.append(np.full(len(partners), row))
            right.append(partners)
            size += len(partners)
            if size > 100_000:
                yield np.concatenate(left), np.concatenate(right)
                left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _compare(tables: int, threshold: float):
    """Rows arrive sorted by bucket and pair of blocks; each such group, of two blocks at most, is verified by exact
    cosines. Results: per vector the copies that it links to, and a forest over the links, from which
    their components follow. A group that a batch cuts is carried over to the next."""

    def groups(table: pa.Table) -> np.ndarray:
        """Where a new group starts."""
        changed = np.zeros(len(table), bool)
        changed[:1] = True
        for name in ("label", "tab", "bucket", "d", "i", "j"):
            v = table.column(name).to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(changed)

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = table.column("d").to_numpy()
        for d in np.unique(dims):
            part = table.take(pa.array(np.flatnonzero(dims == d))).combine_chunks()
            get = {n: part.column(n).to_numpy() for n in ("node", "copies", "block", "i", "j", "tab", "bucket")}
            x = unit(_lists(part.column("vector").combine_chunks(), np.float64))
            keys = _lists(part.column("keys").combine_chunks(), np.int64).reshape(len(part), tables, -1)
            starts = groups(part)
            links = _Links(get["node"], get["copies"])
            for p, q in _candidates(starts, np.append(starts[1:], len(part)), get["block"] == get["i"], get["block"] == get["j"]):
                close = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[close], q[close]
                apart = get["node"][p] != get["node"][q]
                p, q = p[apart], q[apart]
                if len(p):
                    first, where = _first_meeting(keys[p], keys[q])
                    mine = (first == get["tab"][p]) & (where == get["bucket"][p])
                    links.add(p[mine], q[mine])
            yield links.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            last = int(groups(table)[-1]) if len(table) else 0
            if last:
                yield from verify(table.slice(0, last))
            held = table.slice(last)
        if held is not None and len(held):
            yield from verify(held)

    return run, "a bigint, b bigint, n bigint"


def link_vectors(vectors: DataFrame, threshold: float = 0.98, tables: int = 8, hashes: int = 2, probes: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (smallest id that links
    reach, its own included) and kept (the row is its component's one with that id).

    Rows link if their labels are equal and not null, their lengths are equal and their cosine, in double
    precision, is at least threshold. Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing. Identical vectors of a label become one node with a count, so a vector that is everywhere costs
    no more than any other; a component whose ids are all null has a null component_id. Rows that repeat an id
    are rows of their own; of several with the component's id all are kept. Columns besides these three are
    ignored; an empty table gives an empty result.

    Each table buckets the nodes by `hashes` cross-polytope hashes of the rotated vector; a node also enters the
    buckets of its `probes` nearest alternatives. A pair meets if one's own bucket is among the other's. At
    cosine 0.98 a pair is missed by all tables about once in a thousand cases or less (see the tests). Buckets
    beyond `block` nodes are compared block by block in tasks of their own; every pair is compared.
    """
    v = F.col("_vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("_label").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).cast("array<double>").alias("_vector"))
    rows = rows.select("_id", "_label", "_vector", usable.alias("_usable"))
    whole = F.transform("_vector", lambda x: x + 0.0)  # -0.0 as 0.0
    rows = stash(rows.select("_id", "_usable", F.when(F.col("_usable"), F.col("_label")).alias("_label"), F.when(F.col("_usable"), whole).alias("_vector")), "vectors")
    named = F.sha2(F.concat_ws(",", F.lit("v"), F.col("_label"), F.col("_vector").cast("string")), 256)
    rows = rows.withColumn("_name", F.when(F.col("_usable"), named))
    nodes = rows.where("_usable").groupBy("_name").agg(F.first("_label").alias("label"), F.first("_vector").alias("vector"), F.count("*").alias("copies"), F.min("_id").alias("least"))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    run, schema = _hash_rows(tables, hashes, probes)
    hashed = stash(nodes.select("node", "label", "vector").mapInArrow(run, schema), "hashed")
    bucket = ["label", "tab", "bucket", "d"]
    met = hashed.groupBy(*bucket).agg(F.count("*").alias("met")).where("met > 1").select(*bucket, F.ceil(F.col("met") / block).cast("int").alias("blocks"))
    inside = hashed.join(met, bucket).join(nodes.select("node", "copies", "vector"), "node")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    group = [*bucket, "i", "j"]
    dealt = inside.withColumn("pair", F.explode(pairs)).select(*bucket, "pair.i", "pair.j", "node", "vector", "keys", "copies", "block")
    run, schema = _compare(tables, threshold)
    links = stash(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema), "links")
    counts = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    comps = connected_components(links.where("a <> b").select("a", "b"))
    placed = nodes.select("_name", "node", "copies", "least").join(comps, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stash(placed, "placed")
    ends = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    told = placed.join(ends, "component").select("_name", F.col("component_id").alias("_component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("_links"))
    final = rows.select("_id", "_usable", "_name").join(told, "_name", "left")
    component = F.when(F.col("_usable"), F.col("_component")).otherwise(F.col("_id"))
    return final.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
