"""Near-duplicate classes by DartMinHash.

A text is the multiset of its five-word shingles; similarity is the weighted Jaccard similarity (sum of the
smaller counts over sum of the larger). The n-th copy of a shingle is a region of unit weight. Hashed darts
fall on each region at the ranks of a Poisson process and each lands on one of ``COORDINATES`` coordinates;
the earliest dart of a coordinate is its signature. Darts are thrown up to a rank that fills nearly all
coordinates, then further for those texts that still have empty ones, so the work is in proportion to the
shingles plus the darts, not to their product. ``BANDS`` bands of eight coordinates each are joined: a pair at
similarity 0.8 meets in some band with probability 0.997, one at 0.85 with 0.9999.

Equal word sequences are one text with one class, joined back to all documents, so copies are never paired.
Texts that meet in a band form a group (the component of star links, found by Spark joins). Inside a group
every pair that shares a band is compared exactly, unless it is already in one class: groups are cut into
blocks of about ``BLOCK`` shingles, each pair of blocks is a task's work, and each returns links that span its
classes rather than pairs. No candidate is dropped. A last component search over the verified links gives
the classes. A text is copied once for each block of its own group.

Defined cases: a text of fewer than five words has one shingle, all its words; texts without words are in one
class only with equal texts (null is not equal to the empty text); the class id is the least doc_id of the
class; repeated rows are in one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import MEMO, Memo, fields, hash_word, map_batches, mix, text_digest, word_hashes, words
from passagework.session import written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8
COORDINATES = BANDS * ROWS
BLOCK = 500_000
#: Darts and regions that are held at a time.
CELLS = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def regions(hashes: np.ndarray) -> np.ndarray:
    """One sorted unsigned number for each copy of each shingle of a text."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(SHINGLE, n)
    h = np.zeros(n - size + 1, dtype=np.uint64)
    for o in range(size):
        h = h * GOLDEN + hashes[o : n - size + 1 + o]
    h = np.sort(mix(h))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    copy = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(mix(h + copy.astype(np.uint64) * GOLDEN))


def signatures(units: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, one row for each text; all texts must have regions."""
    out = np.zeros((len(units), k), dtype=np.uint64)
    sizes = np.array([len(u) for u in units])
    scale = np.log2(sizes).astype(int)
    for s in np.unique(scale):  # texts of like sizes throw alike numbers of darts for each region
        todo, reach = np.flatnonzero(scale == s), np.log(k) + 3.0
        while len(todo):
            step = max(1, CELLS // int(k * reach + 3 * 2.0 ** (s + 1)))
            left = []
            for part in (todo[i : i + step] for i in range(0, len(todo), step)):
                dart, full = _throw([units[i] for i in part], reach, k)
                out[part[full]] = dart[full]
                left.append(part[~full])
            todo, reach = np.concatenate(left), reach * 2
    return out


def _throw(units: list[np.ndarray], reach: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Darts up to the rank at which ``reach * k`` have fallen on a text, and whether they fill its coordinates."""
    sizes = np.array([len(u) for u in units])
    text, unit = np.repeat(np.arange(len(units)), sizes), np.concatenate(units)
    limit = reach / sizes
    rank = np.full(len(units) * k, np.inf)
    dart = np.zeros(len(units) * k, dtype=np.uint64)
    base, thrown = np.zeros(len(unit)), 0
    m = int(np.ceil(k * limit.max())) + 2
    while len(unit):
        numbers = np.arange(thrown + 1, thrown + m + 1).astype(np.uint64) * GOLDEN
        h = mix(unit[:, None] + numbers)
        ahead = base[:, None] + np.cumsum(np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / -k, axis=1)
        inside = ahead <= limit[text][:, None]
        fallen = mix(h[inside])
        cell = np.repeat(text, inside.sum(axis=1)) * k + (fallen % np.uint64(k)).astype(np.int64)
        at = ahead[inside]
        np.minimum.at(rank, cell, at)
        first = at == rank[cell]
        dart[cell[first]] = fallen[first]
        more = inside[:, -1]
        base, unit, text, thrown, m = ahead[more, -1], unit[more], text[more], thrown + m, 4
    return dart.reshape(-1, k), ~np.isinf(rank).reshape(-1, k).any(axis=1)


def bands_of(dart: np.ndarray) -> np.ndarray:
    """One number for each band of each text."""
    parts = dart.reshape(len(dart), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(dart), 1))
    for r in range(ROWS):
        h = mix(h * GOLDEN + parts[:, :, r])
    return h.view(np.int64)


def signed(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id``, the text's own digest, ``key`` of its words, ``size`` in shingles and ``bands`` (none without words)."""
    asked = documents.select(documents[doc_id].alias("doc_id"), text_digest(documents[text]).alias("digest"), documents[text].alias("__text"))
    schema = T.StructType([*fields(asked, "doc_id", "digest"), T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    memo = Memo(hash_word)
    known: dict[bytes, list] = {}

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            keys, sizes, new = [], [], {}
            for t, digest in zip(part.column("__text").to_pylist(), part.column("digest").to_pylist(), strict=True):
                found = words(t)
                sizes.append(max(len(found) - SHINGLE + 1, 1))
                keys.append(xxhash.xxh128_digest(" ".join(found).encode("utf-8", "surrogatepass")) if found else b"=" + digest)
                if found and keys[-1] not in known and keys[-1] not in new:
                    new[keys[-1]] = regions(np.fromiter(map(memo.__getitem__, found), dtype=np.uint64, count=len(found)))
            if len(known) > MEMO // 40:
                kept = {k: known[k] for k in keys if k in known}
                known.clear()
                known.update(kept)
            if new:
                known.update(zip(new, bands_of(signatures(list(new.values()))), strict=True))
            memo.trim()
            bands = pa.array([known.get(k) for k in keys], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), bands], names=schema.fieldNames())

    return map_batches(asked, run, schema)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root``: every node of ``edges`` (a, b) with the least node of its component.

    Each round gives every node the least root among its own and its neighbours', then follows the roots'
    own roots, so long chains take a logarithmic number of rounds.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    for _ in range(most):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = written(moved.join(jump, "root").select("node", "before", F.least("root", "further").alias("root")), "roots")
        changed = moved.where(F.col("before") != F.col("root")).limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("components did not settle")


class Links:
    """Union of positions by verified links."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, js: np.ndarray) -> None:
        roots = np.unique(self.of[np.append(js, i)])
        self.of[np.isin(self.of, roots)] = roots[0]


def spanning_links(units: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links at SIMILARITY or more between ``left`` and ``right`` positions that share a band, enough to span the classes."""
    sizes = np.array([len(u) for u in units])
    _, local = np.unique(np.concatenate(units), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(local.max()) + 1, dtype=bool)
    links = Links(len(units))
    within = np.array_equal(left, right)
    for i in left:
        others = right[right > i] if within else right
        others = others[links.of[others] != links.of[i]]
        others = others[(bands[others] == bands[i]).any(axis=1)]
        near = np.minimum(sizes[others], sizes[i]) >= SIMILARITY * np.maximum(sizes[others], sizes[i])
        others, step = others[near], 4
        if not len(others):
            continue
        mark[local[ends[i] - sizes[i] : ends[i]]] = True
        while len(others):
            now, others = others[:step], others[step:]
            step *= 4
            at = np.repeat(ends[now] - np.cumsum(sizes[now]), sizes[now]) + np.arange(sizes[now].sum())
            common = np.add.reduceat(mark[local[at]].astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
            linked = now[common >= SIMILARITY * (sizes[now] + sizes[i] - common) - 1e-9]
            if len(linked):
                for j in linked:
                    if links.of[j] != links.of[i]:
                        links.join(i, np.array([j]))
                        yield int(i), int(j)
                others = others[links.of[others] != links.of[i]]
        mark[local[ends[i] - sizes[i] : ends[i]]] = False


def verified(members: DataFrame) -> DataFrame:
    """``a, b``: verified links between texts. ``members``: id, text, bands, root, block, low, high; one row for each block pair."""
    memo = Memo(hash_word)

    def check(table: pa.Table) -> pa.Table:
        seen: dict[int, int] = {}
        for n, i in enumerate(table.column("id").to_pylist()):
            seen.setdefault(i, n)
        table = table.take(pa.array(seen.values(), pa.int64()))
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        units = [regions(word_hashes(t.as_py(), memo)) for t in table.column("text")]
        memo.trim()
        bands = np.array(table.column("bands").to_pylist(), dtype=np.int64).reshape(-1, BANDS)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        found = np.array(list(spanning_links(units, bands, np.flatnonzero(block == low), np.flatnonzero(block == high))), dtype=np.int64).reshape(-1, 2)
        return pa.table([ids[found[:, 0]], ids[found[:, 1]]], names=["a", "b"])

    return members.groupBy("root", "low", "high").applyInArrow(check, "a long, b long")


def classes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, digest, class_id, copies, first``: every row with its class and the number of rows with its words.

    ``first`` is true for rows equal to the one row (doc_id, digest) that stands for the class: the least, rows
    without doc_id last.
    """
    rows = written(signed(documents, text, doc_id), "dart-rows")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    one = F.min(row).alias("one")
    distinct = rows.groupBy("key").agg(one, F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    texts = written(distinct.withColumn("id", F.monotonically_increasing_id()), "dart-texts")

    spread = texts.where("bands is not null").select("id", F.explode("bands").alias("band"))
    leads = spread.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    #: A text and the leads it meets hang on the least of them: as many links as texts and different leads, not as bands.
    #: Spark takes an exploded list for one entry a row, so either side might be broadcast at any number of texts: sorted and merged instead.
    met = spread.join(leads.hint("merge"), "band").where("id != lead").groupBy("id").agg(F.min("lead").alias("b"), F.collect_set("lead").alias("leads"))
    hung = met.select(F.explode(F.array_append("leads", F.col("id"))).alias("a"), "b").where("a != b")
    stars = written(hung.distinct(), "dart-stars")
    groups = components(stars).withColumnRenamed("node", "id")

    asked = written(texts.join(groups, "id").select("id", "one", "size", "bands", "root"), "dart-groups")
    blocks = asked.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    asked = asked.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    docs = documents.select(documents[doc_id].alias("doc_id"), text_digest(documents[text]).alias("digest"), documents[text].alias("text")).select(row.alias("one"), "text")
    held = docs.join(asked.hint("shuffle_hash"), docs["one"].eqNullSafe(asked["one"]))
    held = held.select("id", "bands", "text", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = held.select("id", "bands", "text", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    links = written(verified(pairs), "dart-links")

    classed = texts.select("id", "key", "one", "copies").join(components(links).withColumnRenamed("node", "id"), "id", "left")
    classed = written(classed.withColumn("root", F.coalesce("root", "id")), "dart-roots")
    stands = classed.groupBy("root").agg(F.min("one").alias("stands"))
    whole = written(classed.join(stands, "root").select("key", "copies", "stands"), "dart-classes")
    return (
        rows.select("doc_id", "digest", "key")
        .join(whole, "key")
        .select("doc_id", "digest", F.col("stands.doc_id").alias("class_id"), "copies", row.eqNullSafe(F.col("stands")).alias("first"))
    )


def deduplicate(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``documents`` with one row of each class: the row with the least doc_id; of equal rows any one."""
    stands = classes(documents, text, doc_id).where("first").select("doc_id", "digest").distinct()
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("__name")
    kept = stands.select(F.col("doc_id").isNull().alias("__unnamed"), name(F.col("doc_id")), F.col("digest").alias("__digest"))
    rows = documents.select("*", documents[doc_id].isNull().alias("__unnamed"), name(documents[doc_id]), text_digest(documents[text]).alias("__digest"))
    key = ["__unnamed", "__name", "__digest"]
    one = rows.join(kept.hint("shuffle_hash"), key).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
    return one.where("__n = 1").select(*documents.columns)
