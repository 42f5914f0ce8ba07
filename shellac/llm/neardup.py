"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

Each distinct shingle set gets SYMBOLS b-bit MinHash symbols. A pair of Jaccard similarity j differs in a
Binomial(SYMBOLS, 1 - j) number of them, so `distance_bound` gives the distance that a linked pair exceeds with a
chance of at most MISS. The signature is cut into so many chunks that, by the pigeonhole principle, two signatures
within that distance differ in at most one symbol of some chunk; leaving out each symbol of each chunk in turn
enumerates that one allowed error, so every pair within the distance shares a key. Candidates within the distance,
and within the bound of CHECKS more symbols, are then confirmed on their full shingle sets.

Members of one key are not expanded into all pairs at once: three rounds compare them with one hub each, and only
those that are still in different components are then compared with each other, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm import groups, shingles
from shellac.llm.components import components
from shellac.llm.scratch import semi_join, small_batches, with_position, written

#: Symbols of a signature, two bytes each, and the chance that a pair right at the threshold is missed.
SYMBOLS = 64
MISS = 1e-4
#: Further symbols, one byte each, that sharpen the distance of candidates before their sets are fetched.
CHECKS = 384
#: Hub rounds: the hub of a key is its member of least `node xor salt`.
HUB_SALTS = (0, 0x2B99_2DDF_A232_49D6, 0x5851_F42D_4C95_7F2D)
#: Groups over which the pairs of one hub are dealt.
PARTS_OF_HUB = 64
#: Candidate pairs compared at once in a task.
PAIRS_AT_ONCE = 100_000

_MULTIPLY = (shingles._odd_words("permute", SYMBOLS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (shingles._odd_words("shift", SYMBOLS) >> np.uint64(32)).astype(np.uint32)
_SYMBOL_WORDS = shingles._odd_words("symbol", SYMBOLS)
_CHECK_MULTIPLY = (shingles._odd_words("check", CHECKS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CHECK_ADD = (shingles._odd_words("check shift", CHECKS) >> np.uint64(32)).astype(np.uint32)


def distance_bound(percent: int, symbols: int = SYMBOLS) -> int:
    """Least r with P(Binomial(symbols, 1 - percent / 100) > r) <= MISS."""
    p = 1 - percent / 100
    below = 0.0
    for r in range(symbols + 1):
        below += math.comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
        if 1 - below <= MISS:
            return r
    return symbols


def chunk_edges(bound: int) -> list[int]:
    """Edges of the chunks: bound // chunks is 1, the error that the keys allow in a chunk."""
    count = min(bound // 2 + 1, SYMBOLS // 2)
    return [round(i * SYMBOLS / count) for i in range(count + 1)]


def _least(hashes: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Each permutation's least hash of a non-empty set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (multiply[:, None] * short[None, at : at + 1024] + add[:, None]).min(axis=1), out=least)
    return least.astype(np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of a non-empty shingle set: a mix of each permutation's least hash."""
    return (shingles.mix64(_least(hashes, _MULTIPLY, _ADD) + _SYMBOL_WORDS) >> np.uint64(48)).astype(np.uint16)


def marks(hashes: np.ndarray) -> bytes:
    """The signature and CHECKS further 8-bit symbols."""
    checks = shingles.mix64(_least(hashes, _CHECK_MULTIPLY, _CHECK_ADD)) >> np.uint64(56)
    return signature(hashes).tobytes() + checks.astype(np.uint8).tobytes()


def keys_of(signatures: np.ndarray, edges: list[int]) -> np.ndarray:
    """SYMBOLS keys for each row of signatures: key j stands for j's chunk without symbol j."""
    spread = shingles.mix64(signatures.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(20)))
    spread *= _SYMBOL_WORDS
    out = np.empty(spread.shape, dtype=np.uint64)
    for low, high in zip(edges, edges[1:], strict=False):
        out[:, low:high] = spread[:, low:high].sum(axis=1, dtype=np.uint64)[:, None] - spread[:, low:high]
    return shingles.mix64(out + np.arange(SYMBOLS, dtype=np.uint64)).view(np.int64)


def _digests(hashes: np.ndarray) -> list[np.uint64]:
    """Two digests of a shingle set; equal sets, and with their size no others, have both equal."""
    return [shingles.mix64(hashes ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)]


def _signer(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches):
        for batch in batches:
            count = batch.num_rows
            sizes = np.zeros(count, dtype=np.int64)
            digests = np.zeros((2, count), dtype=np.uint64)
            signatures: list[bytes | None] = []
            for i, hashes in enumerate(shingles.shingle_sets(batch.column(1), words)):
                sizes[i] = len(hashes)
                if len(hashes):
                    digests[:, i] = _digests(hashes)
                    signatures.append(signature(hashes).tobytes())
                else:
                    signatures.append(None)
            columns = [batch.column(0), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in digests), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "d1", "d2", "sig"])

    return sign


def _shingler(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests, marks and hashes of the texts that have shingles."""

    def shingle(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for own, hashes in zip(ids, shingles.shingle_sets(batch.column(1), words), strict=True):
                if len(hashes):
                    rows.append((own, len(hashes), *(int(x.view(np.int64)) for x in _digests(hashes)), marks(hashes), hashes.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["id", "size", "d1", "d2", "marks", "hashes"])

    return shingle


def _as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), SYMBOLS)


def _as_marks(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and checks."""
    table = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), 2 * SYMBOLS + CHECKS)
    return np.ascontiguousarray(table[:, : 2 * SYMBOLS]).view(np.uint16), table[:, 2 * SYMBOLS :]


def _key_maker(edges: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = keys_of(_as_signatures(batch.column(1)), edges)
                nodes = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])

    return make


def _against_hubs(near: Callable[[np.ndarray, np.ndarray], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) whose payloads pass `near`, from rows (a, b, payload) in which each run of rows of one a starts with
    a's own, of null b. A run may go on over batches; only its first row is kept."""

    def compare(batches):
        hub, own = None, np.empty(0)
        for batch in batches:
            ends, others = batch.column(0).to_numpy(), batch.column(1)
            first = others.is_null().to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                payload = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8)
                if first[i]:
                    hub, own = ends[i], payload.copy()
                elif ends[i] == hub:
                    keep[i] = near(own, payload)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return compare


def _marks_near(bound: int, wide_bound: int) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Within the bounds of the signature and of all symbols."""

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        apart = np.count_nonzero(x[: 2 * SYMBOLS].view(np.uint16) != y[: 2 * SYMBOLS].view(np.uint16))
        return apart <= bound and apart + np.count_nonzero(x[2 * SYMBOLS :] != y[2 * SYMBOLS :]) <= wide_bound

    return near


def _sets_near(percent: int) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Similar enough, both sets in full."""

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        x, y = x.view(np.uint64), y.view(np.uint64)
        small, large = sorted((len(x), len(y)))
        if not large or 100 * small < percent * large:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return near


def _block_pairs(edges: list[int], bound: int, wide_bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a key in different components and within the bounds; a pair comes from the first key it shares."""

    def compare(batches):
        for table in groups.whole_groups(batches):
            signatures, checks = _as_marks(table["marks"])
            nodes, parts, keys = (table[c].to_numpy() for c in ("node", "component", "key"))
            for i, j in groups.pairs_in(table, PAIRS_AT_ONCE):
                other = parts[i] != parts[j]
                i, j = i[other], j[other]
                apart = (signatures[i] != signatures[j]).sum(axis=1)
                near = apart <= bound
                i, j, apart = i[near], j[near], apart[near]
                left = keys_of(signatures[i], edges)
                shared = (left == keys_of(signatures[j], edges)).argmax(axis=1)
                first = left[np.arange(len(i)), shared] == keys[i]
                i, j, apart = i[first], j[first], apart[first]
                near = apart + (checks[i] != checks[j]).sum(axis=1) <= wide_bound
                i, j = nodes[i[near]], nodes[j[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    return compare


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links, its own included) and kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their distinct `words`-word shingles
    (percent from 50 to 100); texts of fewer words count as one shingle, the whole sequence. Null texts and texts
    without words have no shingles and link with nothing. Equal sets always link. Rows that repeat an id count as
    one node with the links of all of them; rows with a null id link with nothing, are kept and have a null
    component_id. An empty table gives an empty result. Other columns of `docs` are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    small_batches(docs.sparkSession)
    bound, wide_bound = distance_bound(percent), distance_bound(percent, SYMBOLS + CHECKS)
    edges = chunk_edges(bound)
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    signed = written(source.mapInArrow(_signer(words), "id long, size long, d1 long, d2 long, sig binary"))
    of_set = ["d1", "d2", "size"]

    # texts with equal sets are one class and one node, for which its least id stands
    usable = signed.filter("size > 0 AND id IS NOT NULL")
    classes = usable.groupBy(*of_set).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.col("id")))
    # an id that several rows have may stand for several classes: these get numbers above all ids, and links to the id
    repeated = written(usable.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"))
    id_links: DataFrame | None = None
    if not repeated.isEmpty():
        most = usable.agg(F.max("id")).first()[0]
        others = with_position(semi_join(classes, repeated, "id"), ["id", *of_set], "place")
        others = others.withColumn("node", F.col("place") + F.lit(most) + 1).drop("place")
        classes = written(semi_join(classes, repeated, "id", "left_anti").unionByName(others))
        rows = semi_join(usable, repeated, "id").join(classes.select(*of_set, "node"), of_set)
        id_links = written(rows.select(F.col("node").alias("a"), F.col("id").alias("b")).distinct())

    keys = classes.select("node", "sig").mapInArrow(_key_maker(edges), "key long, node long")
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    members = written(keys.join(shared, "key"))

    # the sets of the classes that share a key, each from a row of the class's id
    involved = written(semi_join(classes.select("node", "id", *of_set), members.select("node").distinct(), "node"))
    texts = semi_join(source, involved.select("id").distinct(), "id")
    sets = texts.mapInArrow(_shingler(words), "id long, size long, d1 long, d2 long, marks binary, hashes binary")
    # merge joins here and below: broadcasts of so many keys would only fill the driver
    sets = sets.join(involved.hint("merge"), ["id", *of_set]).select("node", "marks", "hashes")
    sets = written(sets if id_links is None else sets.dropDuplicates(["node"]))

    def compared(pairs: DataFrame, column: str, near: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
        """The pairs (a, b) of which `column` of `sets` is near; a is the end that may have very many pairs. Each a's
        payload goes to at most PARTS_OF_HUB groups, to which its pairs are dealt, never to each pair."""
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS_OF_HUB)).cast("int"))
        payload = sets.select("node", F.col(column).alias("payload"))
        heads = dealt.select("a", "part").distinct().join(payload.withColumnRenamed("node", "a"), "a")
        heads = heads.select("a", F.lit(None).cast("long").alias("b"), "part", "payload")
        rows = heads.unionAll(dealt.join(payload.withColumnRenamed("node", "b"), "b").select("a", "b", "part", "payload"))
        rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "payload")
        return rows.mapInArrow(_against_hubs(near), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return compared(pairs, "hashes", _sets_near(percent))

    #: (node, component) as far as known, and all links found; without an entry a node is its own component
    parts: DataFrame | None = None
    links: list[DataFrame] = [] if id_links is None else [id_links]

    def whole_parts() -> DataFrame | None:
        """Components of all links so far."""
        every = None
        for found in links:
            every = found if every is None else every.unionAll(found)
        return None if every is None else written(components(every))

    def relabelled(found: DataFrame) -> DataFrame:
        """`parts` after one step: of the components that links join, the greater takes the name of the least it is
        linked with. What has one name is connected; the rest of the way is left to whole_parts."""
        joined = with_parts(with_parts(found, "a", "low"), "b", "high").filter("low != high")
        renamed = joined.groupBy(F.greatest("low", "high").alias("component")).agg(F.min(F.least("low", "high")).alias("name"))
        ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()
        known = ends.withColumn("component", F.col("node"))
        if parts is not None:
            known = parts.select("node", "component").unionAll(known.join(parts.select("node"), "node", "left_anti"))
        return written(known.join(renamed, "component", "left").select("node", F.coalesce("name", "component").alias("component")))

    def with_parts(table: DataFrame, node: str, name: str) -> DataFrame:
        if parts is None:
            return table.withColumn(name, F.col(node))
        own = parts.select(F.col("node").alias(node), F.col("component").alias("_own"))
        return table.join(own, node, "left").withColumn(name, F.coalesce("_own", node)).drop("_own")

    def mixed(table: DataFrame, salt: int) -> DataFrame:
        """Keys whose members are in more than one component, with a hub and its component."""
        least = F.min(F.struct(F.col("node").bitwiseXOR(F.lit(salt)).alias("hub"), F.col("component").alias("hub_component"))).alias("least")
        hubs = table.groupBy("key").agg(least, F.min("component").alias("low"), F.max("component").alias("high"))
        return hubs.filter("low < high").select("key", F.col("least.hub").bitwiseXOR(F.lit(salt)).alias("hub"), "least.hub_component")

    for salt in HUB_SALTS:
        placed = with_parts(members, "node", "component") if parts is None else written(with_parts(members, "node", "component"))
        star = placed.join(mixed(placed, salt).hint("merge"), "key").filter("component != hub_component")
        pairs = written(star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
        if pairs.isEmpty():  # the members of each key are in one component
            parts = None
            break
        near = written(compared(pairs, "marks", _marks_near(bound, wide_bound)))
        if not near.isEmpty():
            links.append(written(confirmed(near)))
            parts = relabelled(links[-1])
    else:
        parts = whole_parts()
        placed = with_parts(members, "node", "component")
        left_over = placed.join(mixed(placed, 0).select("key").hint("merge"), "key")
        columns = ["group", "block", "alone", "key", "node", "component", "marks"]
        blocks = groups.in_blocks(left_over, "key", "node", sets.select("node", "marks")).select(*columns)
        pairs = written(blocks.mapInArrow(_block_pairs(edges, bound, wide_bound), "a long, b long").distinct())
        if not pairs.isEmpty():
            # components stand for their links from here on
            links = [] if parts is None else [parts.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            links.append(confirmed(pairs))
            parts = None
    if parts is None:
        parts = whole_parts()
    merged = with_parts(classes.select(*of_set, "node", "copies"), "node", "component")
    merged = merged.filter("copies > 1 OR component != node").select(*of_set, "component")
    out = signed.select("id", *of_set).join(merged, of_set, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_column),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
