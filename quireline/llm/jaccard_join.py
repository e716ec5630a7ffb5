"""N-gram Jaccard join with a token-group matrix.

A text's set is its distinct k-word shingles, kept as sorted 64-bit hashes. Two texts link if 100 * |A n B| >= threshold * |A u B|.

1. Texts with equal sets are one class, found by a 128-bit digest of the set.
2. Similar classes are partitioned into groups: a class joins the group of the commonest of its keys, which are hashes of pairs of bin
   minima. Near copies, linked or not, fall into few groups; a class without a partner is a group of its own.
3. The token-group matrix holds, for each group, the union of its members' prefix tokens. In one order of all tokens, rare ones first, two
   sets that link share ``SHARED`` of the first ``n - ceil(t n) + SHARED`` tokens. Pairs of groups that share fewer are not looked at further.
4. Of the other pairs of groups (and within groups), blocks of members are opened against each other: a query is bounded by its overlap with
   the union of the block's tokens, and those that can reach the threshold are compared with the block by one product of incidence
   matrices. Of the links found, a spanning forest is returned.
5. Links make the components; a text's component is the smallest doc_id in it.

No link can be missed: every pair of classes is in one group or in a pair of groups, and steps 3 and 4 skip only what the bounds rule out. The
order of tokens comes from counts over all texts, by a remainder of the token; it changes how many groups are opened, never the result. A block's tasks
are fixed in size, whatever the size of a group, and a text travels once for each block that it is opened against.

Tables of sets, groups and links are written to the shared folder. Nothing is collected but bounded arrays: the counters of tokens, and a bit
map of wanted texts, whose false hits a join removes.

Null and empty texts have an empty set and link with nothing: their component is their own doc_id. With fewer than k words the whole sequence
is the one shingle. A null doc_id is part of its class, but never the smallest. Rows with one doc_id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import named
from quireline.llm.components import components
from quireline.llm.hashing import ngrams, nonspace_mask, word_rounds
from quireline.llm.storage import small_batches, written
from quireline.operators.contained import chunks_of, sum_of

#: Shared prefix tokens that a pair of groups needs; pairs of bin minima by which classes are grouped.
SHARED, BANDS = 4, 6
#: Counters of texts by the remainders of their tokens, which give the order of tokens.
COUNTERS = 1 << 21
#: Members of a block, columns of an incidence matrix, and most bits of the map of wanted texts.
BLOCK, COLUMNS, MAP_BITS = 1024, 2048, 1 << 28
#: Parts into which the rows of one key are dealt, and classes of a key from which those of its group are.
SALTS, HOT = 8, 1000


def _least(n, threshold: int):
    """Tokens that a set of n shares at least with any that it links to."""
    return (threshold * n + 99) // 100


def token_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles)."""
    for low, high, at, words in word_rounds(texts, nonspace_mask()):
        grams = ngrams(words, k)
        for row in range(low, high):
            a, b = int(at[row - low]), int(at[row - low + 1])
            yield row, (np.unique(grams[a : b - k + 1]) if b - a >= k else ngrams(words[a:b], b - a) if b > a else grams[:0])


def set_digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _band_keys(tokens: np.ndarray) -> list[int]:
    """Hashes of pairs of bin minima; bins are the tokens by their remainder, and pairs of empty bins give no key."""
    bins = (tokens % np.uint64(2 * BANDS)).astype(np.int64)
    first = np.full(2 * BANDS, -1)
    first[bins[::-1]] = np.arange(len(tokens))[::-1]
    low = [int(tokens[i]) if i >= 0 else 0 for i in first.tolist()]
    return [xxhash.xxh3_64_intdigest(f"{i},{low[i]},{low[i + BANDS]}".encode()) - (1 << 63) for i in range(BANDS) if low[i] or low[i + BANDS]]


def _prefix(tokens: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
    n = len(tokens)
    need = _least(n, threshold)
    order = np.argsort(counts[tokens % np.uint64(len(counts))], kind="stable")  # of equal counts the smaller token
    return tokens[order[: n - need + min(SHARED, need)]]


def _token_counts(texts: DataFrame, k: int) -> np.ndarray:
    """How many texts have tokens of each remainder by ``COUNTERS``: of all texts, added up by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = np.zeros(COUNTERS, np.uint32), [], 0
        for batch in batches:
            for _, tokens in token_sets(batch.column("text"), k):
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 18:
                    _count(out, held)
                    held, size = [], 0
        _count(out, held)
        yield from chunks_of(out)

    return sum_of(texts.select("text").mapInArrow(run, "chunk int, data binary"), COUNTERS)


def _count(out: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        place, n = np.unique((np.concatenate(sets) % np.uint64(len(out))).astype(np.uint32), return_counts=True)
        out[place] += n.astype(np.uint32)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the sets of few texts are held at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


_SKETCH = "tk long, n long, node binary, keys array<long>, prefix binary"


def _sketch(k: int, threshold: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for batch in _slices(batches):
            n, node, keys, prefix = [], [], [], []
            for _, tokens in token_sets(batch.column("text"), k):
                n.append(len(tokens))
                node.append(set_digest(tokens) if len(tokens) else None)
                keys.append(_band_keys(tokens) if len(tokens) else None)
                prefix.append(_prefix(tokens, held, threshold).tobytes() if len(tokens) else None)
            arrays = [*(batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(prefix, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(c for c in batch.schema.names if c != "text"), "n", "node", "keys", "prefix"])

    return run


def _salt(keyed: str = "keyed", node: str = "node") -> Column:
    """The part of a row of a group whose key has many classes; 0 elsewhere."""
    return F.when(F.col(keyed) > HOT, F.pmod(F.hash(node), F.lit(SALTS))).otherwise(0)


def _salts(keyed: str = "keyed") -> Column:
    """All parts that ``_salt`` may give: the other side of a join is there once for each."""
    return F.explode(F.when(F.col(keyed) > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def _grouped(nodes: DataFrame) -> DataFrame:
    """``nodes`` with g, the group of the commonest key (of equals the largest) or one of its own, and keyed, how many classes have that key."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = keyed.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(shared, ["key", "salt"])
    best = found.groupBy("node").agg(F.max(F.struct("size", "key")).alias("best"))
    return nodes.join(best, "node", "left").select("node", "lowest", "tk", "rk", "n", F.coalesce("best.key", F.xxhash64("node")).alias("g"), F.coalesce("best.size", F.lit(1)).alias("keyed"))


def _postings(prefixes: DataFrame) -> DataFrame:
    """token, g, n of each prefix token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix").to_pylist()
            sizes = [len(p) // 8 for p in prefix]
            token = np.frombuffer(b"".join(prefix), np.int64)
            repeated = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("g", "n")]
            for low in range(0, len(token), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 17)]) for x in (token, *repeated)], names=["token", "g", "n"])

    return prefixes.select("g", "n", "prefix").mapInArrow(run, "token long, g long, n int")


def _group_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """Pairs of groups (a < b) whose rows of the token-group matrix share enough tokens. ``members``: g, n, prefix, size (of the group)."""
    lone = _postings(members.filter("size = 1")).select("token", "g", F.col("n").alias("low"), F.col("n").alias("high"))
    more = _postings(members.filter("size > 1")).groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = lone.unionByName(more)
    a, b = (matrix.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("g", "low", "high"))) for side in "ab")
    fits = (F.col("g_a") < F.col("g_b")) & (100 * F.col("high_a") >= threshold * F.col("low_b")) & (100 * F.col("high_b") >= threshold * F.col("low_a"))
    needed = F.least(F.lit(SHARED), F.floor((threshold * F.least("low_a", "low_b") + 99) / 100))
    counted = a.join(b, "token").filter(fits).groupBy(F.col("g_a").alias("a"), F.col("g_b").alias("b")).agg(F.count("*").alias("shared"), F.min("low_a").alias("low_a"), F.min("low_b").alias("low_b"))
    return counted.filter(F.col("shared") >= needed).select("a", "b")


def _bit_map(wanted: DataFrame) -> np.ndarray:
    """Bits at the hashes ``tk``, eight a row or more; of bounded size, so with false hits where there are very many rows."""
    bits = min(MAP_BITS, 1 << max(12, (8 * wanted.count()).bit_length()))
    place = F.pmod("tk", F.lit(bits))
    rows = wanted.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(tk, {bits}) & 31 as int))")).alias("set")).collect()
    out = np.zeros(bits // 32, np.uint32)
    out[[r.word for r in rows]] = [r.set for r in rows]
    return out


def _sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, tokens of the classes whose texts' hashes are ``tk`` of ``wanted``, and of some more."""
    shared = texts.sparkSession.sparkContext.broadcast(_bit_map(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in _slices(batches):
            place = batch.column("tk").to_numpy() % (len(held) * 32)
            hit = (held[place >> 5] >> (place & 31).astype(np.uint32)) & 1
            some = batch.column("text").filter(pa.array(hit.astype(bool)))
            found = [tokens for _, tokens in token_sets(some, k)]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(t) for t in found], pa.binary()), pa.array([t.tobytes() for t in found], pa.binary())], names=["node", "tokens"])

    return texts.filter("text IS NOT NULL").select("tk", "text").mapInArrow(run, "node binary, tokens binary")


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = _overlap(a, b)
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _overlap(query: np.ndarray, union: np.ndarray) -> int:
    return int((union[np.minimum(np.searchsorted(union, query), len(union) - 1)] == query).sum())


def _shared_counts(queries: list[np.ndarray], block: list[np.ndarray]) -> np.ndarray:
    """|Q n M| of each query and member, by products of incidence matrices over the tokens that both sides have."""
    flat = [np.concatenate(x) for x in (queries, block)]
    row = [np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (queries, block)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(queries), len(block)), np.float32)
    if len(shared):
        place = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in flat]
        good = [shared[p] == x for p, x in zip(place, flat, strict=True)]
        for low in range(0, len(shared), COLUMNS):
            matrices = []
            for p, g, r, x in zip(place, good, row, (queries, block), strict=True):
                own = g & (p >= low) & (p < low + COLUMNS)
                m = np.zeros((len(x), min(COLUMNS, len(shared) - low)), np.float32)
                m[r[own], p[own] - low] = 1
                matrices.append(m)
            out += matrices[0] @ matrices[1].T
    return out


def forest(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, column) pairs that connect what the true cells connect; each row or column but one of a component gives one at most two steps off."""
    rows, columns = links.shape
    row = np.where(links.any(1), np.arange(rows), rows + columns)
    column = np.full(columns, rows + columns)
    while True:
        column = np.minimum(column, np.where(links, row[:, None], rows + columns).min(0))
        lower = np.minimum(row, np.where(links, column[None, :], rows + columns).min(1))
        if (lower == row).all():
            break
        row = lower
    for i in range(rows):
        if row[i] < i:
            yield i, -1 - int(row[i])
    for j in range(columns):
        if column[j] < rows:
            yield int(column[j]), j


def _open(threshold: int):
    """Batches of (a, b, block_a, block_b, side, node, tokens) in this order: links between sides 0 and 1, or within side 0 if there is no other."""

    def links(queries: list, block: list, same: bool) -> Iterator[tuple]:
        if same:
            block = queries
        if not queries or not block or same and len(queries) < 2:
            return
        if len(queries) == 1 and len(block) == 1:
            if linked(queries[0][1], block[0][1], threshold):
                yield queries[0][0], block[0][0]
            return
        kept = []
        for side, other in ((queries, block), (block, queries)):
            union = np.unique(np.concatenate([t for _, t in other]))
            kept.append(side if same else [x for x in side if _overlap(x[1], union) >= _least(len(x[1]), threshold)])
            if not kept[-1]:
                return
        queries, block = kept
        both = _shared_counts([t for _, t in queries], [t for _, t in block])
        total = np.array([len(t) for _, t in queries])[:, None] + np.array([len(t) for _, t in block])[None, :]
        for i, j in forest(100 * both >= threshold * (total - both)):
            a, b = queries[i][0], (block[j] if j >= 0 else queries[-1 - j])[0]
            if a != b:
                yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, block = None, [], []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["a", "b"])

        def close() -> list[tuple]:
            return list(links(queries, block, key[0] == key[1] and key[2] == key[3])) if key else []

        for batch in batches:
            rows = []
            keys = zip(*(batch.column(n).to_pylist() for n in ("a", "b", "block_a", "block_b")), strict=True)
            for now, side, node, tokens in zip(keys, batch.column("side").to_pylist(), batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if now != key:
                    rows += close()
                    key, queries, block = now, [], []
                own = block if side else queries
                if not own or own[-1][0] != node:  # a class may have come more than once
                    own.append((node, np.frombuffer(tokens, np.uint64)))
            if rows:
                yield out(rows)
        if rows := close():
            yield out(rows)

    return run


def _links(members: DataFrame, pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (node, node) that connect the members of groups and of pairs of groups as all their links do. ``members``: node, tk, n, g, size."""
    bounds = members.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.first("keyed").alias("keyed"))
    a, b = (bounds.select(F.col("g").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("low", "high", "blocks", "keyed"))) for side in "ab")
    sized = pairs.join(a, "a").join(b, "b")
    member = members.select("g", "node", "n", "tk", _salt().alias("salt"))

    def side(own: str, other: str, number: int) -> DataFrame:
        fits = (100 * F.col("n") >= threshold * F.col(f"low_{other}")) & (threshold * F.col("n") <= 100 * F.col(f"high_{other}"))
        dealt = sized.withColumn("salt", _salts(f"keyed_{own}")).withColumn("g", F.col(own))
        rows = dealt.join(member, ["g", "salt"]).filter(fits)
        mine = F.pmod(F.hash("node"), F.col(f"blocks_{own}")).alias(f"block_{own}")
        return rows.select("a", "b", mine, F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)).alias(f"block_{other}"), F.lit(number).alias("side"), "node", "tk")

    salted = bounds.drop("low", "high").withColumn("salt", _salts()).drop("keyed")
    within = members.filter("size > 1").withColumn("salt", _salt()).join(salted, ["g", "salt"]).withColumn("mine", F.pmod(F.hash("node"), F.col("blocks")))
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    # of two blocks of one group the lower number asks; a block against itself has only one side
    asks = F.transform(F.filter(blocks, lambda i: i >= F.col("mine")), lambda i: F.struct(F.col("mine").alias("block_a"), i.alias("block_b"), F.lit(0).alias("side")))
    told = F.transform(F.filter(blocks, lambda i: i < F.col("mine")), lambda i: F.struct(i.alias("block_a"), F.col("mine").alias("block_b"), F.lit(1).alias("side")))
    inner = within.select(F.col("g").alias("a"), F.col("g").alias("b"), F.inline(F.concat(asks, told)), "node", "tk").select("a", "b", "block_a", "block_b", "side", "node", "tk")
    rows = written(side("a", "b", 0).unionByName(side("b", "a", 1)).unionByName(inner), "jaccard-open")
    wanted = rows.select("tk").distinct()
    sets = _sets(texts, wanted, k)
    names = ["a", "b", "block_a", "block_b"]
    opened = rows.drop("tk").join(sets, "node")
    return opened.repartition(*names).sortWithinPartitions(*names, "side", "node").mapInArrow(_open(threshold), "a binary, b binary")


def row_hash(text: str = "text", doc_id: str = "doc_id") -> Column:
    """What ``jaccard_components`` tells rows of one doc_id apart by."""
    return F.xxhash64(named(text).cast("string"), named(doc_id))


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, threshold: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that it reaches by links), class_id (hex digest of its set), group_id
    (a digest that all rows of a component have in common, whatever their doc_ids; null for empty sets) and row_hash (of text and doc_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text")).withColumn("tk", row_hash("text", "doc_id"))
    counts = spark.sparkContext.broadcast(_token_counts(texts, k))
    kind = docs.schema[doc_id].dataType.simpleString()
    sketches = written(texts.select("doc_id", "tk", "text").mapInArrow(_sketch(k, threshold, counts), f"doc_id {kind}, {_SKETCH}"), "jaccard-sketches")
    # one row stands for a class: tk finds its text again, rk its sketch
    rk = F.xxhash64("node", "doc_id", "tk")
    chosen = sketches.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("lowest"), F.min(F.struct("doc_id", "tk")).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(chosen.select("node", "lowest", "one.tk", F.xxhash64("node", "one.doc_id", "one.tk").alias("rk"), "n", "keys"), "jaccard-classes")
    grouped = _grouped(nodes)
    least = min((n for n in range(1, 102) if 100 * n >= threshold * (n + 1)), default=1 << 62)  # smaller sets link only with equal ones
    able = grouped.filter(F.col("n") >= least)
    sizes = able.groupBy("g").agg(F.count("*").alias("size"), F.first("keyed").alias("keyed")).withColumn("salt", _salts()).drop("keyed")
    members = written(able.withColumn("salt", _salt()).join(sizes, ["g", "salt"]).drop("salt"), "jaccard-groups")
    prefixes = sketches.select(rk.alias("rk"), "prefix").join(members.select("rk", "g", F.col("n").cast("int").alias("n"), "size"), "rk")
    pairs = written(_group_pairs(prefixes, threshold), "jaccard-candidates")
    joined = components(_links(members, pairs, texts, k, threshold), "jaccard-joined")
    final = nodes.select("node", "lowest").join(joined, "node", "left").select("node", "lowest", F.coalesce("comp", "node").alias("whole"))
    lowest = joined.join(nodes.select("node", "lowest"), "node").groupBy(F.col("comp").alias("whole")).agg(F.min("lowest").alias("component_id"))
    classes = written(final.join(lowest, "whole", "left").select("node", "whole", F.coalesce("component_id", "lowest").alias("component_id")), "jaccard-components")
    shown = (F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.hex("node").alias("class_id"), F.hex("whole").alias("group_id"), F.col("tk").alias("row_hash"))
    return sketches.select("doc_id", "n", "node", "tk").join(classes, "node", "left").select("doc_id", *shown)


def brute_force(docs: list[tuple], k: int = 4, threshold: int = 85) -> dict:
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    import re

    sets, parent = {}, {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}
