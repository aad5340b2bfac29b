"""N-gram Jaccard join by prefixes of token combinations.

Tokens are the 64-bit numbers of word shingles. All sets are ordered the same way, by
how often a token occurs, rare first, so two sets that are similar enough meet in a
short prefix. Rare tokens are indexed alone. Frequent ones would make long lists, so
where a prefix reaches them it is extended and pairs of neighbouring frequent tokens
are indexed instead.

Why neighbours are enough: let x and y have n <= m tokens and a Jaccard index of at
least t >= 3/4. They share at least 2tn/(1+t) and at least tm tokens, so their first
common one lies in the first n - 2tn/(1+t) + 1 of x and the first m - tm + 1 of y. If
it is rare, it is indexed alone in both. Otherwise all their common tokens are frequent.
With u tokens of x and v of y not in common, the first u + v + 2 common tokens have
u + v + 1 gaps, so in one gap neither set has a token: a pair of neighbours in both. It
lies in the first 2u + v + 2 tokens of x, at most 3n(1-t)/(1+t) + 2, and in the first
u + 2v + 2 of y, at most 2(1-t)m + 2. So keys have a role: those of the shorter prefix
find larger sets, the others are only found.

Sets that are equal are one node, the smallest id. In each list the other members are
compared with its first one only, and the links found make components. Then members of
one list that are still in different components are compared too. In lists of a rare
token, which are short, these are pairs, less those whose distances to the first member
differ by over 1 - t (Jaccard distance is a metric, so they cannot link). The lists of
frequent pairs, and any longer ones of rare tokens (with many more words than counters
the rarest are not that rare), that have the same first member are one group, which may
be large: its
members that are not in the first one's component are compared with all, block by block,
and what leaves a task is an edge per member, never a row per pair. So a group of near
copies that link costs comparisons in proportion to its size.

A pair is first compared by counts of tokens per bucket, half a byte to a byte a token:
the sum of the smaller counts is at least the number of common tokens, so pairs that
fail cannot link. Only those that pass are compared by their sets, which are made from
the texts of the documents concerned.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdline.llm import common
from holdline.llm.components import block_roots, components
from holdline.llm.shingles import shingle_set

# Counters of the frequency sketch, of a fixed size at any scale: the order of tokens
# decides only how long the lists are, never which pairs are found.
COUNTERS = 1 << 20
_CHUNK = 1 << 14
# A token is frequent if its counter is this far above the mean counter, and by as
# many standard deviations of a counter.
FREQUENT, DEVIATIONS = 256, 8
# Lists of rare tokens with more members are compared in blocks too.
LONG_LIST = 512
# Tables of tasks are merged so many at a time.
_FAN = 64

_SCAN = pa.schema(
    [
        ("id", pa.int64()),
        ("n", pa.int64()),
        ("content", pa.binary()),
        ("chunk", pa.int32()),
        ("task", pa.int32()),
        ("data", pa.binary()),
    ]
)
_SCAN_DDL = "id long, n long, content binary, chunk int, task int, data binary"
_CHUNKS = pa.schema([("chunk", pa.int32()), ("task", pa.int32()), ("data", pa.binary())])
_CHUNKS_DDL = "chunk int, task int, data binary"
# Bits and keys of the filter that picks the documents whose sets are made; of a fixed
# size too, as documents that pass it by chance are dropped by a join afterwards.
_FILTER_BITS, _FILTER_KEYS = 26, 2

_KEYS = pa.schema(
    [
        ("id", pa.int64()),
        ("n", pa.int64()),
        ("rare", pa.list_(pa.int64())),
        ("rare_short", pa.int32()),
        ("pairs", pa.list_(pa.int64())),
        ("pairs_short", pa.int32()),
        ("buckets", pa.binary()),
    ]
)
_KEYS_DDL = "id long, n long, rare array<long>, rare_short int, pairs array<long>, pairs_short int, buckets binary"
# Members of a group that are compared with as many others in one task.
_BLOCK_ROWS = 256
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BOUNDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("most", pa.float64()), ("may_link", pa.bool_())])
_SETS = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])
_DISTANCES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())])


def _counters(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def _scan(batches):
    """Size and content digest of each set, then the counters of the whole partition."""
    counts = np.zeros(COUNTERS, np.int64)
    for ids, texts in common.columns_of(batches, "id", "text"):
        sets = [shingle_set(t) for t in texts]
        counts += np.bincount(_counters(np.concatenate(sets)), minlength=COUNTERS)
        blank = [None] * len(ids)
        yield common.batch(
            {
                "id": ids,
                "n": [len(s) for s in sets],
                "content": [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets],
                "chunk": blank,
                "task": blank,
                "data": blank,
            },
            _SCAN,
        )
    for rows in _chunks(counts):
        yield common.batch({"id": [None], "n": [None], "content": [None], **rows}, _SCAN)


def _chunks(table: np.ndarray):
    """The chunks of a task's table that are not all zero, one by one."""
    task = TaskContext.get().partitionId()
    for i, part in enumerate(table.reshape(-1, _CHUNK)):
        if part.any():
            yield {"chunk": [i], "task": [task], "data": [zlib.compress(part.tobytes(), 1)]}


def _merged(parts: DataFrame, merge: np.ufunc, table: np.ndarray) -> np.ndarray:
    """``table`` (all zero) with the chunks of all tasks merged, a bounded number at a
    time however many tasks there were."""

    kind = table.dtype

    def some(key, rows):
        total = np.zeros(_CHUNK, kind)
        for x in rows["data"]:
            merge(total, np.frombuffer(zlib.decompress(x), kind), out=total)
        rows = rows.iloc[:1].copy()
        rows["data"] = [zlib.compress(total.tobytes(), 1)]
        return rows

    most = parts.agg(F.max("task")).first()[0] or 0
    while True:
        parts = parts.withColumn("task", F.expr(f"int(task div {_FAN})"))
        parts = parts.groupBy("chunk", "task").applyInPandas(some, _CHUNKS_DDL)
        most //= _FAN
        if not most:
            break
    chunks = table.reshape(-1, _CHUNK)
    for row in parts.toLocalIterator():
        chunks[row["chunk"]] = np.frombuffer(zlib.decompress(bytes(row["data"])), kind)
    return table


def _sketch(scan: DataFrame) -> np.ndarray:
    """The counters of all rows; 8 MB at any scale."""
    parts = scan.filter("chunk IS NOT NULL").select("chunk", "task", "data")
    return _merged(parts, np.add, np.zeros(COUNTERS, np.int64))


def index_keys(tokens: np.ndarray, counts: np.ndarray, frequent: float, percent: int):
    """(rare tokens, how many of them find larger sets, pairs of frequent ones, how many
    of them do): the keys under which a set is indexed."""
    n = len(tokens)
    seen = counts[_counters(tokens)]
    order = np.lexsort((tokens, seen))
    tokens, rare = tokens[order], int((seen <= frequent).sum())
    found = n - -(-percent * n // 100) + 1
    finds = n - -(-2 * percent * n // (100 + percent)) + 1
    alone = tokens[: min(found, rare)]
    if rare >= found:
        return alone, min(finds, rare), tokens[:0], 0
    reach = tokens[rare : 2 * (100 - percent) * n // 100 + 2]
    pairs = (reach[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ reach[1:]
    pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    short = 3 * (100 - percent) * n // (100 + percent) + 2 - rare - 1 if rare < finds else 0
    return alone, min(finds, rare), pairs, max(0, min(short, len(pairs)))


def buckets(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each of a power of two of equal ranges, at least 16 and
    more than half the number of tokens."""
    bits = max(4, (len(tokens) // 2).bit_length())
    while True:
        counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def most_similar(x: bytes, y: bytes, percent: int) -> tuple[float, bool]:
    """A bound on the Jaccard index of two sets, and whether it allows a link."""
    x, y = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y))
    size = min(len(x), len(y))
    x, y = (z.reshape(size, -1).sum(axis=1) for z in (x, y))
    same = int(np.minimum(x, y).sum())
    union = int(x.sum() + y.sum()) - same
    return same / max(union, 1), same > 0 and 100 * same >= percent * union


def _keys(shared, frequent: float, percent: int):
    def run(batches):
        counts = shared.value
        for ids, texts in common.columns_of(batches, "id", "text"):
            sets = [shingle_set(t) for t in texts]
            keys = [index_keys(x, counts, frequent, percent) for x in sets]
            cols = {"id": ids, "n": [len(x) for x in sets], "buckets": [buckets(x) for x in sets]}
            for at, name in enumerate(("rare", "pairs")):
                cols[name] = [k[2 * at].view(np.int64) for k in keys]
                cols[f"{name}_short"] = [k[2 * at + 1] for k in keys]
            yield common.batch(cols, _KEYS)

    return run


def _bound(percent: int):
    def run(batches):
        for a, b, left, right in common.columns_of(batches, "a", "b", "left", "right"):
            found = [most_similar(x, y, percent) for x, y in zip(left, right)]
            cols = {"a": a, "b": b, "most": [f[0] for f in found], "may_link": [f[1] for f in found]}
            yield common.batch(cols, _BOUNDS)

    return run


def _places(ids: np.ndarray) -> np.ndarray:
    """The bits of the filter for each id, one row per key."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = [np.uint64(64 - _FILTER_BITS - 6 * k) for k in range(_FILTER_KEYS)]
    return np.stack([(x >> k) & np.uint64((1 << _FILTER_BITS) - 1) for k in shift]).astype(np.int64)


def _marked(batches):
    """The filter's bytes that a partition's ids set."""
    mine = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for (ids,) in common.columns_of(batches, "id"):
        for places in _places(np.array(ids, np.int64)):
            np.bitwise_or.at(mine, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
    for rows in _chunks(mine):
        yield common.batch(rows, _CHUNKS)


def _filter(ids: DataFrame) -> np.ndarray:
    """A filter that all of ``ids`` pass: 8 MB at any scale, here too."""
    parts = common.bounded_batches(ids).mapInArrow(_marked, _CHUNKS_DDL)
    return _merged(common.written(parts, "filter"), np.bitwise_or, np.zeros(1 << (_FILTER_BITS - 3), np.uint8))


def _sets(shared):
    def run(batches):
        for ids, texts in common.columns_of(batches, "id", "text"):
            places = _places(np.array(ids, np.int64))
            wanted = ((shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)
            rows = [(i, shingle_set(t).tobytes()) for i, t, w in zip(ids, texts, wanted) if w]
            yield common.batch({"id": [r[0] for r in rows], "tokens": [r[1] for r in rows]}, _SETS)

    return run


def _compare(percent: int):
    def run(batches):
        for a, b, left, right in common.columns_of(batches, "a", "b", "left", "right"):
            distance, linked = [], []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                x, y = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                union = len(x) + len(y) - same
                distance.append(1 - same / max(union, 1))
                linked.append(same > 0 and 100 * same >= percent * union)
            yield common.batch({"a": a, "b": b, "distance": distance, "linked": linked}, _DISTANCES)

    return run


def _postings(keys: DataFrame, name: str) -> DataFrame:
    """(key, id, finds) of one class of keys."""
    rows = keys.select("id", f"{name}_short", F.posexplode(name).alias("at", "key"))
    return rows.select("key", "id", (F.col("at") < F.col(f"{name}_short")).alias("finds"))


def _rare_lists(keys: DataFrame) -> DataFrame:
    """(key, a, b, finds, size): every member b of a list with its first member a, the
    smallest that finds, and the length of the list. Lists in which none does hold no
    pair."""
    first = Window.partitionBy("key").orderBy(F.desc("finds"), "id")
    rows = _postings(keys, "rare").select(
        "key",
        F.first("id").over(first).alias("a"),
        F.first("finds").over(first).alias("first_finds"),
        F.col("id").alias("b"),
        "finds",
        F.count("*").over(Window.partitionBy("key")).alias("size"),
    )
    return rows.filter("first_finds AND a <> b").drop("first_finds")


def _pair_groups(keys: DataFrame) -> DataFrame:
    """(a, b): every member b of some list of a frequent pair with its first member a.
    These lists can be long, so their first members come from a partial aggregate."""
    rows = _postings(keys, "pairs")
    firsts = rows.groupBy("key").agg(F.min(F.when(F.col("finds"), F.col("id"))).alias("a"), F.count("*").alias("size"))
    firsts = common.written(firsts.filter("a IS NOT NULL AND size > 1").drop("size"), "list-heads")
    rows = rows.join(firsts, "key").select("a", F.col("id").alias("b"))
    return rows.filter("a <> b")


def _both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    left = values.select(F.col("id").alias("a"), F.col(column).alias("left"))
    right = values.select(F.col("id").alias("b"), F.col(column).alias("right"))
    return common.bounded_batches(pairs.select("a", "b").join(left, "a").join(right, "b"))


def _bounds(pairs: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """(a, b, most, may_link) for each pair, from the counts per bucket."""
    rows = _both(pairs, keys, "buckets")
    return common.written(rows.mapInArrow(_bound(percent), "a long, b long, most double, may_link boolean"), "bounds")


def _token_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, tokens) of the documents in some pair; the texts stay where they are."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = common.written(ids, "compared")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(ids))
    sets = docs.filter("id IS NOT NULL").mapInArrow(_sets(shared), "id long, tokens binary")
    return common.written(sets.join(ids, "id", "left_semi"), "shingle-sets")


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) for each pair, exactly."""
    rows = _both(pairs, sets, "tokens")
    ddl = "a long, b long, distance double, linked boolean"
    return common.written(rows.mapInArrow(_compare(percent), ddl), "distances")


def _labelled(rows: DataFrame, found: DataFrame, *sides: str) -> DataFrame:
    """``rows`` with the component of each side as ``<side>_component``."""
    for side in sides:
        label = found.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component"))
        rows = rows.join(label, side, "left")
        rows = rows.withColumn(f"{side}_component", F.coalesce(f"{side}_component", side))
    return rows


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    return _labelled(rows, found, "a", "b").filter("a_component <> b_component")


def _block_links(percent: int):
    """Edges that tie what links among the rows of two blocks: id, inside (whether it is
    in the first member's component, all of which is tied already), tokens."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["id", "inside", "tokens"]).to_pydict()
        ids, inside = np.array(rows["id"], np.int64), np.array(rows["inside"], bool)
        sets = [np.frombuffer(t, "<u8") for t in rows["tokens"]]
        sizes = np.array([len(x) for x in sets])
        places = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        links, mine = np.zeros((len(ids), len(ids)), bool), np.zeros(int(places.max(initial=0)) + 1, bool)
        for i in np.nonzero(~inside & (sizes > 0))[0]:
            own = places[starts[i] : starts[i] + sizes[i]]
            mine[own] = True
            upto = np.concatenate([[0], np.cumsum(mine[places])])
            same = upto[starts + sizes] - upto[starts]
            mine[own] = False
            links[i] = (same > 0) & (100 * same >= percent * (sizes + sizes[i] - same))
        links |= links.T
        roots = block_roots(links, ids)
        tied = roots != ids
        return pa.table([ids[tied], roots[tied]], schema=_EDGES)

    return run


def _group_links(docs: DataFrame, groups: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Edges among members of groups that are not all in one component yet."""
    # Written: a join splits a frequent key only if it stands on two plain shuffles.
    mixed = common.written(_apart(groups, found).select("a").distinct(), "mixed-groups")
    members = groups.join(mixed, "a", "left_semi").unionByName(mixed.select("a", F.col("a").alias("b")))
    members = _labelled(members, found, "a", "b").select(
        "a", F.col("b").alias("id"), (F.col("a_component") == F.col("b_component")).alias("inside")
    )
    members = common.written(members, "group-members")
    sets = _token_sets(docs, members.select("a", F.col("id").alias("b")))

    def blocks(inside: bool):
        return F.ceil(F.count_if(F.col("inside") == inside) / _BLOCK_ROWS)

    sizes = members.groupBy("a").agg(blocks(False).alias("outer"), blocks(True).alias("inner"))
    rows = members.join(common.written(sizes, "group-sizes"), "a")
    # Blocks of the outer members come first; a block of inner ones meets only those.
    hashed = F.xxhash64("id")
    own = F.when(F.col("inside"), F.col("outer") + F.pmod(hashed, F.col("inner"))).otherwise(F.pmod(hashed, F.col("outer")))
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    rows = rows.select("a", "id", "inside", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    rows = common.bounded_batches(rows.join(sets, "id"))
    edges = rows.groupBy("a", "first", "second").applyInArrow(_block_links(percent), "a long, b long")
    return common.written(edges.distinct(), "group-edges")


def _list_pairs(lists: DataFrame, keys: DataFrame, ranges: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members of one list, neither its first, that are in different
    components and that sizes, roles and distances to the first member let link."""
    mixed = lists.join(_apart(lists, found).select("key").distinct(), "key", "left_semi")
    members = _labelled(mixed.join(ranges, ["a", "b"]).drop("a"), found, "b")
    members = common.written(members.join(keys.select(F.col("id").alias("b"), "n"), "b"), "members")
    columns = ("b", "n", "finds", "low", "high", "b_component")
    x, y = (members.select("key", *[F.col(c).alias(c + side) for c in columns]) for side in "xy")
    slack = 1 - percent / 100 + 1e-9
    near = (F.col("lowx") - F.col("highy") <= slack) & (F.col("lowy") - F.col("highx") <= slack)
    sizes = F.col("findsx") & (F.col("nx") <= F.col("ny")) & (100 * F.col("nx") >= percent * F.col("ny"))
    once = (F.col("nx") < F.col("ny")) | (F.col("bx") < F.col("by")) | ~F.col("findsy")
    apart = (F.col("bx") != F.col("by")) & (F.col("b_componentx") != F.col("b_componenty"))
    rest = x.join(y, "key").filter(apart & sizes & once & near)
    return rest.select(F.least("bx", "by").alias("a"), F.greatest("bx", "by").alias("b")).distinct()


def _links(docs: DataFrame, keys: DataFrame, lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the nodes that some link ties."""
    firsts = lists.select("a", "b").unionByName(groups).distinct()
    bounds = _bounds(firsts, keys, percent)
    pairs = bounds.filter("may_link")
    known = _distances(pairs, _token_sets(docs, pairs), percent)
    tied = known.filter("linked").select("a", "b")
    found = components(tied)

    more = []
    if not _apart(groups, found).isEmpty():
        more.append(_group_links(docs, groups, found, percent))

    # The range in which the distance of a member to the first one is.
    exact = known.groupBy("a", "b").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    ranges = bounds.groupBy("a", "b").agg(F.max("most").alias("most")).join(exact, ["a", "b"], "left")
    ranges = ranges.select(
        "a", "b", F.coalesce("low", 1 - F.col("most")).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high")
    )
    rest = _list_pairs(lists, keys, ranges, found, percent)
    rest = _bounds(rest.join(bounds.select("a", "b"), ["a", "b"], "left_anti"), keys, percent).filter("may_link")
    if not rest.isEmpty():
        last = _distances(rest, _token_sets(docs, rest), percent)
        more.append(last.filter("linked").select("a", "b"))
    return components(reduce(DataFrame.unionByName, more, tied)) if more else found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set of five-word
    shingles and the smallest id that links reach, itself included. Two rows link when
    their sets' Jaccard index is at least ``percent`` hundredths (75 to 100).

    A null or blank text has no shingles and links with nothing. A row with a null id
    links with nothing and has a null component. Copies of one text share a component;
    a repeated id with different texts gets a row for each, by its text. Other columns
    are ignored, an empty table gives no rows.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the index is exact for 75 to 100 hundredths")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = _similar_texts(docs, percent) if _ids_repeat(docs) else _similar(docs, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _ids_repeat(docs: DataFrame) -> bool:
    """Whether an id names different texts."""
    content = F.xxhash64("text")
    texts = docs.filter("id IS NOT NULL").groupBy("id").agg(F.min(content).alias("x"), F.max(content).alias("y"))
    return not texts.filter("x <> y").isEmpty()


def _own(identity: str = "id") -> Column:
    """A number for each text of each id."""
    return F.when(F.col(identity).isNotNull(), F.xxhash64(F.col(identity).cast("long"), F.col("text").cast("binary")))


def _similar_texts(docs: DataFrame, percent: int) -> DataFrame:
    """``_similar`` of a table whose ids may name different texts, each a node by itself:
    its columns, ``own`` and ``keeper``, the ``own`` of the component's smallest row."""
    numbered = docs.withColumns({"own": _own(), "given": F.col("id")})
    found = common.written(_similar(numbered.select(F.col("own").alias("id"), "text"), percent), "text-components")
    names = numbered.filter("own IS NOT NULL").select("own", "given").distinct()
    found = found.withColumnRenamed("id", "own").join(common.written(names, "text-names"), "own", "left")
    least = found.filter("own IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("given", "own")).alias("least"))
    found = found.join(common.written(least, "text-keepers"), "component_id", "left")
    return found.select(
        F.col("given").alias("id"), "n", F.col("least.given").alias("component_id"), "own", F.col("least.own").alias("keeper")
    )


def _similar(docs: DataFrame, percent: int) -> DataFrame:
    """(id, n, component_id) for each row; an id names one text."""
    scan = common.written(common.bounded_batches(docs).mapInArrow(_scan, _SCAN_DDL), "shingle-scan")
    rows = scan.filter("chunk IS NULL").select("id", "n", "content")
    nodes = rows.filter("id IS NOT NULL AND content IS NOT NULL").groupBy("content").agg(F.min("id").alias("id"))

    counts = _sketch(scan)
    mean = counts.mean()
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int64))
    frequent = mean + FREQUENT + DEVIATIONS * mean**0.5
    keys = docs.filter("id IS NOT NULL").mapInArrow(_keys(shared, frequent, percent), _KEYS_DDL)
    keys = common.written(keys, "shingle-keys")
    # The first member of a list is a node, as copies are in the same lists.
    lists = _rare_lists(keys).join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    lists = common.written(lists, "shingle-lists")
    # Few sets reach frequent tokens, so their copies go before the lists are made.
    paired = keys.filter(F.size("pairs") > 0).join(nodes.select("id"), "id", "left_semi")
    long = lists.filter(F.col("size") > LONG_LIST).select("a", "b")
    groups = common.written(_pair_groups(paired).unionByName(long).distinct(), "pair-groups")
    lists = lists.filter(F.col("size") <= LONG_LIST).drop("size")
    found = _links(docs, keys, lists, groups, percent)

    named = nodes.join(found, "id", "left").select(
        "content", F.coalesce("component", "id").alias("component_id")
    )
    return rows.join(named, "content", "left").select(
        "id",
        "n",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


def without_near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group that
    links connect: the row with the smallest doc_id stays, once if it is repeated. Rows
    with a null id all stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    if _ids_repeat(rows):
        own = common.free_name(docs, "own")
        first = _similar_texts(rows, percent).filter("own = keeper").select(F.col("own").alias(own)).distinct()
        kept = docs.withColumn(own, _own("doc_id")).join(first, own, "left_semi").dropDuplicates(["doc_id", "text"])
        return kept.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
    found = similar_documents(docs.select("doc_id", "text"), percent=percent)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
