"""N-gram Jaccard join with count-vector R-trees.

Every document is the set of its distinct k-word shingles; two documents link
when den * |intersection| >= num * |union|. The join loses no link.

Index. Shingles are hashed into `GROUPS` groups; the counts by group are a
document's point. For two points the sum over groups of the smaller counts is
an upper bound of the overlap, and so is the sum of min(query, box maximum) for
all points in a box: an R-tree search descends only into boxes, and verifies
only points, whose bound reaches the overlap that the threshold needs.

Directory. For random texts every box of a corpus-wide tree covers nearly the
whole space, so such a tree alone prunes nothing and its search is quadratic.
Its upper level is therefore exact: a document's shingles are divided by hash
into segments, more than twice as many as two linked documents can differ in.
Linked documents of n shingles differ in at most d = n(1-t)/t segments, so among
each one's d+1 first segments (larger first, then by content hash: one order
for all) at least one is the same. Documents meet only in such a tile (size
class, segment content); the trees are built inside tiles.

Steps, all on Spark:
1. each document: set hash, size, tile keys. Documents with equal sets are one
   node from here on, so copies cost nothing and are not expanded to pairs; tile
   keys that only one node has are dropped by a filter of bounded size;
2. each tile names a leader, its node that has the most tiles; a node follows the
   leader it meets most often. The points of a leader's followers are put in
   R-trees, which the leader's own point searches; survivors are verified. This
   joins a large group of near copies by one pair a member, not by all pairs;
3. tiles whose members are still in different components are searched: pages of
   at most `PAGE` points with an R-tree each, queried by the members outside
   the tile's largest component; survivors are verified. Together with 2 every
   pair that could link is verified or already connected;
4. components of the links, which all came out of an R-tree.

Defined results: null, empty and wordless texts have no shingles and are
components of their own; a text of fewer than k words is one shingle; repeated
rows and ids give a row each; component_id is the smallest non-null id
reachable, null only if there is none; other columns are not read. Shingles and
sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import LOWER, UPPER, components, drop_settled, free_name, if_small, join_by_key, settle
from .shared import flat, shared_values, sum_of_sizes

GROUPS = 256
PAGE = 256
#: Entries of a node of an R-tree.
LEAF = 8
#: Lowest tiles of a node that travel with it, and what stands for fewer.
FIRST_TILES = 8
NO_TILE = (1 << 63) - 1


def _shingles(b: K.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row: (hash, row)."""
    t = K.tokens(b, K.NON_SPACE)
    h, at = K.windows(t.hash, t.row, k)
    row = t.row[at]
    n = K.per_row(t.row, b.rows)
    if (short := (n > 0) & (n < k)).any():
        first = np.searchsorted(t.row, np.arange(b.rows))
        more = []
        for r in np.flatnonzero(short).tolist():
            w, _ = K.windows(t.hash[first[r] : first[r] + n[r]], np.zeros(n[r], np.int64), int(n[r]))
            more.append(w[0])
        h, row = np.r_[h, np.array(more, np.uint64)], np.r_[row, np.flatnonzero(short)]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _most_different(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most shingles by which a set of n can differ from one that it links with."""
    return n * (den - num) // num


def _tiles(h: np.ndarray, row: np.ndarray, rows: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: size and set hash; and (tile, row) for its first segments, grouped by row."""
    n = K.per_row(row, rows)
    content = K.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(content, out=sums[1:])
    ends = np.cumsum(n)
    sig = K.mix(sums[ends] - sums[ends - n] + n.astype(np.uint64))
    keys, owners = [], []
    bits = np.zeros(rows, np.int64)
    bits[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64) + 1
    for up in (0, 1):
        size_class = bits + up
        use = (n > 0) & (_most_different(n, num, den) > 0)
        if up:
            use &= n * den >= num * (1 << (size_class - 1))
        if not use.any():
            continue
        most = (1 << size_class) - 1
        parts = 3 * (_most_different(most, num, den) + 1) // 2 + 1
        sel = use[row]
        r, x, c = row[sel], h[sel], content[sel]
        g = ((x >> np.uint64(32)) * parts[r].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(r), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(r)])
        token = K.mix(np.add.reduceat(c, at) ^ (K.mix(size_class[r[at]].astype(np.uint64)) + g[at]))
        owner = r[at]
        order = np.lexsort((token, -size, owner))
        token, owner = token[order], owner[order]
        have = K.per_row(owner, rows)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(have) - have, have)
        want = _most_different(n, num, den) + 1
        keep = rank < want[owner]
        keys.append(token[keep])
        owners.append(owner[keep])
        # A set with fewer filled segments than that also goes by its empty ones, lowest first.
        for i in np.flatnonzero(use & (have < want)).tolist():
            full = set(g[at][r[at] == i].tolist())
            empty = [s for s in range(int(parts[i])) if s not in full][: int(want[i] - have[i])]
            e = np.array(empty, np.uint64) + np.uint64(int(size_class[i]) << 40)
            keys.append(K.mix(K.mix(e) + np.uint64(1)))
            owners.append(np.full(len(empty), i))
    tile = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return n, sig, tile[order], owner[order]


def _describe(k: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in K.blocks(batch.column(1)):
            h, row = _shingles(b, k)
            n, sig, tile, owner = _tiles(h, row, b.rows, num, den)
            offsets = np.r_[0, np.cumsum(K.per_row(owner, b.rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(b.first, b.rows), batch.column(2).slice(b.first, b.rows), pa.array(n), pa.array(K.signed(sig)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(K.signed(tile)))],
                names=["doc_id", "copy", "n", "sig", "tiles"],
            )


def _shared_tiles(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, tile) of the tiles that several nodes have, and of a few more."""
    for batch in batches:
        tiles, row = flat(batch.column(1))
        keep = held.value.keeps(tiles.view(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(tiles[keep])], names=["sig", "tile"])


def _sets(k: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in K.blocks(batch.column(0)):
            h, row = _shingles(b, k)
            n = K.per_row(row, b.rows)
            ends = np.cumsum(n)
            content = np.r_[np.uint64(0), np.cumsum(K.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
            sig = K.mix(content[ends] - content[ends - n] + n.astype(np.uint64))
            # 255 stands for any larger count: see _points.
            point = np.bincount(row * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64), minlength=b.rows * GROUPS).clip(max=255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(K.signed(sig)), pa.array(n), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(K.signed(h))), pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), b.rows, [None, pa.py_buffer(point.tobytes())]).cast(pa.binary())],
                names=["sig", "n", "shingles", "point"],
            )


def _points(stored: list[bytes]) -> np.ndarray:
    """The points' counts; an unknown large one is no limit, so that bounds stay upper bounds."""
    counts = np.frombuffer(b"".join(stored), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    counts[counts == 255] = 1 << 20
    return counts


class RTree:
    """Points in boxes of LEAF, boxes in boxes of LEAF up to one root; a box keeps its largest counts, and its smallest and largest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(points))
        # Bulk load: halves along the count that differs most, in whole leaves.
        parts, self.order = [order], []
        while parts:
            part = parts.pop()
            if len(part) <= LEAF:
                self.order.append(part)
                continue
            spread = np.argmax(np.ptp(points[part], 0))
            part = part[np.lexsort((sizes[part], points[part, spread]))]
            half = -(-len(part) // 2 // LEAF) * LEAF
            parts += [part[half:], part[:half]]
        self.order = np.concatenate(self.order) if len(points) else order
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            high, small, large = self.levels[-1]
            starts = np.arange(0, len(small), LEAF)
            self.levels.append((np.maximum.reduceat(high, starts, 0), np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts)))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Indexes of all points that may link with a set of that point and size."""
        at = np.arange(len(self.levels[-1][1]))
        for depth, (high, small, large) in reversed(list(enumerate(self.levels))):
            at = at[(large[at] * den >= num * size) & (small[at] * num <= den * size)]
            # |intersection| >= num / (num + den) * (size + other)
            at = at[np.minimum(high[at], point).sum(1) * (num + den) >= num * (size + small[at])]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def _search(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (tile, page) side by side: points and queries; candidate pairs come out.

    A pair that meets in several tiles survives the bound in each of them. It
    comes out of the lowest tile that both know of among their first ones only.
    """

    def page(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig, comp, n = (rows.column(c).to_numpy() for c in ("sig", "comp", "n"))
        query, big = rows.column("query").to_numpy(zero_copy_only=False), rows.column("big").to_numpy()
        points = _points(rows.column("point").to_pylist())
        held, asks = np.flatnonzero(~query), np.flatnonzero(query)
        tile, firsts = rows.column("tile")[0].as_py(), rows.column("firsts").combine_chunks().flatten().to_numpy().reshape(-1, FIRST_TILES)
        a, b = [], []
        if len(held) and len(asks):
            tree = RTree(points[held], n[held])
            for q in asks.tolist():
                to = held[tree.search(points[q], int(n[q]), num, den)]
                to = to[(comp[to] != comp[q]) & ((comp[to] == big[q]) | (sig[to] > sig[q]))]
                shared = (firsts[to][:, :, None] == firsts[q]).any(2) & (firsts[to] != NO_TILE)
                lowest = np.where(shared, firsts[to], NO_TILE).min(1, initial=NO_TILE)
                to = to[(lowest == NO_TILE) | (lowest == tile)]
                a.append(np.full(len(to), sig[q]))
                b.append(sig[to])
        e = np.zeros(0, np.int64)
        return np.concatenate([e, *a]), np.concatenate([e, *b])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        tile, number = rows.column("tile").to_numpy(), rows.column("page").to_numpy()
        cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (number[1:] != number[:-1])) + 1
        found = [page(rows.slice(i, j - i)) for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        rest = rows.slice(int(cuts[-1])) if len(cuts) else rows
        if found:
            pairs = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
    if rest is not None and rest.num_rows:
        a, b = page(rest)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole shingle sets."""
    pairs = settle(pairs, "pairs")
    nodes = settle(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct(), "nodes")
    # Only these sets move.
    sets = sets.join(if_small(nodes), "sig", "left_semi")
    one = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(both * den >= num * (F.size("x") + F.size("y") - both)).select("a", "b")


def _placed(members: DataFrame, sets: DataFrame) -> DataFrame:
    return members.join(sets.select("sig", "n", "point"), "sig")


def _candidates(held: DataFrame, asks: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) that R-trees over `held` give for the queries `asks`, page by page."""
    columns = ["tile", "page", "sig", "comp", "big", "n", "point", "firsts", "query"]
    pages = held.withColumn("query", F.lit(False)).select(columns).union(asks.withColumn("query", F.lit(True)).select(columns))
    pages = pages.repartition("tile", "page").sortWithinPartitions("tile", "page")
    pairs = pages.mapInArrow(lambda it: _search(num, den, it), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _page(pages: str = "pages"):
    return F.pmod(F.xxhash64("sig"), F.col(pages))


def _every_page(pages: str = "pages"):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(pages) - 1))


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, figures: dict | None = None) -> DataFrame:
    """(doc_id, copy, n, sig, component), a row for each row of docs: hashes of the text and of the set, and the set's component."""
    text = F.col(text_col)
    kept = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    described = settle(kept.mapInArrow(lambda it: _describe(k, num, den, it), f"doc_id {id_type}, copy long, n long, sig long, tiles array<long>"), "sets")

    held = docs.sparkSession.sparkContext.broadcast(shared_values(described, "sig", "tiles", sum_of_sizes(described, "tiles")))
    keys = settle(described.select("sig", "tiles").mapInArrow(lambda it: _shared_tiles(held, it), "sig long, tile long").distinct(), "keys")
    rows = settle(described.select("doc_id", "copy", "n", "sig"), "rows")
    drop_settled(described)
    total = keys.count()
    # Of a group of near copies, what they were made from has the most tiles: it leads.
    score = keys.groupBy("sig").agg(F.count("*").alias("score"))
    hubs = keys.join(score, "sig").groupBy("tile").agg(F.max(F.struct("score", "sig")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = settle(hubs.select("tile", F.col("hub.sig").alias("leader"), F.col("hub.score").alias("score"), "n"), "hubs")
    met = settle(join_by_key(keys, hubs, "tile", total).where("sig <> leader").select("tile", "sig", "leader", "score"), "met")
    drop_settled(keys, hubs)
    votes = met.groupBy("sig", "leader", "score").count()
    first = settle(votes.groupBy("sig").agg(F.max_by("leader", F.struct("count", "score", "leader")).alias("leader")), "first")
    nodes = met.select("sig").union(met.select(F.col("leader").alias("sig"))).distinct()
    ids = settle(rows.groupBy("sig").agg(F.min(F.struct("doc_id", "copy")).alias("d")).join(nodes, "sig", "left_semi").select("sig", "d.doc_id", "d.copy"), "ids")
    wanted = ids.select(F.col("doc_id").alias("wanted"), F.col("copy").alias("wanted_copy"))
    texts = kept.join(if_small(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")) & (F.col("copy") == F.col("wanted_copy")), "left_semi").select("text")
    sets = texts.mapInArrow(lambda it: _sets(k, num, den, it), "sig long, n long, shingles array<long>, point binary")
    # Rows that repeat id and text give their set once each.
    sets = settle(sets.dropDuplicates(["sig"]), "shingles")

    none = F.array_repeat(F.lit(NO_TILE), FIRST_TILES)
    led = first.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(PAGE)).alias("pages"))
    of = lambda df, comp: df.withColumn("comp", F.lit(comp).cast("long")).withColumn("big", F.lit(0).cast("long")).withColumn("firsts", none)
    followers = _placed(first.join(led, "leader").select(F.col("leader").alias("tile"), "sig", "pages"), sets).withColumn("page", _page())
    leaders = _placed(led.select(F.col("leader").alias("tile"), F.col("leader").alias("sig"), "pages"), sets).withColumn("page", _every_page())
    found = _candidates(of(followers, 0), of(leaders, 1), num, den)
    links = settle(_verified(found, sets, num, den), "links")
    comps = settle(components(links), "comps")

    comp_of = lambda c, name: comps.select(F.col("id").alias(c), F.col("component").alias(name))
    seen = met.join(comp_of("sig", "c1"), "sig", "left").join(comp_of("leader", "c2"), "leader", "left")
    open_tiles = seen.where(F.coalesce("c1", "sig") != F.coalesce("c2", "leader")).select("tile").distinct()
    members = met.join(open_tiles, "tile", "left_semi")
    members = members.select("tile", "sig").union(members.select("tile", F.col("leader").alias("sig"))).distinct()
    members = settle(members.join(comp_of("sig", "c"), "sig", "left").select("tile", "sig", F.coalesce("c", "sig").alias("comp")), "open")
    drop_settled(met)
    shares = members.groupBy("tile", "comp").count()
    tiles = shares.groupBy("tile").agg(F.max_by("comp", F.struct("count", "comp")).alias("big"), F.ceil(F.sum("count") / F.lit(PAGE)).alias("pages"))
    # A node has no more tiles than keys, a fraction of its own shingles.
    lowest = F.slice(F.concat(F.array_sort(F.collect_list("tile")), none), 1, FIRST_TILES)
    firsts = members.groupBy("sig").agg(lowest.alias("firsts"))
    placed = _placed(members.join(tiles, "tile").join(firsts, "sig"), sets)
    found = settle(_candidates(placed.withColumn("page", _page()), placed.where("comp <> big").withColumn("page", _every_page()), num, den), "found")
    more = settle(_verified(found, sets, num, den), "links")
    if figures is not None:
        figures |= {"followers": first.count(), "links": links.count(), "open_candidates": found.count(), "open_links": more.count()}
    if more.limit(1).count():
        comps = settle(components(links.unionByName(more)), "comps")
    return rows.join(comps.select(F.col("id").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, figures: dict | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs; `figures` takes how many candidates and links the R-trees gave."""
    rows = _grouped(docs, id_col, text_col, k, num, den, figures)
    lows = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    # Most components are one document; those of none at all don't meet.
    out = rows.join(lows.withColumn("some", F.lit(True)), (rows["component"] == lows["component"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component: the one of its smallest id, then of its smallest text hash; rows without an id come last.

    Documents are told apart by id and text, so an id that stands on several texts
    drops none of them for another's sake. Texts without words stay.
    """
    rows = settle(_grouped(docs, id_col, text_col, k, num, den).where("n > 0").groupBy("component", "doc_id", "copy").agg(F.count("*").alias("times")), "rows")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("best"), F.sum("times").alias("size")).where("size > 1")
    marked = rows.join(best, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("copy") == F.col("best.copy"))
    drop = settle(marked.where(~stays).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")), "drop")
    again = settle(marked.where(stays & (F.col("times") > 1)).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")), "again")
    same = lambda a, b: a[id_col].eqNullSafe(b["_id"]) & (F.xxhash64(a[text_col]) == b["_copy"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    drop = if_small(drop)
    kept = docs.join(drop, same(docs, drop), "left_anti").select(*columns)
    if not again.limit(1).count():
        return kept
    again = if_small(again)
    copies = kept.join(again, same(kept, again), "left_semi").withColumn(c := free_name(kept, "_copy_hash"), F.xxhash64(F.col(text_col))).dropDuplicates([id_col, c])
    return kept.join(again, same(kept, again), "left_anti").unionByName(copies.select(*columns))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def jaccard_sql(documents: str = "documents", k: int = 3, num: int = 90, den: int = 100) -> str:
    """DuckDB SQL for jaccard_components by brute force: every pair that shares a shingle is counted."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END)) AS x FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS same FROM s AS a JOIN s AS b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n AS u ON u.r = a JOIN n AS v ON v.r = b WHERE {den} * same >= {num} * (u.n + v.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(r, q) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON c.q = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN d AS o ON o.r = c.q GROUP BY c.r) AS m USING (r)"""
