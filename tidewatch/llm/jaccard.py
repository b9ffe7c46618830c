"""N-gram Jaccard join with count-vector R-trees.

Two texts link when their sets of word shingles have a Jaccard similarity of 0.75 or more. Shingles are hashed
into groups; a text's counts per group are a point, and the sum of two points' coordinate minima bounds their
overlap from above. R-trees of such points are joined node by node, and pairs that the bound leaves are
verified on the sets themselves.

With some hundred coordinates no tree separates random texts of a whole corpus, so trees are built over
families: texts that could link because they share enough of their lowest-hashed shingles (any linked pair
must). Families of any size fall into tiles of bounded weight, and tiles of one family are joined with each
other only as far as earlier links leave them apart.

Families are made in steps that are linear in the keys. A key of at most LIGHT texts pairs them (at most
(LIGHT - 1) / 2 pairs per occurrence). A commoner key is never expanded: a text with too few light keys links to
the nodes of the rarest of its common ones, as many as an exact bound asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, mix, ngram_hashes, release_memory, slices, text_slices, word_hashes
from tidewatch.llm.components import connected_components

SHINGLE = 5
#: A shingle of at most so many texts pairs these directly; a text made of commoner ones belongs to a crowd.
LIGHT = 5
#: Texts and shingles in a tile, and texts that all tiles of one large family share so that their links meet.
TILE, TILE_SHINGLES, ANCHORS = 1024, 250_000, 32
LEAF, FANOUT = 16, 8
#: Keys that are dealt at once, keys of a partition, and flushes that meet in one group.
FLUSH_KEYS, PART_KEYS, FAN = 400_000, 300_000, 512
#: Memberships of common keys in a row, and tasks that one key's memberships are dealt to where they meet its count.
MEMBERS, SALTS = 20_000, 16
#: Texts in families are told to all tasks up to this number (16 bytes each); beyond, by a join.
BROADCAST_DOCS = 400_000
#: Bytes of text hashed at once (a longer text alone), and rows.
HASH_BYTES, HASH_ROWS = 500_000, 1000


def spare(n: np.ndarray) -> np.ndarray:
    """Keys beyond the necessary prefix, as a function of the set size; linked sets share as many, by the smaller."""
    return np.maximum(1, -(-n // 5))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """A set's lowest hashes in which it shares `spare` with any set it links to: n - ceil(0.75 n) + spare."""
    return np.minimum(n, n // 4 + spare(n))


def shingle_sets(texts: list[str | bytes | None]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; the whole text is one if it has fewer words than a shingle."""
    for at, end in slices(texts, HASH_BYTES, len(texts)):
        hashes, _, _, counts = word_hashes(texts[at:end], lower=True)
        grams = ngram_hashes(hashes, SHINGLE)
        first = 0
        for n in counts:
            if n >= SHINGLE:
                yield np.unique(grams[first : first + n - SHINGLE + 1])
            else:
                yield ngram_hashes(hashes[first : first + n], n) if n else np.empty(0, np.uint64)
            first += n


_COPY = np.uint64(0xA0761D6478BD642F)


def _planes(values: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones: equal high bytes then compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _batch(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in text_slices(batches, HASH_BYTES, HASH_ROWS):
        n, one, two = np.empty(len(texts), np.int64), np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64)
        for k, s in enumerate(shingle_sets(texts)):
            n[k], one[k], two[k] = len(s), mix(s + _COPY).sum(dtype=np.uint64), mix(s ^ _COPY).sum(dtype=np.uint64)
        yield _batch({"doc_id": piece.column(0), "n": n, "c1": one.view(np.int64), "c2": two.view(np.int64)})


# --- dealing keys to partitions ---------------------------------------------------------------

_CHUNK = "part int, salt int, keys binary, docs binary, sizes binary, marks binary, members binary"
_FOUND = "common boolean, a long, b long, n long"


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _chunks(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, marks: np.ndarray, parts: list[int] | None, n_parts: int, salt: int) -> pa.RecordBatch:
    """Rows of _CHUNK: the keys that few texts have, by partition, and memberships (text, key) of the others.

    parts: the only partitions of these keys, if known. What is known to be common needn't meet anywhere, so its
    memberships go to any partition.
    """
    order = np.argsort(keys, kind="stable")
    keys, docs, sizes = keys[order], docs[order], sizes[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    reps = np.diff(np.append(first, len(keys)))
    known = (reps > LIGHT) | np.isin(keys[first], marks)
    marks = np.union1d(marks, keys[first[known]])
    common = np.repeat(known, reps)
    rest, rest_docs, rest_sizes = keys[~common], docs[~common], sizes[~common]
    rows: list[tuple] = []
    own = np.arange(n_parts) if parts is None else np.array(parts)
    low, high = own.astype(np.uint64), (own + 1).astype(np.uint64)
    of, of_marks = _part_of(rest, n_parts), _part_of(marks, n_parts)
    for p, a, b, c, d in zip(own.tolist(), np.searchsorted(of, low), np.searchsorted(of, high), np.searchsorted(of_marks, low), np.searchsorted(of_marks, high)):
        if b > a or d > c:
            rows.append((p, salt, _planes(rest[a:b]), _planes(rest_docs[a:b]), _planes(rest_sizes[a:b]), marks[c:d].tobytes(), None))
    spread, spread_docs = keys[common], docs[common]
    for k, a in enumerate(range(0, len(spread), MEMBERS)):
        pair = np.stack([spread_docs[a : a + MEMBERS].view(np.uint64), spread[a : a + MEMBERS]])
        to = mix(pair[0, :1] + np.uint64(k))[0] % np.uint64(n_parts)  # not by salt and place: all flushes would meet in the same few
        rows.append((int(to), salt, None, None, None, None, pair.tobytes()))
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    kinds = [pa.int32()] * 2 + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _deal(parts: int, salts: int):
    """Prefix keys of texts as rows of _CHUNK, a flush of FLUSH_KEYS at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int, int, np.ndarray]] = []
        size, flush = 0, TaskContext.get().partitionId()

        def flushed() -> pa.RecordBatch:
            counts = [len(k) for _, _, k in held]
            return _chunks(np.concatenate([k for _, _, k in held]), np.repeat(np.array([d for d, _, _ in held], np.int64), counts),
                           np.repeat(np.array([n for _, n, _ in held], np.int32), counts), np.empty(0, np.uint64), None, parts, flush % salts)

        for piece, texts in text_slices(batches, HASH_BYTES, HASH_ROWS):
            for d, s in zip(piece.column(0).to_pylist(), shingle_sets(texts)):
                if len(s):
                    held.append((d, len(s), s[: int(prefix_length(np.int64(len(s))))].copy()))
                    size += len(held[-1][2])
                if size >= FLUSH_KEYS:
                    yield flushed()
                    held, size, flush = [], 0, flush + 1
        if held:
            yield flushed()
        release_memory()

    return run


def _read_chunks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(keys, texts, set sizes, known common keys, packed memberships) of a group of chunks."""
    held = lambda c: [x for x in table.column(c).to_pylist() if x is not None]
    cat = lambda c, kind: np.concatenate([_from_planes(x, kind) for x in held(c)] or [np.empty(0, kind)])
    return cat("keys", np.uint64), cat("docs", np.int64), cat("sizes", np.int32), np.unique(np.frombuffer(b"".join(held("marks")), np.uint64)), held("members")


def _merge_chunks(parts: int, fan: int):
    """A group's chunks as one: keys that are common among them are told apart before more of them meet."""
    def run(table: pa.Table) -> pa.Table:
        part, salt = table.column("part")[0].as_py(), table.column("salt")[0].as_py() // fan
        keys, docs, sizes, marks, members = _read_chunks(table)
        made = _chunks(keys, docs, sizes, marks, [part], parts, salt)
        rows = [{"part": part, "salt": salt, "members": m} for m in members]
        return pa.concat_tables([pa.Table.from_batches([made]), pa.Table.from_pylist(rows, schema=made.schema)])

    return run


def _members(packed: bytes) -> dict[str, np.ndarray]:
    docs, keys = np.frombuffer(packed, np.int64).reshape(2, -1)
    return {"common": np.ones(len(docs), bool), "a": docs, "b": keys, "n": np.ones(len(docs), np.int64)}


def _pair_up(table: pa.Table) -> pa.Table:
    """A partition's keys: pairs of texts (with the number of shared light keys), and memberships of common keys."""
    keys, docs, sizes, marks, packed = _read_chunks(table)
    out = [_batch(_members(m)) for m in packed]
    order = np.argsort(keys, kind="stable")
    keys, docs, sizes = keys[order], docs[order], sizes[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    reps = np.diff(np.append(first, len(keys)))
    common = (reps > LIGHT) | np.isin(keys[first], marks)
    spread = np.repeat(common, reps)
    out.append(_batch(_members(np.stack([docs[spread], keys[spread].view(np.int64)]).tobytes())))
    pairs = []
    for c in range(2, LIGHT + 1):
        at = first[(reps == c) & ~common]
        if len(at):
            d, s = docs[at[:, None] + np.arange(c)], sizes[at[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            fit = (3 * np.maximum(s[:, i], s[:, j]) <= 4 * np.minimum(s[:, i], s[:, j])) & (d[:, i] != d[:, j])
            pairs.append(np.stack([np.minimum(d[:, i], d[:, j])[fit], np.maximum(d[:, i], d[:, j])[fit]], axis=1))
    if pairs:
        every = np.concatenate(pairs)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        new = np.flatnonzero(np.concatenate(([True], (every[1:] != every[:-1]).any(axis=1)))) if len(every) else np.empty(0, np.int64)
        out.append(_batch({"common": np.zeros(len(new), bool), "a": every[new, 0], "b": every[new, 1], "n": np.diff(np.append(new, len(every)))}))
    return pa.Table.from_batches(out)


# --- the R-tree join of one tile --------------------------------------------------------------


class RTree:
    """Count vectors packed by sort-tile-recursive order; leaves and the nodes above them know their largest counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.order = self._pack(counts, sizes)
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_n, high_n, width = self.counts, self.sizes, self.sizes, LEAF
        while True:
            at = np.arange(0, len(high), width)
            high, low_n, high_n = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            self.levels.append((high, low_n, high_n))
            width = FANOUT
            if len(high) == 1:
                break

    @staticmethod
    def _pack(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(sizes)
        wide = np.argsort(-counts.var(axis=0), kind="stable")[:2]
        slabs = max(1, round((n / LEAF) ** (1 / 3)))
        order = np.argsort(sizes, kind="stable")
        out = []
        for slab in np.array_split(order, slabs):
            slab = slab[np.argsort(counts[slab, wide[0]], kind="stable")]
            out += [run[np.argsort(counts[run, wide[-1]], kind="stable")] for run in np.array_split(slab, slabs)]
        return np.concatenate(out)

    def children(self, level: int, node: int) -> range:
        width = FANOUT if level else LEAF
        n = len(self.levels[level - 1][0]) if level else len(self.sizes)
        return range(node * width, min(n, (node + 1) * width))

    def leaf_pairs(self, other: RTree) -> Iterator[tuple[int, int]]:
        """Leaves of both trees whose boxes may hold a linked pair; for a tree with itself, each pair once."""
        top = (len(self.levels) - 1, 0, len(other.levels) - 1, 0)
        stack = [top]
        while stack:
            la, a, lb, b = stack.pop()
            ha, lo_a, hi_a = (x[a] for x in self.levels[la])
            hb, lo_b, hi_b = (x[b] for x in other.levels[lb])
            if 3 * lo_a > 4 * hi_b or 3 * lo_b > 4 * hi_a or 7 * int(np.minimum(ha, hb).sum()) < 3 * (int(lo_a) + int(lo_b)):
                continue
            if la == lb == 0:
                if self is not other or a <= b:
                    yield a, b
            elif self is other and la == lb and a == b:
                kids = list(self.children(la, a))
                stack += [(la - 1, x, lb - 1, y) for k, x in enumerate(kids) for y in kids[k:]]
            elif la >= lb:
                stack += [(la - 1, x, lb, b) for x in self.children(la, a)] if la > lb else [(la - 1, x, lb - 1, y) for x in self.children(la, a) for y in other.children(lb, b)]
            else:
                stack += [(la, a, lb - 1, y) for y in other.children(lb, b)]


class _Roots:
    """Union-find over places; the root of a set is its first place."""

    def __init__(self, roots: np.ndarray) -> None:
        self.root = roots

    def join(self, a: int, b: int) -> None:
        x, y = sorted((self.root[a], self.root[b]))
        if x != y:
            self.root[self.root == y] = x


def link_sets(sets: list[np.ndarray], known: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """Verified links that join all components of the sets: a spanning forest of links, not all pairs.

    known: equal numbers mark sets whose component is known to be one. split: only pairs across this place.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    groups = 1 << int(np.clip(np.log2(max(np.median(sizes), 1)) - 1, 4, 8))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * groups + (mix(flat) & np.uint64(groups - 1)).astype(np.int64), minlength=n * groups).reshape(n, groups).astype(np.int32)
    ids = np.unique(flat, return_inverse=True)[1]
    begin = np.cumsum(sizes) - sizes
    flag = np.zeros(ids.max() + 1 if len(ids) else 1, dtype=bool)
    roots = _Roots(np.arange(n) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]])
    links: list[tuple[int, int]] = []
    parts = [np.arange(n)] if split is None else [np.arange(split), np.arange(split, n)]
    trees = [RTree(counts[p], sizes[p]) for p in parts]
    one, two = trees[0], trees[-1]
    map_one, map_two = parts[0][one.order], parts[-1][two.order]
    for a, b in one.leaf_pairs(two):
        left, right = map_one[list(one.children(0, a))], map_two[list(two.children(0, b))]
        for i in left:
            js = right[right != i]
            if split is None and a == b:
                js = js[js > i]
            js = js[roots.root[js] != roots.root[i]]
            if not len(js):
                continue
            bound = np.minimum(counts[js], counts[i]).sum(axis=1)
            js = js[7 * bound >= 3 * (sizes[js] + sizes[i])]
            if not len(js):
                continue
            mine = ids[begin[i] : begin[i] + sizes[i]]
            flag[mine] = True
            for j in js:
                if roots.root[i] != roots.root[j] and 7 * int(flag[ids[begin[j] : begin[j] + sizes[j]]].sum()) >= 3 * (sizes[i] + sizes[j]):
                    links.append((int(i), int(j)))
                    roots.join(i, j)
            flag[mine] = False
    return links


def _no_links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _tile_links(table: pa.Table) -> pa.Table:
    """Links within each (family, tile) of a group of rows (doc_id, family, tile, text)."""
    out: list[tuple[int, int]] = []
    ids, family, tile = (table.column(c).to_numpy() for c in ("doc_id", "family", "tile"))
    texts = table.column("text")
    order = np.lexsort((ids, tile, family))
    cuts = np.flatnonzero((np.diff(family[order]) != 0) | (np.diff(tile[order]) != 0)) + 1
    for own in np.split(order, cuts):
        own = own[np.concatenate(([True], np.diff(ids[own]) != 0))] if len(own) else own
        sets = list(shingle_sets(texts.take(pa.array(own)).to_pylist()))
        out += [(int(ids[own[i]]), int(ids[own[j]])) for i, j in link_sets(sets)]
    release_memory()
    return _no_links(out)


def _cross_links(table: pa.Table) -> pa.Table:
    """Links between the two tiles of a pair (rows doc_id, component, side, text), or inside a tile paired with itself."""
    ids, side, component = (table.column(c).to_numpy() for c in ("doc_id", "side", "component"))
    order = np.lexsort((ids, side))
    own = order[np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(side[order]) != 0)))]
    split = int((side[own] == 0).sum())
    if not split:
        return _no_links([])
    sets = list(shingle_sets(table.column("text").take(pa.array(own)).to_pylist()))
    links = link_sets(sets, component[own], None if split == len(own) else split)
    release_memory()
    return _no_links([(int(ids[own[i]]), int(ids[own[j]])) for i, j in links])


def _texts(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The texts of the given documents."""
    return docs.join(F.broadcast(members) if n <= BROADCAST_DOCS else members, "doc_id")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's set size and component: doc_id, n_shingles, component_id, class_id.

    component_id: the smallest doc_id that links reach, itself included; class_id: the smallest doc_id with the
    same set. Shingles are five words, A-Z in lower case; fewer words are one shingle; without words or text a
    set is empty and links with nothing. doc_id must be an integer; rows without one link through their text
    and have a null component if no other row has that set. Repeated rows give equal rows, an empty table an
    empty result. Different texts under one doc_id are one node: what any of them links to is the component of all,
    so rows should be told apart by unique ids (as the corpus pipeline does). Tasks hold texts of a tile (TILE texts, TILE_SHINGLES shingles, or a single text) whatever the
    input's size. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = scratch.keep(source.mapInArrow(_sketches, "doc_id long, n long, c1 long, c2 long"), "sketch", shuffled=False)
    classes = scratch.keep(sketch.filter("n > 0 and doc_id is not null").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("class_id")), "classes")
    source = source.filter("doc_id is not null and text is not null")
    links = _links(source, sketch, classes, scratch)
    components = connected_components(links, scratch)
    known = classes.join(components, classes["class_id"] == components["node"], "left").select(
        "n", "c1", "c2", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    own = sketch.select("doc_id", "n", "c1", "c2")
    out = own.join(known, ["n", "c1", "c2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = scratch.keep(out, "result")
    scratch.drop_all_but(out)
    return out


def _node(kind: str, col: str) -> Column:
    """A node of the graph of families. Equal numbers of two nodes would only make a larger family."""
    return F.xxhash64(F.lit(kind), col)


def _found_keys(reps: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of _FOUND: pairs of texts by light keys, and (text, key) of common keys."""
    n_keys = int(prefix_length(np.int64(classes.agg(F.sum("n")).first()[0] or 0)))
    parts, flushes = max(12, n_keys // PART_KEYS), max(1, 2 * n_keys // FLUSH_KEYS)
    salts = -(-flushes // FAN)  # a key sends LIGHT rows a flush at most; groups of FAN flushes meet first
    chunks = reps.mapInArrow(_deal(parts, salts), _CHUNK)
    while salts > 1:  # not written to a table: Parquet's reader holds thousands of rows at once, and these are large
        chunks = chunks.groupBy("part", "salt").applyInArrow(_merge_chunks(parts, FAN), _CHUNK)
        salts = -(-salts // FAN)
    return scratch.keep(chunks.groupBy("part").applyInArrow(_pair_up, _FOUND), "found")


def _families(reps: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Texts that might link to another one: doc_id, n, family."""
    found = _found_keys(reps, classes, scratch)
    least = lambda n: F.greatest(F.lit(1), F.ceil(n / 5))  # noqa: E731  as spare()
    common = found.filter("common").groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("h"))
    facts = scratch.keep(classes.select(F.col("class_id").alias("doc_id"), "n").join(common, "doc_id", "left").select(
        "doc_id", "n", F.coalesce("h", F.lit(0)).alias("h"), least(F.col("n")).alias("t"), least(F.ceil(F.col("n") * 3 / 4)).alias("t_least")), "facts")
    one = facts.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"), F.col("t").alias("ta"))
    two = facts.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"), F.col("t").alias("tb"))
    pairs = found.filter("not common").groupBy("a", "b").agg(F.sum("n").alias("s")).join(one, "a").join(two, "b")
    pairs = pairs.filter("s + least(ha, hb) >= least(ta, tb)").select(_node("text", "a").alias("u"), _node("text", "b").alias("v"))
    # In the order light keys, then common ones from the rarest, linked sets share a key among the first
    # |prefix| - t_least + 1: a text needs its h - t_least + 1 rarest common keys.
    held = found.filter("common").select(F.col("a").alias("doc_id"), F.col("b").alias("key"))
    crowd = scratch.keep(held.join(facts.filter("h >= t_least").select("doc_id", (F.col("h") - F.col("t_least") + 1).alias("first")), "doc_id"), "crowd")
    counts = crowd.groupBy("key").agg(F.count("*").alias("texts"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("texts", "key"))
    salted = counts.filter("texts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a key may be in a third of all texts
    stars = crowd.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left").withColumn("texts", F.coalesce("texts", F.lit(1))).withColumn("rank", rank).filter("rank <= first")
    links = pairs.union(stars.filter("texts > 1").select(_node("text", "doc_id").alias("u"), _node("key", "key").alias("v")))
    family = scratch.keep(connected_components(links, scratch), "family")
    scratch.drop(found, crowd)
    return facts.select("doc_id", "n", _node("text", "doc_id").alias("node")).join(family, "node").select("doc_id", "n", F.col("root").alias("family"))


def _links(source: DataFrame, sketch: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links between class representatives that join each component."""
    copies = sketch.filter("n > 0").join(classes, ["n", "c1", "c2"]).filter("doc_id <> class_id").select("doc_id").distinct()
    copies = scratch.keep(copies.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_anti"), "copies")
    reps = source.join(F.broadcast(copies) if copies.count() <= BROADCAST_DOCS else copies, "doc_id", "left_anti")
    known = _families(reps, classes, scratch)
    sizes = known.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1")
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("weight") / TILE_SHINGLES)).cast("int")
    members = scratch.keep(known.join(sizes, "family").select("doc_id", "n", "family", "size", "weight", tiles.alias("tiles")), "members")
    n_members, weight, most = members.agg(F.count("*"), F.sum("n"), F.max("tiles")).first()
    tile = F.pmod(F.xxhash64("doc_id"), "tiles").cast("int")
    anchor = (F.col("tiles") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("size") / ANCHORS).cast("int")) == 0)
    placed = members.withColumn("tile", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(tile))))
    groups = max(12, 2 * (weight or 0) // TILE_SHINGLES)
    bucket = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.xxhash64("family", "tile")).alias("bucket")
    texts = _texts(source, placed.select("doc_id", "family", "tile", bucket), n_members or 0)
    links = scratch.keep(texts.groupBy("bucket").applyInArrow(_tile_links, "u long, v long"), "tile-links")
    if (most or 0) <= 1:
        return links
    more = _cross_tile_links(source, members.filter("tiles > 1"), links, scratch)
    return links.union(more)


def _cross_tile_links(source: DataFrame, members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between texts of large families that no link joins yet.

    A family whose tiles have grown into one component is done. Of others, components as heavy as a tile are cut
    by themselves and the rest by bands of set sizes, and tiles meet if sizes allow links between them: linked
    sizes are within 4/3 of each other, so bands are neighbours or equal.
    """
    roots = connected_components(links, scratch).withColumnRenamed("node", "doc_id")
    own = members.join(roots, "doc_id", "left").select("doc_id", "n", "family", F.coalesce("root", "doc_id").alias("component"))
    own = scratch.keep(own, "apart")
    sizes = own.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    open_ = sizes.groupBy("family").agg(F.count("*").alias("k")).filter("k > 1")
    big = (F.col("c") >= TILE) | (F.col("w") >= TILE_SHINGLES)
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    placed = own.join(sizes, ["family", "component"]).join(open_, "family").select(
        "doc_id", "n", "family", "component", F.when(big, F.col("component")).alias("whole"), band.alias("band"))
    widths = placed.groupBy("family", "whole", "band").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("width"))
    same = (F.col("p.family") == F.col("q.family")) & F.col("p.whole").eqNullSafe(F.col("q.whole")) & (F.col("p.band") == F.col("q.band"))
    placed = placed.alias("p").join(widths.alias("q"), same).select("p.*", F.pmod(F.xxhash64("doc_id"), "width").cast("int").alias("tile"))
    spot = F.xxhash64(F.coalesce("whole", F.lit(-1)), F.isnull("whole"), "band", "tile", "family")
    placed = scratch.keep(placed.withColumn("spot", spot), "placed")
    tiles = placed.groupBy("family", "spot").agg(F.first("whole").alias("whole"), F.first("band").alias("band"))
    a = tiles.select("family", F.col("spot").alias("x"), F.col("whole").alias("wx"), "band")
    b = tiles.select("family", F.col("spot").alias("y"), F.col("whole").alias("wy"), F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    pairs = a.join(b, ["family", "band"]).filter("(x < y and not (wx <=> wy and wx is not null)) or (x = y and wx is null)").select(
        "x", "y", F.xxhash64("family", "x", "y").alias("pair"))
    sides = pairs.select("pair", F.col("x").alias("spot"), F.lit(0).alias("side")).union(pairs.filter("x != y").select("pair", F.col("y").alias("spot"), F.lit(1).alias("side")))
    work = scratch.keep(placed.join(sides, "spot").select("doc_id", "component", "pair", "side"), "work")
    texts = _texts(source, work, work.count())
    found = scratch.keep(texts.groupBy("pair").applyInArrow(_cross_links, "u long, v long"), "cross-links")
    scratch.drop(own, placed, work)
    return found


#: The same in SQL, by all pairs of texts that share a shingle.
ORACLE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE MIN(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM s), e AS (SELECT doc_id, UNNEST(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, CAST(ANY_VALUE(n) AS BIGINT) AS n_shingles, MIN(root) AS component_id, ANY_VALUE(class_id) AS class_id FROM n JOIN r USING (doc_id) GROUP BY doc_id"""
