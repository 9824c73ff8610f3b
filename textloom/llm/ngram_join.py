"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough.

Documents meet in tiles, and no similar pair is lost on the way:

1. Every document asks how many of its grams another one has. If fewer are shared than the bound demands, it is
   similar to none, and goes no further. Only 32 bits of a gram and its place in a block of documents are shuffled; a gram
   that several documents of a block have goes out once for them all.
2. Of equal sets one stands for all. The grams of those that are left are put in order of how many sets have them, rarest first.
   Sets of s grams with a Jaccard similarity of t have at least ceil(t * s) in common, so similar ones share a gram among their first
   s - ceil(t * s) + 1. Each of these grams that occurs elsewhere is a tile; in it, sets are sorted by size and compared with
   those in their size band alone, sizes that the bound allows. Tiles of more than `block` sets are cut into blocks, and each two
   blocks make a tile.
3. Each set has a bitmap of about two bits a gram, in which each gram flips the bit of its hash: the bits in which two
   bitmaps differ are fewer than the grams in which the sets differ, so they bound the overlap from above, and pairs that can't reach the bound go.
   Pairs that sets in between connect already needn't be compared here. What is left connects sets to groups.
4. In each group, again in size bands and after the bitmaps, sorted arrays are intersected, which gives the exact
   figures. Groups of more than `block` sets are compared in several tasks, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Blocks, Scatter, ask, block_bucket, block_reduce, block_schema, block_shuffle, bucket_of, found, joined, parts, ranges, settled, starts, table, texts_of
from .graph import components, merged

PAIRS = "doc_a long, doc_b long, size_a int, size_b int, overlap int, jaccard double"


@dataclass(frozen=True)
class Settings:
    n: int = 3  # words of a gram
    jaccard: float = 0.55
    #: Tiles and groups of more sets are compared in several tasks, block by block.
    block: int = 2000


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct gram hashes, offsets by text)."""
    w = K.words(texts)
    g, offsets = K.grams(w.hash, w.offsets, n)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], np.searchsorted(row[keep], np.arange(len(texts) + 1))


def widths(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set: two bits a gram, rounded up to a power of two."""
    return (1 << np.ceil(np.log2(np.maximum(sizes * 2, 64) / 64)).astype(np.int64)).astype(np.int64)


def bitmaps(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all bitmaps, offsets)."""
    sizes = np.diff(offsets)
    w = widths(sizes)
    at = np.concatenate([[0], np.cumsum(w)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = K.mix(g ^ np.uint64(0x5851F42D4C957F2D)) & (w[row].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    flips = np.bincount(at[:-1][row] * 64 + bit.astype(np.int64), minlength=at[-1] * 64).astype(np.uint8) & 1
    return np.packbits(flips, bitorder="little").view(np.uint64), at


class Bitmaps:
    """Bitmaps of several widths; two are compared at the lesser width, the wider one folded."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.width = widths(self.sizes)
        at = np.cumsum(self.width) - self.width
        self.of: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            a = words[at[own][:, None] + np.arange(w)]
            b = words[at[wider][:, None] + np.arange(2 * w)]
            self.of[w] = np.concatenate([a, b[:, :w] ^ b[:, w:]])
            place = np.full(len(sizes), -1)
            place[np.concatenate([own, wider])] = np.arange(len(own) + len(wider))
            self.place[w] = place

    def may(self, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        """Which of the pairs, whose sizes are in each other's band, the bit counts allow."""
        out = np.zeros(len(i), bool)
        total = self.sizes[i] + self.sizes[j]
        narrow = np.minimum(self.width[i], self.width[j])
        for w in np.unique(narrow).tolist():
            all_at = np.flatnonzero(narrow == w)
            for x in range(0, len(all_at), step := max(1, (1 << 20) // w)):
                at = all_at[x : x + step]
                m = self.of[w]
                differ = np.bitwise_count(m[self.place[w][i[at]]] ^ m[self.place[w][j[at]]]).sum(axis=1, dtype=np.int64)
                out[at] = reach((total[at] - differ) // 2, total[at], t)
        return out


def reach(overlap: np.ndarray, total: np.ndarray, t: float) -> np.ndarray:
    """Whether an overlap of sets with so many grams altogether is a Jaccard similarity of t."""
    return overlap * (1 + t) >= t * total - 1e-9


def banded_pairs(group: np.ndarray, sizes: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group whose sizes allow t; rows are sorted by group and size."""
    at = np.arange(len(group))
    lag = 1
    while len(at):
        at = at[at + lag < len(group)]
        at = at[(group[at + lag] == group[at]) & (sizes[at] >= t * sizes[at + lag] - 1e-9)]
        if len(at):
            yield at, at + lag
        lag += 1


def needed(sizes: np.ndarray, t: float) -> np.ndarray:
    """Grams that a set of so many has in common with any similar one, at least."""
    return np.ceil(t * sizes - 1e-9).astype(np.int64)


def digests(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; first: where each starts."""
    x = K.mix(g)
    return np.add.reduceat(x, first), np.bitwise_xor.reduceat(K.mix(x ^ np.uint64(0xA24BAED4963EE407)), first)


# ---- 1. which documents share enough grams with others

_GRAM = ["u4", "i4"]
_META = ["i8", "u8", "u8", "i4", "i8"]
_CREDIT = ["i4", "i4"]


def _columns(dtypes: list[str], name: str) -> str:
    return ", ".join(f"{name}{k} binary" for k in range(len(dtypes)))


_ASKED = f"bucket int, block long, {_columns(_GRAM, 'g')}, {_columns(_META, 'm')}"
_TOLD = f"bucket int, block long, {_columns(_CREDIT, 'c')}, {_columns(_META, 'm')}"


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the schema's columns, null where none is given."""
    n = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[k]) if name in columns else pa.nulls(n, kinds[k]) for name, k in fields], names=[name for name, _ in fields])


def _ask_shared(buckets: int, s: Settings):
    """Of each block of documents: its distinct grams (32 bits; place of the set in the block, or -1 if several have it), and what is known of its documents: doc, digests, size, and how many grams other sets of the block share, less those that are needed."""

    def block_rows(out: Blocks) -> Iterator[pa.RecordBatch]:
        number, (doc, one, two, size, grams) = out.take()
        # of equal sets in the block the first goes on
        _, first, of = np.unique(np.stack([one, two ^ size.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        rep = first[of.ravel()]
        row = np.repeat(np.arange(len(doc)), size)
        own = rep[row] == row
        g, row = grams[own], row[own]
        order = np.argsort(g)
        g, row = g[order], row[order]
        at = starts(g)
        many = np.diff(np.append(at, len(g)))
        shared = np.bincount(row[np.repeat(many > 1, many)], minlength=len(doc))
        credit = (shared - needed(size.astype(np.int64), s.jaccard))[rep]
        meta = [doc, one, two, size, credit]
        yield _rows(_ASKED, bucket=block_bucket(np.array([number]), buckets), block=[number], **{f"m{k}": [c.astype(d).tobytes()] for k, (c, d) in enumerate(zip(meta, _META, strict=True))})
        g, row = g[at], np.where(many > 1, -1, row[at])
        to = bucket_of(g, buckets)
        # by place, as the high bits of grams are at random: neighbours compress
        order = np.lexsort((row, to))
        g, row, to = g[order].astype(np.uint32), row[order].astype(np.int32), to[order]
        at = starts(to)
        cut = np.append(at, len(to))
        each = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        yield _rows(_ASKED, bucket=to[at], block=np.full(len(at), number), g0=[g[x:y].tobytes() for x, y in each], g1=[row[x:y].tobytes() for x, y in each])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blocks(buckets, ["i8", "u8", "u8", "i4", "u8"])
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in K.slices(texts):
                g, offsets = gram_sets(texts.slice(a, b - a), s.n)
                full = np.flatnonzero(np.diff(offsets))
                if len(full):
                    one, two = digests(g, offsets[full])
                    # filled by the number of grams, not of documents
                    out.held.append((ids[a:b][full], one, two, np.diff(offsets)[full].astype(np.int32), g))
                    out.n += len(g)
                    if out.n >= out.hold:
                        yield from block_rows(out)
        if out.n:
            yield from block_rows(out)

    return rows


def _tell_shared(buckets: int):
    """How many of a bucket's grams each set shares with sets of other blocks; what is known of the documents goes on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, row, block = [], [], []
        for batch in batches:
            known = np.flatnonzero(batch.column("m0").is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                x = batch.take(pa.array(known))
                yield _rows(_TOLD, **{n: x.column(n) for n in ("bucket", "block", *(f"m{k}" for k in range(len(_META))))})
            for i in np.flatnonzero(batch.column("g0").is_valid().to_numpy(zero_copy_only=False)).tolist():
                gram.append(np.frombuffer(batch.column("g0")[i].as_buffer(), np.uint32))
                row.append(np.frombuffer(batch.column("g1")[i].as_buffer(), np.int32))
                block.append(np.full(len(gram[-1]), batch.column("block")[i].as_py()))
        if not gram:
            return
        gram, row, block = (np.concatenate(c) for c in (gram, row, block))
        order = np.argsort(gram)
        at = starts(gram[order])
        many = np.diff(np.append(at, len(gram)))
        # a block asks for each of its grams once
        shared = order[np.repeat(many > 1, many)]
        block, row = block[shared], row[shared]
        mine = row >= 0
        block, row = block[mine], row[mine]
        order = np.lexsort((row, block))
        block, row = block[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
        credit = np.diff(np.append(new, len(row))).astype(np.int32)
        block, row = block[new], row[new]
        at = starts(block)
        cut = np.append(at, len(block))
        each = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        if each:
            yield _rows(_TOLD, bucket=block_bucket(block[at], buckets), block=block[at], c0=[row[x:y].tobytes() for x, y in each], c1=[credit[x:y].tobytes() for x, y in each])

    return rows


SHARING = "tl_doc long, tl_one long, tl_two long, tl_size int"


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block that share enough grams, with the digests of their sets."""
    known: dict[int, list[np.ndarray]] = {}
    credits: list[tuple[int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        valid = batch.column("m0").is_valid().to_pylist()
        for i, block in enumerate(batch.column("block").to_pylist()):
            if valid[i]:
                known[block] = [np.frombuffer(batch.column(f"m{k}")[i].as_buffer(), d) for k, d in enumerate(_META)]
            else:
                credits.append((block, *(np.frombuffer(batch.column(f"c{k}")[i].as_buffer(), d) for k, d in enumerate(_CREDIT))))
    more = {b: np.zeros(len(m[0]), np.int64) for b, m in known.items()}
    for block, row, credit in credits:
        more[block][row] += credit
    for block, (doc, one, two, size, credit) in known.items():
        # the first of equal sets was told for all of them
        _, first, of = np.unique(np.stack([one, two ^ size.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        at = first[of.ravel()]
        copies = np.bincount(at, minlength=len(doc))[at]
        take = (credit + more[block][at] >= 0) | (copies > 1)
        yield pa.RecordBatch.from_pydict({"tl_doc": doc[take], "tl_one": one[take].view(np.int64), "tl_two": two[take].view(np.int64), "tl_size": size[take]})


def sharing(own: DataFrame, s: Settings) -> DataFrame:
    """The documents that have a gram set in common with others, or share enough of it."""
    n = parts(own.sparkSession)
    asked = block_shuffle(own.mapInArrow(_ask_shared(n, s), _ASKED), n)
    told = block_shuffle(asked.mapInArrow(_tell_shared(n), _TOLD), n)
    return settled(told.mapInArrow(_sharing, SHARING))


# ---- 2. the rarest grams of each set

_SETS = ["i8", "u8", "i8", "i4", "u8"]


def _set_blocks(buckets: int, s: Settings):
    """Blocks of sets that stand for all equal ones: doc, digest, copies, size; grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blocks(buckets, _SETS)
        for batch in batches:
            ids, texts = batch.column("tl_doc").to_numpy(zero_copy_only=False), batch.column("tl_text")
            wanted = batch.column("tl_sets")
            for a, b in K.slices(texts):
                g, offsets = gram_sets(texts.slice(a, b - a), s.n)
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                one, two = digests(g, offsets[full])
                # a repeated key with another text: that one's set may be stood for elsewhere
                copies = np.array([next((c["copies"] for c in wanted[a + r].as_py() if (c["tl_one"], c["tl_two"]) == (x, y)), 0) for r, x, y in zip(full.tolist(), one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)], np.int64)
                take = copies > 0
                rows = full[take]
                if len(rows):
                    yield from out.add(int(size[rows].sum()), ids[a:b][rows], one[take], copies[take], size[rows], g[np.repeat(offsets[rows], size[rows]) + ranges(size[rows])])
        yield from out.flush()

    return rows


_POST = ["i8", "u8", "i4"]


def _prefixes(buckets: int, s: Settings):
    """Tiles that each set is in: its rarest grams, as far as others have them. A row for each set and bucket: doc, digest, size; bitmap and tiles."""

    def use(doc, digest, copies, size, grams, known, many) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(doc)), size)
        at, there = found(grams, known)
        df = np.ones(len(grams), np.int64)
        df[there] = many[at[there]]
        order = np.lexsort((grams, df, row))
        g, df = grams[order], df[order]
        head = ranges(size) < (size - needed(size.astype(np.int64), s.jaccard) + 1)[row]
        take = np.flatnonzero(head & (df > 1))
        g, df, row = g[take], df[take], row[take]
        # a tile of several blocks: one tile for each two of them
        blocks = -(-df // s.block)
        mine = (K.mix(digest)[row] % blocks.astype(np.uint64)).astype(np.int64)
        of = np.repeat(np.arange(len(g)), blocks)
        other = ranges(blocks)
        low, high = np.minimum(mine[of], other), np.maximum(mine[of], other)
        tile = K.mix(g[of] + K.mix((low << 32 | high).astype(np.uint64)))
        row, to = row[of], bucket_of(tile, buckets)
        order = np.lexsort((tile, to, row))
        tile, row, to = tile[order], row[order], to[order]
        if not len(tile):
            return
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])]))
        n = np.diff(np.append(first, len(tile)))
        offsets = np.concatenate([[0], np.cumsum(size)])
        words, word_at = bitmaps(grams, offsets)
        r = row[first]
        width = np.diff(word_at)[r]
        out = Scatter(buckets, _POST, long=True)
        for a in range(0, len(first), 1 << 14):
            x = slice(a, a + (1 << 14))
            total = width[x] + n[x]
            start = np.cumsum(total) - total
            run = np.empty(int(total.sum()), np.uint64)
            run[np.repeat(start, width[x]) + ranges(width[x])] = words[np.repeat(word_at[:-1][r[x]], width[x]) + ranges(width[x])]
            run[np.repeat(start + width[x], n[x]) + ranges(n[x])] = tile[np.repeat(first[x], n[x]) + ranges(n[x])]
            yield from out.add(to[first[x]], doc[r[x]], digest[r[x]], size[r[x]], run=(run, total))
        yield from out.flush()

    return use


def _gram_counts(doc, digest, copies, size, grams):
    """Distinct grams of a block, and how many of its sets have them."""
    return np.unique(grams, return_counts=True)


def _several(key, many):
    """The grams of several sets."""
    order = np.argsort(key)
    at = starts(key[order])
    total = np.add.reduceat(many[order], at)
    size = np.diff(np.append(at, len(key)))
    keep = np.repeat(total > 1, size)
    return order[keep], np.repeat(total, size)[keep]


# ---- 3. which sets the bitmaps connect


def _tiles(t: float):
    def reduce(doc, digest, size, many, run):
        width = widths(size.astype(np.int64))
        at = np.cumsum(many) - many
        maps = Bitmaps(run[np.repeat(at, width) + ranges(width)], size)
        n = many - width
        tile, row = run[np.repeat(at + width, n) + ranges(n)], np.repeat(np.arange(len(doc)), n)
        order = np.lexsort((digest[row], doc[row], size[row], tile))
        tile, row = tile[order], row[order]
        nodes, node = np.unique(doc, return_inverse=True)
        label = np.arange(len(nodes))
        for i, j in banded_pairs(tile, size[row], t):
            i, j = row[i], row[j]
            open_ = label[node[i]] != label[node[j]]
            i, j = i[open_], j[open_]
            if len(i):
                # a pair may meet in many tiles
                _, one = np.unique(i.astype(np.int64) << 32 | j, return_index=True)
                i, j = i[one], j[one]
                ok = maps.may(i, j, t)
                label = merged(label, node[i[ok]], node[j[ok]])
        rest = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_pydict({"a": nodes[rest], "b": nodes[label[rest]]})

    return reduce


# ---- 4. exact figures in the groups

_SET = ["i8", "i4", "i4", "i1", "i8", "u8", "i8"]


def _group_tiles(buckets: int, s: Settings):
    """The sets of the groups: group, the two blocks of the tile, whether it is of the second; doc, digest, copies, grams. A group of more than a block is cut into blocks by digest, and each two blocks make a tile."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Scatter(buckets, _SET, 1 << 18, long=True)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                doc, digest, copies, group, many = (part.column(n).to_numpy(zero_copy_only=False) for n in ("tl_doc", "digest", "copies", "tl_group", "tl_many"))
                digest = digest.view(np.uint64)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("grams")]
                size = np.array([len(x) for x in sets])
                g, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
                blocks = -(-many // s.block)
                mine = (K.mix(digest) % blocks.astype(np.uint64)).astype(np.int64)
                of = np.repeat(np.arange(len(doc)), blocks)
                other = ranges(blocks)
                low, high = np.minimum(mine[of], other), np.maximum(mine[of], other)
                at = K.mix(group[of].view(np.uint64) + K.mix((low << 32 | high).astype(np.uint64)))
                for x in range(0, len(of), 1 << 12):
                    y = slice(x, x + (1 << 12))
                    r = of[y]
                    yield from out.add(bucket_of(at[y], buckets), group[r], low[y], high[y], mine[r] != low[y], doc[r], digest[r], copies[r], run=(g[np.repeat(offsets[r], size[r]) + ranges(size[r])], size[r]))
        yield from out.flush()

    return rows


class _Tile(NamedTuple):
    """Sets of several tiles, sorted by tile and size."""

    tile: np.ndarray
    apart: np.ndarray  # whether the tile is of two blocks
    second: np.ndarray
    doc: np.ndarray
    copies: np.ndarray
    size: np.ndarray
    grams: np.ndarray  # numbers of the grams among those of these tiles
    kinds: int
    maps: Bitmaps


def _tile_of(group, low, high, second, doc, digest, copies, size, grams) -> _Tile:
    at = np.cumsum(size) - size
    order = np.lexsort((digest, doc, size, high, low, group))
    # a row that is repeated comes twice
    same = np.ones(len(order), bool)
    same[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (group, low, high, size, doc, digest)])
    order = order[same]
    group, low, high, second, doc, copies, size, at = (c[order] for c in (group, low, high, second, doc, copies, size.astype(np.int64), at))
    tile = np.cumsum(np.concatenate([[0], ((group[1:] != group[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])).astype(np.int64)]))
    flat = grams[np.repeat(at, size) + ranges(size)]
    maps = Bitmaps(bitmaps(flat, np.concatenate([[0], np.cumsum(size)]))[0], size)
    kinds, number = np.unique(flat, return_inverse=True)
    return _Tile(tile, low != high, second, doc, copies, size, number.astype(np.int32), len(kinds), maps)


def _similar_sets(x: _Tile, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of similar sets of one tile, by exact intersection: each set's grams are marked, and its partners' sorted arrays are looked up in the marks."""
    n = len(x.tile)
    # sets are sorted by size: a set's partners are those behind it up to its size band's end
    key = x.tile * (1 << 40) + x.size
    end = np.searchsorted(key, x.tile * (1 << 40) + np.floor(x.size / t + 1e-9).astype(np.int64), "right")
    many = end - np.arange(n) - 1
    offsets = np.concatenate([[0], np.cumsum(x.size)])
    mark = np.zeros(x.kinds, bool)
    done = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(done, done[a] + (1 << 18), "right")) - 1)
        i = np.repeat(np.arange(a, b), many[a:b])
        j = i + 1 + ranges(many[a:b])
        # a tile of two blocks has the pairs of one from each
        fit = (~x.apart[i] | (x.second[i] != x.second[j])) & (x.doc[i] != x.doc[j])
        i, j = i[fit], j[fit]
        ok = x.maps.may(i, j, t)
        i, j = i[ok], j[ok]
        first = starts(i)
        overlap = np.zeros(len(i), np.int64)
        for p, q in zip(first.tolist(), np.append(first[1:], len(i)).tolist(), strict=True):
            own = x.grams[offsets[i[p]] : offsets[i[p] + 1]]
            mark[own] = True
            to = j[p:q]
            for c in range(0, len(to), step := max(1, (1 << 22) // int(x.size[to].max()))):
                part = to[c : c + step]
                size = x.size[part]
                hits = mark[x.grams[np.repeat(offsets[part], size) + ranges(size)]]
                overlap[p + c : p + c + len(part)] = np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
            mark[own] = False
        ok = reach(overlap, x.size[i] + x.size[j], t)
        yield i[ok], j[ok], overlap[ok]
        a = b


def _pair_rows(s: Settings):
    def reduce(*columns):
        x = _tile_of(*columns)
        for i, j, overlap in _similar_sets(x, s.jaccard):
            swap = x.doc[j] < x.doc[i]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_pydict({"doc_a": x.doc[i], "doc_b": x.doc[j], "size_a": x.size[i].astype(np.int32), "size_b": x.size[j].astype(np.int32), "overlap": overlap.astype(np.int32), "jaccard": overlap / (x.size[i] + x.size[j] - overlap)})

    return reduce


LINKS = "node long, root long, texts long, docs long, jaccard double, nearest long"


def _link_rows(s: Settings):
    """For each set of a tile that is similar to others: the least document that such pairs connect it with, how many texts and documents it is similar to, and the nearest."""

    def reduce(*columns):
        x = _tile_of(*columns)
        n = len(x.tile)
        texts, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best, nearest = np.zeros(n), np.full(n, np.iinfo(np.int64).max)
        nodes, node = np.unique(x.doc, return_inverse=True)
        label = np.arange(len(nodes))
        for i, j, overlap in _similar_sets(x, s.jaccard):
            jaccard = overlap / (x.size[i] + x.size[j] - overlap)
            for p, q in ((i, j), (j, i)):
                texts += np.bincount(p, minlength=n)
                np.add.at(docs, p, x.copies[q])
                order = np.lexsort((x.doc[q], -jaccard, p))
                first = order[starts(p[order])]
                at, far, other = p[first], jaccard[first], x.doc[q[first]]
                better = (far > best[at]) | ((far == best[at]) & (other < nearest[at]))
                best[at[better]], nearest[at[better]] = far[better], other[better]
            label = merged(label, node[i], node[j])
        at = np.flatnonzero(texts)
        yield pa.RecordBatch.from_pydict({"node": x.doc[at], "root": nodes[label[node[at]]], "texts": texts[at], "docs": docs[at], "jaccard": best[at], "nearest": nearest[at]})

    return reduce


# ---- the whole


class _Meeting(NamedTuple):
    members: DataFrame  # doc, digests and size of the sets that share enough, one row for each set of a document
    sets: DataFrame  # digests, size: rep (the least document that has it), copies
    tiles: DataFrame  # the groups' sets, as a Scatter has them
    n: int


def _meeting(docs: DataFrame, s: Settings, key: str, text: str) -> _Meeting:
    n = parts(docs.sparkSession)
    own = texts_of(docs, key, text)
    members = sharing(own, s).distinct()
    sets = settled(members.groupBy("tl_one", "tl_two", "tl_size").agg(F.min("tl_doc").alias("rep"), F.count("*").alias("copies")))
    reps = sets.groupBy(F.col("rep").alias("tl_doc")).agg(F.collect_set(F.struct("tl_one", "tl_two", "copies")).alias("tl_sets"))
    blocks = settled(joined(own, reps, "tl_doc").select("tl_doc", "tl_text", "tl_sets").mapInArrow(_set_blocks(n, s), block_schema(_SETS)))
    posted = ask(blocks, n, _SETS, _gram_counts, ["i4"], _several, ["i4"], _prefixes(n, s), Scatter(n, _POST, long=True).schema)
    edges = settled(block_reduce(posted, n, [*_POST, "i4", "u8"], _tiles(s.jaccard), "a long, b long"))
    groups = settled(components(edges))
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("tl_many")), "component").select(F.col("node").alias("tl_doc"), F.col("component").alias("tl_group"), "tl_many")
    every = blocks.mapInArrow(_each_set, "tl_doc long, digest long, copies long, grams binary")
    tiles = joined(every, sized, "tl_doc").select("tl_doc", "digest", "copies", "grams", "tl_group", "tl_many").mapInArrow(_group_tiles(n, s), Scatter(n, _SET, long=True).schema)
    return _Meeting(members, sets, tiles, n)


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            doc, digest, copies, size = (np.frombuffer(batch.column(f"b{k}")[i].as_buffer(), d) for k, d in enumerate(_SETS[:4]))
            grams = batch.column("b4")[i].as_buffer()
            ends = np.concatenate([[0], np.cumsum(size.astype(np.int64))]) * 8
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(digest.view(np.int64)), pa.array(copies), pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), grams]).cast(pa.binary())], names=["tl_doc", "digest", "copies", "grams"])


def similar(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of distinct gram sets with a Jaccard similarity of at least settings.jaccard: all of them, one row each.

    doc_a < doc_b are the least documents that have either set; classes() says which others do. Texts of fewer than n words
    have one gram, all their words; null and empty texts, and texts without words, are similar to nothing; rows without a key take no part. Of
    a key that is repeated with different texts each text is compared with those of other keys."""
    m = _meeting(docs, settings, key, text)
    return block_reduce(m.tiles, m.n, [*_SET, "i4", "u8"], _pair_rows(settings), PAIRS)


def classes(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document that is similar to another: doc_id, class_id, n_copies, n_texts, n_links, nearest_id, nearest_jaccard.

    class_id is the least document that similar pairs connect it with, itself perhaps. n_copies: other documents with the
    same gram set; n_texts: different sets that are similar to its own; n_links: other documents that are similar, copies and all. The
    nearest of different sets is named by the least document that has it; null, with null for its similarity, if there is none. Nothing is thinned out:
    groups of copies just aren't written as pairs. What counts as similar is as in similar(); a key that is repeated with different texts is in
    one class with what is similar to any of them, and its figures are those of its texts together."""
    m = _meeting(docs, settings, key, text)
    links = settled(block_reduce(m.tiles, m.n, [*_SET, "i4", "u8"], _link_rows(settings), LINKS))
    of_doc = m.members.join(m.sets.hint("shuffle_hash"), ["tl_one", "tl_two", "tl_size"]).select("tl_doc", "rep", "copies")
    several = m.members.groupBy("tl_doc").agg(F.count("*").alias("n")).where("n > 1").select("tl_doc")
    bound = of_doc.join(several, "tl_doc", "left_semi")
    edges = links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    edges = edges.union(bound.join(bound.groupBy("tl_doc").agg(F.min("rep").alias("least")), "tl_doc").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    named = components(edges)
    each = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"), F.min(F.struct((-F.col("jaccard")).alias("far"), "nearest")).alias("near"))
    about = named.join(each, "node", "full_outer").withColumnRenamed("node", "rep")
    rows = of_doc.join(about.hint("shuffle_hash"), "rep", "left").where("copies > 1 or texts is not null")
    return (
        rows.groupBy(F.col("tl_doc").alias("doc_id"))
        .agg(
            F.min(F.coalesce("component", "rep")).alias("class_id"),
            F.sum(F.col("copies") - 1).alias("n_copies"),
            F.sum(F.coalesce("texts", F.lit(0))).alias("n_texts"),
            F.sum(F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
            F.min("near").alias("near"),
        )
        .select("doc_id", "class_id", "n_copies", "n_texts", "n_links", F.col("near.nearest").alias("nearest_id"), (-F.col("near.far")).alias("nearest_jaccard"))
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is similar to another, with its class and the number of its links."""
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similar pairs connect, the one with the least doc_id; the others unchanged."""
    gone = settled(classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("tl_doc"), F.lit(True).alias("tl_gone")))
    names = docs.columns
    own = docs.select(*[docs[c].alias(f"tl_c{k}") for k, c in enumerate(names)], docs["doc_id"].cast("long").alias("tl_doc"))
    return joined(own, gone, "tl_doc", "left").where("tl_gone is null").select(*[F.col(f"tl_c{k}").alias(c) for k, c in enumerate(names)])
