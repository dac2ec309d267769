"""Operator 2: n-gram Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct 5-word shingles (as 64-bit hashes); two link
when 4 * intersection >= 3 * union, that is when their sets differ in at most
(|r| + |s|) / 7 shingles. Documents of equal sets are one class and join once.

* Bands: sizes [2^b, 2^(b+1)) share one partition of the universe into segments, a
  few more than the largest difference H allows. A class is also partitioned as the
  band above does if it is large enough to have a partner there.
* Pigeonhole: if r differs from s in each of H + 1 segments, they cannot link. So a
  link shows in any H + 1 non-empty segments of the smaller set, as equal content.
* Index: each non-empty segment gives a key of its content. Keys are dealt to buckets
  in packed blocks; a bucket tells each class which of its keys others share. A class
  with more than m - H unshared segments has no partner and leaves the join here.
* Cost-based allocation: unshared segments count at no cost; what is missing to
  H + 1 is taken from the shared keys with the fewest sharers. Popular segments
  (common passages) are thus avoided wherever something rarer can be used.
* One-deletion neighbourhoods: small sets index their segments less one shingle too.
  A set whose shingles fell into fewer than H + 1 segments probes these, each such
  segment then standing for two differences. What still lacks some (a handful of tiny
  sets) is joined by single shingles, |r| / 4 + 1 of them.
* Groups of near copies: keys first offer their members one leader (the most central
  class, then one that differs by key); linked members unite, and only pairs of
  different components are candidates after that. Members that share a leader (the
  pivot), near or not, are measured against what most of them hold: counts alone, and the rarest
  of what they hold besides, rule out nearly all pairs that the leader did not unite. A key with
  many members around several pivots does not join them: they meet by their rarest shingles.
  Every candidate left is verified, so no link between components is lost.
* Verification intersects the two whole sets of a pair, if their parity sketches do not rule the
  link out: a bit of a sketch tells whether an odd number of shingles fell there, so two sets differ in
  at least as many shingles as their sketches in bits.
* Each kind of candidates is written apart: one plan of all would be planned and described anew
  after each of its stages, in the driver's memory.
* Texts travel once, and only those of classes that may have a partner (and a few that share their
  mark in a bitmap of fixed size): a task drops the others before the shuffle.

Edge cases: words are cut at ASCII white space after lower-casing A-Z; fewer than five
words are one shingle; a null, empty or blank text has no set, links with nothing and
is its own component; equal rows link; a null document id takes part, but names no
component unless it is alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, expanded, identified, raw, slices, squeezed, stored
from runlake.llm.components import components

WIDTH = 5
SLACK = 1.2
#: Sets up to this size index one-deletion neighbourhoods.
SMALL = 63
BUCKET_KEYS = 1_000_000
#: A key with more classes than this in one slice of a task is known to be shared there.
LOCAL_SHARED = 64
#: Shingles whose signatures a task computes at once.
AT_ONCE = 1 << 17
#: A key joins its two sides as such if their pairs are at most so many times its rows.
FEW = 8
#: Bits that mark rows wanted; they bound what is broadcast (4 MB), not what is found.
MARKS = 1 << 25
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLACES = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and the bounds."""
    digest, sets, n = xxhash.xxh3_64_intdigest, [], []
    for t in texts:
        ws = t.lower().split()  # bytes: A-Z only, and ASCII white space only
        h = np.fromiter(map(digest, ws), np.uint64, len(ws))
        if len(h) >= WIDTH:
            s = h[:len(h) - WIDTH + 1] * _PLACES[0]
            for i in range(1, WIDTH):
                s = s + h[i:len(h) - WIDTH + 1 + i] * _PLACES[i]
            s = np.unique(mix(s))
        elif len(h):
            s = mix((h * _PLACES[:len(h)]).sum(keepdims=True) + _U(len(h)))
        else:
            s = h
        sets.append(s)
        n.append(len(s))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def set_hashes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, equal for equal sets (0 for the empty one)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ _U(0x5851F42D4C957F2D)))])
    n = np.diff(bounds)
    return np.where(n > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)), _U(0)).view(np.int64)


def segments(u: np.ndarray) -> np.ndarray:
    """Segments of the band with largest size ``u``."""
    return np.ceil(SLACK * (2 * u // 7 + 1)).astype(np.int64) + 2


class Signatures:
    """Keys of some classes: key, class, flags (bit 0: partitioned as the band above does,
    bit 1: a one-deletion neighbour) and lack = H + 1 - non-empty segments."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, cls: np.ndarray):
        n = np.diff(bounds)
        parts, short = [], []
        for above in (0, 1):
            band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
            low = 1 << (band + above)
            u = 2 * low - 1
            bound = (n + np.minimum(u, 4 * n // 3)) // 7  # H of this class, with partners no smaller
            live = (n > 0) & (bound > 0) & ((4 * n // 3 >= low) if above else True)
            pick = np.flatnonzero(live)
            if not len(pick):
                continue
            m = segments(u[pick])
            first = np.cumsum(m) - m
            size = n[pick]
            take = np.repeat(bounds[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            t = tokens[take]
            owner = np.repeat(np.arange(len(pick)), size)
            seg = ((t >> _U(20)) % m[owner].astype(np.uint64)).astype(np.int64) + first[owner]
            mixed = mix(t + _U(0x9E3779B97F4A7C15))
            content = np.zeros(m.sum(), np.uint64)
            np.add.at(content, seg, mixed)
            count = np.bincount(seg, minlength=len(content))
            place = np.arange(len(content)) - np.repeat(first, m)
            # a segment's name: its band and its place in it
            name = mix(place.astype(np.uint64) + (np.repeat(u[pick], m).astype(np.uint64) << _U(32)))
            whole = np.flatnonzero(count)
            holder = np.repeat(np.arange(len(pick)), m)
            filled = np.bincount(holder[whole], minlength=len(pick))
            lack = bound[pick] + 1 - filled
            parts.append((mix(content[whole] + name[whole]), cls[pick][holder[whole]],
                          np.full(len(whole), above, np.int32), lack[holder[whole]]))
            small = np.flatnonzero((size[owner] <= SMALL) & (count[seg] > 1))
            if len(small):
                s = seg[small]
                parts.append((mix(content[s] - mixed[small] + name[s]), cls[pick][owner[small]],
                              np.full(len(small), above + 2, np.int32), lack[owner[small]]))
            doubled = np.bincount(holder[(count > 1)], minlength=len(pick)) * (size <= SMALL)
            short.append(pick[lack > doubled])
        join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        self.keys, self.cls = join(0, np.uint64), join(1, np.int64)
        self.flags, self.lack = join(2, np.int32), join(3, np.int64)
        #: classes that even the neighbourhoods do not give H + 1 differences
        self.short = np.unique(np.concatenate(short)) if short else np.zeros(0, np.int64)


def signatures(tokens: np.ndarray, bounds: np.ndarray, cls: np.ndarray, pick: np.ndarray, at_once: int = AT_ONCE):
    """Which sets, and their signatures: those of ``pick``, some at a time (about ``at_once`` shingles, one set
    at least). So what a task holds besides the keys follows the longest text, not its slice."""
    size = np.diff(bounds)[pick]
    part = (np.cumsum(size) - size) // at_once
    for some in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(part)) + 1) if len(pick) else ():
        n = size[some]
        take = np.repeat(bounds[pick[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield pick[some], Signatures(tokens[take], np.concatenate([[0], np.cumsum(n)]), cls[pick[some]])


BLOCK = "bucket bigint, place bigint, low binary, slot binary, cls binary, traits binary"
SHARED = "cls bigint, above boolean, deleted boolean, lack int, key bigint, sharers bigint, sharers_x bigint"


def _packed(rows: np.ndarray, bucket: np.ndarray, place: np.ndarray, keys: np.ndarray, run: np.ndarray,
            cls: np.ndarray, traits: np.ndarray) -> pa.RecordBatch:
    """A block for each place: of every key its low 32 bits and a slot, of every slot its class and traits."""
    by = rows[np.argsort(place[rows], kind="stable")]
    at, of = place[by], run[by]
    start = np.ones(len(by), bool)
    start[1:] = at[1:] != at[:-1]
    fresh = start.copy()
    fresh[1:] |= of[1:] != of[:-1]
    cut, slots = np.flatnonzero(start), np.flatnonzero(fresh)
    begin = np.searchsorted(slots, cut)  # of each block, its first slot
    slot = np.cumsum(fresh) - 1 - np.repeat(begin, np.diff(np.append(cut, len(by))))
    kind = "<u2" if len(slot) == 0 or slot.max() < 1 << 16 else "<u4"

    def glued(values, starts):
        ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])

    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[by[cut]].astype(np.int64)), pa.array(at[cut].astype(np.int64)), glued(keys[by].astype("<u4"), cut), glued(slot.astype(kind), cut),
         glued(cls[of[slots]].astype("<i8"), begin), glued(traits[of[slots]].astype("<i4"), begin)],
        ["bucket", "place", "low", "slot", "cls", "traits"])


def _index(batches, buckets: int):
    """Blocks of keys for each bucket, with their classes and traits (flags | lack << 2); keys
    known to be shared go to a pseudo-bucket below 0, but for two rows that tell the others.
    Within a bucket 32 bits name a key: two that coincide count as shared, no more than that."""
    for batch in slices(batches, "text", 8 << 20):
        tokens, bounds = shingle_sets(raw(batch.column(0)))
        cls = set_hashes(tokens, bounds)
        _, once = np.unique(cls, return_index=True)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        parts = [none], [none]  # whole segments, and those less one: of a key's rows, whole ones tell the others
        for _, sig in signatures(tokens, bounds, cls, once):
            traits = (sig.flags | (sig.lack.astype(np.int32) << 2)).astype(np.int32)
            for deleted in (0, 1):
                rows = np.flatnonzero((sig.flags >> 1) == deleted)
                parts[deleted].append((sig.keys[rows], sig.cls[rows], traits[rows]))
        tag = int(cls[0]) % 97
        del tokens
        keys, cls, traits = (np.concatenate(x) for x in zip(*parts[0], *parts[1]))
        del parts
        change = np.ones(len(keys), bool)
        change[1:] = (cls[1:] != cls[:-1]) | (traits[1:] != traits[:-1])
        run, cls, traits = np.cumsum(change, dtype=np.int32) - np.int32(1), cls[change], traits[change]
        place = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        width = np.diff(np.append(edge, len(k)))
        del k
        many = np.repeat(width > LOCAL_SHARED, width)
        hot = np.zeros(len(keys), bool)
        hot[order] = many
        many[edge] = False
        many[(edge + 1)[width > 1]] = False  # all but two of a key that many hold
        told = np.ones(len(keys), bool)
        told[order] = ~many
        del order, edge, width, many
        known = -1 - (place * np.int64(31) + tag) % buckets  # spread over pseudo-buckets
        for rows, bucket in ((np.flatnonzero(told), place), (np.flatnonzero(hot), known)):
            yield _packed(rows, bucket, place, keys, run, cls, traits)


def _share(table: pa.Table) -> pa.Table:
    """Of a bucket: the rows whose key another class has too, with how many do."""
    low, slot, cls, traits = ([np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
                              for name, kind in (("low", "<u4"), ("slot", "u1"), ("cls", "<i8"), ("traits", "<i4")))
    slot = [x.view("<u2" if len(x) == 2 * len(y) else "<u4") for x, y in zip(slot, low)]
    many = [len(x) for x in low]
    base = np.cumsum([0, *map(len, cls)])[:-1]
    at = np.concatenate([np.zeros(0, np.int64), *slot]).astype(np.int64) + np.repeat(base, many).astype(np.int64)
    keys = np.concatenate([np.zeros(0, np.uint32), *low]).astype(np.uint64)
    keys |= np.repeat(table.column("place").to_numpy(), many).astype(np.uint64) << _U(32)
    cls = np.concatenate([np.zeros(0, np.int64), *cls])[at]
    packed = np.concatenate([np.zeros(0, np.int32), *traits])[at]
    known = bool(len(keys)) and table.column("bucket")[0].as_py() < 0
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    if not known:
        twice = np.zeros(len(k), bool)
        twice[1:] = k[1:] == k[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
    order = order[np.lexsort((packed[order], cls[order], keys[order]))]
    k, c, p = keys[order], cls[order], packed[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    k, c, p = k[new], c[new], p[new]
    group = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1 if len(k) else np.zeros(0, np.int64)
    deleted = (p & 2) > 0
    first = np.ones(len(k), bool)  # of a class, a key and a kind
    first[1:] = (group[1:] != group[:-1]) | (c[1:] != c[:-1]) | (deleted[1:] != deleted[:-1])
    whole = np.bincount(group[first & ~deleted], minlength=group[-1] + 1 if len(k) else 0)
    less = np.bincount(group[first & deleted], minlength=len(whole))
    others = whole[group] - ~deleted
    others_x = np.where(deleted, 0, less[group])
    keep = (others > 0) | (others_x > 0) | known
    if known:
        others, others_x = np.maximum(others, 1), others_x
    return pa.table({"cls": c[keep], "above": (p[keep] & 1) > 0, "deleted": deleted[keep],
                     "lack": (p[keep] >> 2).astype(np.int32), "key": k[keep].view(np.int64),
                     "sharers": others[keep].astype(np.int64), "sharers_x": others_x[keep].astype(np.int64)})


def parities(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of all sets, in words of 64 bits one after the other, and the bounds. A set has at least
    a bit a shingle, their number a power of two; folding the halves makes the next smaller sketch."""
    n = np.diff(bounds)
    bits = np.left_shift(np.int64(64), np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    place = ((tokens >> _U(20)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(at[:-1], n)
    odd = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8"), at // 64


def _sets(batches):
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
    for batch in slices(batches, "text", 1 << 20):
        tokens, bounds = shingle_sets(expanded(batch.column(2)))
        words, at = parities(tokens, bounds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int32)),
                                          lists(at, words), lists(bounds, tokens)], ["cls", "keyed", "n", "parity", "tokens"])


def _mark():
    return F.pmod(F.xxhash64(*ROW_ID), F.lit(MARKS)).cast("long")


def _marks(rids: DataFrame) -> np.ndarray:
    """A bitmap of ``MARKS`` bits with those of the rows ``rids`` set."""
    size = 32768  # bits of one of Spark's bitmaps
    parts = (rids.select(_mark().alias("mark")).groupBy(F.floor(F.col("mark") / size).alias("part"))
             .agg(F.bitmap_construct_agg(F.col("mark") % size).alias("bits")))
    out = np.zeros((MARKS // size, size // 8), np.uint8)
    for part, bits in parts.collect():
        out[part] = np.frombuffer(bytes(bits), np.uint8)
    return out.ravel()


def _marked(batches, marks: np.ndarray):
    """The rows whose bit (``mark``, the last column) is set, without it."""
    for batch in batches:
        mark = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        kept = batch.filter(pa.array((marks[mark >> 3] >> (mark & 7).astype(np.uint8) & 1) > 0))
        yield kept.select(range(batch.num_columns - 1))


def _rows(batches):
    for batch in slices(batches, "text"):
        tokens, bounds = shingle_sets(raw(batch.column(3)))
        cls = set_hashes(tokens, bounds)
        short = np.zeros(len(cls), bool)
        for some, sig in signatures(tokens, bounds, cls, np.arange(len(cls))):
            short[some[sig.short]] = True
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds)),
                                          pa.array(cls), pa.array(short)],
                                         ["rid_file", "rid_row", "doc_id", "n_shingles", "cls", "short"])


#: Of a measured pair: 4 * intersection >= 3 * union.
LINK = "4 * i >= 3 * (na + nb - i)"


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with their sizes na, nb and the intersection i of their whole sets."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    return two.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"),
                      F.size(F.array_intersect("ta", "tb")).alias("i"))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches allow a link: sets that link differ in
    at most (na + nb) / 7 shingles. By sizes one sketch is at most twice as long as the other."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    differ = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))

    def folded(x, other):
        half = F.size(other)
        return F.when(F.size(x) > half, differ(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half))).otherwise(F.col(x))

    bits = F.aggregate(differ(folded("pa", "pb"), folded("pb", "pa")), F.lit(0), lambda n, w: n + F.bit_count(w))
    return (pairs.join(side("a"), "a").filter("na > 0").join(side("b"), "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)")
            .filter(7 * bits <= F.col("na") + F.col("nb")).select("a", "b"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""
    return common(stored(likely(pairs, sets), "likely-pairs"), sets).filter(LINK).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _across(probes: DataFrame, places: DataFrame, members: DataFrame, pivot: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates by key in two components whose pivots differ (a class without one is its own).
    Only a key with few of one side or the other is joined as such: its pairs are at most
    ``FEW`` times its rows. The classes of all other keys meet by their rarest shingles."""
    known = stored(members.join(pivot.select("cls", "pivot"), "cls", "left").withColumn("pivot", F.coalesce("pivot", "cls")), "members-pivots")
    p = probes.select("key", "cls", "deleted", "doubled").join(known, "cls")
    q = places.select("key", "cls", "deleted").join(known, "cls")
    # both sides: a set that probes the band above does not lie in that band's places
    both = (p.select("key", "pivot", "label", F.lit(1).alias("p"), F.lit(0).alias("q"))
            .unionByName(q.select("key", "pivot", "label", F.lit(0).alias("p"), F.lit(1).alias("q"))))
    spread = both.groupBy("key").agg(F.min("pivot").alias("lo"), F.max("pivot").alias("hi"), F.min("label").alias("l"),
                                     F.max("label").alias("h"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    keep = stored(spread.filter("lo <> hi and l <> h and p > 0 and q > 0").select("key", F.expr(f"p * q > {FEW} * (p + q)").alias("many")), "keys-across")
    p, q = stored(p.join(keep, "key"), "probes-across"), stored(q.join(keep, "key"), "places-across")
    crowd = p.filter("many").select("cls", "pivot", "label").unionByName(q.filter("many").select("cls", "pivot", "label")).distinct()
    p, q = p.filter("not many"), q.filter("not many")
    sides = (p.select("key", F.col("pivot").alias("pp"), F.col("label").alias("pl")).distinct()
             .join(q.select("key", F.col("pivot").alias("qp"), F.col("label").alias("ql")).distinct(), "key")
             .filter("pp <> qp and pl <> ql"))
    out = (sides.join(p.select("key", F.col("pivot").alias("pp"), F.col("label").alias("pl"), F.col("cls").alias("pc"),
                               F.col("deleted").alias("pd"), "doubled"), ["key", "pp", "pl"])
           .join(q.select("key", F.col("pivot").alias("qp"), F.col("label").alias("ql"), F.col("cls").alias("qc"),
                          F.col("deleted").alias("qd")), ["key", "qp", "ql"]))
    # whole with whole always; whole with less one, either way, for classes that count such segments twice
    out = stored(out.filter("not (pd and qd) and (doubled or not (pd or qd))").select(*_pair("pc", "qc")).distinct(), "pairs-by-key")
    if keep.filter("many").isEmpty():
        return out
    return out.unionByName(stored(_crowded(crowd, sets), "pairs-of-crowds"))


def _crowded(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates among the classes (cls, pivot, label) of keys that many hold, in two components
    and around two pivots. Linked sets share three quarters of either, so if r's shingles are
    ordered by how many hold them, one of the rarest ``own - ceil(3 n / 4) + 1`` of the ``own``
    that classes of another pivot hold too is shared; and behind the first one that two share
    there must be enough on both sides. A passage that all have is thus no reason to meet."""
    held = crowd.join(sets.select("cls", "tokens"), "cls").select("cls", "pivot", "label", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    token = (held.groupBy("token").agg(F.count("*").alias("c"), F.min("pivot").alias("lo"), F.max("pivot").alias("hi"))
             .filter("lo <> hi").select("token", "c"))
    each = (held.join(token, "token").groupBy("cls", "pivot", "label", "n")
            .agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared")))  # part of the set
    least = F.expr("size(shared) - cast(ceil(3 * n / 4) as int) + 1")
    rare = (each.filter(least > 0).select("cls", "pivot", "label", "n", F.size("shared").alias("own"), F.posexplode(F.slice("shared", F.lit(1), least)).alias("nth", "s"))
            .select("cls", "pivot", "label", "n", (F.col("own") - F.col("nth")).alias("rest"), F.col("s.token").alias("token")))
    side = lambda x: rare.select("token", *[F.col(c).alias(f"{c}_{x}") for c in rare.columns if c != "token"])
    return (side("r").join(side("s"), "token")
            .filter("label_r < label_s and pivot_r <> pivot_s and 7 * least(rest_r, rest_s) >= 3 * (n_r + n_s)")
            .select(*_pair("cls_r", "cls_s")).distinct())


def _around(members: DataFrame, pivot: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates in two components around one pivot. Let L hold the shingles that more than
    half of the group have, more = s \\ L and less = L \\ s. r and s differ in the symmetric
    differences of their mores and of their lesses. So either they share a shingle that L
    has not, or |more_r| + |more_s| + ||less_r| - |less_s|| must not exceed the largest
    difference of a link. The first is a prefix-filtered join: the rarest of a member's
    shared extras, less the overlap that every partner must have, bounded by the counts.
    The second is joined by counts (cells of equal more and less). So members that cannot
    link are hardly enumerated. Any grouping is right; a group of near copies is cheap."""
    own = pivot.select(F.col("pivot").alias("cls")).distinct().withColumn("pivot", F.col("cls"))
    # a pivot may itself have another pivot: it then stands in both groups
    group = pivot.select("cls", "pivot").unionByName(own).distinct().join(members, "cls")
    mixed = group.groupBy("pivot").agg(F.min("label").alias("l"), F.max("label").alias("h"),
                                       F.count("*").alias("size")).filter("l <> h").select("pivot", "size")
    group = stored(group.join(mixed, "pivot"), "pivot-groups")
    held = group.join(sets.select("cls", "tokens"), "cls").select("pivot", "cls", "label", "size", F.explode("tokens").alias("token"))
    token = (held.groupBy("pivot", "token").agg(F.count("*").alias("c"), F.first("size").alias("size"),
                                                F.min("label").alias("l"), F.max("label").alias("h"))
             .select("pivot", "token", "c", (2 * F.col("c") > F.col("size")).alias("usual"), (F.col("l") != F.col("h")).alias("several")))
    usual = token.filter("usual").groupBy("pivot").agg(F.count("*").alias("usual"))
    each = (held.select("pivot", "cls", "label", "token").join(token, ["pivot", "token"]).groupBy("pivot", "cls", "label")
            .agg(F.count("*").cast("int").alias("n"), F.count_if("usual").cast("int").alias("kept"),
                 F.sort_array(F.collect_list(F.when(F.col("several") & ~F.col("usual"), F.struct("c", "token")))).alias("extra"))  # part of the set
            .join(usual, "pivot", "left"))
    group = stored(each.select("pivot", "cls", "label", "n", (F.col("n") - F.col("kept")).alias("more"),
                               (F.coalesce("usual", F.lit(0)) - F.col("kept")).cast("int").alias("less"), "extra"), "pivot-counts")
    cell = ["pivot", "label", "n", "more", "less"]
    side = lambda t, x: t.select("pivot", *[F.col(c).alias(f"{c}_{x}") for c in t.columns if c != "pivot"])
    # more_r alone must not exceed the largest difference, n_r / 3
    few = group.filter("3 * more <= n")
    cells, rows = few.select(*cell).distinct(), few.select(*cell, "cls")
    near = side(cells, "r").join(side(cells, "s"), "pivot").filter(
        "label_r < label_s and 7 * (more_r + more_s + abs(less_r - less_s)) <= n_r + n_s")
    on = lambda x: ["pivot", *[f"{c}_{x}" for c in cell[1:]]]
    close = stored(near.join(side(rows, "r"), on("r")).join(side(rows, "s"), on("s")).select(*_pair("cls_r", "cls_s")).distinct(), "pairs-by-counts")
    # partners of r share at least more_r - n_r / 3 of its extras, so one of its rarest others plus one
    needed = F.greatest(F.lit(1), F.ceil(F.col("more") - F.col("n") / 3)).cast("int")
    held_back = F.greatest(F.lit(0), F.size("extra") - needed + 1).cast("int")
    extra = group.select(*cell, "cls", F.size("extra").alias("own"), F.posexplode(F.slice("extra", F.lit(1), held_back)).alias("nth", "e"))
    # of two that share extras, the first shared one has all others behind it on both sides
    extra = extra.select(*cell, "cls", (F.col("own") - F.col("nth")).alias("rest"), F.col("e.token").alias("token"))
    share = (side(extra, "r").withColumnRenamed("token_r", "token")
             .join(side(extra, "s").withColumnRenamed("token_s", "token"), ["pivot", "token"])
             .filter("label_r < label_s and 7 * (more_r + more_s - 2 * least(rest_r, rest_s) + abs(less_r - less_s)) <= n_r + n_s")
             .select(*_pair("cls_r", "cls_s")).distinct())
    return close.unionByName(stored(share, "pairs-by-extras"))


def _one_group(pivot: DataFrame) -> DataFrame:
    """Groups (cls, pivot) from (cls, pivot, near): pivots that are near to pivots of their own
    are taken as one, so that a large group's members meet by counts and rare extras, and not
    by the keys of several pivots."""
    chain = pivot.filter("near").join(pivot.select(F.col("pivot").alias("cls")).distinct(), "cls")
    if chain.isEmpty():
        return pivot.select("cls", "pivot")
    root = components(chain, "cls", "pivot").select(F.col("v").alias("pivot"), F.col("label").alias("root"))
    return stored(pivot.join(root, "pivot", "left").select("cls", F.coalesce("root", "pivot").alias("pivot"))
                  .filter("cls <> pivot"), "groups")


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (cls, label) after uniting the labels that ``links`` (a, b: labels) join."""
    if links.isEmpty():
        return members
    new = components(links).select(F.col("v").alias("label"), F.col("label").alias("united"))
    return stored(members.join(new, "label", "left").select("cls", F.coalesce("united", "label").alias("label")), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: rid_file, rid_row, doc_id, n_shingles, cls (equal sets),
    label (the component's smallest class; blank rows share one), component_id (smallest document id reachable by links)."""
    texts = identified(docs, id_col, text_col)
    texts = texts.select(*ROW_ID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(texts.mapInArrow(_rows, "rid_file bigint, rid_row bigint, doc_id bigint, n_shingles bigint, "
                                          "cls bigint, short boolean"), "shingle-rows")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(max(32, total * 0.7 // bucket_keys))
    index = texts.select("text").mapInArrow(lambda b: _index(b, buckets), BLOCK)
    shared = stored(index.groupBy("bucket").applyInArrow(_share, SHARED), "shared-keys")

    # cost-based allocation: how many units are missing, and the cheapest keys that give them
    own = Window.partitionBy("cls", "above")
    unit = (~F.col("deleted") & (F.col("sharers") > 0)).cast("int")
    ranked = (shared.withColumn("need", F.col("lack") + F.sum(unit).over(own))
              .filter((F.col("need") > 0) | (F.col("lack") > 0))
              .withColumn("nth", F.row_number().over(own.orderBy(F.col("deleted"), F.col("sharers") == 0, "sharers", "key"))))
    probing = F.when(F.col("lack") > 0, F.lit(True)).otherwise(~F.col("deleted") & (F.col("nth") <= F.col("need")))
    keys = stored(ranked.select("cls", "above", "deleted", "key", (F.col("lack") > 0).alias("doubled"), "need",
                                probing.alias("probe")), "chosen-keys")
    probes, places = keys.filter("probe"), keys.filter("not above").select("cls", "deleted", "key", "need")

    # sets of the classes still in play, from one row each, in one pass with those that
    # sets of too few segments may link with
    alive = keys.select("cls").distinct()
    wanted = alive.withColumn("keyed", F.lit(True))
    span = rows.filter("short").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")).first()
    if span["lo"] is not None:
        near = rows.filter((F.col("n_shingles") * 4 >= 3 * span["lo"]) & (F.col("n_shingles") * 3 <= 4 * span["hi"]))
        wanted = wanted.unionByName(near.select("cls", F.lit(False).alias("keyed"))).groupBy("cls").agg(F.max("keyed").alias("keyed"))
    reps = (rows.join(wanted, "cls").groupBy("cls").agg(F.min(F.struct(*ROW_ID)).alias("rid"), F.first("keyed").alias("keyed"))
            .select("cls", "keyed", "rid.*"))
    reps = stored(reps, "wanted-rows")
    marks = docs.sparkSession.sparkContext.broadcast(_marks(reps))
    every = stored(texts.select(*ROW_ID, "text", _mark().alias("mark"))
                   .mapInArrow(lambda b: squeezed(_marked(b, marks.value)), "rid_file bigint, rid_row bigint, text binary")
                   .join(reps, [*ROW_ID]).select("cls", "keyed", "text")
                   .mapInArrow(_sets, "cls bigint, keyed boolean, n int, parity array<bigint>, tokens array<bigint>"), "shingle-sets")
    marks.destroy()
    sets, fallback = every.filter("keyed").drop("keyed"), None
    if span["lo"] is not None:
        size = F.size("tokens")
        tiny = every.filter((size * 4 >= 3 * span["lo"]) & (size * 3 <= 4 * span["hi"]))
        fallback = stored(_by_shingle(tiny, rows), "short-pairs")
        alive = alive.unionByName(fallback.select(F.col("a").alias("cls"))).unionByName(fallback.select(F.col("b").alias("cls"))).distinct()

    members = stored(alive.select("cls", F.col("cls").alias("label")), "members")
    whole = places.filter("not deleted").select("key", "cls", "need")
    # first each key's most central class leads: it has the fewest segments of its own
    lead = whole.groupBy("key").agg(F.min(F.struct((-F.col("need")).alias("r"), "cls")).alias("lead")).select("key", F.col("lead.cls").alias("lead"))
    led = whole.join(lead, "key").filter("cls <> lead").groupBy("cls", "lead").agg(F.count("*").alias("k"))
    # a class's pivot: of the leaders of at least half as many of its keys as any other, the
    # one that leads most classes, so that a group has few pivots
    led = stored(led, "leaders")
    best = led.groupBy("cls").agg(F.max(F.struct("k", "lead")).alias("best"))
    votes = best.groupBy(F.col("best.lead").alias("lead")).agg(F.count("*").alias("votes"))
    led = led.join(best, "cls").filter("2 * k >= best.k").select("cls", "lead", "k").join(votes, "lead")
    led = stored(led.groupBy("cls").agg(F.max(F.struct("votes", "k", "lead")).alias("best"))
                 .select("cls", F.col("best.lead").alias("pivot")), "led")
    measured = stored(common(led.select(*_pair("cls", "pivot")).distinct(), sets), "measured")
    members = _relabel(members, _between(measured.filter(LINK).select("a", "b"), members))
    pivot = led.select("cls", "pivot", *_pair("cls", "pivot")).join(measured, ["a", "b"])
    pivot = _one_group(stored(pivot.select("cls", "pivot", F.expr("i >= 0.4 * (na + nb - i)").alias("near")), "pivots"))
    # then a leader that differs by key, for the members whose component is another
    tagged = whole.join(members, "cls")
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    other = tagged.join(mixed, "key").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "cls").alias("r"), "cls", "label")).alias("lead"))
    star = (probes.filter("not deleted").select("key", "cls").join(members, "cls").join(other, "key").filter("label <> lead.label")
            .select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct())
    members = _relabel(members, _between(linked(stored(star, "pairs-by-leader"), sets), members))
    if fallback is not None:
        members = _relabel(members, _between(linked(fallback, tiny), members))

    left = _across(probes, places, members, pivot, sets).unionByName(_around(members, pivot, sets)).distinct()
    members = _relabel(members, _between(linked(left, sets), members))

    marked = rows.join(members, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    marked = marked.select(*ROW_ID, "doc_id", "n_shingles", "cls", "label")
    smallest = marked.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = marked.filter("n_shingles > 0").join(smallest, "label")
    blank = marked.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = [*ROW_ID, "doc_id", "n_shingles", "cls", "label", "component_id"]
    return named.select(*out).unionByName(blank.select(*out))


def _between(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) of classes as links of their labels."""
    la = members.select(F.col("cls").alias("a"), F.col("label").alias("la"))
    lb = members.select(F.col("cls").alias("b"), F.col("label").alias("lb"))
    return stored(links.join(la, "a").join(lb, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "label-links")


def _by_shingle(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate pairs of the classes whose segments are too few: partners share one of the
    |r| / 4 + 1 shingles of r and one of the |s| / 4 + 1 of s that fewest sets have, so a
    common shingle meets only where a set has hardly any other. ``sets``: all of a size that
    can be a partner."""
    short = rows.filter("short").select("cls").distinct()
    every = sets.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    every = every.join(every.groupBy("t").agg(F.count("*").alias("c")), "t")
    rare = Window.partitionBy("cls").orderBy("c", "t")  # part of one small set
    every = every.withColumn("nth", F.row_number().over(rare)).filter("nth <= floor(n / 4) + 1 and c > 1").select("cls", "n", "t")
    probe = every.join(short, "cls", "left_semi").select(F.col("cls").alias("r"), F.col("n").alias("nr"), "t")
    return (probe.join(every.select(F.col("cls").alias("s"), F.col("n").alias("ns"), "t"), "t")
            .filter("r <> s and 4 * least(nr, ns) >= 3 * greatest(nr, ns)")
            .select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct())
