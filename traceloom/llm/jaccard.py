"""Near duplicates by the Jaccard similarity of word shingles: every pair at `SIMILAR` or more is found.

A text is the set of its shingles' 64-bit hashes. In any one order of all shingles, two sets of n and m whose
similarity is 4/5 share one of the first n - ceil(4n/5) + 1 of the one and of the first m - ceil(4m/5) + 1 of the
other. Only these prefixes are joined; sizes and places in the prefix rule out most pairs, the others are compared
whole, after a look at their sketches: of the parities of 2,048 shares or more of two sets, no more differ than
shingles do.
With `bits`, SimHash with deletion variants (op3's operator) goes first: fingerprints at `bits` or fewer differing bits
link their texts, pairs that it has connected are not compared, and the exact comparison finds what lies further apart.
Nothing is sampled but the order: shingles that a sample of the texts holds often come last, which keeps keys
short and changes no result.

Equal sets meet as one before any join. Under a key with over `CROWD` sets, no pairs are made: sizes and sketches are
brought together first, and the sets that they leave a partner are linked by a search outward that gives a spanning tree
of them.

Defined results: words are lowered (A-Z) and parted at ASCII blanks; texts of fewer words than a shingle are one
shingle; null and empty texts are one set, equal to itself alone; of a component the smallest id stays, null ids come
last; equal ids on different texts of one component: the smallest hash of the text stays, in different components
each; repeated rows give one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_sized, settled
from .components import components
from .lm_score import isin, pair
from .simhash import fingerprint_all
from .simhash import links as print_links

SIZE = 5
CROWD = 256
SAMPLE = 64  # one text in so many is counted for the order
COMMON = 1 << 17
BITS = 2_048  # of a sketch
LOOK = 256  # of the sketches that likely pairs are judged by
STARS = 2  # rounds in which each set is compared with one other
_WORDS = 200_000  # at a time


def shingle_sets(texts: list, size: int = SIZE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words, count = [], []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        words += w
        count.append(len(w))
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    s = h[: max(len(h) - size + 1, 0)]
    for k in range(1, size):
        s = pair(s, h[k : k + len(s)])
    out, at = [], 0
    for n in count:
        if n >= size:
            out.append(np.unique(s[at : at + n - size + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), n)] if n else [], dtype=np.uint64))
        at += n
    return out


def pieces_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch of about _WORDS words or one text, with their texts."""
    size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], dtype=np.int64) // 6 + 1
    part = (np.cumsum(size) - size) // _WORDS
    starts = np.unique(part, return_index=True)[1].tolist() if len(part) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        piece = batch.slice(a, b - a)
        yield piece, piece.column(column).to_pylist()


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set: in order of hashes, common ones last."""
    take = len(s) - (4 * len(s) + 4) // 5 + 1
    if not len(common):
        return s[:take]
    on = isin(s, common)
    return np.concatenate([s[~on], s[on]])[:take] if on.any() else s[:take]


def sketch(s: np.ndarray, least: int = BITS) -> np.ndarray:
    """Parities of the number of shingles in each share, as words of 64; a larger set has twice as many shares, or four
    times, ..., so that a sketch has about a bit a shingle."""
    bits = least << (len(s) // least).bit_length()
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(x: Column, y: Column) -> Column:
    """In how many shares two sketches differ. Sets that can be similar have sketches of the same length or of half of
    it; the longer one is folded, as shares go by the last bits of a hash."""
    xor = lambda u, v: u.bitwiseXOR(v)
    fold = lambda u, v: F.when(F.size(u) == 2 * F.size(v), F.zip_with(F.slice(u, F.lit(1), F.size(v)), F.slice(u, F.size(v) + 1, F.size(v)), xor)).otherwise(u)
    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)


def similar(shared: np.ndarray, n, m) -> np.ndarray:
    """shared / (n + m - shared) >= 4/5"""
    return 9 * shared >= 4 * (n + m)


def tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets that are similar to each other: a search outward from one after another."""
    left, out = np.arange(len(sets)), []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = left[(5 * size[left] >= 4 * size[x]) & (5 * size[x] >= 4 * size[left])]
            hits: list[int] = []
            for k in range(0, len(near), 1000):
                some = near[k : k + 1000]
                on = isin(np.concatenate([sets[j] for j in some]), sets[x])
                shared = np.add.reduceat(on, np.cumsum(size[some]) - size[some], dtype=np.int64)
                hits += some[similar(shared, size[some], size[x])].tolist()
            if hits:
                out += [(x, j) for j in hits]
                front += hits
                left = np.setdiff1d(left, hits, assume_unique=True)
    return out


def runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and length of runs of two equal keys or more."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(start, len(key)))
    on = length > 1
    yield from zip(start[on].tolist(), length[on].tolist(), strict=True)


def pairs_of(key: np.ndarray, sid: np.ndarray, n: np.ndarray, at: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs under equal keys that sizes and places don't rule out; (key, set) of crowds."""
    pairs, crowds = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for s, k in runs(key):
        if k > crowd:
            crowds.append(np.stack([key[s : s + k], sid[s : s + k]], axis=1))
            continue
        i, j = np.triu_indices(k, 1)
        i, j = i + s, j + s
        on = similar(1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1), n[i], n[j])
        i, j = sid[i[on]], sid[j[on]]
        pairs.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
    return np.unique(np.concatenate(pairs), axis=0), np.concatenate(crowds)


def candidates(prefixes: DataFrame, crowd: int) -> DataFrame:
    """prefixes: sid, n, keys. Returns g, a, b: pairs (g null), and members a of crowds g (b null)."""
    rows = prefixes.select("sid", "n", F.posexplode("keys").alias("at", "key")).select("key", "sid", "n", "at")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]

        def out(n: int) -> pa.RecordBatch:
            pairs, crowds = pairs_of(*(x[:n] for x in held), crowd)
            none = pa.nulls(len(pairs), pa.int64())
            g = pa.concat_arrays([none, pa.array(crowds[:, 0])])
            a = np.concatenate([pairs[:, 0], crowds[:, 1]])
            b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(crowds), pa.int64())])
            return pa.RecordBatch.from_arrays([g, pa.array(a), b], ["g", "a", "b"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy().astype(np.int64)]) for k, x in enumerate(held)]
            if len(held[0]) and (n := int(np.searchsorted(held[0], held[0][-1]))):  # the last key may go on
                yield out(n)
                held = [x[n:] for x in held]
        if len(held[0]):
            yield out(len(held[0]))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "g long, a long, b long").distinct()


def may_match(sketches: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Which sets of a crowd have another one in it that neither sizes nor sketches rule out."""
    words = np.array([len(x) for x in sketches])
    held = {w: np.stack([sketches[k] for k in np.flatnonzero(words == w)]) for w in np.unique(words).tolist()}
    of_size = {w: n[words == w] for w in held}
    on = {w: np.zeros(len(x), bool) for w, x in held.items()}
    for w, x in held.items():
        for v in (w, 2 * w):  # the longer one is folded, as shares go by the last bits of a hash
            if v not in held:
                continue
            y = held[v] if v == w else held[v][:, :w] ^ held[v][:, w:]
            order = np.argsort(of_size[v], kind="stable")
            size = of_size[v][order]
            least, most = np.searchsorted(5 * size, 4 * of_size[w], "left"), np.searchsorted(4 * size, 5 * of_size[w], "right")
            for i in range(len(x)):
                near = order[least[i] : most[i]]
                if on[w][i]:
                    near = near[~on[v][near]]
                if v == w:
                    near = near[near != i]
                for k in range(0, len(near), 10_000):
                    some = near[k : k + 10_000]
                    hit = some[9 * np.bitwise_count(y[some] ^ x[i]).sum(axis=1, dtype=np.int64) <= of_size[w][i] + of_size[v][some]]
                    if len(hit):
                        on[w][i] = True
                        on[v][hit] = True
    out = np.zeros(len(n), bool)
    for w, x in on.items():
        out[words == w] = x
    return out


def partnered(members: DataFrame) -> DataFrame:
    """members: g, sid, n, sketch. Returns g, sid of those that may be similar to another one under their key; no whole set
    moves for the others."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size, sketches = None, [], [], []

        def out() -> pa.RecordBatch:
            some = np.array(ids)[may_match(sketches, np.array(size))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now), pa.int64()), pa.array(some, pa.int64())], ["g", "sid"])

        for batch in batches:
            for g, i, n, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if g != now:
                    if ids:
                        yield out()
                    now, ids, size, sketches = g, [], [], []
                ids.append(i)
                size.append(n)
                sketches.append(x.values.to_numpy().view(np.uint64))
        if ids:
            yield out()

    return members.select("g", "sid", "n", "sketch").repartition("g").sortWithinPartitions("g").mapInArrow(choose, "g long, sid long")


def crowd_links(members: DataFrame) -> DataFrame:
    """members: g, sid, shingles. Returns a, b: links that connect what is similar under a key."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            found = tree(sets)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for g, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != now:
                    if ids:
                        yield out()
                    now, ids, sets = g, [], []
                ids.append(i)
                sets.append(s.values.to_numpy().view(np.uint64))
        if ids:
            yield out()

    return members.select("g", "sid", "shingles").repartition("g").sortWithinPartitions("g").mapInArrow(link, "a long, b long")


def sets_of(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """The columns keep, shingles (longs), n of rows with a column text."""
    df = rows.select(F.struct(*keep).alias("row"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces_of(batch, 1):
                sets = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())], ["row", "shingles", "n"])

    schema = df.select("row", *(F.lit(None).cast(t).alias(c) for c, t in (("shingles", "array<long>"), ("n", "long")))).schema
    return df.mapInArrow(read, schema).select("row.*", "shingles", "n")


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar, compared whole. Only sets of a pair move; those that stand first stay where
    they are if the pairs are few."""
    pairs = cut(pairs.select("a", "b"), "pairs")
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("shingles").alias(f"{c}_shingles"))
    first = join_sized(side("a"), pairs, ["a"], "inner")
    second = join_sized(side("b"), pairs.select("b").distinct(), ["b"], "left_semi")
    both = first.join(second, "b")
    return both.filter(similar(F.size(F.array_intersect("a_shingles", "b_shingles")), F.size("a_shingles"), F.size("b_shingles"))).select("a", "b")


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs a, b that are not connected yet."""
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    left = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return left.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def linked_prints(seen: DataFrame, bits: int) -> DataFrame:
    """seen: sid, fp. Returns a, b: links between sets whose fingerprints are equal or connected by `bits` or fewer
    differing bits."""
    held = cut(seen.select("sid", "fp").distinct(), "prints")
    root = components(print_links(held.select("fp").distinct(), bits))
    named = held.join(root, F.col("fp") == F.col("node"), "left").select("sid", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("sid").alias("b"), F.count("*").alias("n")).filter("n > 1").select("root", "b")
    return join_sized(named, least, ["root"], "inner").filter("sid <> b").select(F.col("sid").alias("a"), "b")


def linked(likely: DataFrame, sets: DataFrame, links: DataFrame, stars: int = STARS) -> DataFrame:
    """node, root of the components that links and the similar ones among the likely pairs make.

    Whole sets travel with a pair that is compared, and a group of n similar sets has up to n * n pairs. So each round
    first compares every set with the smallest that it is likely to be similar to, one pair a set; pairs whose ends are
    connected by then need no look. After `stars` rounds all pairs that are left are compared.
    """
    links = cut(links, "links")
    opened = cut(apart(likely, components(links)), "open")
    for turn in range(stars + 1):
        chosen = opened.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if turn < stars else opened
        links = cut(links.union(near_pairs(chosen, sets)), "links")
        root = components(links)
        if turn == stars:
            break
        opened = cut(apart(opened.join(chosen, ["a", "b"], "left_anti"), root), "open")
        if opened.isEmpty():
            break
    return root


def classes(docs: DataFrame, doc_id: str, text: str, size: int = SIZE, crowd: int = CROWD, bits: int | None = None) -> DataFrame:
    """id, th (hash of the text), root (one value a component); a row for each of docs."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sampled = sets_of(rows.filter(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]), ["th"], size)
    often = sampled.select(F.explode("shingles").alias("h")).groupBy("h").count().filter("count > 3").orderBy(F.desc("count"), "h").limit(COMMON)
    common = np.sort(often.select("h").toArrow().column(0).to_numpy().view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(common)
    df = rows.select(F.struct("id", "th").alias("row"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces_of(batch, 1):
                sets = shingle_sets(texts, size)
                sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), len(s)) for s in sets], dtype=np.uint64).view(np.int64)
                longs = [pa.array(x, pa.list_(pa.int64())) for x in ([prefix(s, held.value).view(np.int64) for s in sets], [sketch(s, LOOK) for s in sets])]
                fps = pa.nulls(len(sets), pa.int64()) if bits is None else pa.array(fingerprint_all(texts))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sid), pa.array([len(s) for s in sets], pa.int64()), *longs, fps], ["row", "sid", "n", "keys", "sketch", "fp"])

    schema = df.select("row", *(F.lit(None).cast(t).alias(c) for c, t in (("sid", "long"), ("n", "long"), ("keys", "array<long>"), ("sketch", "array<long>"), ("fp", "long")))).schema
    seen = cut(df.mapInArrow(read, schema).select("row.*", "sid", "n", "keys", "sketch", "fp"), "prefixes")
    found = cut(candidates(seen.filter("n > 0").select("sid", "n", "keys").dropDuplicates(["sid"]), crowd), "candidates")
    met = found.select(F.explode(F.array("a", "b")).alias("sid")).filter("sid is not null").distinct()
    sketches = cut(join_sized(seen.select("sid", "n", "sketch"), met, ["sid"], "left_semi").dropDuplicates(["sid"]), "sketches")
    look = lambda c: sketches.select(F.col("sid").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("n").alias(f"{c}_n"))
    short = found.filter("g is null").select("a", "b").join(look("a"), "a").join(look("b"), "b")
    differ = differing(F.col("a_sketch"), F.col("b_sketch"))
    likely = cut(short.filter(9 * differ <= F.col("a_n") + F.col("b_n")).select("a", "b"), "likely")
    crowds = cut(partnered(found.filter("g is not null").select("g", F.col("a").alias("sid")).join(sketches, "sid")), "crowds")
    need = likely.select(F.explode(F.array("a", "b")).alias("sid")).union(crowds.select("sid")).distinct()
    first = join_sized(seen.select("sid", "id", "th"), need, ["sid"], "left_semi").groupBy("sid").agg(F.min(F.struct("id", "th")).alias("f"))
    few = cut(first.select("sid", *_keys(F.col("f.id"), F.col("f.th"))), "first")
    texts = join_sized(rows.select("text", *_keys(F.col("id"), F.col("th"))), few, KEYS, "inner").select("sid", "text").dropDuplicates(["sid"])
    sets = cut(sets_of(texts, ["sid"], size), "sets")
    in_crowd = join_sized(sets, crowds.select("sid").distinct(), ["sid"], "left_semi")
    links = crowd_links(crowds.join(in_crowd, "sid"))
    root = linked(likely, sets, links if bits is None else links.union(linked_prints(seen, bits)))
    return seen.select("id", "th", "sid").join(root, F.col("sid") == F.col("node"), "left").select("id", "th", F.coalesce("root", "sid").alias("root"))


KEYS = ["_bare", "_id", "_th"]


def _keys(doc_id: Column, th: Column) -> list[Column]:
    """Columns that tell rows of other ids or texts apart, without nulls."""
    return [doc_id.isNull().alias("_bare"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("_id"), th.alias("_th")]


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, crowd: int = CROWD, bits: int | None = None) -> DataFrame:
    """Of each component the row with the smallest id (of repeated rows that which comes first in order of all columns),
    with the columns of docs. Only rows that go, or stand repeated, are looked up; the others stay where they are. Of the
    tables on the way only the rows' fate is left in the shared folder."""
    spark = docs.sparkSession

    def fates() -> DataFrame:
        member = settled(spark, lambda: classes(docs, doc_id, text, size, crowd, bits).groupBy("root", "id", "th").agg(F.count("*").alias("times")), "members")
        winner = member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "th")).alias("w"))
        won = F.col("w.id").eqNullSafe(F.col("id")) & (F.col("w.th") == F.col("th"))
        return member.join(winner, "root").select(*_keys(F.col("id"), F.col("th")), F.when(won, F.col("times")).otherwise(0).alias("_stay")).filter("_stay <> 1")

    fate = settled(spark, fates, "fate")
    rows = docs.select(F.struct("*").alias("row"), *_keys(F.col(doc_id), F.xxhash64(F.coalesce(text, F.lit("")))))
    dealt = join_sized(rows, fate, KEYS, "left")
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("row").cast("string")))
    again = dealt.filter("_stay > 1").withColumn("_n", n).filter("_n = 1")
    return dealt.filter("_stay is null").select("row.*").union(again.select("row.*"))
