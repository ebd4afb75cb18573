"""N-gram Jaccard join with token-combination prefixes (operator 10).

A document is its set of distinct five-word shingles, as 64-bit hashes. Documents of
equal sets form a class, named by a hash of the set; all that follows works on
classes, so copies cost nothing.

Order all shingles with frequent ones last. Two sets of similarity t share a shingle
in their prefixes of n - ceil(t * n) + 1, and m + 1 shingles in prefixes that are m
longer. Rare shingles of a prefix extended by n / 16 are index keys by themselves; a
class that has fewer keys in common with others than that many extra shingles demand
(a passage alone that others have too) has no partner and is left out. A class whose
prefix reaches the frequent shingles extends it by m, deals its frequent shingles into m
groups by hash, and indexes the pairs inside each group: of m + 1 shared shingles two
fall into one group. m follows the size of the larger set, so a class indexes for its
own size and for the next power of two if a partner can have it.

Which shingles count as frequent only moves work: any fixed set gives the same result.
Once the keys' sizes are known, a class drops its most frequent keys, as many as it must
have in common with any partner but one: the prefix rule again, on exact frequencies.

Candidates become links in two steps. First every key's classes are compared with one
leader, and links are merged to components: a group of near copies takes one comparison a
member. Then whatever shares a key and is of different components still is compared
exhaustively: in small keys pair by pair, in large ones block by block with shared-shingle
counts as matrix products, so that no pair is ever a row. No link is left untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import arrow_texts, by_shuffle, chunks, dropped, mix, released, stored, word_hashes
from revlens.llm.components import connected_components

WORDS = 5
#: Similarity, as a share of 100.
PERCENT = 75
#: A shingle is frequent from this many classes on (as counted inside tasks), and so
#: many at most are; the list is 16 bytes each and is broadcast.
FREQUENT, MOST_FREQUENT = 24, 200_000
#: Classes up to which the list of those to compare is broadcast (8 bytes each).
BROADCAST_CLASSES = 1_000_000
#: Shingles that a task sends in one batch of sets, and holds at a time when it counts.
SENT = 500_000
#: Classes of a key up to which its pairs are listed; classes and shingles in a block of
#: larger ones, and shingles in a step of their product.
SMALL, BLOCK, BLOCK_SHINGLES, COLUMNS = 16, 256, 500_000, 4096
HELD = 2_000_000

_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _sequence_hash(w: np.ndarray) -> np.uint64:
    places = mix(np.arange(1, len(w) + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((w * places).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text, in order."""
    for first, last in chunks(texts):
        w, counts = word_hashes(texts[first:last])
        n = max(0, len(w) - words + 1)
        s = np.zeros(n, np.uint64)
        for j in range(words):
            s += w[j : j + n] * _STEPS[j]
        s = mix(s)
        at = 0
        for c in counts.tolist():
            if c >= words:
                yield np.unique(s[at : at + c - words + 1])
            else:
                yield np.array([_sequence_hash(w[at : at + c])] if c else [], np.uint64)
            at += c


def class_hash(s: np.ndarray) -> int:
    """Name of a set: a hash of all its members, as a signed long."""
    return int(mix(mix(s ^ np.uint64(0x5BF0_3635)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


_PROFILE = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("token", pa.int64()), ("df", pa.int64())])


def _profile(batches):
    """A row per document, and rows (token, df) of shingles that three classes or
    more of this task share."""
    seen: set[int] = set()
    held, total = [], 0

    def shared():
        tokens, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
        keep = df >= 3
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.record_batch([none, none, none, pa.array(tokens[keep].view(np.int64)), pa.array(df[keep].astype(np.int64))], schema=_PROFILE)

    for batch in batches:
        texts = arrow_texts(batch.column("text"))
        classes, sizes = [], []
        for s in shingle_sets(texts):
            sizes.append(len(s))
            c = class_hash(s) if len(s) else None
            classes.append(c)
            if len(s) > 2 and c not in seen:
                seen.add(c)
                held.append(s)
                total += len(s)
                if total > HELD:
                    yield shared()
                    held, total = [], 0
                    seen = set()
        none = pa.nulls(len(texts), pa.int64())
        yield pa.record_batch([batch.column("doc_id"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), none, none], schema=_PROFILE)
    yield shared()


def spare(n):
    """Shingles by which the prefix of a set of `n` is longer than it must be."""
    return n // 16


def demanded(n, percent: int = PERCENT):
    """Keys that a set of `n` has in common with any partner, at least: as many as the
    smallest partner's spare shingles and one."""
    return spare((n * percent + 99) // 100) + 1


def prefix_keys(
    s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Index keys of a set: of rare shingles, and of pairs of frequent ones; and
    whether its prefix is of rare ones only. `frequent` holds the frequent shingles,
    sorted; `rank` their places in the order, the most frequent last."""
    n = len(s)
    p = n + (-percent * n) // 100 + 1
    at = np.searchsorted(frequent, s)
    common = np.zeros(n, bool)
    if len(frequent):
        common = frequent[np.minimum(at, len(frequent) - 1)] == s
    rare = s[~common]
    keys = []
    if len(rare) < p:
        often = s[common][np.argsort(rank[at[common]], kind="stable")]
        top = (100 * n) // percent
        for level in sorted({n.bit_length(), top.bit_length()}):
            m = max(1, (1 << level) >> 4)
            part = often[: p + m - len(rare)]
            group = mix(part ^ np.uint64(0x77F1)) % np.uint64(m)
            order = np.lexsort((part, group))
            part, group = part[order], group[order]
            for gap in range(1, len(part)):
                same = group[gap:] == group[:-gap]
                if not same.any():
                    break
                a, b = part[:-gap][same], part[gap:][same]
                keys.append(mix(mix(a) + b * np.uint64(3) + np.uint64(level)))
    longer = p + spare(n)
    return mix(rare[:longer] ^ np.uint64(0x51A6)), np.unique(np.concatenate(keys)) if keys else s[:0], len(rare) >= longer


_KEYS = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("often", pa.bool_()), ("plain", pa.bool_())])


KEYS = "key long, class long, n int, often boolean, plain boolean"


def _keys(frequent, percent: int):
    def run(batches):
        tokens, rank = frequent.value
        seen: set[int] = set()
        for batch in batches:
            keys, classes, sizes, often, plain = [], [], [], [], []
            for s in shingle_sets(arrow_texts(batch.column("text"))):
                if len(s) < 3:  # can only equal, and equal sets are one class
                    continue
                c = class_hash(s)
                if c in seen:
                    continue
                seen.add(c)
                *both, rare_only = prefix_keys(s, tokens, rank, percent)
                for k, of_frequent in zip(both, (False, True), strict=True):
                    keys.append(k)
                    classes.append(np.full(len(k), c, np.int64))
                    sizes.append(np.full(len(k), len(s), np.int32))
                    often.append(np.full(len(k), of_frequent))
                    plain.append(np.full(len(k), rare_only))
            if keys:
                parts = np.concatenate(keys).view(np.int64), *map(np.concatenate, (classes, sizes, often, plain))
                yield pa.record_batch([pa.array(x) for x in parts], schema=_KEYS)

    return run


def _shared_keys(batches):
    """Of rows sorted by (key, class), those whose key has two classes or more, and
    all of frequent shingles; each once. Holds a batch and one row."""
    held, has_previous = None, False
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(_KEYS))]
        if held is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
        k, c = cols[:2]
        if not len(k):
            continue
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
        cols = [x[fresh] for x in cols]
        k, often = cols[0], cols[3]
        same = k[1:] == k[:-1]
        previous = np.concatenate(([has_previous], same))
        keep = (previous[:-1] | same) | often[:-1]
        held, has_previous = [x[-1:] for x in cols], bool(previous[-1])
        if keep.any():
            yield pa.record_batch([pa.array(x[:-1][keep]) for x in cols], schema=_KEYS)
    if held is not None and (has_previous or held[3][0]):
        yield pa.record_batch([pa.array(x) for x in held], schema=_KEYS)


def _partnered(shared: DataFrame, percent: int) -> DataFrame:
    """Stored (key, class, n): every class without its most frequent keys, one less than
    it has in common with any partner (`demanded`); keys of one class are left out."""
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    least = F.expr(f"((n * {percent} + 99) DIV 100) DIV 16 + 1")  # demanded(n)
    w = Window.partitionBy("class").orderBy(F.desc("size"), "key")
    ranked = shared.where("plain").join(by_shuffle(sizes), "key").withColumn("place", F.row_number().over(w))
    kept = ranked.where(F.col("place") >= least).select("key", "class", "n")
    kept = stored(kept.unionByName(shared.where("NOT plain").select("key", "class", "n")), "kept")
    several = kept.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    out = stored(kept.join(by_shuffle(several.select("key")), "key", "left_semi"), "partnered")
    dropped(kept, shared)
    return out


def _sets(wanted):
    """Rows (doc_id, class, set); with `wanted` (classes, their documents) only those."""
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("set", pa.list_(pa.int64()))])

    def rows(ids, classes, sets):
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), values], schema=schema)

    def run(batches):
        want, first = (None, None) if wanted is None else wanted.value
        for batch in batches:
            ids, classes, sets = [], [], []
            held = 0
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(arrow_texts(batch.column("text"))), strict=True):
                if held > SENT:
                    yield rows(ids, classes, sets)
                    ids, classes, sets, held = [], [], [], 0
                if len(s) < 3:
                    continue
                c = class_hash(s)
                if want is not None:
                    i = int(np.searchsorted(want, c))
                    if i == len(want) or want[i] != c or first[i] != doc_id:
                        continue
                ids.append(doc_id)
                classes.append(c)
                sets.append(s.view(np.int64))
                held += len(s)
            if classes:
                yield rows(ids, classes, sets)

    return run


def _sets_of(texts: DataFrame, firsts: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, set) of the wanted classes, computed from one document each (`firsts`:
    class, doc_id). Classes are looked up in a list if it is short, else joined."""
    spark = texts.sparkSession
    wanted = stored(classes.distinct().join(by_shuffle(firsts), "class"), "wanted")
    schema = "doc_id long, class long, set array<bigint>"
    if wanted.count() <= BROADCAST_CLASSES:
        listed = wanted.where("doc_id IS NOT NULL").toArrow()  # BROADCAST_CLASSES rows at most
        names, ids = (np.asarray(listed.column(c).combine_chunks()) for c in ("class", "doc_id"))
        order = np.argsort(names)
        known = spark.sparkContext.broadcast((names[order], ids[order]))
        named = texts.where("doc_id IS NOT NULL").mapInArrow(_sets(known), schema).select("class", "set")
        nameless = wanted.where("doc_id IS NULL")
        if nameless.isEmpty():
            return named
        others = texts.where("doc_id IS NULL").mapInArrow(_sets(None), schema)
        return named.unionByName(others.join(by_shuffle(nameless.select("class")), "class", "left_semi").select("class", "set"))
    one = wanted.select(F.col("class").alias("c"), F.col("doc_id").alias("d"))
    rows = texts.mapInArrow(_sets(None), schema)
    return rows.join(by_shuffle(one), (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("class", "set")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Stored links (u, v): the pairs (a, b) of classes whose sets are similar. A set
    that comes twice gives the same link twice."""
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    links = by_shuffle(pairs).join(left, "a").join(by_shuffle(right), "b").where(similar)
    return stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, class, n, label): rows of keys whose classes are of two components or
    more; a class without a link is its own component."""
    named = labels.select(F.col("node").alias("class"), F.col("component").alias("named"))
    rows = shared.join(by_shuffle(named), "class", "left").select("key", "class", "n", F.coalesce("named", "class").alias("label"))
    several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return rows.join(by_shuffle(several.select("key")), "key", "left_semi")


def _star(rows: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b): every key's leader (the least by hash) with the key's classes
    of other components whose size allows a link."""
    place = F.xxhash64("class")
    leaders = rows.groupBy("key").agg(F.min(F.struct(place.alias("p"), "class", "n", "label")).alias("x"))
    leaders = leaders.select("key", F.col("x.class").alias("lc"), F.col("x.n").alias("ln"), F.col("x.label").alias("ll"))
    pairs = rows.join(by_shuffle(leaders), "key").where(
        (F.col("ll") != F.col("label")) & (100 * F.least("n", "ln") >= percent * F.greatest("n", "ln"))
    )
    return stored(pairs.select(F.least("class", "lc").alias("a"), F.greatest("class", "lc").alias("b")).distinct(), "pairs")


def _small_key_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b) of different components in keys of SMALL classes at most."""
    left = rows.select("key", F.col("class").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = rows.select("key", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = left.join(by_shuffle(right), "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits)
    return stored(pairs.select("a", "b").distinct(), "pairs")


def _compare(percent: int):
    """Links between the left and the right rows of a block: one for each pair of
    labels that has any, for classes of one label are linked already."""

    def run(block: pa.Table) -> pa.Table:
        left = np.asarray(block.column("left").combine_chunks().to_numpy(zero_copy_only=False))
        name, label, n = (block.column(c).to_numpy() for c in ("class", "label", "n"))
        sets = block.column("set").combine_chunks()
        token, row = sets.flatten().to_numpy(), np.repeat(np.arange(len(n)), np.diff(sets.offsets.to_numpy()))
        _, token, count = np.unique(token, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        keep = count[token] > 1
        token, row = column[token[keep]], row[keep]
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        place = np.zeros(len(n), np.int64)
        place[l], place[r] = np.arange(len(l)), np.arange(len(r))
        both = np.zeros((len(l), len(r)), np.float32)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        for first in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
            lo, hi = np.searchsorted(token, (first, first + COLUMNS))
            t, w = token[lo:hi] - first, row[lo:hi]
            x, y = np.zeros((len(l), COLUMNS), np.float32), np.zeros((len(r), COLUMNS), np.float32)
            is_left = left[w]
            x[place[w[is_left]], t[is_left]] = 1
            y[place[w[~is_left]], t[~is_left]] = 1
            both += x @ y.T
        union = n[l][:, None] + n[r][None, :] - both
        found = (100 * both >= percent * union) & (label[l][:, None] != label[r][None, :])
        i, j = np.nonzero(found)
        _, one = np.unique(np.stack((label[l[i]], label[r[j]])), axis=1, return_index=True)
        i, j = i[one], j[one]
        return pa.table({"u": pa.array(name[l[i]], pa.int64()), "v": pa.array(name[r[j]], pa.int64())})

    return run


def _large_key_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored links (u, v) of different components in large keys.

    Large keys that share a class are one group. A group's largest component is not
    compared within itself: all other classes (left) meet all classes (right), both cut
    into blocks of about BLOCK classes, and a pair of blocks is one comparison.
    """
    first = rows.groupBy("key").agg(F.min("class").alias("first"))
    group = stored(connected_components(rows.join(by_shuffle(first), "key").select(F.col("class").alias("u"), F.col("first").alias("v"))), "groups")
    members = rows.select("class", "label", "n").distinct().join(by_shuffle(group), F.col("class") == F.col("node"))
    members = stored(members.select("class", "label", "n", F.col("component").alias("group")), "members")
    by_label = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    per_group = by_label.groupBy("group").agg(
        F.max(F.struct("rows", "label", "shingles")).alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")
    )

    def blocks(rows, shingles):
        return F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    per_group = per_group.select(
        "group", F.col("main.label").alias("main"),
        blocks(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("left_blocks"),
        blocks(F.col("rows"), F.col("shingles")).alias("right_blocks"),
    )
    placed = members.join(per_group, "group")
    h = F.xxhash64("class")
    cols = ["group", "class", "label", "n"]
    left = placed.where("label <> main").select(
        *cols, F.lit(True).alias("left"), F.pmod(h, "left_blocks").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"),
    )
    right = placed.select(
        *cols, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"),
        F.pmod(h, "right_blocks").cast("int").alias("j"),
    )
    # sets come in last, by class: a group's rows never meet in one task
    blocked = by_shuffle(left.unionByName(right)).join(sets, "class")
    links = blocked.groupBy("group", "i", "j").applyInArrow(_compare(percent), "u long, v long")
    out = stored(links, "links")
    dropped(members, group)
    return out


def _labels(texts: DataFrame, firsts: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all classes that have a link; deletes `shared`."""
    spark = texts.sparkSession
    none = spark.createDataFrame([], "node long, component long")
    if shared.isEmpty():
        return none
    sets = stored(_sets_of(texts, firsts, shared.select("class")), "sets")  # all that can be compared
    pairs = _star(shared.withColumn("label", F.col("class")), percent)
    links = _verified(sets, pairs, percent)
    labels = stored(connected_components(links), "labels")
    dropped(pairs)
    released(spark)
    rows = stored(_open(shared, labels), "open")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    small = rows.join(by_shuffle(sizes.where(F.col("size") <= SMALL).select("key")), "key", "left_semi")
    large = rows.join(by_shuffle(sizes.where(F.col("size") > SMALL).select("key")), "key", "left_semi")
    pairs = _small_key_pairs(small, percent)
    more = _verified(sets, pairs, percent)
    if not large.isEmpty():
        more = more.unionByName(_large_key_links(large, sets, percent))
    if not more.isEmpty():
        labels = stored(connected_components(links.unionByName(more)), "labels")
    dropped(pairs, rows, sets, shared)
    released(spark)
    return labels


def similar_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, itself included).

    Null and empty texts and texts without words have no shingles and are linked
    with nothing. Rows of the same doc_id are linked as their texts are; a null
    doc_id is never a component's name unless all of its documents have none. An
    empty table gives an empty result. Only doc_id and text are read; texts are
    read whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stored(texts.mapInArrow(_profile, "doc_id long, class long, n long, token long, df long"), "profile")
    known = profile.where("token IS NULL").select("doc_id", "class", "n")
    often = (
        profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= FREQUENT)
        .orderBy(F.desc("df"), "token").limit(MOST_FREQUENT).toArrow()  # MOST_FREQUENT rows at most
    )
    tokens = np.asarray(often.column("token").combine_chunks()).view(np.uint64)
    order = np.argsort(tokens)
    rank = (len(tokens) - np.arange(len(tokens)))[order]
    frequent = spark.sparkContext.broadcast((tokens[order], rank))
    index = texts.mapInArrow(_keys(frequent, percent), KEYS)
    # a key of frequent shingles may hold a third of all classes: its rows are dealt
    # by class as well and all go on, the others are sorted by key
    dealt = F.when(F.col("often"), F.xxhash64("key", "class")).otherwise(F.col("key"))
    parts = index.repartition(dealt).sortWithinPartitions("key", "class")
    shared = _partnered(stored(parts.mapInArrow(_shared_keys, KEYS), "shared"), percent)
    released(spark)
    firsts = known.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    labels = _labels(texts, firsts, shared, percent)
    named = known.join(by_shuffle(labels), known["class"] == labels["node"], "left").select(
        "doc_id", "n", F.coalesce("component", "class").alias("group")
    )
    least = named.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = named.join(by_shuffle(least), "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each group, the smallest doc_id (its repeated rows
    are one document and stay). Documents without words, and those without a doc_id,
    stay; columns are as they are."""
    groups = similar_components(docs, percent)
    spare = groups.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id")))
    spare = stored(spare.select(F.col("doc_id").alias("__spare")).distinct(), "copies")
    if spare.count() > BROADCAST_CLASSES:
        return docs.join(by_shuffle(spare), F.col("doc_id") == F.col("__spare"), "left_anti")
    ids = np.sort(np.asarray(spare.toArrow().column("__spare").combine_chunks()))  # BROADCAST_CLASSES at most, 8 bytes each
    return docs.where(~_listed(docs.sparkSession.sparkContext.broadcast(ids))(F.col("doc_id").cast("long")))


def _listed(ids):
    """Is a number in the sorted list `ids`? A null is not."""

    @F.arrow_udf("boolean")
    def listed(numbers: pa.Array) -> pa.Array:
        known, n = ids.value, numbers.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(known):
            return pa.array(np.zeros(len(n), bool))
        found = known[np.minimum(np.searchsorted(known, n), len(known) - 1)] == n
        return pa.array(found & numbers.is_valid().to_numpy(zero_copy_only=False))

    return listed
