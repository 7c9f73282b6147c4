"""N-gram Jaccard join: which documents have nearly the same set of word n-grams.

Documents with equal sets form a class, and only one of each class goes on. All shingles are counted exactly, in compact blocks:
a task sends, for a batch of documents, its sorted shingle hashes to buckets by hash range; a bucket finds those that occur in two documents
or more and answers each batch. The order of all shingles is by rising document frequency (in fine logarithmic steps), then hash.
A shingle of one document alone is rarest and comes first, so a document whose rare ones fill its prefix can have no partner; the
rest are joined on their prefix shingles under length and positional filters. Pairs are verified once on their whole sets, after a
suffix filter.

Components need not know every link, so a large group of near copies is not spelled out in pairs: first all members of a prefix shingle
are verified against its pivots, then components are found, and only pairs of a shingle that lie in different components are verified.
No pair that could connect two components is left out. That is join(); links() and link_counts() verify every pair of classes that passes the filters.

Batches and buckets hold about the square root of BLOCK_ENTRIES times all shingles, within the bounds below, so that blocks keep a useful size and
a task's memory is bounded. A hot shingle (HOT documents of a batch or more) is sent once for a batch, with its count; any other adds fewer than
HOT entries a batch to its bucket, under half of a bucket's mean. What is summed by a key is written before it is joined with the
rows of that key again: then both sides are plain shuffles, and a key that many rows share is dealt to several tasks. Words are runs of bytes other than space and 9
to 13, with A-Z lowered. A document of fewer words than n has its whole sequence as only shingle; null texts and texts without words
have an empty set, are linked with nothing and stand alone. Repeated rows are equal sets. A null id is never a component's
id unless no member has another. Empty tables give empty results; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import Rolling, bounded, dealt, drop_saved, hot_from, mixed, runs_of, saved, step_entries, text_chunks, word_bounds

#: Words of a shingle, and least similarity in hundredths.
WORDS, SIMILAR = 4, 85
#: Entries of a batch, and of a bucket in the mean, at least and at most (about 64 bytes of a task's memory each); entries that a block should hold.
LEAST_ENTRIES, MOST_ENTRIES, BLOCK_ENTRIES = 1 << 18, 1 << 23, 64
#: Documents of a batch at most; documents of a batch from which a shingle is hot, at least (see common.hot_from).
BATCH_DOCS, HOT = 60_000, 32
#: Copies whose ids are broadcast so that they are not indexed (8 bytes each); with more, they are indexed, too.
SKIPPED = 2_000_000
#: Pivots that a shingle's documents are verified against before pairs are.
PIVOTS = 3
HASH_BITS, DOC_BITS, STEPS = 48, 16, 3.2
EDGE = "u long, v long"


# ---- sets


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, rolling: Rolling) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, counts = word_bounds(low, offs)
    words = rolling.over(low).of(starts, ends)
    out = []
    total = len(words)
    joined = np.zeros(total, np.uint64)
    for k in range(n):
        part = words[k:]
        joined[: len(part)] = joined[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part
    joined = mixed(joined + np.uint64(n))
    at = 0
    for c in counts.tolist():
        if c >= n:
            s = np.sort(joined[at : at + c - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[at : at + c]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + w
                out.append(mixed(np.array([whole + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def fingerprint(s: np.ndarray) -> bytes | None:
    """128 bits of a set, whatever its order."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return np.array([mixed(s + np.uint64(0x1234567)).sum(), mixed(s ^ np.uint64(0x9ABCDEF012345678)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def _rows(n: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rolling = Rolling()
        for rows, data, offs in text_chunks(batches):
            sets = shingle_sets(data, offs, n, rolling)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary())], names=["doc_id", "n", "fp"])

    return run


# ---- exact document frequencies


def packed_bytes(x: np.ndarray) -> bytes:
    """Sorted integers as differences, byte by byte of rising weight: leading zeros are left to Spark's compression."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return d.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()) if n else np.zeros(0, np.uint64)


BLOCK = "bucket int, batch long, docs boolean, entries binary, hot binary, fps binary, sizes binary"


def _blocks(n: int, buckets: int, entries: int, from_hot: int):
    """Of each batch of documents: a block of entries (hash << 16 | document) for each bucket, and one that describes the documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        rolling = Rolling()
        part = TaskContext.get().partitionId()
        held, fps, sizes, total, number = [], [], [], 0, 0

        def flush():
            nonlocal held, fps, sizes, total, number
            batch = part << 24 | number
            x = np.sort(np.concatenate(held))
            hashes = x >> np.uint64(DOC_BITS)
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            counts = np.diff(first, append=len(x))
            many = counts >= from_hot
            hot = hashes[first[many]] << np.uint64(DOC_BITS) | np.minimum(counts[many], 0xFFFF).astype(np.uint64)
            of_hot = np.repeat(many, counts)
            cold = x[~of_hot]
            used, ends = [], []
            for some in (cold, hot):  # hashes rise, and with them their buckets
                place = ((some >> np.uint64(DOC_BITS + 16)) * np.uint64(buckets) >> np.uint64(HASH_BITS - 16)).astype(np.int64)
                first, _ = runs_of(place)
                used.append(place[first])
                ends.append(np.append(first, len(some)))
            rows = {name: [] for name in ("bucket", "batch", "docs", "entries", "hot", "fps", "sizes")}
            for k in np.union1d(*used).tolist():
                parts = []
                for some, places, end in zip((cold, hot), used, ends):
                    i = int(np.searchsorted(places, k))
                    parts.append(some[end[i] : end[i + 1]] if i < len(places) and places[i] == k else some[:0])
                for name, value in zip(rows, (k, batch, False, packed_bytes(parts[0]), parts[1].tobytes(), None, None)):
                    rows[name].append(value)
            for name, value in zip(rows, (batch % buckets, batch, True, packed_bytes(x[of_hot]), None, b"".join(fps), np.array(sizes, np.int64).tobytes())):
                rows[name].append(value)
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            held, fps, sizes, total, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, kinds)], names=list(rows))

        for rows, data, offs in text_chunks(batches):
            for s in shingle_sets(data, offs, n, rolling):
                if not len(s):
                    continue
                cut = np.unique(s >> np.uint64(64 - HASH_BITS))
                held.append(cut << np.uint64(DOC_BITS) | np.uint64(len(sizes)))
                fps.append(fingerprint(s))
                sizes.append(len(s))
                total += len(cut)
                if total >= entries or len(sizes) >= BATCH_DOCS:
                    yield flush()
        if held:
            yield flush()

    return run


ANSWER = "batch long, docs boolean, entries binary, steps binary, fps binary, sizes binary"


def _answer(_, rows):
    """A bucket: each batch gets those of its entries whose hash is in two documents or more, with their frequency's step."""
    import pyarrow as pa

    out = {name: [] for name in ("batch", "docs", "entries", "steps", "fps", "sizes")}

    def put(*values):
        for name, value in zip(out, values):
            out[name].append(value)

    batches, parts, hots = [], [], []
    for batch, docs, entries, hot, fps, sizes in zip(*(rows.column(c).to_pylist() for c in ("batch", "docs", "entries", "hot", "fps", "sizes"))):
        if docs:
            put(batch, True, entries, None, fps, sizes)
        else:
            batches.append(batch)
            parts.append(unpacked(entries))
            hots.append(np.frombuffer(hot, np.uint64))
    if parts:
        hashes = np.concatenate([*parts, *hots]) >> np.uint64(DOC_BITS)
        cold = sum(map(len, parts))
        weight = np.ones(len(hashes), np.int64)
        weight[cold:] = (np.concatenate(hots) & np.uint64(0xFFFF)).astype(np.int64)
        order = np.argsort(hashes)
        h = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        df = np.add.reduceat(weight[order], first)
        step = np.where(df > 1, np.minimum(127, (STEPS * np.log2(np.maximum(df, 2))).astype(np.int64)), 0).astype(np.uint8)
        steps = np.empty(len(h), np.uint8)
        steps[order] = np.repeat(step, np.diff(first, append=len(h)))
        at, hot_at = 0, cold
        for batch, part, hot in zip(batches, parts, hots):
            s, t = steps[at : at + len(part)], steps[hot_at : hot_at + len(hot)]
            at, hot_at = at + len(part), hot_at + len(hot)
            # a hot shingle's answer has the document number 65535
            keep = np.concatenate((part[s > 0], hot | np.uint64(0xFFFF)))
            order = np.argsort(keep, kind="stable")
            if len(keep):
                put(batch, False, packed_bytes(keep[order]), np.concatenate((s[s > 0], t))[order].tobytes(), None, None)
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(out[k], t) for k, t in zip(out, kinds)], names=list(out))


def _gathered(similar: int):
    """A batch: its documents that can have a partner at all, with their shared shingles in global order."""

    def run(_, rows):
        import pyarrow as pa

        entries, steps, fps, sizes, hot_entries = [], [], b"", np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for docs, e, s, f, z in zip(*(rows.column(c).to_pylist() for c in ("docs", "entries", "steps", "fps", "sizes"))):
            if docs:
                fps, sizes, hot_entries = f, np.frombuffer(z, np.int64), unpacked(e)
            else:
                entries.append(unpacked(e))
                steps.append(np.frombuffer(s, np.uint8))
        x = np.concatenate(entries) if entries else np.zeros(0, np.uint64)
        step = (np.concatenate(steps) if steps else np.zeros(0, np.uint8)).astype(np.uint64)
        is_hot = x & np.uint64(0xFFFF) == 0xFFFF
        if is_hot.any():  # each document that holds a hot shingle gets its answer
            order = np.argsort(x[is_hot])
            answered, its_step = x[is_hot][order] >> np.uint64(DOC_BITS), step[is_hot][order]
            place = np.searchsorted(answered, hot_entries >> np.uint64(DOC_BITS))
            x, step = np.concatenate((x[~is_hot], hot_entries)), np.concatenate((step[~is_hot], its_step[place]))
        doc = (x & np.uint64(0xFFFF)).astype(np.int64)
        key = (step << np.uint64(HASH_BITS) | x >> np.uint64(DOC_BITS)).astype(np.int64)
        shared = np.bincount(doc, minlength=len(sizes))
        able = (shared > 0) & (100 * shared >= similar * sizes)
        keep = able[doc]
        doc, key = doc[keep], key[keep]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        who = np.flatnonzero(able)
        bounds = np.concatenate((np.searchsorted(doc, who), [len(doc)])).astype(np.int32)
        return pa.table([pa.array([fps[16 * i : 16 * i + 16] for i in who.tolist()], pa.binary()), pa.array(sizes[who], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(key, pa.int64())) if len(who) else pa.array([], pa.list_(pa.int64()))], names=["fp", "n", "keys"])

    return run


# ---- pairs


def least_overlap(na: Column, nb: Column, similar: int) -> Column:
    """Common shingles that two sets of these sizes need."""
    return F.ceil((na + nb) * similar / F.lit(100.0 + similar) - 1e-9)


def suffix_differs(a: np.ndarray, b: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the elements in one of the sorted arrays only; may stop once above ``most``. Splits at the middle element."""
    apart = abs(len(a) - len(b))
    if not depth or apart > most or not len(a) or not len(b):
        return apart
    if len(a) < len(b):
        a, b = b, a
    w = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, w))
    same = j < len(b) and b[j] == w
    bound = abs(i - j) + abs((len(a) - i - 1) - (len(b) - j - same)) + (not same)
    if bound > most:
        return bound
    left = suffix_differs(a[:i], b[:j], most, depth - 1)
    return left + suffix_differs(a[i + 1 :], b[j + same :], most - left, depth - 1) + (not same)


def _verified(similar: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("ka"), batch.column("kb")
            ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
            av, bv = a.values.to_numpy(), b.values.to_numpy()
            good = []
            for i, (na, nb) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                need = -(-(na + nb) * similar // (100 + similar))
                # shingles of one document alone are in no other: they differ for sure
                lone = na - len(x) + nb - len(y)
                most = na + nb - 2 * need
                if lone + suffix_differs(x, y, most - lone) > most:
                    continue
                common = np.concatenate((x, y))
                common.sort()
                overlap = int((common[1:] == common[:-1]).sum())
                if 100 * overlap >= similar * (na + nb - overlap):
                    good.append(i)
            pick = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pick), batch.column("b").take(pick)], names=["u", "v"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) that are similar enough by their whole sets, each once."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    return once.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_verified(similar), EDGE)


def _possible(similar: int) -> Column:
    """Length and positional filters of two postings. A similar pair meets at its first common shingle, wherever else it meets; there, all
    that is common are the key and shared shingles behind it: s - j and t - k of them, where the key stands at j of s and k of t."""
    n, m, s, t, j, k = (F.col(c) for c in ("n", "m", "s", "t", "j", "k"))
    return (100 * F.least(n, m) >= similar * F.greatest(n, m)) & (F.least(s - j, t - k) >= least_overlap(n, m, similar))


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge, root the least of the component: alternating large and small stars,
    each a sum over neighbours and a join, until nothing changes."""
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "join-edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "join-low")
        large = saved(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "join-stars")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "join-low")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = saved(small, "join-edges")
        drop_saved(now, low, large, least)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


# ---- the join


def join(docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of each document. Its pairs are links()."""
    rows, classes, sets = _indexed(docs, words, similar)
    ids_of = classes.select("fp", "rep")
    if sets is not None:
        labels = _linked(sets, similar)
        if labels is not None:
            named = saved(labels.join(sets.select("node", "fp"), "node").join(classes.select("fp", "rep"), "fp").select("fp", "root", "rep"), "join-named")
            least = saved(named.groupBy("root").agg(F.min("rep").alias("component_id")), "join-least")
            linked = saved(named.join(least, "root").select("fp", "component_id"), "join-linked")
            ids_of = saved(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("rep")), "join-classes")
            drop_saved(labels, named, least, linked)
        drop_saved(sets)
    some = rows.filter("fp is not null").join(ids_of, "fp").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    return some.unionByName(rows.filter("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Every link: (doc_id, n_shingles, fp) of each document, where fp is its class, null if its set is empty; and (fp_a, fp_b), once each, of the
    pairs of classes that are similar enough. Documents of a class are linked with each other, too. No pivot is used and no pair left out."""
    rows, _, sets = _indexed(docs, words, similar)
    members = rows.select("doc_id", F.col("n").alias("n_shingles"), "fp")
    if sets is None:
        return members, docs.sparkSession.createDataFrame([], "fp_a binary, fp_b binary")
    postings = _postings(sets, similar)
    other = postings.select("key", *(F.col(f).alias(to) for f, to in zip(("node", "n", "s", "j"), ("other", "m", "t", "k"))))
    pairs = postings.join(other, "key").filter((F.col("node") < F.col("other")) & _possible(similar))
    found = verify(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")), sets, similar)
    named = found.join(sets.select(F.col("node").alias("u"), F.col("fp").alias("fp_a")), "u").join(sets.select(F.col("node").alias("v"), F.col("fp").alias("fp_b")), "v")
    return members, saved(named.select("fp_a", "fp_b"), "join-pairs")


def link_counts(docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and n_links: the number of other rows that each is linked with, copies included."""
    members, pairs = links(docs, words=words, similar=similar)
    copies = members.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b")))
    near = both.join(copies.withColumnRenamed("fp", "fp_b"), "fp_b").groupBy(F.col("fp_a").alias("fp")).agg(F.sum("copies").alias("near"))
    counted = copies.join(near, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(counted, "fp", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _indexed(docs: DataFrame, words: int, similar: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows with their sets' fingerprints, the classes, and those that can have a partner (none if no text has words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded(docs.sparkSession)
    rows = saved(docs.mapInArrow(_rows(words), "doc_id long, n long, fp binary"), "join-rows")
    classes = saved(rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "join-classes")
    total, ids, some = rows.agg(F.sum("n"), F.countDistinct("doc_id"), F.count("*")).first()
    if not total:
        return rows, classes, None
    return rows, classes, _partners(docs, rows, classes, words, similar, total, ids == some)


def _partners(docs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, similar: int, total: int, unique: bool) -> DataFrame:
    """(node, fp, n, keys) of the classes that can have a partner."""
    left_out = 0
    if unique:  # copies need not be indexed: a document is known by its id
        copies = saved(rows.filter("fp is not null").join(classes.filter("copies > 1").drop("copies"), "fp").filter("doc_id <> rep").select("doc_id"), "join-copies")
        left_out = copies.count()
        if 0 < left_out <= SKIPPED:
            docs = docs.join(F.broadcast(copies), "doc_id", "left_anti")
    entries = step_entries(total, min(LEAST_ENTRIES, MOST_ENTRIES), MOST_ENTRIES, BLOCK_ENTRIES)
    buckets = max(16, -(-total // entries))
    blocks = docs.mapInArrow(_blocks(words, buckets, entries, hot_from(total, entries, HOT)), BLOCK)
    answers = dealt(blocks, "bucket", buckets).groupBy("bucket").applyInArrow(_answer, ANSWER)
    able = dealt(answers, "batch", buckets).groupBy("batch").applyInArrow(_gathered(similar), "fp binary, n long, keys array<long>")
    if not unique or left_out > SKIPPED:
        able = able.dropDuplicates(["fp"])
    return saved(able.withColumn("node", F.monotonically_increasing_id()), "join-sets")


def _postings(sets: DataFrame, similar: int) -> DataFrame:
    """(key, node, n, s, j) of the prefix shingles that several classes have."""
    lone = F.col("n") - F.size("keys")
    length = F.col("n") - F.ceil(F.col("n") * similar / F.lit(100.0) - 1e-9) + 1 - lone
    prefix = sets.withColumn("p", length.cast("int")).filter("p > 0")
    postings = prefix.select("node", "n", F.size("keys").alias("s"), F.posexplode(F.slice("keys", 1, F.col("p"))).alias("j", "key"))
    several = saved(postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "join-several")
    return saved(postings.join(several, "key"), "join-postings")


def _linked(sets: DataFrame, similar: int) -> DataFrame | None:
    """(node, root) of the classes with a link."""
    postings = _postings(sets, similar)
    fields = ("node", "n", "s", "j", "comp")
    # the first pivot is the set with fewest shingles of its own, the likeliest centre of a group; the others are picked by hash
    orders = {"first": [F.col("n") - F.col("s")], "others": [F.xxhash64(F.lit(i), "node") for i in range(PIVOTS)]}
    labels = None
    for step in ("first", "others", "pairs"):
        here = postings.withColumn("comp", F.col("node"))
        if labels is not None:
            here = postings.join(labels.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            labelled = saved(here, "join-labelled")
            several = saved(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "join-several")
            here = saved(labelled.join(several, "key"), "join-mixed")
            drop_saved(labelled, several)
            if here.isEmpty():
                break
        if step == "pairs":
            other, apart = here, F.col("node") < F.col("other")
        else:
            best = here.groupBy("key").agg(*(F.min(F.struct(o.alias("h"), *fields)).alias(f"p{i}") for i, o in enumerate(orders[step])))
            pivots = F.array_distinct(F.array(*(F.struct(*(f"p{i}.{f}" for f in fields)) for i in range(len(orders[step])))))
            other = saved(best.select("key", F.explode(pivots).alias("p")).select("key", "p.*"), "join-pivots")
            apart = F.col("node") != F.col("other")
        other = other.select("key", *(F.col(f).alias(to) for f, to in zip(fields, ("other", "m", "t", "k", "its"))))
        pairs = here.join(other, "key").filter(apart & (F.col("comp") != F.col("its")) & _possible(similar))
        found = saved(verify(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")), sets, similar), "join-links")
        if found.isEmpty():
            continue
        # what is connected already enters as its star
        known = found if labels is None else found.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v")))
        rooted = components(known)
        labels = saved(rooted, "join-labels")
        drop_saved(rooted)
    drop_saved(postings)
    return labels
