"""Near-duplicate classes by ProbMinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, parts, release, slices, staged, utf8
from tessera.llm.repeats import Plan, Slice

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BROADCAST_IDS = 500_000
_BLOCK_TEXTS = 1_000
_GROUP_BYTES = 4 << 20


def weighted_shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 64-bit shingle hash, count) of each distinct word shingle of each text, by text and hash. A text of fewer words is one shingle of them all."""
    s = Slice.of_fragments(raw, np.diff(off), np.zeros(len(off) - 1, np.int64), Plan(n=width, k=1, words=True))
    n = np.diff(s.sym_off)
    short = (n > 0) & (n < width)
    x = np.concatenate([s.sym, np.zeros(width, np.uint64)])
    h = np.zeros(len(s.sym), np.uint64)
    for j in range(width):
        h = mix(h * _STEP + x[j : j + len(h)])
    count = np.where(n >= width, n - width + 1, 0)
    at = np.repeat(s.sym_off[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    docs, hashes = [np.repeat(np.arange(len(n)), count)], [h[at]]
    for j in range(1, width):
        these = np.flatnonzero(short & (n == j))
        if len(these):
            g = np.full(len(these), j, np.uint64)
            for i in range(j):
                g = mix(g * _STEP + s.sym[s.sym_off[these] + i])
            docs.append(these)
            hashes.append(g)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    # one sort by text and the hash's upper bits; texts in which those tie are put right by a full sort
    bits = np.uint64(max(1, int(len(n)).bit_length()))
    order = np.argsort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    doc, h = doc[order], h[order]
    if np.any((doc[1:] == doc[:-1]) & (h[1:] < h[:-1])):
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff([*first, len(h)])


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (docs x m): position k holds 32 bits of the shingle whose arrival at k is earliest.

    Each shingle is a Poisson process of rate its weight; its i-th arrival comes an exponential waiting time (hashed from shingle and i) after the one before and
    falls on a hashed position. A position of two texts agrees with the probability Jaccard of their weights. A shingle's process ends once its next arrival
    comes after the latest of the earliest arrivals of its text, as it can change no position any more.
    """
    earliest = np.full(docs * m, np.inf)
    winner = np.zeros(docs * m, np.uint32)
    seed, at, rate, time = mix(shingle + _STEP), doc, weight.astype(np.float64), np.zeros(len(doc))
    mark, i = (seed >> np.uint64(32)).astype(np.uint32), 0
    while len(at):
        i += 1
        r = mix(seed + np.uint64(i * int(_STEP) % (1 << 64)))
        time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        place = at * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, place, time)
        won = time == earliest[place]
        winner[place[won]] = mark[won]
        last = earliest.reshape(docs, m).max(1)
        go = time < last[at]
        seed, at, rate, time, mark = seed[go], at[go], rate[go], time[go], mark[go]
    return winner.reshape(docs, m)


def probability_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i), exactly, in one sort by the ratio x / y."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = w1[i].astype(np.float64), w2[j].astype(np.float64)
    only_x, only_y = w1.sum() - x.sum(), w2.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # for i: those of a ratio at least its own count by x, the others by y
    below = np.searchsorted(ratio, ratio, "left")
    cx, cy = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    return float((1 / ((cx[-1] - cx[below] + only_x) / x + (cy[below] + only_y) / y)).sum())


def block_links(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (x, y), x of left and y of right, of a probability Jaccard >= threshold that join different labels, tested exactly.

    Every pair of different labels is tested, by counting the shingles that a text shares with all others at once. The sum of min(p, q) of the normalised weights
    bounds the similarity from above; where all weights are one, the similarity is the Jaccard of the shingle sets. What is left is computed in full. Labels that a link joins
    are one from then on, so only links that a spanning forest needs are returned.
    """
    docs = len(label)
    at = np.searchsorted(doc, np.arange(docs + 1))
    total = np.bincount(doc, weight, docs)
    n = np.diff(at)
    plain = np.bincount(doc, weight > 1, docs) == 0
    values, slot = np.unique(shingle, return_inverse=True)
    in_right = np.zeros(docs, bool)
    in_right[right] = True
    mine = np.flatnonzero(in_right[doc])
    by = mine[np.argsort(slot[mine], kind="stable")]
    first = np.searchsorted(slot[by], np.arange(len(values) + 1))
    share = weight / total[doc]
    parent = {int(x): int(x) for x in np.unique(label)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    both = bool(np.isin(left, right).any())
    for x in left.tolist():
        own = np.arange(at[x], at[x + 1])
        lo, size = first[slot[own]], np.diff(first)[slot[own]]
        upper, common = np.zeros(docs), np.zeros(docs, np.int64)
        for i, j in slices(np.concatenate([[0], np.cumsum(size)]), 2_000_000):
            reps = size[i:j]
            pick = by[np.repeat(lo[i:j] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
            d = doc[pick]
            upper += np.bincount(d, np.minimum(share[pick], np.repeat(share[own[i:j]], reps)), docs)
            common += np.bincount(d, minlength=docs)
        near = np.flatnonzero((upper >= threshold - 1e-9) & (label != label[x]))
        if both:
            near = near[(near > x) | ~np.isin(near, left)]
        sets = common[near] / (n[x] + n[near] - common[near])
        sure = plain[near] & plain[x]
        for y in near[~sure | (sets >= threshold - 1e-9)].tolist():
            a, b = root(int(label[x])), root(int(label[y]))
            if a == b:
                continue
            i, j = slice(at[x], at[x + 1]), slice(at[y], at[y + 1])
            if (plain[x] and plain[y]) or probability_jaccard(shingle[i], weight[i], shingle[j], weight[j]) >= threshold - 1e-9:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def sign(docs: DataFrame, key: str, text: str, width: int, m: int, slice_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, same, n, sig): same is a 128-bit digest of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in slices(off, slice_bytes):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                doc, shingle, weight = weighted_shingles(part, at, width)
                sig = signatures(doc, shingle, weight, j - i, m)
                same = [hashlib.blake2b(part[p:q].tobytes(), digest_size=16).digest() for p, q in zip(at[:-1], at[1:])]
                n = np.bincount(doc, minlength=j - i)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel().view(np.int32), pa.int32()), m).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(same, pa.binary()), pa.array(n, pa.int64()), rows], names=["doc_id", "same", "n", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, same binary, n long, sig array<int>")


def _texts_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct texts of a group's rows, decompressed and cut into shingles, and which of them each row has."""
    codec, at, each = pa.Codec("zstd"), {}, []
    pieces: list[bytes] = []
    sizes = table.column("size").to_numpy()
    for i, (id_, blob) in enumerate(zip(table.column("id").to_pylist(), table.column("blob").to_pylist())):
        if (id_, blob) not in at:
            at[id_, blob] = len(pieces)
            pieces.append(codec.decompress(blob, int(sizes[i]), asbytes=True) if sizes[i] else b"")
        each.append(at[id_, blob])
    off = np.concatenate([[0], np.cumsum([len(t) for t in pieces])]).astype(np.int64)
    return np.array(each, np.int64), *weighted_shingles(np.frombuffer(b"".join(pieces), np.uint8), off, width)


def _total(ids: DataFrame, texts: DataFrame) -> int:
    """Bytes of the texts of a column of ids, each as often as it occurs."""
    return int(ids.join(texts.groupBy("id").agg(F.sum("size").alias("size")), "id").agg(F.sum("size")).first()[0] or 0)


def _verify(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those (a, b) of pairs of which some texts have a probability Jaccard >= threshold. texts: (id, size, blob), blob zstd; an id may have several.

    The partners of one a are cut into chunks of at most 64 and about 4 MB, so that a hot one fills no task; its text goes to each of its chunks once.
    """
    sizes = texts.groupBy("id").agg(F.sum("size").alias("size"))
    groups = parts(2 * _total(pairs.select(F.col("b").alias("id")), texts), _GROUP_BYTES)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).join(sizes.withColumnRenamed("id", "a"), "a")
    chunks = F.ceil(F.greatest(F.col("c") / F.lit(64), F.col("c") * F.col("size") / F.lit(_GROUP_BYTES)))
    cut = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), chunks).alias("p"))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("a", "p"), F.lit(groups)).cast("int"))
    members = cut.select("g", "a", F.col("b").alias("id"))
    leads = cut.select("g", "a", F.col("a").alias("id")).distinct()
    rows = members.unionByName(leads).join(texts, "id")

    def run(table: pa.Table) -> pa.Table:
        each, doc, shingle, weight = _texts_of(table, width)
        at = np.searchsorted(doc, np.arange(int(each.max()) + 2))
        a, ids = table.column("a").to_numpy(), table.column("id").to_numpy()
        leads: dict[int, set[int]] = {}
        for k in np.flatnonzero(a == ids).tolist():
            leads.setdefault(int(a[k]), set()).add(int(each[k]))
        out = set()
        for k in np.flatnonzero(a != ids).tolist():
            j = slice(at[each[k]], at[each[k] + 1])
            for x in leads[int(a[k])]:
                i = slice(at[x], at[x + 1])
                if probability_jaccard(shingle[i], weight[i], shingle[j], weight[j]) >= threshold - 1e-9:
                    out.add((int(a[k]), int(ids[k])))
                    break
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return staged(rows.select("g", "a", "id", "size", "blob").groupBy("g").applyInArrow(run, "a long, b long"), "verified")


def _across(open_: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) between members of one band value that are in different components, enough of them to join what is linked. open_: (h, id, label).

    The members of a band value are cut into blocks of at most about 1,000 texts and 4 MB; a task has two blocks of it and tests all their pairs, see block_links.
    No pair is listed outside a task, and a text goes to as many tasks as its band value has blocks.
    """
    sizes = texts.groupBy("id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    sized = open_.join(sizes, "id")
    per = sized.groupBy("h").agg(F.sum("texts").alias("m"), F.sum("size").alias("bytes"))
    per = staged(per.select("h", F.ceil(F.greatest(F.col("m") / F.lit(_BLOCK_TEXTS), F.col("bytes") / F.lit(_GROUP_BYTES))).cast("int").alias("blocks"), "bytes"), "blocks")
    groups = parts(per.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0, _GROUP_BYTES)
    own = open_.join(per.select("h", "blocks"), "h").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block k meets itself and every other one: tasks (i, j) with i <= j
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("h", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "id", "label")
    rows = met.withColumn("g", F.pmod(F.xxhash64("h", "i", "j"), F.lit(groups)).cast("int")).join(texts, "id")

    def run(table: pa.Table) -> pa.Table:
        each, doc, shingle, weight = _texts_of(table, width)
        at = np.searchsorted(doc, np.arange(int(each.max()) + 2))
        h, i, j, k, ids, label = (table.column(c).to_numpy() for c in ("h", "i", "j", "k", "id", "label"))
        order = np.lexsort((k, j, i, h))
        key = np.stack([h, i, j])[:, order]
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        out = set()
        for lo, hi in zip([0, *edges], [*edges, len(order)]):
            these = order[lo:hi]
            if len(np.unique(label[these])) < 2:
                continue
            t = each[these]
            size = at[t + 1] - at[t]
            pick = np.repeat(at[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            local = np.repeat(np.arange(len(t)), size)
            same = i[these[0]] == j[these[0]]
            left = np.arange(len(t)) if same else np.flatnonzero(k[these] == i[these[0]])
            right = left if same else np.flatnonzero(k[these] != i[these[0]])
            if len(left) and len(right):
                for x, y in block_links(local, shingle[pick], weight[pick], label[these], left, right, threshold):
                    a, b = sorted((int(ids[these[x]]), int(ids[these[y]])))
                    out.add((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    found = staged(rows.select("g", "h", "i", "j", "k", "id", "label", "size", "blob").groupBy("g").applyInArrow(run, "a long, b long"), "across")
    release(per)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's component; nodes without edges are absent.

    Labels move along edges and are then looked up in themselves (pointer jumping), each round a written table, until none changes: about log2 of the longest path in rounds.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = old = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("near"))
        moved = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = moved.select(F.col("id").alias("label"), F.col("label").alias("top"))
        new = staged(moved.join(up, "label").select("id", "old", F.least("label", "top").alias("label")), "labels")
        release(old)
        labels, old = new.select("id", "label"), new
        if not new.filter(F.col("label") != F.col("old")).limit(1).count():
            release(both)
            labels._staged_at = new._staged_at
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, rows: int = 4, bands: int = 24) -> DataFrame:
    """(doc_id, class_id, n_shingles): one row per row of docs; class_id is the least id of its near-duplicate class.

    1. ProbMinHash signatures of rows x bands positions over word shingles weighted by their counts. 2. Equal texts (by a 128-bit digest) become one node, named by their least id.
    3. Nodes that agree in all positions of a band are candidates. Each band value pairs its members with its least member; those pairs are
    verified exactly by their shingle weights, and components taken. 4. Members of one band value that are still in different components are tested against each other, all of
    them, block by block inside tasks: no candidate link between different components is lost, and no pair is listed. 5. Components once more.

    With 4 x 24 positions a pair of similarity 0.8 shares no band with probability 3e-6. A text of fewer than `width` words is one shingle; texts without words (null, empty,
    blank) are alone in their class, as are rows with a null id (class null). Rows that share an id are one document, whose classes merge. An empty table gives no rows.
    """
    signed = staged(sign(docs, key, text, width, rows * bands), "signed")
    live = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    rep = staged(live.groupBy("same").agg(F.min(F.struct("doc_id", "sig")).alias("s")).select("same", F.col("s.doc_id").alias("id"), "s.sig"), "nodes")
    values = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    banded = rep.select("id", F.explode(values).alias("h"))
    leads = banded.groupBy("h").agg(F.min("id").alias("lead"), F.max("id").alias("most")).filter(F.col("lead") < F.col("most")).select("h", "lead")
    shared = staged(banded.join(leads, "h").select("h", "lead", "id"), "bands")
    ids = staged(shared.select("id").distinct(), "ids")
    named = staged(signed.select("doc_id", "n", "same").join(rep.select("same", "id"), "same", "left").select("doc_id", "n", "id"), "named")
    release(signed, rep)
    few = ids.count() <= _BROADCAST_IDS
    wanted = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    texts = staged(_compressed(wanted.join(F.broadcast(ids) if few else ids, "id", "left_semi")), "texts")
    release(ids)
    pairs = staged(shared.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    verified, several = _verify(pairs, texts, width, threshold), _one_id_many_texts(named)
    edges = verified.unionByName(several)
    labels = components(edges)
    release(pairs)
    labelled = shared.select("h", "id").join(labels, "id", "left").select("h", "id", F.coalesce("label", "id").alias("label"))
    spread = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("h")
    open_ = staged(labelled.join(spread, "h").distinct(), "open")
    release(shared)
    across = _across(open_, texts, width, threshold)
    release(open_, texts)
    if across.limit(1).count():
        release(labels)
        labels = components(edges.unionByName(across))
    release(verified, several, across)
    out = named.join(labels, "id", "left").select("doc_id", F.coalesce("label", "id").alias("label"), F.col("n").alias("n_shingles"))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("label")).alias("class_id"), "n_shingles")


def _one_id_many_texts(named: DataFrame) -> DataFrame:
    """Edges between the nodes of each id that has several texts."""
    nodes = named.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("id").alias("b"))
    several = nodes.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("most")).filter("a < most").select("doc_id", "a")
    return staged(nodes.join(several, "doc_id").filter("a <> b").select("a", "b").distinct(), "several")


def _compressed(texts: DataFrame) -> DataFrame:
    """(id, size, blob) of the texts of each id, repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            raw, off = utf8(b.column(1))
            pieces = [raw[p:q].tobytes() for p, q in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in pieces], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in pieces], pa.binary())], names=["id", "size", "blob"]
            )

    return texts.mapInArrow(run, "id long, size long, blob binary").dropDuplicates(["id", "size", "blob"])
