"""N-gram Jaccard join by T-occurrence search, exact and without listing all pairs of a group.

Texts become sets of hashed five-word shingles. Two sets link when ``100 * |A & B| >= 75 * |A | B|``, which asks for an
overlap of T; a set that links at all shares at least ceil(0.75 * size) of its shingles with others.

1. Exact copies collapse to one text (a narrow hash table, pre-aggregated).
2. *Census*: shingle hashes are dealt over hash ranges of bounded size as packed arrays; each range marks those that two
   texts hold. A text with too few shared shingles cannot link and leaves. Hashes are cut to 32 bits within a range, which
   can only keep a text too many.
3. The texts left get an inverted index ordered by list length. Of a set only the lists of its
   ``size - ceil(0.75 * size) + 1`` shortest shingles have to be merged to meet every partner at least once (the long
   lists are the T - 1 others).
4. *T-occurrence.* A round lets a member (the query) of every list ask; its list mates are candidates. :func:`merge_short` builds
   the posting lists of the candidates' short shingles and heap-merges those of the query's: a candidate's count there plus all
   of the T - 1 long lists must reach T, else it goes before its whole set is read. For the others :func:`probe_long` looks
   the long part up by binary search (DivideSkip with the largest possible set of long lists). Members already known to be
   connected need no search; a list closes when all members left are connected. Queries per list grow each round, as many
   as a fixed multiple of the first round's postings allows and at least fourfold, so every pair that is not connected
   otherwise is met, and no list is expanded into all its pairs. Only links between different components of a round enter
   the next connected components.

Tables that meet by a shingle, a text or a component are written before they are joined, so that the planner can split a hot
key of either side.

Shingles are 64-bit hashes of words hashed to 64 bits; two different shingles agree with probability 2**-64.

Defined results: null, empty and word-less texts have an empty set and link with nothing, copies included; fewer than five
words give one shingle of the whole sequence; repeated rows are copies; a null doc_id never becomes a component id unless the
component has no other; an empty table gives an empty result; other columns are ignored. Whole texts are read; a very long one
is hashed in memory (about 60 bytes a word) and is one row of the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, connected_components, cut, drop, pieces, releasing, shuffle_partitions

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BYTES = 2 << 20


class WordHashes(dict):
    """UTF-8 word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], words: WordHashes, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every whole text (UTF-8 bytes; A-Z lower-cased; words part at ASCII white space)."""
    split = [t.translate(_LOWER).split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((words[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    rolled = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = rolled * _MULTIPLIER + flat[k : k + len(rolled)]
    rolled, ends = mix64(rolled), np.cumsum(sizes)
    out = []
    for size, end in zip(sizes.tolist(), ends.tolist()):
        if size >= n:
            out.append(np.unique(rolled[end - size : end - n + 1]))
        elif size:
            h = np.array([size], np.uint64)
            for k in range(end - size, end):
                h = h * _MULTIPLIER + flat[k]
            out.append(mix64(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def merge_short(query: np.ndarray, records: list[np.ndarray]) -> list[int]:
    """How many of the query's short shingles each record holds among its own short ones.

    The posting lists of the records' shingles (record numbers in order) are cut out for the query's shingles and heap-merged.
    """
    flat = np.concatenate(records) if records else np.empty(0, query.dtype)
    owner = np.repeat(np.arange(len(records)), [len(r) for r in records])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    lists = [owner[a:b].tolist() for a, b in zip(np.searchsorted(flat, query), np.searchsorted(flat, query, "right")) if b > a]
    counts = [0] * len(records)
    for r in heapq.merge(*lists):
        counts[r] += 1
    return counts


def probe_long(part: np.ndarray, record: np.ndarray) -> int:
    """How many shingles of the long part the record (any order) holds, by binary search."""
    if not len(record):
        return 0
    record = np.sort(record)
    at = np.searchsorted(record, part)
    return int((record[np.minimum(at, len(record) - 1)] == part).sum())


def _chunks(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[pa.RecordBatch]:
    """Row runs of at most about ``_CHUNK_BYTES`` of text, whatever the batch size."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(lengths) // _CHUNK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


DEALT = "grp long, chunk long, keys string, owners binary, counts binary, hashes binary"
COUNTED = "chunk long, keys string, owners binary, counts binary"


def deal_chunk(sets: list[np.ndarray], ranges: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The hashes of a chunk's texts by range: range, texts that have hashes there, how many each, and the hashes cut to 32 bits.

    Only what is there is written, so the size is linear in the hashes however many ranges there are.
    """
    step = np.uint64(min((2**64 - 1) // ranges + 1, 2**64 - 1))
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    rng = (flat // step).astype(np.int64)
    order = np.argsort(rng, kind="stable")
    rng, owner = rng[order], owner[order]
    low = (flat % step % np.uint64(2**32)).astype(np.uint32)[order]
    first = np.flatnonzero(np.append(True, (rng[1:] != rng[:-1]) | (owner[1:] != owner[:-1]))) if len(rng) else np.empty(0, np.int64)
    texts, each = owner[first], np.diff(np.append(first, len(rng))).astype(np.uint32)
    edges = np.append(np.flatnonzero(np.append(True, rng[1:] != rng[:-1])), len(rng)) if len(rng) else np.zeros(1, np.int64)
    runs = np.searchsorted(first, edges)
    for a, b, i, j in zip(edges.tolist(), edges[1:].tolist(), runs.tolist(), runs[1:].tolist()):
        yield int(rng[a]), texts[i:j].tobytes(), each[i:j].tobytes(), low[a:b].tobytes()


def _deal(ranges: int, n: int):
    """Map side of the census: rows of ``DEALT``. A chunk's keys and set sizes go along in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        names = [x.split()[0] for x in DEALT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        for part in _chunks(batches, 1):
            keys = part.column(0).to_pylist()
            sets = shingle_sets(part.column(1).to_pylist(), words, n)
            chunk = xxhash.xxh3_64_intdigest("".join(keys)) >> 1
            sizes = np.array([len(s) for s in sets], np.uint32)
            rows = [(-1 - chunk % (4 * ranges), chunk, ",".join(keys), b"", sizes.tobytes(), b"")]
            for r, texts, each, low in deal_chunk(sets, ranges):
                rows.append((r, chunk, "", texts, each, low))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _census(group: pa.Table) -> pa.Table:
    """One hash range: per chunk, how many of each text's hashes another text holds too. Key rows pass through."""
    if group.column("grp")[0].as_py() < 0:
        return group.select(["chunk", "keys", "owners", "counts"])
    parts = [np.frombuffer(b, np.uint32) for b in group.column("hashes").to_pylist()]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    chunks, owners, counts = [], [], []
    for chunk, part, texts, each in zip(group.column("chunk").to_pylist(), parts, group.column("owners").to_pylist(), group.column("counts").to_pylist()):
        at = np.minimum(np.searchsorted(twice, part), max(len(twice) - 1, 0))
        shared = twice[at] == part if len(twice) else np.zeros(len(part), bool)
        each = np.frombuffer(each, np.uint32)
        found = np.bincount(np.repeat(np.arange(len(each)), each)[shared], minlength=len(each))
        if found.any():
            chunks.append(chunk)
            owners.append(np.frombuffer(texts, np.uint32)[found > 0].tobytes())
            counts.append(found[found > 0].astype(np.uint32).tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "keys": pa.array([""] * len(chunks), pa.string()), "owners": pa.array(owners, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _verdicts(percent: int):
    """Reduce side of the census: one chunk's counts over all ranges, and which texts may link."""

    def run(group: pa.Table) -> pa.Table:
        keys, sizes, found = [], np.empty(0, np.int64), []
        for k, o, c in zip(*(group.column(x).to_pylist() for x in ("keys", "owners", "counts"))):
            if k:
                keys, sizes = k.split(","), np.frombuffer(c, np.uint32).astype(np.int64)
            else:
                found.append((np.frombuffer(o, np.uint32), np.frombuffer(c, np.uint32)))
        shared = np.zeros(len(keys), np.int64)
        for owners, counts in found:
            shared[owners] += counts
        return pa.table({"key": keys, "n": sizes, "alive": (sizes > 0) & (100 * shared >= percent * sizes)})

    return run


def _sets(n: int):
    """Text rows to their sets: key, node (hash of the whole set), n, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in _chunks(batches, 1):
            sets = shingle_sets(part.column(1).to_pylist(), words, n)
            nodes = [int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["key", "node", "n", "shingles"],
            )

    return run


def _ints(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, node, both short parts, need) to the candidates that can still link, with their count ``met``. Rows of a query
    that come together are merged together."""
    for batch in batches:
        queries, need = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        met = np.zeros(len(queries), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(queries)) + 1).tolist(), len(queries)]
        for lo, hi in zip(edges, edges[1:]):
            for at in range(lo, hi, 512):
                end = min(at + 512, hi)
                met[at:end] = merge_short(_ints(batch.column(2), at), [_ints(batch.column(3), i) for i in range(at, end)])
        keep = pa.array(met >= need)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(met)], ["query", "node", "met"]).filter(keep)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, node, met, the long part of one, the whole set of the other, T) to links."""
    for batch in batches:
        met, t = batch.column(2).to_numpy(), batch.column(5).to_numpy()
        found = [m + probe_long(_ints(batch.column(3), i), _ints(batch.column(4), i)) for i, m in enumerate(met.tolist())]
        keep = pa.array(np.array(found, np.int64) >= t)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, m (shared shingles), short and long: the shared shingles by list length, parted so that the long part holds T - 1
    at the least T of any partner; last: the place of the short part's end in the common order. Only sets that can link."""
    post = sets.select("node", "n", F.explode("shingles").alias("h"))
    df = cut(post.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "join-lengths")
    ordered = post.join(df, "h").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    ordered = ordered.withColumn("m", F.size("s")).withColumn("cut", (F.col("m") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")).filter("cut >= 1")
    found = cut(
        ordered.select(
            "node", "n", "m", F.slice("s", F.lit(1), F.col("cut"))["h"].alias("short"),
            F.slice("s", F.col("cut") + 1, F.greatest(F.col("m") - F.col("cut"), F.lit(0)))["h"].alias("long"), F.element_at("s", F.col("cut")).alias("last"),
        ),
        "join-index",
    )
    drop(df)
    return found


def _links(pairs: DataFrame, index: DataFrame, overlap) -> DataFrame:
    """The (a, b) of ``pairs`` (query, node) that link."""
    ours = index.select(F.col("node").alias("query"), *[F.col(c).alias(f"q_{c}") for c in ("n", "m", "short", "long", "last")])
    t = overlap(F.col("n"), F.col("q_n"))
    # beyond the earlier of the two ends only that side's long part can hold more
    mine = F.col("q_last") <= F.col("last")
    rest = F.when(mine, F.col("q_m") - F.size("q_short")).otherwise(F.col("m") - F.size("short"))
    both = pairs.join(index.select("node", "n", "m", "short", "last"), "node").join(ours.drop("q_long"), "query")
    met = cut(both.select("query", "node", "q_short", "short", (t - rest).cast("long").alias("need")).mapInArrow(releasing(_merge), "query long, node long, met long"), "join-met")
    full = met.join(index, "node").join(ours, "query")
    part = F.when(mine, F.col("q_long")).otherwise(F.col("long"))
    whole = F.when(mine, F.concat("short", "long")).otherwise(F.concat("q_short", "q_long"))
    found = cut(full.select("query", "node", "met", part.alias("part"), whole.alias("whole"), t.cast("long").alias("t")).mapInArrow(releasing(_probe), "a long, b long"), "join-links")
    drop(met)
    return found


def link_components(sets: DataFrame, percent: int = 75, budget: int = 32) -> DataFrame:
    """(node, comp) for the nodes of ``sets`` (node, n, shingles; one row per node) that can link with another."""
    index = _index(sets, percent)
    least = F.ceil(F.col("n") * percent / 100)
    overlap = lambda a, b: F.ceil((a + b) * percent / (100 + percent))
    listed = index.select("node", "n", "m", F.posexplode("short").alias("i", "h")).select("node", "n", "m", (F.col("n") - F.col("m") + F.col("i") + 1).alias("pos"), "h")
    # Two sets that link first meet at a place no later than size - overlap + 1 in either. A member of a list can meet none there
    # if it could not even meet one of the list's smallest size, nor can it if its shared shingles are too few for that.
    shortest = cut(listed.groupBy("h").agg(F.min("n").alias("least_n"), F.count("*").alias("members")).filter("members > 1"), "join-shortest")
    easiest = overlap(F.col("n"), F.greatest("least_n", least))
    lists = cut(listed.join(shortest, "h").filter((F.col("pos") <= F.col("n") - easiest + 1) & (F.col("m") >= easiest)).select("node", "n", "m", "pos", "h"), "join-lists")
    drop(shortest)
    labels = index.select("node", F.col("node").alias("comp"))
    ahead, first, linked = 1, None, False
    while True:
        named = lists.join(labels, "node") if first else lists.withColumn("comp", F.col("node"))
        # The set with the fewest own shingles, the middle of a group of near copies, asks first and settles most of the list;
        # from then on those with the most own shingles ask, as they are the ones still apart.
        named = named.withColumn("who", F.struct((F.col("n") - F.col("m")).alias("own"), "node", "n", "m", "pos", "comp"))
        state = named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("who").alias("q"), F.count("*").alias("members"))
        open_ = cut(state.filter("lo < hi").select("h", "q", "members"), "join-open")
        postings = open_.agg(F.sum("members")).first()[0] or 0
        if not postings:
            drop(open_)
            break
        if first is None:
            first, asking, done = postings, open_.select("h", "q"), F.col("node") == F.col("q.node")
            met = left = named.join(asking, "h").filter(~done)
        else:
            ahead = max(4 * ahead, budget * first // postings)
            live = cut(named.join(open_.select("h"), "h"), "join-live")
            turn = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("who")))  # limited before the shuffle
            asked = cut(live.select("h", F.col("who").alias("q"), turn.alias("rn")).filter(F.col("rn") <= ahead).select("h", "q"), "join-asked")
            met = live.join(asked, "h").filter(F.col("who") < F.col("q"))
            left = live.join(asked.groupBy("h").agg(F.min("q").alias("last")), "h").filter(F.col("who") < F.col("last"))
        t = overlap(F.col("n"), F.col("q.n"))
        possible = (
            (100 * F.least("n", "q.n") >= percent * F.greatest("n", "q.n")) & (F.least("m", "q.m") >= t)
            & (F.col("pos") <= F.col("n") - t + 1) & (F.col("q.pos") <= F.col("q.n") - t + 1)
        )
        pairs = cut(met.filter((F.col("comp") != F.col("q.comp")) & possible).select(F.col("q.node").alias("query"), "node").distinct(), "join-pairs")
        kept = cut(left.select("node", "n", "m", "pos", "h"), "join-lists")
        for done_with in (lists, open_) if ahead == 1 else (lists, open_, live, asked):
            drop(done_with)
        lists = kept
        if not pairs.isEmpty():
            links = _links(pairs, index, overlap)
            if not links.isEmpty():
                labels, linked = _joined_labels(labels, links, linked), True
            drop(links)
        drop(pairs)
    if not linked:
        labels = cut(labels, "join-labels")
    drop(lists)
    drop(index)
    return labels


def _joined_labels(labels: DataFrame, links: DataFrame, named: bool) -> DataFrame:
    """Labels after the links: connected components of the components that they join."""
    edges = links
    if named:
        end = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        edges = links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    found = connected_components(edges.filter("a <> b"))
    top = found.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    out = cut(labels.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "join-labels")
    drop(found)
    drop(labels)
    return out


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)


def placed_texts(docs: DataFrame, n: int = 5, percent: int = 75, range_hashes: int = 700_000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) and distinct texts (key, rep: the row that stands for it, least: its smallest doc_id, n, place); texts
    of one component share a place. Both are cut to the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    keyed = rows.withColumn("key", _text_key(F.col("text")))
    named = cut(keyed.select("doc_id", "key", F.octet_length("text").alias("bytes")), "join-keys")
    copies = named.groupBy("key").agg(F.min(F.struct(F.col("doc_id"))).alias("rep"), F.min("doc_id").alias("least"), F.max("bytes").alias("bytes"))
    copies = cut(copies.select("key", F.col("rep.doc_id").alias("rep"), "least", "bytes"), "join-copies")
    total = copies.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(shuffle_partitions(spark), pieces(total / 6, range_hashes))

    def texts_of(chosen: DataFrame) -> DataFrame:
        c = chosen.select(F.col("rep").alias("c_id"), F.col("key").alias("c_key"))
        return keyed.join(c, (keyed["key"] == c["c_key"]) & keyed["doc_id"].eqNullSafe(c["c_id"])).select("key", "text")

    dealt = texts_of(copies).mapInArrow(releasing(_deal(ranges, n)), DEALT)
    counted = dealt.groupBy("grp").applyInArrow(_census, COUNTED)
    found = cut(counted.groupBy("chunk").applyInArrow(_verdicts(percent), "key string, n long, alive boolean"), "join-census", BATCH_BYTES)
    # exactly repeated rows stand for one text
    verdicts = found.groupBy("key").agg(F.max("n").alias("n"), F.max("alive").alias("alive"))
    chosen = copies.join(verdicts.filter("alive").select("key"), "key").select("rep", "key")
    members = cut(texts_of(chosen).mapInArrow(releasing(_sets(n)), "key string, node long, n long, shingles array<long>"), "join-sets", BATCH_BYTES)
    sets = cut(members.select("node", "n", "shingles").dropDuplicates(["node"]), "join-classes")
    labels = link_components(sets, percent)
    drop(sets)
    classes = members.select("key", "node").distinct().join(labels, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    placed = copies.join(verdicts, "key").join(classes, "key", "left")
    placed = cut(placed.select("key", "rep", "least", "n", F.coalesce(F.col("comp").cast("string"), "key").alias("place")), "join-places")
    for table in (found, copies, members, labels):
        drop(table)
    return named.select("doc_id", "key"), placed


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    rows, texts = placed_texts(docs, n, percent)
    smallest = cut(texts.groupBy("place").agg(F.min("least").alias("smallest")), "join-smallest")
    named = cut(texts.join(smallest, "place").select("key", "n", "smallest"), "join-named")
    drop(smallest)
    drop(texts)
    return rows.join(named, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id")
    )


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` (all columns) with one row of each component, that of the smallest doc_id (of exactly repeated rows one); texts
    without words all stay."""
    rows, texts = placed_texts(docs, n, percent)
    leads = texts.filter("n > 0").groupBy("place").agg(F.min(F.struct("rep", "key")).alias("lead")).select(F.col("lead.rep").alias("_k_id"), F.col("lead.key").alias("_k_key"), F.lit(True).alias("_k_once"))
    bare = rows.join(texts.filter("n = 0").select("key"), "key").select(F.col("doc_id").alias("_k_id"), F.col("key").alias("_k_key"), F.lit(False).alias("_k_once")).distinct()
    kept = cut(leads.union(bare), "join-kept")
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(names)])
    text, doc = f"_d{names.index('text')}", f"_d{names.index('doc_id')}"
    out = hidden.withColumn("_key", _text_key(F.col(text).cast("string"))).join(kept, (F.col("_key") == F.col("_k_key")) & F.col(doc).cast("long").eqNullSafe(F.col("_k_id")))
    # only rows that agree in id and text can be more than one; whether there are any is told by narrow columns
    ids = rows.groupBy("doc_id", "key").count().filter("count > 1").join(kept.filter("_k_once"), (F.col("key") == F.col("_k_key")) & F.col("doc_id").eqNullSafe(F.col("_k_id"))).select("_k_id", "_k_key")
    if not ids.isEmpty():
        out = out.filter(~F.col("_k_once")).union(out.filter("_k_once").dropDuplicates(["_key", doc]))
    return out.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
