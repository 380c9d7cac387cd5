"""Exact Jaccard join of word n-gram sets, with skipping by set relations.

Sets are hashed shingles.  Texts with one and the same set form a class, of
which one entry takes part; all the rest is about different sets.

*Order.*  Shingles are ordered by how frequent they are in the whole corpus
(counted in hashed buckets, a table of fixed size that tasks fill and that is
summed), rare ones first.  Two sets that reach the threshold t share a shingle
among the first ``n - ceil(t n) + 1`` of each, so only these are indexed.

*Index-level skipping.*  A shingle's list is ordered by set size.  Lists are cut
in blocks; a block is skipped when its largest remaining length (size minus
position) cannot give the overlap that its smallest size asks for.

*Answer-level skipping.*  A set first asks only one other set, its leader: the
set that heads most of its lists (least edited sets do).  If the two are similar, their answers hold for
one component, so that the members of a large group of near copies are not
compared with one another.  Afterwards lists are read again for the pairs that
are still in different components, and these are compared exactly.  No link is
lost: a pair is skipped only when it is known to be in one component, or when
the length and position bounds prove it too different.

Texts are fetched for the pairs to compare only, each once per leader.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import discard, doc_id, materialize, partitions, quoted, row_key, small_batches, unused
from .textkit import chunks, shingles, words_of

#: log2 of the frequency table's buckets, and buckets in one of its rows.
LOG2_BUCKETS, BLOCK = 21, 1 << 15
#: Entries of a list that are compared or skipped together.
SKIP_BLOCK = 64
#: Sets sent to one task with their leader.
GROUP = 512


def _need(numerator: int, denominator: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of sizes a and b that reaches the threshold numerator / denominator."""
    return -(-numerator * (a + b) // (numerator + denominator))


def _prefix(sizes, numerator: int, denominator: int):
    return sizes - (-(-numerator * sizes // denominator)) + 1


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64)


def _sets(batch_texts: pa.Array, gram: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, buf, offs in chunks(batch_texts):
        words, first = words_of(buf, offs, lower)
        grams, at = shingles(words, first, gram)
        for i in range(b - a):
            yield a + i, np.unique(grams[at[i] : at[i + 1]])


def _sid(s: np.ndarray) -> int:
    """64-bit identity of a set, from its sorted members."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_frequency(docs: DataFrame, gram: int, lower: bool) -> np.ndarray:
    """Frequency class (a byte: eighths of log2) of each bucket, over all texts.  Its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << LOG2_BUCKETS, np.int64)
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                words, first = words_of(buf, offs, lower)
                counts += np.bincount(_bucket(shingles(words, first, gram)[0]), minlength=len(counts))
        rows = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(c), np.int64)
                sums[k] = sums[k] + got if k in sums else got
        classes = [np.minimum(255, 8 * np.log2(1 + v)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(classes, pa.binary())], names=["block", "classes"])

    blocks = (1 << LOG2_BUCKETS) // BLOCK
    rows = docs.select("text").mapInArrow(count, "block long, counts binary").repartition(min(blocks, partitions(docs.sparkSession)), "block").mapInArrow(add, "block long, classes binary").toArrow()
    out = np.zeros((blocks, BLOCK), np.uint8)
    for k, c in zip(rows["block"].to_pylist(), rows["classes"].to_pylist()):
        out[k] = np.frombuffer(c, np.uint8)
    return out.ravel()


def _entries(docs: DataFrame, frequency: np.ndarray, gram: int, lower: bool, t: tuple[int, int]) -> DataFrame:
    """One row per text (token null: identity and size of its set) and one per prefix shingle of each new set of a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            tokens, sids, sizes, spots, heads = [], [], [], [], []
            for i, s in _sets(batch.column(1), gram, lower):
                n, sid = len(s), _sid(s)
                heads.append((keys[i], sid, n))
                if n and sid not in seen:
                    seen.add(sid)
                    p = int(_prefix(n, *t))
                    order = np.lexsort((s, classes[_bucket(s)]))[:p]
                    tokens.append(s[order])
                    sids.append(np.full(p, sid))
                    sizes.append(np.full(p, n))
                    spots.append(np.arange(p))
            none = np.zeros(0, np.int64)
            cat = lambda x: np.concatenate(x) if x else none
            m = sum(map(len, tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(len(heads), pa.int64()), pa.array(cat(tokens).astype(np.uint64).view(np.int64))]),
                    pa.array(np.concatenate([np.array([h[1] for h in heads], np.int64), cat(sids)])),
                    pa.array(np.concatenate([np.array([h[2] for h in heads], np.int64), cat(sizes)]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(heads), np.int64), cat(spots)]).astype(np.int32)),
                    pa.concat_arrays([pa.array([h[0] for h in heads], pa.int64()), pa.nulls(m, pa.int64())]),
                ],
                names=["token", "sid", "size", "pos", "key"],
            )

    return docs.select("_key", "text").mapInArrow(run, "token long, sid long, size int, pos int, key long")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive pieces that end where a token ends; the input is sorted by token."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last token may go on
        if cut or held and held[0][0][0] != cols[0][-1]:
            done = [np.concatenate([h[k] for h in held] + [c[:cut]]) for k, c in enumerate(cols)]
            held = []
            if len(done[0]):
                yield done
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(names))]


def _leaders(entries: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Entries of lists of two sets or more, with the list's leader for the set's size band.

    The leader is the set in which the fewest rarer shingles come first: the
    least edited member of a group of near copies.  Streams through the sorted rows and keeps one row, so a list of any length passes.
    """
    step = np.log(t[1] / t[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row held back, and whether its token had one before it
        lead = None
        for batch in batches:
            tok, band, sid, size, pos = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("token", "band", "sid", "size", "pos"))
            if not len(tok):
                continue
            if last is not None:
                tok, band, sid, size, pos = (np.concatenate([[v], x]) for v, x in zip(last[:5], (tok, band, sid, size, pos)))
            fresh = np.ones(len(tok), bool)  # tasks that met the same set sent the same rows
            fresh[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
            tok, band, sid, size, pos = (x[fresh] for x in (tok, band, sid, size, pos))
            n = len(tok)
            new = np.ones(n, bool)
            new[1:] = (tok[1:] != tok[:-1]) | (band[1:] != band[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            lsid, lsize, lpos = sid[at], size[at], pos[at]
            if last is not None and not last[6]:  # the held row continues a group that began earlier
                same = at == 0
                lsid[same], lsize[same], lpos[same] = lead
            before = np.zeros(n, bool)
            before[1:] = tok[1:] == tok[:-1]
            before[0] = last is not None and last[5]
            multi = before.copy()
            multi[:-1] |= before[1:]
            keep = multi[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (tok, sid, size, pos, lsid, lsize, lpos)], names=OUT)
            last = (tok[-1], band[-1], sid[-1], size[-1], pos[-1], bool(before[-1]), bool(at[-1] == n - 1 and (n > 1 or last is None or last[6])))
            lead = (lsid[-1], lsize[-1], lpos[-1])
        if last is not None and last[5]:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([v])) for v in (*last[:1], *last[2:5], *lead)], names=OUT)

    OUT = ["token", "sid", "size", "pos", "lsid", "lsize", "lpos"]
    lists = entries.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(float(step))).cast("int"))
    lists = lists.repartition(partitions(entries.sparkSession), "token").sortWithinPartitions("token", "band", "pos", "sid")
    return lists.mapInArrow(run, "token long, sid long, size int, pos int, lsid long, lsize int, lpos int")


def _possible(size: str, pos: str, osize: str, opos: str, t: tuple[int, int]):
    """Whether the length and position bounds allow two sets to reach the threshold."""
    a, b = F.col(size).cast("long"), F.col(osize).cast("long")
    need = F.ceil((a + b) * t[0] / (t[0] + t[1]) - 1e-9)
    return (F.least(a - F.col(pos), b - F.col(opos)) >= need) & (F.least(a, b) * t[1] >= F.greatest(a, b) * t[0])


def _cross_pairs(lists: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Distinct pairs of one list that the bounds allow and that are in different components (column comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, size, pos, sid, comp in _runs(batches, ("token", "size", "pos", "sid", "comp")):
            first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            ends = np.append(first[1:], len(tok))
            size, rest = size.astype(np.int64), size.astype(np.int64) - pos
            found: list[np.ndarray] = []
            for lo, hi in zip(first.tolist(), ends.tolist()):
                if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                    continue
                blocks = [(s, min(s + SKIP_BLOCK, hi)) for s in range(lo, hi, SKIP_BLOCK)]
                widest = [int(rest[s:e].max()) for s, e in blocks]
                for i in range(lo, hi - 1):
                    x, r = int(size[i]), int(rest[i])
                    for (s, e), most in zip(blocks[(i - lo) // SKIP_BLOCK :], widest[(i - lo) // SKIP_BLOCK :]):
                        s = max(s, i + 1)
                        if s >= e:
                            continue
                        if int(size[s]) * t[0] > x * t[1]:
                            break  # sizes rise: nothing further is small enough
                        if min(r, most) < int(_need(*t, x, int(size[s]))):
                            if r < int(_need(*t, x, int(size[s]))):
                                break  # this set's rest is too short for all that follow
                            continue
                        y = size[s:e]
                        ok = (comp[s:e] != comp[i]) & (y * t[0] <= x * t[1]) & (np.minimum(r, rest[s:e]) >= _need(*t, x, y))
                        if ok.any():
                            other = sid[s:e][ok]
                            found.append(np.stack([np.minimum(sid[i], other), np.maximum(sid[i], other)]))
                if sum(f.shape[1] for f in found) > 1 << 16:
                    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
                    found = []
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    sorted_lists = lists.repartition(partitions(lists.sparkSession), "token").sortWithinPartitions("token", "size", "sid")
    return sorted_lists.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, gram: int, lower: bool, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    The pairs of one ``a`` are split in groups of about ``GROUP``; a group's
    task gets the text of ``a`` once and those of its partners.
    """
    n_groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    split = n_groups.filter("groups > 1")
    salted = pairs.join(split, "a", "left").withColumn("g", F.pmod(F.xxhash64("b"), F.coalesce(F.col("groups"), F.lit(1))).cast("int"))
    partners = salted.select("a", "g", F.col("b").alias("sid")).join(texts.hint("merge"), "sid").select("a", "g", "sid", "text")
    owners = n_groups.select(F.col("a").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g")).join(texts.hint("merge"), "sid").select(F.col("sid").alias("a"), "g", "sid", "text")
    rows = partners.union(owners).withColumn("own", F.col("sid") != F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, mine = None, None
        for batch in batches:
            a, g, sid = (batch.column(k).to_pylist() for k in (0, 1, 2))
            left, right = [], []
            for i, s in _sets(batch.column(3), gram, lower):
                if sid[i] == a[i]:
                    owner, mine = (a[i], g[i]), s
                elif owner == (a[i], g[i]):
                    n, m = len(mine), len(s)
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if both * t[1] >= t[0] * (n + m - both):
                        left.append(a[i])
                        right.append(sid[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    sorted_rows = rows.repartition(partitions(pairs.sparkSession), "a", "g").sortWithinPartitions("a", "g", "own")
    return sorted_rows.select("a", "g", "sid", "text").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, gram: int = 4, threshold: tuple[int, int] = (85, 100), lower: bool = True) -> DataFrame:
    """Components of the texts whose sets of ``gram``-word shingles are similar.

    ``threshold`` is a fraction: two texts link when intersection * denominator
    >= numerator * union.  Returns one row per input row: doc_id, n_shingles,
    component_id (least doc_id reachable, itself included), first (whether the
    row stands for its component: the least doc_id, one without id only if all
    are) and _key (hash of id and text).  A null, empty or blank text has an empty set and is linked with
    nothing, so its component is its own doc_id; equal texts are linked;
    repeated rows give repeated rows; a null doc_id takes part and never is the
    least one; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    base = docs.select(doc_id(), F.col("text"), row_key().alias("_key"))
    entries = _entries(base, shingle_frequency(base, gram, lower), gram, lower, threshold)
    all_rows = materialize(entries.filter("token is not null or key is not null").select("token", "sid", "size", "pos", "key"), "jaccard-entries")
    heads = all_rows.filter("token is null").groupBy("key").agg(F.first("sid").alias("sid"), F.first("size").cast("long").alias("n_shingles"))
    heads = materialize(heads, "jaccard-heads")
    prefixes = all_rows.filter("token is not null").select("token", "sid", "size", "pos")
    lists = materialize(_leaders(prefixes, threshold), "jaccard-lists")

    discard(all_rows)

    # A set's leader: the one that heads most of its lists, as far as the bounds allow.
    asked = lists.filter((F.col("sid") != F.col("lsid")) & _possible("size", "pos", "lsize", "lpos", threshold)).groupBy("sid", "lsid").agg(F.count("*").alias("n"))
    first = materialize(asked.groupBy("sid").agg(F.max_by("lsid", F.struct("n", F.col("lsid"))).alias("a")).select("a", F.col("sid").alias("b")), "jaccard-leaders")
    wanted = lists.filter(_reachable(threshold)).select("sid").distinct()
    one = heads.groupBy("sid").agg(F.min("key").alias("key")).join(wanted, "sid", "left_semi")
    # Joined by sorting at every size: what fits a broadcast on a small corpus would not on a large one.
    one = one.withColumnRenamed("key", "_key").hint("merge")
    texts = base.select("_key", "text").join(one, "_key").dropDuplicates(["_key"]).select("sid", "text")  # no further shuffle
    texts = materialize(texts, "jaccard-texts")
    links = materialize(_verified(first, texts, gram, lower, threshold), "jaccard-links")
    labels = connected_components(links)

    located = lists.select("token", "sid", "size", "pos").join(labels.withColumnRenamed("v", "sid"), "sid", "left")
    cross = materialize(_cross_pairs(located.select("token", "sid", "size", "pos", F.coalesce("label", "sid").alias("comp")), threshold), "jaccard-cross")
    discard(lists)
    more = materialize(_verified(cross, texts, gram, lower, threshold), "jaccard-links")
    discard(texts)
    labels = connected_components(links.union(more))

    member = heads.join(labels.withColumnRenamed("v", "sid"), "sid", "left").select("key", "n_shingles", F.coalesce("label", "sid").alias("label"))
    ids = base.select("doc_id", "_key").join(member.withColumnRenamed("key", "_key"), "_key")
    ids = materialize(ids, "jaccard-members")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_key")
    least = ids.filter("n_shingles > 0").groupBy("label").agg(F.min(order).alias("least"))
    out = ids.join(least, "label", "left")
    linked = F.col("n_shingles") > 0
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~linked | (F.col("least._key") == F.col("_key"))).alias("first"),
        "_key",
    )


def _reachable(t: tuple[int, int]):
    """Entries that some equal or smaller set could still meet within the bounds."""
    size = F.col("size").cast("long")
    return size - F.col("pos") >= F.ceil(size * t[0] / t[1] - 1e-9)


def keep_one_per_group(docs: DataFrame, gram: int = 5, threshold: tuple[int, int] = (80, 100), lower: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the least doc_id, and one of repeated rows."""
    found = jaccard_components(docs, gram, threshold, lower)
    key = unused(docs.columns, "_key")
    keep = found.filter("first").select(F.col("_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key())
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).select(*quoted(docs.columns))
