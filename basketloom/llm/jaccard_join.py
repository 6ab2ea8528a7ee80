"""N-gram Jaccard join with token-combination prefixes.

The shingles of a text are its tokens, brought into one global order: rare ones by hash, then the
frequent ones by how often they occur.  Two sets that overlap enough must share tokens at the front
of that order.  A rare token is a signature by itself.  Frequent tokens fall into ``CLASSES``
classes; the front is longer by one token per class, so that two similar sets share a rare token
or two tokens of one frequent class, and pairs inside a class are the signatures there.  Texts
that share a signature are candidates; a bound from bit sketches drops most of them, and the
overlap of the whole sets decides.

Only connectivity is asked for, so a group of thousands of copies is not paired up: equal sets are
one vertex and equal buckets are one bucket; every text is compared with the smallest text it shares
a bucket with, then with a text of each bucket, another one in each of a few rounds, and at last all pairs
of a bucket whose texts are still in different components are compared, which loses no link that could
join two components.  That last step carries the sketches along, so a pair leaves its task only if it
passes them, by one of its buckets as far as the few smallest of each text can tell, and it deals large
buckets out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.llm.common import release, small_batches, text_buffers, without_nulls
from basketloom.llm.components import components
from basketloom.llm.shingles import distinct_sets, mixed, shingle_hashes, word_hashes
from basketloom.runtime import Scratch

SHINGLE = 4
# 100 * intersection >= PERCENT * union
PERCENT = 85
# tokens in more sets than this are frequent
FREQUENT = 64
CLASSES = 16
# a token in this many texts of one task may be frequent in all; only the order depends on it
LOCAL_COUNT = 8
# the most frequent tokens known to every task; only the order depends on it
ORDERED_TOKENS = 200_000
# sets above the one size index frequent tokens singly, as pairs would be too many, and so do sets
# up to the other, which may share fewer tokens than there are classes
LARGE_SET, SMALL_SET = 2000, 20
# sets to compare whose texts are found by a broadcast join; more are joined by shuffling
SENT_SETS = 200_000
# 64-bit words of a sketch for this many tokens; sets of twice the size have sketches of twice the size
SKETCH_WORDS, SKETCH_TOKENS = 8, 350
PAIRS_AT_ONCE, PAIRED_BUCKET, SKETCHED_AT_ONCE = 50_000, 200, 250_000
# a text of every bucket is compared with the others so often before all pairs are, and no more after
# a round with fewer links in a hundred pairs; no link depends on it
PIVOT_ROUNDS, ROUND_PERCENT = 4, 1
# buckets of a text that its rows carry along to tell which bucket a pair leaves by
CARRIED_BUCKETS = 8
# rows of a bucket that are paired up in one task, cell by cell; larger buckets are cut into blocks
BLOCK_ROWS, CELL_ROWS = 4096, 10_000

SETS = "doc_id long, hash long, key string, n int, front array<long>, sketch array<long>"


def batch_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    offsets, raw = text_buffers(texts)
    words, text = word_hashes(offsets, raw)
    hashes, of = shingle_hashes(words, text, len(texts), size)
    return distinct_sets(hashes, of, len(texts))


def front_length(n: int, percent: int) -> int:
    """Tokens at the front of which two similar sets share at least one per class and one more."""
    needed = -(-percent * n // 100)
    return min(n, n - needed + 1 + CLASSES)


def sketch_words(n: int) -> int:
    doublings = max(0, -(-n // SKETCH_TOKENS) - 1).bit_length()
    return SKETCH_WORDS << doublings


def frequent_tokens(documents: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are common in some part of the documents, and their counts, ascending by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def fold() -> None:
            nonlocal tokens, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            both, where = np.unique(np.concatenate([tokens, new]), return_inverse=True)
            total = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            tokens, counts = both, total
            if len(tokens) > 1_000_000:
                # what is rare so far is forgotten, as in a lossy count
                often = counts > 1
                tokens, counts = tokens[often], counts[often]

        for batch in small_batches(batches):
            waiting.append(batch_sets(without_nulls(batch.column("text")), size)[0])
            if sum(map(len, waiting)) > 250_000:
                fold()
        if waiting:
            fold()
        often = counts >= LOCAL_COUNT
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens[often].view(np.int64)), pa.array(counts[often])],
            names=["token", "n"],
        )

    found = documents.select("text").mapInArrow(run, "token long, n long")
    summed = found.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    rows = summed.orderBy(F.desc("n"), "token").limit(ORDERED_TOKENS).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    counts = rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _fronts(known: tuple[np.ndarray, np.ndarray], size: int, percent: int):
    """A ``mapInArrow`` function: documents to the key, size, front and sketch of their set."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = known
        for batch in small_batches(batches):
            values, offsets = batch_sets(without_nulls(batch.column("text")), size)
            at = np.minimum(np.searchsorted(tokens, values), max(len(tokens) - 1, 0))
            often = np.zeros(len(values), np.int64)
            if len(tokens):
                hit = tokens[at] == values
                often[hit] = counts[at[hit]]
            keys, sizes, fronts, ends, sketches = [], [], [], [0], []
            sketch_ends = [0]
            bit = values >> np.uint64(32)
            for first, end in zip(offsets[:-1], offsets[1:], strict=True):
                n = int(end - first)
                mine = values[first:end]
                keys.append(xxhash.xxh3_128_hexdigest(mine.tobytes()) if n else None)
                sizes.append(n)
                k = front_length(n, percent) if n else 0
                # values ascend already, and the sort is stable
                fronts.append(mine[np.argsort(often[first:end], kind="stable")[:k]])
                ends.append(ends[-1] + len(fronts[-1]))
                bits = np.zeros(64 * sketch_words(n), np.uint8)
                bits[bit[first:end] % np.uint64(len(bits))] = 1
                sketches.append(np.packbits(bits).view(np.int64))
                sketch_ends.append(sketch_ends[-1] + len(sketches[-1]))
            flat = np.concatenate(fronts) if fronts else np.empty(0, np.uint64)
            sketch = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("hash"),
                    pa.array(keys, pa.string()),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(sketch_ends, pa.int32()), pa.array(sketch)
                    ),
                ],
                names=["doc_id", "hash", "key", "n", "front", "sketch"],
            )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole groups; the rows of a group come together."""
    waiting: list[pa.Table] = []
    held = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.concat_tables(waiting).combine_chunks()
        keys = table.column(key).to_numpy()
        before = np.flatnonzero(keys != keys[-1])
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield table.slice(0, cut)
        waiting, held = [table.slice(cut)], table.num_rows - cut
    if held:
        yield pa.concat_tables(waiting).combine_chunks()


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of each group of equal keys that stand together, and its length."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    return starts, np.diff(np.append(starts, len(key)))


def _shared_tokens(frequent: int):
    """Rows, sorted by token, whose token is in two sets or more, with the token's count.

    Above ``frequent`` the count may be any number above it, so that a token of very many sets is
    never held whole.
    """

    def counted(table: pa.Table, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        several = pa.array(count > 1)
        yield from table.append_column("count", pa.array(count)).filter(several).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unfinished, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if unfinished is not None:
                table = pa.concat_tables([unfinished, table]).combine_chunks()
            token = table.column("token").to_numpy()
            _, lengths = _groups(token)
            count = np.repeat(lengths, lengths)
            if hot is not None:
                count[token == hot] = frequent + 1
            done = len(token)
            if count[-1] > frequent:
                hot = token[-1]
            else:
                done -= int(lengths[-1])
            unfinished = table.slice(done) if done < len(token) else None
            yield from counted(table.slice(0, done), count[:done])
        if unfinished is not None:
            yield from counted(unfinished, np.full(unfinished.num_rows, unfinished.num_rows))

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of frequent tokens of one class, set by set."""
    names = ["sig", "rep", "n"]
    for batch in batches:
        sigs, reps, sizes = [], [], []
        for rep, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "tokens"))):
            tokens = np.sort(np.asarray(tokens, np.int64).view(np.uint64))
            kind = mixed(tokens) % np.uint64(CLASSES)
            for c in range(CLASSES):
                mine = tokens[kind == c]
                i, j = np.triu_indices(len(mine), 1)
                with np.errstate(over="ignore"):
                    sig = mixed(mine[i] * np.uint64(3) + mixed(mine[j]))
                sigs.append(sig.view(np.int64))
                reps.append(np.full(len(i), rep))
                sizes.append(np.full(len(i), n, np.int32))
        parts = [np.concatenate(x) if x else [] for x in (sigs, reps, sizes)]
        kinds = (pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(parts, kinds, strict=True)], names=names
        )


def _apart(
    flat: np.ndarray, first: np.ndarray, words: np.ndarray, small: np.ndarray, large: np.ndarray
) -> np.ndarray:
    """Bits in which the sketches of two rows differ; a longer sketch is folded to the shorter."""
    apart = np.zeros(len(small), np.int64)
    sizes = words[small] << 32 | words[large]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        w, v = int(size >> 32), int(size & 0xFFFFFFFF)
        step = max(1, SKETCHED_AT_ONCE // v)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            x = flat[first[small[part], None] + np.arange(w)]
            y = flat[first[large[part], None] + np.arange(v)].reshape(len(part), -1, w)
            differ = np.bitwise_xor(x, np.bitwise_or.reduce(y, axis=1)).view(np.uint64)
            apart[part] = np.bitwise_count(differ).sum(axis=1)
    return apart


def _cross_pairs(percent: int):
    """Likely links of one cell between texts in different components.

    Sizes and sketches are compared here, so that only pairs worth a comparison of the whole sets
    leave the task.
    """

    def crossing(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, bucket, rep, n, component, block, cross = (
            rows.column(c).to_numpy()
            for c in ("cell", "bucket", "rep", "n", "component", "block", "cross")
        )
        buckets: dict[int, frozenset] = {}

        def buckets_of(row: int) -> frozenset:
            if row not in buckets:
                buckets[row] = frozenset(rows.column("buckets")[row].as_py())
            return buckets[row]

        n = n.astype(np.int64)
        sketch = rows.column("sketch").combine_chunks()
        ends = sketch.offsets.to_numpy().astype(np.int64)
        flat, first, words = sketch.values.to_numpy(), ends[:-1], np.diff(ends)
        order = np.lexsort((n, cell))
        starts, lengths = _groups(cell[order])
        # only cells that have texts of several components
        several = np.minimum.reduceat(component[order], starts) < np.maximum.reduceat(
            component[order], starts
        )
        starts, lengths = starts[several], lengths[several]

        def likely(small: np.ndarray, large: np.ndarray) -> np.ndarray:
            """Pairs of rows, the first one's set not larger, that may link and join components."""
            ok = (component[small] != component[large]) & (100 * n[small] >= percent * n[large])
            # rows of one block meet in a cell of their own
            ok &= (block[small] != block[large]) | ~(cross[small] | cross[large])
            small, large = small[ok], large[ok]
            both = n[small] + n[large]
            room = both - 2 * -(-percent * both // (100 + percent))
            # bits that differ are at most the tokens that differ
            ok = _apart(flat, first, words, small, large) <= room
            small, large = small[ok], large[ok]
            # a pair leaves by the first of the buckets that it shares; where the carried buckets
            # do not tell, it leaves once more
            firsts = (
                min(buckets_of(a) & buckets_of(b), default=here)
                for a, b, here in zip(
                    small.tolist(), large.tolist(), bucket[small].tolist(), strict=True
                )
            )
            ok = np.fromiter(firsts, np.int64, len(small)) >= bucket[small]
            small, large = small[ok], large[ok]
            swap = rep[small] > rep[large]
            a, b = np.where(swap, large, small), np.where(swap, small, large)
            return np.stack([rep[a], rep[b], n[a], n[b]])

        waiting: list[np.ndarray] = []
        seen = 0
        # cells of one length are paired up all at once, longer ones row by row
        for length in np.unique(lengths[lengths <= PAIRED_BUCKET]):
            i, j = np.triu_indices(length, 1)
            same = starts[lengths == length]
            at_once = max(1, PAIRS_AT_ONCE // len(i))
            for k in range(0, len(same), at_once):
                rows_of = order[same[k : k + at_once, None] + np.arange(length)]
                waiting.append(likely(rows_of[:, i].ravel(), rows_of[:, j].ravel()))
                seen += waiting[-1].shape[1]
                if seen > PAIRS_AT_ONCE:
                    yield _pairs(waiting)
                    waiting, seen = [], 0
        long = lengths > PAIRED_BUCKET
        for start, length in zip(starts[long], lengths[long], strict=True):
            mine = order[start : start + length]
            # a set reaches up to this size
            reach = np.searchsorted(n[mine], n[mine] * 100 // percent, side="right")
            for k in range(len(mine) - 1):
                others = mine[k + 1 : reach[k]]
                waiting.append(likely(np.full(len(others), mine[k]), others))
                seen += waiting[-1].shape[1]
                if seen > PAIRS_AT_ONCE:
                    yield _pairs(waiting)
                    waiting, seen = [], 0
        if seen:
            yield _pairs(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "cell", CELL_ROWS):
            yield from crossing(rows)

    return run


def _pairs(waiting: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(waiting, axis=1), axis=1)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2]), pa.array(pairs[3])],
        names=["a", "b", "n_a", "n_b"],
    )


def _needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """The smallest overlap that links sets of these sizes."""
    return F.ceil(percent * (n_a + n_b) / F.lit(100 + percent))


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches):
            values, offsets = batch_sets(without_nulls(batch.column("text")), size)
            keys = [
                xxhash.xxh3_128_hexdigest(values[first:end].tobytes())
                for first, end in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            tokens = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))
            )
            table = pa.table({"rep": batch.column("rep"), "tokens": tokens})
            # another text may have the same 64-bit hash
            yield from table.filter(pc.equal(pa.array(keys), batch.column("key"))).to_batches()

    return run


def jaccard_components(
    documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    ``documents``: doc_id, text; other columns are ignored.  Two texts link when
    100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles; a component
    is named by its smallest doc_id.  A text with fewer words is one shingle; a null or empty one
    has none and is its own component.  Rows that repeat an id are kept, each with its own text;
    rows without an id link too, but their id never names a component.  No rows give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text"
    )
    known = spark.sparkContext.broadcast(frequent_tokens(rows, size))

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fronts(known.value, size, percent)(batches)

    sets = scratch.keep(rows.mapInArrow(fronts, SETS))
    # equal sets are one vertex; vertices are numbered, as ids may be missing
    vertices = scratch.keep(
        sets.where("n > 0")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("first"),
            # one text that has this set
            F.min(F.struct("hash", "doc_id")).alias("chosen"),
            F.first("n").alias("n"),
            F.first("front").alias("front"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("rep", F.monotonically_increasing_id())
    )
    # what is read to the end is kept without the fronts, which are most of these tables
    members = scratch.keep(sets.select("doc_id", "key", "n"))
    scratch.drop(sets)
    fronted, vertices = vertices, scratch.keep(vertices.drop("front"))
    release(spark)
    shared = scratch.keep(
        fronted.select("rep", "n", F.posexplode("front").alias("pos", "token"))
        .repartition("token")
        .sortWithinPartitions("token")
        .mapInArrow(_shared_tokens(FREQUENT), "rep long, n int, pos int, token long, count long")
    )
    scratch.drop(fronted)
    release(spark)
    n = F.col("n")
    # partners of sets without pairs index frequent tokens singly as well; one shared token at
    # the unextended front is enough there
    singly = (100 * n > percent * LARGE_SET) | (n <= SMALL_SET)
    in_front = F.col("pos") < n - F.ceil(percent * n / F.lit(100)) + 1
    single = (F.col("count") <= FREQUENT) | (singly & in_front)
    pairs_of = (
        shared.where((F.col("count") > FREQUENT) & (n <= LARGE_SET) & (n > SMALL_SET * percent // 100))
        # few rows make many pairs, so they stay in as many tasks
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep")
        .groupBy("rep", "n")
        .agg(F.collect_list("token").alias("tokens"))
        .mapInArrow(_combined, "sig long, rep long, n int")
    )
    signatures = scratch.keep(
        shared.where(single).select(F.col("token").alias("sig"), "rep", "n").unionByName(pairs_of)
    )
    scratch.drop(shared)
    release(spark)
    # the tokens of one passage have the same sets, so a bucket is named by its sets; should two
    # names be equal by chance, their sets only share one bucket
    pivots = (
        signatures.groupBy("sig")
        .agg(
            F.min(F.struct("rep", "n")).alias("least"),
            F.max("rep").alias("last"),
            F.bit_xor(F.xxhash64("rep")).alias("sets"),
        )
        .where("least.rep < last")
        .select(
            "sig",
            F.xxhash64("least.rep", "last", "sets").alias("bucket"),
            F.col("least.rep").alias("pivot"),
            F.col("least.n").alias("pivot_n"),
        )
    )
    buckets = scratch.keep(
        signatures.join(pivots, "sig").select("bucket", "rep", "n", "pivot", "pivot_n").distinct()
    )
    scratch.drop(signatures)
    release(spark)
    sketches = vertices.select("rep", "n", "sketch")

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) that the sketches leave, with the sizes of their sets."""
        side = lambda c: sketches.select(
            F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")
        )
        different = F.aggregate(
            F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
            F.lit(0),
            lambda total, x: total + x,
        )
        needed = _needed(F.col("n_a"), F.col("n_b"), percent)
        # bits that differ are at most the tokens that differ; sketches of two sizes say nothing
        return (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .where(
                (F.size("s_a") != F.size("s_b"))
                | (different <= F.col("n_a") + F.col("n_b") - 2 * needed)
            )
            .select("a", "b", "n_a", "n_b")
        )

    def verified(likely: DataFrame) -> DataFrame:
        """Links among stored likely pairs (a, b, n_a, n_b), which are dropped, by the whole sets."""
        release(spark)
        ends = likely.select(F.col("a").alias("rep")).distinct()
        ends = ends.unionByName(likely.select(F.col("b").alias("rep")).distinct()).distinct()
        wanted = scratch.keep(vertices.join(ends, "rep").select("rep", "key", "chosen.*"))
        few = F.broadcast(wanted) if wanted.count() <= SENT_SETS else wanted
        texts = rows.join(
            few.withColumnRenamed("doc_id", "chosen_id"),
            on=(rows["hash"] == few["hash"]) & F.col("doc_id").eqNullSafe(F.col("chosen_id")),
        ).select("rep", "key", "text")
        full = scratch.keep(texts.mapInArrow(_full_sets(size), "rep long, tokens array<long>"))
        of = lambda c: full.select(F.col("rep").alias(c), F.col("tokens").alias(f"t_{c}"))
        overlap = F.size(F.array_intersect("t_a", "t_b"))
        links = scratch.keep(
            likely.join(of("a"), "a")
            .join(of("b"), "b")
            .where(100 * overlap >= percent * (F.col("n_a") + F.col("n_b") - overlap))
            .select("a", "b")
        )
        scratch.drop(likely, wanted, full)
        release(spark)
        return links

    def placed(frame: DataFrame, parts: DataFrame, of: str, out: str) -> DataFrame:
        """``frame`` with the component of column ``of``."""
        named = parts.select(F.col("node").alias(of), F.col("component").alias(out))
        return frame.join(named, of, "left").withColumn(out, F.coalesce(out, of))

    similar = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    with_pivot = buckets.where((F.col("rep") != F.col("pivot")) & similar).select(
        F.col("pivot").alias("a"), F.col("rep").alias("b")
    )
    # one pivot a text joins most of a large group
    smallest_pivot = with_pivot.groupBy("b").agg(F.min("a").alias("a"))
    first_links = verified(scratch.keep(likely_pairs(smallest_pivot)))
    links = first_links

    def mixed_rows(rest: DataFrame, choice: Column) -> DataFrame:
        """Rows of the buckets that have texts of several components, each with a chosen text."""
        several = (
            rest.groupBy("bucket")
            .agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"),
                F.min_by(F.struct("rep", "n", "component"), choice).alias("chosen"),
            )
            .where("low < high")
            .select("bucket", "blocks", "chosen")
        )
        return rest.join(several, "bucket")

    def placed_rows(links: DataFrame) -> DataFrame:
        parts = components(links, scratch)
        return scratch.keep(
            placed(buckets.select("bucket", "rep", "n"), parts, "rep", "component")
        )

    for k in range(PIVOT_ROUNDS):
        # other pivots each time, so that texts far from one pivot meet another
        rest = placed_rows(links)
        several = mixed_rows(rest, F.xxhash64("rep", "bucket", F.lit(k)))
        chosen = F.col("chosen.n")
        with_chosen = several.where(
            (F.col("component") != F.col("chosen.component"))
            & (100 * F.least("n", chosen) >= percent * F.greatest("n", chosen))
        ).select(
            F.least("rep", "chosen.rep").alias("a"), F.greatest("rep", "chosen.rep").alias("b")
        )
        likely = scratch.keep(likely_pairs(with_chosen.distinct()))
        tried = likely.count()
        more = verified(likely)
        scratch.drop(rest)
        release(spark)
        links = scratch.keep(links.unionByName(more))
        if 100 * more.count() <= ROUND_PERCENT * tried:
            break
    rest = placed_rows(links)
    scratch.drop(buckets)
    mixed_buckets = scratch.keep(mixed_rows(rest, F.col("rep")).drop("chosen"))
    scratch.drop(rest)
    release(spark)
    # as many buckets a row however many a text has, so that the rows of a text do not grow by square
    carried = F.slice(F.array_sort(F.collect_set("bucket")), 1, CARRIED_BUCKETS)
    lists = mixed_buckets.groupBy("rep").agg(carried.alias("buckets"))
    blocks, block, other = F.col("blocks"), F.col("block"), F.col("other")
    cells = (
        mixed_buckets.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.xxhash64("bucket", F.least(block, other), F.greatest(block, other)).alias("cell"),
            "bucket", "rep", "n", "component", "block",
            (block != other).alias("cross"),
        )
    )
    crossing = (
        cells.join(vertices.select("rep", "sketch"), "rep")
        .join(lists, "rep")
        .select("cell", "bucket", "rep", "n", "component", "block", "cross", "sketch", "buckets")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_cross_pairs(percent), "a long, b long, n_a long, n_b long")
        .distinct()
    )
    last_pairs = scratch.keep(crossing)
    scratch.drop(mixed_buckets)
    last_links = verified(last_pairs)
    joined = components(links.unionByName(last_links), scratch)
    named = vertices.join(
        joined.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select("key", "first", F.coalesce("component", "rep").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_key = scratch.keep(named.join(smallest, "component").select("key", "component_id"))
    scratch.drop(vertices)
    return members.join(by_key, "key", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
