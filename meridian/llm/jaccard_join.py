"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Texts are sets of word shingles; two link when 100 * intersection >= percent * union. Equal sets are one node. All
sets share one order of shingles: those found frequent last, the more frequent the later, else by hash; any one order gives
exact results, this one keeps what many documents share out of prefixes. If two sets link, their prefixes of
n - need + l shingles share l of them, for every l. Each node takes the l whose estimated cost (postings
scanned, candidates verified) is least, and a pair is verified only if its prefixes share as many shingles
as the two demand, counted over all they share. Shingles that no other prefix has fall out first, and count
against a node: what its prefix can't share, no partner has.

Frequencies are counted over all documents, not over parts of them: each document sends twice the shingles of a prefix
(those with the least hashes, packed as numbers of eight bytes), and then all the rest where so many of these are
frequent that the prefix reaches beyond them.

Only components are wanted, so links that a component has already are not sought again. First every node is
compared with one hub, the prefix neighbour with the fewest unshared shingles, which joins groups of copies
at the price of one comparison a node. Nodes near one hub then meet only in shingles in which both differ from it, so
that variants of one text which all lie a little too far apart are not met pair by pair. Last, all remaining
candidate pairs of different components are verified, none left out. Sets travel only for pairs to be compared.

Shingles are 64-bit hashes, and so are nodes: two of N different sets are taken for one with probability N^2 / 2^65.

Rows: null or wordless texts have empty sets and are linked with nothing; rows that repeat an id are one document
whose links join, whatever their texts; rows with a null id are kept with a null component and link nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm import shingles
from meridian.llm.common import by_bytes, column_bytes, discard, map_text, stored
from meridian.llm.components import components

#: A shingle is frequent if FREQUENT_FROM documents have it; of those so counted, the most frequent go last in the
#: order, FREQUENT at most. BAND: how much more than a prefix each document counts; HELD: keys that a task sorts at once.
FREQUENT_FROM, FREQUENT, BAND, HELD = 6, 1_000_000, 2, 1_000_000
#: The longest multi-match, and the cost of a verification in scanned postings.
MOST_MATCHES, VERIFY_COST = 4, 20
#: Nodes whose numbers may be broadcast; beyond that they are joined.
BROADCAST_NODES = 1_000_000
#: A key is the upper 48 bits of a shingle, and 16 bits of the set that has it, so that copies count once.
_SHINGLE = np.uint64(0xFFFF_FFFF_FFFF_0000)


def _need(n, percent: int):
    """The least intersection of a set of n with any set it links to: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(own: np.ndarray) -> int:
    """A set's number: a hash of its sorted shingles."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


class Frequent:
    """The frequent shingles by their upper bits, sorted, and their sightings."""

    def __init__(self, keys: np.ndarray, sightings: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.sightings = keys[order], sightings[order]

    def of(self, own: np.ndarray) -> np.ndarray:
        """Sightings of each shingle, 0 unless it is a frequent one."""
        if not len(self.keys):
            return np.zeros(len(own), np.int64)
        keys = own & _SHINGLE
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.sightings[at], 0)


def _once(done: set[int], node: int) -> bool:
    """Whether a node is new to this task; of very many, not all are remembered."""
    if node in done:
        return False
    if len(done) < 300_000:
        done.add(node)
    return True


def count_keys(docs: DataFrame, text_col: str, size: int, percent: int, known: Frequent | None) -> DataFrame:
    """(bucket, keys) of what documents count: the first BAND prefixes of their shingles; or, where frequent ones are known,
    the rest of those whose prefix reaches beyond that. Dealt by the shingles' upper bits."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, (16 * partitions - 1).bit_length())
    sent = spark.sparkContext.broadcast(known)

    def run(batches):
        known, done, held, size_held = sent.value, set(), [], 0

        def out():
            keys = np.sort(np.concatenate(held))
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            chunks = [keys[a:b].astype("<u8").tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(chunks, pa.binary())], names=["bucket", "keys"])

        for batch in batches:
            for part in by_bytes(batch):
                for own in shingles.sets(column_bytes(part.column(0)), size):
                    if not len(own) or not _once(done, node := _node(own)):
                        continue
                    length = len(own) - _need(len(own), percent) + MOST_MATCHES
                    counted = own[: BAND * length]
                    if known is not None:
                        if np.count_nonzero(known.of(counted) == 0) >= length:
                            continue
                        counted = own[BAND * length :]
                    if len(counted):
                        held.append((counted & _SHINGLE) | np.uint64(node & 0xFFFF))
                        size_held += len(counted)
                    if size_held >= HELD:
                        yield out()
                        held, size_held = [], 0
        if held:
            yield out()

    return docs.select(text_col).mapInArrow(run, "bucket int, keys binary")


def counted(keys: DataFrame) -> DataFrame:
    """(key, n) of shingles with FREQUENT_FROM sightings at least, bucket by bucket."""

    def run(batches):
        held: list[np.ndarray] = []
        last = None

        def out():
            keys = np.sort(np.concatenate(held))
            own = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] & _SHINGLE
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            n = np.diff(np.append(first, len(own)))
            often = n >= FREQUENT_FROM
            return pa.RecordBatch.from_arrays([pa.array(own[first[often]].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for bucket, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != last and held:
                    yield out()
                    held = []
                last = bucket
                held.append(np.frombuffer(chunk, "<u8"))
        if held:
            yield out()

    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, n long")


def frequent_shingles(docs: DataFrame, text_col: str, size: int, percent: int) -> Frequent:
    """At most FREQUENT shingles; which ones only matters for speed."""
    found = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for known in (False, True):
        table = stored(counted(count_keys(docs, text_col, size, percent, found if known else None)))
        total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        rows = table.where(F.col("n") * (FREQUENT // 2) >= total).toArrow()  # at most half of FREQUENT have that share
        found = Frequent(np.concatenate((found.keys, rows["key"].to_numpy().view(np.uint64))), np.concatenate((found.sightings, rows["n"].to_numpy())))
        discard(table)
    return found


PREFIX = "id long, node long, n int, shingle long, place int, df int"


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, frequent: Frequent) -> DataFrame:
    """Rows of documents (id, node, n; no shingle) and of the longest prefixes of those with an id, each set once a task (node, n,
    shingle, place, df); df is 0 unless the shingle is a frequent one."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        frequent, done = sent.value, set()

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            nodes, sizes, lengths, values, places, dfs = [], [], [], [], [], []
            whole, counts = [], []
            for own, named in zip(shingles.sets(texts, size), ids.is_valid().to_pylist(), strict=True):
                n = len(own)
                node = _node(own) if n else None
                whole.append(node)
                counts.append(n)
                if not n or not named or not _once(done, node):
                    continue
                df = frequent.of(own)
                length = min(n, n - _need(n, percent) + MOST_MATCHES)
                order = np.argsort(df, kind="stable")[:length]
                nodes.append(node)
                sizes.append(n)
                lengths.append(length)
                values.append(own[order])
                places.append(np.arange(length, dtype=np.int32))
                dfs.append(df[order].astype(np.int32))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            more = int(sum(lengths))
            return {
                "id": pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(more, pa.int64())]),
                "node": pa.concat_arrays([pa.array(whole, pa.int64()), pa.array(np.repeat(np.array(nodes, np.int64), lengths))]),
                "n": pa.concat_arrays([pa.array(counts, pa.int32()), pa.array(np.repeat(np.array(sizes, np.int32), lengths))]),
                "shingle": pa.concat_arrays([pa.nulls(len(whole), pa.int64()), pa.array(_signed(join(values, np.uint64)))]),
                "place": pa.concat_arrays([pa.nulls(len(whole), pa.int32()), pa.array(join(places, np.int32))]),
                "df": pa.concat_arrays([pa.nulls(len(whole), pa.int32()), pa.array(join(dfs, np.int32))]),
            }

        return fn

    return map_text(docs, id_col, text_col, PREFIX, make)


def _shared_only(batches):
    """Of rows sorted by shingle and node, those whose shingle has two nodes at least, each (shingle, node) once, with
    the number of nodes. A shingle's rows are held until the next begins, or until there are very many."""
    held, known = None, 0

    def emit(t: pa.Table, before: int):
        shingle, node = t["shingle"].to_numpy(), t["node"].to_numpy()
        new = np.ones(len(t), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
        t = t.filter(pa.array(new))
        starts = np.flatnonzero(np.diff(t["shingle"].to_numpy(), prepend=t["shingle"][0].as_py() ^ 1))
        counts = np.diff(np.append(starts, len(t)))
        counts[0] += before
        df = np.repeat(counts, np.diff(np.append(starts, len(t)))).astype(np.int32)
        out = t.set_column(t.schema.get_field_index("df"), "df", pa.array(df)).filter(pa.array(df > 1))
        return out.to_batches(), int(counts[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        shingle = table["shingle"].to_numpy()
        last = int(np.searchsorted(shingle, shingle[-1], side="left"))
        if last:
            out, _ = emit(table.slice(0, last), known)
            yield from out
            known = 0
        held = table.slice(last)
        if len(held) > 200_000:
            out, n = emit(held.slice(0, len(held) - 1), known + 1)  # the row kept makes one more node
            yield from out
            known, held = n - 1, held.slice(len(held) - 1)
    if held is not None:
        out, _ = emit(held, known)
        yield from out


def shared_postings(prefix: DataFrame) -> DataFrame:
    """Prefix rows (node, n, shingle, place, df) without the shingles that no other node's prefix has."""
    usual = prefix.where("df = 0").repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(_shared_only, prefix.schema)
    frequent = prefix.where("df > 0").dropDuplicates(["shingle", "node"])
    return usual.unionByName(frequent)


ADAPTED = "node long, n int, matches int, prefix int, unshared int, rank int, shingle long, place int"
_ADAPTED = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("matches", pa.int32()), ("prefix", pa.int32()), ("unshared", pa.int32()), ("rank", pa.int32()), ("shingle", pa.int64()), ("place", pa.int32())])


def _adapt(t: pa.Table, percent: int) -> list[pa.RecordBatch]:
    """Whole nodes' postings, sorted by node: the multi-match of least cost, and the postings of its prefix."""
    node, n, place, df = (t[c].to_numpy() for c in ("node", "n", "place", "df"))
    first = np.flatnonzero(np.diff(node, prepend=node[0] - 1 if node[0] > -(1 << 63) else 0))
    size = np.diff(np.append(first, len(node)))
    base = n - _need(n, percent)  # a prefix of base + m shingles shares m
    cost = np.full((len(first), MOST_MATCHES), np.inf)
    for m in range(1, MOST_MATCHES + 1):
        scanned = np.add.reduceat(np.where(place < base + m, df - 1, 0), first)
        fits = _need(n[first], percent) >= m
        cost[fits, m - 1] = (scanned * (1 + VERIFY_COST / m))[fits]
    matches = np.repeat(cost.argmin(axis=1) + 1, size).astype(np.int32)
    prefix = (base + matches).astype(np.int32)
    keep = place < prefix
    kept = np.repeat(np.add.reduceat(keep.astype(np.int32), first), size).astype(np.int32)
    rank = (np.arange(len(node)) - np.repeat(first, size)).astype(np.int32)  # postings are sorted by place
    out = pa.Table.from_arrays([t["node"], t["n"], pa.array(matches), pa.array(prefix), pa.array(prefix - kept), pa.array(rank), t["shingle"], t["place"]], schema=_ADAPTED)
    return out.filter(pa.array(keep)).to_batches(max_chunksize=64_000)


def adapted(postings: DataFrame, percent: int) -> DataFrame:
    """Each node's own multi-match: postings (node, n, matches, prefix, unshared, rank, shingle, place) of its adapted prefix; rank
    counts them in the order of shingles."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            node = t["node"].to_numpy()
            last = int(np.searchsorted(node, node[-1], side="left"))
            if last:
                yield from _adapt(t.slice(0, last), percent)
            held = t.slice(last)  # one node's postings: a part of one document's shingles
        if held is not None:
            yield from _adapt(held, percent)

    return postings.repartition("node").sortWithinPartitions("node", "place").mapInArrow(run, ADAPTED)


def _in_question(met: DataFrame, percent: int, condition: Column) -> DataFrame:
    """(a, b) of pairs of nodes met in a shingle, as a.* and b.*, that share as many shingles of their prefixes as they must to
    link. `met` has every shingle that a pair shares, once."""
    least = F.expr(f"({percent}L * (a.n + b.n) + {99 + percent}) div {100 + percent}")
    # all shared shingles up to the earlier of the two edges are in both prefixes, so beyond it only the
    # rest of the set that ends there can be shared
    room = lambda x, y: F.when(F.col("a.edge") < F.col("b.edge"), x).when(F.col("a.edge") > F.col("b.edge"), y).otherwise(F.greatest(x, y))
    shareable = room(F.col("a.n") - F.col("a.unshared"), F.col("b.n") - F.col("b.unshared"))
    rest = room(F.col("a.n") - F.col("a.prefix"), F.col("b.n") - F.col("b.prefix"))
    want = F.greatest(F.least("a.matches", "b.matches"), least - rest)
    rows = met.where(
        condition
        & (F.col("a.n") * 100 >= F.col("b.n") * percent)
        & (F.col("b.n") * 100 >= F.col("a.n") * percent)
        & (shareable >= least)
        & (F.least(F.col("a.prefix") - F.col("a.unshared"), F.col("b.prefix") - F.col("b.unshared")) >= want)
    )
    shared = rows.groupBy(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).agg(F.count("*").alias("c"), F.max(want).alias("want"))
    return shared.where("c >= want").select("a", "b")


def hub_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node and the one hub it shares most shingles with, if the two may link; a shingle's hub has the fewest
    unshared. Pairs that are left out here come up again among the candidates."""
    own = F.struct((F.col("unshared") / F.col("n")).alias("r"), "node", "n", "matches", "prefix", "unshared", "edge")
    hubs = postings.groupBy("shingle").agg(F.min(own).alias("hub")).select("shingle", "hub.*")
    met = postings.alias("a").join(hubs.alias("b"), "shingle")
    least = F.expr(f"({percent}L * (a.n + b.n) + {99 + percent}) div {100 + percent}")
    # a hub does not stand for all that two nodes share, so nothing is demanded but that they may link
    rows = met.where((F.col("a.node") != F.col("b.node")) & (F.least("a.n", "b.n") >= least))
    pairs = rows.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("c"))
    return pairs.groupBy("a").agg(F.max(F.struct("c", "b")).b.alias("b"))


def candidate_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of unlike labels and unlike hubs that may link. Of a shingle's nodes, those of its most common hub or
    label are met with the others, not with one another; a shingle whose nodes have but one is met by none."""
    own = postings.withColumn("crowd", F.coalesce("hub", "label"))
    crowds = own.groupBy("shingle", "crowd").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "crowd")).crowd.alias("most"), F.count("*").alias("crowds")).where("crowds > 1")
    live = stored(own.join(crowds.select("shingle", "most"), "shingle"))
    met = live.where("crowd <> most").alias("a").join(live.alias("b"), "shingle")
    other = (F.col("a.label") != F.col("b.label")) & (F.col("a.crowd") != F.col("b.crowd")) & ((F.col("b.crowd") == F.col("b.most")) | (F.col("a.node") < F.col("b.node")))
    pairs = stored(_in_question(met, percent, other))
    discard(live)
    return pairs


def near_links(near: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links between nodes (node, hub, n, d, label, delta) that were compared with one hub: what two of them differ in
    follows from what they differ from the hub in, |a ^ b| = |a ^ h| + |b ^ h| - 2 |(a ^ h) & (b ^ h)|. As their labels are unlike,
    they do not both link to the hub, so they link only if they share such differences. Only these are met."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                flat = [np.frombuffer(x, "<i8") for x in part.column(part.num_columns - 1).to_pylist()]
                row = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
                values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(part.num_columns - 1)), pa.array(values)], names=["node", "hub", "n", "d", "label", "x"])

    # hubs all of whose nodes have one label have nothing to tell
    several = near.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("hub")
    single = near.join(several, "hub", "left_semi").select("node", "hub", "n", "d", "label", "delta").mapInArrow(run, "node long, hub long, n long, d long, label long, x long")
    single = stored(single)
    crowds = single.groupBy("hub", "x", "label").agg(F.count("*").alias("k")).groupBy("hub", "x").agg(F.max(F.struct("k", "label")).label.alias("most"), F.sum("k").alias("k"), F.count("*").alias("labels")).where("k > 1")
    shared = stored(single.join(crowds.select("hub", "x", "most", "labels"), ["hub", "x"]))
    counts = shared.groupBy("node").agg(F.count("*").alias("s"))
    live = stored(shared.where("labels > 1").join(counts, "node"))
    discard(single, shared)
    most_apart = F.expr(f"({100 - percent}L * (a.n + b.n)) div {100 + percent}")
    demanded = (F.col("a.d") + F.col("b.d") - most_apart + 1) / 2  # of shared differences, a half more at most
    other = (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.most")) | (F.col("a.node") < F.col("b.node")))
    met = live.where("label <> most").alias("a").join(live.alias("b"), ["hub", "x"]).where(other & (F.least("a.s", "b.s") + 0.5 >= demanded))
    pairs = met.groupBy(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).agg(F.count("*").alias("c"), F.max(F.col("a.d") + F.col("b.d") - most_apart).alias("over"))
    links = stored(pairs.where("2 * c >= over").select("a", "b"))
    discard(live)
    return links


def set_table(docs: DataFrame, id_col: str, text_col: str, size: int, nodes: DataFrame) -> DataFrame:
    """(node, s binary): the whole sets of the nodes (node, rep) asked for, from the rows with the id `rep`; a node comes
    again where such rows are repeated."""
    count = nodes.count()
    if count <= BROADCAST_NODES:
        rows = nodes.toArrow()
        order = np.argsort(rows["node"].to_numpy())
        ask = rows["node"].to_numpy()[order], rows["rep"].to_numpy()[order]
    else:
        docs, ask = docs.join(nodes.select(F.col("rep").alias(id_col)).distinct(), id_col, "left_semi"), None
    wanted = docs.sparkSession.sparkContext.broadcast(ask)

    def make():
        ask = wanted.value

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            if ask is not None:  # texts of other ids need no look
                asked = np.isin(ids.to_numpy(zero_copy_only=False), ask[1]).tolist()
                ids, texts = ids.filter(pa.array(asked)), [t for t, x in zip(texts, asked, strict=True) if x]
            found, lists = [], []
            for i, own in zip(ids.to_pylist(), shingles.sets(texts, size), strict=True):
                if not len(own):
                    continue
                node = _node(own)
                if ask is not None:
                    at = int(np.searchsorted(ask[0], node))
                    if at == len(ask[0]) or ask[0][at] != node or ask[1][at] != i:
                        continue
                found.append(node)
                lists.append(own.astype("<u8").tobytes())
            return {"node": found, "s": pa.array(lists, pa.binary())}

        return fn

    return map_text(docs, id_col, text_col, "node long, s binary", make)


COMPARED = "a long, b long, na long, nb long, d long, delta binary"


def compared(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, deltas: bool) -> DataFrame:
    """The pairs (a, b) with their sets' sizes and how many shingles only one of them has; and, if wanted, these shingles, where
    they are at most twice as many as a link allows."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = stored(set_table(docs, id_col, text_col, size, stored(both.join(reps, "node"))))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                na, nb, d, delta = [], [], [], []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                    apart = np.setxor1d(x, y, assume_unique=True)
                    na.append(len(x))
                    nb.append(len(y))
                    d.append(len(apart))
                    delta.append(apart.tobytes() if deltas and len(apart) * (100 + percent) <= 2 * (100 - percent) * (len(x) + len(y)) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(d, pa.int64()), pa.array(delta, pa.binary())], names=["a", "b", "na", "nb", "d", "delta"])

    left = own.select(F.col("node").alias("a"), F.col("s").alias("x"))
    right = own.select(F.col("node").alias("b"), F.col("s").alias("y"))
    rows = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, COMPARED).dropDuplicates(["a", "b"]))
    discard(own)
    return rows


def links_of(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of compared ones that link."""
    return pairs.where(F.col("d") * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document: component_id is the smallest id reachable by links."""
    named = docs.where(F.col(id_col).isNotNull())  # others may not come between documents, as hubs either
    frequent = frequent_shingles(named, text_col, size, percent)
    both = stored(prefixes(docs, id_col, text_col, size, percent, frequent))
    documents = stored(both.where("shingle is null").select("id", "node", "n"))
    prefix = both.where("shingle is not null").drop("id")
    postings = stored(adapted(shared_postings(prefix), percent))
    reps = stored(documents.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep")))

    # the order of shingles is (df, hash); an edge is the last shingle of the prefix in that order
    order = F.struct("df", F.col("shingle").bitwiseXOR(F.lit(-(1 << 63))))
    ends = prefix.where(f"place >= n - ({percent} * n + 99) div 100")  # the last few rows of each node
    edges = ends.join(postings.select("node", "prefix").distinct(), "node").where("place = prefix - 1").select("node", order.alias("edge")).dropDuplicates(["node"])
    placed = stored(postings.join(edges, "node"))
    discard(both, postings)

    met = compared(stored(hub_pairs(placed, percent)), reps, named, id_col, text_col, size, percent, deltas=True)
    links = links_of(met, percent)
    labels = components(links)
    # what was compared with a hub, and the hubs, which do not differ from themselves
    hubs = met.where("delta is not null").groupBy(F.col("b").alias("node")).agg(F.max("nb").alias("n")).select("node", F.col("node").alias("hub"), "n", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("delta"))
    near = met.where("delta is not null").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("na").alias("n"), "d", "delta").join(hubs, "node", "left_anti").unionByName(hubs)
    near = stored(near.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    links = stored(links.unionByName(near_links(near, percent)))
    labelled = placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(near.select("node", "hub"), "node", "left")
    pairs = candidate_pairs(labelled, percent)
    discard(placed, met, near)
    if not pairs.isEmpty():
        links = links.unionByName(links_of(compared(pairs, reps, named, id_col, text_col, size, percent, deltas=False), percent))

    # components by ids: a node stands for its smallest id, and joins the ids that have other texts too
    by_id = links.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb")
    several = documents.where("id is not null").groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), (F.count("node") < F.count("*")).alias("wordless"))
    several = several.where("lo < hi or lo is not null and wordless").select("id")
    same_id = documents.join(several, "id", "left_semi").join(reps, "node").select(F.col("rep").alias("ra"), F.col("id").alias("rb"))
    labels = components(by_id.unionByName(same_id), "ra", "rb").select(F.col("node").alias("rep"), "label")
    # a wordless row has what its id has from other rows
    placed = documents.join(reps, "node", "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    return placed.join(labels, "rep", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that have the smallest id of their group; a row without an id stays."""
    groups = linked(docs.where(F.col(id_col).isNotNull()), size, percent, id_col, text_col)
    others = stored(groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return docs.join(others, id_col, "left_anti")
