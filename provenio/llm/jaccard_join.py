"""Similarity join of documents on word n-grams by PartEnum signatures (Arasu, Ganti and Kaushik, 2006)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import discard, give_back, partitions_for, written
from provenio.llm.components import connected_components

#: Each partition of the domain is cut into so many parts, of which every subset but one part is a signature.
PARTS = 3
#: Bits of the print that rules open pairs out: bits that two prints differ in are features that the sets differ in.
PRINT_BITS = 2048
#: Narrow tables are broadcast up to so many rows (8 to 16 bytes each), which are counted first.
MAX_BROADCAST = 1_000_000
#: Features that a task gathers before it sends them, and that meet in one bucket on average.
CHUNK_FEATURES, BUCKET_FEATURES = 500_000, 1_000_000
CHUNK_DOCUMENTS = 60_000
#: Bits of a feature beyond those that number all features: one in 2 ** SPARE_BITS seems shared and is not.
SPARE_BITS = 7
#: Crowded signatures are paired in blocks of so many nodes.
BLOCK_NODES = 256

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _S1)) * _M2
    x = (x ^ (x >> _S2)) * _M3
    return x ^ (x >> _S3)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams.

    A-Z are lower-cased; words are parted by ASCII white space, as bytes.split() does. With fewer words than the
    width the whole sequence is the one feature; without words there is none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    count = len(words) - span + 1
    value = np.full(count, span, np.uint64)
    for k in range(span):
        value = mixed((value * _M1) ^ hashes[k : k + count])
    return np.unique(value)


class PartEnum:
    """Signatures of sets such that any two with Jaccard similarity >= percent / 100 share at least one.

    Sizes are cut into bands, each 100 / percent as wide as its start. Band p has an instance for the pairs whose
    smaller set is in p; the larger is then in p or p + 1, so a set signs for its own band and the one below. Two
    such sets differ in at most `budget` features. The domain is cut into first + slack partitions so that `budget`
    differences leave at least slack + 1 of them with one difference or none, and each of these is cut into PARTS
    parts of which all subsets but one part are enumerated.

    slack lets a set leave out its thinnest subsets: two sets that share a subset have the same number of features
    in it, so both leave it out or the one with the higher threshold does, and that one spoils at most `slack`
    partitions. What is left still meets in at least one, and thin subsets, which would meet by chance, are gone.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return bisect_right(self.starts, size) - 1

    @lru_cache(maxsize=4096)
    def layout(self, band: int) -> tuple[int, int, int, np.ndarray]:
        """(first-level partitions, parts of each, slack, upper ends of all parts) of a band's instance."""
        while len(self.starts) <= band + 1:
            self.band(self.starts[-1])
        small = self.starts[band + 1] - 1
        large = small * 100 // self.percent
        budget = (100 - self.percent) * (small + large) // (100 + self.percent)
        if budget == 0:
            first, parts, slack = 1, 1, 0
        else:
            first, parts = budget // 2 + 1, PARTS
            slack = first // 3 if first < 16 else 4 + first // 12
        leaves = (first + slack) * parts
        ends = np.array([(i + 1) * 2**64 // leaves - 1 for i in range(leaves)], np.uint64)
        return first + slack, parts, slack, ends

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """The signatures of a sorted array of distinct feature hashes."""
        if not len(features):
            return np.empty(0, np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(features ^ _M1))])
        own = self.band(len(features))
        return np.concatenate([self._of_instance(band, features, sums) for band in (own, own - 1) if band >= 0])

    def _of_instance(self, band: int, features: np.ndarray, sums: np.ndarray) -> np.ndarray:
        outer, parts, slack, ends = self.layout(band)
        stops = np.searchsorted(features, ends, side="right")
        counts = np.diff(stops, prepend=0).reshape(outer, parts)
        values = np.diff(sums[stops], prepend=np.uint64(0)).reshape(outer, parts)
        if parts > 1:  # every subset leaves one part out
            counts = counts.sum(axis=1, keepdims=True) - counts
            values = values.sum(axis=1, keepdims=True) - values
        least = np.partition(counts.min(axis=1), slack)[slack]
        kept = counts.ravel() >= least
        place = np.flatnonzero(kept).astype(np.uint64) + np.uint64((band + 1) << 32)
        return mixed(values.ravel()[kept] ^ mixed(place * _M1))


@lru_cache(maxsize=8)
def part_enum(percent: int) -> PartEnum:
    return PartEnum(percent)


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending numbers as their first and the bytes of the differences, those of like weight side by side."""
    steps = np.diff(values, prepend=values[:1])
    wide = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return int(values[0]), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _unpacked(first: int, data: bytes, size: int) -> np.ndarray:
    planes = np.zeros((size, 8), np.uint8)
    given = np.frombuffer(data, np.uint8).reshape(-1, size)
    planes[:, : len(given)] = given.T
    return np.cumsum(planes.view(np.uint64).ravel()) + np.uint64(first)


def _chunks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, feature sets) of so many documents that they have CHUNK_FEATURES features or a few more."""
    ids, sets, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch["i"], batch["t"]):
            ids.append(key)
            sets.append(shingle_set(text, width))
            held += len(sets[-1])
            if held >= CHUNK_FEATURES or len(ids) >= CHUNK_DOCUMENTS:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _dealt(chunk: int, ids: list, sets: list[np.ndarray], bits: int, buckets: int) -> list[dict]:
    """The rows of a chunk: one on its documents, and its features by bucket.

    A feature that the chunk has twice is shared already; it goes out once, without an owner, for the other chunks.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    short = np.concatenate(sets) >> np.uint64(64 - bits)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(short, kind="stable")
    short, owner = short[order], owner[order]
    same = np.zeros(len(short) + 1, bool)
    same[1:-1] = short[1:] == short[:-1]
    shared = same[1:] | same[:-1]
    held = np.bincount(owner[shared], minlength=len(sets))
    first = ~same[:-1]
    owner = np.where(shared, np.uint16(0xFFFF), owner)[first]
    short = short[first]
    prints = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in sets]
    signed = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
    rows = [
        {
            "bucket": -1 - chunk % buckets, "chunk": chunk, "ids": ids, "ns": sizes, "held": held,
            "f1": signed[:, 0], "f2": signed[:, 1], "first": None, "steps": None, "owners": None,
        }
    ]
    cuts = np.searchsorted(short, np.array([-(-(k << bits) // buckets) for k in range(buckets + 1)], np.uint64))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        least, steps = _packed(short[cuts[k] : cuts[k + 1]])
        rows.append(
            {
                "bucket": k, "chunk": chunk, "ids": None, "ns": None, "held": None, "f1": None, "f2": None,
                "first": least, "steps": steps, "owners": owner[cuts[k] : cuts[k + 1]].tobytes(),
            }
        )
    return rows


def _held_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, how many features of which of its documents other chunks have too."""
    owners = [np.frombuffer(x, np.uint16) for x in rows["owners"]]
    parts = [_unpacked(f, s, len(o)) for f, s, o in zip(rows["first"], rows["steps"], owners)]
    whole = np.sort(np.concatenate(parts))
    common = np.append(np.unique(whole[1:][whole[1:] == whole[:-1]]), np.uint64(2**64 - 1))
    found = []
    for part, owner in zip(parts, owners):
        counts = np.bincount(owner[(common[np.searchsorted(common, part)] == part) & (owner != 0xFFFF)])
        places = np.flatnonzero(counts)
        found.append((places.astype(np.uint16).tobytes(), counts[places].astype(np.int32).tobytes()))
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "places": [a for a, _ in found], "counts": [b for _, b in found]})


def supported_documents(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, chance): a document's number of features, a 128-bit print of its set, and whether so many of
    its features are in other documents too that one of them can be similar enough.

    Similar sets share percent / 100 of the larger, so a set whose features are mostly its own needs no signatures.
    Features travel as a few bytes each: tasks sort those of a chunk of documents and send them by range of the
    hash, cut to as many bits as the number of features asks for. Cut hashes may meet by chance, which makes a chance
    and loses none. A feature that many documents have goes out once a chunk. What comes back is counts.
    """
    # as text, ids of any type and null ones come through Python as they are
    narrow = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    # no text has more shingles than half its bytes; prose has about one in seven
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(56, max(24, (total // 4).bit_length() + SPARE_BITS))
    buckets = max(partitions_for(df.sparkSession), 1 + total // 7 // BUCKET_FEATURES)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for k, (ids, sets) in enumerate(_chunks(batches, width)):
            yield pd.DataFrame(_dealt((task << 24) + k, ids, sets, bits, buckets))
        give_back()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        about = rows[["chunk", "ids", "ns", "held", "f1", "f2"]]
        if rows["bucket"].iloc[0] < 0:
            return about.assign(places=None, counts=None)
        return _held_in_bucket(rows).assign(**dict.fromkeys(("ids", "ns", "held", "f1", "f2")))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        about = rows[rows["ns"].notna()].iloc[0]
        held = np.array(about["held"], np.int64)
        for places, counts in zip(rows["places"], rows["counts"]):
            if places is not None:
                held[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32)
        n = np.array(about["ns"], np.int64)
        give_back()
        chance = (n > 0) & (100 * held >= percent * n)
        return pd.DataFrame({"id": list(about["ids"]), "n": n, "f1": about["f1"], "f2": about["f2"], "chance": chance})

    about = "chunk long, ids array<string>, ns array<long>, held array<long>, f1 array<long>, f2 array<long>"
    dealt = narrow.mapInPandas(deal, f"bucket long, {about}, first long, steps binary, owners binary")
    parts = written(dealt.groupBy("bucket").applyInPandas(count, f"{about}, places binary, counts binary"), "feature-counts")
    counted = parts.groupBy("chunk").applyInPandas(gather, "id string, n long, f1 long, f2 long, chance boolean")
    rows = written(counted.withColumn("id", F.col("id").cast(df.schema[id_col].dataType)), "supported")
    discard(parts)
    return rows


def bit_print(features: np.ndarray) -> np.ndarray:
    """PRINT_BITS bits as 64-bit numbers, of which each feature sets one."""
    bits = np.zeros(PRINT_BITS, bool)
    bits[features % np.uint64(PRINT_BITS)] = True
    return np.packbits(bits).view(np.int64)


def node_sets(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(node, n, hs, bits, sigs): the sets of the documents in nodes (node), their prints and their signatures."""
    wanted = nodes.select(F.col("node").alias("id"))
    wanted = F.broadcast(wanted) if _small_enough(wanted) else wanted
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, "id", "left_semi")
    kind = df.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme = part_enum(percent)
        for batch in batches:
            for k in range(0, len(batch), 200):
                piece = batch.iloc[k : k + 200]
                sets = [shingle_set(text, width) for text in piece["t"]]
                yield pd.DataFrame(
                    {
                        "node": piece["id"],
                        "n": [len(s) for s in sets],
                        "hs": [s.view(np.int64) for s in sets],
                        "bits": [bit_print(s) for s in sets],
                        "sigs": [scheme.signatures(s).view(np.int64) for s in sets],
                    }
                )
        give_back()

    return texts.mapInPandas(sign, f"node {kind}, n long, hs array<long>, bits array<long>, sigs array<long>").filter("n > 0")


def _small_enough(df: DataFrame) -> bool:
    return df.count() <= MAX_BROADCAST


def supported(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, held): how many of a node's features are in another component of members as well.

    No partner in another component can share more than that, which rules pairs out before they are made.
    """
    rows = members.select("node", "component").distinct().join(sets.select("node", "hs"), "node")
    rows = rows.select("node", "component", F.explode("hs").alias("h"))
    common = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    common = common.filter("low <> high").select("h")
    return rows.join(common, "h", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("held"))


def _bits_allow(percent: int, a: str = "_a", b: str = "_b") -> str:
    """Two prints differ in at most as many bits as sets of these sizes may differ in features."""
    return f"""{100 + percent} * aggregate(zip_with(bits{a}, bits{b}, (x, y) -> bit_count(x ^ y)), 0, (s, k) -> s + k)
        <= {100 - percent} * (n{a} + n{b})"""


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ordered distinct pairs (a, b) that neither their sizes nor their prints rule out."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = ordered.join(side("b"), "b").join(side("a"), "a")
    sizes = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return both.filter(F.expr(sizes) & F.expr(_bits_allow(percent))).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(left, right):
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            found.append(100 * shared >= percent * (len(both) - shared))
        return pd.Series(found, dtype=bool)

    similar.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    # the larger id is a member, the smaller its bucket's leader, which many pairs may share: members first
    members = pairs.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("sb")), "b")
    both = members.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("sa")), "a")
    return both.filter(F.pandas_udf(similar, "boolean")("sa", "sb")).select("a", "b")


def paired_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of two components that share a signature and that support and prints leave a chance.

    members: (sig, node, component, held, n). A signature's nodes are cut into blocks of some BLOCK_NODES, and two
    blocks at a time are joined, so that no task has a whole crowded signature.
    """
    crowd = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("blocks"))
    dealt = members.join(crowd, "sig").join(sets.select("node", "bits"), "node")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def side(name: str, others, one: str, two: str) -> DataFrame:
        spread = dealt.withColumn("other", F.explode(others)).withColumn("one", F.col(one)).withColumn("two", F.col(two))
        return spread.select(*[F.col(c).alias(f"{c}_{name}") for c in ("sig", "one", "two", "node", "component", "held", "n", "bits")])

    left = side("a", F.sequence("block", F.col("blocks") - 1), "block", "other")
    right = side("b", F.sequence(F.lit(0), "block"), "other", "block")
    on = F.expr(
        f"""sig_a = sig_b and one_a = one_b and two_a = two_b
        and (component_a < component_b or (one_a < two_a and component_a > component_b))
        and 100 * least(held_a, held_b) >= {percent} * (n_a + n_b - least(held_a, held_b))
        and {_bits_allow(percent)}"""
    )
    return left.join(right, on).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def similarity_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df; two documents link when Jaccard >= percent / 100.

    Rows with one and the same set are one node, the smallest of their ids, from the start. Nodes most of whose
    features no other document has cannot link and get no signatures. Signatures of the others are counted with
    map-side combining; those of two nodes give a pair, those of more list their nodes. First each node is compared
    with its signature's leader, and what links is one component. What then still shares a signature across
    components is compared again, with the member whose features are best supported and then pair by pair; a pair
    is left out only if the features that either has in common with all other components are too few, or if the
    bits in which their prints differ (each a feature of one alone) are too many. So a bucket of thousands of copies
    costs a comparison or two each, and yet every pair that could link is compared or already connected.
    Comparisons are exact on 64-bit hashes of the n-grams.

    Buckets, pairs and components stay distributed. Intermediate tables are written to the shared folder, and go as
    soon as nothing reads them.

    Edge cases: no rows give no rows; null, empty and blank texts have no features and link with nothing; a null
    id is its own component, null; rows that repeat an id count as one document with all their texts, and each
    is a row of the result; texts of any length are read whole; extra columns are not read.
    """
    rows = supported_documents(df, id_col, text_col, width, percent)
    filled = rows.filter("n > 0 and id is not null")
    classes = written(
        filled.groupBy("f1", "f2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows"), F.max("chance").alias("chance")), "set-classes"
    )
    repeated = written(filled.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"), "repeated-ids")
    copied = classes.filter("rows > 1").select("f1", "f2", "node")
    copied = F.broadcast(copied) if _small_enough(copied) else copied
    of_row = rows.join(copied, ["f1", "f2"], "left").select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("node", "id")).otherwise(F.col("id")).alias("node"))
    sets = node_sets(classes.filter("chance").select("node").distinct(), df, id_col, text_col, width, percent)
    # an id with several texts: what they link with is one component, by edges to each text's node
    joined = None
    if not repeated.isEmpty():
        sets = sets.dropDuplicates(["node", "hs"])
        joined = of_row.join(repeated, "id", "left_semi").filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()
    sets = written(sets, "node-sets")
    exploded = sets.select(F.explode("sigs").alias("sig"), "node")
    # signatures of the very same nodes say the same: one of them is enough
    met = exploded.groupBy("sig").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"),
        *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)],
    )
    shared = written(met.filter("a <> b").groupBy("a", "b", "n", "x1", "x2").agg(F.min("sig").alias("sig")), "shared-signatures")
    crowded = shared.filter("n > 2").select("sig", F.col("a").alias("leader"))
    crowded = F.broadcast(crowded) if _small_enough(crowded) else crowded
    listed = written(exploded.join(crowded, "sig"), "crowded-signatures")
    pairs = listed.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = pairs.unionByName(shared.filter("n = 2").select("a", "b"))
    checked = written(possible(pairs, sets, percent), "pairs")
    discard(shared)
    links = verified(checked, sets, percent)
    links = written(links if joined is None else links.unionByName(joined), "links")
    found = written(connected_components(links), "components")

    # What still shares a crowded signature across components: compared with the member whose features are best
    # supported, which most of a group of copies links with; then pair by pair, where the support leaves a chance.
    for turn in ("best", "pairs"):
        labelled = listed.join(found, listed["node"] == found["node"], "left").select(
            "sig", listed["node"], F.coalesce("component", listed["node"]).alias("component")
        )
        split = labelled.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        members = written(labelled.join(split.filter("low <> high").select("sig"), "sig"), "open-signatures")
        if members.isEmpty():
            discard(members)
            break
        held = supported(members, sets).join(sets.select("node", "n"), "node")
        held = written(held.filter(F.expr(f"100 * held >= {percent} * n")), "support")
        backed = members.join(held, "node")
        if turn == "best":
            best = backed.groupBy("sig").agg(F.max(F.struct(F.col("held") / F.col("n"), "node", "component")).alias("best"))
            chosen = backed.join(best, "sig").filter("component <> best.component")
            pairs = chosen.select(F.col("best.node").alias("a"), F.col("node").alias("b"))
        else:
            pairs = paired_in_blocks(backed, sets, percent)
        fresh = written(possible(pairs, sets, percent).join(checked, ["a", "b"], "left_anti"), "pairs")
        discard(members, held)
        if not fresh.isEmpty():
            more = written(links.unionByName(verified(fresh, sets, percent)), "links")
            discard(links, found)
            links, found = more, written(connected_components(more), "components")
            checked = checked.unionByName(fresh)
        else:
            discard(fresh)
    discard(checked, listed, sets, links, repeated)
    placed = of_row.join(found, "node", "left")
    return placed.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df whose id is the smallest of their group; ids that are null stay, and rows that repeat an id stay
    or go together. Other edge cases are those of similarity_groups."""
    groups = similarity_groups(df, id_col=id_col, **options)
    gone = written(groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "near-copies")
    gone = F.broadcast(gone) if _small_enough(gone) else gone
    return df.join(gone, id_col, "left_anti").select(df.columns)
