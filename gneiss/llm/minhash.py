"""Near-duplicate detection by b-bit MinHash.

Each document's set of word shingles has 128 minima. Bands of four full minima generate candidates; of every minimum two
low bits are retained and packed into four longs. For a candidate pair, XOR and bit counts of the packed signatures give
the share P of equal lanes, and (P - 1/4) / (3/4) estimates the similarity with chance collisions taken out. Pairs whose
estimate lies five standard deviations below the threshold are dropped, the rest is confirmed on the full sets.

Work stays linear in large groups. Documents with equal sets form one class, a numbered node in the order of its smallest
doc_id. In each band bucket members are first compared with the bucket's smallest node only, each with the one hub that it shares most
bands with. Confirmed links give components. Members that a hub draws together, linked or not, are a group; where a group
holds several components, tiles of members outside its largest component and of all its members are compared within one
task, which returns at most one link for each member and other component. Last, pairs that share a bucket but neither
group nor component are compared. Pairs within a component need no test, so no link between components is lost and a
group of copies never becomes all its pairs.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**4)**32, 5e-8.

Defined results: a null or wordless text has an empty set and is linked with nothing; a text with fewer words than a
shingle has its whole sequence as its one shingle; rows that repeat a doc_id are rows of their own, linked by their texts
only, and so are null doc_ids, which come after all others: a group of these alone has a null component_id; kept says that
doc_id is the group's component_id; an empty table gives an empty table; other columns are not carried by near_duplicates.
keep_representatives keeps one row of each group, of several with its smallest doc_id the one whose text has the smallest
hash, and every wordless row, with all columns. Sets hold 64-bit hashes of shingles; a row is known by its doc_id and a
64-bit hash of its text.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.shared import drop_written, giving_back, join_hot, join_salted, read_table, written
from gneiss.llm.tokenizer import text_blocks
from gneiss.llm.words import gram_hashes, mix, sequence_hash, word_hashes

HASHES, BANDS, BITS = 128, 32, 2
_ROWS, _LANES = HASHES // BANDS, 64 // BITS
LAST = (1 << 63) - 1
#: Up to so many rows of ids (under 30 MB) are broadcast to pick out texts; beyond, texts are shuffled.
BROADCAST_IDS = 500_000


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return numbers[:HASHES] | np.uint64(1), numbers[HASHES:]


def shingle_sets(texts: list[bytes], shingle: int, fold: bool) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at = word_hashes(texts, fold)
    grams = gram_hashes(hashes, shingle)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= shingle:
            sets.append(np.unique(grams[a : b - shingle + 1]))
        else:
            sets.append(np.array([sequence_hash(hashes[a:b])] if b > a else [], np.uint64))
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES 32-bit minima for each non-empty set."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    every = np.concatenate(sets)
    out = np.empty((len(sets), HASHES), np.uint32)
    for j, (a, b) in enumerate(zip(*_coefficients(), strict=True)):
        out[:, j] = np.minimum.reduceat((every * a + b) >> np.uint64(32), starts)
    return out


def packed(lows: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, packed into longs."""
    lanes = (lows & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(lows), -1, _LANES)
    return np.bitwise_or.reduce(lanes << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def band_keys(lows: np.ndarray) -> np.ndarray:
    rows = lows.astype(np.uint64).reshape(len(lows), BANDS, _ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(_ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return total.view(np.int64)


SIGNATURE = [f"s{i}" for i in range(HASHES * BITS // 64)]


def estimate(a: str, b: str) -> Column:
    """The collision-corrected similarity of the packed signatures of columns a.s0, ... and b.s0, ..."""
    lanes = F.lit(sum(1 << (BITS * i) for i in range(_LANES)))

    def differing(s: str) -> Column:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        return F.bit_count(reduce(Column.bitwiseOR, (F.shiftrightunsigned(x, i) for i in range(BITS))).bitwiseAND(lanes))

    chance = 1 / (1 << BITS)
    equal = 1 - reduce(Column.__add__, map(differing, SIGNATURE)) / float(HASHES)
    return (equal - chance) / (1 - chance)


def least_estimate(similarity: float, deviations: float = 5.0) -> float:
    """What the estimate of a pair at the similarity exceeds, but for so many standard deviations."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * similarity
    return similarity - deviations * sqrt(p * (1 - p) / HASHES) / (1 - chance)


ROW = ["id", "row"]


def _texts(docs: DataFrame) -> DataFrame:
    """id, row (a hash of the text) and text of each row; id and row together stand for a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def signatures(docs: DataFrame, shingle: int, fold: bool) -> DataFrame:
    """id, row, n_shingles, set_key (a digest of the set), the packed signature and band keys of each row."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a, b in text_blocks(texts):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), shingle, fold)
                some = [i for i, s in enumerate(sets) if len(s)]
                signature, bands = np.zeros((b - a, len(SIGNATURE)), np.int64), [None] * (b - a)
                if some:
                    lows = minima([sets[i] for i in some])
                    signature[some] = packed(lows)
                    for i, keys in zip(some, band_keys(lows), strict=True):
                        bands[i] = keys
                columns = [*(batch.column(c).slice(a, b - a) for c in ROW), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *map(pa.array, signature.T), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*ROW, "n_shingles", "set_key", *SIGNATURE, "bands"])

    return _texts(docs).mapInArrow(giving_back(run), f"id long, row long, n_shingles long, set_key binary, {', '.join(f'{s} long' for s in SIGNATURE)}, bands array<long>")


def _grams(docs: DataFrame, nodes: DataFrame, shingle: int, fold: bool) -> DataFrame:
    """node and grams (its full set) of the rows of docs that the written table nodes (id, row, node) names."""

    def sets(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a, b in text_blocks(texts):
                found = shingle_sets(texts.slice(a, b - a).to_pylist(), shingle, fold)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "grams"])

    chosen = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    return _texts(docs).join(chosen, ROW).select("node", "text").mapInArrow(giving_back(sets), "node long, grams binary")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, fold: bool, percent: int) -> DataFrame:
    """Of pairs of nodes (a, b) those whose full sets have 100 * intersection >= percent * union. Reads the texts of these nodes only."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = written(classes.select(*ROW, "node").join(ids, "node"), "pair-nodes")

    def agree(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    grams = written(_grams(docs, ids, shingle, fold).dropDuplicates(["node"]), "pair-sets")
    # A hub is in the pairs of all its members; its set goes to parts of them.
    uses = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("uses")), "pair-uses")
    members = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    joined = join_salted(members, grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), uses, "b", "uses", pairs.count(), "a")
    out = written(joined.select("a", "b", "x", "y").mapInArrow(giving_back(agree), "a long, b long"), "confirmed", batch=100)
    drop_written(ids, grams, uses)
    return out


def tile_links(few: dict, many: dict, least: float, percent: int) -> list[tuple[int, int]]:
    """Links (node, node) between members of few and of many in another component, one for each member of few and component.

    Both hold arrays node, component, a matrix signature and a list of sets grams."""
    sizes = np.array([len(g) for g in many["grams"]])
    tokens, coded = np.unique(np.concatenate(many["grams"]), return_inverse=True)
    starts = np.cumsum([0, *sizes])[:-1]
    lanes = np.uint64(sum(1 << (BITS * i) for i in range(_LANES)))
    chance = 1 / (1 << BITS)
    most_different = int((1 - (chance + (1 - chance) * least)) * HASHES + 1e-9)
    signature, links = many["signature"].astype(np.int64).view(np.uint64), []
    for i, component, own, grams in zip(few["node"].tolist(), few["component"].tolist(), few["signature"].astype(np.int64).view(np.uint64), few["grams"], strict=True):
        x = signature ^ own[None, :]
        near = (np.bitwise_count((x | (x >> np.uint64(1))) & lanes).sum(axis=1) <= most_different) & (many["component"] != component)
        if not near.any():
            continue
        at = np.minimum(np.searchsorted(tokens, grams), len(tokens) - 1)
        has = np.zeros(len(tokens), bool)
        has[at[tokens[at] == grams]] = True
        both = np.add.reduceat(has[coded].astype(np.int64), starts)
        hit = np.flatnonzero(near & (100 * both >= percent * (sizes + len(grams) - both)))
        _, first = np.unique(many["component"][hit], return_index=True)
        links += [(i, j) for j in many["node"][hit[first]].tolist()]
    return links


#: Members in one tile: those outside the largest component, and all of a group.
FEW, MANY = 512, 1024


def _tiled(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """columns, row and column of the members outside the largest component (major) and of all, as tiles of a group's pairs; rows has few, many, major, component and node."""
    tall, wide = F.ceil(F.col("few") / FEW).cast("int"), F.ceil(F.col("many") / MANY).cast("int")
    rows = rows.withColumns({"tall": tall, "wide": wide})
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.filter("component <> major").select(*columns, deal(1, "tall").alias("row"), every("wide").alias("column"))
    return few, rows.select(*(F.col(c).alias(c) for c in columns), every("tall").alias("row"), deal(2, "wide").alias("column"))


def _group_links(groups: DataFrame, grams: DataFrame, least: float, percent: int) -> DataFrame:
    """Links between components of the same group; groups has group, few, many, major, component, node and the signature."""
    few, many = _tiled(groups.join(grams, "node"), ["group", "node", "component", *SIGNATURE, "grams"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def side(t: pa.Table) -> dict:
        return {"node": t.column("node").to_numpy(), "component": t.column("component").to_numpy(), "signature": np.stack([t.column(s).to_numpy() for s in SIGNATURE], axis=1), "grams": [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = tile_links(side(left), side(right), least, percent) if left.num_rows and right.num_rows else []
        return pa.Table.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=schema)

    return few.groupBy("group", "row", "column").cogroup(many.groupBy("group", "row", "column")).applyInArrow(run, "a long, b long")


def _major(sizes: DataFrame, key: str) -> DataFrame:
    """Of key, component and n: for each key with several components the largest one, few members outside it, and many in all."""
    major = sizes.groupBy(key).agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("many")).filter("c > 1")
    return major.select(key, F.col("most.component").alias("major"), (F.col("many") - F.col("most.n")).alias("few"), "many")


def _classes(rows: DataFrame) -> DataFrame:
    """set_key, n (its rows), id and row of its first row, and node, a number in the order of id."""
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct(*ROW)).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = classes.select("set_key", "n", "first.*").repartitionByRange("id", "set_key").sortWithinPartitions("id", "set_key")
    return written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def _of_node(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("id").alias("node"), name)


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, total: int, shingle: int, percent: int, fold: bool) -> DataFrame:
    """id and component of each node with a link; members are the nodes of buckets with several, total is the number of bands."""
    least = least_estimate(percent / 100)

    # One comparison for each member: with the hub that it shares most bands with.
    shares = members.filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"), *(F.first(s).alias(s) for s in SIGNATURE))
    best = shares.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("minus_hub"), *SIGNATURE)).alias("best")).select("node", (-F.col("best.minus_hub")).alias("hub"), *(F.col(f"best.{s}").alias(s) for s in SIGNATURE))
    best = written(best, "best-hubs")
    own = members.filter("node = hub").select("hub", *(F.col(s).alias(f"h_{s}") for s in SIGNATURE)).dropDuplicates(["hub"])
    own = written(own.join(best.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "hub"), "hub-signatures")
    pairs = join_hot(best, own, "hub", "size", best.count())
    pairs = pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.struct(*SIGNATURE).alias("x"), F.struct(*(F.col(f"h_{s}").alias(s) for s in SIGNATURE)).alias("y"))
    first = written(pairs.filter(estimate("x", "y") >= least).select("a", "b"), "hub-pairs")
    drop_written(best, own)
    links = confirmed(first, docs, classes, shingle, fold, percent)
    found = written(components(links), "hub-components")

    # Members that a hub draws together: components of all hub pairs, confirmed or not.
    drawn = written(components(first).withColumnRenamed("component", "group"), "groups")
    grouped = written(drawn.join(found, "id", "left").select(F.col("id").alias("node"), "group", F.coalesce("component", "id").alias("component")), "grouped")
    major = written(_major(grouped.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")), "group"), "majors")
    if not major.isEmpty():
        mixed = join_hot(grouped, major, "group", "many", grouped.count())
        mixed = written(mixed.join(members.select("node", *SIGNATURE).dropDuplicates(["node"]), "node"), "mixed-groups")
        ids = written(classes.select(*ROW, "node").join(mixed.select("node"), "node"), "mixed-nodes")
        grams = written(_grams(docs, ids, shingle, fold).dropDuplicates(["node"]), "mixed-sets")
        links = written(links.unionByName(_group_links(mixed, grams, least, percent)), "group-links")
        drop_written(grams, ids, mixed)
        found = written(components(links), "group-components")
    drop_written(major)

    # Buckets that still hold several components: members outside the largest one against those of other groups.
    labelled = members.join(_of_node(found, "component"), "node", "left").join(_of_node(drawn, "group"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("group", "node").alias("group"), *SIGNATURE)
    major = written(_major(labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "key"), "majors")
    rest = written(join_hot(labelled, major, "key", "many", total), "mixed-members")
    x, y = (side.alias(name) for side, name in zip(_tiled(rest, ["key", "node", "component", "group", "major", *SIGNATURE]), "xy", strict=True))
    tile = (F.col("x.key") == F.col("y.key")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.column") == F.col("y.column"))
    apart = tile & (F.col("x.component") != F.col("y.component")) & (F.col("x.group") != F.col("y.group")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.node") < F.col("y.node")))
    second = x.join(y, apart & (estimate("x", "y") >= least)).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    second = written(second, "rest-pairs")
    drop_written(members, rest, major, grouped, drawn)
    if not second.isEmpty():
        found = written(components(links.unionByName(confirmed(second, docs, classes, shingle, fold, percent))), "components")
    return found


def _labelled(docs: DataFrame, shingle: int, percent: int, fold: bool) -> DataFrame:
    """id, row, n_shingles and component of each row of docs: the first node that its class reaches, and in first_id that node's id; both null for wordless rows."""
    rows = written(signatures(docs, shingle, fold), "signatures")
    classes = _classes(rows)
    reps = rows.join(classes.select(*ROW, "set_key", "node"), [*ROW, "set_key"]).dropDuplicates(["node"])
    bands = reps.select("node", F.explode("bands").alias("key"), *SIGNATURE)
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = written(hubs, "band-hubs")
    total = classes.count() * BANDS
    members = written(join_hot(bands, hubs, "key", "size", total).drop("size"), "band-members")
    drop_written(hubs)
    # Without a bucket of several nodes there are no links.
    linked = None if members.isEmpty() else _linked(docs, classes, members, total, shingle, percent, fold)
    whole = classes.withColumn("component", F.col("node"))
    if linked is not None:
        whole = classes.join(_of_node(linked, "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = classes.select(F.col("node").alias("component"), F.col("id").alias("first_id"))
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    whole = join_hot(whole.select("set_key", "n", "component"), names.join(sizes, "component"), "component", "size", classes.count()).drop("size")
    rows_of = rows.select(*ROW, "n_shingles", "set_key")
    some = join_hot(rows_of.filter("n_shingles > 0"), written(whole, "class-components"), "set_key", "n", rows.count())
    none = rows_of.filter("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "first_id": F.lit(None).cast("long")})
    columns = [*ROW, "n_shingles", "component", "first_id"]
    return some.select(*columns).unionByName(none.select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    component = F.coalesce("first_id", "id")
    named = lambda c: F.when(c != LAST, c)
    return _labelled(docs, shingle, percent, fold).select(named(F.col("id")).alias("doc_id"), "n_shingles", named(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """The rows of docs that stay: one of each group and all wordless ones, with the columns of docs."""
    rows = written(_labelled(docs, shingle, percent, fold), "near-labelled")
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct(*ROW)).alias("first")).select("component", "first.*")
    # What goes, by id alone where each id is on one row.
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("_id"))
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    if ids["n"] == ids["ids"]:
        gone = written(rows.filter("id <> first_id").select(F.col("id").alias("_id")), "near-dropped")
        few = gone.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(gone) if few else gone, own, "left_anti")
    stays = written(first.select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.lit(True).alias("_one")).unionByName(rows.filter("component is null").select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.lit(False).alias("_one")).distinct()), "near-kept")
    keyed = docs.withColumns({"_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), "_all": F.struct(*docs.columns)})
    keyed = keyed.join(stays, own & (F.col("_hash") == F.col("_row"))).select("_id", "_row", "_one", "_all")
    # Rows alike in doc_id and text: one of them, wordless ones all.
    one = keyed.filter("_one").groupBy("_id", "_row").agg(F.first("_all").alias("_all"))
    return one.select("_all.*").unionByName(keyed.filter(~F.col("_one")).select("_all.*"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op5_minhash": op5_minhash}
ORACLE_SQL: dict[str, str] = {}
