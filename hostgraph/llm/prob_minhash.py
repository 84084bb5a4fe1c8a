"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Every shingle (weight: how often it occurs) is a Poisson process of that rate whose arrivals
fall on random registers; a register keeps the shingle that arrived first.  Two documents agree
on a register with the probability Jaccard similarity of their shingles.  The arrivals of all
shingles of a batch are drawn together, and a shingle stops once its next arrival is later than
every register of its document.

Banding: documents that agree on all rows of a band meet.  A node is a text, named by the number of one row
that holds it; copies of a text are one node from the start, so a large group of copies costs one row each.
In a band's bucket every node is verified against the smallest one.  Pairs within one component of the links
found need no further look.  Where a bucket is left with several components, its nodes are dealt out in chunks
(of bounded number and bytes), and the pairs across components whose registers agree in not far less than the
threshold are verified by their shingles, which travel with the chunks.  A unit of work verifies no pair whose
ends it knows to be connected, and hands on a spanning forest of its links: a passage that very many documents
share fills buckets with texts that are not alike, and their pairs never become rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import WORDS, counted, mix, probability_jaccard
from .store import drop_table, write_table

BANDS, ROWS = 25, 5
SIMILARITY = 0.8
SLICE = 256            # documents whose arrivals are drawn together
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[tuple], registers: int) -> np.ndarray:
    """ProbMinHash registers (uint64, documents x registers) of non-empty weighted sets."""
    n = np.array([len(h) for h, _ in sets])
    key = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    time = np.zeros(len(key))
    first = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(sets) * registers, np.uint64)
    shift = np.zeros(1, np.uint64)
    while len(key):
        shift += _GOLDEN
        seed = mix(key + shift)
        u = ((seed >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
        time = time - np.log(u) / weight
        latest = first.reshape(len(sets), registers).max(1)
        alive = time < latest[doc]
        key, weight, doc, time, seed = key[alive], weight[alive], doc[alive], time[alive], seed[alive]
        at = doc * registers + (mix(seed) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = key[won]
    return winner.reshape(len(sets), registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band; the band's number is part of it."""
    s = signature.reshape(len(signature), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(s), 1))
    for r in range(rows):
        h = mix(h * _GOLDEN + s[:, :, r])
    return h.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, words: int) -> DataFrame:
    """``row, doc_id, text_key, shingles, bands, registers``: the row's number, a 128-bit key of the text, how
    many distinct shingles it has, its band keys (null for a null text or one without words) and 16 bits of
    each register."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sets = [counted(t, words) for t in texts]
                full = [k for k, (h, _) in enumerate(sets) if len(h)]
                keys: list = [None] * len(sets)
                short: list = [None] * len(sets)
                if full:
                    sig = signatures([sets[k] for k in full], bands * rows)
                    for k, row, reg in zip(full, band_keys(sig, bands, rows), mix(sig).astype("<u2")):
                        keys[k], short[k] = row, reg.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()),
                     pa.array([len(h) for h, _ in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    names=["doc_id", "text_key", "shingles", "bands", "registers"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, text_key binary, shingles long, bands array<long>, registers binary")
            .withColumn("row", F.monotonically_increasing_id()))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int, fan: int = 256) -> DataFrame:
    """The pairs ``u < v`` of nodes with a probability Jaccard similarity of ``threshold`` or more.

    A node's text goes to the tasks of the smaller nodes it is compared with; a smaller node with
    more than ``fan`` partners is copied to one group per ``fan`` of them.  A task holds the
    shingles of one pair at a time."""
    size = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("parts"))
    members = pairs.join(size, "u").select(
        "u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("node"))
    leads = size.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                        F.col("u").alias("node"))
    rows = (members.unionAll(leads).join(texts, "node").select("u", "part", "node", "text")
            .repartition("u", "part").sortWithinPartitions("u", "part", "node"))

    def run(batches):
        lead, own = None, None
        for batch in batches:
            us, parts, nodes = (batch.column(k).to_pylist() for k in range(3))
            found: tuple[list, list] = ([], [])
            for k, group in enumerate(zip(us, parts)):
                if nodes[k] == us[k]:
                    if group != lead:
                        lead, own = group, counted(batch.column(3)[k].as_py() or "", words)
                elif group == lead:
                    other = counted(batch.column(3)[k].as_py() or "", words)
                    if probability_jaccard(own, other) >= threshold - 1e-12:
                        found[0].append(us[k])
                        found[1].append(nodes[k])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def shingled(texts: DataFrame, words: int) -> DataFrame:
    """``node, keys, weights`` of the rows ``node, text``; no weights where no shingle repeats."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [counted(t or "", words) for t in part.column(1).to_pylist()]
                lists = []
                for x in ([h.view(np.int64) for h, _ in sets], [w if (w > 1).any() else w[:0] for _, w in sets]):
                    at = pa.array(np.cumsum([0, *map(len, x)]), pa.int32())
                    lists.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))))
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["node", "keys", "weights"])

    return texts.mapInArrow(run, "node long, keys array<long>, weights array<double>")


def links_across(members: DataFrame, payload: DataFrame, least: float, threshold: float, chunk: int = 512,
                 chunk_shingles: int = 500_000) -> DataFrame:
    """A forest ``u, v`` of links between nodes of different components that share a band (rows ``band, node,
    shingles`` of ``members``): of the pairs whose registers agree in a share of ``least`` or more, those
    of ``threshold`` or more that connect what is not yet connected.

    ``payload``: ``node, component, bands, registers, keys, weights``.  A band's bucket is cut into chunks, and
    each pair of chunks is one unit of work of bounded size; a pair is looked at where it meets first."""
    size = members.groupBy("band").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("shingles") / chunk_shingles)).cast("int").alias("chunks"))
    work = (members.join(size, "band")
            .withColumn("c", F.pmod(F.xxhash64("node", "band"), F.col("chunks")).cast("int"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("band", F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), "c", "node"))
    rows = (work.join(payload, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node"))

    def compare(keys: tuple, parts: list[pa.RecordBatch]):
        band, i, j = keys
        got = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        node, c, component = (got.column(k).to_numpy() for k in ("node", "c", "component"))
        bands = np.stack(got.column("bands").to_numpy(zero_copy_only=False))
        reg = np.stack([np.frombuffer(r, "<u2") for r in got.column("registers").to_pylist()])
        lists = []
        for name in ("keys", "weights"):
            at, flat = got.column(name).offsets.to_numpy(), got.column(name).values.to_numpy()
            lists.append([flat[lo:hi] for lo, hi in zip(at, at[1:])])
        sets = [(h.view(np.uint64), w if len(w) else np.ones(len(h))) for h, w in zip(*lists)]
        group = np.unique(component, return_inverse=True)[1]
        found: tuple[list, list] = ([], [])
        for k in range(len(node) - 1):
            other = np.arange(k + 1, len(node))
            other = other[(component[other] != component[k]) & ((c[other] != c[k]) | (i == j))]
            other = other[(reg[other] == reg[k]).mean(1) >= least]
            if len(other):
                # the first band in which they agree is this one
                first = (bands[other] == bands[k]).argmax(1)
                other = other[bands[k][first] == band]
            for x in other.tolist():
                if group[x] != group[k] and probability_jaccard(sets[k], sets[x]) >= threshold - 1e-12:
                    found[0].append(node[k])
                    found[1].append(node[x])
                    group[group == group[x]] = group[k]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            key = [batch.column(k).to_numpy() for k in ("band", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                group = tuple(int(k[lo]) for k in key)
                if group != now and parts:
                    yield compare(now, parts)
                    parts = []
                now = group
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield compare(now, parts)

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS,
                    rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, class_id, copies, kept, linkable, text_key``: the smallest doc_id that
    links of ``threshold`` or more lead to, how many rows hold exactly this text, whether the row stays when
    one row of each group of alike texts does, whether it can link at all, and the 128-bit key of its text.

    Links: equal texts, and texts whose verified similarity reaches the threshold; classes are the
    components.  Null and word-less texts link with nothing, each is its own class and stays.  Rows that
    repeat an id share a class, whatever their texts; but of texts that are not alike one each stays (of a
    group: the row of the smallest doc_id, then the first).  A null id has a null class and stays.  An empty
    table gives no rows.  Other columns are not read, whatever their names."""
    sk, sk_path = write_table(sketches(docs, id_col, text_col, bands, rows, words), "sketches")
    lead = F.min(F.struct("doc_id", "row"))
    text_nodes, node_path = write_table(
        sk.where("bands IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("text_key").agg(lead.alias("lead"), F.count(F.lit(1)).alias("copies"))
        .select("text_key", "copies", F.col("lead.row").alias("node"), F.col("lead.doc_id").alias("first")), "nodes")
    one = sk.withColumnRenamed("row", "node").join(text_nodes.select("node"), "node", "left_semi")
    keyed = one.select("node", "shingles", F.explode("bands").alias("band"))
    met_in = keyed.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    met, met_path = write_table(keyed.join(met_in.select("band", "lead"), "band"), "buckets")

    def texts(wanted: DataFrame) -> DataFrame:
        """``node, text`` of the wanted nodes (again for rows that repeat an id with its text)."""
        keys = text_nodes.join(wanted, "node", "left_semi").select("text_key", "node", "first")
        d = docs.select(F.col(id_col).cast("long").alias("first"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return d.withColumn("text_key", F.unhex(F.md5("text"))).join(keys, ["first", "text_key"]).select("node", "text")

    stars, star_path = write_table(
        met.where("node > lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    first, first_path = write_table(verified(
        stars, texts(stars.select(F.col("u").alias("node")).unionAll(stars.select("v")).distinct()), threshold, words), "links")
    part, part_path = components(first)
    named = met.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (named.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"))
             .where("a < b").select("band"))
    open_, open_path = write_table(named.join(mixed, "band", "left_semi").select("band", "node", "shingles"), "open-buckets")
    asked = open_.select("node").distinct()
    payload = (one.select("node", "bands", "registers").join(asked, "node", "left_semi")
               .join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
               .join(shingled(texts(asked), words).dropDuplicates(["node"]), "node"))
    # an estimate from so many registers falls short by more than four standard deviations in
    # three of 100,000 cases
    least = threshold - 4 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    second, second_path = write_table(links_across(open_, payload, least, threshold), "links-across")
    alike, alike_path = components(first.unionAll(second))
    # groups of alike texts, each named by its smallest doc_id's row; those that share an id are one class
    group = text_nodes.join(alike, "node", "left").withColumn("group", F.coalesce("component", "node"))
    heads = group.groupBy("group").agg(F.min(F.struct("first", "node")).alias("head"))
    texts_of, texts_path = write_table(group.join(heads, "group").select(
        "text_key", "copies", "group", F.col("head.first").alias("first"), F.col("head.node").alias("head")), "groups")
    ids = sk.where("doc_id IS NOT NULL").join(texts_of, "text_key").select("doc_id", "group").distinct()
    shared = (ids.join(ids.groupBy("doc_id").agg(F.min("group").alias("v")), "doc_id")
              .where("group <> v").select(F.col("group").alias("u"), "v"))
    tied, tied_path = components(shared)
    classes = texts_of.join(tied.withColumnRenamed("node", "group"), "group", "left").withColumn(
        "class", F.coalesce("component", "group"))
    names = classes.groupBy("class").agg(F.min("first").alias("class_id"))
    labels = classes.join(names, "class").select("text_key", "class_id", "copies", "head")
    linkable = F.col("bands").isNotNull() & F.col("doc_id").isNotNull()
    out, _ = write_table(
        sk.join(labels, "text_key", "left")
        .select("doc_id", F.when(linkable, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                F.when(F.col("bands").isNull(), F.lit(1)).otherwise(F.coalesce("copies", F.lit(1))).alias("copies"),
                (~linkable | (F.col("row") == F.col("head"))).alias("kept"), linkable.alias("linkable"), "text_key"),
        "classes")
    for p in (sk_path, node_path, met_path, star_path, first_path, part_path, open_path, second_path, alike_path,
              texts_path, tied_path):
        drop_table(docs.sparkSession, p)
    return out


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of alike texts (the one marked ``kept``; if rows repeat its id and text, one of
    them), and every row that links with nothing; all columns as they were."""
    # one key of id and text, never null: the rows meet by it and repeated ones too, so they move once
    pair = lambda i, key: F.concat(key, F.coalesce(F.col(i).cast("string").cast("binary"), F.lit(b"")))
    stays = classes.where("kept").select(pair("doc_id", F.col("text_key")).alias("pair"), "linkable").distinct()
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    d = d.withColumn("id", F.col("row")[id_col].cast("long")).select(
        "row", pair("id", F.unhex(F.md5(F.coalesce(F.col("row")[text_col], F.lit(""))))).alias("pair"))
    named = d.join(stays, "pair")
    return (named.where("linkable").dropDuplicates(["pair"]).unionByName(named.where("NOT linkable"))
            .select("row.*"))
