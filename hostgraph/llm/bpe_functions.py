"""Byte-level BPE by Spark's higher-order functions over the distinct words of a corpus.

The words (matches of the pattern) are made distinct; each is an array of one-byte pieces, and an
``aggregate`` over it merges, step by step, the leftmost adjacent pair of least rank.  Pieces are
written in hexadecimal, so joining strings joins bytes.  The rank map is one literal: an array of
small maps, found by the CRC-32 of a piece (Spark looks keys of a map up one by one).
"""
from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16
NO_RANK = (1 << 31) - 1


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<hex piece, rank>> by ``crc32(piece) mod SLOTS``; folded to a constant."""
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def _rank(piece: Column, table: Column) -> Column:
    slot = F.get(table, (F.crc32(piece.cast("binary")) % SLOTS).cast("int"))
    return F.coalesce(F.try_element_at(slot, piece), F.lit(NO_RANK))


def _merged(pieces: Column, table: Column) -> Column:
    """One merge, or the same pieces when no adjacent pair has a rank."""
    ranks = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2),
                        lambda i: _rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1)), table))

    def apply(r: Column) -> Column:
        least = F.array_min(r)
        at = F.array_position(r, least).cast("int")
        joined = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
        return F.when(least == NO_RANK, pieces).otherwise(
            F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(joined),
                     F.slice(pieces, at + 2, F.size(pieces))))

    return F.when(F.size(pieces) < 2, pieces).otherwise(F.get(F.transform(F.array(ranks), apply), F.lit(0)))


def word_ids(word: Column, table: Column) -> Column:
    """ids (array<int>) of one word."""
    raw = F.hex(F.encode(word, "UTF-8"))
    start = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.substring(raw, 2 * i + 1, F.lit(2)))
    pieces = F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, lambda acc, _: _merged(acc, table))
    folded = F.when(F.octet_length(word) < 2, start).otherwise(pieces)
    whole = _rank(raw, table)
    return F.when(whole != NO_RANK, F.array(whole)).otherwise(F.transform(folded, lambda p: _rank(p, table)))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row, as ``bpe.encode``: words are joined with their ids and each
    row's words are put in order again."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    F.monotonically_increasing_id().alias("row"))
    words = d.select("doc_id", "row", F.posexplode_outer(
        F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))).alias("at", "word"))
    known = (words.where("word IS NOT NULL").select("word").distinct()
             .select("word", word_ids(F.col("word"), rank_literal(ranks)).alias("ids")))
    placed = words.join(known, "word", "left").select(
        "row", "doc_id", F.struct("at", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).alias("x"))
    return (placed.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
            .select("doc_id", F.flatten(F.col("x.ids")).alias("ids")))


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The frame with ``decoded``: the hexadecimal pieces of ``ids``, concatenated."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return coded.withColumn("decoded", F.unhex(F.array_join(F.transform("ids", lambda i: F.get(table, i)), "")))
