"""SimHash near-duplicates: exact comparison in tiles, with numpy XOR and bit counts.

Distinct fingerprints are tiled by the population counts of their four 16-bit words.  One
differing bit changes one of these counts by one, so two fingerprints within the radius lie in
tiles whose counts differ by no more than the radius in sum; all other pairs of tiles are
skipped.  Every fingerprint is a resident of its tile and visits the tiles in reach, the pair
of tiles being compared at the one with the smaller number.  A tile with many residents is cut
into chunks, which its visitors meet one after another as a stream.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from cartlens.llm.common import components, spare
from cartlens.session import materialise

SHINGLE = 3
RADIUS = 3
SEED = 42
CHUNK = 4_096
WORDS, WORD_BITS = 4, 16
SIDE = WORD_BITS + 1


def fingerprint(data, shingle=SHINGLE):
    """The 64-bit fingerprint of a text given as UTF-8 bytes; None counts as empty.

    A bit is set if it is set in over half of the hashes of the word runs, repeats included.
    A text with fewer words is one run; a text without words has fingerprint zero.
    """
    # bytes.lower and bytes.split know ASCII letters and blanks only, as wanted here.
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: max(0, len(words) - shingle)]]).tolist()
    stops = (ends[min(len(words), shingle) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    # Bounded pieces, so that a very long text needs no more memory than a short one.
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8_192):
        piece = hashes[i : i + 8_192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs, shingle=SHINGLE, also=()):
    """``doc_id, fp``: the fingerprint as a signed long, from whole texts; columns ``also`` follow."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.select("doc_id", hashed(F.col("text").cast("binary")).alias("fp"), *also)


def tile_offsets(radius):
    """Steps to the tiles with a smaller number that are within ``radius`` in sum."""
    steps = itertools.product(range(-radius, radius + 1), repeat=WORDS)
    return [
        s
        for s in steps
        if 0 < sum(map(abs, s)) <= radius and sum(x * SIDE**i for i, x in enumerate(s)) < 0
    ]


def _counts():
    return [
        F.bit_count(F.shiftrightunsigned("fp", WORD_BITS * i).bitwiseAND(F.lit(2**WORD_BITS - 1)))
        for i in range(WORDS)
    ]


def _tile(counts):
    number = F.lit(0)
    for i, count in enumerate(counts):
        number = number + count * SIDE**i
    return number.cast("int")


def _links(visitors, residents, labels, radius, own=False):
    """Pairs that join a visitor to each group of residents it is near to.

    ``labels`` numbers the groups of residents found so far and is updated.  One pair per
    group is enough for the components, so dense groups do not give all their pairs.
    """
    out = []
    step = max(1, 4_000_000 // max(1, len(residents)))
    for i in range(0, len(visitors), step):
        some = visitors[i : i + step]
        near = np.bitwise_count(residents[:, None] ^ some[None, :]) <= radius
        if own:
            near &= np.arange(len(residents))[:, None] < np.arange(i, i + len(some))[None, :]
        for v in np.flatnonzero(near.any(axis=0)):
            hits = np.flatnonzero(near[:, v])
            groups, first = np.unique(labels[hits], return_index=True)
            out += [(some[v], residents[hits[f]]) for f in first]
            if own:
                groups = np.append(groups, labels[i + v])
            if len(groups) > 1:
                labels[np.isin(labels, groups)] = groups.min()
    return out


def links(distinct, radius=RADIUS):
    """``a, b``: near fingerprints, enough of them to connect all that are connected.

    ``distinct`` has the column ``fp`` without repeats.  Every pair of fingerprints in tiles
    within reach is compared.
    """
    tiled = distinct.select("fp", *[c.alias(f"n{i}") for i, c in enumerate(_counts())])
    tiled = tiled.withColumn("tile", _tile([F.col(f"n{i}") for i in range(WORDS)]))
    tiles = materialise(
        tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")),
        "tiles",
    )
    sizes = F.broadcast(tiles)  # at most SIDE**WORDS = 83,521 rows of two numbers
    own = tiled.join(sizes, "tile").withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    residents = own.select(
        F.col("tile").alias("home"), "chunk", F.lit(0).alias("visitor"), "fp"
    )
    to_later_chunks = own.where("chunk + 1 < chunks").select(
        F.col("tile").alias("home"),
        F.explode(F.expr("sequence(chunk + 1, chunks - 1)")).alias("chunk"),
        F.lit(1).alias("visitor"),
        "fp",
    )
    offsets = F.array(
        *[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in tile_offsets(radius)]
    )
    moved = tiled.select("fp", *[f"n{i}" for i in range(WORDS)], F.explode(offsets).alias("d"))
    reach = [F.col(f"n{i}") + F.col(f"d.d{i}") for i in range(WORDS)]
    inside = F.lit(True)
    for count in reach:
        inside = inside & count.between(0, WORD_BITS)
    visits = (
        moved.where(inside)
        .select("fp", _tile(reach).alias("tile"))
        .join(sizes, "tile")
        .select(
            F.col("tile").alias("home"),
            F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"),
            F.lit(1).alias("visitor"),
            "fp",
        )
    )

    def compare(batches):
        at, residents, labels, waiting = None, None, None, []
        for batch in batches:
            key = batch.home.to_numpy(np.int64) * 2**32 + batch.chunk.to_numpy(np.int64)
            fps = batch.fp.to_numpy().view(np.uint64)
            coming = batch.visitor.to_numpy() == 1
            cuts = np.flatnonzero(np.diff(key)) + 1
            found = []
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                if key[lo] != at:
                    if waiting:
                        rows = np.concatenate(waiting)
                        found += _links(rows, rows, np.arange(len(rows)), radius, own=True)
                    at, residents, waiting = key[lo], None, []
                stays = fps[lo:hi][~coming[lo:hi]]
                if len(stays):
                    waiting.append(stays)
                visiting = fps[lo:hi][coming[lo:hi]]
                if len(visiting) and (waiting or residents is not None):
                    if residents is None:  # residents come first, so they are complete
                        residents, waiting = np.concatenate(waiting), []
                        labels = np.arange(len(residents))
                        found += _links(residents, residents, labels, radius, own=True)
                    found += _links(visiting, residents, labels, radius)
            yield _frame(found)
        if waiting:
            rows = np.concatenate(waiting)
            yield _frame(_links(rows, rows, np.arange(len(rows)), radius, own=True))

    laid = (
        residents.unionByName(to_later_chunks)
        .unionByName(visits)
        .repartition("home", "chunk")
        .sortWithinPartitions("home", "chunk", "visitor")
    )
    return laid.mapInPandas(compare, "a long, b long")


def _frame(pairs):
    rows = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1]})


def near_duplicates(docs, shingle=SHINGLE, radius=RADIUS, also=()):
    """``doc_id, fp, component_id``: one row per row of ``docs``; named columns ``also`` follow.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` bits reach.
    Null and empty texts share fingerprint zero.  A row without ``doc_id`` is compared with
    nothing and has no component.  Rows that share an id are rows of one document: each has the
    component of its own text.  Texts of any length are hashed whole, in bounded pieces.
    """
    hashed = materialise(fingerprints(docs, shingle, also), "fingerprints")
    named = hashed.where(F.col("doc_id").isNotNull())
    classes = materialise(
        named.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes"
    )
    pairs = materialise(links(classes.select("fp"), radius).distinct(), "fingerprint-links")
    found = materialise(components(pairs, "fingerprint-components"), "fingerprint-members")
    found = found.withColumnRenamed("node", "fp")
    # Stored, like the members, so that the join on a root with very many members can be split.
    linked = materialise(
        classes.join(found, "fp").groupBy("root").agg(F.min("first").alias("component_id")),
        "fingerprint-smallest",
    )
    linked = found.join(linked, "root").select("fp", "component_id")
    roots = materialise(
        classes.join(linked, "fp", "left").select(
            "fp", F.coalesce("component_id", "first").alias("component_id")
        ),
        "fingerprint-roots",
    )
    # Two stored tables: AQE splits the shuffle of a fingerprint that very many rows share.
    return hashed.join(roots, "fp", "left").select(
        "doc_id",
        "fp",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        *also,
    )


def query(docs):
    """One row per document: fingerprint in 16 hexadecimal digits and component."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs, shingle=SHINGLE, radius=RADIUS):
    """One document of each component, the one with the smallest id; all columns pass through.

    Rows without an id stay.  Of rows that share an id one stays, on any layout the same: of
    those whose text is in the component of that id, the one with the smallest hash of its
    text, then of its other columns.  Columns named like those made here are kept as they are.
    """
    key = spare(docs, "text_key")
    # Two hashes, so that different texts are not taken for one another.
    keyed = docs.withColumn(
        key, F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"))
    )
    kept = (
        near_duplicates(keyed.select("doc_id", "text", key), shingle, radius, [key])
        .where("doc_id = component_id")
        .groupBy("doc_id")
        .agg(F.min(key).alias(key))
    )
    one = keyed.where(F.col("doc_id").isNotNull()).join(kept, ["doc_id", key], "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rank = F.xxhash64(F.to_json(F.struct(*others)))
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank)
    one = one.groupBy(F.col("doc_id").alias(spare(docs, "group"))).agg(row.alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
