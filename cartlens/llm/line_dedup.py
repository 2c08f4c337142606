"""Near-duplicate lines by a segment-partition edit join, in DataFrame and SQL functions only.

Lines within ``max_edits`` edits of each other, and all that hang together by such links, are
one class; the first occurrence of a class in the corpus stays.  A line is cut into
``max_edits + 1`` segments.  Two lines within the threshold agree in one segment at a place
that the lengths narrow down to a few, so each line sends one key per segment and a few probes
for every length it may match.  Keys are hashes; only keys that two different lines share lead
to a comparison, which is a banded bit-parallel edit distance on the lines themselves.

With ``whole``, as the registered query and the pipeline have it, that holds for every line
that is not blank: exact repeats of any length, and near lines within edits scaled to the length
of the shorter one.  Lines are split and hashed once and stored; all lengths go through one
join, in which the length of the shorter line says how many edits are allowed.
"""

from pyspark.sql import functions as F

from cartlens.llm.common import components, spare
from cartlens.session import materialise

MIN_CHARS = 20
MAX_EDITS = 2
BLOCK = 64
BROADCAST_LINES = 200_000
_TOP = 60  # highest bit of the window of the bit vectors


def lines_of(docs):
    """``doc_id, pos, line``: the lines of at least one character, without outer blanks.

    Null text has no lines.  Rows without ``doc_id`` are left out.
    """
    split = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "raw")
    )
    return split.select("doc_id", "pos", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))


def _line_id():
    """128 bits that name a line, so that no two lines of a large corpus are taken for one."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")]


def stored_lines(docs, least=1):
    """``doc_id, pos, line, n, h1, h2`` of the lines of ``least`` characters, written once."""
    lines = lines_of(docs).withColumn("n", F.length("line")).where(F.col("n") >= least)
    return materialise(lines.select("*", *_line_id()), "lines")


def segment_places(max_edits):
    """``(shorter, segment, shift, indexed)`` of the keys that a line sends.

    ``indexed`` keys are the segments of the line itself.  The others are the places of a
    line at most ``max_edits`` shorter where one of its segments may stand, by the bounds from
    the left and the right end (Li, Deng, Wang and Feng, PVLDB 2011).  Equal lengths share the
    key of an unshifted segment, so that one is not sent twice.
    """
    return [
        (shorter, i, shift, shorter == 0 and shift == 0)
        for shorter in range(max_edits + 1)
        for i in range(max_edits + 1)
        for shift in range(
            max(-i, shorter - (max_edits - i)), min(i, shorter + (max_edits - i)) + 1
        )
    ]


def scaled_edits(max_edits, min_chars):
    """``(edits, least, below)``: the lengths of a shorter line that allow so many edits.

    That is ``max_edits * n / min_chars``, rounded down, up to ``max_edits``: by default one
    edit for 10 to 19 characters, two from there and none below.
    """
    starts = [-(-e * min_chars // max_edits) for e in range(1, max_edits + 1)]
    return list(zip(range(1, max_edits + 1), starts, [*starts[1:], None]))


def _keyed(lines, ranges):
    """``key, indexed, h1, h2`` for every line and place; the key is one short expression.

    ``ranges`` are those of ``scaled_edits``; a line sends the keys of each range that it, or a
    line that is at most so many edits shorter, lies in.
    """

    def places(some):
        return F.array(
            *[
                F.struct(
                    F.lit(edits).alias("edits"),
                    F.lit(least).alias("least"),
                    F.lit(below or 2**31 - 1).alias("below"),
                    F.lit(shorter).alias("shorter"),
                    F.lit(i).alias("i"),
                    F.lit(shift).alias("shift"),
                    F.lit(indexed).alias("indexed"),
                )
                for edits, least, below in some
                for shorter, i, shift, indexed in segment_places(edits)
            ]
        )

    # Most lines are longer than what any range but the last one can ask of them.
    most, last, _ = ranges[-1]
    sent = F.when(F.col("n") >= last + most, places(ranges[-1:])).otherwise(places(ranges))
    sent = lines.select("line", "h1", "h2", "n", F.inline(sent))
    # The last segments of a length that does not divide evenly are one longer.
    sent = sent.withColumn("size", F.col("n") - F.col("shorter")).where("size >= least and size < below")
    sent = sent.selectExpr(
        "line", "h1", "h2", "indexed", "edits", "i", "size",
        "cast(size / (edits + 1) as int) as width", "edits + 1 - size % (edits + 1) as even", "shift",
    )
    sent = sent.withColumn(
        "start", F.expr("i * width + greatest(0, i - even) + shift")
    ).withColumn("width", F.expr("width + if(i >= even, 1, 0)"))
    return sent.where("start >= 0").selectExpr(
        "xxhash64(edits, size, i, substring(line, start + 1, width)) as key", "indexed", "h1", "h2"
    )


def _let(name, value, body):
    """``value`` worked out once under ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def edit_distance(a, b, most):
    """SQL of the edit distance of two lines, exact up to ``most`` and larger beyond.

    ``a`` is the longer one and at most ``most`` longer.  Both are expressions of structs with
    ``line`` and its length ``n``.  The window of the bit vectors holds the
    2 * most + 1 diagonals that matter and slides by one character per step (Hyyro, Nordic
    Journal of Computing 2003); it is worked out for one character of ``b`` after another.
    """
    ones = (1 << (_TOP + 1)) - 1
    top = 1 << _TOP
    start = sum(1 << (_TOP - i) for i in range(most + 1))
    equal = " | ".join(
        f"if(get(long, j - {most} + {t}) = c, {1 << (_TOP - 2 * most + t)}L, 0L)"
        for t in range(2 * most + 1)
    )
    after = _let(
        "h",
        f"named_struct('p', (s.vn | (({ones}L ^ (d0 | s.vp)))) & {ones}L, 'n', d0 & s.vp)",
        f"""named_struct(
            'vp', (h.n | ({ones}L ^ (shiftright(d0, 1) | h.p))) & {ones}L,
            'vn', shiftright(d0, 1) & h.p,
            'd', s.d + if(j < {a}.n - {most},
                if((d0 & {top}L) = 0, 1, 0),
                if((h.p & shiftright({top >> 1}L, cast(j - {a}.n + {most} as int))) != 0, 1, 0)
                - if((h.n & shiftright({top >> 1}L, cast(j - {a}.n + {most} as int))) != 0, 1, 0)))""",
    )
    step = _let(
        "c",
        "get(short, j)",
        _let(
            "eq",
            f"({equal})",
            _let("d0", f"(((((eq & s.vp) + s.vp) ^ s.vp) | eq | s.vn) & {ones}L)", after),
        ),
    )
    walk = f"""aggregate(sequence(0, {b}.n - 1),
        named_struct('vp', {start}L, 'vn', 0L, 'd', {most}), (s, j) -> {step}, s -> s.d)"""
    return _let("long", f"split({a}.line, '')", _let("short", f"split({b}.line, '')", walk))


def near_pairs(docs, max_edits=MAX_EDITS, min_chars=MIN_CHARS, max_chars=None):
    """``a, b``: ids of two different lines within ``max_edits`` edits, each pair once.

    Lines under ``min_chars`` and, where given, over ``max_chars`` characters are left out.
    """
    lines = stored_lines(docs, min_chars)
    if max_chars is not None:
        lines = lines.where(F.col("n") <= max_chars)
    return _pairs(lines, [(max_edits, min_chars, None)])


def scaled_pairs(docs, max_edits=MAX_EDITS, min_chars=MIN_CHARS):
    """Like ``near_pairs``, for lines of all lengths, within the ``scaled_edits`` of the shorter one."""
    ranges = scaled_edits(max_edits, min_chars)
    return _pairs(stored_lines(docs, ranges[0][1]), ranges)


def _pairs(lines, ranges):
    """The pairs of stored ``lines`` within the edits that ``ranges`` give the shorter line."""
    max_edits = ranges[-1][0]
    keyed = _keyed(lines.where(F.col("n") >= ranges[0][1]), ranges)
    # Every repeat of a line merges into one row before the shuffle, so a frequent line is small.
    shared = materialise(
        keyed.groupBy("key")
        .agg(
            F.min("h1").alias("low"),
            F.max("h1").alias("high"),
            F.max(F.col("indexed").cast("int")).alias("indexed"),
        )
        .where("low <> high and indexed = 1")
        .select("key"),
        "shared-keys",
    )
    members = materialise(
        _with(keyed, shared, ["key"]).groupBy("key", "h1", "h2").agg(
            F.max("indexed").alias("indexed")
        ),
        "key-members",
    )
    wanted = materialise(members.select("h1", "h2").distinct(), "wanted-lines")
    texts = materialise(
        _with(lines.select("line", "h1", "h2"), wanted, ["h1", "h2"])
        .groupBy("h1", "h2")
        .agg(F.first("line").alias("line")),
        "line-texts",
    )
    # Each edit flips at most two of 64 parities of characters, and four of those of pairs.
    singles = "aggregate(sequence(0, n - 1), 0L, (s, i) -> s ^ shiftleft(1L, pmod(hash(get(c, i)), 64)))"
    pairs = (
        "aggregate(sequence(1, n - 1), 0L, (s, i) -> s ^ shiftleft(1L,"
        " pmod(hash(get(c, i - 1), get(c, i)), 64)))"
    )
    texts = texts.select("h1", "h2", "line", F.length("line").alias("n")).select(
        "h1",
        "h2",
        F.struct("line", "n").alias("text"),
        F.expr(
            _let("c", "split(line, '')", f"named_struct('one', {singles}, 'two', {pairs})")
        ).alias("parity"),
    )
    # A key with many lines is cut into blocks; pairs of blocks are compared where they meet.
    counts = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocks = (
        members.join(counts, "key")
        .join(texts, ["h1", "h2"])
        .withColumn("block", F.pmod(F.xxhash64("h2"), F.col("blocks")))
        .groupBy("key", "block", "blocks")
        .agg(
            F.collect_list(
                F.struct(F.struct("h1", "h2").alias("id"), "indexed", "text", "parity")
            ).alias("items")
        )
    )
    blocks = materialise(blocks, "line-blocks")
    left = blocks.select(
        "key", F.col("block"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("other"), F.col("items").alias("ours")
    )
    right = blocks.select("key", F.col("block").alias("other"), F.col("items").alias("theirs"))
    distance = (
        f"if(x.text.n >= y.text.n, {edit_distance('x.text', 'y.text', max_edits)}, "
        f"{edit_distance('y.text', 'x.text', max_edits)})"
    )
    allowed = " ".join(f"when least(x.text.n, y.text.n) >= {least} then {e}" for e, least, _ in reversed(ranges))
    allowed = f"(case {allowed} else 0 end)"
    close = f"""(x.indexed or y.indexed) and x.id <> y.id and (block <> other or x.id < y.id)
        and abs(x.text.n - y.text.n) <= {allowed}
        and bit_count(x.parity.one ^ y.parity.one) <= 2 * {allowed}
        and bit_count(x.parity.two ^ y.parity.two) <= 4 * {allowed}
        and {distance} <= {allowed}"""
    found = left.join(right, ["key", "other"]).select(
        F.explode(
            F.expr(
                "flatten(transform(ours, x -> transform("
                f"filter(theirs, y -> {close}), "
                "y -> named_struct('a', least(x.id, y.id), 'b', greatest(x.id, y.id)))))"
            )
        ).alias("pair")
    )
    return materialise(found.select("pair.a", "pair.b").distinct(), "line-pairs")


def _with(rows, few, keys):
    """Rows whose keys are in ``few``; a counted small table is broadcast, a larger one joined."""
    if few.count() <= BROADCAST_LINES:
        few = F.broadcast(few)
    return rows.join(few, keys, "left_semi")


def repeated_lines(docs, max_edits=MAX_EDITS, min_chars=MIN_CHARS, whole=False):
    """``doc_id, dropped, links, classes``: for each document the lines that repeat another.

    ``dropped`` are the numbers, from 0, of lines whose class has an earlier occurrence, by
    ``doc_id`` and then line number.  ``classes`` names the class of each dropped line by its
    smallest line id (hexadecimal) and ``links`` counts the near lines of other wording that
    the dropped lines have.  Documents that lose no line are not in the table.  Lines under
    ``min_chars`` characters are never dropped, unless ``whole``: then every line that is not
    blank has a class, by its exact repeats and by ``scaled_edits``.
    """
    lines = stored_lines(docs, 1 if whole else min_chars)
    pairs = _pairs(lines, scaled_edits(max_edits, min_chars)[0 if whole else -1 :])
    classes = components(pairs, "line-classes")
    degree = (
        pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
        .groupBy(F.col("a").alias("node"))
        .agg(F.count(F.lit(1)).alias("links"))
    )
    known = materialise(
        classes.join(degree, "node").select(
            F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "root", "links"
        ),
        "line-roots",
    )
    places = lines.select("doc_id", "pos", "h1", "h2")
    exact = places.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    rooted = exact.join(known, ["h1", "h2"], "left").where("n > 1 or root is not null")
    rooted = materialise(
        rooted.select(
            "h1",
            "h2",
            "first",
            F.coalesce("root", F.struct("h1", "h2")).alias("root"),
            F.coalesce("links", F.lit(0)).alias("links"),
        ),
        "line-firsts",
    )
    # Joined as two stored tables, so that AQE can split a class with very many lines.
    earliest = materialise(rooted.groupBy("root").agg(F.min("first").alias("keep")), "line-earliest")
    marked = materialise(rooted.join(earliest, "root").select("h1", "h2", "root", "links", "keep"), "line-keeps")
    # Both sides are stored tables, so AQE can split the shuffle of a very frequent line.
    return (
        places.join(marked, ["h1", "h2"])
        .where(F.struct("doc_id", "pos") > F.col("keep"))
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_set(
                    F.struct("pos", F.concat(F.hex("root.h1"), F.hex("root.h2")).alias("class"))
                )
            ).alias("hits"),
            F.sum("links").alias("links"),
        )
        .select(
            "doc_id",
            F.col("hits.pos").alias("dropped"),
            F.col("hits.class").alias("classes"),
            "links",
        )
    )


def query(docs, whole=False):
    """One row per document: lines, lines dropped, their numbers, classes and links.

    Null text has no lines, empty text one empty line.  Rows that share a ``doc_id`` are
    treated alike, and a row without one is never compared and loses nothing.
    """
    found = repeated_lines(docs, whole=whole)
    counted = docs.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines")
    )
    return counted.join(found, "doc_id", "left").select(
        "doc_id",
        F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"),
        F.coalesce(F.array_join("classes", ","), F.lit("")).alias("classes"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def drop_repeated_lines(docs, max_edits=MAX_EDITS, min_chars=MIN_CHARS, whole=False):
    """``docs`` without the repeated lines; ``n_chars`` follows where that column exists.

    A document of which nothing but blanks remains is left out if it lost a line.  All other
    columns pass through.
    """
    name = spare(docs, "_dropped")
    found = repeated_lines(docs, max_edits, min_chars, whole).select(
        "doc_id", F.col("dropped").alias(name)
    )
    numbers = f"array_except(sequence(0, size(l) - 1), {name})"
    kept = F.expr(_let("l", "split(text, '\n')", f"transform({numbers}, i -> get(l, i))"))
    whole = F.col(name).isNull()
    joined = docs.join(found, "doc_id", "left").withColumn(
        "text", F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n"))
    )
    joined = joined.where(whole | (F.length(F.btrim("text", F.lit(" \n\t\r\x0b\x0c"))) > 0))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(length))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
