"""A Merkle manifest of a dataset: one root hash, and for every document a proof that leads to it.

Documents are the leaves of one tree per source, in the order of their ids, and the roots of
these trees are the leaves of a tree over the sources.  Sixteen consecutive nodes are hashed to
one.  A leaf's place in its tree, in digits of base sixteen, says under which nodes it stands.

The rollup works in blocks of 4,096 consecutive nodes (three digits), so no row grows beyond
that.  Within a block the digit columns are grouped away one after another: each time the child
structs go, in order, into a parent struct that has them and their hash.  The block's struct is
stored, its hash is a node of the next round, and rounds go on until every tree has one node.

Proofs come from above.  The steps of a block, found by the round above it, meet the block's
struct by union and grouping on the block's number; ``transform`` then makes the steps of the
children from their siblings and ``explode`` hands them down, digit by digit.  No proof needs a
join (only the numbering has one, with a row per partition), and a hot source is just more blocks.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.functions.ordered import lay_out
from cartlens.llm.common import ascii_lower
from cartlens.session import materialise

FAN = 16
DIGITS = 3
BLOCK = FAN**DIGITS


def sha256(*columns):
    """H: the lowercase hexadecimal sha256 of the columns' text, one after another."""
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def field(column):
    """A value that no other value can be taken for: ``-`` if null, else bytes, colon, text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def document_hash(text):
    """H of ``doc_id, source, lang, n_chars`` and the column ``text``."""
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return sha256(*[field(c) for c in [*named, text]])


def placed(nodes, tree, order):
    """``nodes`` with ``place``: their number, from 0, within their ``tree`` by ``order``.

    ``tree`` and ``order`` name columns which together are a total order.  The rows are laid out in
    that order; a part needs only to know how many rows of its first tree stand in earlier
    parts, so a tree may hold any share of the rows, and there may be any number of trees.
    """
    laid = lay_out(nodes, [tree, *order])
    runs = laid.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("n"))
    edges = runs.groupBy("_part").agg(
        F.min(F.struct(tree)).alias("first"), F.max(F.struct(tree, "n")).alias("last")
    )
    asked = edges.select(F.col(f"first.{tree}").alias("tree"), "_part", F.lit(0).alias("n"), F.lit(0).alias("kind"))
    given = edges.select(F.col(f"last.{tree}").alias("tree"), "_part", "last.n", F.lit(1).alias("kind"))
    before = Window.partitionBy("tree").orderBy("_part", "kind")
    before = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        asked.unionByName(given)
        .withColumn("start", F.sum("n").over(before))
        .where("kind = 0")
        .select("_part", F.col("tree").alias("_first"), "start")
    )
    # One row per part: bounded by the number of shuffle partitions.
    inside = F.row_number().over(Window.partitionBy("_part", tree).orderBy(*order)) - 1
    continued = F.when(F.col(tree).eqNullSafe(F.col("_first")), F.col("start")).otherwise(0)
    return laid.join(F.broadcast(starts), "_part").select(
        *nodes.columns, (inside + continued).cast("long").alias("place")
    )


def _parents(rows, keys):
    """One parent struct per ``keys`` over the ``node`` structs of ``rows``, in their order.

    A tree whose only node is its first one is finished: that node has no parent hash, and
    its hash goes up as it is.  Any other run of nodes, also of one, is hashed.
    """
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("node")).alias("kids"))
    done = (F.size("kids") == 1) & (F.col("kids")[0]["place"] == 0)
    joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    return grouped.select(
        *keys,
        F.struct(
            F.floor(F.col("kids")[0]["place"] / FAN).alias("place"),
            F.when(done, F.col("kids")[0]["hash"]).otherwise(sha256(joined)).alias("hash"),
            done.alias("done"),
            "kids",
        ).alias("node"),
    )


def blocks_of(nodes, carried, name):
    """``tree, block, node``: the nested struct of each block of ``nodes(tree, place, hash)``.

    ``carried`` columns go along with the nodes.  The rows of a block are brought together once;
    every grouping of a digit then finds them in one task.
    """
    digits = [f"d{i}" for i in range(DIGITS - 1, 0, -1)]
    rows = nodes.select(
        "tree",
        F.expr(f"place div {BLOCK}").alias("block"),
        *[F.expr(f"place div {FAN ** int(d[1:])} % {FAN}").alias(d) for d in digits],
        F.struct("place", "hash", *carried).alias("node"),
    )
    rows = rows.repartition("tree", "block")
    for left in range(len(digits), -1, -1):
        rows = _parents(rows, ["tree", "block", *digits[:left]])
    return materialise(rows, name)


def rounds_of(nodes, carried, name):
    """The blocks of every round, from the leaves up to one block with one hash per tree."""
    found = [blocks_of(nodes, carried, name)]
    while (found[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = found[-1].select("tree", F.col("block").alias("place"), "node.hash")
        found.append(blocks_of(up, [], name))
    return found


def _step(position, done):
    """What stands left and right of the node at ``position`` of ``kids``; null if not hashed."""
    hashes = F.transform("kids", lambda k: k["hash"])
    return F.when(
        ~done,
        F.struct(
            F.array_join(F.slice(hashes, F.lit(1), position), "").alias("before"),
            F.array_join(F.slice(hashes, position + 2, F.lit(FAN)), "").alias("after"),
        ),
    )


def handed_down(blocks, upper, carried, passed):
    """``tree, place, hash, steps`` of the nodes in ``blocks``, with ``carried`` and ``passed``.

    ``upper(tree, place, steps)`` has the steps from each block to the root and the ``passed``
    columns.  Steps run from the node upwards.
    """
    kind = blocks.schema["node"].dataType
    below = blocks.select(
        "tree", "block", "node",
        *[F.lit(None).cast(upper.schema[c].dataType).alias(c) for c in ["steps", *passed]],
    )
    above = upper.select(
        "tree", F.col("place").alias("block"), F.lit(None).cast(kind).alias("node"), "steps", *passed
    )
    rows = below.unionByName(above).groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ["node", "steps", *passed]]
    )
    for _ in range(DIGITS):
        rows = rows.select("tree", "steps", *passed, "node.done", "node.kids")
        rows = rows.select("*", F.posexplode("kids").alias("pos", "node")).select(
            "tree",
            F.concat(F.array_compact(F.array(_step(F.col("pos"), F.col("done")))), "steps").alias("steps"),
            *passed,
            "node",
        )
    return rows.select(
        "tree", "node.place", "node.hash", "steps", *[f"node.{c}" for c in carried], *passed
    )


def _descend(rounds, upper, carried, passed):
    for i, blocks in reversed(list(enumerate(rounds))):
        upper = handed_down(blocks, upper, carried if i == 0 else [], passed)
    return upper


def proofs(leaves, order, carried=()):
    """``tree, hash, steps, subroot, root`` and the ``carried`` columns for each of ``leaves``.

    ``leaves`` have ``tree``, ``hash``, the columns ``order`` that set their order within a tree,
    and ``carried`` columns.  ``steps`` lead from the leaf to the root: each has the hashes
    ``before`` and ``after`` the node, joined; hashing them around the node's hash gives the next.
    Leaves that agree in all columns are leaves of their own.  No leaves give no rows.
    """
    carried = list(carried)
    numbered = leaves.withColumn("row", F.monotonically_increasing_id())
    nodes = placed(numbered, "tree", [*order, "hash", "row"])
    inner = rounds_of(nodes.select("tree", "place", "hash", *carried), carried, "merkle-leaves")
    tops = inner[-1].select(
        F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("node.hash").alias("hash")
    )
    outer = rounds_of(placed(tops, "tree", ["name"]), ["name"], "merkle-trees")
    head = outer[-1].select("tree", F.lit(0).cast("long").alias("place"), F.col("node.hash").alias("root"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    trees = _descend(outer, head.withColumn("steps", none), ["name"], ["root"])
    trees = trees.select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "steps",
        F.col("hash").alias("subroot"), "root",
    )
    return _descend(inner, trees, carried, ["subroot", "root"]).drop("place")


def folded(hash_, steps):
    """The root to which ``steps`` lead from a hash."""
    return F.aggregate(
        steps, hash_, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256)
    )


def manifest(docs, altered=None):
    """``doc_id, source, leaf, steps, subroot, root`` for each row of ``docs``.

    With a column ``altered`` (text as it may have been changed) there is also ``altered_leaf``,
    null where the text is as it was.
    """
    leaf = document_hash(F.col("text"))
    columns = [F.col("source").alias("tree"), "doc_id", leaf.alias("hash")]
    if altered is not None:
        changed = ~altered.eqNullSafe(F.col("text"))
        columns.append(F.when(changed, document_hash(altered)).alias("altered_leaf"))
    carried = ["doc_id", *(["altered_leaf"] if altered is not None else [])]
    return proofs(docs.select(*columns), ["doc_id"], carried).select(
        *carried, F.col("tree").alias("source"), F.col("hash").alias("leaf"), "steps", "subroot", "root"
    )


def tampered_text():
    """The text with A-Z lower-cased where 5 divides the crc32 of the decimal id, else as it is."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, ascii_lower(F.col("text"))).otherwise(F.col("text"))


def query(docs):
    """One row per row of ``docs``: its leaf, its proof's digest, and whether its proof still holds.

    Nulls of any column have a hash form of their own; null sources are one source, before
    all others.  A null id stands before all ids and is not tampered with.  Empty and very long
    texts are hashed whole.  Rows that share an id stand in the order of their hashes, and equal
    rows are leaves of their own with proofs of their own.  No rows give no rows.  Columns other
    than the five of a leaf are not looked at, whatever their names.
    """
    proven = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), tampered_text())
    siblings = F.transform("steps", lambda s: F.concat(s["before"], s["after"]))
    proven = proven.select(
        "doc_id", "leaf", "subroot", "root",
        sha256(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.coalesce("altered_leaf", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(
    _FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
# translate() in DuckDB takes the same two lists of letters.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda d: ord(d)::BIGINT)), lambda c, d: list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"""

SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source AS tree, {_LEAF.format(text="text")} AS leaf,
        CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(text=_LOWER)} ELSE {_LEAF.format(text="text")} END AS altered
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
        count(*) OVER (PARTITION BY tree) AS n
    FROM docs
), inner_nodes AS (
    SELECT tree, 0 AS level, place, leaf AS hash, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // {FAN}, sha256(string_agg(hash, '' ORDER BY place)), (n + {FAN - 1}) // {FAN}
    FROM inner_nodes WHERE n > 1 GROUP BY tree, level, place // {FAN}, n
), tops AS (
    SELECT tree, hash, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM inner_nodes WHERE n = 1
), outer_nodes AS (
    SELECT 0 AS level, place, hash, n FROM tops
    UNION ALL
    SELECT level + 1, place // {FAN}, sha256(string_agg(hash, '' ORDER BY place)), (n + {FAN - 1}) // {FAN}
    FROM outer_nodes WHERE n > 1 GROUP BY level, place // {FAN}, n
), inner_steps AS (
    SELECT a.tree, a.level, a.place, any_value(a.hash) AS hash,
        coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
        coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
    FROM inner_nodes a JOIN inner_nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level
        AND a.place // {FAN} = b.place // {FAN}
    WHERE a.n > 1 GROUP BY a.tree, a.level, a.place
), outer_steps AS (
    SELECT a.level, a.place,
        coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
        coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
    FROM outer_nodes a JOIN outer_nodes b ON a.level = b.level AND a.place // {FAN} = b.place // {FAN}
    WHERE a.n > 1 GROUP BY a.level, a.place
), walk AS (
    SELECT doc_id, tree, leaf, 0 AS level, place, false AS up, altered AS hash, '' AS seen FROM leaves
    UNION ALL
    SELECT doc_id, tree, leaf, level, place, up, hash, seen FROM (
        SELECT w.doc_id, w.tree, w.leaf, w.level + 1 AS level, w.place // {FAN} AS place, false AS up,
            sha256(s.before || w.hash || s.after) AS hash, w.seen || s.before || s.after AS seen
        FROM walk w JOIN inner_steps s
            ON w.tree IS NOT DISTINCT FROM s.tree AND w.level = s.level AND w.place = s.place
        WHERE NOT w.up
        UNION ALL
        SELECT w.doc_id, w.tree, w.leaf, 0, t.place, true, w.hash, w.seen
        FROM walk w JOIN tops t ON w.tree IS NOT DISTINCT FROM t.tree
        WHERE NOT w.up AND NOT EXISTS (SELECT 1 FROM inner_steps s
            WHERE w.tree IS NOT DISTINCT FROM s.tree AND w.level = s.level AND w.place = s.place)
        UNION ALL
        SELECT w.doc_id, w.tree, w.leaf, w.level + 1, w.place // {FAN}, true,
            sha256(s.before || w.hash || s.after), w.seen || s.before || s.after
        FROM walk w JOIN outer_steps s ON w.level = s.level AND w.place = s.place WHERE w.up
    )
), final AS (
    SELECT * FROM walk WHERE up AND level = (SELECT max(level) FROM outer_nodes)
)
SELECT f.doc_id, f.leaf, t.hash AS subroot, r.hash AS root, sha256(f.seen) AS proof_sha256,
    f.hash AS folded_root, f.hash = r.hash AS verified
FROM final f JOIN tops t ON f.tree IS NOT DISTINCT FROM t.tree
CROSS JOIN (SELECT hash FROM outer_nodes WHERE n = 1) r
"""
