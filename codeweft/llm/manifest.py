"""Merkle manifest of a dataset, by SQL functions alone.

Every row is a leaf; the leaves of a source stand by doc_id, every ARITY neighbours
become one node, level by level, and the sources' roots become the root in the same
way. Leaves are ranked by range partitions (counts of partitions, never one window over
a source), put into arrays of at most BLOCK neighbours, and each array is collapsed by
``aggregate`` over levels and ``transform`` over slices; block roots are the next
round's leaves. Coming back, each block hands its rows the siblings above it.

Defined cases: a null value is ``-``; an empty text is a value of 0 bytes; long texts
are hashed whole; rows of one source and doc_id stand by leaf, so repeated rows are
leaves of their own; null doc_ids come first and are never tampered with; an empty
table has no leaves, so no rows; other columns are ignored; all rows of one
source, however many, are dealt to tasks by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.text import LOWER, UPPER
from codeweft.sources.scratch import Workspace

ARITY = 16
#: Levels that one array collapses; a block holds ARITY ** LEVELS nodes at most.
LEVELS = 2
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, ``text`` in place of its own if given."""
    parts = [field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]
    return F.sha2(F.concat(*parts), 256)


def folded(nodes: Column) -> Column:
    """The next level: every ARITY consecutive digests as one."""
    count = F.ceil(F.size(nodes) / F.lit(ARITY)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256)
    )


def ranked(nodes: DataFrame, order: list[str], ws: Workspace) -> DataFrame:
    """``nodes`` with ``pos``, their place from 0 in their ``group`` by ``order``, and ``n``, the group's size."""
    dealt = nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    at = F.monotonically_increasing_id()
    dealt = ws.put(dealt.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    parts = dealt.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min("nth").alias("low"))
    earlier = F.expr("coalesce(sum(rows) over (partition by group order by part rows between unbounded preceding and 1 preceding), 0)")
    shifts = parts.select("group", "part", (earlier - F.col("low")).alias("shift"), F.expr("sum(rows) over (partition by group)").alias("n"))
    return dealt.join(shifts, ["group", "part"]).withColumn("pos", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def collapsed(nodes: DataFrame, ws: Workspace, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Rounds over ``nodes(group, pos, n, digest, *carry)`` until each group is one node; and ``(group, digest)`` of those.

    A round is a table ``group, block, n, levels, rows``, one row for each array; ``rows`` holds what the nodes carry.
    """
    rounds: list[DataFrame] = []
    done: DataFrame | None = None
    while True:
        member = F.struct("pos", "digest", *carry)
        blocks = nodes.groupBy("group", F.expr(f"pos div {BLOCK}").alias("block")).agg(
            F.array_sort(F.collect_list(member)).alias("rows"), F.first("n").alias("n")
        )
        # a whole group that fits one block stops at its root; any other block takes all LEVELS
        height = F.when(F.col("n") > BLOCK, LEVELS).otherwise(sum(((F.col("n") > ARITY**k).cast("int") for k in range(LEVELS)), F.lit(0)))
        levels = F.aggregate(
            F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), height),
            F.array(F.col("rows.digest")),
            lambda done, _: F.concat(done, F.array(folded(F.element_at(done, -1)))),
        )
        carried = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in carry])) if carry else F.lit(None).cast("array<string>")
        written = ws.put(blocks.select("group", "block", "n", levels.alias("levels"), carried.alias("rows")))
        rounds.append(written)
        top = F.element_at(F.element_at("levels", -1), 1).alias("digest")
        ended = written.where(F.col("n") <= BLOCK).select("group", top)
        done = ended if done is None else done.union(ended)
        rest = written.where(F.col("n") > BLOCK)
        if rest.isEmpty():
            return rounds, done
        nodes = rest.select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), top)
        carry = []


def _path(index: Column, above: Column) -> Column:
    """Siblings of the node at ``index`` of a block, level by level, and then those ``above``."""
    inner = F.slice(F.col("levels"), F.lit(1), F.size("levels") - 1)

    def step(nodes: Column, k: Column) -> Column:
        at = F.floor(index / F.pow(F.lit(ARITY), k)).cast("int")
        place = F.pmod(at, F.lit(ARITY))
        left = F.array_join(F.slice(nodes, at - place + 1, place), "")
        right = F.array_join(F.slice(nodes, at + 2, F.lit(ARITY - 1) - place), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.concat(F.transform(inner, step), above)


def _descend(rounds: list[DataFrame], tops: DataFrame, ws: Workspace) -> DataFrame:
    """``(group, block, above, *)`` for the blocks of the first round, from ``tops(group, above, *)``, what stands above each group."""
    extra = [c for c in tops.columns if c not in ("group", "above")]
    paths = None
    for i in range(len(rounds) - 1, -1, -1):
        blocks = rounds[i].select("group", "block", "n", "levels")
        here = blocks.where(F.col("n") <= BLOCK).join(tops, "group").select("group", "block", "levels", "above", *extra)
        if paths is not None:
            here = here.union(blocks.where(F.col("n") > BLOCK).join(paths, ["group", "block"]).select("group", "block", "levels", "above", *extra))
        if i == 0:
            return here.select("group", "block", "above", *extra)
        nodes = F.element_at("levels", 1)
        members = F.transform(nodes, lambda _, j: F.struct((F.col("block") * BLOCK + j).alias("block"), _path(j, F.col("above")).alias("above")))
        paths = ws.put(here.select("group", *extra, F.inline(members)))
    raise AssertionError("a tree has at least one round")


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``tampered`` is the text found later, null where it is the row's own: roots and
    proofs are of the original rows, ``folded_root`` is what the row as found, with
    its proof, leads to, and ``verified`` whether that is the root.
    """
    ws = Workspace(documents.sparkSession, "manifest")
    # the null source's group is empty and stands before all others, which begin with a sign
    group = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("group")
    found = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))
    # rows equal in all else are told apart by a number, so that a range of them can be split
    tie = F.monotonically_increasing_id().alias("tie")
    leaves = ws.put(documents.select(group, "doc_id", leaf().alias("digest"), found.alias("found"), tie))
    carry = ["doc_id", "found"]
    nodes = ranked(leaves, ["doc_id", "digest", "tie"], ws).select("group", "pos", "n", "digest", *carry)
    rounds, subroots = collapsed(nodes, ws, carry)
    subroots = ws.put(subroots)
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("source"), "digest")
    sources, root = collapsed(ranked(named, ["source"], ws).select("group", "pos", "n", "digest", "source"), ws, ["source"])

    above = _descend(sources, root.select("group", F.array().cast(f"array<{_STEP}>").alias("above"), F.col("digest").alias("root")), ws)
    within = sources[0].join(above, ["group", "block"])
    each = F.transform(
        "rows",
        lambda r, j: F.struct(
            r["source"].alias("group"),
            F.element_at(F.element_at("levels", 1), j + 1).alias("subroot"),
            _path(j, F.col("above")).alias("above"),
        ),
    )
    tops = ws.put(within.select("root", F.inline(each)))

    blocks = rounds[0].join(_descend(rounds, tops, ws), ["group", "block"])
    lifted = F.transform(
        "rows",
        lambda r, j: F.struct(r.alias("row"), F.element_at(F.element_at("levels", 1), j + 1).alias("leaf"), _path(j, F.col("above")).alias("path")),
    )
    proof = lambda p: F.sha2(F.array_join(F.transform(p, lambda s: F.concat(s["left"], s["right"])), ""), 256)
    fold = lambda start, p: F.aggregate(p, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    ends = F.transform(
        lifted,
        lambda x: F.struct(
            x["row"]["doc_id"].alias("doc_id"),
            x["leaf"].alias("leaf"),
            proof(x["path"]).alias("proof_sha256"),
            fold(F.coalesce(x["row"]["found"], x["leaf"]), x["path"]).alias("folded_root"),
        ),
    )
    out = blocks.select("subroot", "root", F.inline(ends))
    verified = F.col("folded_root") == F.col("root")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified.alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, checked against rows of which every fifth, by the checksum of its id, has its text lower-cased."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, F.translate("text", UPPER, LOWER))
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered)


def _sql(levels: int = 8) -> str:
    """Levels unrolled: 16 ** 8 rows of a source, and as many sources."""
    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), "
        "lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295)"
    )
    field = lambda e: f"coalesce(CAST(strlen(CAST({e} AS VARCHAR)) AS VARCHAR) || ':' || CAST({e} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(t if c == "text" else c) for c in FIELDS) + ")"
    out = [
        f"docs AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN "
        f"{leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} END AS found FROM documents)",
        "l0 AS (SELECT doc_id, leaf, found, coalesce('+' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
        "leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM docs)",
    ]

    def climb(name: str, first: str) -> str:
        for k in range(levels):
            below = first if k == 0 else f"{name}{k}"
            out.append(
                f"{name}{k + 1} AS (SELECT g, pos // {ARITY} AS pos, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, "
                f"(max(n) + {ARITY - 1}) // {ARITY} AS n FROM {below} GROUP BY g, pos // {ARITY})"
            )
        return f"{name}{levels}"

    def steps(name: str, first: str) -> tuple[str, str, str]:
        """Joins to every level's siblings of a row at ``pos`` of ``g``; the proof's text; the fold's parts."""
        joins, proof, parts = [], [], []
        for k in range(levels):
            below = first if k == 0 else f"{name}{k}"
            out.append(
                f"{name}s{k} AS (SELECT g, pos, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY pos) OVER w1, '') END AS l, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY pos) OVER w2, '') END AS r FROM {below} "
                f"WINDOW w1 AS (PARTITION BY g, pos // {ARITY} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
                f"w2 AS (PARTITION BY g, pos // {ARITY} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
            )
            joins.append(f"JOIN {name}s{k} AS {name}j{k} ON {name}j{k}.g = {{g}} AND {name}j{k}.pos = {{pos}} // {ARITY**k}")
            proof.append(f"coalesce({name}j{k}.l || {name}j{k}.r, '')")
            parts.append(f"{name}j{k}")
        return " ".join(joins), " || ".join(proof), parts

    climb("l", "l0")
    out.append(
        f"t0 AS (SELECT '' AS g, g AS source, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM l{levels})"
    )
    climb("t", "t0")
    joins, proof, parts = steps("l", "l0")
    joins2, proof2, parts2 = steps("t", "t0")
    out.append(
        "joined AS (SELECT l0.doc_id, l0.leaf, t0.digest AS subroot, "
        f"(SELECT digest FROM t{levels}) AS root, sha256({proof} || {proof2}) AS proof_sha256, coalesce(l0.found, l0.leaf) AS f0, "
        + ", ".join(f"{p}.l AS left{i}, {p}.r AS right{i}" for i, p in enumerate([*parts, *parts2]))
        + f" FROM l0 {joins.format(g='l0.g', pos='l0.pos')} JOIN t0 ON t0.source = l0.g {joins2.format(g='t0.g', pos='t0.pos')})"
    )
    last = "joined"
    for i in range(2 * levels):
        out.append(f"f{i + 1} AS (SELECT *, CASE WHEN left{i} IS NULL THEN f{i} ELSE sha256(left{i} || f{i} || right{i}) END AS f{i + 1} FROM {last})")
        last = f"f{i + 1}"
    return (
        "WITH " + ", ".join(out) + f" SELECT doc_id, leaf, subroot, root, proof_sha256, f{2 * levels} AS folded_root, f{2 * levels} = root AS verified FROM {last}"
    )


OP13_SQL = _sql()
