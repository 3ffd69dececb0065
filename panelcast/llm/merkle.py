"""Merkle manifest of a dataset: a hash tree for each group of rows, one over the groups, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, attach, cut

#: Children of a block: its levels are hashed within one row of an array, so no array is longer.
BLOCK = 256
#: A level's runs have at most this many nodes.
FANS = range(2, 17)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: doc_ids whose CRC-32 this divides are proved as if n_chars were one more.
TAMPER_EVERY = 7


def digest_of(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, `-` where null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]), 256)


def parents(digests: Column, fan: int) -> Column:
    """The next level: every fan consecutive digests, the last run maybe fewer, become their hash."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / fan).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * fan + 1, F.lit(fan)), ""), 256))


def block_levels(fan: int) -> int:
    """Levels that a block of at most BLOCK children has."""
    n = 1
    while fan ** (n + 1) <= BLOCK:
        n += 1
    return n


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str, known: DataFrame | None = None) -> DataFrame:
    """rows with at, the place in its group from 0 in the order given (nulls first), n, the group's size, and what known has of the group.

    Rows are dealt by ranges of (group, order), numbered within a range and moved on by the sizes of the ranges before, so that a
    group of any size is spread over tasks. rows must be stored: equal ones are told apart by their place in storage.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by, "_tie").withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part", group).orderBy(*by[1:], "_tie")
    dealt = scratch.table(dealt.withColumn("_own", F.row_number().over(own) - 1), name)
    sizes = dealt.groupBy("_part", group).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    more = []
    if known is not None:
        more = [c for c in known.columns if c != group]
        sizes = sizes.join(known, F.col("_g").eqNullSafe(known[group])).drop(known[group])
    met = dealt.join(sizes, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*rows.columns, (F.col("_own") + F.col("_before")).alias("at"), "n", *more)


def level_size(n: Column, power: Column) -> Column:
    """Nodes of a level whose nodes stand for power leaves each, of n leaves."""
    return F.floor((n + power - 1) / power).cast("long")


class Forest:
    """The node tables of trees over stored leaves (tree long, at long, n long, digest), and proofs from them.

    Nodes are made in rounds of several levels: a block of at most BLOCK neighbours is one row of a shuffle and hashed up to its
    root, and the block roots are the next round's leaves. A proof is looked up the same way, so that a row asks for the siblings in
    its own block only and takes the rest from its block's root: no node is wanted by more than BLOCK rows.
    """

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str, fan: int = 2):
        if fan not in FANS:
            raise ValueError(f"fan is {fan}, not within {FANS.start} and {FANS.stop - 1}")
        self.fan, self.step = fan, block_levels(fan)
        self.rounds: list[DataFrame] = []
        self.nodes: list[DataFrame] = []
        now = leaves.select("tree", "at", "n", "digest")
        most = now.agg(F.max("n")).first()[0] or 0
        while True:
            self.rounds.append(now)
            if most <= 1:
                break
            made = scratch.table(self._climb(now), f"{name}-{len(self.nodes)}")
            self.nodes.append(made)
            now = made.where(F.col("level") == self.step).select("tree", "at", level_size(F.col("n"), F.lit(self.fan**self.step)).alias("n"), "digest")
            # a tree whose root is below this round's last level ends in its own round
            ended = made.where((F.col("level") < self.step) & (F.col("size") == 1)).select("tree", "at", F.lit(1).cast("long").alias("n"), "digest")
            now = now.unionByName(ended)
            most = -(-most // self.fan**self.step)

    def _climb(self, leaves: DataFrame) -> DataFrame:
        """tree, level, at, n (the round's leaves), size (the level's), digest: all nodes of a round, its leaves as level 0."""
        width = self.fan**self.step
        blocks = leaves.withColumn("_b", F.floor(F.col("at") / width)).groupBy("tree", "_b", "n").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("_v"))
        start = F.struct(F.col("_v.digest").alias("now"), F.array(F.col("_v.digest")).alias("all"))

        def rise(acc: Column, _: Column) -> Column:
            return F.transform(F.array(parents(acc["now"], self.fan)), lambda up: F.struct(up.alias("now"), F.concat(acc["all"], F.array(up)).alias("all")))[0]

        levels = F.aggregate(F.sequence(F.lit(1), F.lit(self.step)), start, rise, lambda acc: acc["all"])
        power = F.element_at(self._powers(), F.col("level") + 1)
        rows = blocks.select("tree", "n", "_b", F.posexplode(levels).alias("level", "_all"))
        rows = rows.withColumn("size", level_size(F.col("n"), power)).where((F.col("level") == 0) | (level_size(F.col("n"), F.element_at(self._powers(), F.greatest(F.col("level"), F.lit(1)))) > 1))
        rows = rows.select("tree", "n", "_b", "level", "size", F.posexplode("_all").alias("_i", "digest"))
        first = F.col("_b") * F.element_at(self._powers(), self.step - F.col("level") + 1)
        return rows.select("tree", "level", (first + F.col("_i")).alias("at"), "n", "size", "digest")

    def _powers(self) -> Column:
        return F.array(*[F.lit(self.fan**i).cast("long") for i in range(self.step + 1)])

    def roots(self) -> DataFrame:
        """tree, root: what remains of each tree; a lone leaf is its own."""
        return self.rounds[-1].select("tree", F.col("digest").alias("root"))

    def proofs(self, first: int = 0) -> DataFrame:
        """tree, at, proof of the leaves of a round: a struct (left, right) for each level up to the root, the run's siblings before and after it joined."""
        empty = F.array().cast("array<struct<left:string,right:string>>")
        proof = self.rounds[-1].select("tree", "at", empty.alias("proof"))
        for leaves, nodes in list(zip(self.rounds[:-1], self.nodes, strict=True))[first:][::-1]:
            own = self._segment(leaves, nodes)
            proof = own.join(self._above(proof), ["tree", "_b"]).select("tree", "at", F.concat("_own", "_above").alias("proof"))
        return proof

    def _above(self, proof: DataFrame) -> DataFrame:
        return proof.select("tree", F.col("at").alias("_b"), F.col("proof").alias("_above"))

    def proved(self, leaves: DataFrame, altered: Column) -> DataFrame:
        """leaves (tree, at, digest and more) with proof_text, the joined siblings, and now, the root that altered folds to.

        What a leaf's own block gives is folded before the rest is joined, so that no whole proof is shuffled for a leaf.
        """
        if not self.nodes:
            return leaves.select("*", F.lit("").alias("proof_text"), altered.alias("now"))
        own = self._segment(self.rounds[0], self.nodes[0]).join(leaves, ["tree", "at"])
        own = own.select(*leaves.columns, "_b", joined(F.col("_own")).alias("_text"), folded(altered, F.col("_own")).alias("_now"))
        rows = own.join(self._above(self.proofs(1)), ["tree", "_b"])
        return rows.select(*leaves.columns, F.concat("_text", joined(F.col("_above"))).alias("proof_text"), folded(F.col("_now"), F.col("_above")).alias("now"))

    def _segment(self, leaves: DataFrame, nodes: DataFrame) -> DataFrame:
        """tree, at, _own: the part of the proofs that lies in a round.

        Each leaf's coordinates (level, at) of required siblings follow from its place and its tree's size; they are joined to the
        nodes and ordered. A level without siblings has an empty struct.
        """
        fan, powers = self.fan, self._powers()
        size = lambda level: level_size(F.col("n"), F.element_at(powers, level + 1))
        levels = F.filter(F.sequence(F.lit(0), F.lit(self.step - 1)), lambda i: size(i) > 1)

        def siblings(i: Column) -> Column:
            own = F.floor(F.col("at") / F.element_at(powers, i + 1))
            first = F.floor(own / fan) * fan
            others = F.filter(F.sequence(first, F.least(first + fan - 1, size(i) - 1)), lambda x: x != own)
            return F.transform(others, lambda x: F.struct(i.alias("level"), x.alias("sib"), (x < own).alias("before")))

        asked = leaves.select("tree", "at", levels.alias("_levels"), F.explode_outer(F.flatten(F.transform(levels, siblings))).alias("_q"))
        asked = asked.select("tree", "at", "_levels", "_q.level", "_q.sib", "_q.before")
        known = nodes.where(F.col("level") < self.step).select("tree", "level", F.col("at").alias("sib"), "digest")
        met = asked.join(known, ["tree", "level", "sib"], "left")
        found = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "sib", "before", "digest"))))
        rows = met.groupBy("tree", "at").agg(F.first("_levels").alias("_levels"), found.alias("_f"))
        side = lambda i, before: F.array_join(F.transform(F.filter("_f", lambda s: (s["level"] == i) & (s["before"] == before)), lambda s: s["digest"]), "")
        return rows.select("tree", "at", F.transform("_levels", lambda i: F.struct(side(i, F.lit(True)).alias("left"), side(i, F.lit(False)).alias("right"))).alias("_own"), F.floor(F.col("at") / fan**self.step).alias("_b"))


def joined(proof: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof."""
    return F.aggregate(proof, leaf, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def manifest(docs: DataFrame, fan: int = 2, group: str = "lang", tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs.

    A leaf is the hash of doc_id, source, lang, n_chars and text. Leaves of a group ascend by doc_id (null first, ties by digest) and
    make a tree with runs of fan nodes; the groups' roots, ordered by group (null first, by bytes), make the tree over them. A proof
    is the siblings from leaf to root. Where tamper_every divides the CRC-32 of doc_id (a null one has none), the leaf that is folded
    again has one more in n_chars (a null one stays, and then verifies). Repeated rows are leaves each. Other columns are ignored,
    whatever their names; a table without rows gives none. Texts are hashed once, where they are read; only digests are shuffled.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        values = {c: F.col(c) for c in FIELDS}
        altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0, digest_of(list((values | {"n_chars": F.col("n_chars") + 1}).values())))
        leaves = scratch.table(docs.select("doc_id", F.col(group).alias("_group"), digest_of(list(values.values())).alias("digest"), altered.alias("_altered")), "leaves")
        groups = scratch.table(leaves.groupBy("_group").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0)), "groups")
        groups = scratch.table(numbered(groups.drop("n"), "_all", ["_group"], scratch, "ranked").select("_group", F.col("at").alias("tree"), F.col("n").alias("_trees")), "trees")
        placed = scratch.table(numbered(leaves, "_group", ["doc_id", "digest"], scratch, "dealt", groups).drop("_group"), "placed")
        forest = Forest(placed, scratch, "nodes", fan)
        subroots = scratch.table(forest.roots().join(placed.where("at = 0").select("tree", "n", "_trees"), "tree"), "subroots")
        top = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("_trees").alias("n"), F.col("root").alias("digest")), scratch, "top", fan)
        above = top.proofs().join(top.roots(), "tree").select(F.col("at").alias("tree"), F.col("proof").alias("_above"), "root")
        above = scratch.table(above.join(subroots.select("tree", "n", F.col("root").alias("subroot")), "tree"), "above")
        rows = forest.proved(placed.drop("n", "_trees"), F.coalesce("_altered", "digest"))
        rows = attach(rows, above, "tree", placed.count(), F.xxhash64("at"))
        out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat("proof_text", joined(F.col("_above"))), 256).alias("proof_sha256"), folded(F.col("now"), F.col("_above")).alias("folded_root"))
        return cut(out.withColumn("verified", F.col("folded_root") == F.col("root")))


#: The same in DuckDB's SQL, level by level. CRC-32 is by its rule: eight halvings a byte.
MANIFEST_SQL = """
WITH RECURSIVE tab(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM tab WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
docs AS (SELECT doc_id, lang, n_chars, text, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT])), 4294967295::UBIGINT) AS crc
  FROM documents, crcs),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS altered FROM docs),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (SELECT doc_id, leaf, altered, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed JOIN trees ON hashed.lang IS NOT DISTINCT FROM trees.lang),
nodes(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS (SELECT tree, digest AS subroot, level AS depth FROM nodes WHERE n = 1),
tops(level, pos, digest, n) AS (
  SELECT 0, tree - 1, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
whole AS (SELECT digest AS root, level AS height FROM tops WHERE n = 1),
walk(tree, start, doc_id, leaf, proof, now, level) AS (
  SELECT tree, pos, doc_id, leaf, '', coalesce(altered, leaf), 0 FROM leaves
  UNION ALL
  SELECT w.tree, w.start, w.doc_id, w.leaf, w.proof || coalesce(s.digest, ''), sha256(CASE WHEN p % 2 = 1 THEN s.digest || w.now ELSE w.now || coalesce(s.digest, '') END), w.level + 1
  FROM (SELECT walk.*, depth, CASE WHEN level < depth THEN start // (1::BIGINT << level) ELSE (walk.tree - 1) // (1::BIGINT << (level - depth)) END AS p FROM walk JOIN subroots USING (tree), whole WHERE level < depth + height) w
  LEFT JOIN (SELECT tree, level, pos, digest, 0 AS upper FROM nodes UNION ALL SELECT 0, level, pos, digest, 1 FROM tops) s
    ON s.upper = (w.level >= depth)::INT AND s.tree = CASE WHEN w.level < depth THEN w.tree ELSE 0 END AND s.level = CASE WHEN w.level < depth THEN w.level ELSE w.level - depth END AND s.pos = xor(p, 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM walk JOIN subroots USING (tree), whole WHERE level = depth + height
"""
