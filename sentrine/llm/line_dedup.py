"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line is cut into ``edits + 1`` segments. If two lines are within ``edits`` edits, one segment of the shorter
stands unchanged in the longer, near its own place; so lines are joined on (length, segment number, segment), the
longer probing each length it can reach. Where many lines share a segment, they are cut finer. What meets is verified
with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrine.operators.components import connected_components
from sentrine.storage import drop, materialize, release


FEW = 500_000  # line ids, of 16 bytes, that may be broadcast; beyond that the lines are shuffled
MANY = 32  # lines that share a segment and are still tried pairwise
BLOCKS = 16  # finer cuts of a line


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by bisection over substring comparisons."""
    most = F.least(F.char_length(a), F.char_length(b))
    start = F.struct(F.lit(0).alias("lo"), most.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + F.lit(2))).cast("int"))
    return F.aggregate(steps, start, lambda s, i: F.when(s["lo"] < s["hi"], halve(s, i)).otherwise(s), lambda s: s["lo"])


def edit_within(a: Column, b: Column, k: int) -> Column:
    """True if strings ``a`` and ``b``, whose lengths differ by k at most, are at most ``k`` edits apart.

    What both begin with is skipped. Then the 2k+2 cells around the diagonal are one small integer per column,
    updated by Myers' bit operations; the distance is followed down the lower edge of the band and then along the
    last row, and no more is computed once it is out of reach.
    """
    width = 2 * k + 2
    full = (1 << width) - 1
    one = F.array(F.struct(a.alias("a"), b.alias("b"), (_common_prefix(a, b) + 1).alias("at")))
    tail = "\u0001" * (k + 1)  # the same end on both sides changes no distance and makes both longer than k

    def rest(t: Column, name: str) -> Column:
        return F.split(F.concat(t[name].substr(t["at"], F.char_length(t[name])), F.lit(tail)), "")

    def bit(on: Column) -> Column:
        return F.when(on, 1).otherwise(0)

    def bound(value: Column, then) -> Column:
        """``then`` of a value that is computed once."""
        return F.transform(F.array(value), then)[0]

    def inverse(x: Column) -> Column:
        return F.lit(full).bitwiseXOR(x)

    def distance(t: Column) -> Column:
        pattern, text, m, n = t["p"], t["t"], t["m"], t["n"]

        def step(s: Column, j: Column) -> Column:  # j: column, from 0
            match = F.lit(0)
            for i in range(width):
                at = j + (k + 1 - width + i)
                match = match + bit(F.get(pattern, at) == F.get(text, j)) * (1 << i)
            vp, vn = s["vp"], s["vn"]

            def deltas(x: Column) -> Column:
                return ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def move(d: Column) -> Column:
                return bound(F.struct(d.alias("d"), vn.bitwiseOR(inverse(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn")), update)

            def update(u: Column) -> Column:
                down = F.shiftright(u["d"], 1)
                edge = bit(u["d"].bitwiseAND(F.lit(1 << (width - 1))) == 0)
                last = bit(u["hp"].bitwiseAND(s["row"]) != 0) - bit(u["hn"].bitwiseAND(s["row"]) != 0)
                return F.struct(
                    u["hn"].bitwiseOR(inverse(down.bitwiseOR(u["hp"]))).alias("vp"),
                    down.bitwiseAND(u["hp"]).alias("vn"),
                    (s["dist"] + F.when(j < m - k, edge).otherwise(last)).alias("dist"),
                    F.when(j < m - k, s["row"]).otherwise(F.shiftright(s["row"], 1)).alias("row"),
                )

            return F.when(s["dist"] > 2 * k + n - m, s).otherwise(bound(match, lambda x: bound(deltas(x), move)))

        start = F.struct(
            F.lit(full & ~((1 << (width - k - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("dist"), F.lit(1 << (width - 2)).alias("row")
        )
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["dist"] <= k)

    cut = F.transform(one, lambda t: F.struct(rest(t, "a").alias("p"), rest(t, "b").alias("t")))
    cut = F.transform(cut, lambda t: F.struct(t["p"].alias("p"), t["t"].alias("t"), F.size(t["p"]).alias("m"), F.size(t["t"]).alias("n")))
    return F.transform(cut, distance)[0]


def _keys(edits: int) -> Column:
    """The join keys of a line as an array of structs: its own segments, and where shorter partners' may stand."""
    out, length = [], F.char_length("line")
    for less in range(edits + 1):
        n = length - less
        for i in range(edits + 1):
            begin = F.floor(n * i / (edits + 1)).cast("int")
            size = F.floor(n * (i + 1) / (edits + 1)).cast("int") - begin
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                own = less == 0 and shift == 0
                out.append(F.struct(F.xxhash64(n, F.lit(i), F.substring(F.col("line"), begin + shift + 1, size)).alias("key"), F.lit(own).alias("own")))
    return F.array(*out)


def _fine_keys() -> Column:
    """For one edit: a line without one of ``BLOCKS`` blocks, and without such a block of a shorter partner and one character more."""
    out, length = [], F.char_length("line")
    for less in (0, 1):
        n = length - less
        for i in range(BLOCKS):
            begin, end = F.floor(n * i / BLOCKS).cast("int"), F.floor(n * (i + 1) / BLOCKS).cast("int") + less
            left, right = F.substring(F.col("line"), F.lit(1), begin), F.substring(F.col("line"), end + 1, length)
            out.append(F.struct(F.xxhash64(n, F.lit(i), left, right).alias("key"), F.lit(less == 0).alias("own")))
    return F.array(*out)


def _lines(docs: DataFrame) -> DataFrame:
    """The lines of all texts that are not blank. Rows that repeat a doc_id with other texts are told apart by a hash of the text."""
    every = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("sig"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return every.where(F.trim("line") != "").withColumn("id", F.unhex(F.md5("line")))


def _meeting(keys: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of lines that share a key, which one of them owns."""
    left, right = keys.where("own").select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"), F.col("own").alias("own_b"))
    return left.join(right, "key").where((F.col("a") != F.col("b")) & (~F.col("own_b") | (F.col("a") < F.col("b")))).select("a", "b").distinct()


def line_classes(docs: DataFrame, edits: int = 1, near_chars: int = 16) -> DataFrame:
    """``id`` (md5 of the line), ``n`` occurrences, ``class_id`` and the class's first occurrence ``first_doc, first_sig, first_pos``.

    A segment that more than ``MANY`` lines share gives no pairs for one edit: these lines are joined again without
    one of ``BLOCKS`` blocks each, where two lines within one edit meet all the same and few others do.
    """
    lines = _lines(docs)
    ids = materialize(lines.groupBy("id").agg(F.min(F.struct("doc_id", "sig", "pos")).alias("first"), F.count("*").alias("n")))
    long_ = lines.where(F.char_length("line") >= max(near_chars, 2 * edits + 2))

    def texts(wanted: DataFrame) -> DataFrame:
        few = wanted.count() <= FEW
        # a line is fetched where it first stands, so that a line of many documents is no hot key
        placed = ids.join(F.broadcast(wanted) if few else wanted, "id").select("id", "first.doc_id", "first.sig", "first.pos")
        text = long_.join(F.broadcast(placed) if few else placed, ["id", "doc_id", "sig", "pos"]).select("id", "line")
        return materialize(text.dropDuplicates(["id"]))

    keys = long_.select("id", F.explode(_keys(edits)).alias("k")).select("id", "k.key", "k.own").distinct()
    keys = materialize(keys)
    meet = materialize(keys.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("o")).where("c > 1 and o").select("key", "c"))
    keys2 = materialize(keys.join(meet, "key"))
    drop(keys, meet)
    release(docs.sparkSession)
    old = [keys2]
    if edits == 1:
        pairs = _meeting(keys2.where(F.col("c") <= MANY))
        crowd = materialize(keys2.where(F.col("c") > MANY).select("id").distinct())
        crowded = texts(crowd)
        fine = materialize(crowded.select("id", F.explode(_fine_keys()).alias("k")).select("id", "k.key", "k.own"))
        pairs = pairs.union(_meeting(fine)).distinct()
        old += [crowd, crowded, fine]
    else:
        pairs = _meeting(keys2)
    pairs = materialize(pairs)
    drop(*old)
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    text = texts(wanted)
    both = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    links = materialize(both.where(edit_within(F.col("la"), F.col("lb"), edits)).select("a", "b"))
    comp = connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("class_id"))
    tagged = materialize(ids.join(comp, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")))
    drop(pairs, wanted, text, links, ids)
    release(docs.sparkSession)
    firsts = tagged.groupBy("class_id").agg(F.min("first").alias("f"))
    return tagged.join(firsts, "class_id").select("id", "n", "class_id", F.col("f.doc_id").alias("first_doc"), F.col("f.sig").alias("first_sig"), F.col("f.pos").alias("first_pos"))


def dedup_lines(docs: DataFrame, edits: int = 1, near_chars: int = 16, keep_whole: bool = True) -> DataFrame:
    """``docs`` with ``text`` rid of lines seen before, and ``n_lines, n_removed`` added.

    Lines within ``edits`` edits of each other, and chains of such lines, are one class; lines of fewer than
    ``near_chars`` characters are one class only if equal. Of each class the first occurrence (smallest doc_id, then
    line number) stays in the corpus. Blank lines are never touched. A document that would lose every line keeps
    its text (op7's SQL says so), unless ``keep_whole`` is false: then only its blank lines stay, so that no line
    seen before is left in the corpus. Rows without doc_id or text stay as they are and count
    0 lines. Rows that repeat a doc_id with the same text keep the same lines; with different texts they are judged
    one after the other, in the order of a hash of the text. No rows give no rows. The columns of ``docs`` all come
    back, whatever their names (only columns named n_lines or n_removed are replaced).
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = line_classes(typed, edits, near_chars).select("first_doc", "first_sig", "first_pos").distinct()
    kept = first.groupBy("first_doc", "first_sig").agg(F.array_sort(F.collect_list("first_pos")).alias("kept"))
    text = F.col("row.text").cast("string")
    given = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("sig"))
    joined = given.join(kept, (F.col("doc") == F.col("first_doc")) & (F.col("sig") == F.col("first_sig")), "left")

    def rebuilt(parts: Column) -> Column:
        """Of one text's lines, bound once: how many are not blank, and the text of those that stay."""
        blank = F.filter(F.transform(parts, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
        stay = F.transform(F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank)), lambda i: F.get(parts, i))
        return F.struct((F.size(parts) - F.size(blank)).alias("lines"), F.array_join(stay, "\n").alias("text"))

    made = joined.withColumn("made", F.transform(F.array(F.split(text, "\n", -1)), rebuilt)[0])
    known = F.col("doc").isNotNull() & text.isNotNull()
    lines = F.when(known, F.col("made.lines")).otherwise(0)
    left = F.when(known, F.coalesce(F.size("kept"), F.lit(0))).otherwise(0)
    some = known & (left < lines) & ((left > 0) | F.lit(not keep_whole))
    new = {"n_lines": lines.cast("long"), "n_removed": F.when(some, lines - left).otherwise(0).cast("long"), "text": F.when(some, F.col("made.text")).otherwise(F.col("row.text"))}
    names = [*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in docs.columns]]
    return made.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` without lines seen before: counts of lines and a digest of each text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP7_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)) t),
d AS (SELECT line, md5(line) AS id, length(line) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
h AS (SELECT id, line, n, n AS len, 0 AS side, left(line, n // 2) AS seg FROM d WHERE n >= 16
  UNION ALL SELECT id, line, n, n, 1, right(line, n - n // 2) FROM d WHERE n >= 16
  UNION ALL SELECT id, line, n, n - 1, 0, left(line, (n - 1) // 2) FROM d WHERE n >= 16
  UNION ALL SELECT id, line, n, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM d WHERE n >= 16),
p AS (SELECT DISTINCT a.id AS x, b.id AS y, a.line AS lx, b.line AS ly FROM h a JOIN h b
  ON a.len = b.len AND a.side = b.side AND a.seg = b.seg AND a.id < b.id AND abs(a.n - b.n) <= 1),
e AS (SELECT x, y FROM p WHERE levenshtein(lx, ly) <= 1 UNION SELECT y, x FROM p WHERE levenshtein(lx, ly) <= 1),
r(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
o AS (SELECT l.doc_id, l.pos, l.line, trim(l.line, ' ') = '' AS blank, coalesce(c.root, md5(l.line)) AS cls FROM l LEFT JOIN c ON c.node = md5(l.line)),
k AS (SELECT *, blank OR row_number() OVER (PARTITION BY cls, blank ORDER BY doc_id, pos) = 1 AS keep FROM o),
t AS (SELECT doc_id, count(*) FILTER (WHERE NOT blank) AS n, count(*) FILTER (WHERE NOT blank AND keep) AS kept,
  string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep) AS txt FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN t.kept > 0 AND t.kept < t.n THEN t.n - t.kept ELSE 0 END AS BIGINT) AS n_removed,
  md5(CASE WHEN t.kept > 0 AND t.kept < t.n THEN t.txt ELSE d.text END) AS text_md5
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
