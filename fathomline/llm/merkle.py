"""Document fingerprints as Merkle trees over sections, paragraphs and their clauses, in SQL functions alone.

A text is cut at blank lines into sections, at line ends into paragraphs and these after marks and words that end in
certain letters into clauses of a few words, so that what a cut depends on stands next to it and an edit moves no other
cut. The cuts lose nothing: equal roots mean equal texts. Every branch is hashed from the hashes below it. A
fingerprint is the whole hash of the root and a short one of every other node, in the tree's shape; two fingerprints
are compared from the root down, and only where a branch differs is it gone into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import written

#: Hex digits of a node's hash that a fingerprint shows.
SHOWN = 8
#: After what a paragraph is cut into clauses: a mark or the commonest last letter, and a space. One small set of Latin
#: characters, since others are several times slower to match; scripts without spaces are cut at line ends alone.
CUT = "[e.,;:!?] "


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


def _shown(x: Column) -> Column:
    return F.substring(x, 1, SHOWN)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.transform(F.array(x), f)[0]


def fingerprint(text: Column) -> Column:
    """root:section|section, a section hash=paragraph;paragraph and a paragraph hash-clause,clause."""

    def node(whole: Column, shown: Column, between: str, end: str) -> Column:
        """A branch from the whole and the shown hashes of what is below it."""
        hashed = _digest(F.array_join(whole, between))
        return _let(F.struct(hashed.alias("hash"), F.array_join(shown, between).alias("shown")), lambda n: F.struct(n["hash"].alias("hash"), F.concat_ws(end, _shown(n["hash"]), n["shown"]).alias("shown")))

    def paragraph(line: Column) -> Column:
        return _let(F.transform(F.split(line, f"(?<={CUT})", -1), _digest), lambda c: node(c, F.transform(c, _shown), ",", "-"))

    def section(part: Column) -> Column:
        return _let(F.transform(F.split(part, "\n", -1), paragraph), lambda p: node(p["hash"], p["shown"], ";", "="))

    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)
    return _let(sections, lambda s: F.concat_ws(":", _digest(F.array_join(s["hash"], "|")), F.array_join(s["shown"], "|")))


def root(fp: Column) -> Column:
    return F.substring_index(fp, ":", 1)


def _tree(fp: Column) -> Column:
    return F.substring_index(fp, ":", -1)


def leaves(fp: Column) -> Column:
    """The distinct clauses of a fingerprint."""
    return F.array_distinct(F.transform(F.split(_tree(fp), "[|;,]"), lambda x: F.substring(x, -SHOWN, SHOWN)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal roots, else twice the clauses in both over the clauses of each (Dice)."""
    both = _let(F.struct(leaves(a).alias("x"), leaves(b).alias("y")), lambda s: 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / (F.size(s["x"]) + F.size(s["y"])))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(both)


def _common(x: Column, y: Column, end: str) -> Column:
    """How many nodes from the first on have equal hashes, what is below them unseen."""
    differ = F.array_position(F.zip_with(x, y, lambda p, q: F.substring_index(p, end, 1).eqNullSafe(F.substring_index(q, end, 1))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(x)).cast("int")


def _descent(a: Column, b: Column, backwards: bool) -> Column:
    """section.paragraph.clause of the first difference of two trees, found from the root down."""

    def nodes(x: Column, between: str) -> Column:
        parts = F.split(F.coalesce(x, F.lit("")), between, -1)
        return F.reverse(parts) if backwards else parts

    def level(x: Column, y: Column, end: str, below: Callable[[Column, Column], Column] | None) -> Column:
        def found(s: Column) -> Column:
            if below is None:
                return s["k"].cast("string")
            node = lambda side: F.substring_index(F.get(s[side], s["k"]), end, -1)
            return F.concat_ws(".", s["k"].cast("string"), below(node("x"), node("y")))

        return _let(F.struct(x.alias("x"), y.alias("y")), lambda s: _let(F.struct(s["x"].alias("x"), s["y"].alias("y"), _common(s["x"], s["y"], end).alias("k")), found))

    clauses = lambda x, y: level(nodes(x, ","), nodes(y, ","), "/", None)
    paragraphs = lambda x, y: level(nodes(x, ";"), nodes(y, ";"), "-", clauses)
    return level(nodes(_tree(a), "[|]"), nodes(_tree(b), "[|]"), "=", paragraphs)


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: ``first``, the section.paragraph.clause of the first differing clause counted from
    0, and ``last``, that of the last one counted from the ends. Null for equal roots."""
    return F.when(root(a) != root(b), F.struct(_descent(a, b, False).alias("first"), _descent(a, b, True).alias("last")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; null counts as the empty text, which has one empty clause."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(id_col, F.char_length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def following(ids: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids with the next one in order, the first after the last, without sorting them in one task.

    Ids are dealt out by range; each range looks ahead within itself, and of each range only its ends meet."""
    ranged = written(ids.repartitionByRange(id_col).withColumn("__part", F.spark_partition_id()), "id-ranges")
    ends = ranged.groupBy("__part").agg(F.min(id_col).alias("__first"))
    order = Window.orderBy("__first")  # a row for each range
    ends = ends.select("__part", F.coalesce(F.lead("__first").over(order), F.min("__first").over(Window.partitionBy())).alias("__after"))
    inside = F.lead(id_col).over(Window.partitionBy("__part").orderBy(id_col))
    return ranged.withColumn("__inside", inside).join(ends, "__part").select(*ids.columns, F.coalesce("__inside", "__after").alias("next_id"))


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its fingerprint, that of its edited text, their likeness to each other and the next document's, and
    where the edit begins and ends in the tree (null if the text stays the same).

    The edited text keeps the first half of the code points (the longer half) and takes the rest from the beginning of
    the next document in order of id, as far as that goes. After the last comes the first, so a single document
    follows itself. Rows of one id follow each other in no order: each is followed by the next greater id, of whose
    rows the one with the fewest characters counts, then the one whose text sorts first. Rows with a null id have the
    empty text as the next document.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    half = F.floor(F.char_length("text") / 2)
    per_id = rows.where("id is not null").groupBy("id").agg(F.min(F.char_length("text")).alias("n"), F.max(half).alias("half"), F.count("*").alias("rows"))
    order = written(following(per_id, "id"), "id-order")
    marked = rows.select("id", "text", F.char_length("text").cast("long").alias("n"))
    # Both joins take the same filtered rows, so that one exchange of the texts serves both.
    alone, marked = marked.where("id is null"), marked.where("id is not null and n is not null")
    # Every document sends the next one its half; the next one answers with its beginning and its fingerprint.
    asks = order.select(F.col("next_id").alias("at"), F.col("id").alias("asks"), F.col("half"))
    asks = asks.join(order.select(F.col("id").alias("at"), F.col("n").alias("first_n")), "at")
    # No row of an id is shorter than its shortest; put so, the join is by the id alone.
    answers = marked.join(asks, (marked.id == asks["at"]) & (marked.n <= asks.first_n)).select("asks", F.expr("substring(text, 1, half)").alias("start"), fingerprint(F.col("text")).alias("next_fp"))
    if not order.where("rows > 1").isEmpty():
        answers = answers.groupBy("asks").agg(F.min_by(F.struct("start", "next_fp"), F.struct("start", "next_fp")).alias("s")).select("asks", "s.*")
    joined = marked.join(answers, marked.id == answers.asks).select("id", "text", "n", "start", "next_fp")
    joined = joined.unionByName(alone.select("*", F.lit("").alias("start"), fingerprint(F.lit("")).alias("next_fp")))
    edited = F.concat(F.expr("substring(text, 1, n - n div 2)"), F.expr("substring(start, 1, n div 2)"))
    out = joined.select("id", "n", fingerprint(F.col("text")).alias("fp"), "next_fp", edited.alias("edited"))
    out = out.select("id", "n", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    out = out.withColumn("edits", edits(F.col("fp"), F.col("edited_fp")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("edits.first").alias("first_edit"), F.col("edits.last").alias("last_edit"),
    )
