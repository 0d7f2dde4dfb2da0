"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree of domains, languages and sources by the weights of siblings. What a node can't
fill (its documents times the most epochs allowed) goes to its siblings first, since a parent is never given more than
all below it can hold; only what a whole subtree lacks goes to the siblings of an ancestor. Each leaf then takes whole
epochs of its documents and the beginning of one more, in an order that the seed and the epoch's number give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import written

LEVELS = ("domain", "lang", "source")
#: What counts as a token here: a run of characters without ASCII white space.
TOKEN = "[^\\x20\\x09-\\x0D]+"
#: Hex digits of the order key by which a leaf's documents are summed, first roughly, then in the one range where its
#: budget ends, before any are sorted: the range that is sorted has about a 65536th of the leaf.
_COARSE, _FINE = 2, 4


def tokens(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long")


def weight(level: str, weights: dict[str, int], default: int) -> Column:
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
    return F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(default).cast("long")) if pairs else F.lit(default).cast("long")


def filled(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``share`` for each node: its parent's ``budget`` by ``weight``, none over its ``capacity``, what some can't hold
    going to their siblings. In whole numbers, rounded down; a weight of 0 gets nothing."""
    order = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("weight")), name)
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).withColumn("weight", F.greatest("weight", F.lit(1)))
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("of", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("full", F.col("capacity") * F.col("of") <= F.col("weight") * F.col("left"))
    # The siblings after the first that isn't full share what is left then.
    open_ = F.first(F.when(~F.col("full"), F.struct("left", "of")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nodes = nodes.withColumn("open", open_)
    return nodes.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("greatest(0, weight * open.left div open.of)"))).drop("left", "of", "full", "open")


def budgets(leaves: DataFrame, budget: int, *, weights: dict[str, dict[str, int]], max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``share``, the tokens each leaf gives."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    domains = nodes.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    domains = domains.withColumn("budget", F.lit(int(budget)).cast("long")).withColumn("weight", weight("domain", weights.get("domain", {}), default_weight))
    level = filled(domains, [], "domain").select("domain", F.col("share").alias("budget"))
    langs = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(level, "domain").withColumn("weight", weight("lang", weights.get("lang", {}), default_weight))
    level = filled(langs, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    sources = nodes.join(level, ["domain", "lang"]).withColumn("weight", weight("source", weights.get("source", {}), default_weight))
    return filled(sources, ["domain", "lang"], "source").select(*LEVELS, "tokens", "share")


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def _named(docs: DataFrame, domain: Column, lang_col: str, source_col: str, text_col: str, *columns: Column) -> DataFrame:
    """``columns`` with the leaf and the tokens of each row; null labels are the empty name."""
    rows = docs.select(*columns, domain.cast("string").alias("domain"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), tokens(text_col).alias("n_tokens"))
    return rows.fillna("", list(LEVELS))


def _selected(rows: DataFrame, weights: dict[str, dict[str, int]], fraction: float, max_epochs: int, seed: int, ties: list[str]) -> DataFrame:
    """``rows`` (id, the leaf, n_tokens and more) with epochs and extra_tokens.

    What each leaf gives and where in its order it ends is a row for each leaf, written so that its size is known: few
    are sent to the rows, many are met in a join. Only rows of the range where a leaf ends are shuffled and sorted."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    amount = leaves.agg(F.floor(F.sum("tokens") * F.lit(float(fraction))).cast("long").alias("budget")).first()["budget"] or 0
    shares = budgets(leaves, amount, weights=weights, max_epochs=max_epochs)
    # Leaves without tokens have nothing to give and count as gone through not at all.
    shares = written(shares.withColumn("epochs", F.expr("if(tokens > 0, share div tokens, 0)")).withColumn("rest", F.expr("if(tokens > 0, share % tokens, 0)")).select(*LEVELS, "epochs", "rest"), "mixing-shares")
    key = order_key(seed, F.col("epochs"), F.col("id"))
    keyed = rows.select("id", *LEVELS, "n_tokens").join(shares, list(LEVELS)).withColumn("key", key)
    edge = None
    for digits in (_COARSE, _FINE):
        inside = keyed.withColumn("before", F.lit(0).cast("long")) if edge is None else keyed.join(edge, list(LEVELS)).where(F.col("key").startswith(F.col("edge")))
        sums = inside.groupBy(*LEVELS, F.substring("key", 1, digits).alias("range")).agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        so_far = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.col("before") + F.coalesce(so_far, F.lit(0)))
        edge = written(sums.where("before < rest and before + t >= rest").select(*LEVELS, F.col("range").alias("edge"), "before"), "mixing-edge")
    ends = written(shares.join(edge, list(LEVELS), "left"), "mixing-ends")
    marked = rows.join(ends, list(LEVELS)).withColumn("key", key).withColumn("range", F.substring("key", 1, _FINE))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "id", "n_tokens", *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = marked.where("range = edge").withColumn("extra_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before") - within)))
    outer = marked.where("edge is null or range != edge").withColumn("extra_tokens", F.when(F.col("range") < F.col("edge"), F.col("n_tokens")).otherwise(0))
    return inner.unionByName(outer).drop("rest", "edge", "before", "key", "range")


def selection(docs: DataFrame, *, domain: Column, weights: dict[str, dict[str, int]], fraction: float = 0.5, max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, domain, lang, source, n_tokens, epochs, extra_tokens) of every row.

    The budget is ``fraction`` of all tokens, rounded down. A row is taken ``epochs`` times whole, and of one epoch
    more its first ``extra_tokens`` tokens. Null labels are the empty name; null and empty texts have no tokens and
    are taken as often as their leaf is gone through whole. Rows of one id stand together in an epoch, shorter first.
    No leaf is sorted as a whole: sums over ranges of the order key find the range where its budget ends.
    """
    rows = written(_named(docs, domain, lang_col, source_col, text_col, F.col(id_col).alias("id")), "mixing-rows")
    out = _selected(rows, weights, fraction, max_epochs, seed, [])
    return out.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "epochs", "extra_tokens")


def first_tokens(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th token."""
    each = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{TOKEN}"), F.lit(0))
    return F.array_join(F.slice(each, F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, *, domain: Column, weights: dict[str, dict[str, int]], fraction: float = 0.5, max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as many times as ``selection`` takes it; the one document of a leaf in which its budget
    ends comes with its first tokens. So a leaf gives exactly its share of tokens.

    Rows are told apart by a number of their own, so those of a null or repeated id go by their own selection. Rows
    without tokens come as often as their leaf is gone through whole. An empty table gives an empty one."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = written(_named(docs, domain, lang_col, source_col, text_col, whole, F.col(id_col).alias("id")).withColumn("row", F.monotonically_increasing_id()), "mixing-docs")
    taken = _selected(rows, weights, fraction, max_epochs, seed, ["row"])
    taken = taken.withColumn("times", F.col("epochs") + (F.col("extra_tokens") > 0).cast("long")).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    text = F.col("doc")[text_col]
    cut = F.when((F.col("copy") > F.col("epochs")) & (F.col("extra_tokens") < F.col("n_tokens")), first_tokens(text, F.col("extra_tokens"))).otherwise(text)
    return taken.select(*[(cut if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
