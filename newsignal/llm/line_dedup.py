"""Line dedup by a template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import maybe_in, same, unused
from newsignal.session import materialise, scratch

BLANKS = "\t\x0b\x0c\r"
VARIABLE = "<*>"
# A kind of line with more than this share of all lines is frequent: 10,000 kinds at most.
FREQUENT = 1e-4


def tokens_of(line: Column) -> Column:
    """What stands between blanks.

    Few lines have another blank than a space, and splitting at one character
    needs no regular expression.
    """
    spaced = F.when(line.rlike(f"[{BLANKS}]"), F.translate(line, BLANKS, " " * len(BLANKS))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def masked(token: Column) -> Column:
    """A token with a digit is a variable field."""
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def lines_of(docs: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """digest, all, position, size, leaf, line, tokens of every line that is long enough; equal texts repeat their rows.

    `all` and `size` are the lengths of text and line. A line's leaf in the tree
    is its token count and its first tokens; both are hashed into one number.
    """
    keyed = docs.where("text is not null").select(F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("all"), "text")
    # Tokens are made inside the explode, so that filters below it do not make them again.
    cut = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), tokens_of(x).alias("tokens")))
    each = keyed.select("digest", "all", F.posexplode(cut).alias("position", "cut")).select("digest", "all", "position", "cut.*")
    cut = each.withColumn("n", F.size("tokens"))
    head = F.transform(F.slice("tokens", 1, depth), masked)
    return cut.where(F.col("n") >= least_tokens).select(
        "digest", "all", "position", F.length("line").alias("size"), F.xxhash64("n", head).alias("leaf"), "line", "tokens"
    )


def line_templates(lines: DataFrame, similarity: float, least_docs: int) -> DataFrame:
    """leaf, code (the hash of a masked line), n (its lines), template.

    A leaf has as many templates as its lines call for. A token is constant where
    lines of `least_docs` documents of the leaf have it at that position, else a
    variable field. Lines whose constant tokens are the same, and are enough of
    the line, share a template; any other line is a template of its own.
    """
    kinds = materialise(
        lines.groupBy("leaf", "code", "fields").agg(F.count_distinct("digest").alias("docs"), F.count("*").alias("n"))
        .select("leaf", "code", "docs", "n", F.split("fields", " ").alias("tokens"))
    )
    at = kinds.select("leaf", "code", "docs", F.posexplode("tokens").alias("p", "token")).where(F.col("token") != VARIABLE)
    often = at.groupBy("leaf", "p", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # Written, so that the planner knows its size and broadcasts it where it is small.
    constant = at.join(materialise(often.select("leaf", "p", "token")), ["leaf", "p", "token"])
    shapes = constant.groupBy("leaf", "code").agg(F.array_sort(F.collect_list(F.struct("p", "token"))).alias("shape"))
    enough = F.size("shape") >= similarity * F.size("tokens")
    template = F.when(enough, F.xxhash64("leaf", "shape")).otherwise(F.col("code"))
    return kinds.join(shapes, ["leaf", "code"], "left").select("leaf", "code", "n", template.alias("template"))


def with_template(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """`lines` with the template of their leaf and code.

    Templates of frequent kinds, of which there are 1 / `FREQUENT` at most, are
    broadcast; only lines of the other kinds are shuffled, so a line that stands
    in a third of all documents does not meet in one task.
    """
    frequent = F.col("n") > F.lit(FREQUENT * lines.count())
    kind = ["leaf", "code"]
    known = lines.join(F.broadcast(templates.where(frequent).drop("n")), kind, "left")
    rest = known.where("template is null").drop("template").join(templates.where(~frequent).drop("n"), kind)
    return known.where("template is not null").unionByName(rest)


def recurring_lines(
    docs: DataFrame,
    least_docs: int = 5,
    depth: int = 3,
    least_tokens: int = 1,
    similarity: float = 0.6,
    copied_share: float = 0.5,
) -> DataFrame:
    """digest of a text and the positions of its lines to drop; `docs` has text.

    A template recurs if it occurs in `least_docs` different texts. A text with
    more than `copied_share` of its characters in recurring lines is a copy of
    another document, whose lines are no boilerplate; such texts are then left
    out of the count, though recurring lines are dropped from them too.
    """
    lines = lines_of(docs, depth, least_tokens)
    leaves = materialise(
        lines.select("leaf", "digest").distinct().groupBy("leaf").count().where(F.col("count") >= least_docs).select("leaf")
    )
    plain = F.size(F.filter("tokens", lambda t: ~t.rlike("[0-9]")))
    some = F.col("line").rlike("[0-9]") & (plain >= similarity * F.size("tokens"))
    fields = F.array_join(F.when(some, F.transform("tokens", masked)).otherwise(F.col("tokens")), " ")
    often = materialise(
        lines.join(leaves, "leaf").select("digest", "all", "position", "size", "leaf", fields.alias("fields"))
        .withColumn("code", F.xxhash64("fields"))
    )
    templates = materialise(line_templates(often, similarity, least_docs))
    placed = materialise(with_template(often.drop("fields"), templates).drop("leaf", "code").distinct())

    def recurring(rows: DataFrame) -> DataFrame:
        counted = rows.select("template", "digest").distinct().groupBy("template").count()
        return counted.where(F.col("count") >= least_docs).select("template")

    first = materialise(placed.join(recurring(placed), "template", "left_semi"))
    copied = materialise(
        first.groupBy("digest").agg(F.sum("size").alias("part"), F.max("all").alias("all"))
        .where(F.col("part") > copied_share * F.col("all")).select("digest")
    )
    final = materialise(recurring(first.join(copied, "digest", "left_anti")))
    return materialise(
        first.join(final, "template", "left_semi").groupBy("digest").agg(F.collect_list("position").alias("positions"))
    )


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **settings
) -> DataFrame:
    """`docs` with the text cut, and the columns `n_lines` and `n_dropped`.

    Lines are split at newlines. The tree has a fixed depth: token count, then
    the first `depth` tokens, tokens with digits being variable. In a line of
    too few other tokens, as in a table of numbers, no token is variable. Short
    lines have leaves of their own; lines of fewer than `least_tokens` tokens
    stay, by default blank ones only. See `recurring_lines` for what recurs.
    Lines that stay keep their order; a text without a dropped line is not
    changed.

    A NULL text stays NULL with 0 lines, an empty one has one line; an empty
    table gives an empty one. Whole texts of any length are read, one text's
    tokens being held at a time. Equal texts are counted once and get equal
    results. Own columns of the two names are
    replaced; other columns are passed through.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(recurring_lines(docs.select(F.col(text_col).alias("text")), **settings))
    digest, positions, maybe = unused(docs, "digest"), unused(docs, "positions"), unused(docs, "maybe")
    found = found.select(F.col("digest").alias(digest), F.col("positions").alias(positions))
    # Texts that a bitmap rules out have no position and are not shuffled.
    marked = maybe_in(docs.withColumn(digest, F.unhex(F.md5(F.col(text_col)))), digest, found.select(digest), maybe)
    none = F.lit(None).cast("array<int>").alias(positions)
    whole = marked.where(~F.col(maybe)).drop(maybe).select("*", none)
    joined = marked.where(F.col(maybe)).drop(maybe).join(found, digest, "left")
    joined = whole.unionByName(joined)
    lines = F.split(F.col(text_col), "\n")

    def without(cut: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(positions))
        return F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n")

    out = joined.withColumns(
        {
            n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
            n_dropped: F.when(F.col(positions).isNull(), 0).otherwise(F.size(F.col(positions))).cast("long"),
        }
    )
    changed = F.when(F.col(positions).isNull(), F.col(text_col)).otherwise(same(lines, "t", without))
    return out.withColumn(text_col, changed).drop(digest, positions)
