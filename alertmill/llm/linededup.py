"""Line dedup by a log-template tree, in DataFrame functions alone.

Method: a tree whose first levels are fixed. A line goes down by its token count and its leading tokens, in which tokens
with digits are variable; a leaf holds as many templates as its lines have. A template that recurs across documents is
boilerplate: all its lines but those of its first document go.

* Leaves of fewer than `documents` documents can hold no recurring template and are left at once; only lines of the
  others are split into tokens. Equal lines of a leaf are one kind; what recurs is counted in documents.
* A kind can belong to these templates, the widest first: that of the leaf's main tokens (at each place the token of at
  least `agreement` of the leaf's documents, else a variable field); its own text with tokens with digits masked; and a
  chain of templates whose constant tokens are those of its tokens that at least so many documents have at their place,
  for each number from `documents` on, down to a text that recurs word for word. The other tokens are variable fields.
* At least `match` of a line's tokens must be constant ones, and at least `match` of those after the leading ones, which
  the path has made equal; so short lines must recur word for word, but for tokens with digits. A line belongs to the widest of its templates that is in at
  least `documents` documents.

Lines are parted by newlines and tokens by blanks; empty lines stay. The order "first" is by doc_id, nulls last, then by
the row's content; equal rows are one document, and keep or lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import row_key, written

DEPTH = 3
DOCUMENTS = 8
AGREEMENT = 0.5
MATCH = 0.6


def tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r")), "[ \t\r]+")


def leaf(token: Column, depth: int) -> Column:
    """The path: how many tokens, and the leading ones with variable ones masked."""
    lead = F.transform(F.slice(token, 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.xxhash64(F.size(token), lead)


def lines_of(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, place and line, of the lines that are not blank."""
    split = F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("place", "line")
    rows = docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"), split)
    return rows.filter(F.trim("line") != "")


def templates(kinds: DataFrame, by_token: DataFrame, leaves: DataFrame, depth: int, documents: int, agreement: float, match: float) -> DataFrame:
    """leaf, same, rank and template: the templates that each kind of line could belong to, the widest first."""
    of_place = by_token.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("most")).join(leaves, "leaf")
    common = F.when(F.col("most.n") >= agreement * F.col("n"), F.col("most.token"))
    main = of_place.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", common.alias("token")))).alias("main"))
    often = by_token.filter(F.col("n") >= documents).select("leaf", "at", "token", (-F.col("n")).alias("less"))
    each = kinds.select("leaf", "same", F.posexplode("tokens").alias("at", "token"))
    chain = each.join(often, ["leaf", "at", "token"]).groupBy("leaf", "same").agg(F.sort_array(F.collect_list(F.struct("less", "at", "token"))).alias("chain"))
    rows = kinds.join(main, "leaf").join(chain, ["leaf", "same"], "left").withColumn("chain", F.coalesce("chain", F.array().cast(chain.schema["chain"].dataType)))

    n = F.size("tokens")
    beyond = lambda places: F.size(F.filter(places, lambda at: at >= depth))
    # the path says nothing about the tokens after it
    enough = lambda places: (F.size(places) >= match * n) & (beyond(places) >= match * (n - depth))
    agreed = F.filter(F.zip_with("tokens", "main", lambda t, c: F.when(t == c["token"], c["at"])), lambda at: at.isNotNull())
    literal = F.filter("tokens", lambda t: ~t.rlike("[0-9]"))
    masked = F.transform("tokens", lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    # a prefix of the chain ends where the next token is in fewer documents
    ends = F.filter(F.sequence(F.lit(1), F.size("chain")), lambda i: enough(F.slice(F.col("chain.at"), 1, i)) & ((i == F.size("chain")) | (F.get("chain", i)["less"] != F.get("chain", i - 1)["less"])))
    chained = F.when(F.size("chain") > 0, F.transform(ends, lambda i: F.xxhash64(F.lit("chain"), F.slice("chain", 1, i)))).otherwise(F.array().cast("array<long>"))
    wide = F.array(F.when(enough(agreed), F.xxhash64(F.lit("main"))), F.when(F.size(literal) >= match * n, F.xxhash64(F.lit("masked"), masked)))
    return rows.select("leaf", "same", F.posexplode(F.filter(F.concat(wide, chained), lambda x: x.isNotNull())).alias("rank", "template"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, documents: int = DOCUMENTS, agreement: float = AGREEMENT, match: float = MATCH) -> DataFrame:
    """k1, k2 and place of the lines whose template recurs, without those of its first document."""
    split = lines_of(docs).withColumn("token", tokens(F.col("line")))  # a column of its own, so that it is made once
    # paths are stored, as leaves are counted and then looked up
    found = written(split.select("k1", "k2", "place", leaf(F.col("token"), depth).alias("leaf")), "paths")
    in_docs = found.groupBy("leaf", "k1", "k2").agg(F.lit(1).alias("one"))
    common = written(in_docs.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= documents), "leaves")

    chosen = found.join(common.select("leaf"), "leaf").groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "leaf")).alias("chosen"))
    text = docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"), F.split(F.col("text").cast("string"), "\n").alias("lines"))
    met = text.join(chosen, ["k1", "k2"]).select("k1", "k2", "doc_id", F.explode(F.transform("chosen", lambda c: F.struct(c["place"].alias("place"), c["leaf"].alias("leaf"), F.xxhash64(tokens(F.col("lines")[c["place"]])).alias("same"), tokens(F.col("lines")[c["place"]]).alias("tokens")))).alias("l"))
    lines = written(met.select("k1", "k2", "doc_id", "l.*"), "lines")

    # equal lines of a leaf are split once; what recurs is counted in documents
    kinds = written(lines.groupBy("leaf", "same").agg(F.first("tokens").alias("tokens")), "kinds")
    in_doc = lines.select("leaf", "k1", "k2", F.posexplode("tokens").alias("at", "token")).distinct()
    by_token = written(in_doc.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")), "tokens")
    options = written(templates(kinds, by_token, common, depth, documents, agreement, match), "options")

    offered = lines.select("leaf", "same", "k1", "k2").join(options, ["leaf", "same"]).select("leaf", "template", "k1", "k2").distinct()
    recurring = offered.groupBy("leaf", "template").agg(F.count("*").alias("n")).filter(F.col("n") >= documents).select("leaf", "template")
    best = options.join(recurring, ["leaf", "template"]).groupBy("leaf", "same").agg(F.min(F.struct("rank", "template")).alias("best"))
    fits = lines.join(best, ["leaf", "same"]).select("leaf", F.col("best.template").alias("template"), "k1", "k2", "doc_id", "place")
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "k1", "k2")
    firsts = fits.groupBy("leaf", "template").agg(F.min(order).alias("first"))
    first = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    return fits.join(firsts, ["leaf", "template"]).filter(~first).select("k1", "k2", "place")


def without_lines(docs: DataFrame, **settings) -> DataFrame:
    """docs with its recurring lines taken out of text, and n_lines and n_dropped; other columns stay as they are. A null
    text stays null and has no lines; a text that loses all lines is empty."""
    gone = recurring_lines(docs, **settings).groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), *row_key("doc_id", "text"))
    met = keyed.join(gone, ["k1", "k2"], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    return met.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.size(lines).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that stays."""
    lines = F.when(F.col("text").isNull() & (F.col("n_dropped") == 0), F.lit(0)).otherwise(F.col("n_lines"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), lines.cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def replaced(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, with the same columns, their text without recurring lines."""
    found = without_lines(docs, **settings)
    kind = docs.schema["text"].dataType
    return found.select(*(F.col("text").cast(kind).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
